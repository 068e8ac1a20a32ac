"""DuckDB twins of the queries that SQL can express."""

from tidemark.llm.licences import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pairs(words: str) -> str:
    """Neighbouring pairs of a list of words."""
    return f"CASE WHEN len({words}) > 1 THEN list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]) ELSE {words} END"


# Every window that begins at a bigram of the template, without any pruning.
OP1 = f"""
WITH notices(template, licence, notice) AS (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))}),
known AS (SELECT template, licence, len(p) AS n, list_distinct(p) AS b FROM
  (SELECT template, licence, {_pairs("w")} AS p FROM
    (SELECT template, licence, regexp_extract_all(translate(notice, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM notices))),
cut AS MATERIALIZED (SELECT r, doc_id, {_pairs("w")} AS p FROM
  (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents) WHERE len(w) > 0),
of_templates AS (SELECT template, unnest(b) AS x FROM known),
hits AS (SELECT r, pos, template FROM (SELECT r, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS x FROM cut) JOIN of_templates USING (x)),
windows AS (
  SELECT h.r, h.pos, h.template, list(g.pos) AS places FROM hits h JOIN known USING (template) JOIN hits g ON g.r = h.r AND g.template = h.template
  WHERE g.pos >= h.pos AND g.pos < h.pos + n GROUP BY 1, 2, 3),
sized AS (
  SELECT r, pos, template, licence, b, list_distinct(p[pos : list_max(places)]) AS a FROM windows JOIN cut USING (r) JOIN known USING (template)),
scored AS (SELECT r, pos, template, licence, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM sized),
best AS (SELECT r, template, licence, max(dice) AS dice, arg_min(pos, (-dice, pos)) AS pos FROM scored GROUP BY 1, 2, 3)
SELECT doc_id, template::INTEGER AS template, licence, (pos - 1)::INTEGER AS start, dice FROM best JOIN cut USING (r) WHERE dice >= 0.8
"""

# Sources fill up one after the other: each round shares out what is left among those still open.
OP9 = """
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM per),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS fills_at,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER earlier, 0)) / sum(weight) OVER later AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size,
    least(2.0::DOUBLE * source_size, weight * coalesce((SELECT level FROM levels WHERE level < fills_at ORDER BY fills_at, level LIMIT 1), 'infinity'::DOUBLE)) AS target
  FROM levels),
rated AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM rated
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (UPPER, LOWER)

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i : i + least(len(w), 10) - 1] AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, w[i : i + n - 1] AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, item FROM places p JOIN windows v ON p.win = v.win),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') AS k FROM cut),
shared AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT r, place, line, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM split JOIN kept USING (r)
"""

_ROUNDS = 6
_NEAREST = """
near{r} AS MATERIALIZED (
  SELECT row, part, c, min(d * 16 + entry) AS best FROM (
    SELECT row, p.part, p.c, entry, list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i])))::BIGINT AS d
    FROM parts p JOIN book{r} b ON p.part = b.part)
  GROUP BY row, part, c)"""
_BOOK = """
book{r} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM book{q} LEFT JOIN (
    SELECT part, entry, list(value ORDER BY place) AS m FROM (
      SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS value
      FROM (SELECT part, best % 16 AS entry, unnest(c) AS x, unnest(range(len(c))) AS place FROM near{q}) GROUP BY part, entry, place)
    GROUP BY part, entry) USING (part, entry))"""

# Six rounds, written out one after the other.
OP12 = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS c FROM kept, range(8) AS p(part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, c FROM parts WHERE row <= 16),
{",".join(_NEAREST.format(r=r) + "," + _BOOK.format(r=r + 1, q=r) for r in range(_ROUNDS))},
{_NEAREST.format(r=_ROUNDS)},
coded AS (SELECT row, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM near{_ROUNDS} GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{_ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), book
"""

# The checksum's table follows from its polynomial; a text's bytes are read from its hex form.
OP13 = f"""
WITH crc(tab) AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT r, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS f FROM d
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d),
wanted AS (
  SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {_WORDS} AS w FROM benchmark)
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM (SELECT {_WORDS} AS w FROM benchmark)),
held AS MATERIALIZED (SELECT r, f, count(*) AS n FROM runs GROUP BY r, f),
aim AS MATERIALIZED (SELECT f, count(*) AS n FROM wanted GROUP BY f),
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM held UNION SELECT f FROM aim)),
bytes AS (SELECT f, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM features),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
raw AS (SELECT bucket, sum(n) AS s FROM held JOIN hashed USING (f) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM aim JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw) AS all_s, (SELECT coalesce(sum(t), 0) FROM target) AS all_t),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM raw FULL JOIN target USING (bucket), totals),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS long, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY long) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= drawn THEN place END AS rank FROM ranked
"""

ORACLE = {
    "op1_license_scan": OP1, "op9_mixing": OP9, "op10_decontamination": OP10,
    "op11_line_dedup": OP11, "op12_vector_codes": OP12, "op13_importance_resampling": OP13,
}
