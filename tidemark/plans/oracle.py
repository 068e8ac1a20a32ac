"""The registered queries as SQL, for checking results in another engine."""

from __future__ import annotations

from tidemark.functions.columns import BAR_FEATURES, VECTOR_FEATURES
from tidemark.plans.adapters import EVENT_TYPES

F5 = ", ".join(BAR_FEATURES)

ITEM_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BARS = f"""bars AS (
  SELECT l_returnflag AS symbol, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
         first(l_extendedprice ORDER BY {ITEM_ORDER}) AS open,
         last(l_extendedprice ORDER BY {ITEM_ORDER}) AS close,
         min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
SERIES = """series AS (
  SELECT user_id AS series_id, event_id, value,
         row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n_rows,
         lead(value) OVER w AS next_value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
parts AS (
  SELECT *, CAST(floor(n_rows * CAST(0.8 AS DOUBLE) + 0.5) AS BIGINT) AS n_train FROM series),
splits AS (
  SELECT *, CASE WHEN pos < n_train THEN 'train' ELSE 'test' END AS split FROM parts)"""
NUMBERED_BARS = f"""{BARS}, bar_rows AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n_rows,
         {", ".join(f"lead({f}) OVER w AS next_{f}" for f in BAR_FEATURES)}
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
bar_splits AS (
  SELECT *, CAST(floor(n_rows * CAST(0.8 AS DOUBLE) + 0.5) AS BIGINT) AS n_train FROM bar_rows)"""
VECTORS = """vectors AS (
  SELECT vec_id AS seq_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS step,
         CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
VECTOR_STATS = """step_stats AS (
  SELECT step, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS std
  FROM vectors GROUP BY step)"""
LABELS = """clinical_labels AS (
  SELECT user_id AS seq_id, CAST(last(value ORDER BY ts, event_id) > 50 AS INTEGER) AS label
  FROM events GROUP BY user_id)"""
GAP_LABELS = f"""{LABELS}, kept_labels AS (SELECT * FROM clinical_labels WHERE seq_id % 7 <> 0)"""
CLINICAL = f"""clinical AS (
  SELECT user_id AS seq_id, event_id,
         {", ".join(f"CASE WHEN event_type = '{t}' THEN value ELSE 0.0 END AS {t}" for t in EVENT_TYPES)},
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
         count(*) OVER (PARTITION BY user_id) AS n_rows
  FROM events)"""
HASH_SPLIT = """CASE WHEN substr(md5('1-' || {id}), 1, 8) < 'cccccccc' THEN 'train'
  WHEN substr(md5('1-' || {id}), 1, 8) < 'e6666666' THEN 'valid' ELSE 'test' END"""
EXACT = """exact AS (
  SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('12345-' || vec_id), vec_id) <= 450
    THEN 'train' ELSE 'test' END AS split FROM embeddings)"""
RANGES = """SELECT vec_id, CASE WHEN vec_id < 300 THEN 'train' WHEN vec_id < 380 THEN 'valid' ELSE 'test' END AS split
FROM embeddings WHERE vec_id BETWEEN 0 AND 479"""
TASKS = """best AS (
  SELECT label, list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) - 1 AS pred
  FROM embeddings),
tasks AS (
  SELECT 'documents' AS task, CAST(quality AS INTEGER) AS label, CAST(n_chars > 1500 AS INTEGER) AS pred
  FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'vectors', label, CAST(pred AS INTEGER) FROM best),
classes AS (
  SELECT task, class_id, sum(actual) AS support, sum(said) AS said, sum(hit) AS tp FROM (
    SELECT task, label AS class_id, 1 AS actual, 0 AS said, CAST(label = pred AS INTEGER) AS hit FROM tasks
    UNION ALL SELECT task, pred, 0, 1, 0 FROM tasks) GROUP BY 1, 2),
report AS (
  SELECT task, class_id, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp,
         CAST(said - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn,
         coalesce(CAST(tp AS DOUBLE) / nullif(CAST(said AS DOUBLE), 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(CAST(support AS DOUBLE), 0), 0) AS recall,
         coalesce(2 * CAST(tp AS DOUBLE) / nullif(CAST(said + support AS DOUBLE), 0), 0) AS f1 FROM classes)"""


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + CAST(0 AS DOUBLE)"


def scaled(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} = {lo} THEN 0.5 ELSE ({x} - {lo}) / nullif({hi} - {lo}, 0) END"


def bar_range(f: str, scope: str = "") -> str:
    return f"min({f}) {scope} OVER (PARTITION BY symbol) AS {f}_min, max({f}) {scope} OVER (PARTITION BY symbol) AS {f}_max"


RANGED_BARS = f"{BARS}, ranged AS (SELECT *, {', '.join(bar_range(f) for f in BAR_FEATURES)} FROM bars)"
TRAIN_BARS = f"""{NUMBERED_BARS}, bar_scaled AS (
  SELECT *, {', '.join(bar_range(f, 'FILTER (WHERE pos < n_train)') for f in BAR_FEATURES)} FROM bar_splits)"""


def bar_models() -> str:
    """One row per symbol, feature and day, with the model fitted on train pairs."""
    rows = " UNION ALL ".join(
        f"""SELECT symbol, '{f}' AS feature, pos, n_rows, n_train, {f}_min AS lo, {f}_max AS hi,
          {scaled(f, f + '_min', f + '_max')} AS x, {scaled('next_' + f, f + '_min', f + '_max')} AS y,
          next_{f} AS actual FROM bar_scaled"""
        for f in BAR_FEATURES
    )
    return f"""{TRAIN_BARS}, model_rows AS ({rows}),
models AS (
  SELECT symbol, feature, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
  FROM model_rows WHERE pos + 1 < n_train GROUP BY 1, 2),
pairs AS (
  SELECT symbol, pos - n_train - 21 AS idx, feature, (slope * x + intercept) * (hi - lo) + lo AS predict, actual
  FROM model_rows JOIN models USING (symbol, feature)
  WHERE n_train >= 3 AND hi > lo AND slope IS NOT NULL
    AND pos - n_train - 21 >= 0 AND pos - n_train - 21 < (n_rows - n_train) - 23)"""


SERIES_MODELS = f"""{SERIES}, ranged AS (
  SELECT *, min(value) FILTER (WHERE pos < n_train) OVER (PARTITION BY series_id) AS lo,
         max(value) FILTER (WHERE pos < n_train) OVER (PARTITION BY series_id) AS hi FROM splits),
xy AS (
  SELECT *, {scaled('value', 'lo', 'hi')} AS x, {scaled('next_value', 'lo', 'hi')} AS y FROM ranged),
models AS (
  SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
  FROM xy WHERE pos + 1 < n_train GROUP BY series_id),
scored AS (
  SELECT xy.*, (slope * x + intercept) * (hi - lo) + lo AS predict
  FROM xy JOIN models USING (series_id) WHERE n_train >= 3 AND hi > lo AND slope IS NOT NULL)"""


def regression(by: str, source: str, metrics: list[str], digits: int, y: str = "actual", p: str = "predict") -> str:
    rounded = ", ".join(f"{r(m, digits)} AS {m}" for m in metrics)
    return f"""SELECT {by}, n, {rounded} FROM (
  SELECT *, sqrt(mse) AS rmse, mse / v AS rse, 1 - mse / v AS r2, c / sp AS pearson_r FROM (
    SELECT {by}, count(*) AS n, avg(({y} - {p}) * ({y} - {p})) AS mse, avg(abs({y} - {p})) AS mae,
      CASE WHEN var_pop({y}) > 0 THEN var_pop({y}) END AS v, covar_pop({y}, {p}) AS c,
      CASE WHEN stddev_pop({y}) * stddev_pop({p}) > 0 THEN stddev_pop({y}) * stddev_pop({p}) END AS sp
    FROM {source} GROUP BY ALL))"""


ORACLE: dict[str, str] = {
    "symbol_counts": f"WITH {BARS} SELECT symbol, count(date) AS n_rows FROM bars GROUP BY symbol",
    "symbol_total": f"WITH {BARS} SELECT count(DISTINCT symbol) AS n_symbols FROM bars",
    "typed_projection": f"WITH {BARS} SELECT date, symbol, {', '.join(VECTOR_FEATURES)} FROM bars WHERE symbol = 'R'",
    "target_values": f"WITH {BARS} "
    + " UNION ALL ".join(f"SELECT symbol, date, '{f}' AS target, {f} AS value FROM bars" for f in BAR_FEATURES),
    "feature_minmax_by_symbol": f"WITH {BARS} "
    + " UNION ALL ".join(
        f"SELECT symbol, '{f}' AS feature, min({f}) AS min, max({f}) AS max FROM bars GROUP BY symbol"
        for f in BAR_FEATURES
    ),
    "feature_stats_pooled": f"""WITH {VECTORS} SELECT step, count(value) AS n, {r('min(value)')} AS min,
{r('max(value)')} AS max, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM vectors GROUP BY step""",
    "scale_minmax_by_symbol": f"WITH {RANGED_BARS} SELECT symbol, date, "
    + ", ".join(f"{r(scaled(f, f + '_min', f + '_max'))} AS {f}" for f in BAR_FEATURES)
    + " FROM ranged",
    "scale_minmax_pooled": f"WITH {BARS} "
    + " UNION ALL ".join(
        f"SELECT symbol, date, {i} AS position, "
        f"{r(scaled(f, f'min({f}) OVER ()', f'max({f}) OVER ()'))} AS scaled FROM bars"
        for i, f in enumerate(VECTOR_FEATURES)
    ),
    "scale_minmax_pooled_steps": f"""WITH {VECTORS}, {VECTOR_STATS}
SELECT seq_id, step, {r(scaled('value', 'lo', 'hi'))} AS scaled FROM vectors JOIN step_stats USING (step)""",
    "scale_standard_train_fit": f"""WITH {VECTORS}, {EXACT},
stats AS (SELECT step, avg(value) AS mean, stddev_pop(value) AS std FROM vectors
  JOIN exact ON seq_id = vec_id WHERE split = 'train' GROUP BY step)
SELECT seq_id, step, split, {r('CASE WHEN std = 0 THEN 0 ELSE (value - mean) / nullif(std, 0) END')} AS scaled
FROM vectors JOIN exact ON seq_id = vec_id JOIN stats USING (step)""",
    "scale_minmax_train_with_label": f"""WITH {SERIES}, ranged AS (
  SELECT *, min(value) FILTER (WHERE fit) OVER w AS xlo, max(value) FILTER (WHERE fit) OVER w AS xhi,
         min(next_value) FILTER (WHERE fit) OVER w AS ylo, max(next_value) FILTER (WHERE fit) OVER w AS yhi
  FROM (SELECT *, split = 'train' AND next_value IS NOT NULL AS fit FROM splits)
  WINDOW w AS (PARTITION BY series_id))
SELECT series_id, pos, split, {r(scaled('value', 'xlo', 'xhi'))} AS x, {r(scaled('next_value', 'ylo', 'yhi'))} AS y
FROM ranged WHERE next_value IS NOT NULL""",
    "inverse_scale_one": f"""WITH {RANGED_BARS} SELECT symbol, date,
{r(scaled('close', 'close_min', 'close_max'))} AS scaled, {r('close', 4)} AS close FROM ranged""",
    "inverse_scale_all": f"WITH {BARS} SELECT symbol, date, "
    + ", ".join(f"{r(f, 4)} AS {f}" for f in BAR_FEATURES)
    + " FROM bars",
    "inverse_standard": f"WITH {VECTORS} SELECT seq_id, step, {r('value')} AS value FROM vectors",
    "split_chrono": f"WITH {SERIES} SELECT series_id, event_id, pos, split FROM splits",
    "split_ranges": RANGES,
    "split_hash": f"SELECT vec_id, {HASH_SPLIT.format(id='vec_id')} AS split FROM embeddings",
    "split_shuffle_exact": f"WITH {EXACT} SELECT vec_id, split FROM exact",
    "split_per_file_scale": f"""WITH {BARS}, files AS (
  SELECT *, CASE WHEN date < '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM bars),
ranged AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM files
  WINDOW w AS (PARTITION BY split, symbol))
SELECT split, symbol, date, {r(scaled('close', 'lo', 'hi'))} AS close FROM ranged""",
    "split_sizes": f"""WITH {SERIES}, {EXACT}
SELECT 'time' AS method, split, count(*) AS n FROM splits GROUP BY split
UNION ALL SELECT 'ranges', split, count(*) FROM ({RANGES}) GROUP BY split
UNION ALL SELECT 'hash', split, count(*) FROM (SELECT {HASH_SPLIT.format(id='vec_id')} AS split FROM embeddings) GROUP BY split
UNION ALL SELECT 'exact', split, count(*) FROM exact GROUP BY split""",
    "next_row_label": f"WITH {SERIES} SELECT series_id, pos, value, next_value FROM series WHERE next_value IS NOT NULL",
    "train_windows": f"""WITH {SERIES}, ranged AS (
  SELECT *, min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi
  FROM splits WHERE split = 'train'),
starts AS (SELECT series_id, pos AS window_id FROM ranged WHERE pos < n_train - 23)
SELECT series_id, window_id, pos - window_id AS step, {r(scaled('value', 'lo', 'hi'))} AS x,
       {r(scaled('next_value', 'lo', 'hi'))} AS label_next
FROM starts JOIN ranged USING (series_id) WHERE pos BETWEEN window_id AND window_id + 21""",
    "test_windows": f"""WITH {TRAIN_BARS}, test_rows AS (
  SELECT *, pos - n_train AS p, n_rows - n_train AS n FROM bar_scaled WHERE pos >= n_train),
starts AS (SELECT symbol, p AS window_id FROM test_rows WHERE p < n - 23)
SELECT symbol, window_id, p - window_id AS step, """
    + ", ".join(f"{r(scaled(f, f + '_min', f + '_max'))} AS {f}" for f in BAR_FEATURES)
    + """, CASE WHEN p - window_id = 21 THEN next_close END AS label_raw
FROM starts JOIN test_rows USING (symbol) WHERE p BETWEEN window_id AND window_id + 21""",
    "window_counts": """SELECT user_id AS series_id, count(*) AS n_rows, greatest(count(*) - 23, 0) AS n_windows
FROM events GROUP BY user_id""",
    "window_batches": f"""WITH {BARS}, sizes AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)
SELECT symbol, CAST(floor(w / 64) AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_examples FROM (
  SELECT symbol, unnest(range(greatest(n - 23, 0))) AS w FROM sizes) GROUP BY 1, 2""",
    "window_step_totals": f"""WITH {SERIES}, starts AS (
  SELECT series_id, pos AS window_id FROM series WHERE pos < n_rows - 23)
SELECT series_id, CAST(floor(window_id / 64) AS BIGINT) AS batch_id, pos - window_id AS step, count(*) AS n,
       {r('sum(value)', 4)} AS total
FROM starts JOIN series USING (series_id) WHERE pos BETWEEN window_id AND window_id + 21 GROUP BY 1, 2, 3""",
    "text_series_explode": f"""WITH {VECTORS}
SELECT seq_id AS line_no, step, floor(value * 10000) AS value FROM vectors""",
    "block_label": """SELECT vec_id, line_no, CAST(floor(line_no / 100) AS INTEGER) AS label FROM (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line_no FROM embeddings)""",
    "one_hot": """SELECT vec_id AS seq_id, CAST(k AS INTEGER) AS class, CAST(label = k AS INTEGER) AS y
FROM embeddings, range(10) AS t(k)""",
    "label_join": f"""WITH {CLINICAL}, {GAP_LABELS}
SELECT seq_id, event_id, {', '.join(EVENT_TYPES)}, label FROM clinical JOIN kept_labels USING (seq_id)""",
    "label_join_missing": f"""WITH {GAP_LABELS}, ids AS (SELECT DISTINCT user_id AS seq_id FROM events)
SELECT seq_id, 'label' AS missing FROM ids WHERE seq_id NOT IN (SELECT seq_id FROM kept_labels)
UNION ALL SELECT seq_id, 'features' FROM kept_labels WHERE seq_id NOT IN (SELECT seq_id FROM ids)""",
    "document_labels_missing": """SELECT doc_id, 'label' AS missing FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'features' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "align_end": f"""WITH {CLINICAL}, {GAP_LABELS}
SELECT seq_id, step, {', '.join(EVENT_TYPES)}, CASE WHEN step = n_rows - 1 THEN label END AS label,
       CAST(step = n_rows - 1 AS INTEGER) AS label_mask
FROM clinical JOIN kept_labels USING (seq_id)""",
    "align_end_padded": f"""WITH {CLINICAL}, {GAP_LABELS}
SELECT seq_id, step, click, error, CAST(step = n_rows - 1 AS INTEGER) AS label_mask, 1 AS step_mask
FROM clinical JOIN kept_labels USING (seq_id)
UNION ALL
SELECT seq_id, unnest(range(n_rows, 100)) AS step, 0, 0, 0, 0
FROM (SELECT DISTINCT seq_id, n_rows FROM clinical JOIN kept_labels USING (seq_id))""",
    "masked_label_counts": f"""WITH {LABELS}, sizes AS (
  SELECT user_id AS seq_id, count(*) AS n_rows FROM events GROUP BY user_id)
SELECT label, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_steps
FROM clinical_labels JOIN sizes USING (seq_id) GROUP BY label""",
    "eval_accuracy_f1": f"""WITH {TASKS} SELECT task, CAST(sum(support) AS BIGINT) AS n,
{r('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS accuracy, {r('avg(f1)')} AS f1_macro FROM report GROUP BY task""",
    "eval_class_report": f"""WITH {TASKS} SELECT task, class_id, support, tp, fp, fn, {r('precision')} AS precision,
{r('recall')} AS recall, {r('f1')} AS f1 FROM report""",
    "eval_confusion": f"WITH {TASKS} SELECT task, label, pred, count(*) AS n FROM tasks GROUP BY 1, 2, 3",
    "eval_regression": f"WITH {SERIES} "
    + regression(
        "split", "(SELECT * FROM splits WHERE next_value IS NOT NULL)",
        ["mse", "mae", "rmse", "rse", "r2", "pearson_r"], 6, "next_value", "value",
    ),
    "eval_auc_splits": f"""WITH docs AS (
  SELECT {HASH_SPLIT.format(id='doc_id')} AS split, quality AS label, n_chars AS score
  FROM labels JOIN documents USING (doc_id)),
by_score AS (SELECT split, score, sum(CAST(label = 1 AS BIGINT)) AS p, sum(CAST(label <> 1 AS BIGINT)) AS q
  FROM docs GROUP BY 1, 2),
ranked AS (SELECT *, sum(q) OVER (PARTITION BY split ORDER BY score) - q AS below FROM by_score)
SELECT split, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
       {r('sum(CAST(p AS DOUBLE) * (CAST(below AS DOUBLE) + CAST(q AS DOUBLE) / 2)) / nullif(CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE), 0)')} AS auc
FROM ranked GROUP BY split""",
    "forecast_quality": f"WITH {SERIES_MODELS} "
    + regression(
        "series_id",
        "(SELECT series_id, next_value AS actual, predict FROM scored WHERE pos + 1 >= n_train AND pos + 1 < n_rows)",
        ["mae", "mse", "rmse"], 6,
    ),
    "forecast_one": f"""WITH {bar_models()} SELECT symbol, idx, feature, {r('predict', 4)} AS predict, actual
FROM pairs WHERE feature = 'close'""",
    "forecast_all": f"WITH {bar_models()} SELECT symbol, idx, feature, {r('predict', 4)} AS predict, actual FROM pairs",
    "forecast_report": f"WITH {bar_models()} "
    + regression("symbol, feature", "pairs", ["mae", "rmse", "rse", "r2", "pearson_r"], 4),
    "predict_actual_series": f"""WITH {bar_models()}
SELECT symbol, idx, 'predict' AS series_name, {r('predict', 4)} AS value FROM pairs WHERE feature = 'close'
UNION ALL SELECT symbol, idx, 'actual', {r('actual', 4)} FROM pairs WHERE feature = 'close'""",
    "predict_actual_range": f"""WITH {bar_models()}
SELECT symbol, feature, CAST(trunc(min(least(predict, actual)) * CAST(0.98 AS DOUBLE)) AS BIGINT) AS range_min,
       CAST(trunc(max(greatest(predict, actual)) * CAST(1.02 AS DOUBLE)) AS BIGINT) AS range_max
FROM pairs GROUP BY 1, 2""",
    "overlay_series": f"""WITH {SERIES_MODELS}
SELECT series_id, 'train' AS series_name, pos AS idx, {r('value')} AS value FROM scored WHERE split = 'train'
UNION ALL SELECT series_id, 'actual', pos - 1, {r('value')} FROM scored WHERE split = 'test'
UNION ALL SELECT series_id, 'predicted', pos, {r('predict')} FROM scored WHERE split = 'test'""",
    "bars_from_csv": f"WITH {BARS} SELECT date, symbol, {F5} FROM bars WHERE symbol = 'A'",
    "series_from_text": f"""WITH {VECTORS}, lines AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line_no FROM embeddings)
SELECT line_no, CAST(floor(line_no / 100) AS INTEGER) AS label, step, floor(value * 10000) AS value
FROM vectors JOIN lines ON seq_id = vec_id""",
    "prepared_test_split": f"""WITH {VECTORS}, {EXACT}
SELECT seq_id, step, {r('value')} AS value, label FROM vectors JOIN exact ON seq_id = vec_id WHERE split = 'test'""",
}

ORACLE |= {
    "files_numbered": f"WITH {CLINICAL} SELECT seq_id, step, {', '.join(EVENT_TYPES)} FROM clinical",
    "files_range": f"WITH {CLINICAL} SELECT seq_id, step, {', '.join(EVENT_TYPES[:2])} FROM clinical WHERE seq_id BETWEEN 7 AND 40",
    "files_paired_aligned": ORACLE["align_end"],
    "files_unpaired": ORACLE["label_join_missing"],
}

STATE = f"""WITH {SERIES}
SELECT a.series_id, a.event_id,
       {r("sum(CASE WHEN b.pos = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3 END * power(2.0::DOUBLE / 3, a.pos - b.pos) * b.value)", 4)} AS state
FROM series a JOIN series b ON a.series_id = b.series_id AND b.pos <= a.pos GROUP BY 1, 2"""
POOLED = f"""WITH {SERIES_MODELS}, pooled AS (
  SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM xy
  WHERE pos < n_train - 2)
SELECT CAST(0 AS INTEGER) AS pos, {r('slope', 5)} AS value FROM pooled
UNION ALL SELECT 1, {r('intercept', 5)} FROM pooled"""
ORACLE |= {"fit_pooled_ml": POOLED}
ORACLE["scale_minmax_vector"] = ORACLE["scale_minmax_pooled"]
ORACLE |= {"stateful_score_batch": STATE, "stateful_score_stream": STATE}


def descent(steps: int, rate: float) -> str:
    """Full-batch descent from zero for windows of five values: one table per step, from the moments of the examples."""
    rows = ", ".join(["x", *[f"lead(x, {k}) OVER w" for k in range(1, 5)], "CAST(1 AS DOUBLE)"])
    tables = [
        f"""w{k} AS (SELECT b.i, w.v - {rate}::DOUBLE * (s.av - b.b) AS v FROM b JOIN w{k - 1} w USING (i) JOIN (
  SELECT a.i, sum(a.a * w.v) AS av FROM a JOIN w{k - 1} w ON a.j = w.i GROUP BY a.i) s USING (i))"""
        for k in range(1, steps + 1)
    ]
    return f"""WITH {SERIES_MODELS}, windows AS (
  SELECT [{rows}] AS x, lead(y, 4) OVER w AS y, pos, n_train FROM xy WHERE pos < n_train
  WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
examples AS (SELECT x, y FROM windows WHERE pos < n_train - 6),
places AS (SELECT unnest(range(1, 7)) AS i),
a AS (SELECT p.i, q.i AS j, avg(x[p.i] * x[q.i]) AS a FROM examples, places p, places q GROUP BY ALL),
b AS (SELECT i, avg(x[i] * y) AS b FROM examples, places GROUP BY ALL),
w0 AS (SELECT i, CAST(0 AS DOUBLE) AS v FROM places),
{", ".join(tables)}
SELECT CAST(i - 1 AS INTEGER) AS pos, {r("v", 6)} AS value FROM w{steps}"""


ORACLE["train_avg_linear"] = ORACLE["train_avg_barrier"] = ORACLE["model_round_trip"] = descent(5, 0.2)
ORACLE["forecast_unfitted"] = f"""WITH {TRAIN_BARS}, long AS ({" UNION ALL ".join(
    f"SELECT symbol, pos, n_rows, n_train, '{f}' AS feature, {f}_min AS lo, {f}_max AS hi, {f} AS v FROM bar_scaled" for f in BAR_FEATURES
)}),
per AS (SELECT symbol, feature, any_value(n_rows) AS n_rows, any_value(n_train) AS n_train, any_value(lo) AS lo, any_value(hi) AS hi,
  count(DISTINCT v) FILTER (WHERE pos + 1 < n_train) AS kinds FROM long GROUP BY 1, 2)
SELECT symbol, feature, CASE WHEN n_train < 3 THEN 'fewer than 3 train rows' WHEN lo IS NULL THEN 'no train values'
  WHEN hi <= lo THEN 'constant in train' ELSE 'constant before the last train row' END AS reason, n_rows
FROM per WHERE n_train < 3 OR lo IS NULL OR hi <= lo OR kinds < 2"""


def window_models(rows: str, key: str, pooled: bool, features: int, targets: list[int], length: int, l2: float = 1.0) -> str:
    """Window models and their test forecasts, by the definition: windows written out, normal equations, elimination.

    ``rows`` has key, pos, n_train, n_rows, f (0, 1, ...), v (scaled), lo, hi, raw.
    """
    n = length * features + 1
    k = "0" if pooled else key
    aims = ", ".join(f"({f}, {n + t})" for t, f in enumerate(targets))
    return f"""long AS MATERIALIZED ({rows}), aims(f, j) AS (VALUES {aims}),
inputs AS (
  SELECT {key}, pos - s AS w, CAST(s * {features} + f AS INTEGER) AS i, v FROM long, range({length}) AS t(s)
  WHERE pos < n_train AND pos - s BETWEEN 0 AND n_train - {length + 2}),
augmented AS MATERIALIZED (
  SELECT {k} AS k, {key}, w, i, v FROM inputs
  UNION ALL SELECT {k}, {key}, w, {n - 1}, CAST(1 AS DOUBLE) FROM (SELECT DISTINCT {key}, w FROM inputs)
  UNION ALL SELECT {k}, {key}, pos - {length}, j, v FROM long JOIN aims USING (f) WHERE pos < n_train - 1 AND pos >= {length}),
products AS MATERIALIZED (
  SELECT a.k, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i AND a.i < {n - 1} THEN {l2} ELSE 0 END AS v
  FROM augmented a JOIN augmented b ON a.{key} = b.{key} AND a.w = b.w WHERE a.i < {n} GROUP BY a.k, a.i, b.i),
eliminated(k, step, i, line) AS (
  SELECT k, 0, i, list(v ORDER BY j) FROM products GROUP BY k, i
  UNION ALL
  SELECT k, step + 1, i, CASE WHEN i = step THEN list_transform(line, lambda x: x / line[step + 1])
    ELSE list_transform(line, lambda x, j: x - line[step + 1] * top[j] / top[step + 1]) END
  FROM (SELECT *, max(CASE WHEN i = step THEN line END) OVER (PARTITION BY k) AS top FROM eliminated) WHERE step < {n}),
weights AS MATERIALIZED (SELECT k, i, CAST({n} + t AS INTEGER) AS j, line[{n + 1} + t] AS v FROM eliminated, range({len(targets)}) AS u(t) WHERE step = {n}),
told AS (
  SELECT {key}, w, j, sum(x.v * weights.v) AS said FROM (
    SELECT {k} AS k, {key}, pos - n_train - s AS w, CAST(s * {features} + f AS INTEGER) AS i, v FROM long, range({length}) AS t(s)
    WHERE pos - n_train - s BETWEEN 0 AND n_rows - n_train - {length + 2}) x JOIN weights USING (k, i) GROUP BY 1, 2, 3),
window_pairs AS (
  SELECT told.{key}, w AS idx, long.f, (said + b.v) * (hi - lo) + lo AS predict, raw AS actual
  FROM told JOIN aims USING (j) JOIN long ON long.{key} = told.{key} AND long.f = aims.f AND long.pos = n_train + w + {length}
  JOIN weights b ON b.k = {k.replace(key, "told." + key)} AND b.i = {n - 1} AND b.j = told.j)"""


_BAR_ROWS = " UNION ALL ".join(
    f"SELECT symbol, pos, n_train, n_rows, {i} AS f, {scaled(f, f + '_min', f + '_max')} AS v, {f}_min AS lo, {f}_max AS hi, {f} AS raw FROM bar_scaled"
    for i, f in enumerate(BAR_FEATURES)
)
_SERIES_ROWS = "SELECT series_id, pos, n_train, n_rows, 0 AS f, x AS v, lo, hi, value AS raw FROM xy"
_FEATURE = f"[{', '.join(repr(f) for f in BAR_FEATURES)}][f + 1]"
_ALL_BARS = f"WITH RECURSIVE {TRAIN_BARS}, {window_models(_BAR_ROWS, 'symbol', True, 5, [0, 1, 2, 3, 4], 22)}"
ORACLE |= {
    "forecast_window_all": f"{_ALL_BARS} SELECT symbol, idx, {_FEATURE} AS feature, {r('predict', 2)} AS predict, actual FROM window_pairs",
    "forecast_window_report": f"{_ALL_BARS}, named AS (SELECT symbol, {_FEATURE} AS feature, predict, actual FROM window_pairs) "
    + regression("symbol, feature", "named", ["mae", "rmse", "r2"], 3),
    "forecast_window_one": f"WITH RECURSIVE {TRAIN_BARS}, {window_models(_BAR_ROWS, 'symbol', False, 5, [1], 22)} "
    f"SELECT symbol, idx, {r('predict', 2)} AS predict, actual FROM window_pairs",
    "window_model_series": f"WITH RECURSIVE {SERIES_MODELS}, {window_models(_SERIES_ROWS, 'series_id', True, 1, [0], 22)} "
    f"SELECT i AS pos, {r('v')} AS value FROM weights",
    "forecast_window_series": f"WITH RECURSIVE {SERIES_MODELS}, {window_models(_SERIES_ROWS, 'series_id', False, 1, [0], 5)} "
    f"SELECT series_id, idx, {r('predict', 4)} AS predict, actual FROM window_pairs",
}


def trend_states(rows: str) -> str:
    """Level and trend, one row after the other; rows has series_id, pos, x and restart."""
    a, b = "(CAST(1 AS DOUBLE) / 3)", "(CAST(1 AS DOUBLE) / 7)"
    level = f"({a} * n.x + (1 - {a}) * (s.level + s.trend))"
    return f"""steps AS MATERIALIZED ({rows}),
states(series_id, pos, level, trend) AS (
  SELECT series_id, pos, CAST(x AS DOUBLE), CAST(0 AS DOUBLE) FROM steps WHERE pos = 0
  UNION ALL
  SELECT n.series_id, n.pos, CASE WHEN n.restart THEN n.x ELSE {level} END,
    CASE WHEN n.restart THEN 0 ELSE {b} * ({level} - s.level) + (1 - {b}) * s.trend END
  FROM states s JOIN steps n ON n.series_id = s.series_id AND n.pos = s.pos + 1)"""


ORACLE |= {
    "state_train_to_test_overlay": f"""WITH RECURSIVE {SERIES_MODELS}, {trend_states("SELECT series_id, pos, x, FALSE AS restart FROM xy")},
told AS (SELECT xy.*, (level + trend) * (hi - lo) + lo AS said FROM xy JOIN states USING (series_id, pos))
SELECT series_id, 'train' AS series_name, pos AS idx, {r('value', 4)} AS value FROM told WHERE split = 'train'
UNION ALL SELECT series_id, 'actual', pos - 1, {r('value', 4)} FROM told WHERE split = 'test'
UNION ALL SELECT series_id, 'predicted', pos, {r('said', 4)} FROM told WHERE split = 'test'""",
    "state_with_restarts": f"""WITH RECURSIVE {SERIES}, {trend_states("SELECT series_id, pos, event_id, value AS x, event_type = 'signup' AS restart FROM series JOIN (SELECT event_id, event_type FROM events) USING (event_id)")}
SELECT series_id, event_id, {r('level', 4)} AS level, {r('trend', 4)} AS trend FROM states JOIN steps USING (series_id, pos)""",
}

ORACLE["prepared_written_once"] = f"""WITH {VECTORS}, {EXACT}
SELECT split, count(*) AS features, count(DISTINCT seq_id) AS labels, count(*) FILTER (WHERE step < 10) AS features_anew,
  count(DISTINCT seq_id) AS labels_anew, 2 AS writes FROM vectors JOIN exact ON seq_id = vec_id GROUP BY split"""

_ROC = f"""docs AS (
  SELECT {HASH_SPLIT.format(id='doc_id')} AS split, quality AS label,
    least(63, CAST(floor(n_chars::DOUBLE / 16384 * 64) AS INTEGER)) AS bin FROM labels JOIN documents USING (doc_id)),
bins AS (SELECT split, bin, sum(CAST(label = 1 AS BIGINT)) AS p, sum(CAST(label <> 1 AS BIGINT)) AS q FROM docs GROUP BY 1, 2)"""
ORACLE |= {
    "eval_roc_thresholds": f"""WITH {_ROC}
SELECT a.split, a.bin / 64.0::DOUBLE AS threshold, CAST(sum(b.p) FILTER (WHERE b.bin >= a.bin) AS BIGINT) AS tp,
  CAST(sum(b.q) FILTER (WHERE b.bin >= a.bin) AS BIGINT) AS fp,
  {r('CAST(sum(b.p) FILTER (WHERE b.bin >= a.bin) AS DOUBLE) / nullif(CAST(sum(b.p) AS DOUBLE), 0)')} AS tpr,
  {r('CAST(sum(b.q) FILTER (WHERE b.bin >= a.bin) AS DOUBLE) / nullif(CAST(sum(b.q) AS DOUBLE), 0)')} AS fpr
FROM bins a JOIN bins b USING (split) GROUP BY a.split, a.bin""",
    "eval_roc_area": f"""WITH {_ROC}, pairs AS (
  SELECT a.split, sum(a.p * b.q * CASE WHEN b.bin < a.bin THEN 1.0::DOUBLE WHEN b.bin = a.bin THEN 0.5 ELSE 0 END) AS won
  FROM bins a JOIN bins b USING (split) GROUP BY a.split),
totals AS (SELECT split, sum(p) AS p, sum(q) AS q FROM bins GROUP BY split)
SELECT split, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, {r('won / nullif(CAST(p AS DOUBLE) * CAST(q AS DOUBLE), 0)')} AS auc
FROM pairs JOIN totals USING (split)""",
    "classify_aligned_steps": f"""WITH {LABELS}
SELECT label AS class, count(*) AS n, CAST(count(*) AS DOUBLE) AS probability
FROM clinical_labels WHERE {HASH_SPLIT.format(id='seq_id')} = 'train' GROUP BY label""",
    "classify_vector_steps": f"""WITH {EXACT}
SELECT label AS class, count(*) AS n, CAST(count(*) AS DOUBLE) AS probability
FROM embeddings JOIN exact USING (vec_id) WHERE split = 'train' GROUP BY label""",
}

ORACLE["state_stream_from_batch"] = f"""WITH RECURSIVE {SERIES_MODELS}, {trend_states("SELECT series_id, pos, x, FALSE AS restart FROM xy")}
SELECT series_id, event_id, {r('level')} AS level, {r('trend')} AS trend FROM states JOIN xy USING (series_id, pos) WHERE split = 'test'"""
