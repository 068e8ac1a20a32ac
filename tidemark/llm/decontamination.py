"""Find benchmark passages in documents by a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import ascii_lower, fresh
from tidemark.session import write_through

# Windows that are sent to every executor at once; more of them are joined in several blocks.
BLOCK = 50_000
# Words in a shingle, the token whose rarity orders the join; shorter items have one shorter shingle.
SHINGLE = 3


def word_array(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def _row_key(key: str, text: str) -> list[Column]:
    """Names a row by its id and text; rows that agree in both have the same result."""
    return [F.col(key).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h")]


def _shingle(words: Column, at: Column, q: int) -> Column:
    """Hash of q words from the 0-based place."""
    return F.xxhash64(F.lit(q), *[F.get(words, at + j) for j in range(q)])


def item_windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """``item, window`` for all runs of ``width`` words; an item of fewer has one window, one of none has none."""
    words = items.select(F.col(item).cast("string").alias("item"), word_array(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    cut = words.withColumn("at", F.explode(starts))
    return cut.select("item", F.slice("w", F.col("at") + 1, F.least(F.size("w"), F.lit(width))).alias("window")).distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """Each window's shingles: ``wid, q, offset, token``."""
    q = F.least(F.size("window"), F.lit(SHINGLE))
    at = F.explode(F.sequence(F.lit(0), F.size("window") - q)).alias("offset")
    rows = windows.select("wid", "window", q.alias("q"), at)
    token = F.coalesce(*[F.when(F.col("q") == n, _shingle(F.col("window"), F.col("offset"), n)) for n in range(1, SHINGLE + 1)])
    return rows.select("wid", "q", "offset", token.alias("token"))


def _doc_shingles(docs: DataFrame, text: str, q: int, keep: list[Column]) -> DataFrame:
    """Each place of each document with its shingle of q words: ``*keep, w, pos, token``.

    Rows carry their document's words by reference, as long as nothing but
    projections, filters and a broadcast join follows; so callers drop ``w`` in
    the same stage.
    """
    rows = docs.select(*keep, word_array(F.col(text)).alias("w")).where(F.size("w") >= q)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - q)).alias("pos"))
    return rows.select("*", _shingle(F.col("w"), F.col("pos"), q).alias("token"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """Where windows of items occur: ``__id, __h, start, len, window, wid`` of document rows, and the table of windows.

    A window occurs only if all of its shingles do, so its prefix at full
    containment is one shingle: the rarest, counted over all documents (ties by
    hash). Only that one is joined. A match fixes where the window would start;
    it must lie inside the document (length and position), and then all words
    are compared. Windows go out in blocks of at most ``BLOCK``, whatever the
    number of items.
    """
    windows = item_windows(items, item, item_text, width)
    distinct = windows.select("window").distinct().withColumn("wid", F.xxhash64("window", F.lit(1)))
    shingles = write_through(_window_shingles(distinct), "window-shingles")
    tokens = shingles.select("q", "token").distinct()
    sizes = sorted(r.q for r in tokens.select("q").distinct().collect())
    if not sizes:
        return None, windows
    n_blocks = -(-tokens.count() // BLOCK)
    block_of = F.pmod(F.xxhash64("token", F.lit(7)), F.lit(n_blocks))
    counted = []
    for b, q in product(range(n_blocks), sizes):
        block = F.broadcast(tokens.where((block_of == b) & (F.col("q") == q)).select("token"))
        found = _doc_shingles(docs, text, q, []).select("token").join(block, "token").groupBy("token").count()
        counted.append(found.select(F.lit(q).alias("q"), "token", "count"))
    counted = _union(counted)
    counted = write_through(counted, "shingle-counts")
    # A window with a shingle that no document has can't occur at all.
    ranked = shingles.join(counted, ["q", "token"], "left").groupBy("wid").agg(
        F.min(F.coalesce("count", F.lit(0))).alias("least"), F.min_by(F.struct("q", "offset", "token"), F.struct(F.coalesce("count", F.lit(0)), "token", "offset")).alias("rarest")
    )
    prefixes = write_through(
        ranked.where("least > 0").join(distinct, "wid").select("wid", "window", "rarest.q", "rarest.offset", "rarest.token"), "prefixes"
    )
    n_blocks = max(1, -(-prefixes.count() // BLOCK))
    block_of = F.pmod(F.xxhash64("wid", F.lit(7)), F.lit(n_blocks))
    found = []
    for b, q in product(range(n_blocks), sizes):
        block = F.broadcast(prefixes.where((block_of == b) & (F.col("q") == q)).drop("q"))
        rows = _doc_shingles(docs, text, q, _row_key(key, text)).join(block, "token")
        start = F.col("pos") - F.col("offset")
        length = F.size("window")
        rows = rows.where((start >= 0) & (start + length <= F.size("w")))
        # A slice may be made before the place is looked at; it must be valid anyway.
        rows = rows.where(F.slice("w", F.greatest(start + 1, F.lit(1)), length) == F.col("window"))
        found.append(rows.select("__id", "__h", start.alias("start"), length.alias("len"), "wid"))
    found = _union(found)
    return write_through(found.distinct(), "occurrences"), windows


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items`` (sorted ids of items with occurring windows, as strings).

    A word inside any occurrence of a window is hit, once. Null and empty texts
    have no words; rows with a null id are judged by their text like others;
    repeated rows each get their result; an empty table of items hits nothing;
    input columns named like results are replaced. Matched places are grouped by
    document, so a group holds one text's places at most.
    """
    found, windows = occurrences(docs, items, key, text, item, item_text, width)
    plain = docs.drop("n_words", "n_hit", "items")
    counted = plain.withColumns({"n_words": F.size(word_array(F.col(text))).cast("long")})
    if found is None:
        return counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    end = F.col("start") + F.col("len")
    spans = found.select("__id", "__h", "start", end.alias("end")).distinct()
    before = Window.partitionBy("__id", "__h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new_words = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    hits = spans.withColumn("reach", F.max("end").over(before)).groupBy("__id", "__h").agg(F.sum(new_words).alias("__hit"))
    by_wid = windows.select("item", F.xxhash64("window", F.lit(1)).alias("wid"))
    named = found.select("__id", "__h", "wid").distinct().join(by_wid, "wid").groupBy("__id", "__h").agg(F.sort_array(F.collect_set("item")).alias("__items"))
    names = {c: fresh(f"__{c}", docs.columns) for c in ("i", "k", "hit", "items", "h")}
    i, k, hit, held, here = names.values()
    both = hits.join(named, (hits["__id"].eqNullSafe(named["__id"])) & (hits["__h"] == named["__h"])).select(
        hits["__id"].alias(i), hits["__h"].alias(k), F.col("__hit").alias(hit), F.col("__items").alias(held)
    )
    keyed = counted.withColumn(here, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(both, (keyed[key].eqNullSafe(both[i])) & (keyed[here] == both[k]), "left")
    done = {"n_hit": F.coalesce(F.col(hit), F.lit(0)).cast("long"), "items": F.coalesce(held, F.array().cast("array<string>"))}
    return joined.withColumns(done).drop(i, k, hit, held, here)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    found, _ = occurrences(docs, items, **options)
    if found is None:
        return docs
    bad = found.select(F.col("__id").alias("__i"), F.col("__h").alias("__k")).distinct()
    here = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[key].eqNullSafe(bad["__i"]) & (here == bad["__k"]), "left_anti")
