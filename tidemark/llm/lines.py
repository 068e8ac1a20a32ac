"""Lines that many documents share: first occurrences by a range-partitioned sort, kept lines as bitmaps.

Every line long enough is a row ``(two hashes, document, text hash, place)``.
The rows are range-partitioned and sorted by all of these, so a line's
occurrences follow one another, largest document first, and a line that a third
of all documents holds spreads over as many partitions as its rows fill. Each
partition streams its rows once. A line that lies wholly inside the partition is
decided there; of the first and the last line of a partition, which may go on in
its neighbours, only a summary is exchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import ascii_lower, fresh, slices, small_batches
from tidemark.session import write_through

# So many border lines, of 33 bytes, are sent to every executor; more of them are joined by key.
BROADCAST_BORDERS = 200_000
BLANKS = " \t\n\x0b\x0c\r"
NEWLINE = "\n"

_RUN = "kind string, h1 bigint, h2 bigint, doc bigint, no_doc boolean, th bigint, place int"
_RUN_ARROW = pa.schema([("kind", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("no_doc", pa.bool_()), ("th", pa.int64()), ("place", pa.int32())])


def line_array(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), NEWLINE, -1)


def text_hash(text: Column) -> Column:
    """Names a text beside its document's key: null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """``h1, h2, doc, th, place`` of every line whose key has ``least_chars`` code points or more."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), text_hash(F.col(text)).alias("th"), F.posexplode(line_array(F.col(text))).alias("place", "line"))
    # No line shorter than that in bytes can be long enough, and most of the blank ones go here.
    rows = rows.where(F.octet_length("line") >= least_chars).select("doc", "th", "place", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("line"))
    return rows.where(F.char_length("line") >= least_chars).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "th", "place")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it; the first row counts as different."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class _Line:
    """One line's occurrences so far: its largest documents here, and the rows that wait for more of them."""

    def __init__(self, h1: int, h2: int, border: bool):
        self.h1, self.h2, self.border, self.docs, self.waiting = h1, h2, border, [], []

    def add(self, doc: np.ndarray, none: np.ndarray, th: np.ndarray, place: np.ndarray, needed: int) -> list:
        """Take more rows; the ones to drop come back as soon as the line has enough documents.

        The first line of a partition may have begun before it, so even its
        first document here need not be its largest.
        """
        if len(self.docs) < needed:
            for at in np.flatnonzero(_changes(doc, none)).tolist():
                one = None if none[at] else int(doc[at])
                if not self.docs or self.docs[-1] != one:
                    self.docs.append(one)
                if len(self.docs) >= needed:
                    break
        if not self.border:
            rest = ~none if self.docs[0] is None else none | (doc != self.docs[0])
            doc, none, th, place = doc[rest], none[rest], th[rest], place[rest]
        self.waiting.append((doc, none, th, place))
        if len(self.docs) < needed:
            return []
        out, self.waiting = self.waiting, []
        return out


def _batch(kind: str, line: _Line, doc: np.ndarray, none: np.ndarray, th: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    arrays = [
        pa.array([kind] * n, pa.string()), pa.array(np.full(n, line.h1, np.int64)), pa.array(np.full(n, line.h2, np.int64)),
        pa.array(doc, pa.int64()), pa.array(none), pa.array(th, pa.int64()), pa.array(place, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_RUN_ARROW)


def _close(line: _Line, last: bool) -> Iterator[pa.RecordBatch]:
    """What others need to know of a line that isn't decided in this partition."""
    if line.border or last:
        n = len(line.docs)
        none = np.array([d is None for d in line.docs])
        yield _batch("border", line, np.array([d or 0 for d in line.docs], np.int64), none, np.zeros(n, np.int64), np.zeros(n, np.int32))
        for part in line.waiting:
            yield _batch("open", line, *part)


def _stream(batches: Iterator[pa.RecordBatch], needed: int) -> Iterator[pa.RecordBatch]:
    """Decide lines inside the partition; pass on the first and the last one.

    Rows come out as ``drop`` (decided), ``border`` (documents of the first and
    the last line, the largest first, ``needed`` at most) and ``open`` (rows of
    such a line, to be dropped if all its borders together say so). A line that
    begins here, not at the partition's start, has its largest document here.
    """
    line, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, th, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "th", "place"))
        none = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(_changes(h1, h2))
        ends = np.append(starts[1:], len(h1))
        # Most lines come once: only runs of two rows or more, and those at the batch's ends, are looked at.
        several = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(h1)))
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            if line is None or line.h1 != h1[a] or line.h2 != h2[a]:
                if line is not None:
                    yield from _close(line, False)
                line, first = _Line(int(h1[a]), int(h2[a]), first), False
            for part in line.add(doc[a:b], none[a:b], th[a:b], place[a:b], needed):
                if len(part[0]):
                    yield _batch("open" if line.border else "drop", line, *part)
    if line is not None:
        yield from _close(line, True)


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``doc, th, place`` of every line to drop: held by ``least_docs`` documents, and this isn't the largest of them.

    Rows of one key are one document; rows without a key are one document too,
    the smallest. Repeated rows give repeated results.
    """
    order = ["h1", "h2", F.col("doc").desc_nulls_last(), "th", "place"]
    rows = long_lines(docs, key, text, least_chars)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = write_through(rows.mapInArrow(lambda batches: _stream(batches, least_docs), _RUN), "line-runs")
    document = F.struct((~F.col("no_doc")).alias("known"), F.col("doc"))
    # Few lines a partition, and of each at most least_docs documents.
    borders = found.where("kind = 'border'").groupBy("h1", "h2").agg(F.max(document).alias("largest"), F.countDistinct(document).alias("n"))
    borders = write_through(borders.where(F.col("n") >= least_docs), "borders")
    if borders.count() <= BROADCAST_BORDERS:
        # A frequent line's rows stay in the partitions that they were dealt to.
        borders = F.broadcast(borders)
    opened = found.where("kind = 'open'").join(borders, ["h1", "h2"]).where(document != F.col("largest"))
    drop = [F.when(~F.col("no_doc"), F.col("doc")).alias("doc"), "th", "place"]
    return found.where("kind = 'drop'").select(*drop).unionByName(opened.select(*drop))


def _bitmap(places: pa.ListArray) -> tuple[list[int], list[bytes]]:
    counts, maps = [], []
    for one in places:
        gone = np.unique(np.asarray(one.values))
        keep = np.ones((int(gone[-1]) // 8 + 1) * 8, bool)
        keep[gone] = False
        counts.append(len(gone))
        maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
    return counts, maps


def drop_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc, th, n_dropped, keep`` for the texts that lose lines.

    ``keep`` is a compressed bitmap, one bit per line from the first on; lines
    beyond its end stay. A group holds the places of one text, no more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps = _bitmap(batch.column("places"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "th", "n_dropped", "keep"])

    places = dropped_lines(docs, key, text, **options).groupBy("doc", "th").agg(F.collect_set("place").alias("places"))
    return places.mapInArrow(run, "doc bigint, th bigint, n_dropped bigint, keep binary")


def _with_maps(docs: DataFrame, maps: DataFrame, key: str, text: str, names: dict[str, str]) -> DataFrame:
    """Each row with the bitmap of its key and text; the map's columns come under the given names."""
    renamed = maps.withColumnsRenamed(names)
    same = docs[key].cast("bigint").eqNullSafe(renamed[names["doc"]]) & (text_hash(docs[text]) == renamed[names["th"]])
    return docs.join(renamed, same, "left").drop(names["doc"], names["th"])


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_lines, n_dropped, keep``.

    Null and empty texts have one empty line, which stays. ``keep`` is null
    where all lines stay. No text is shuffled.
    """
    small = docs.select(F.col(key), F.size(line_array(F.col(text))).cast("long").alias("n_lines"), text_hash(F.col(text)).alias("th"))
    maps = drop_bitmaps(docs, key, text, **options).withColumnsRenamed({"doc": "doc_", "th": "th_"})
    both = small.join(maps, small[key].cast("bigint").eqNullSafe(maps["doc_"]) & (small["th"] == maps["th_"]), "left")
    return both.select(small[key], "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def kept_mask(keep: bytes | None, n_lines: int) -> np.ndarray:
    """True for each line that stays."""
    mask = np.ones(n_lines, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n_lines].astype(bool)
        mask[: len(bits)] = bits
    return mask


def kept_text(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with each text cut down to the lines that stay, and ``n_lines, n_dropped``.

    Lines are split at line feeds only and joined by them again. A text all of
    whose lines go is empty. Input columns named like results are replaced,
    all others are kept, whatever their names; very long texts are handled one
    at a time; an empty table stays empty. Sets the session's limit of bytes for
    batches of text.
    """
    small_batches(docs.sparkSession)
    plain = docs.drop("n_lines", "n_dropped")
    names = {c: fresh(f"map_{c}", plain.columns) for c in ("doc", "th", "n_dropped", "keep")}
    joined = _with_maps(plain, drop_bitmaps(docs, key, text, **options), key, text, names)
    n_dropped, keep = names["n_dropped"], names["keep"]
    joined = joined.withColumn("n_lines", F.size(line_array(F.col(text))).cast("long"))
    at_text, at_keep = joined.columns.index(text), joined.columns.index(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text):
            maps, texts = batch.column(at_keep), batch.column(at_text)
            if maps.null_count < len(maps):
                # Only texts with a bitmap become Python strings.
                new = texts.to_pylist()
                for i in np.flatnonzero(maps.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    lines = new[i].split(NEWLINE)
                    new[i] = NEWLINE.join(line for line, stays in zip(lines, kept_mask(maps[i].as_py(), len(lines)).tolist()) if stays)
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at_text else batch.column(i) for i in range(batch.num_columns) if i != at_keep], names=[f.name for i, f in enumerate(batch.schema) if i != at_keep])

    done = joined.mapInArrow(run, joined.drop(keep).schema)
    return done.withColumn("n_dropped", F.coalesce(F.col(n_dropped), F.lit(0)).cast("long")).select(*plain.columns, "n_lines", "n_dropped")
