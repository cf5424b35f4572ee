"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, kept as an index of its word windows in blocks (hash ranges,
the partitions of staged tables). Every document is factored greedily against all blocks.

* The *anchor* of a window is the smallest hash among its short runs of words. Equal windows have
  equal anchors at the same place, so windows whose anchor occurs once in the corpus cannot repeat
  and never leave their task.
* Neighbouring windows with the same anchor place form a *block entry*: one row with a hash of all
  its words. An entry that occurs at two places repeats as a whole: a factor of it.
* At factor boundaries, where an entry occurs once but its anchor has other entries, the windows
  are looked up one by one among the windows of the anchor's distinct entries.
* The pieces found for a document are joined into greedy factors: a factor goes on while the next
  piece continues at the next place of its source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bitmap_of, discard, gram_hashes, in_bitmap, mix, numbered, parts, ranges, slices, stage, within_rows, word_hashes

#: Words of the runs among which a window's anchor is chosen.
RUN = 11
#: Limits of the anchor bitmap, which follows the number of repeated anchors: 128 KB to 32 MB.
MIN_LOG2, MAX_LOG2 = 20, 28
#: Size of the bitmap of documents with factors: 2 MB.
ROWS_LOG2 = 24


def _first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of every ``width`` neighbours, by doubling."""
    at, have = np.arange(len(x), dtype=np.int32), 1

    def better(a, b):
        return np.where(x[b] < x[a], b, a)

    while have * 2 <= width:
        at = better(at[:len(at) - have], at[have:])
        have *= 2
    rest = width - have
    return better(at[:len(at) - rest], at[rest:]) if rest else at


def anchors(words: np.ndarray, counts: np.ndarray, window: int):
    """(runs' hashes, starts of the windows inside one row, place of each window's anchor)."""
    runs = gram_hashes(words, RUN)
    span = window - RUN + 1
    if len(runs) < span:
        return runs, np.zeros(0, np.int64), np.zeros(0, np.int32)
    start = np.flatnonzero(within_rows(counts, window))
    return runs, start, _first_least(runs, span)[start]


def _anchor_rows(batches, window: int):
    for b in batches:
        for at, n in slices(b["text"]):
            runs, _, place = anchors(*word_hashes(b["text"].slice(at, n), lower=False), window)
            if len(place):
                own = place[np.concatenate(([True], place[1:] != place[:-1]))]  # places never go back
                key, times = np.unique(runs[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times)], names=["anchor", "n"])


_ENTRIES = "anchor long, entry long, row_key long, start int, n int, windows array<long>"


def _entry_rows(batches, window: int, bits: np.ndarray):
    """The block entries whose anchor repeats; of equal entries of a slice only the first carries its windows."""
    for b in batches:
        for at, n in slices(b["text"]):
            words, counts = word_hashes(b["text"].slice(at, n), lower=False)
            runs, p, place = anchors(words, counts, window)
            keep = in_bitmap(bits, runs[place])
            p, place = p[keep], place[keep]
            if not len(p):
                continue
            h = np.zeros(len(p), U64)
            for i, o in enumerate([*range(0, window - RUN, RUN), window - RUN]):  # runs that cover the window
                h = mix(h + runs[p + o] * U64(2 * i + 3))
            row = np.repeat(np.arange(n), counts)[p]
            fresh = np.ones(len(p), bool)
            fresh[1:] = (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1) | (row[1:] != row[:-1])
            first = np.flatnonzero(fresh)
            size = np.diff(first, append=len(p))
            weight = mix(ranges(size).astype(U64) + U64(99))
            entry = mix(np.add.reduceat(h * weight, first) + (place[first] - p[first]).astype(U64))
            _, lead = np.unique(entry, return_index=True)
            leads = np.zeros(len(first), bool)
            leads[lead] = True
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(leads, size, 0)))).astype(np.int32)),
                pa.array(h[np.repeat(leads, size)].view(np.int64)))
            r = row[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[place[first]].view(np.int64)), pa.array(entry.view(np.int64)), b["row_key"].slice(at, n).take(pa.array(r)),
                 pa.array(ranges(counts)[p[first]].astype(np.int32)), pa.array(size.astype(np.int32)), lists],
                names=["anchor", "entry", "row_key", "start", "n", "windows"])


_FACTORS = "row_key long, start int, n_words int, source long"


def _factor(batches, window: int):
    """Greedy factors from pieces (row_key, start, n, source), sorted by row and start."""
    tail = None  # the factor that may go on: row, start, windows, source
    for b in batches:
        row, start, n, source = (np.asarray(b[c]).astype(np.int64) for c in ("row_key", "start", "n", "source"))
        if tail:
            row, start, n, source = (np.concatenate(([t], x)) for t, x in zip(tail, (row, start, n, source)))
        if not len(row):
            continue
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (source[1:] != source[:-1] + n[:-1])
        first = np.flatnonzero(cut)
        total = np.add.reduceat(n, first)
        tail = (row[first[-1]], start[first[-1]], total[-1], source[first[-1]])
        yield _factor_batch(row[first[:-1]], start[first[:-1]], total[:-1], source[first[:-1]], window)
    if tail:
        yield _factor_batch(*(np.array([x]) for x in tail), window)


def _factor_batch(row, start, n, source, window):
    return pa.RecordBatch.from_arrays(
        [pa.array(row), pa.array(start.astype(np.int32)), pa.array((n + window - 1).astype(np.int32)), pa.array(source)],
        names=["row_key", "start", "n_words", "source"])


def _first_place(row_key: Column | str) -> Column:
    """The place of a row's first word: 62 bits, so that adding a word position cannot overflow."""
    return F.shiftright(F.xxhash64(row_key), 2)


def _row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The key that `factors` gives each row of ``docs``. It follows the row's number: ids and texts may repeat."""
    return _first_place(F.monotonically_increasing_id())


def factors(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The duplicate factors of all texts: row_key, start, n_words and source.

    row_key is the place of the row's first word (see `_row_key`); source, another place with
    the same words, is the row_key of its row plus a word position.
    """
    found = _row_factors(numbered(docs, id_col, text_col), window)
    return found.withColumn("row_key", _first_place("row_key"))


def _row_factors(rows: DataFrame, window: int, scratch: list[DataFrame] | None = None) -> DataFrame:
    """The duplicate factors of ``rows(row_key, text)``: row_key, start, n_words and source (another
    place with the same words).

    row_key is a number of the row's own, text is not null, and the rows are read several times (see
    `common.numbered`). A place is a hash of the row's number plus the word position. Every factor
    has at least ``window`` words. The stored tables that the result reads are added to ``scratch``.
    """
    if window <= RUN:
        raise ValueError(f"window must be over {RUN} words")
    spark = rows.sparkSession
    rows = rows.select("row_key", "text")
    repeated = stage(rows.select("text").mapInArrow(lambda it: _anchor_rows(it, window), "anchor long, n long")
                     .groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "anchors")
    size = min(MAX_LOG2, max(MIN_LOG2, (8 * repeated.count()).bit_length()))
    bits = spark.sparkContext.broadcast(bitmap_of(repeated, "anchor", size))
    index = stage(rows.mapInArrow(lambda it: _entry_rows(it, window, bits.value), _ENTRIES), "entries")

    # It only tells two places of one text apart.
    place = _first_place("row_key") + F.col("start")
    entries = stage(index.groupBy("anchor", "entry").agg(F.min(place).alias("first"), F.max(place).alias("other")), "places")
    whole = entries.filter("first <> other")
    pieces = (index.select("anchor", "entry", "row_key", "start", "n").join(whole, ["anchor", "entry"])
              .select("row_key", "start", "n", F.when(place == F.col("first"), F.col("other")).otherwise(F.col("first")).alias("source")))

    # Factor boundaries: windows of entries whose anchor has several entries, each entry once.
    if scratch is not None:
        scratch += [index, entries]
    several = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    open_entries = entries.join(several, "anchor", "left_semi")
    windows = (index.filter(F.size("windows") > 0).select("anchor", "entry", "row_key", "start", "windows")
               .join(open_entries, ["anchor", "entry"]).dropDuplicates(["anchor", "entry"])
               .select("row_key", "start", "first", "other", F.posexplode("windows").alias("i", "h"))
               .select("h", "row_key", (F.col("start") + F.col("i")).alias("start"),
                       (F.col("first") + F.col("i")).alias("place"), (F.col("first") == F.col("other")).alias("single")))
    windows = stage(windows, "boundary-windows")
    if scratch is not None:
        scratch.append(windows)
    held = windows.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b")
    straddling = (windows.filter("single").join(held, "h")
                  .select("row_key", "start", F.lit(1).alias("n"), F.when(F.col("place") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("source")))
    ordered = (pieces.unionByName(straddling).repartition(parts(rows), "row_key").sortWithinPartitions("row_key", "start"))
    return ordered.mapInArrow(lambda it: _factor(it, window), _FACTORS)


def _cut(batches):
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(b["text"], b["spans"].to_pylist()):
            words = text.as_buffer().to_pybytes().split()  # at [\x20\x09-\x0D]+, as bytes have no other space
            stay = np.ones(len(words), bool)
            for s in spans or ():
                stay[s["start"]:s["start"] + s["n_words"]] = False
            left = [words[i] for i in np.flatnonzero(stay)] if spans else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                          pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take out every word covered by a window of ``window`` words that also starts anywhere else.

    All copies go, the same document's included; windows are judged on the input. Returns one row
    per input row: doc_id, n_words, n_removed, kept (the other words joined by one blank).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null, empty and short texts lose nothing. Every row is a
    document of its own, also rows of one id, without id, or equal in everything. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = numbered(docs, id_col, text_col).select("doc_id", "text", "row_key")
    scratch: list[DataFrame] = []
    found = _row_factors(rows, window, scratch)
    spans = stage(found.groupBy("row_key").agg(F.collect_set(F.struct("start", "n_words")).alias("spans")), "spans")
    discard(*scratch)  # the factors are in the spans
    kind = rows.schema["doc_id"].dataType.simpleString()
    spot = F.xxhash64("row_key").alias("spot")  # numbers of rows are alike in their low bits
    bits = spark.sparkContext.broadcast(bitmap_of(spans.select(spot), "spot", ROWS_LOG2))

    def with_bit(wanted):
        def keep(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(bits.value, np.asarray(b["spot"])) == wanted))
        return rows.select("*", spot).mapInArrow(keep, f"doc_id {kind}, text string, row_key long, spot long")

    # Documents that surely have no factor stay in their tasks; the others meet their spans.
    meet = with_bit(True).join(spans, "row_key", "left").select("doc_id", "text", "spans")
    rest = with_bit(False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return meet.unionByName(rest).mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
