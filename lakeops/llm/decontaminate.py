"""Benchmark decontamination by spaced-seed hashing.

A mask picks six of up to ten consecutive words and ignores the others, so a substituted word
in an ignored place leaves the hash alone. Hashes of the benchmark items and of the documents
under the same masks are joined; each hit fixes an alignment of a document with an item, which
is then compared word by word, allowing substitutions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bitmap_of, in_bitmap, mix, numbered, ranges, slices, stage, text_of, within_rows, word_hashes

#: The fixed masks: word positions that count. Any two substitutions among 13 words leave at
#: least one of them a hit (tests/llm checks that).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 7, 8, 9), (0, 1, 2, 3, 4, 5), (0, 2, 3, 7, 8, 9))
#: One more mask for items under MIN_WORDS words: with a fifth of them replaced, three neighbours stay.
SHORT_MASK = (0, 1, 2)
#: Shortest overlap that counts, in words; a shorter item has to be there as a whole.
MIN_WORDS = 13
#: Share of equal words that an overlap needs.
SIMILARITY = 0.8
#: Items of fewer words are no evidence of a leak.
LEAST_WORDS = 6
#: Size of the bitmap of benchmark hashes that goes to every task: 2 MB, whatever the benchmark's size.
LOG2_BITS = 24

_SEEDS = "row_key long, id long, seed long, pos int, n_words int"


def _seed_hashes(words: np.ndarray, counts: np.ndarray):
    """For each mask: (mask, index of the first word, hash) of every place inside one row."""
    for m, mask in enumerate((*MASKS, SHORT_MASK)):
        span = mask[-1] + 1
        n = len(words) - span + 1
        if n <= 0:
            continue
        factors = np.random.default_rng(50 + m).integers(1, 2**63, len(mask), dtype=np.int64).view(U64) | U64(1)
        total = np.full(n, U64(m + 1))
        for at, f in zip(mask, factors):
            total += words[at:n + at] * f
        keep = np.flatnonzero(within_rows(counts, span))
        yield mask, keep, mix(total[keep])


def _seeds(batches, bits: np.ndarray | None):
    for b in batches:
        for at, n in slices(b["text"]):
            words, counts = word_hashes(b["text"].slice(at, n), lower=True)
            row, pos = np.repeat(np.arange(n), counts), ranges(counts)
            keys, ids = b["row_key"].slice(at, n), b["id"].slice(at, n)
            for mask, first, seed in _seed_hashes(words, counts):
                if bits is None:
                    if mask == SHORT_MASK:
                        short = counts[row[first]] < MIN_WORDS
                        first, seed = first[short], seed[short]
                else:
                    hit = in_bitmap(bits, seed)
                    first, seed = first[hit], seed[hit]
                r = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(r), ids.take(r), pa.array(seed.view(np.int64)), pa.array(pos[first].astype(np.int32)),
                     pa.array(counts[row[first]].astype(np.int32))], names=["row_key", "id", "seed", "pos", "n_words"])


def _words(batches):
    """Every row's word hashes as little-endian bytes."""
    for b in batches:
        for at, n in slices(b["text"]):
            words, counts = word_hashes(b["text"].slice(at, n), lower=True)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [b["id"].slice(at, n), pa.array([words[e - c:e].tobytes() for e, c in zip(ends, counts)], pa.binary())],
                names=["item_id", "item_words"])


def _cut(batches):
    """The document's words that lie beside the item, for every alignment of a candidate document."""
    for b in batches:
        for at, n in slices(b["text"]):
            words, counts = word_hashes(b["text"].slice(at, n), lower=True)
            ends, out = np.cumsum(counts), []
            for i, (key, row, hits) in enumerate(zip(*(b[c].slice(at, n).to_pylist() for c in ("row_key", "id", "hits")))):
                own = words[ends[i] - counts[i]:ends[i]]
                for h in hits:
                    lo, hi = max(0, h["diagonal"]), min(len(own), h["diagonal"] + h["n_words"])
                    out.append((key, row, h["item_id"], h["diagonal"], own[lo:hi].tobytes()))
                    if len(out) >= 4096:
                        yield _cut_batch(out)
                        out = []
            if out:
                yield _cut_batch(out)


def _cut_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["row_key", "doc_id", "item_id", "diagonal", "doc_words"])


def _longest(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest part of which a share of at least ``similarity`` is equal."""
    gain = np.concatenate(([0.0], np.cumsum(equal - similarity))) + 1e-9 * np.arange(len(equal) + 1)
    lows = np.flatnonzero(gain < np.concatenate(([np.inf], np.minimum.accumulate(gain)[:-1])))  # places worth starting at
    best, k = (0, 0), len(lows) - 1
    for end in range(len(equal), 0, -1):
        while k >= 0 and gain[lows[k]] <= gain[end]:
            if lows[k] < end and end - lows[k] > best[1] - best[0]:
                best = (int(lows[k]), end)
            k -= 1
        if k < 0:
            break
    return best


def best_overlap(equal: np.ndarray, min_words: int, similarity: float) -> tuple[int, int, int] | None:
    """(start, end, equal words) of the longest overlap of an alignment that is long and similar enough, or None.

    An overlap begins and ends with equal words.
    """
    todo = [(0, len(equal))]
    best = None
    while todo:
        lo, hi = todo.pop()
        a, z = _longest(equal[lo:hi], similarity)
        if z - a < min_words:
            continue
        same = np.flatnonzero(equal[lo + a:lo + z]) + lo + a
        first, last = int(same[0]), int(same[-1]) + 1
        if last - first >= min_words:
            if best is None or last - first > best[1] - best[0]:
                best = (first, last, len(same))
        else:  # long only with unequal ends: look beside it
            todo += [(lo, lo + a), (lo + z, hi)]
    return best


def _verify(batches, min_words: int, similarity: float):
    for b in batches:
        out = []
        cols = ("row_key", "doc_id", "item_id", "diagonal", "doc_words", "item_words")
        for key, doc, item, diagonal, own, its in zip(*(b[c].to_pylist() for c in cols)):
            own, its = np.frombuffer(own, U64), np.frombuffer(its, U64)
            skip = max(0, -diagonal)
            found = best_overlap(own == its[skip:skip + len(own)], min(min_words, len(its)), similarity)
            if found:
                a, z, same = found
                out.append((key, doc, item, max(0, diagonal) + a, z - a, same))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["row_key", "doc_id", "item_id", "start_word", "n_words", "n_equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Overlaps of documents with benchmark items: doc_id, item_id, start_word, n_words, n_equal.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. An overlap is a run of at least
    ``min_words`` words (the whole item, if that is shorter) of one alignment without gaps, of
    which a share of at least ``similarity`` is equal. One row per document, item and alignment.

    Null or empty texts and items under six words overlap with nothing. Null ids are reported as
    null. Every row is answered by itself, so repeated rows repeat the answer. Empty tables give no
    rows; other columns are ignored.
    """
    rows = numbered(docs, id_col, text_col)
    return row_overlaps(rows, benchmark, min_words, similarity, item_col, item_text_col).drop("row_key")


def row_overlaps(rows: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`overlaps` of ``rows(row_key, doc_id, text)`` (see `common.numbered`), with the row's number."""
    its = text_of(benchmark, item_text_col)
    rows = rows.select("row_key", F.col("doc_id").cast("long").alias("id"), "text")
    items = benchmark.select(F.lit(0).cast("long").alias("row_key"), benchmark[item_col].cast("long").alias("id"), its.alias("text"))

    marks = stage(items.mapInArrow(lambda it: _seeds(it, None), _SEEDS)
                  .filter(F.col("n_words") >= LEAST_WORDS)
                  .select("seed", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "n_words").distinct(), "seeds")
    bits = bitmap_of(marks, "seed", LOG2_BITS)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    found = rows.mapInArrow(lambda it: _seeds(it, shared.value), _SEEDS).select("row_key", "seed", "pos")
    hits = (found.join(marks, "seed")
            .select("row_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "n_words").distinct())
    hits = stage(hits.groupBy("row_key").agg(F.collect_list(F.struct("item_id", "diagonal", "n_words")).alias("hits")), "seed-hits")

    # Only candidate documents travel: their row keys, again as a bitmap of fixed size, cut the scan.
    spot = F.xxhash64("row_key").alias("spot")  # numbers of rows are alike in their low bits
    rows_hit = spark.sparkContext.broadcast(bitmap_of(hits.select(spot), "spot", LOG2_BITS))

    def candidates(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(rows_hit.value, np.asarray(b["spot"]))))

    near = rows.select("*", spot).mapInArrow(candidates, "row_key long, id long, text string, spot long").join(hits, "row_key")
    cut = near.select("row_key", "id", "text", "hits").mapInArrow(_cut, "row_key long, doc_id long, item_id long, diagonal int, doc_words binary")
    words = stage(items.select("id", "text").mapInArrow(_words, "item_id long, item_words binary"), "item-words")
    pairs = cut.join(words, cut["item_id"].eqNullSafe(words["item_id"])).drop(words["item_id"])
    return pairs.mapInArrow(lambda it: _verify(it, min_words, similarity),
                            "row_key long, doc_id long, item_id long, start_word long, n_words long, n_equal long")
