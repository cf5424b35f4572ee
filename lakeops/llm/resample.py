"""Importance resampling towards a target distribution, over a table of distinct lines.

Hashed word n-grams of the corpus and of a target text give every bucket a gain; a text's weight
is the sum of its features' gains, and Gumbel noise turns the highest scores into a draw. Line
feeds separate words, so a text's features are those of its lines and the n-grams that run
across lines. Distinct lines are counted first: the features of a line are computed once and
taken times its occurrences, both for the corpus totals and for the weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.paging import number_rows

from .common import flat, parts, rebatch, split_words, stage, text_of

#: Everything that is not part of a word, as an Arrow (RE2) pattern: ASCII but for letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Gains and noise are whole numbers of this part.
PART = 1000

LINE = "key binary, occ long, n_words long, n_features long, buckets array<int>, counts array<long>"


def _grams(words: pa.Array, row: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """Runs of 1 to ``n`` consecutive words of a row, joined by a blank, and the row of each."""
    runs, rows, last = [words], [row], words
    for k in range(1, n):
        if len(words) <= k:
            break
        last = pc.binary_join_element_wise(last[:-1], words[k:], " ")
        inside = row[:-k] == row[k:]
        runs.append(last.filter(pa.array(inside)))
        rows.append(row[:-k][inside])
    return pa.concat_arrays(runs), np.concatenate(rows)


def bucket_of(features: pa.Array, buckets: int) -> np.ndarray:
    """Unsigned crc32 of the UTF-8 bytes, modulo ``buckets``; computed once for equal features."""
    coded = features.dictionary_encode()
    of = np.fromiter((zlib.crc32(f.encode()) % buckets for f in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return of[np.asarray(coded.indices)]


def _line_features(batches, n: int, buckets: int):
    """Bucket counts of distinct lines."""
    for t in rebatch(batches, "line"):
        words, row = split_words(flat(t["line"]), NOT_WORD)
        features, of = _grams(words, row, n)
        pairs, counts = np.unique(of * buckets + bucket_of(features, buckets), return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(t) + 1) * buckets)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
                 for x in ((pairs % buckets).astype(np.int32), counts.astype(np.int64))]
        yield from pa.table({"key": t["key"], "occ": t["occ"], "n_words": np.bincount(row, minlength=len(t)),
                             "n_features": np.bincount(of, minlength=len(t)), "buckets": lists[0], "counts": lists[1]}).to_batches()


def _cross_line(batches, n: int, buckets: int):
    """For each text the buckets (with repeats) of the n-grams that run over a line feed."""
    for b in batches:
        out = []
        for text in b["text"].to_pylist():
            lines = pc.split_pattern(pa.array([text]), "\n").values
            words, line = split_words(lines, NOT_WORD)
            grams, ends = [], np.searchsorted(line, line, side="right")  # first word of a later line
            for k in range(1, n):
                if len(words) > k:
                    at = np.flatnonzero(ends[:-k] <= np.arange(len(words) - k) + k)
                    run = words.take(pa.array(at))
                    for j in range(1, k + 1):
                        run = pc.binary_join_element_wise(run, words.take(pa.array(at + j)), " ")
                    grams.append(run)
            out.append(bucket_of(pa.concat_arrays(grams), buckets).tolist() if grams else [])
        yield pa.RecordBatch.from_arrays([b["doc"], b["doc_id"], b["text"], pa.array(out, pa.list_(pa.int32()))],
                                         names=["doc", "doc_id", "text", "cross"])


def _texts(docs: DataFrame, id_col: str | None, text_col: str, n: int, buckets: int) -> DataFrame:
    """(doc, doc_id, text, cross): one row per input row, with a number of its own."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc"),
                       (docs[id_col].cast("long") if id_col else F.lit(None).cast("long")).alias("doc_id"),
                       text_of(docs, text_col).alias("text"))
    if n == 1:  # single words never run over a line feed
        return rows.withColumn("cross", F.array().cast("array<int>"))
    return rows.mapInArrow(lambda it: _cross_line(it, n, buckets), "doc long, doc_id long, text string, cross array<int>")


def _line_key(line) -> Column:
    return F.unhex(F.sha2(line, 256))


def _distinct_lines(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """Every distinct line with its occurrences and bucket counts."""
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("occ"))
    keyed = lines.select(_line_key("line").alias("key"), "occ", "line")
    return stage(keyed.mapInArrow(lambda it: _line_features(it, n, buckets), LINE), "line-features")


def _totals(lines: DataFrame, cross: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: ``buckets`` numbers, whatever the corpus holds."""
    inside = (lines.select("occ", F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
              .select(F.col("x.buckets").alias("bucket"), (F.col("occ") * F.col("x.counts")).alias("n")))
    over = cross.select(F.explode("cross").alias("bucket"), F.lit(1).cast("long").alias("n"))
    sums = inside.unionByName(over).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets)
    out[sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    size = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + size) / ((corpus + 1.0) * (target.sum() + size))
    return np.floor(PART * np.log(ratio)).astype(np.int64)


def _line_weights(batches, gain: np.ndarray):
    for b in batches:
        sizes = np.asarray(pc.list_value_length(b["buckets"])).astype(np.int64)
        values = gain[np.asarray(pc.list_flatten(b["buckets"]))] * np.asarray(pc.list_flatten(b["counts"]))
        run = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([b["key"], b["occ"], b["n_words"], b["n_features"], pa.array(run[ends] - run[ends - sizes])],
                                         names=["key", "occ", "n_words", "n_features", "weight"])


def _gumbel(seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) with h the first 8 hex digits of sha256(``seed:doc_id``)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-PART * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20,
                        percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draw the ``percent`` of the documents that are, by hashed n-grams, likest to ``target``'s texts.

    Returns one row per input row: doc_id, n_features, weight, score, rank. Words are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased; features are all runs of 1 to ``n``
    words, repeats counted, each in one of ``buckets`` by its crc32. ``weight`` sums the gains of the
    features, ``score`` adds Gumbel noise that ``seed`` and the id fix. Of the N documents of at least
    ``least_words`` words, floor(percent N / 100) are drawn, by score, ties to the smaller id; ``rank``
    counts them from 1 and is null for all others.

    A null or empty text has no features and weight 0. A null id is hashed as an empty one and
    comes last among ties. Repeated rows count, and are drawn, each by themselves (rows equal in
    score and id in any order). With no document or target text there is nothing to prefer: all
    gains are of empty counts. An empty table gives no rows; other columns are ignored, whatever
    their names. A text is split whole inside one task, and a line is one row.

    Lines are told apart by their text when counted, and by SHA-256 when weights are joined back to the
    documents. The lines that make up more than a part of 1 in 4 x partitions of all lines (so fewer than
    that many) are joined by broadcast, the others by shuffle: no line is a hot key.
    """
    texts = _texts(docs, id_col, text_col, n, buckets)
    lines = texts.select("doc", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"), "cross")
    # What the documents are made of, in one pass: the number of a row is fixed from here on.
    where = stage(lines.select("doc", "doc_id", _line_key("line").alias("key"),
                               F.when(F.col("pos") == 0, F.col("cross")).alias("cross")), "document-lines")
    table = _distinct_lines(texts, n, buckets)
    wanted = _texts(target, None, text_col, n, buckets)
    gain = gains(_totals(table, where, buckets), _totals(_distinct_lines(wanted, n, buckets), wanted, buckets))

    weighed = stage(table.mapInArrow(lambda it: _line_weights(it, gain), "key binary, occ long, n_words long, n_features long, weight long"),
                    "line-weights")
    total = weighed.agg(F.sum("occ").alias("n")).first()["n"] or 0
    hot = weighed.filter(F.col("occ") > max(1, total // (4 * parts(docs)))).drop("occ")
    cold = where.join(F.broadcast(hot.select("key")), "key", "left_anti").join(weighed.drop("occ"), "key")
    each = (where.join(F.broadcast(hot), "key").unionByName(cold)
            .groupBy("doc").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]))
    if n > 1:
        gain_of = docs.sparkSession.createDataFrame(list(enumerate(gain.tolist())), "bucket int, gain long")
        over = (where.select("doc", F.explode("cross").alias("bucket")).join(F.broadcast(gain_of), "bucket")
                .groupBy("doc").agg(F.count(F.lit(1)).alias("more"), F.sum("gain").alias("extra")))
        each = each.join(over, "doc", "left").select(
            "doc", "doc_id", "n_words", (F.col("n_features") + F.coalesce("more", F.lit(0))).alias("n_features"),
            (F.col("weight") + F.coalesce("extra", F.lit(0))).alias("weight"))
    scored = stage(each.select("doc_id", "n_features", "weight", (F.col("weight") + _gumbel(seed)).alias("score"),
                               (F.col("n_words") >= least_words).alias("may")), "scores")
    drawn = scored.filter("may").count() * percent // 100
    placed = number_rows(scored, [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    return placed.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("position") < drawn, F.col("position") + 1).cast("long").alias("rank"))
