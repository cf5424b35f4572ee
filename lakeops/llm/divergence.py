"""Divergence of a corpus's sources, from term counts made in an Arrow compute pipeline.

Tasks lower-case, split and dictionary-encode the texts and count with Arrow's hash group_by
inside ``mapInArrow``; only partial counts (lang, source, term) leave a task. The merged counts
are dealt into columnar shards of terms; a shard becomes one matrix (term x source) and gives the
shard's part of every divergence, and the parts are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, rebatch, split_words, stage, text_of

#: Everything that is not part of a term, as an Arrow (RE2) pattern: ASCII but for letters.
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are whole numbers of this unit.
UNIT_DIGITS = 9
#: Partial counts that a task holds before it hands them on.
HELD_ROWS = 200_000
#: Counts (term, source) that one shard is to hold, and sources of one tile.
SHARD_ROWS, TILE_SOURCES = 200_000, 200

PARTIAL = "lang string, source string, term string, n long, d long"
DIVERGENCES = "lang string, source string, part string, item string, value long"


def _merge(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("d", "sum")])
    return t.rename_columns([c[:-4] if c.endswith("_sum") else c for c in t.column_names]).select([*keys, "n", "d"])


def _counts(t: pa.Table) -> pa.Table:
    """(lang, source, term, n, d) of a block of rows: occurrences, and rows that hold the term."""
    rows = pa.table({"lang": t["lang"], "source": t["source"]})
    words, row = split_words(flat(t["text"]), NOT_TERM)
    coded = words.dictionary_encode()
    each = pa.table({"row": row, "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    # One line per (row, term): n its occurrences there, d one row.
    by_row = rows.take(each["row"])
    by_row = by_row.append_column("code", each["code"]).append_column("n", each["count_all"])
    counts = _merge([by_row.append_column("d", pa.array(np.ones(len(by_row), np.int64)))], ["lang", "source", "code"])
    return counts.append_column("term", coded.dictionary.take(flat(counts["code"]))).select(["lang", "source", "term", "n", "d"])


def count_terms(batches):
    """Partial counts of a task's rows: merged while few, handed on when there are many."""
    held: list[pa.Table] = []
    for t in rebatch(batches, "text"):
        held.append(_counts(t))
        if sum(map(len, held)) > HELD_ROWS:
            held = [_merge(held, ["lang", "source", "term"])]
            if len(held[0]) > HELD_ROWS // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held = []
    if held:
        yield from _merge(held, ["lang", "source", "term"]).to_batches(max_chunksize=50_000)


def unit_shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly: one decimal digit at a time."""
    rest, below = count + 2, total + 2 * kept
    rest, below = np.broadcast_arrays(rest, np.maximum(below, 1))
    out, rest = np.divmod(rest, below)
    for _ in range(UNIT_DIGITS):
        digit, rest = np.divmod(rest * 10, below)
        out = out * 10 + digit
    return out + 1


def parted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); with shares of 10^9 the square fits 64 bits."""
    d = p - q
    return d * d // (p + q)


def _matrix(rows: pa.Table, heads: pa.Table, terms: np.ndarray, n_terms: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sources of a tile, counts (term x source), shares (term x source)."""
    sources = flat(heads["source"])
    at = np.asarray(rows["source"].combine_chunks().dictionary_encode().indices) if len(rows) else np.zeros(0, np.int64)
    if len(rows):
        names = rows["source"].combine_chunks().dictionary_encode().dictionary
        at = np.asarray(pc.index_in(names, sources))[at]
    counts = np.zeros((n_terms, len(sources)), np.int64)
    counts[terms, at] = np.asarray(rows["n"])
    shares = unit_shares(counts, np.asarray(heads["n"])[None, :], np.asarray(heads["v"])[None, :])
    return sources.to_pylist(), counts, shares


def _shard(t: pa.Table, top: int) -> pa.Table:
    """Every divergence's part in one shard of terms and one pair of source tiles."""
    t = pa.table({c: flat(t[c]) for c in t.column_names})
    lang = t["lang"][0].as_py()
    is_head = pc.equal(t["term"], "")
    heads, rows = t.filter(is_head), t.filter(pc.invert(is_head))
    coded = flat(rows["term"]).dictionary_encode()
    n_terms, term_at = len(coded.dictionary), np.asarray(coded.indices)
    left = pc.equal(heads["tile"], heads["ta"])
    left_rows = pc.equal(rows["tile"], rows["ta"])
    one = heads["ta"][0].as_py() == heads["tb"][0].as_py()
    a_names, a_counts, a = _matrix(rows.filter(left_rows), heads.filter(left), term_at[np.asarray(left_rows)], n_terms)
    out: list[tuple] = []
    if one:
        b_names, b = a_names, a
    else:
        other = pc.invert(left_rows)
        b_names, _, b = _matrix(rows.filter(other), heads.filter(pc.invert(left)), term_at[np.asarray(other)], n_terms)
    for i, name in enumerate(a_names):
        first = i + 1 if one else 0
        sums = np.zeros(len(b_names) - first, np.int64)
        for at in range(0, n_terms, 2048):  # a few MB at a time
            sums += parted(a[at:at + 2048, i:i + 1], b[at:at + 2048, first:]).sum(axis=0)
        for item, value in zip(b_names[first:], sums.tolist()):
            out += [(lang, name, "pair", item, value), (lang, item, "pair", name, value)]
    if one and n_terms:
        lang_n = np.zeros(n_terms, np.int64)
        lang_n[term_at] = np.asarray(rows["lang_n"])
        q = unit_shares(lang_n, np.asarray(heads["lang_total"])[:1], np.asarray(heads["v"])[:1])
        words = coded.dictionary.to_pylist()
        for i, name in enumerate(a_names):
            p = a[:, i]
            over = np.flatnonzero((a_counts[:, i] > 0) & (p > q))
            value = parted(p[over], q[over])
            if len(over) > top:  # the top values and all their ties
                least = np.partition(value, len(value) - top)[len(value) - top]
                over, value = over[value >= least], value[value >= least]
            best = sorted(zip((-value).tolist(), (words[k].encode() for k in over.tolist())))[:top]
            out += [(lang, name, "term", w.decode(), -v) for v, w in best]
    cols = list(zip(*out)) or [[]] * 5
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, shard_rows: int = SHARD_ROWS,
                      tile_sources: int = TILE_SOURCES, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source") -> DataFrame:
    """How far each source's terms are from those of the language's other sources, and by which terms.

    Returns (lang, source, part, item, value, rank). Terms are runs of letters and non-ASCII
    characters, A-Z lower-cased; a language keeps the terms found in at least ``min_docs`` of its
    rows (V terms, N occurrences in a group). A share is 1 + floor(10^9 (count + 2) / (N + 2 V)); the
    distance of shares p, q is floor((p - q)^2 / (p + q)). ``pair`` has the sum of distances to every
    other source of the language; ``term`` the ``top`` terms of the source whose share is above the
    language's. Ranks run from 1, by value descending, then item in byte order. All of it is exact
    whole-number arithmetic, up to 9e17 occurrences.

    Null text, language and source are ''. Groups without any term take part with counts of 0; a
    language that keeps no term has distances of 0 and no ``term`` rows; a source alone in its
    language has no ``pair`` rows. Repeated rows count each by themselves. An empty table gives no
    rows; other columns are ignored, whatever their names. A text is counted whole inside one task.

    A shard is sized by its counts and a tile by its sources, so a matrix stays bounded however many
    terms and sources there are; with several tiles each count goes to every pair of tiles that
    needs it. The pairs of sources are the answer itself and leave a shard as sums.
    """
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
                       text_of(docs, text_col).alias("text"))
    partial = rows.mapInArrow(count_terms, PARTIAL)
    # One shuffle by (lang, term) serves the merge and the document counts; tasks hand on merged counts.
    merged = (partial.repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    of_term = Window.partitionBy("lang", "term")
    merged = (merged.withColumn("docs", F.sum("d").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
              .withColumn("first", F.col("source") == F.min("source").over(of_term))
              .filter(F.col("docs") >= min_docs))
    counts = stage(merged.select("lang", "term", "source", "n", "lang_n", "first"), "term-counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("entries"),
                                                  F.count_if("first").alias("v"))
    groups = stage(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0), "groups")
    langs = groups.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum("v").alias("v"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("sources"))
    langs = langs.select(
        "lang", "lang_total", "v", F.greatest(F.lit(1), F.ceil(F.col("entries") / shard_rows)).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("sources") / tile_sources)).cast("int").alias("tiles"))

    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    body = counts.join(langs, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), tile, "tiles",
        "source", "term", "n", "lang_n", F.lit(None).cast("long").alias("lang_total"), F.lit(None).cast("long").alias("v"))
    # Every shard gets a head row of each source: its total, and the language's.
    heads = groups.drop("v", "entries").join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), tile, "tiles",
        "source", F.lit("").alias("term"), "n", F.lit(None).cast("long").alias("lang_n"), "lang_total", "v")
    dealt = (body.unionByName(heads)
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("ta", F.least("tile", "_other")).withColumn("tb", F.greatest("tile", "_other"))
             .drop("tiles", "_other"))
    parts = dealt.groupBy("lang", "shard", "ta", "tb").applyInArrow(lambda t: _shard(t, top), DIVERGENCES)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
