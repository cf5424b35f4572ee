"""Helpers shared by the corpus operators: staged tables, bounded bitmaps, word hashing."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import checkpoint_dir

#: Rows of text handled at once inside a task; keeps a worker's arrays to some tens of MB.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def worker_state() -> dict:
    """A dictionary that lives as long as the worker process.

    Task functions travel by value, so a dictionary among their globals would be a new one for each task.
    """
    name = "lakeops_worker_state"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once all that reads it is stored itself."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def parts(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Most rows that Spark hands to a Python worker at once; texts are long, so fewer than its default.
BATCH_ROWS = 250


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column with null as empty.

    Every operator starts here, so this also lowers the session's Arrow batch size to BATCH_ROWS
    rows where it is larger: workers and their executor then hold a few MB of text, or some tens of MB
    of the largest shingle sets, at a time.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(row_key, doc_id, text, ...) of every row, stored: row_key is a number of the row's own.

    Ids may repeat or lack, and rows may be equal in everything, so nothing in a row tells it
    apart. The number is fixed because the rows are read from the stored copy from here on.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    return stage(rows.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text",
                             *[c.alias(name) for name, c in more.items()]), "rows")


def strip_spaces(text: Column) -> Column:
    """``text`` without any of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, " \t\n\x0b\f\r", "")


def hash_sample(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, about those with the smallest hashes of ``columns``.

    Rows whose hash is far too large are filtered where they lie, by the table's count, so the
    sort for the limit gets little more than ``limit`` rows however many tasks there are.
    """
    by = F.xxhash64(F.lit(11), *columns)
    share = (1.2 * limit + 200) / max(1, df.count())
    if share < 1:
        df = df.filter(by < F.lit(int(-2**63 + share * 2**64)))
    return df.orderBy(by, *columns).limit(limit)


# ---- bounded bitmaps --------------------------------------------------------------------

def bitmap_of(df: DataFrame, column: str, log2_bits: int = 24) -> np.ndarray:
    """Bits of a hash column as a uint64 array of ``2**log2_bits / 64`` words.

    A Bloom filter with one hash: the size is fixed by ``log2_bits`` whatever the table holds,
    so it may go to the driver and to every task; a fuller bitmap only lets more rows through.
    """
    bit = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    rows = (df.select(F.shiftright(bit, 6).alias("w"), F.expr("1L").alias("one"),
                      bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
            .select("w", F.expr("shiftleft(one, b)").alias("v"))
            .groupBy("w").agg(F.bit_or("v").alias("v")).toPandas())
    words = np.zeros((1 << log2_bits) >> 6, dtype=U64)
    words[rows["w"].to_numpy(dtype=np.int64)] = rows["v"].to_numpy(dtype=np.int64).view(U64)
    return words


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(U64) & U64(len(words) * 64 - 1)
    return ((words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1)).astype(bool)


# ---- words ------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).view(U64) | U64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, rows) runs of an Arrow string array of about ``limit`` bytes each (one row at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n, ends = len(texts), np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to - at
        at = to


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and each row's end among them (null: no bytes)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets[1:] - offsets[0]


def word_spans(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+`` and how many words each row has."""
    if len(flat) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    full = ~_SPACE[flat]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    inner = ends[:-1]
    inner = inner[inner < len(flat)]
    begins[inner] = full[inner]  # a word never runs over a row's end
    starts = np.flatnonzero(begins)
    stops = full.copy()
    stops[:-1] &= ~full[1:]
    last = ends[ends > 0] - 1
    stops[last] = full[last]
    return starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, ends), prepend=0)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the rows, and how many words each row has.

    ``lower`` folds A-Z to a-z. The hash is a polynomial in the bytes with random byte values,
    finished with the word's length.
    """
    flat, ends = raw_bytes(texts)
    starts, stops, counts = word_spans(flat, ends)
    if len(starts) == 0:
        return np.zeros(0, U64), counts
    sizes = stops - starts
    inside = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(inside)) - inside
    value = (_LOWER if lower else _BYTE)[flat[np.repeat(starts, sizes) + at]]
    power = np.ones(int(sizes.max()), U64)
    power[1:] = _BASE
    value *= np.multiply.accumulate(power)[at]
    total = np.add.reduceat(value, np.cumsum(sizes) - sizes)
    return mix(total + sizes.astype(U64)), counts


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (``len(words) - k + 1`` of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = np.random.default_rng(1000 + seed).integers(1, 2**63, k, dtype=np.int64).view(U64) | U64(1)
    total = words[:n] * factors[0]
    for j in range(1, k):
        total += words[j:n + j] * factors[j]
    return mix(total)


def within_rows(counts: np.ndarray, k: int) -> np.ndarray:
    """For all runs of ``k`` over the concatenated words: those that lie inside one row."""
    total = int(counts.sum())
    n = max(0, total - k + 1)
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    return np.arange(n) + k <= ends


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, concatenated."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


# ---- Arrow words ------------------------------------------------------------------------

def rebatch(batches, column: str, limit: int = SLICE_BYTES):
    """Arrow batches joined until ``column`` holds about ``limit`` bytes, larger ones cut at rows."""
    held, size = [], 0
    for b in batches:
        for at, n in slices(b[column], limit):
            part = b.slice(at, n)
            held.append(part)
            size += pc.sum(pc.binary_length(part[column])).as_py() or 0
            if size >= limit or sum(x.num_rows for x in held) >= 100_000:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One plain array of a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks at all
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def split_words(texts: pa.Array, separators: str) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows, A-Z lower-cased, cut at every match of ``separators``; the row of each word."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), separators)
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    return words.filter(real), np.asarray(row.filter(real))
