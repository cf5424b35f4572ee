"""Exact duplicates through an extendible-hash index kept as shared files.

1. *Heap*: every row's key text (the text without white space) is hashed to 64 bits. Inside a
   task, rows of equal key texts are folded into one entry, so a group with a third of all
   rows sends one key text per task, not one per row. Rows and entries are written once.
2. *Directory*: cells of the leading hash bits are weighed; the directory doubles bit by bit
   and every bucket above its capacity splits, until each fits or its cell has no bits left
   (then it is an overflow chain). It is a table in the shared folder, never held whole.
3. *Owners*: each owner task takes whole buckets (ranges of the hash), sorted by hash, chains
   entries whose hashes collide and compares their bytes. Its answers are the index pages.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stage, strip_spaces, text_of

#: Bytes of key text that one bucket holds before it splits.
BUCKET_BYTES = 8 << 20
#: Bytes of recent key texts that a task keeps to fold copies; older ones just start a new entry.
FOLD_BYTES = 16 << 20
#: The cells are this many bits finer than even buckets would need.
SPARE_BITS = 3

_HEAP = "row_id long, no_id boolean, n_cp long, h long, entry long, key_sha string, key binary"


def _fold(batches):
    """Fold equal key texts of one task; `entry` is the row whose key text is kept."""
    recent: OrderedDict[bytes, int] = OrderedDict()
    held = 0
    for b in batches:
        entries, keys = [], []
        for row, key in zip(b["row_id"].to_pylist(), b["key"].to_pylist()):
            at = recent.get(key)  # a dictionary hit compares the bytes
            if at is None:
                recent[key], at = row, row
                held += len(key)
                keys.append(key)
                while held > FOLD_BYTES and len(recent) > 1:
                    held -= len(recent.popitem(last=False)[0])
            else:
                recent.move_to_end(key)
                keys.append(None)
            entries.append(at)
        yield pa.RecordBatch.from_arrays(
            [b["row_id"], b["no_id"], b["n_cp"], b["h"], pa.array(entries, pa.int64()), b["key_sha"], pa.array(keys, pa.binary())],
            names=["row_id", "no_id", "n_cp", "h", "entry", "key_sha", "key"])


def _chain(batches):
    """Entries sorted by (bucket, hash): chain those of one hash and compare bytes."""
    last, chain = None, []
    for b in batches:
        entry, first = b["entry"].to_pylist(), []
        for h, e, key in zip(b["h"].to_pylist(), entry, b["key"].to_pylist()):
            if h != last:
                last, chain = h, []
            for text, head in chain:
                if text == key:
                    first.append(head)
                    break
            else:
                chain.append((key, e))
                first.append(e)
        yield pa.RecordBatch.from_arrays([b["bucket"], b["h"], b["entry"], b["key_sha"], pa.array(first, pa.int64())],
                                         names=["bucket", "h", "entry", "key_sha", "head"])


def directory(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """The directory over ``entries(h, size)``: one row per cell of leading hash bits with its bucket.

    Returns ``(cells, bits)`` with columns cell, depth (the bucket's local depth) and bucket
    (its first hash prefix, left-aligned to ``bits``). Level d is the directory after d
    doublings; a bucket goes on splitting while it weighs more than ``bucket_bytes``.
    """
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    bits = min(40, math.ceil(math.log2(max(1, total / bucket_bytes))) + SPARE_BITS)
    cell = F.shiftrightunsigned("h", 64 - bits).alias("cell")
    cells = stage(entries.groupBy(cell).agg(F.sum("size").alias("size")), "exact-cells")
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    prefix = F.expr(f"shiftrightunsigned(cell, {bits} - depth)")
    at = cells.select("cell", "size", levels).withColumn("prefix", prefix)
    load = at.groupBy("depth", "prefix").agg(F.sum("size").alias("load"))
    fits = (F.col("load") <= F.lit(bucket_bytes)) | (F.col("depth") == F.lit(bits))
    leaf = (at.join(load.filter(fits), ["depth", "prefix"])
            .groupBy("cell").agg(F.min("depth").cast("int").alias("depth")))
    return stage(leaf.withColumn("bucket", F.expr(
        f"shiftleft(shiftrightunsigned(cell, {bits} - depth), {bits} - depth)")), "exact-directory"), bits


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Classes of rows whose texts are equal after all of ``[\\x20\\x09-\\x0D]`` is deleted.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex
    of the key text). Of a class the row with the most code points stays, then the smallest id.

    Null text counts as empty, so all empty and blank rows form one class. A null id sorts after
    every other id and is kept as null; rows with the same id are told apart by nothing else, so
    an id given twice with equal texts is a class of two rows that both carry ``kept`` only when
    their id is the one that stays. An empty table gives an empty result. Columns other than the
    two named ones are ignored, whatever their names.
    """
    text = text_of(docs, text_col)
    key = strip_spaces(text)
    rows = docs.select(
        docs[id_col].cast("long").alias("row_id"), F.length(text).cast("long").alias("n_cp"),
        F.xxhash64(key).alias("h"), F.sha2(key, 256).alias("key_sha"), key.cast("binary").alias("key"))
    # A row without id must still be able to head its entry: it stands as id 0, and no_id tells them apart.
    rows = rows.withColumn("no_id", F.col("row_id").isNull()).withColumn("row_id", F.coalesce("row_id", F.lit(0).cast("long")))
    heap = stage(rows.mapInArrow(_fold, _HEAP), "exact-heap")

    entries = heap.filter("key is not null")
    cells, bits = directory(entries.select("h", F.octet_length("key").cast("long").alias("size")), bucket_bytes)
    placed = (entries.select("h", "entry", "key_sha", "key", F.shiftrightunsigned("h", 64 - bits).alias("cell"))
              .join(cells, "cell"))
    owned = (placed.select("bucket", "h", "entry", "key_sha", "key").repartition(parts(docs), "bucket")
             .sortWithinPartitions("bucket", "h", "entry"))
    pages = stage(owned.mapInArrow(_chain, "bucket long, h long, entry long, key_sha string, head long"), "exact-pages")

    # A head names its class only together with the hash: ids may repeat in the input.
    # The best row: most code points, then any id before none, then the smallest id (~id grows as it falls).
    best = F.struct("n_cp", (~F.col("no_id")).alias("has_id"), F.bitwise_not("row_id").alias("down"))
    local = heap.groupBy("h", "entry", "key_sha").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("best"))
    heads = pages.select("h", "entry", "key_sha", "head").distinct()
    named = heads.join(local, ["h", "entry", "key_sha"])
    classes = (named.groupBy("h", "head", "key_sha")
               .agg(F.sum("n").alias("group_size"), F.max("best").alias("best")))
    answers = (named.select("h", "entry", "key_sha", "head").join(classes, ["h", "head", "key_sha"])
               .select("h", "entry", "key_sha", F.when(F.col("best.has_id"), F.bitwise_not("best.down")).alias("keep_id"), "group_size"))
    back = heap.select("row_id", "no_id", "h", "entry", "key_sha").join(answers, ["h", "entry", "key_sha"])
    doc_id = F.when(~F.col("no_id"), F.col("row_id"))
    return back.select(doc_id.alias("doc_id"), "keep_id", F.col("group_size").cast("long"),
                       doc_id.eqNullSafe(F.col("keep_id")).alias("kept"), F.col("key_sha").alias("text_sha256"))
