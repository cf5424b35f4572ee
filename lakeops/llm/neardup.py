"""Near duplicates with an LSH forest over MinHash signatures.

Every distinct shingle set has a signature of 128 MinHash values. The forest is 16 orders of the
sets: order t sorts them by the signature rotated to its value 8 t. Sets whose longest common
prefix in some order has at least four values are neighbours (a pair at similarity 0.8 has such
a prefix in one of the 16 with probability 0.9998). A region of an order, the sets under one
prefix, that is crowded is cut along the order into overlapping runs: its sets meet those with
which they share the longest prefixes, however long these are there.

Inside a region the signatures estimate the similarity of pairs. First the edges of a maximum
spanning forest are compared on the full shingle sets; then every other likely pair whose ends
are not connected yet. So a crowd of copies costs about one comparison each, and a pair is only
left out when it could not change the classes. What is still unconnected in a crowded region is
compared block against block on the full sets, each pair of blocks in a task of its own, so a
crowd misses no pair; this grows with the square of its unconnected blocks. Classes are connected
components, computed by alternating large-star and small-star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import U64, bitmap_of, gram_hashes, in_bitmap, mix, parts, slices, stage, text_of, word_hashes

ORDERS, VALUES = 16, 128
#: Values that the sets of a region share at least.
DEPTH = 4
#: A region of more sets is cut into runs of this many along its order; each run overlaps the next by half.
CROWD = 256
#: Pairs are compared when their estimated similarity is not more than this below the wanted one
#: (four standard deviations of the estimate).
MARGIN = 0.14
#: Weight of the sets in a block of a crowded region: their shingles, and SET_WEIGHT for each set.
BLOCK, SET_WEIGHT = 1 << 18, 192
LOG2_BITS = 24

_SKETCH = "doc_id long, n int, d1 long, d2 long, sig binary"
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1))[:, None]


def shingle_sets(texts: pa.Array, k: int):
    """Each row's distinct k-word shingles as sorted 64-bit hashes (a shorter text is one shingle; no words: none)."""
    words, counts = word_hashes(texts, lower=True)
    grams = gram_hashes(words, k)
    ends = np.cumsum(counts)
    for n, end in zip(counts, ends):
        if n >= k:
            yield np.unique(grams[end - n:end - k + 1])
        elif n:
            yield gram_hashes(words[end - n:end], int(n), seed=int(n))
        else:
            yield grams[:0]


def signature(s: np.ndarray) -> bytes:
    """128 MinHash values of a set, 16 bits of each."""
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = (s >> U64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, ((x[at:at + 2048] ^ _XOR) * _MUL).min(axis=1), out=low)
    return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2").tobytes()


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that, with its size, tell a set from others."""
    m = mix(s ^ U64(0x5851F42D4C957F2D))
    return int(s.sum(dtype=U64).view(np.int64)), int(m.sum(dtype=U64).view(np.int64))


def _sketch(batches, k: int):
    for b in batches:
        for at, n in slices(b["text"]):
            rows = []
            for i, s in zip(b["doc_id"].slice(at, n).to_pylist(), shingle_sets(b["text"].slice(at, n), k)):
                rows.append((i, len(s), *_digest(s), signature(s) if len(s) else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["doc_id", "n", "d1", "d2", "sig"])


def _turned(order, values: int):
    """The first ``values`` values of a signature rotated to its order."""
    return F.substring(F.concat("sig", "sig"), order * (2 * VALUES // ORDERS) + 1, F.lit(2 * values))


def _placed(batches):
    """Rows sorted by region with their task and the weight of the region's rows before them in it."""
    task, last, so_far = TaskContext.get().partitionId(), None, 0
    for b in batches:
        region, weight = np.asarray(b["region"]), np.asarray(b["weight"])
        if not len(region):
            continue
        first = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        before = np.cumsum(weight) - weight
        before -= np.repeat(before[first], np.diff(first, append=len(region)))
        if region[0] == last:
            before[:first[1] if len(first) > 1 else len(before)] += so_far
        last, so_far = region[-1], int(before[-1] + weight[-1])
        tasks = pa.array(np.full(len(region), task, np.int32))
        yield pa.RecordBatch.from_arrays([*b.columns, tasks, pa.array(before)], names=[*b.schema.names, "task", "before"])


def _numbered(rows: DataFrame, n_parts: int, key: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows(region, id, weight, ...)`` and before: the weight of the region's rows
    that precede a row in the order of ``key`` and id, whatever tasks they lie in."""
    ordered = rows.repartitionByRange(n_parts, "region", key, "id").sortWithinPartitions("region", key, "id").select(*keep, "weight")
    schema = StructType([*ordered.schema.fields, StructField("task", IntegerType()), StructField("before", LongType())])
    here = stage(ordered.mapInArrow(_placed, schema), "numbered")
    earlier = Window.partitionBy("region").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = here.groupBy("region", "task").agg(F.sum("weight").alias("total"))
    # Regions that begin in an earlier task: at most one for each task.
    base = sums.select("region", "task", F.sum("total").over(earlier).alias("base")).filter("base is not null")
    return here.join(F.broadcast(base), ["region", "task"], "left").select(
        *keep, (F.col("before") + F.coalesce("base", F.lit(0))).alias("before"))


def _regions(sets: DataFrame) -> DataFrame:
    """(region, id, order, crowd): the sets under each prefix that several share; crowd where they are more than CROWD."""
    placed = sets.select("id", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("order"), "sig").select(
        "id", "order", F.xxhash64("order", _turned(F.col("order"), DEPTH)).alias("region"))
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return stage(placed.join(sizes, "region").select("region", "id", "order", (F.col("size") > CROWD).alias("crowd")), "regions")


def _forest(found: DataFrame, sets: DataFrame, n_parts: int) -> DataFrame:
    """(region, id): regions of 2 to CROWD sets; crowded ones as overlapping runs of CROWD sets along their order."""
    crowd = found.filter("crowd").join(sets.select("id", "sig"), "id").select(
        "region", "id", _turned(F.col("order"), 16).alias("key"), F.lit(1).cast("long").alias("weight"))
    half = F.floor(F.col("before") / (CROWD // 2))
    runs = _numbered(crowd, n_parts, "key", ["region", "id"]).select(
        F.explode(F.array(F.xxhash64("region", half), F.xxhash64("region", half + 1))).alias("region"), "id")
    return stage(found.filter("not crowd").select("region", "id").unionByName(runs), "forest")


def _likely(sig: np.ndarray, n: np.ndarray, percent: int):
    """Pairs (i, j) of a region's rows that may reach the similarity, with their estimates."""
    i, j = np.triu_indices(len(n), 1)
    fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    i, j = i[fits], j[fits]
    near = np.empty(len(i), np.float32)
    for at in range(0, len(i), 4096):
        near[at:at + 4096] = (sig[i[at:at + 4096]] == sig[j[at:at + 4096]]).mean(axis=1)
    fits = near >= percent / 100 - MARGIN
    return i[fits], j[fits], near[fits]


def _first_meeting(places: list[np.ndarray], i: np.ndarray, j: np.ndarray, region: int) -> np.ndarray:
    """Which pairs have no common region before this one (by number)."""
    width = max(map(len, places))
    none = np.iinfo(np.int64).max
    every = np.full((len(places), width), none, np.int64)
    for row, p in zip(every, places):
        row[:len(p)] = p
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1024):
        a, b = every[i[at:at + 1024]], every[j[at:at + 1024]]
        common = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[at:at + 1024] = np.where(common, a, none).min(axis=1) == region
    return out


def _spanning(left, right):
    """Places of the pairs (left, right) that connect what the pairs before them do not."""
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(at)
    return np.array(out, np.int64)


def _pairs_of(ids, comps, n, sig, percent: int, places, region: int):
    i, j, near = _likely(sig, n, percent)
    if places is not None:  # every likely pair whose ends are not connected, in the first region where they meet
        keep = comps[i] != comps[j]
        i, j = i[keep], j[keep]
        if len(i):
            keep = _first_meeting(places, i, j, region)
            i, j = i[keep], j[keep]
        return ids[i], ids[j]
    best = np.argsort(-near, kind="stable")
    best = best[_spanning(i[best], j[best])]
    return ids[i[best]], ids[j[best]]


def _common(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``first`` with the sets ``second`` (masks)."""
    sizes = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    here, there = np.zeros(len(values), bool), np.zeros(len(values), bool)
    here[code[first[owner]]] = True
    there[code[second[owner]]] = True
    both = here & there & (np.bincount(code, minlength=len(values)) > 1)
    place = np.cumsum(both) - 1
    keep = both[code]
    owner, code = owner[keep], place[code[keep]]
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], code[by]
    out = np.zeros((int(first.sum()), int(second.sum())), np.float32)
    row, col = np.cumsum(first) - 1, np.cumsum(second) - 1
    for lo in range(0, int(both.sum()), 2048):
        x, y = np.searchsorted(code, [lo, lo + 2048])
        o, c = owner[x:y], code[x:y] - lo
        a, b = np.zeros((out.shape[0], 2048), np.float32), np.zeros((out.shape[1], 2048), np.float32)
        a[row[o[first[o]]], c[first[o]]] = 1
        b[col[o[second[o]]], c[second[o]]] = 1
        out += a @ b.T
    return out


def _block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links of a block with another (or itself) between sets of several classes: those that connect more."""
    ids, comps, block = np.asarray(t["id"]), np.asarray(t["comp"]), np.asarray(t["block"])
    sets = [np.frombuffer(x.as_buffer(), U64) for x in t["shingles"]]
    first, second = block == t["i"][0].as_py(), block == t["j"][0].as_py()
    n = np.array([len(s) for s in sets], np.float64)
    both = _common(sets, first, second)
    hit = 100.0 * both >= percent * (n[first][:, None] + n[second] - both)
    hit &= comps[first][:, None] != comps[second]
    i, j = np.nonzero(hit)
    keep = _spanning(comps[first][i], comps[second][j])
    a, b = ids[first][i[keep]], ids[second][j[keep]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _candidates(batches, percent: int):
    """Rows come sorted by region; a region that ends in the next batch is carried over.

    With a column of each set's regions all likely pairs of unconnected sets come out, each once;
    without it the edges of a maximum spanning forest of every region."""
    carry = None

    def of(t: pa.Table, last: bool):
        region = np.asarray(t["region"])
        cuts = np.flatnonzero(region[1:] != region[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        stops = np.concatenate((cuts, [len(region)]))
        keep = len(starts) if last else len(starts) - 1
        ids, comps, n = np.asarray(t["id"]), np.asarray(t["comp"]), np.asarray(t["n"]).astype(np.int64)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, VALUES)
        places = None
        if "places" in t.column_names:
            p = t["places"].combine_chunks()
            flat, offsets = np.asarray(p.values), np.asarray(p.offsets)
            places = [flat[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
        out = [_pairs_of(ids[s:e], comps[s:e], n[s:e], sig[s:e], percent, places and places[s:e], region[s])
               for s, e in zip(starts[:keep], stops[:keep]) if e - s > 1]
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        pairs = pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        return pairs, None if last else t.slice(int(starts[-1]))

    for b in batches:
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        if t.num_rows:
            pairs, carry = of(t, last=False)
            yield pairs
    if carry is not None and carry.num_rows:
        yield of(carry, last=True)[0]


def _compare(batches, percent: int):
    for b in batches:
        hit = []
        for x, y in zip(b["set_a"], b["set_b"]):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            hit.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(hit, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])


def _crowd_links(found: DataFrame, comps: DataFrame, wanted: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """(a, b): links between the classes ``comps`` inside the crowded regions, every pair of sets compared."""
    own = found.filter("crowd").join(comps, "id", "left").select("region", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = own.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("region")
    size = wanted.select("id", (F.octet_length("shingles") / 8 + SET_WEIGHT).cast("long").alias("weight"))
    own = own.join(mixed, "region", "left_semi").join(size, "id")
    # Along the classes, so that the blocks inside a large class are compared with nothing of it.
    own = stage(_numbered(own, n_parts, "comp", ["region", "id", "comp"]).select(
        "region", "id", "comp", F.floor(F.col("before") / BLOCK).alias("block")), "blocks")
    blocks = own.groupBy("region", "block").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = x.join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.block") <= F.col("y.block"))).filter(
        F.least("x.x", "y.x") < F.greatest("x.y", "y.y")).select(
        F.col("x.region").alias("region"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    uses = meet.select("region", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    dealt = own.join(uses, ["region", "block"]).join(wanted, "id").repartition(n_parts, "region", "i", "j")
    return dealt.groupBy("region", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id in ``links(a, b)``; ids without links are left out."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    last = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        last = state
        # Large star: hang every larger neighbour of a vertex on the smallest vertex around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: hang a vertex and its smaller neighbours on the smallest of them.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = (edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = stage(edges, "cc")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least ``percent`` / 100 of k-word shingles.

    Returns one row per input row: doc_id, n_shingles (size of its set), component_id (the
    smallest id reachable over links), kept (doc_id = component_id). Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than k words is one shingle.

    Null or blank texts have an empty set and are linked with nothing. Every row is a document of
    its own, also rows of one id (which may stand in different classes) and rows without an id:
    these are linked like all others, but give a class no name, so a class of such rows alone has a
    null component_id; kept compares the two null-safely. Of rows that share a class's id all are
    kept; number the rows first where one has to stay. Equal sets are one class without any
    comparison, so repeated rows and ties cost nothing. An empty table gives an empty result; other
    columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    sketch = stage(rows.mapInArrow(lambda it: _sketch(it, k), _SKETCH), "sketch")
    # A set, whatever rows have it, gets a number; from here on numbers of sets are compared. Stored, so
    # that the numbers are fixed, and that the last join can split the rows of a huge class.
    digest = ["n", "d1", "d2"]
    classes = sketch.filter("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("id"), *digest, "least", "sig"), "sets")
    sets = classes.select("id", "n", "sig")

    found = _regions(sets)
    region = _forest(found, sets, parts(docs))

    def pairs(comps: DataFrame | None) -> DataFrame:
        cols = ["region", "id", "comp", "n", "sig"]
        if comps is None:
            rows = region.join(sets.withColumn("comp", F.col("id")), "id")
        else:
            # Regions with ends of several classes only; a set stands in at most ORDERS of them.
            # Crowded regions are left to `_crowd_links`.
            own = found.filter("not crowd").join(comps, "id", "left").select("region", "id", F.coalesce("comp", "id").alias("comp"))
            mixed = own.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("region")
            own = stage(own.join(mixed, "region", "left_semi"), "mixed")
            places = own.groupBy("id").agg(F.collect_set("region").alias("places"))
            rows = own.join(sets.join(places, "id"), "id")
            cols.append("places")
        ordered = rows.select(*cols).repartition(parts(docs), "region").sortWithinPartitions("region", "id")
        return ordered.mapInArrow(lambda it: _candidates(it, percent), "a long, b long").distinct()

    tried = stage(pairs(None), "pairs")
    ends = (tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id")))
            .unionByName(found.filter("crowd").select("id")).distinct())
    ends = stage(classes.join(ends, "id", "left_semi").select("id", *digest), "ends")
    bits = spark.sparkContext.broadcast(bitmap_of(ends, "d1", LOG2_BITS))

    def full_sets(batches):
        for b in batches:
            for at, n in slices(b["text"]):
                found = [(len(s), *_digest(s), s) for s in shingle_sets(b["text"].slice(at, n), k)]
                some = in_bitmap(bits.value, np.array([x[1] for x in found], np.int64))
                found = [(n, d1, d2, s.tobytes()) for (n, d1, d2, s), has in zip(found, some) if has and n]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                cols = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*digest, "shingles"])

    # The sets that have a likely partner or stand in a crowd, each once. A task hands on a set once, the
    # bitmap of fixed size only spares the others the way.
    wanted = (rows.select("text").mapInArrow(full_sets, "n int, d1 long, d2 long, shingles binary")
              .join(ends, digest).groupBy("id").agg(F.first("shingles").alias("shingles")))
    wanted = stage(wanted, "shingles")

    def verified(some: DataFrame) -> DataFrame:
        both = (some.join(wanted.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
                .join(wanted.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"))
        return both.mapInArrow(lambda it: _compare(it, percent), "a long, b long")

    comps = stage(components(stage(verified(tried), "links")), "comps")
    rest = pairs(comps).join(tried, ["a", "b"], "left_anti")
    more = stage(verified(rest).unionByName(_crowd_links(found, comps, wanted, percent, parts(docs))), "links")
    if not more.isEmpty():
        # The first classes are stars already: only their heads have to meet.
        comps = stage(components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more)), "comps")

    # A class is called by the smallest id among its rows.
    own = classes.select("id", *digest, "least").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    names = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = stage(own.join(names, "comp").select(*digest, "component_id"), "named")
    empty = sketch.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = sketch.filter("n > 0").select("doc_id", *digest).join(named, digest).select("doc_id", "n", "component_id").unionByName(empty)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
