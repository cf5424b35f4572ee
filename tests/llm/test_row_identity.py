"""Rows are told apart by nothing in them: repeated ids, equal rows, missing and extreme ids against brute force."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from lakeops.llm import decontaminate, exact, lines, neardup, packing, substring

BLANK = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string"


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(w, at):
    return w[:at] + ["changed"] + w[at + 1:]


A, B = words(1, 90), words(2, 90)
LONG = " ".join(words(3, 40))
ROWS = [
    (5, " ".join(A)), (5, " ".join(B)), (1, " ".join(changed(A, 45))), (2, " ".join(changed(B, 45))),
    (7, LONG), (7, LONG), (None, LONG + " tail"), (None, LONG + " tail"), (None, None), (None, "lone row without id"),
    (-2**63, "low end"), (2**63 - 1, "lowend"), (None, "low  end"), (2**63 - 1, "high end"), (0, "highend"), (0, ""), (9, None),
] + [(None, f"shared line\nown {i}") for i in range(6)] + [(4, "shared line\nsame")] * 6


@pytest.fixture(params=[1, 3, 200])
def docs(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(request.param, 24)))
    yield spark.createDataFrame(ROWS, SCHEMA).repartition(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_lines(docs):
    seen = Counter()
    for _, t in ROWS:
        seen.update({x.strip(BLANK).lower() for x in (t or "").split("\n")})
    want = []
    for i, t in ROWS:
        every = (t or "").split("\n")
        kept = [x for x in every if not (x.strip(BLANK) and seen[x.strip(BLANK).lower()] >= 6)]
        want.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    same(lines.drop_frequent_lines(docs, 6).collect(), want)
    assert sum(w[2] for w in want) == 18  # of 6 rows without id and of 6 equal rows


def test_line_runs_reopen(spark):
    runs = lines.LineRuns(spark, 3)
    first = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "key binary")
    runs.add(first)
    again = lines.LineRuns(spark, 3, path=runs._path)
    again.add(first)
    again.add(spark.createDataFrame([(b"c",)], "key binary"))
    assert sorted(bytes(r.key) for r in again.frequent().collect()) == [b"a"]
    again.add(spark.createDataFrame([(b"b",), (b"a",)], "key binary"))
    assert sorted(bytes(r.key) for r in again.frequent().collect()) == [b"a", b"b"]
    plan = again._meet(first.groupBy("key").count().select("key", "count").toDF("key", "n"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") <= 1  # the batch's own: runs are not shuffled
    runs.close(), again.close()


def test_exact(docs):
    key = ["".join(c for c in t or "" if c not in BLANK) for _, t in ROWS]
    want = []
    for (i, t), k in zip(ROWS, key):
        group = [r for r, x in zip(ROWS, key) if x == k]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want.append((i, keep, len(group), i == keep, hashlib.sha256(k.encode()).hexdigest()))
    same(exact.exact_groups(docs, bucket_bytes=300).collect(), want)


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near(docs):
    sets = [shingles(t, 4) for _, t in ROWS]
    comp = list(range(len(ROWS)))
    for x in range(len(ROWS)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                comp = [comp[y] if c == comp[x] else c for c in comp]
    want = []
    for x, (i, _) in enumerate(ROWS):
        ids = [ROWS[y][0] for y in range(len(ROWS)) if comp[y] == comp[x] and ROWS[y][0] is not None]
        name = min(ids) if ids else None
        want.append((i, len(sets[x]), name, i == name))
    same(neardup.near_duplicates(docs, 4).collect(), want)
    assert {w[2] for w in want if w[0] == 5} == {1, 2}


def test_substrings(docs):
    places = Counter()
    for _, t in ROWS:
        w = (t or "").split()
        places.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = []
    for i, t in ROWS:
        w = (t or "").split()
        gone = {p for s in range(len(w) - 34) if places[tuple(w[s:s + 35])] > 1 for p in range(s, s + 35)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    same(substring.remove_repeats(docs, 35).collect(), want)
    assert [w[2] for w in want[4:8]] == [40, 40, 41, 41]


def test_pipeline_stages_keep_one_row_of_each_class(spark, docs):
    left = corpus_pipeline.exact_dedup(spark, docs, "")
    best = {}
    for i, t in ROWS:
        k = "".join(c for c in t or "" if c not in BLANK)
        best[k] = max(best.get(k, -1), len(t or ""))
    same(((("".join(c for c in r.text or "" if c not in BLANK)), len(r.text or "")) for r in left.collect()), best.items())
    left = [r.text for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len([t for t in left if t in (" ".join(A), " ".join(changed(A, 45)))]) == 1
    assert len([t for t in left if t in (" ".join(B), " ".join(changed(B, 45)))]) == 1
    assert left.count("lone row without id") == 1 and left.count("shared line\nsame") == 1
    assert len([t for t in left if not t]) == 3  # without words nothing is a near copy


def test_decontamination_goes_by_row(spark, tmp_path):
    item = words(9, 20)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "x " + " ".join(item)), (None, "clean without id"), (3, " ".join(item)), (3, "clean of that id"), (3, " ".join(item))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted(r.text for r in left.collect()) == ["clean of that id", "clean without id"]


@pytest.mark.parametrize("n", range(6, 13))
def test_short_items_are_found_with_a_fifth_replaced(spark, n):
    from itertools import combinations
    item = words(n, n)
    may = n - -(-8 * n // 10)
    rows = []
    for k in range(may + 1):
        for gone in combinations(range(1, n - 1), k):  # an overlap begins and ends with equal words
            rows.append((len(rows), " ".join(["before", *("other" if p in gone else w for p, w in enumerate(item)), "after"])))
    docs = spark.createDataFrame(rows + [(-1, "before other after")], SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(docs, bench).collect()} == {r[0] for r in rows}


def test_added_tokens_have_their_ids(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|> b")], SCHEMA)
    from tokenizers import Tokenizer
    import public_tokenizers
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a<|endoftext|> b", add_special_tokens=False).ids
    assert 50256 in ids
    assert [bytes(r.ids) for r in packing.pack(docs).collect()] == [b"".join(x.to_bytes(4, "little") for x in [*ids, 1])]
