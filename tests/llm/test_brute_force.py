"""Operators against brute force on the same rows: odd rows, clashing columns, planted copies."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeops.llm import decontaminate, exact, lines, neardup, packing, pii, shards, substring

BLANK = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER = {v: k for k, v in LOWER.items()}
SCHEMA = "doc_id long, text string, lang string, row_key long, n long, shard int, h string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "Do", "ki", "lu", "mé", "ß", "to"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(25)]
    texts = [None, "", "  \n\t ", "one", "one two", "one  two ", "\n\n", "x y", "😀 " * 40, "a " * 300, "Same line\nother\n" * 3]
    for t in base:
        w = t.split()
        texts += [t, t, t.replace(" ", "  ", 5) + "\n"]
        near = w[:]
        near[len(near) // 2] = "changed"
        texts += [" ".join(near), " ".join(w[:40]) + " " + prose(rng, 60), prose(rng, 30) + " " + " ".join(w[10:55])]
    common = "  All Rights Reserved  "
    texts += [prose(rng, 12) + "\n" + common.strip().upper() + "\r\n" + prose(rng, 9) for _ in range(14)]
    texts.append(" ".join(prose(rng, 1) for _ in range(20_000)))  # a very long one
    rows = [(i, t, "en", i % 3, None, 7, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows, empty):
    key = {i: "".join(c for c in t or "" if c not in BLANK) for i, t, *_ in rows}
    text = {i: t or "" for i, t, *_ in rows}
    groups = defaultdict(list)
    for i, k in key.items():
        groups[k].append(i)
    want = {}
    for k, ids in groups.items():
        best = min(ids, key=lambda i: (-len(text[i]), i))
        for i in ids:
            want[i] = (best, len(ids), i == best, hashlib.sha256(k.encode()).hexdigest())
    for size in (exact.BUCKET_BYTES, 2000):  # many buckets: the directory doubles and splits
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, bucket_bytes=size).collect()}
        assert got == want
    assert exact.exact_groups(empty).count() == 0


def test_exact_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b"), (None, "ab"), (3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact.exact_groups(d).collect())
    assert got == [(-1, -1, 1, True), (-1, 3, 4, False), (-1, 3, 4, False), (3, 3, 4, True), (3, 3, 4, True)]


def test_directory_splits_until_buckets_fit(spark):
    e = spark.range(2000).select(F.xxhash64("id").alias("h"), F.lit(10).cast("long").alias("size"))
    cells, bits = exact.directory(e, 500)
    placed = e.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(cells, "cell")
    assert placed.count() == 2000
    loads = placed.groupBy("bucket").agg(F.sum("size").alias("s"), F.max("depth").alias("d")).collect()
    assert len(loads) > 20 and all(r.s <= 500 or r.d == bits for r in loads)


def test_lines(docs, rows, empty, spark):
    def key(line):
        return line.translate(LOWER).strip(BLANK)

    seen = Counter()
    for _, t, *_ in rows:
        seen.update({key(x) for x in (t or "").split("\n")})
    for batches, least in ((1, 10), (4, 3)):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.drop_frequent_lines(docs, least, batches=batches).collect()}
        for i, t, *_ in rows:
            every = (t or "").split("\n")
            kept = [x for x in every if not (key(x) and seen[key(x)] >= least)]
            assert got[i] == (len(every), len(every) - len(kept), "\n".join(kept)), i
    assert any(v[1] for v in got.values())
    assert lines.drop_frequent_lines(empty).count() == 0


def test_line_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, min_docs=5)
    for i in range(5):
        runs.add(spark.createDataFrame([(b"a",), (f"only{i}".encode(),)], "key binary"))
    assert sorted(runs._runs) == [0, 2]  # 5 = one run of four batches and one of one
    assert [bytes(r.key) for r in runs.frequent().collect()] == [b"a"]


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for length in (2048, 64):
        got = packing.pack(docs, length=length).collect()
        docs_of, seqs = defaultdict(list), defaultdict(list)
        for r in got:
            docs_of[r.doc_id].append(r)
            seqs[r.sequence_id].append(r)
        for i, t, *_ in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            parts = sorted(docs_of[i], key=lambda r: r.start)
            joined = b"".join(bytes(r.ids) for r in parts)
            assert joined == b"".join(x.to_bytes(4, "little") for x in ids), i
            assert all(r.doc_tokens == len(ids) and len(r.ids) == 4 * r.length for r in parts)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
            assert sum(r.length for r in s) <= length
        total = sum(r.length for r in got)
        assert len(seqs) <= -(-total // length) + 4 + 0.02 * len(seqs)  # at most one short one a task and a little slack
    assert packing.pack(empty).count() == 0


def test_fill_reaches_the_best_total():
    rng = random.Random(2)
    for _ in range(300):
        room = rng.randint(5, 40)
        counts = Counter(rng.randint(1, room) for _ in range(rng.randint(1, 8)))
        lead = max(counts)
        rest = list((counts - Counter([lead])).elements())
        best = max(lead + sum(x for k, x in enumerate(rest) if m >> k & 1) for m in range(1 << len(rest))
                   if lead + sum(x for k, x in enumerate(rest) if m >> k & 1) <= room)
        chosen = Counter()
        for n, c in packing.fill(dict(counts), room):
            chosen[n] += c
        assert sum(n * c for n, c in chosen.items()) == best and all(c <= counts[n] for n, c in chosen.items())


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc, rng = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "Be", " ", " ", "\n", "\t", "'s", "'", ".", "1", "é", "😀", " ", " ", "\x1c", "\x85"]) for _ in range(rng.randint(0, 14)))
        want = b"".join(x.to_bytes(4, "little") for x in tok.encode(t, add_special_tokens=False).ids)
        assert enc(t) == want, repr(t)


def test_shards(docs, rows, empty):
    out = shards.write_shards(docs, n_shards=7, bucket_bytes=3000).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == sorted((i, t or "") for i, t, *_ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert "in_shard" in out[0].asDict()  # the clashing column is kept under another name
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    ups = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.3 < ups / len(order) < 0.7
    assert shards.write_shards(empty).count() == 0


def shingles(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, empty, k):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, k).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    if k == 5:
        assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """More near copies than a region may hold: regions deepen and every copy is still reached."""
    rng = random.Random(6)
    w = prose(rng, 150).split()
    texts = [" ".join(w)]
    for _ in range(60):
        v = w[:]
        v[rng.randrange(150)] = "odd" + str(rng.random())
        texts.append(" ".join(v))
    monkeypatch.setattr(neardup, "CROWD", 8)
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (100, "apart")], "doc_id long, text string")
    got = neardup.near_duplicates(d, 4).collect()
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 100} == {0}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(0, False)]


def test_runs_of_a_crowd_do_not_depend_on_tasks(spark, monkeypatch):
    """A crowded region is cut along its order over task borders: the same runs with any number of tasks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)
    sets = []
    for i in range(90):
        own = np.concatenate((base[rng.permutation(200)[:180]], rng.integers(0, 2**63, 20, dtype=np.int64).astype(np.uint64)))
        sets.append((i, bytearray(neardup.signature(own))))
    sets = spark.createDataFrame(sets, "id long, sig binary")
    monkeypatch.setattr(neardup, "CROWD", 8)
    found = neardup._regions(sets)
    assert found.filter("crowd").count() > 90
    got = [sorted(map(tuple, neardup._forest(found, sets, n).collect())) for n in (1, 8, 200)]
    assert got[0] == got[1] == got[2]
    sizes = Counter(r for r, _ in got[0])
    crowds = Counter(r.region for r in found.filter("crowd").collect())
    runs = {r: n for r, n in sizes.items() if r not in {x.region for x in found.filter("not crowd").collect()}}
    assert max(runs.values()) == 8 and sum(runs.values()) == 2 * sum(crowds.values())


@pytest.mark.parametrize("block", [1 << 18, 3000])
def test_copies_that_only_a_hub_links(spark, monkeypatch, block):
    """Copies of one text that are unlike each other: every one is linked to it, and two families stay apart."""
    rng, texts, family = random.Random(8), [], []
    for _ in range(2):
        w = [str(rng.random()) for _ in range(200)]
        hub = len(texts)
        texts.append(" ".join(w))
        family.append(hub)
        for _ in range(150):
            v = w[:]
            for at in rng.sample(range(10, 190, 6), 4):
                v[at] = "odd" + str(rng.random())
            texts.append(" ".join(v))
            family.append(hub)
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets[1:151]) for b in sets[1:1 + i]]
    assert min(len(sets[0] & a) / len(sets[0] | a) for a in sets[:151]) >= 0.8
    assert sum(x < 0.8 for x in alike) > 0.99 * len(alike)
    monkeypatch.setattr(neardup, "CROWD", 8)
    monkeypatch.setattr(neardup, "BLOCK", block)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(neardup.near_duplicates(d, 5).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == family


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(tuple(r) for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("window", [35, 12])
def test_substring(docs, rows, empty, window):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    times = Counter(tuple(w[i:i + window]) for w in words.values() for i in range(len(w) - window + 1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, window).collect()}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        assert got[d] == (len(w), len(w) - len(left), " ".join(left)), d
    assert sum(v[1] for v in got.values()) > 1000
    if window == 35:
        assert substring.remove_repeats(empty).count() == 0


def test_factors_name_a_source(docs, rows):
    words = {}
    for r in docs.select(substring._row_key(docs, "doc_id", "text").alias("k"), "text").collect():
        words[r.k] = WORD.findall(r.text or "")
    for f in substring.factors(docs, 35).collect():
        own = words[f.row_key][f.start:f.start + f.n_words]
        key = max((k for k in words if k <= f.source), default=None)
        at = f.source - key
        assert len(own) == f.n_words >= 35 and words[key][at:at + f.n_words] == own
        assert (key, at) != (f.row_key, f.start)


def test_masks_survive_two_substitutions():
    import itertools
    for gone in itertools.combinations(range(13), 2):
        assert any(not any(o + m in gone for m in mask) for mask in decontaminate.MASKS for o in range(13 - mask[-1]))


def test_overlaps(spark, empty):
    rng = random.Random(3)
    items = [prose(rng, n) for n in (30, 14, 40, 9)] + [None, "", "too short"]
    clean = [prose(rng, 120) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(clean)] + [(90, None), (91, "")]
    want = set()
    for n, (item, cut, subs) in enumerate([(0, (0, 30), 0), (0, (5, 25), 3), (1, (0, 14), 2), (2, (10, 40), 5), (3, (0, 9), 0), (2, (0, 13), 2)]):
        w = items[item].split()[cut[0]:cut[1]]
        for p in rng.sample(range(1, len(w) - 1), subs):
            w[p] = "swapped"
        docs.append((50 + n, prose(rng, 40) + " " + " ".join(w).translate(UPPER) + " " + prose(rng, 40)))
        want.add((50 + n, item))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, seed int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.overlaps(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(docs)
    for r in got:
        own = [x.lower() for x in text[r.doc_id].split()][r.start_word:r.start_word + r.n_words]
        its = [x.lower() for x in items[r.item_id].split()]
        assert r.n_equal >= 0.8 * r.n_words
        assert max(sum(x == y for x, y in zip(own, its[o:])) for o in range(len(its))) == r.n_equal
    assert decontaminate.overlaps(empty, b).count() == 0
    assert decontaminate.overlaps(d, b.limit(0)).count() == 0


def naive_pii(t):
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r, t) if pii.valid(pii.KINDS[k], m[0]))


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@1-+ 9(é\n") for _ in range(rng.randint(0, 28)))
        assert naive_pii(t) == pii.base_spans(t), t
    assert len(pii.base_spans("a" * 200_000 + "1" * 200_000)) == 0  # no quadratic scan


def sample_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = prose(rng, 14).split()
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(d + c for c in "0123456789" if pii.luhn(d + c))
        w[3] = rng.choice([f"{w[0].lower().encode('ascii', 'ignore').decode()}x.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com", card, "10.%d.3.%d" % (rng.randint(0, 255), rng.randint(0, 255)),
                           f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "plain"])
        out.append(" ".join(w))
    return out


def test_tagger_learns_and_adds_to_the_rules(spark, empty):
    texts = sample_texts(300, 1)
    net = pii.train([t[:pii.WINDOW] for t in texts], [[s for s in pii.base_spans(t) if s[2] <= pii.WINDOW] for t in texts], steps=150)
    held = sample_texts(120, 2)
    rng, found, total, docs = np.random.default_rng(5), 0, 0, []
    for i, t in enumerate(held):
        docs.append((i, pii.disguise(t, pii.base_spans(t), rng)[0], "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, held[0] * 400, "x")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string, base string"), net).collect()}
    for i, t in enumerate(held):
        twin = docs[i][1]
        base = [(pii.KINDS[k], a, z) for a, k, z in pii.base_spans(twin)]
        assert [(s.kind, s.start, s.end) for s in out[i].base] == base
        assert set(base) <= {(s.kind, s.start, s.end) for s in out[i].spans}
        if pii.base_spans(t) and not base:
            total += 1
            found += len(out[i].spans) > 0
    assert total > 20 and found / total > 0.7
    assert out[500].spans == [] and out[501].spans == []
    assert len(out[502].base) == len(naive_pii(held[0] * 400))
    assert pii.find_pii(empty, net).count() == 0 and pii.fit(empty) is None


def test_text_crc_of_null_is_that_of_nothing(spark):
    assert spark.range(1).select(F.crc32(F.lit("").cast("binary"))).first()[0] == zlib.crc32(b"")
