"""Divergence audit, importance resampling and SentencePiece against brute force on odd small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import public_tokenizers
from lakeops.llm import divergence, pieces, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Column names of the operators' own tables ride along as ordinary extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, term string, doc long, rank int"


def words(rng, n):
    return " ".join(rng.choice(["Ba", "do", "ki", "LU", "mé", "ß", "to9", "日本", "É", "x1y"]) for _ in range(n))


def table(seed, size=120):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        text = rng.choice([None, "", "\n", "  \r\n", words(rng, 5), words(rng, 40) + "\n" + words(rng, 3),
                           "Common line here\n" + words(rng, 30) + "\n\nCommon line here\n" + words(rng, 2)])
        rows.append((rng.choice([i, i, i, None, 3]), text, rng.choice(["en", "en", "fr", None]),
                     rng.choice(["a", "a", "b", "ß", "", None]), "t", 1, 2))
    rows.append((7777, words(rng, 20_000), "en", "b", "t", 1, 2))
    rows += [rows[-1]] * 2  # repeated rows
    rows += [(None, "\u0000one\u007ftwo", "zz", "lone", "t", 1, 2)]
    return rows


def shares(count, total, kept):
    return 1 + 10**9 * (count + 2) // (total + 2 * kept)


def brute_divergence(rows, min_docs, top):
    found, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        found[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        count = {s: {t: found[lang, s][t] for t in kept} for s in sources}
        total = {s: sum(count[s].values()) for s in sources}
        of_lang = {t: sum(count[s][t] for s in sources) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            p = {t: shares(count[s][t], total[s], len(kept)) for t in kept}
            pairs, terms = [], []
            for o in sources:
                if o != s:
                    pairs.append((o, sum(far(p[t], shares(count[o][t], total[o], len(kept))) for t in kept)))
            for t in kept:
                q = shares(of_lang[t], sum(of_lang.values()), len(kept))
                if count[s][t] and p[t] > q:
                    terms.append((t, far(p[t], q)))
            for part, found_items, most in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(found_items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,tile_sources,min_docs", [(10**6, 200, 3), (4, 1, 3), (7, 2, 10**6)])
def test_divergence(spark, shard_rows, tile_sources, min_docs):
    rows = table(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.source_divergence(docs, min_docs, 4, shard_rows, tile_sources)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, min_docs, 4)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_for_huge_counts():
    count, total = np.array([9 * 10**15, 0, 123456789012345678]), np.array([10**16, 10**17, 2 * 10**17])
    assert divergence.unit_shares(count, total, np.array([5] * 3)).tolist() == [
        shares(int(c), int(t), 5) for c, t in zip(count, total)]


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, n, buckets, least, percent, seed):
    def of(features):
        return [zlib.crc32(f.encode()) % buckets for f in features]

    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(of(grams(text, n)[1]))
    for text in target:
        t.update(of(grams(text, n)[1]))
    sizes = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sizes[0] + buckets) / ((s[b] + 1.0) * (sizes[1] + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        w, f = grams(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of(f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    may = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = len(may) * percent // 100
    ranks = {id(x): k + 1 for k, x in enumerate(may[:drawn])}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize("n,buckets,partitions", [(1, 10_000, 3), (2, 97, 1), (3, 50, 7)])
def test_resample(spark, n, buckets, partitions):
    rows = table(2)
    target = ["Ba ki\nlu lu mé", None, "日本 ß. ß"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.importance_resample(docs, goal, n=n, buckets=buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target, n, buckets, 20, 30, 2024)


def test_resample_of_nothing(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.importance_resample(none, some).count() == 0
    rows = table(3, 30)
    got = resample.importance_resample(spark.createDataFrame(rows, SCHEMA), some.filter("false"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, [], 1, 10_000, 20, 10, 2024)


def test_a_line_of_most_rows_is_joined_by_broadcast(spark):
    rows = [(i, "the same line\n" + f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(1, "the line")], "item_id long, text string")
    got = resample.importance_resample(docs, goal, least_words=1)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, ["the line"], 1, 10_000, 1, 10, 2024)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_marked_words_give_the_librarys_ids(library):
    rng = random.Random(6)
    bits = [" ", " ", "   ", "▁", "a", "the", "é", "\n", "\t", "日本", "😀", "\x00", "\x7f", "ß", "<s>", "</s>", "<0x41>", "<unk>", "ﬁ", "　", "́", "\r"]
    texts = ["", " ", "  ", "▁", "▁▁", "a ", " a", None] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    assert m.by_word
    for by_word in (True, False):  # whole texts where words cannot stand by themselves
        m.by_word = by_word
        try:
            ids, counts, spelled = pieces.encode_block(m, pa.array(texts))
        finally:
            m.by_word = True
        at = 0
        for text, n, s in zip(texts, counts, spelled):
            assert ids[at:at + n].tolist() == library.encode(text or "")
            assert s.as_py() == ",".join(map(str, ids[at:at + n]))
            at += n


def test_each_distinct_marked_word_is_segmented_once(library):
    m = pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    asked = []
    plain = m.words
    m.words = lambda marked: asked.extend(marked) or plain(marked)
    pieces.encode_block(m, pa.array(["the cat the cat", "the  cat"]))
    assert sorted(asked) == ["  cat", " cat", " the"]


def test_encode_and_decode(spark, library):
    rows = table(4, 40) + [(5, " ▁ x  ", "en", "a", "t", 1, 2), (6, "y" * 50_000, "en", "a", "t", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = pieces.encode_pieces(docs).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        back = library.decode(ids) if ids else ""
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    again = pieces.decode_pieces(pieces.encode_pieces(docs).select("doc_id", "ids")).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((w[0], w[5]) for w in want), key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert pieces.encode_pieces(empty, with_ids=False).count() == 0
