"""Held-out accuracy of the classifiers, the registered queries against their SQL, the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeops.llm import common, packing, pii, quality, queries, secret_scan
from lakeops.session import read_table

SF = "/root/testdata/sf0.001"


def texts(rng, n):
    """Prose (1) and junk of three kinds (0)."""
    words = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        kind = rng.random()
        if kind < 0.75:
            out.append((" ".join(w).capitalize() + ".", 1))
        elif kind < 0.83:
            out.append((" ".join(x.upper() + "!!" for x in w), 0))
        elif kind < 0.91:
            out.append((" ".join(x + "###" for x in w), 0))
        else:
            out.append((" ".join(x for x in w[:5] for _ in range(20)), 0))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, t, q) for i, (t, q) in enumerate(texts(random.Random(3), 1500))]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9000, "", "x")], "doc_id long, text string, score string")
    positives = spark.createDataFrame([(i,) for i, _, q in rows if q == 1 and i % 2], "doc_id long")
    return rows, docs, positives


def test_positive_unlabelled_learning(spark, labelled):
    rows, docs, positives = labelled
    held = lambda c: c % 4 == 2
    net, prior = quality.train(docs, positives, exclude=held)
    assert 0.4 < prior < 0.85  # about 0.6 of what is not named is good
    out = quality.score(docs, net)
    assert out.columns == ["doc_id", "text", "score"] and dict(out.dtypes)["score"] == "double"
    got = {r.doc_id: r.score for r in out.collect()}
    assert len(got) == 1502 and all(0 <= s <= 1 for s in got.values())
    test = [(got[i] >= 0.7, q == 1) for i, _, q in rows if i % 4 == 2]
    assert np.mean([a == b for a, b in test]) > 0.95
    again, _ = quality.train(docs.repartition(7), positives, exclude=held)
    assert all(np.allclose(a, b) for a, b in zip(net.p, again.p))  # the rows' order does not matter


def test_quality_without_labels(spark, labelled):
    _, docs, positives = labelled
    assert quality.train(docs, positives.limit(0)) is None
    assert quality.train(docs.limit(0), positives) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_features_do_not_depend_on_neighbours():
    many = pa.array(["One two two.", None, "", "ÉTÉ 12 | a | a", "x" * 5000, "a\nb\nb"])
    whole = quality.features(many)
    for i in range(len(many)):
        assert np.allclose(whole[i], quality.features(many.slice(i, 1))[0]), i


def test_word_hashes_follow_the_words():
    a, counts = common.word_hashes(pa.array(["One  two\tONE", None, "two", " \x0b "]), lower=True)
    assert list(counts) == [3, 0, 1, 0] and a[0] == a[2] and a[1] == a[3] and a[0] != a[1]
    b, _ = common.word_hashes(pa.array(["One ONE"]), lower=False)
    assert b[0] != b[1]
    assert [x for x in common.slices(pa.array(["a" * 10] * 5 + ["b" * 100]), 25)] == [(0, 2), (2, 2), (4, 1), (5, 1)]


def test_bitmap(spark):
    d = spark.range(1000).select(F.xxhash64("id").alias("h"))
    bits = common.bitmap_of(d, "h", 16)
    own = np.array([r.h for r in d.collect()], np.int64)
    assert common.in_bitmap(bits, own).all() and len(bits) == 1024
    other = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    assert common.in_bitmap(bits, other).mean() < 0.03
    assert not common.in_bitmap(common.bitmap_of(d.limit(0), "h", 16), own).any()


def test_hash_sample(spark):
    d = spark.range(5000).withColumn("x", F.lit(1))
    a, b = (sorted(r.id for r in common.hash_sample(d.repartition(n), ["id"], 300).collect()) for n in (1, 5))
    assert a == b and len(a) == 300
    assert common.hash_sample(d, ["id"], 9000).count() == 5000


def secret_texts(rng, n):
    docs = []
    for i in range(n):
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40])))
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(15)) + str(rng.randint(0, 9))
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(d + c for c in "0123456789" if pii.luhn(d + c))
        kind = i % 4
        value, before = ((hexa + "7", 'password='), (key, "the "), (card, "a card "), ("abcdefghijklmnopqr1", "some "))[kind]
        docs.append((i, f"lorem ipsum é {before}{value} and more text here\nmore {value}", "path/test" if kind == 3 else "src", kind < 2, value))
    return docs


def test_secret_scan_on_held_out_findings(spark):
    rng = random.Random(5)
    docs = secret_texts(rng, 320)
    schema = "doc_id long, text string, source string"
    train = spark.createDataFrame([d[:3] for d in docs[:200]], schema)
    marks = {(d[0], d[4]): float(d[3]) for d in docs}
    found = secret_scan.findings(train).collect()
    text = {d[0]: d[1] for d in docs}
    assert all(text[f.doc_id][f.start:f.end] == f.finding for f in found) and len(found) == 400
    given = spark.createDataFrame([(*f, marks[f.doc_id, f.finding]) for f in found],
                                  "doc_id long, start long, end long, finding string, before string, after string, path string, label double")
    test = spark.createDataFrame([d[:3] for d in docs[200:]] + [(None, None, None), (900, "", None), (901, "x" * 50_000 + "1", "p")], schema)
    out = secret_scan.scan(test, labelled=given).collect()
    own = [r for r in out if r.doc_id is not None and r.doc_id < 900]
    right = [r.is_secret == bool(marks[r.doc_id, r.finding]) for r in own]
    assert len(own) == 240 and np.mean(right) > 0.95
    assert [r.end - r.start for r in out if r.doc_id == 901] == [50_001]


def test_secret_scan_learns_from_a_rare_label(spark):
    """One secret among many harmless findings and their copies is read, and so are those beside a hot group."""
    def fitted(rows):
        names = ["f_length", "f_hex"]
        rows = spark.createDataFrame(rows, "finding string, before string, after string, label double, f_length double, f_hex double")
        return secret_scan.train(rows, names, max_rows=20)

    many = [(f"word{i}", "the ", " is", 0.0, 30.0, 0.0) for i in range(3000)]
    hot = [("license", "the ", " of", 0.0, 30.0, 0.0)] * 3000
    for label in (0.0, 1.0):
        for rows in (many, hot, many + hot):
            rest = [(*r[:3], label, *r[4:]) for r in rows]
            model = fitted(rest + [("deadbeef01", "key=", "", 1 - label, 18.0, 1.0)])
            assert model is not None and model.numFeatures == 2
            assert fitted(rest) is None


def test_secret_scan_without_labels_or_rows(spark):
    schema = "doc_id long, text string, source string, score int"
    assert secret_scan.scan(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "plain qwertyuiopasdfgh12345 text", None, 4)], schema)
    assert [(r.score, r.is_secret) for r in secret_scan.scan(one).collect()] == [(1.0, True)]


def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck().execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_query_digests(spark):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, SF, "documents").collect()}
    rows = queries.op4_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    enc = packing.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for r in queries.op1_packing(spark, SF).collect()[:200]:
        ids = enc(docs[r.doc_id]) + b"\1\0\0\0"
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4
    for r in queries.op10_pii(spark, SF).collect():
        base = [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in pii.base_spans(docs[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    docs = read_table(spark, SF, "documents")
    n, had = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, SF), "test-pipeline")
        assert docs.columns == had and docs.count() <= n, name
        n = docs.count()
    left = {r.doc_id for r in docs.collect()}
    assert 0 < len(left) and {r.doc_id for r in corpus_pipeline.packed(spark, docs, SF).collect()} == left
    assert docs.select(common.strip_spaces(F.col("text"))).distinct().count() == n
    odd = spark.createDataFrame([(None, "a b c", None, None, None), (None, "abc", None, None, None), (5, None, None, None, None)], docs.schema)
    kept = corpus_pipeline.exact_dedup(spark, odd, SF).collect()
    assert len(kept) == 2
    assert corpus_pipeline.near_dedup(spark, odd, SF).count() == 3
    assert corpus_pipeline.decontaminated(spark, odd, SF).count() == 3


def test_decontamination_takes_the_contaminated_rows_only(spark):
    docs = read_table(spark, SF, "documents")
    item = max((r.text for r in read_table(spark, SF, "benchmark").collect() if r.text), key=len)
    clean = [(None, "nothing of the kind"), (None, None), (7, "a clean text with this id")]
    dirty = [(None, "before it " + item), (7, item + " after it"), (8, item)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in clean + dirty], docs.schema)
    kept = corpus_pipeline.decontaminated(spark, rows, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(clean, key=repr)
