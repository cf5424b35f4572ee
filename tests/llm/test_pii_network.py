"""What the network adds to the rules: recall and precision on planted spans that no fit has seen."""

import random

import numpy as np

from lakeops.llm import pii

SF = "/root/testdata/sf0.1"


def fresh(rng, kind):
    """Data of people and hosts that do not occur in the tables, as the rules know it."""
    if kind == 0:
        return (f"{rng.choice(['anna', 'bo.k', 'user', 'Mia_'])}{rng.randrange(99)}@{rng.choice(['site', 'post', 'web'])}"
                f"{rng.randrange(9)}.{rng.choice(['org', 'net', 'example.com'])}")
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        d = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))
    return f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"


def test_disguised_data_is_found_beyond_the_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = pii.fit(docs)
    texts = sorted({r.text for r in docs.filter("length(text) > 200").select("text").limit(900).collect()})
    rng, npr = random.Random(3), np.random.default_rng(5)
    rows, planted = [], {}
    for i, text in enumerate(rng.sample(texts, 500)):
        text, kind = text[:1500], rng.randrange(4)
        s = pii.disguised(kind, fresh(rng, kind), npr)
        at = text.find(" ", rng.randrange(100)) + 1
        twin = text[:at] + s + " " + text[at:]
        if not any(a < at + len(s) and z > at for a, _, z in pii.base_spans(twin)):
            planted[i] = (at, pii.KINDS[kind], at + len(s))
            rows.append((i, twin))
    clean = [(1000 + i, t[:1500]) for i, t in enumerate(texts[:300])]
    out = pii.find_pii(spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(4), net).collect()
    found = right = 0
    for r in out:
        text = dict(rows + clean)[r.doc_id]
        base = [tuple(x) for x in r.base]
        assert base == [(a, pii.KINDS[k], z) for a, k, z in pii.base_spans(text)]
        more = [tuple(x) for x in r.spans if tuple(x) not in base]
        assert set(base) <= {tuple(x) for x in r.spans}
        found += len(more)
        right += planted.get(r.doc_id) in more
    assert len(planted) > 400
    assert right >= 0.8 * len(planted), (right, len(planted))
    assert right >= 0.9 * found, (right, found)
