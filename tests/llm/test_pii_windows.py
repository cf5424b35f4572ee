"""Windows of many texts go through the network together, with the tags that each has by itself."""

import math
import random

import numpy as np

from lakeops.llm import pii


def texts(n, seed):
    rng = random.Random(seed)
    words = ["at", "mia@site3.org", "10.2.3.44", "dot", "+49 171 555 0199", "plain", "house", "é7", "4111 1111 1111 1111", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)] + ["", "no mark of any kind"]


def plain_viterbi(net, x):
    e, tr = net.emissions(x)[0], net.p["tr"] + pii._BAN
    best, back = e[0], []
    for t in range(1, len(e)):
        s = best[:, :, None] + tr
        back.append(s.argmax(1))
        best = e[t] + s.max(1)
    out = [best.argmax(1)]
    for b in reversed(back):
        out.append(b[np.arange(len(b)), out[-1]])
    return np.stack(out[::-1], 1)


def test_windows_of_many_texts_are_decoded_together(monkeypatch):
    net, sizes = pii.Tagger(), []
    decode = net.decode
    xs = [pii.codes(t) for t in texts(300, 1)]
    starts = [pii.window_starts(pii.marks_of(x, t)) for x, t in zip(xs, texts(300, 1))]
    monkeypatch.setattr(net, "decode", lambda x: sizes.append(len(x)) or decode(x))
    got = net.tags(xs, starts)
    assert sum(sizes) == sum(map(len, starts)) > 1000 and max(sizes) <= pii.DECODED
    assert len(sizes) == math.ceil(sum(sizes) / pii.DECODED)  # not one call or more for each text
    assert len(got) == len(xs)
    for x, s, tags in zip(xs, starts, got):
        assert tags.shape == (len(s), pii.WINDOW)
        if len(s):
            alone = np.stack([pii._padded(x, i, 4) for i in s])
            assert (tags == plain_viterbi(net, alone)).all()
    assert [t.shape for t in net.tags([pii.codes("none")], [np.zeros(0, np.int64)])] == [(0, pii.WINDOW)]


def test_a_table_takes_few_calls(spark, monkeypatch):
    """find_pii on one task of many short texts: the calls follow the windows, not the texts."""
    net = pii.Tagger()
    rows = [(i, f"call 0171 555 {i}" if i % 2 else f"write mia{i}@site.org") for i in range(400)]
    calls = spark.sparkContext.accumulator(0)
    decode = pii.Tagger.decode

    def counted(self, x):
        calls.add(1)
        return decode(self, x)

    monkeypatch.setattr(pii.Tagger, "decode", counted)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(pii)
    try:
        out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), net).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(pii)
    assert sorted(r.doc_id for r in out) == list(range(400))
    assert all([(s.kind, s.start) for s in r.base] == ([] if r.doc_id % 2 else [("email", 6)]) for r in out)
    assert 1 <= calls.value <= 8, calls.value
