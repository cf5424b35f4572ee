"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled documents are all it learns from; label 0 is never
read. A first fit of "labelled against unlabelled" ranks the documents; the class prior is
estimated from that ranking; the final network minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

Only a bounded sample of feature rows reaches the driver; every document is scored in its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, raw_bytes, slices, stage, text_of, word_hashes, word_spans

#: Most positives and most unlabelled documents that the fit reads (those with the smallest hashes of their ids).
MAX_POSITIVES, MAX_UNLABELLED = 16_000, 32_000
#: Hashed pairs of neighbouring bytes, beside the counts listed in `features`.
PAIR_BUCKETS = 96

_KINDS = ("upper", "letter", "wide", "digit", "blank", "line feed", "plain mark", "other mark")
_KIND = np.full(256, 7, np.int32)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[44, 46, 39]] = 4, 5, 6
_PAIR = np.random.default_rng(3).integers(0, PAIR_BUCKETS, 1 << 16).astype(np.int32)

def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text: shares of kinds of bytes, of repeated words and word pairs, word lengths, byte pairs."""
    flat, ends = raw_bytes(texts)
    rows = len(ends)
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    per_byte = np.maximum(sizes, 1)
    kinds = np.bincount(row * len(_KINDS) + _KIND[flat], minlength=rows * len(_KINDS)).reshape(rows, -1)
    out = list((kinds / per_byte[:, None]).T)
    upper = _KIND[flat] == 0

    starts, stops, counts = word_spans(flat, ends)
    words, _ = word_hashes(texts, lower=True)
    of = np.repeat(np.arange(rows), counts)
    n = np.maximum(counts, 1)
    length = (stops - starts).astype(float)
    mean = np.bincount(of, length, rows) / n
    out += [mean / 10, np.sqrt(np.maximum(0, np.bincount(of, length ** 2, rows) / n - mean ** 2)) / 10]
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    out.append(np.bincount(of[same], minlength=rows) / n)
    shouted = np.zeros(len(words), bool)
    if len(words):
        shouted = np.add.reduceat(np.concatenate((upper, [False])).astype(np.int32), np.stack((starts, stops), 1).ravel())[::2] >= 2
    out.append(np.bincount(of[shouted], minlength=rows) / n)
    for keys, at in ((words, of), _pairs(words, of)):
        # row in the high bits, hash in the low ones: one sort groups equal words of a row
        k = np.sort((at.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
        run = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        a = (k[run] >> np.uint64(44)).astype(np.int64)
        out.append(np.bincount(a, minlength=rows) / n)
        most = np.zeros(rows)
        np.maximum.at(most, a, np.diff(run, append=len(k)))
        out.append(most / n)
    out.append(np.log1p(counts) / 10)
    # Pairs of neighbouring bytes; those that straddle two rows are taken off again.
    code = flat[:-1].astype(np.uint16) << np.uint16(8) | flat[1:]
    pairs = np.bincount(row[:-1] * PAIR_BUCKETS + _PAIR[code], minlength=rows * PAIR_BUCKETS).reshape(rows, PAIR_BUCKETS)
    last = ends[(sizes > 0) & (ends < len(flat))] - 1
    np.subtract.at(pairs, (row[last], _PAIR[code[last]]), 1)
    return np.hstack((np.stack(out, 1), np.sqrt(pairs / per_byte[:, None]))).astype(np.float32)


def _pairs(words: np.ndarray, of: np.ndarray):
    at = np.flatnonzero(of[1:] == of[:-1]) if len(of) > 1 else np.zeros(0, np.int64)
    return words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + 1], of[at]


class Network:
    """One hidden layer, fitted by Adam on the gradient of the logits that `fit` is given."""

    def __init__(self, width: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = [(r.normal(size=(width, hidden)) / np.sqrt(width)).astype(np.float32), np.zeros(hidden, np.float32),
                  (r.normal(size=hidden) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)]
        self.m, self.v, self.t = [0 * x for x in self.p], [0 * x for x in self.p], 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.norm(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def step(self, x: np.ndarray, grad_of, rate: float, decay: float = 1e-4) -> None:
        """``x`` is normalised; ``grad_of(logits)`` gives the loss gradient for each row."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        g = grad_of(h @ self.p[2] + self.p[3]).astype(np.float32)
        back = np.outer(g, self.p[2]) * (1 - h * h)
        self.t += 1
        for i, d in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum(keepdims=True))):
            d = d + decay * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * d
            self.v[i] = 0.999 * self.v[i] + 0.001 * d * d
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[i] / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _batches(p, u, rng, size=2048):
    order = rng.permutation(len(u))
    for i in range(0, len(u), size):
        yield p[rng.integers(0, len(p), size)], u[order[i:i + size]]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of "labelled" for both.

    For any set S of documents, P_unlabelled(S) >= prior * P_positive(S); the least ratio over
    the sets "score at least t" that hold a fair part of the positives is the estimate.
    """
    best = 1.0
    for t in np.quantile(positive, np.linspace(0.02, 0.6, 30)):
        inside = float(np.mean(positive >= t))
        slack = 1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive))  # chance alone must not pull it down
        best = min(best, (float(np.mean(unlabelled >= t)) + slack) / inside)
    return float(np.clip(best, 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 60, hidden: int = 24, seed: int = 5) -> tuple[Network, float]:
    """The network and the estimated prior, from feature rows of positives and unlabelled documents."""
    every = np.vstack((positive, unlabelled))
    rng = np.random.default_rng(seed)

    def fresh(s):
        net = Network(every.shape[1], hidden, s)
        net.mean, net.scale = every.mean(0), every.std(0) + 1e-3
        return net

    whole = fresh(seed)
    p, u = whole.norm(positive), whole.norm(unlabelled)
    folds_p, folds_u = np.arange(len(p)) % 2, np.arange(len(u)) % 2
    score_p, score_u = np.zeros(len(p)), np.zeros(len(u))
    for side in (0, 1):  # each half is ranked by a fit on the other, so that nothing learnt by heart counts
        rank = fresh(seed)
        own_p, own_u = p[folds_p != side], u[folds_u != side]
        if not len(own_p) or not len(own_u):
            continue
        for _ in range(12):
            for a, b in _batches(own_p, own_u, rng):
                rank.step(np.vstack((a, b)), lambda z, n=len(a): np.concatenate(
                    ((sigmoid(z[:n]) - 1) / n, sigmoid(z[n:]) / (len(z) - n))), 4e-3)
        score_p[folds_p == side] = rank.logits(positive[folds_p == side])
        score_u[folds_u == side] = rank.logits(unlabelled[folds_u == side])
    prior = class_prior(score_p, score_u)

    net = fresh(seed + 1)
    for epoch in range(epochs):
        for a, b in _batches(p, u, rng):
            n = len(a)

            def grad(z):
                plus, minus = sigmoid(z), sigmoid(-z)
                # logistic loss: R+ is mean softplus(-z), R- is mean softplus(z)
                negative = np.mean(np.logaddexp(0, z[n:])) - prior * np.mean(np.logaddexp(0, z[:n]))
                g = np.zeros_like(z)
                if negative >= 0:
                    g[:n] += prior * (-minus[:n]) / n - prior * plus[:n] / n
                    g[n:] += plus[n:] / (len(z) - n)
                else:  # the negative part is held at zero
                    g[:n] -= prior * minus[:n] / n
                return g

            net.step(np.vstack((a, b)), grad, 1e-2 * 0.97 ** epoch)
    return net, prior


def _feature_rows(batches):
    for b in batches:
        for at, n in slices(b["text"]):
            x = features(b["text"].slice(at, n))
            yield pa.RecordBatch.from_arrays(
                [b["id"].slice(at, n), b["known"].slice(at, n), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
                names=["id", "known", "x"])


def train(docs: DataFrame, positives: DataFrame, exclude=None, max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[Network, float] | None:
    """Fit on trusted positives (a table of ids) and the documents that ``positives`` does not name.

    ``exclude`` is a condition on the id column for rows that must not be learnt from. The fit
    reads at most ``max_positives`` and ``max_unlabelled`` rows, chosen by the hash of their ids.
    None if either side is empty.
    """
    ids = docs.select(docs[id_col].cast("long").alias("id")).filter("id is not null").distinct()
    good = positives.select(positives[positives.columns[0]].cast("long").alias("id")).filter("id is not null").distinct()
    if exclude is not None:
        ids, good = ids.filter(~exclude(F.col("id"))), good.filter(~exclude(F.col("id")))
    split = stage(ids.join(good.withColumn("known", F.lit(1)), "id", "left").select("id", F.coalesce("known", F.lit(0)).alias("known")), "known")
    chosen = hash_sample(split.filter("known = 1"), ["id"], max_positives).unionByName(
        hash_sample(split.filter("known = 0"), ["id"], max_unlabelled))
    # At most max_positives + max_unlabelled ids: small enough for every task.
    rows = (docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
            .join(F.broadcast(chosen), "id").select("id", "known", "text"))
    got = rows.mapInArrow(_feature_rows, "id long, known int, x array<float>").toArrow()
    known = np.asarray(got["known"])
    if not (known == 1).any() or not (known == 0).any():
        return None
    x = np.asarray(pc.list_flatten(got["x"].combine_chunks())).reshape(len(known), -1)
    order = np.lexsort((x[:, 0], np.asarray(got["id"]), known))  # the fit does not depend on the order rows arrive in
    known, x = known[order], x[order]
    return fit(x[known == 1], x[known == 0])


def score(docs: DataFrame, net: Network | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column ``out_col`` (0 to 1, higher: better text), replacing one of that name.

    Only the text is scored; null counts as empty, and an empty text gets the network's answer to
    all-zero counts. Without a network every score is 0.5. Repeated rows get equal scores; an empty
    table gives an empty result; other columns pass through, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast((net.p, net.mean, net.scale)) if net is not None else None
    rest = [docs[c] for c in docs.columns if c not in (out_col, text_col)]
    kept = docs.select(F.struct(docs[text_col].cast("string").alias(text_col), *rest).alias("row"))
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def apply(batches):
        if model is not None:
            own = Network(len(model.value[1]), 1, 0)
            own.p, own.mean, own.scale = model.value
        for b in batches:
            text, s = b["row"].field(0), np.full(b.num_rows, 0.5)
            if model is not None:
                for at, n in slices(text):
                    s[at:at + n] = sigmoid(own.logits(features(text.slice(at, n))))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(s, pa.float64())], names=["row", "score"])

    out = kept.mapInArrow(apply, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out_col], F.col("score").alias(out_col))
