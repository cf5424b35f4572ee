"""Personal data: rules plus a character-level bidirectional LSTM with a CRF, in numpy.

The rules give the base spans. The network reads overlapping windows of characters and tags each
character (outside, begin or inside of a kind); it is trained from labelled spans and their
disguised twins, which the rules miss: an address whose at sign and dots are spelt out or set apart, a
phone number without its plus, numbers with other separators. Its windows are decoded by Viterbi and
reconciled over the whole text: every character takes its tag from the window in which it lies most
centrally. Where a span lies and of what kind it is, the network decides; a span is only dropped
when its content cannot be of that kind (check digits, ranges, an address without a host).

Every kind holds a digit, an at sign or the word "at"; windows without any of these have no span
and are not computed. Whole texts are covered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, raw_bytes, slices, stage, text_of

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and the step between windows.
WINDOW, STEP = 96, 48
#: Most labelled windows that the fit reads (those with the smallest hashes).
MAX_WINDOWS = 2_500
HIDDEN = 24
#: Windows that are decoded at once.
DECODED = 512

# ---- base rules ---------------------------------------------------------------------------

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT_WORD = re.compile(r"(?<![A-Za-z])at(?![A-Za-z])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def valid(kind: str, s: str) -> bool:
    """The check that a match of the kind has to pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches, leftmost and non-overlapping in each kind."""
    out, last = [], 0
    # An address is found from its at sign: the longest run before it, back to the last match.
    for m in _HOST.finditer(text) if "@" in text else ():
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, 0, m.end()))
            last = m.end()
    for kind, rule in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if kind < 3 or "+" in text:
            out += [(m.start(), kind, m.end()) for m in rule.finditer(text) if valid(KINDS[kind], m[0])]
    return sorted(out)


# ---- characters, windows, tags --------------------------------------------------------------

_CLASSES = 26
_CODE = np.full(128, 25, np.int8)  # other
for _n, _chars in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " ", "\t\n\x0b\f\r", "@",
                             ".", "-", "_", "+", "(", ")", "%", "/", ":", "=", ",", ";", "\"'", "!?", "[]{}", "<>", "#$&*|~^")):
    _CODE[[ord(c) for c in _chars]] = _n
_OUTSIDE_ASCII = 23
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], _OUTSIDE_ASCII).astype(np.int8)


def tags_of(length: int, spans) -> np.ndarray:
    y = np.zeros(length, np.int8)
    for start, kind, end in spans:
        if not y[start:end].any():  # of overlapping kinds the first is learnt
            y[start], y[start + 1:end] = 1 + 2 * kind, 2 + 2 * kind
    return y


def marks_of(x: np.ndarray, text: str) -> np.ndarray:
    """Which characters are a digit, an at sign or the beginning of the word "at"."""
    out = (x == 0) | (x == 5)
    out[[m.start() for m in _AT_WORD.finditer(text)]] = True
    return out


def window_starts(marks: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a mark."""
    n = max(1, -(-(len(marks) - (WINDOW - STEP)) // STEP))
    so_far = np.concatenate(([0], np.cumsum(marks)))
    start = np.arange(n) * STEP
    return start[so_far[np.minimum(start + WINDOW, len(marks))] > so_far[start]]


def _padded(x: np.ndarray, start: int, fill: int) -> np.ndarray:
    part = x[start:start + WINDOW]
    return np.concatenate((part, np.full(WINDOW - len(part), fill, x.dtype)))


# ---- the network ----------------------------------------------------------------------------

_BAN = np.zeros((TAGS, TAGS), np.float32)
for _to in range(2, TAGS, 2):  # inside only follows begin or inside of its own kind
    _BAN[:, _to] = -1e4
    _BAN[[_to - 1, _to], _to] = 0


def _sig(z):
    return 1 / (1 + np.exp(-z))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 3, hidden: int = HIDDEN):
        r, h = np.random.default_rng(seed), hidden
        g = lambda *s: (r.normal(size=s) * 0.2).astype(np.float32)
        self.h = h
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("wx", g(_CLASSES, 4 * h)), ("wh", g(h, 4 * h)), ("b", np.zeros(4 * h, np.float32)))}
        for d in "fb":
            self.p[f"b{d}"][h:2 * h] = 1  # remember by default
        self.p |= {"wo": g(2 * h, TAGS), "bo": np.zeros(TAGS, np.float32), "tr": np.zeros((TAGS, TAGS), np.float32)}
        self.m = {k: 0 * v for k, v in self.p.items()}
        self.v = {k: 0 * v for k, v in self.p.items()}
        self.t = 0

    def _run(self, x, d, keep):
        """Hidden states in reading order; x is (batch, time)."""
        n, h, p = len(x), self.h, self.p
        state = cell = np.zeros((n, h), np.float32)
        out, trail = np.zeros((x.shape[1], n, h), np.float32), []
        for t in range(x.shape[1]):
            z = p[f"wx{d}"][x[:, t]] + state @ p[f"wh{d}"] + p[f"b{d}"]
            gates, g = _sig(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            before, prior = cell, state
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[t] = state
            if keep:
                trail.append((i, f, o, g, before, tc, prior))
        return out, trail

    def _back(self, x, d, trail, dout, grad):
        h, p = self.h, self.p
        dh = dc = np.zeros((len(x), h), np.float32)
        zs, priors = [], []
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, before, tc, prior = trail[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
            zs.append(z)
            priors.append(prior)
            dh, dc = z @ p[f"wh{d}"].T, dc * f
        z = np.concatenate(zs)
        grad[f"wx{d}"] += np.eye(_CLASSES, dtype=np.float32)[x[:, ::-1].T.ravel()].T @ z
        grad[f"wh{d}"] += np.concatenate(priors).T @ z
        grad[f"b{d}"] += z.sum(0)

    def emissions(self, x, keep=False):
        f, tf = self._run(x, "f", keep)
        b, tb = self._run(x[:, ::-1], "b", keep)
        both = np.concatenate((f, b[::-1]), 2)
        return both @ self.p["wo"] + self.p["bo"], both, tf, tb

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adam step on the CRF's negative log-likelihood; returns the loss for a window."""
        e, both, tf, tb = self.emissions(x, True)
        steps, n = e.shape[:2]
        y, tr = y.T, self.p["tr"] + _BAN
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _lse(alpha[-1], 1)
        rows = np.arange(n)
        gold = sum(e[t, rows, y[t]] for t in range(steps)) + sum(tr[y[t - 1], y[t]] for t in range(1, steps))
        de = np.exp(alpha + beta - log_z[None, :, None])
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps):
            grad["tr"] += np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(grad["tr"], (y[:-1].ravel(), y[1:].ravel()), -1)
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        grad["wo"] += np.tensordot(both, de, ((0, 1), (0, 1)))
        grad["bo"] += de.sum((0, 1))
        dboth = de @ self.p["wo"].T
        self._back(x, "f", tf, dboth[:, :, :self.h], grad)
        self._back(x[:, ::-1], "b", tb, dboth[::-1, :, self.h:], grad)
        self.t += 1
        for k, g in grad.items():
            g = np.clip(g / n, -5, 5)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-7)
        return float((log_z - gold).mean())

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window, by Viterbi."""
        best = np.ascontiguousarray(self.emissions(x)[0].transpose(0, 2, 1))  # (time, tag, window)
        tr = self.p["tr"] + _BAN
        for t in range(1, len(best)):
            best[t] += (best[t - 1][:, None] + tr[:, :, None]).max(0)
        out = [best[-1].argmax(0)]
        for b in best[-2::-1]:  # only the way into the chosen tag is looked for again
            out.append((b + tr[:, out[-1]]).argmax(0))
        return np.stack(out[::-1], 1).astype(np.int8)

    def tags(self, xs: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of the windows of several texts, each at its ``starts``.

        A text has few windows and a step of the network costs little more for hundreds of them, so the
        windows of all texts are decoded together, DECODED at a time.
        """
        ends = np.cumsum([len(s) for s in starts])
        flat = np.concatenate([part for x in xs for part in (x, np.full(WINDOW, 4, x.dtype))])
        at = np.concatenate([s + b for s, b in zip(starts, np.cumsum([0] + [len(x) + WINDOW for x in xs[:-1]]))])
        found = [self.decode(flat[at[j:j + DECODED, None] + np.arange(WINDOW)]) for j in range(0, len(at), DECODED)]
        return np.split(np.concatenate([np.zeros((0, WINDOW), np.int8), *found]), ends[:-1])


#: How disguised twins write an at sign, a dot of an address, and what stands between groups of digits.
AT_FORMS = (" @ ", " at ", " (at) ", "(at)", "[at]", " [at] ", " AT ", "@ ", " @")
DOT_FORMS = (".", " dot ", " (dot) ", "[.]", " . ", "(dot)", "[dot]")
_NAME_PARTS = ("an", "Bo", "mar", "li", "sen", "tor", "jo", "k", "ev", "ri", "dan", "Su", "web", "post", "7", "42", "x", "19")
_ENDS = ("com", "org", "net", "de", "io", "info", "co")
GAPS = (" ", ".", "-", "/", " - ", "_", "  ", ". ")


def disguised(kind: int, s: str, rng) -> str:
    """The data of a span in a form that the rules do not know."""
    pick = lambda forms: forms[rng.integers(len(forms))]
    d = _digits(s)
    if kind == 0:
        left, _, host = s.rpartition("@")
        if rng.integers(2):  # other names, so that those of the rules' addresses are not learnt by heart
            name = lambda: "".join(pick(_NAME_PARTS) for _ in range(rng.integers(1, 4)))
            left, host = name() + pick(("", ".", "_", "-")) + name(), ".".join([name() for _ in range(rng.integers(1, 3))] + [pick(_ENDS)])
        return left + pick(AT_FORMS) + host.replace(".", pick(DOT_FORMS))
    if kind == 1:
        return pick((" . ", "[.]", ". ", "-", " dot ", ",", "/")).join(s.split("."))
    if kind == 2:
        return pick([g for g in GAPS if g not in (" ", "-")]).join(d[i:i + 4] for i in range(0, len(d), 4))
    cut, gap = 1 + rng.integers(3), pick(GAPS)
    rest = d[cut:]
    return pick(("", "00", "(0)")) + d[:cut] + gap + gap.join(rest[i:i + 3] if len(rest) - i != 4 else rest[i:] for i in range(0, len(rest) - (len(rest) % 3 == 1), 3))


def disguise(text: str, spans, rng) -> tuple[str, list]:
    """A twin of a labelled text whose spans are written differently; the labels move along."""
    out, moved, at, size = [], [], 0, 0
    for start, kind, end in sorted(spans):
        if start < at:
            continue
        s = disguised(kind, text[start:end], rng)
        out += [text[at:start], s]
        size += start - at
        moved.append((size, kind, size + len(s)))
        size, at = size + len(s), end
    out.append(text[at:])
    return "".join(out), moved


def train(texts: list[str], spans: list[list], steps: int = 600, batch: int = 64, seed: int = 3) -> Tagger:
    """Fit on texts with labelled (start, kind number, end) spans, each with four disguised twins."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, labels in zip(texts, spans):
        twins = [disguise(text, labels, rng) for _ in range(4)] if labels else []
        for t, s in ((text, labels), *twins):
            x = codes(t)
            y = tags_of(len(x), s)
            xs.append(_padded(x, 0, 4))
            ys.append(_padded(y, 0, 0))
    x, y = np.stack(xs), np.stack(ys)
    net = Tagger(seed)
    for i in range(steps):
        pick = rng.integers(0, len(x), batch)
        net.step(x[pick], y[pick], 0.02 * (1 - i / steps) + 0.001)
    return net


def plausible(kind: int, s: str) -> bool:
    """Whether what a found span holds can be of its kind, however it is written."""
    if kind == 0:
        bare = re.sub(r"\s+", "", re.sub(r"\s*[\[(]?\s*(?<![A-Za-z])dot(?![A-Za-z])\s*[\])]?\s*|\s*\[?\.\]?\s*", ".", _AT_WORD.sub("@", s), flags=re.I))
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+[\[(]?@[\])]?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", bare))
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    return not re.search("[A-Za-z]", s) and valid(KINDS[kind], s)


def found_spans(text: str, x: np.ndarray, starts: np.ndarray, tags: np.ndarray, base) -> list[tuple[int, int, int]]:
    """The network's spans that pass their checks and meet no base span; ``tags`` are those of the windows at ``starts``."""
    y = np.zeros(len(x), np.int8)
    edge = (WINDOW - STEP) // 2
    for start, t in zip(starts, tags):  # the central half; the text's ends belong to their only window
        lo = 0 if start == 0 else start + edge
        hi = len(x) if start + WINDOW >= len(x) else start + WINDOW - edge
        y[lo:hi] = t[lo - start:hi - start]
    out, n = [], len(y)
    begins = np.flatnonzero((y > 0) & ((y % 2 == 1) | (np.concatenate(([0], y[:-1])) == 0)))
    for b in begins:
        kind, e = (int(y[b]) - 1) // 2, int(b) + 1
        while e < n and y[e] == 2 + 2 * kind:
            e += 1
        s = text[b:e]
        lone = not (b and text[b - 1].isalnum()) and not (e < n and text[e].isalnum())
        if lone and plausible(kind, s) and all(e <= a or b >= z for a, _, z in base):
            out.append((int(b), kind, e))
    return out


# ---- Spark ----------------------------------------------------------------------------------

def _marked(texts: pa.Array) -> np.ndarray:
    """Which rows hold a digit, an at sign or the word "at"."""
    flat, ends = raw_bytes(texts)
    marks = np.concatenate(([0], np.cumsum(((flat >= 48) & (flat <= 57)) | (flat == 64))))
    word = pc.fill_null(pc.match_substring_regex(texts, r"(?i)(?:^|[^a-z])at(?:[^a-z]|$)"), False)
    return (np.diff(marks[ends], prepend=0) > 0) | np.asarray(word)


def _labelled(batches):
    """Windows with their base spans, for the fit."""
    for b in batches:
        texts, labels = [], []
        for i in np.flatnonzero(_marked(b["text"])):
            text = b["text"][int(i)].as_py()
            spans, x = base_spans(text), codes(text)
            for s in window_starts(marks_of(x, text)):
                own = [(a - s, k, z - s) for a, k, z in spans if a >= s and z <= s + WINDOW]
                if len(own) == sum(a < s + WINDOW and z > s for a, _, z in spans):  # no span cut by the edge
                    texts.append(text[s:s + WINDOW])
                    labels.append(",".join(f"{int(a)}:{k}:{int(z)}" for a, k, z in own))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(labels, pa.string())], names=["window", "labels"])


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS, text_col: str = "text") -> Tagger | None:
    """Train on windows of ``docs`` labelled by the base rules; None if there are none.

    At most ``max_windows`` distinct windows are read, half of them with a span (bounded samples by hash).
    """
    rows = docs.select(text_of(docs, text_col).alias("text")).mapInArrow(_labelled, "window string, labels string")
    rows, half = stage(rows.distinct(), "pii-windows"), max_windows // 2
    got = [r for some in ("labels <> ''", "labels = ''") for r in hash_sample(rows.filter(some), ["window", "labels"], half).collect()]
    if not got:
        return None
    spans = [[tuple(map(int, s.split(":"))) for s in r["labels"].split(",")] if r["labels"] else [] for r in got]
    return train([r["window"] for r in got], spans)


def find_pii(docs: DataFrame, net: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every text: doc_id, base and spans.

    Both are arrays of (start, kind, end) in code points, end exclusive, by start and then kind as
    in KINDS; ``base`` holds the rules' spans, ``spans`` also those that the network adds. Null or
    empty texts have none. Null ids are kept; repeated rows are answered each. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(net.p) if net else None
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:int,kind:string,end:int>>"

    def tag(batches):
        own = Tagger()
        if model:
            own.p = model.value
        for b in batches:
            base, every = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for at, n in slices(b["text"]):
                marked = np.flatnonzero(_marked(b["text"].slice(at, n))) + at
                texts = [b["text"][int(i)].as_py() for i in marked]
                for i, text in zip(marked, texts):
                    base[i] = every[i] = base_spans(text)
                if model and texts:
                    xs = [codes(text) for text in texts]
                    starts = [window_starts(marks_of(x, text)) for x, text in zip(xs, texts)]
                    for i, text, x, s, tags in zip(marked, texts, xs, starts, own.tags(xs, starts)):
                        every[i] = sorted(base[i] + found_spans(text, x, s, tags, base[i]))
            shape = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            cols = [pa.array([[{"start": a, "kind": KINDS[k], "end": z} for a, k, z in s] for s in x], shape) for x in (base, every)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], names=["doc_id", "base", "spans"])

    return rows.mapInArrow(tag, f"doc_id {kind}, base {span}, spans {span}")
