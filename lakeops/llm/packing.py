"""Packing token sequences by minimum bin slack.

Every document is cut into full sequences and a remainder. Remainders of a window of documents
are packed by minimum bin slack: a bitset (one Python integer, bit i = "total i is reachable")
runs the subset-sum recurrence over the remaining lengths and their counts; the reachable total
closest to the capacity is traced back to the multiset of lengths that makes it.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_of, worker_state

#: Tokens of one window of documents, packed together inside a task.
WINDOW_TOKENS = 2 << 20
#: Distinct chunks of text whose ids a worker remembers.
CACHE_CHUNKS = 150_000

PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves,
    the others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Encoder:
    """Ids of texts under a byte-level BPE tokenizer file (JSON), as little-endian 32-bit bytes.

    Strings of added tokens in a text become their ids, as with the tokenizers library. Other text
    is cut before every white-space run; a token never spans such a cut, so the ids of the
    chunks, remembered by chunk, are the ids of the text.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._added = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte = byte_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self._added}
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._added)
        self._after_space: dict[str, bytes] = {}
        # Two white-space characters in a row, the second a blank: the cut before the blank is not a token's end.
        self._tangled = re.compile(r"\s ")

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self._added):
            return np.asarray(self._bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        if self._tangled.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known, out = self._after_space, [self._ids(first)]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = self._ids(" " + chunk)
                if len(chunk) < 64:
                    if len(known) >= CACHE_CHUNKS:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    known = worker_state().setdefault("encoders", {})
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of ``counts`` (length -> how many) with the largest total up to ``capacity``.

    The longest length always takes part, as in minimum bin slack, so every step makes progress.
    """
    lead = max(counts)
    room = capacity - lead
    mask = (1 << (room + 1)) - 1
    goal = 1 << room
    reach, layers = 1, []
    for length in sorted(counts, reverse=True):
        if reach & goal:
            break
        if length > room:
            continue
        left = counts[length] - (length == lead)
        take, step = 1, []
        while left > 0 and take * length <= room and not reach & goal:  # counts as binary parts
            now = min(take, left)
            step.append((now, reach))
            reach = (reach | reach << now * length) & mask
            left -= now
            take *= 2
        if step:
            layers.append((length, step))
    total = reach.bit_length() - 1
    chosen = [(lead, 1)]
    for length, step in reversed(layers):  # trace back which counts made the total
        used = 0
        for now, before in reversed(step):
            if not before >> total & 1:
                total -= now * length
                used += now
        if used:
            chosen.append((length, used))
    assert total == 0
    return chosen


class _Window:
    def __init__(self, length: int):
        self.length = length
        self.full: list[tuple] = []
        self.rest: dict[int, list[tuple]] = defaultdict(list)
        self.tokens = 0

    def add(self, doc, ids: bytes) -> None:
        n, step = len(ids) // 4, self.length
        for at in range(0, n - n % step, step):
            self.full.append((doc, at, step, n, ids[4 * at:4 * (at + step)]))
        if n % step:
            self.rest[n % step].append((doc, n - n % step, n % step, n, ids[4 * (n - n % step):]))
        self.tokens += n

    def sequences(self):
        for piece in self.full:
            yield [piece]
        counts = {n: len(x) for n, x in self.rest.items()}
        while counts:
            for_bin = []
            for n, used in fill(counts, self.length):
                counts[n] -= used
                if not counts[n]:
                    del counts[n]
                for_bin += [self.rest[n].pop() for _ in range(used)]
            yield for_bin


def _pack(batches, path: str, length: int, end_id: int):
    encode, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    task, made = TaskContext.get().partitionId(), 0
    window = _Window(length)

    def flush():
        nonlocal made, window
        rows = []
        for pieces in window.sequences():
            offset = 0
            for doc, start, n, total, ids in pieces:
                rows.append((doc, start, n, total, (task << 36) + made, offset, ids))
                offset += n
            made += 1
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        window = _Window(length)

    for b in batches:
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
            window.add(doc, encode(text.as_py() or "") + end)
            if window.tokens >= WINDOW_TOKENS:
                yield from flush()
    yield from flush()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's tokens (and an end id) into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset (gapless
    from 0 in its sequence), ids (little-endian 32-bit). Only the last sequences of a window of
    documents can be short. Documents never leave their task: there is no shuffle, and memory is
    bounded by the window.

    A null or empty text is a document of the end id alone. Null ids stay null. Repeated rows are
    packed each by itself. A long text is cut into any number of full sequences. An empty table
    gives no rows; other columns are ignored, whatever their names. ``tokenizer_path`` is the JSON
    file of a byte-level BPE tokenizer; by default the public 50k one next to the installed tokenizers.
    Strings of its added tokens in a text become those tokens' ids.
    """
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    if not os.path.basename(tokenizer_path):
        raise ValueError("tokenizer_path must name a file")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, length, end_id), PIECES)
