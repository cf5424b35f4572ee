"""SentencePiece encoding and decoding over a table of distinct chunks.

SentencePiece marks blanks as U+2581. Where no piece of the model has a mark behind another
character, no piece crosses from one marked word into the next, so a text's ids are those of
its marked words, one after another. A task cuts a block of texts into marked words, keeps the
distinct ones as a table (Arrow's dictionary encoding), segments each of them once, and joins the
ids back by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import flat, ranges, raw_bytes, rebatch, text_of, worker_state

MARK = "▁"
#: Bytes of text whose distinct marked words make one table.
BLOCK_BYTES = 16 << 20
#: Ids decoded by one call.
DECODE_IDS = 200_000

#: Texts that show what a model's normaliser does; each must come back marked, and otherwise as it is.
_PROBES = ("a", " a", "a  b ", "  ", "\t\n\r\x0b", "Å Å", "ﬁ ①", "　 ​﻿", "Ａ가", "\x00\x7f")


class Model:
    """A SentencePiece model and whether marked words can be segmented by themselves."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        apart = all(MARK not in p.lstrip(MARK) for p in pieces)
        plain = all(self.lib.normalize(t) == MARK + t.replace(" ", MARK) for t in _PROBES)
        self.by_word = apart and plain
        # Before an empty text the model puts no mark; the ids of "a " end with those of a lone one.
        self._lone = self.lib.encode("a ")[len(self.lib.encode("a")):]

    def words(self, marked: list[str]) -> list[list[int]]:
        """Ids of marked words (each begins with a mark, which the model itself puts before a text)."""
        out = self.lib.encode([w[1:] for w in marked], num_threads=1)
        return [x if w != " " else self._lone for w, x in zip(marked, out)]


def model(path: str) -> Model:
    """One model per worker process and file."""
    known = worker_state().setdefault("pieces", {})
    if path not in known:
        known[path] = Model(path)
    return known[path]


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The marked words of all rows, and how many each row has (an empty text has none).

    A marked word is a run of marks and the characters up to the next mark; a text is marked at
    its beginning and for every blank, and marks at its end are a word by themselves. Marks are
    given as blanks.
    """
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
    first = pa.array(np.where(np.asarray(pc.not_equal(texts, "")), " ", "")).cast(pa.large_string())
    data, ends = raw_bytes(pc.binary_join_element_wise(first, texts, pa.scalar("", pa.large_string())))
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    heads = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    begins[heads] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def encode_block(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids of all rows, how many each row has, and each row's ids as comma-joined decimals."""
    if m.by_word:
        words, per_row = marked_words(texts)
    else:  # pieces may cross words: whole texts are the chunks
        words, per_row = pc.fill_null(texts, ""), np.ones(len(texts), np.int64)
    table = words.dictionary_encode()  # the distinct-chunk table
    distinct, codes = table.dictionary.to_pylist(), np.asarray(table.indices).astype(np.int64)
    ids = m.words(distinct) if m.by_word else m.lib.encode(distinct, num_threads=1)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    pool = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
    spelled = pa.array([",".join(map(str, x)) for x in ids], pa.large_string())
    # Joined back by position.
    n = sizes[codes]
    starts = (np.cumsum(sizes) - sizes)[codes]
    flat_ids = pool[np.repeat(starts, n) + ranges(n)]
    row_ends = np.concatenate([[0], np.cumsum(per_row)])
    run = np.concatenate([[0], np.cumsum(n)])
    counts = run[row_ends[1:]] - run[row_ends[:-1]]
    real = n > 0  # a chunk without ids leaves no comma
    kept_ends = np.concatenate([[0], np.cumsum(real)])[row_ends]
    lists = pa.ListArray.from_arrays(pa.array(kept_ends, pa.int32()), spelled.take(pa.array(codes[real])))
    return flat_ids, counts, pc.binary_join(lists, pa.scalar(",", pa.large_string()))


def _encoded(batches, path: str, with_ids: bool):
    m = model(path)
    for t in rebatch(batches, "text", BLOCK_BYTES):
        ids, counts, spelled = encode_block(m, flat(t["text"]))
        digests = [hashlib.sha256(memoryview(s.as_buffer()) if len(s.as_buffer()) else b"").hexdigest() for s in spelled]
        ends = np.concatenate([[0], np.cumsum(counts)])
        decoded, at = [], 0
        while at < len(counts):  # a few rows at a time: the library wants Python lists
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODE_IDS, side="right")) - 1)
            decoded += m.lib.decode([ids[ends[i]:ends[i + 1]].tolist() for i in range(at, to)], num_threads=1)
            at = to
        out = {"doc_id": flat(t["doc_id"]), "n_tokens": pa.array(counts), "ids_sha256": pa.array(digests, pa.string()),
               "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            out["decoded"] = pa.array(decoded, pa.string())
        yield from pa.table(out).to_batches(max_chunksize=2000)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_pieces(docs: DataFrame, model_path: str | None = None, with_ids: bool = True,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's SentencePiece ids and the text that they decode to.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 and, with
    ``with_ids``, ids (array) and decoded. Ids are those of the library's ``encode`` without begin or
    end ids. There is no shuffle; a table of distinct chunks serves some 16 MB of text in a task, and
    a longer text gets one for itself.

    A null or empty text has no ids and decodes to nothing. Null ids stay null, and repeated rows are
    each answered. An empty table gives no rows; other columns are ignored, whatever their names.
    A model whose pieces can cross blanks, or whose normaliser changes texts, is applied to distinct
    whole texts. By default the model is the public 32k one next to the installed tokenizers.
    """
    if model_path is None:
        import public_tokenizers
        model_path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    schema = DIGESTS + (", ids array<int>, decoded string" if with_ids else "")
    return rows.mapInArrow(lambda it: _encoded(it, model_path, with_ids), schema)


def _decoded(batches, path: str):
    m = model(path)
    for b in batches:
        texts = [m.lib.decode(x) if x else "" for x in b["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_pieces(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with an array of ids; null or empty arrays give an empty text."""
    if model_path is None:
        import public_tokenizers
        model_path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _decoded(it, model_path), "doc_id long, text string")
