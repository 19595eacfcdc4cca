"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts every text where the hash says so, hence equal passages
are cut alike in all documents. A chunk met before is not encoded again: its ids come from a memo of
bounded size that lives as long as the Python worker. A cut may fall inside a word, so what the memo
holds is the part of a chunk between its first and last white space, and its two open ends. At each
join the ends are put together and encoded anew; the window grows over further chunks until both of
its edges stand at white space, where the ids left and right provably agree with those of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adloom.llm.rows import column, per_batch, texts
from adloom.llm.wordbpe import WordIds, kept, load

WINDOW = 32  # bytes the rolling hash sees
MEMO_BYTES = 64 << 20  # chunks and ids a worker keeps

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, mask: int) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW bytes has its masked bits clear."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:  # the sum over twice as many bytes from two sums side by side
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return np.flatnonzero((h & np.uint32(mask)) == 0) + 1


def chunked(raw: list[bytes], bits: int) -> list[list[bytes]]:
    """Chunks of each text; about 2**bits bytes each. Where a text is cut depends on its content alone."""
    joined = b"".join(raw)
    mask = ((1 << bits) - 1) << (32 - bits)
    cuts = cut_points(np.frombuffer(joined, np.uint8), mask) if joined else np.zeros(0, np.int64)
    ends = np.cumsum([len(t) for t in raw])
    out = []
    lo = 0
    for t, end in zip(raw, ends):
        hi = np.searchsorted(cuts, end, "left")
        begin = int(end) - len(t)
        own = [begin] + [int(c) for c in cuts[lo:hi] if c >= begin + WINDOW] + [int(end)]
        lo = hi
        out.append([joined[a:b] for a, b in zip(own, own[1:])] if t else [])
    return out


class ChunkIds:
    """Ids of texts from memoised chunks with repaired joins."""

    def __init__(self, path: str, bits: int = 9, memo_bytes: int = MEMO_BYTES):
        self.words = WordIds(path)
        self.bits, self.memo_bytes = bits, memo_bytes
        self.memo: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.kept = self.reused = self.encoded = 0

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        """(open start, ids between the first and the last white space, open end); None where a
        chunk has no white space."""
        found = self.memo.get(chunk)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        inner = chunk.split()
        if not inner or len(inner) == 1 and len(inner[0]) == len(chunk):
            got = (chunk, None, b"") if inner else (b"", b"", b"")
        else:
            head = b"" if chunk[:1].isspace() else inner.pop(0)
            tail = b"" if chunk[-1:].isspace() else inner.pop()
            got = (head, b"".join(map(self.words.words.__getitem__, inner)), tail)
        size = len(chunk) + len(got[1] or b"")
        if self.kept + size > self.memo_bytes:
            self.memo.clear()
            self.kept = 0
        self.memo[chunk] = got
        self.kept += size
        return got

    def encode(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        words = self.words.words
        out = []
        for chunks in chunked(raw, self.bits):
            ids: list[bytes] = []
            window: list[bytes] = []
            for chunk in chunks:
                head, body, tail = self._chunk(chunk)
                window.append(head)
                if body is None:  # no white space yet: the window stays open
                    continue
                word = b"".join(window)
                if word:
                    ids.append(words[word])
                ids.append(body)
                window = [tail]
            word = b"".join(window)
            if word:
                ids.append(words[word])
            out.append(b"".join(ids))
        return out


class Decoder:
    """Ids -> text as the library gives it for a vocabulary without a decoder: strings joined by a space."""

    def __init__(self, tok):
        if tok.decoder is not None:
            raise ValueError("this vocabulary has a decoder of its own")
        size = tok.get_vocab_size(with_added_tokens=True)
        self.table = pa.array([(tok.id_to_token(i) + " ").encode() for i in range(size)], pa.large_binary())

    def decode(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), "<u4")
        taken = self.table.take(pa.array(ids.astype(np.int64)))
        bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
        if not len(ids):
            return [b""] * len(packed)
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:][: len(ids) + 1]
        data = memoryview(taken.buffers()[2])
        at = offsets[bounds]
        return [bytes(data[a:b - 1]) if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def encode(docs: DataFrame, tokenizer: str, bits: int = 9) -> DataFrame:
    """doc_id and ids (array of int) per row; null and empty texts have no ids."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = kept(ChunkIds, tokenizer, bits)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = coder.encode(texts(batch))
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "ids"])

        return step

    return per_batch(docs.select("doc_id", "text"), start, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text per row of (doc_id, ids); null ids give an empty text."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        decoder = Decoder(load(tokenizer))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [np.array(x or [], "<u4").tobytes() for x in column(batch, "ids").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([t.decode("utf-8") for t in decoder.decode(packed)], pa.string())], ["doc_id", "text"])

        return step

    return per_batch(coded.select("doc_id", "ids"), start, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, bits: int = 9) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, from one encode and decode of each text.

    Null and empty texts have no ids and the digests of nothing; repeated rows each give a row; an
    empty table gives none; other columns are not looked at. One narrow pass without a shuffle.
    """

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = kept(ChunkIds, tokenizer, bits)
        decoder = Decoder(coder.words.tok)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = coder.encode(texts(batch))
            back = decoder.decode(packed)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()),
                 pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                 pa.array([hashlib.sha256(t).hexdigest() for t in back])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return per_batch(docs.select("doc_id", "text"), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
