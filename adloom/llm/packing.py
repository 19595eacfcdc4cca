"""Packing by sum of squares: each piece goes to the fill level that keeps the level counts flattest.

Every task packs the rows of its own partition, so nothing is shuffled and a retry of the task gives
the same sequences. A document of `length` tokens or more first fills whole sequences; its rest is
one item. Open sequences are known by their fill level alone: counts[h] of them hold h tokens, and an
item of s tokens goes from level h to h + s (h = 0 opens a sequence, h + s = length closes one) where
the sum of squared counts becomes smallest; ties go to the fullest level. When the partition ends,
documents may be cut freely, so the emptiest open sequences fill up the fullest ones and at most one
sequence of a partition stays short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from adloom.llm.rows import bounded, column, texts
from adloom.llm.wordbpe import WordIds, kept

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                              "offset", "sequence_tokens")])

Item = tuple[int | None, int, bytes, int]  # doc_id, first id, packed ids, ids of the document


class Levels:
    """Level array of the open sequences."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[list[Item]]] = [[] for _ in range(length)]

    def choose(self, size: int) -> int:
        """The level whose use makes the sum of squared counts smallest."""
        room = self.length - size
        here, there = self.counts[: room + 1], self.counts[size:]
        gain = np.where(here > 0, there - here, np.iinfo(np.int64).max // 4) * 2 + 2
        gain[0] = 2 * self.counts[size] + 1 if room else 0  # a new sequence leaves no level
        if room and self.counts[room]:
            gain[room] = 1 - 2 * self.counts[room]  # a full sequence is on no level
        return room - int(np.argmin(gain[::-1]))

    def place(self, item: Item) -> list[Item] | None:
        """Put an item in; the content of the sequence if that fills it."""
        size = len(item[2]) // 4
        level = self.choose(size)
        if level:
            self.counts[level] -= 1
            content = self.open[level].pop()
        else:
            content = []
        content.append(item)
        if level + size == self.length:
            return content
        self.counts[level + size] += 1
        self.open[level + size].append(content)
        return None

    def rest(self) -> Iterator[list[Item]]:
        """Merge what is open, cutting items: all sequences but the last come out full."""
        left = [c for level in range(self.length - 1, 0, -1) for c in self.open[level]]  # fullest first
        fill = [sum(len(i[2]) // 4 for i in c) for c in left]
        lo, hi = 0, len(left) - 1
        while lo < hi:
            room = self.length - fill[lo]
            doc, start, ids, total = left[hi].pop()
            take = min(room, len(ids) // 4)
            left[lo].append((doc, start, ids[: 4 * take], total))
            if 4 * take < len(ids):
                left[hi].append((doc, start + take, ids[4 * take:], total))
            fill[lo] += take
            fill[hi] -= take
            if fill[lo] == self.length:
                yield left[lo]
                lo += 1
            if not fill[hi]:
                hi -= 1
        if lo == hi:
            yield left[lo]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A null or empty text is the end id alone; a null doc_id is carried; repeated rows are packed each;
    an empty table gives no piece; other columns are not looked at. Sequences are meant to be padded
    to `length`.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels = kept(WordIds, tokenizer), Levels(length)
        base = TaskContext.get().partitionId() << 36
        made = 0
        rows: list[tuple] = []

        def write(content: list[Item]) -> None:
            nonlocal made
            total = sum(len(i[2]) for i in content) // 4
            at = 0
            for doc, start, ids, n in content:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, base + made, at, total))
                at += len(ids) // 4
            made += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(_ARROW)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts(batch)):
                ids = words.encode(text) + end
                n = len(ids) // 4
                whole = n - n % length
                for start in range(0, whole, length):
                    write([(doc, start, ids[4 * start: 4 * (start + length)], n)])
                if whole < n:
                    full = levels.place((doc, whole, ids[4 * whole:], n))
                    if full:
                        write(full)
            if rows:
                yield flush()
        for content in levels.rest():
            write(content)
        if rows:
            yield flush()

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
