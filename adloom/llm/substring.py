"""Substring dedup by relative Lempel-Ziv factors.

The corpus itself is the reference, cut into blocks of text that are all indexed. A document whose words
all repeat a smaller document is one factor, and only the first such document goes on: of every window of
`window` words the index holds its minimizer, the smallest hash of the short word sequences in it. Equal
windows have equal minimizers, so a window can only repeat in another document if its minimizer does
(the index, partitioned by hash, says which do). Such windows are looked up by a 96-bit hash: the
reference is the smallest document that holds the window. A greedy parse joins consecutive looked-up
windows with one reference into factors of at least `window` words. Windows over a factor boundary are
looked up like all others, so nothing is lost where two factors meet. Repeats inside one document are
found in its own text. Words under a window that starts earlier in the corpus are the duplicate spans.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from adloom.llm.hashes import sequences, sliding_min, word_hashes
from adloom.llm.rows import column, per_batch, texts
from adloom.llm.work import Steps

SEED_WORDS = 8


def minimizers(h: np.ndarray, window: int, seed_words: int) -> np.ndarray:
    """The smallest seed hash of each window."""
    seeds = sequences(h, seed_words)
    width = window - seed_words + 1
    return sliding_min(seeds, width) if len(seeds) >= width else np.zeros(0, np.uint64)


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys stand in several documents, with the smallest of these as `ref_doc`.

    Minimum and maximum are combined before the shuffle, and the join splits a key that holds many
    rows, so no task gets a hot key whole. The hint keeps a table that grows with the corpus from being
    broadcast where it happens to be small.
    """
    ends = rows.groupBy(*keys).agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("_last"))
    return rows.join(ends.filter("ref_doc < _last").drop("_last").hint("merge"), keys)


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """Digest of the words, their number, and the distinct minimizers of each document."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, digests, counts = [], [], []
            for text in texts(batch):
                words = text.split()
                counts.append(len(words))
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                found.append(np.unique(minimizers(word_hashes(words), window, SEED_WORDS)))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "fp"), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).view(np.int64)))], ["doc_id", "fp", "digest", "words", "seeds"])

        return step

    return per_batch(_rows(docs), start, "doc_id long, fp long, digest binary, words int, seeds array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and fp, the row's fingerprint: rows with one doc_id and other texts keep their own factors."""
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", fingerprint(F.col("text")).alias("fp"))


def fingerprint(text: Column) -> Column:
    """64 bits: it only tells apart rows of one doc_id, and it travels with every looked-up window."""
    return F.xxhash64(text)


def _copies(seeded: DataFrame, window: int) -> DataFrame:
    """doc_id, words, ref_doc of documents whose words all stand in the same order in a smaller document:
    each of their windows starts earlier."""
    rows = seeded.filter(F.col("words") >= window).select("doc_id", "fp", "digest", "words")
    return _shared(rows, ["digest", "words"]).filter("doc_id > ref_doc").select("doc_id", "fp", "words", "ref_doc").distinct()


def _windows(marked: DataFrame, window: int) -> DataFrame:
    """First start in its document of each window whose minimizer is in several documents."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, checks, starts, ids, fps = [], [], [], [], []
            for doc, fp, text, seeds in zip(column(batch, "doc_id").to_pylist(), column(batch, "fp").to_pylist(), texts(batch),
                                            column(batch, "seeds")):
                h = word_hashes(text.split())
                known = np.isin(minimizers(h, window, SEED_WORDS), np.asarray(seeds.values).view(np.uint64))
                at = np.flatnonzero(known)
                key = sequences(h, window)[at]
                key, first = np.unique(key, return_index=True)
                at = at[first]
                keys.append(key.view(np.int64))
                checks.append((sequences(h, window, 1)[at] >> np.uint64(33)).astype(np.int32))
                starts.append(at.astype(np.int32))
                ids.append(np.full(len(at), doc, np.int64))
                fps.append(np.full(len(at), fp, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, checks, ids, starts, fps)],
                                              ["key", "check", "doc_id", "start", "fp"])

        return step

    return per_batch(marked.select("doc_id", "fp", "text", "seeds"), start, "key long, check int, doc_id long, start int, fp long")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def inner_repeats(h: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that equal one that starts earlier in the same text."""
    key = sequences(h, window)
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return np.flatnonzero(later)


def factors(starts: np.ndarray, refs: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy parse of looked-up windows: (start, words, reference) of maximal runs with one reference."""
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(refs) != 0)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b] - starts[a]) + window, int(refs[a])) for a, b in zip(lo, hi)]


def duplicate_factors(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, fp (the row's text fingerprint) and `found`: array of (start, words, ref_doc), the factors of a
    row that stand in a document with a smaller id. Rows without one give no row."""
    steps = Steps(docs.sparkSession, "substring")
    seeded = steps.write(_seeds(docs, window))
    copies = steps.write(_copies(seeded, window))
    seeds = steps.write(seeded.select("doc_id", "fp", "seeds").join(copies.select("doc_id", "fp").hint("merge"), ["doc_id", "fp"], "left_anti")
                        .select(F.explode("seeds").alias("seed"), "doc_id"))
    steps.drop(seeded)
    marks = steps.write(_shared(seeds, ["seed"]).groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")))
    steps.drop(seeds)
    windows = steps.write(_windows(_rows(docs).join(marks.hint("merge"), "doc_id"), window))
    steps.drop(marks)
    hits = _shared(windows, ["key", "check"]).filter("doc_id > ref_doc").select("doc_id", "fp", "start", "ref_doc")
    grouped = hits.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set(F.struct("start", "ref_doc"))).alias("hits"))

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64())]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for hits in column(batch, "hits"):
                at, ref = (np.asarray(hits.values.field(k)) for k in ("start", "ref_doc"))
                out.append([{"start": a, "words": n, "ref_doc": r} for a, n, r in factors(at, ref, window)])
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "fp"), pa.array(out, kind)], ["doc_id", "fp", "found"])

        return step

    parts = per_batch(grouped, start, "doc_id long, fp long, found array<struct<start:int,words:int,ref_doc:long>>")
    whole = copies.select("doc_id", "fp", F.array(F.struct(F.lit(0).alias("start"), "words", "ref_doc")).alias("found"))
    found = steps.write(parts.union(whole))
    steps.drop(windows)
    return found


def _cut(text: bytes, found: list[dict] | None, judged: bool, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that stay."""
    words = text.split()
    if not judged or len(words) < window:
        return len(words), words
    gone = np.zeros(len(words), bool)
    for f in found or ():
        gone[f["start"]: f["start"] + f["words"]] = True
    inside = inner_repeats(word_hashes(words), window)
    if len(inside):
        gone |= covered(len(words), inside, window)
    return len(words), list(compress(words, ~gone)) if gone.any() else words


def _with_factors(docs: DataFrame, window: int) -> DataFrame:
    rows = docs.select("doc_id", "text", fingerprint(F.col("text")).alias("fp"))
    return rows.join(duplicate_factors(docs, window).hint("merge"), ["doc_id", "fp"], "left")


def dedup_digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row.

    A null or empty text has no words and the digest of nothing. Rows with one doc_id are one document:
    they do not remove each other's words, and each keeps the factors of its own text. A null doc_id has no place in the order: such a row keeps
    all its words and removes none elsewhere. An empty table gives no row; other columns are not looked at.
    """

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, removed, digest = [], [], []
            for doc, text, found in zip(column(batch, "doc_id").to_pylist(), texts(batch), column(batch, "found").to_pylist()):
                n, kept = _cut(text, found, doc is not None, window)
                total.append(n)
                removed.append(n - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return step

    return per_batch(_with_factors(docs, window), start, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, window: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, with duplicate spans cut from `text`: a text that loses
    words becomes its other words joined by single spaces, all other texts stay as they are (null too).
    Internal columns get names that no column of docs has.
    """
    names = docs.columns
    tag = uuid.uuid4().hex[:12]
    doc_c, fp_c, row_c, found_c = (f"_{k}_{tag}" for k in ("doc", "fp", "row", "found"))

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        at = names.index("text")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc, text, found in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), column(batch, found_c).to_pylist()):
                n, kept = _cut((text or "").encode(), found, doc is not None, window)
                out.append(text if len(kept) == n else b" ".join(kept).decode())
            cols = [batch.column(k) for k in range(len(names))]
            cols[at] = pa.array(out, pa.string())
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    found = duplicate_factors(docs, window).select(F.col("doc_id").alias(doc_c), F.col("fp").alias(fp_c), F.col("found").alias(found_c))
    keyed = docs.select("*", fingerprint(F.col("text")).alias(row_c))
    joined = keyed.join(found.hint("merge"), (F.col("doc_id") == F.col(doc_c)) & (F.col(row_c) == F.col(fp_c)), "left")
    return per_batch(joined.drop(doc_c, fp_c, row_c), start, docs.schema)
