"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of signs. An n-gram vector binds the letters' vectors, each shifted
cyclically by its place (multiplied component by component); a text bundles (adds) the vectors of its
letter trigrams, white space and other signs counting as one boundary symbol. The bundle of all
training texts of a language is its prototype. A text takes the language of the nearest prototype by
cosine. Bundling is linear, so both sides go through trigram counts: prototypes are exact sums over
every training row, and no vector is made per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adloom.llm.rows import bounded, column, per_batch, texts

SYMBOLS = 40  # boundary, a to z, and 13 classes of other letters
DIM = 512
GRAMS = SYMBOLS ** 3
SEED = 10
STEP = 32  # texts counted at a time: bounds the count matrix


def letter_table() -> np.ndarray:
    """Code point of the basic plane -> symbol; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
    return table


def gram_vectors() -> np.ndarray:
    """GRAMS x DIM signs: first letter shifted by two, second by one, third in place, bound by product."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None, None] * second[None, :, None] * letters[None, None]).reshape(GRAMS, DIM)


def symbols(text: bytes, table: np.ndarray) -> np.ndarray:
    """Symbols of a text between two boundaries."""
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), "<u4")
    out = np.zeros(len(points) + 2, np.int32)
    if len(points) and points.max() >= len(table):  # letters beyond the basic plane share the last class
        beyond = points >= len(table)
        wide = np.array([SYMBOLS - 1 if chr(p).isalpha() else 0 for p in points[beyond]], np.int32)
        out[1:-1] = table[np.where(beyond, 0, points)]
        out[1:-1][beyond] = wide
    else:
        out[1:-1] = table[points]
    return out


def grams(text: bytes, table: np.ndarray) -> np.ndarray:
    """Ids of the trigrams around each letter."""
    s = symbols(text, table)
    ids = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return ids[s[1:-1] > 0]


def held_out(folds: int = 5) -> Column:
    """crc32 of the doc_id as text leaves no remainder; null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def profiles(docs: DataFrame, lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, bundled over every given row with a language and a letter.

    Each task adds up its own rows; what reaches the driver is one vector per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = letter_table(), {}
        for batch in batches:
            for name, text in zip(column(batch, lang).to_pylist(), texts(batch)):
                got = sums.setdefault(name, np.zeros(GRAMS, np.int64))
                got += np.bincount(grams(text, table), minlength=GRAMS)
        if sums:
            vectors = gram_vectors().astype(np.float64)
            names = list(sums)
            made = np.stack([sums[n] @ vectors for n in names])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made.tolist(), pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).alias(lang), "text")
    bounded(docs.sparkSession)
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    # sums of whole numbers below 2**53: the same in any order
    found = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).filter(F.col("x") != 0).collect()
    names = sorted({r["lang"] for r in found})
    protos = np.zeros((len(names), DIM))
    at = {n: i for i, n in enumerate(names)}
    for r in found:
        protos[at[r["lang"]], r["k"]] = r["x"]
    return names, protos


def identify(docs: DataFrame, names: list[str], protos: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row.

    The score is the cosine to the chosen prototype, cut at 0; ties go to the smaller name. A null
    text, or one without a letter, is `und` with score 0, and so is every text when nothing was
    learned. Repeated rows each give a row; an empty table gives none; other columns are not looked at.
    """
    norms = np.linalg.norm(protos, axis=1)
    unit = protos / np.where(norms > 0, norms, 1)[:, None] if len(names) else protos

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        table, vectors = letter_table(), gram_vectors()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            preds: list[str] = []
            scores: list[float] = []
            raw = texts(batch)
            for lo in range(0, len(raw), STEP):
                ids = [grams(t, table) for t in raw[lo: lo + STEP]]
                flat = np.concatenate(ids)
                doc = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                counts = np.bincount(doc * GRAMS + flat, minlength=len(ids) * GRAMS).reshape(len(ids), GRAMS)
                used = np.flatnonzero(counts.any(axis=0))
                bundle = counts[:, used].astype(np.float32) @ vectors[used].astype(np.float32)
                length = np.linalg.norm(bundle, axis=1)
                if len(names):
                    cos = (bundle / np.where(length > 0, length, 1)[:, None]) @ unit.T
                    best = cos.argmax(axis=1)
                for k, i in enumerate(ids):
                    known = len(i) > 0 and len(names) > 0
                    preds.append(names[best[k]] if known else "und")
                    scores.append(float(min(1.0, max(0.0, cos[k, best[k]]))) if known else 0.0)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

        return step

    return per_batch(docs.select("doc_id", "text", held_out().alias("held_out")), start,
                     "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn the prototypes from the rows that are not held out, then predict every row."""
    names, protos = profiles(docs.filter(~held_out()))
    return identify(docs, names, protos)
