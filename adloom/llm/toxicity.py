"""Classifier chain: label categories are predicted one after the other, each seeing the earlier ones.

Model k is a linear classifier over the words of a text and over the probabilities of models 1 to
k - 1. When it is fitted, those probabilities come from models that did not see the row (out of fold),
so it learns how far they can be trusted. A corpus has more words than labelled rows, so a model uses only
words whose effect stands out from chance (lasso) and weighs those anew. The models are fitted on a bounded
sample of labelled rows; scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adloom.llm.rows import column, per_batch, texts
from adloom.llm.work import Steps

SAMPLE = 8_000  # labelled rows used for fitting; what reaches the driver is bounded by it
SPACE = 1 << 20  # hashed words
MIN_DOCS = 6  # sampled documents a word must be in
FOLDS = 3
CHANCE = 3.0  # standard deviations by which a word's pull on the fit must exceed chance
MEMO_ENTRIES = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: bytes) -> tuple[int, ...]:
    """Hashed letter runs of a white-space word, in lower case."""
    return tuple(zlib.crc32(w.encode()) % SPACE for w in _LETTERS.findall(word.decode("utf-8").lower()))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Rows:
    """Sampled rows: distinct word columns of each, row by row."""

    cols: np.ndarray
    rows: np.ndarray
    size: int
    width: int

    def pick(self, chosen: np.ndarray) -> Rows:
        at = np.full(self.size, -1)
        at[chosen] = np.arange(len(chosen))
        keep = at[self.rows] >= 0
        return Rows(self.cols[keep], at[self.rows[keep]], len(chosen), self.width)

    def only(self, words: np.ndarray) -> Rows:
        at = np.full(self.width, -1)
        at[words] = np.arange(len(words))
        keep = at[self.cols] >= 0
        return Rows(at[self.cols[keep]], self.rows[keep], self.size, len(words))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.size)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, r[self.rows], self.width)


@dataclass
class Linear:
    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return _logistic(x.dot(self.words) + earlier @ self.earlier + self.bias)


def telling(x: Rows, earlier: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Columns of the words a lasso over standardised words keeps; earlier probabilities and the bias are not
    penalised. Accelerated proximal gradients, restarted where the momentum turns against the step."""
    n, k = x.size, x.width
    if not k or not 0 < y.sum() < n:
        return np.zeros(0, np.int64)
    share = y.mean()
    mean = x.back(np.ones(n)) / n
    scale = np.sqrt(mean * (1 - mean))
    scale = np.divide(1, scale, out=np.zeros(k), where=scale > 1e-9)
    e = earlier - earlier.mean(axis=0)
    e = e / np.maximum(e.std(axis=0), 1e-9)

    def out(w: np.ndarray) -> np.ndarray:
        words = w[:k] * scale
        return x.dot(words) - mean @ words + e @ w[k:-1] + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([scale * (x.back(r) - mean * r.sum()), e.T @ r, [r.sum()]])

    # by chance a word's gradient has this standard deviation
    limit = np.concatenate([np.full(k, CHANCE * np.sqrt(share * (1 - share) / n)), np.zeros(e.shape[1] + 1)])
    v = np.random.default_rng(7).normal(size=len(limit))
    for _ in range(20):
        v = back(out(v)) / n
        steepest = np.linalg.norm(v)
        v /= steepest
    step = 1 / (0.3 * steepest)  # curvature is at most a quarter of it; some room as the estimate is from below
    w = np.zeros(len(limit))
    w[-1] = np.log(share / (1 - share))
    ahead, t = w, 1.0
    for _ in range(rounds):
        now = ahead - step * back(_logistic(out(ahead)) - y) / n
        now = np.sign(now) * np.maximum(np.abs(now) - step * limit, 0)
        t_now = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (ahead - now) @ (now - w) > 0:
            t_now = t = 1.0
        ahead = now + (t - 1) / t_now * (now - w)
        w, t = now, t_now
    return np.flatnonzero(w[:k])


def fit_linear(x: Rows, earlier: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 0.1, rate: float = 0.5) -> Linear:
    """Logistic regression over the telling words with squared penalty, weighed against the sum over all rows;
    full gradients with per-weight step sizes. Other words weigh zero.

    The penalty is small, since words are chosen before: a rare telling word keeps its weight.
    """
    if not x.size:
        return Linear(np.zeros(x.width), np.zeros(earlier.shape[1]), 0.0)
    words = telling(x, earlier, y)
    x, width = x.only(words), x.width
    m = Linear(np.zeros(x.width), np.zeros(earlier.shape[1]), 0.0)
    decay = penalty / x.size
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    sw, se, sb = np.full(x.width, 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        r = (m.probability(x, earlier) - y) / x.size
        gw, ge, gb = x.back(r) + decay * m.words, earlier.T @ r + decay * m.earlier, r.sum()
        sw += gw ** 2
        se += ge ** 2
        sb += gb ** 2
        m.words -= rate * gw / np.sqrt(sw)
        m.earlier -= rate * ge / np.sqrt(se)
        m.bias -= rate * gb / np.sqrt(sb)
    weights = np.zeros(width)
    weights[words] = m.words
    m.words = weights
    return m


@dataclass
class Chain:
    names: tuple[str, ...]
    columns: np.ndarray  # hashed word of each weight
    models: list[Linear]

    def probabilities(self, x: Rows) -> np.ndarray:
        out = np.zeros((x.size, 0))
        for m in self.models:
            out = np.column_stack([out, m.probability(x, out)])
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]], sample: int = SAMPLE) -> Chain | None:
    """Fit the chain in the order of `categories`: (name, SQL condition over labels).

    The rows come from the labels with the smallest hash of their id, `sample` of them at most; labels
    with a null id or a null category are left out, and of repeated labels of an id one is used (the largest
    flag). Of repeated documents of an id, the smallest text is fitted. Every word of a fitted text counts;
    words in fewer than MIN_DOCS fitted texts are dropped in Spark (hashed words are at most SPACE), so the
    driver receives only columns that are fitted. No labelled row with a text: None (nothing to fit).
    """
    flags = [f"_y{k}" for k in range(len(categories))]
    known = labels.select("doc_id", *[F.expr(sql).cast("int").alias(y) for y, (_, sql) in zip(flags, categories)]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in flags])
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted({f for w in set(t.split()) for f in features(w)}) for t in texts(batch)]
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(found, pa.list_(pa.int32())), *[column(batch, y) for y in flags]],
                ["doc_id", "words", *flags])

        return step

    # the sample is bounded by its parameter, so it may be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = Steps(docs.sparkSession, "toxicity").write(per_batch(rows, start, "doc_id long, words array<int>, " + ", ".join(f"{y} int" for y in flags)))
    # document frequency of every hashed word in Spark; only words of MIN_DOCS fitted texts travel on
    often = (rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("_d"))
             .where(F.col("_d") >= MIN_DOCS).select("w"))
    kept = rows.select("doc_id", F.explode_outer("words").alias("w"), *flags).join(F.broadcast(often), "w", "left_semi")
    kept = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("w")).alias("words"))
    rows = rows.drop("words").join(kept, "doc_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<int>")))
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])
    if not got:
        return None
    names = tuple(n for n, _ in categories)
    y = np.array([[r[f] for f in flags] for r in got], float).reshape(len(got), len(names))
    flat = np.array([w for r in got for w in r["words"]], np.int64)
    used, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    frequent = count >= MIN_DOCS
    rank = np.cumsum(frequent) - 1
    row = np.repeat(np.arange(len(got)), [len(r["words"]) for r in got]).astype(np.int64)
    keep = frequent[inverse] if len(flat) else np.zeros(0, bool)
    x = Rows(rank[inverse[keep]] if len(flat) else flat, row[keep], len(got), int(frequent.sum()))
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in got], np.int64)
    earlier = np.zeros((len(got), 0))
    models = []
    for k in range(len(names)):
        models.append(fit_linear(x, earlier, y[:, k]))
        if k + 1 < len(names):
            unseen = np.zeros(len(got))
            for f in range(FOLDS):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = fit_linear(x.pick(inside), earlier[inside], y[inside, k])
                unseen[outside] = part.probability(x.pick(outside), earlier[outside])
            earlier = np.column_stack([earlier, unseen])
    weighed = np.any([m.words != 0 for m in models], axis=0)
    for m in models:
        m.words = m.words[weighed]
    return Chain(names, used[frequent][weighed], models)


class Columns(dict):
    """White-space word -> weight columns of its letter runs."""

    def __init__(self, hashed: np.ndarray):
        super().__init__()
        self.at = {int(h): k for k, h in enumerate(hashed)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        out = tuple(self.at[f] for f in features(word) if f in self.at)
        if len(word) <= 48:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = out
        return out


def _judge(chain: Chain) -> Callable[[list[bytes]], np.ndarray]:
    """Texts -> probabilities, a column per category."""
    known = Columns(chain.columns)

    def judge(raw: list[bytes]) -> np.ndarray:
        found = [sorted(set().union(*map(known.__getitem__, set(t.split())))) for t in raw]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64)
        cols = np.array([c for f in found for c in f], np.int64)
        return chain.probabilities(Rows(cols, rows, len(found), len(chain.columns)))

    return judge


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> (0 to 1) per row.

    A null or empty text is scored by the biases alone; a null doc_id is carried; repeated rows each
    give a row; an empty table gives none; other columns are not looked at.
    """
    names = [f"p_{n}" for n in chain.names]

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        judge = _judge(chain)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = judge(texts(batch))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[pa.array(p[:, k]) for k in range(len(names))]], ["doc_id", *names])

        return step

    return per_batch(docs.select("doc_id", "text"), start, "doc_id long, " + ", ".join(f"{n} double" for n in names))


#: The chain over the given labels: poor text first, since it helps to judge the rest.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic (p_toxic >= threshold) per row of docs. Without any labelled
    document nothing is fitted: probabilities are null and no row is toxic."""
    chain = fit(docs, labels, CATEGORIES, sample)
    if chain is None:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{n}") for n, _ in CATEGORIES], F.lit(False).alias("toxic"))
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose toxic probability stays below the threshold; all rows
    when there is no labelled document to fit on."""
    chain = fit(docs, labels, CATEGORIES, sample)
    if chain is None:
        return docs

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        judge = _judge(chain)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(judge(texts(batch))[:, -1] < threshold))

        return step

    return per_batch(docs, start, docs.schema)
