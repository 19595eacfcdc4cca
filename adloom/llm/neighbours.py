"""Approximate nearest neighbours with balanced posting lists.

Vectors are clustered; each cluster is a posting list. Centroids come from k-means on a bounded sample
with a penalty on crowded clusters, so that lists stay balanced. A vector near a boundary is replicated
to further clusters whose distance is within a ratio of the nearest one, unless a chosen centroid is
closer to that centroid than the vector is. A query walks a neighbour graph over the centroids, held in
memory by every task, and reads those lists whose centroid lies within a ratio of the closest distance up
to which the lists own k + 1 vectors. A vector is owned by its nearest list alone, so that many are distinct.
A list costs each of its readers rows, so lists are made coarser until queries read about `READS`; clustered
vectors keep fine lists. Scores of a block come from one matrix product; those that can be among the k best
are computed again in one order of summing.

Largest inner product becomes smallest distance by one more component: sqrt(M^2 - |x|^2), M the largest
norm; 0 for queries. Of equal vectors only the `k + 1` smallest ids can be in any answer, so the others
are not put into lists; they still query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adloom.llm.rows import column, per_batch
from adloom.llm.work import Steps

SAMPLE = 20_000  # vectors that fit the centroids
LIST = 128  # vectors of a list aimed at
CENTROIDS = 4_096  # at most; broadcast to every task, so 4096 x (dim + 1) floats bound it; longer lists are split
REPLICAS = 6
CLOSE = 1.25  # distance ratio of replicas
DEGREE = 16  # links of a centroid
BEAM = 96  # centroids a walk keeps at least, besides all it meets within PRUNE
PRUNE = 1.45  # distance ratio of lists a query reads
READS = 64  # lists a query may read on average before lists are made coarser
TRIAL = 128  # sampled vectors whose reads are counted for that
BLOCK = 8_192  # vectors of a list in one call
QUERIES = 4_096  # queries of a list in one call
SCORED = 256  # of them in one matrix product
PAIRS = 65_536  # pairs scored again at once


@dataclass
class Lists:
    centroids: np.ndarray
    links: np.ndarray
    top: float  # largest norm

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top ** 2 - (x ** 2).sum(axis=1), 0))
        return np.column_stack([x, extra])

    def walk(self, q: np.ndarray, beam: int = BEAM) -> list[tuple[float, int]]:
        """(distance, centroid) found from a fixed entry by best-first search, nearest first; `beam` of them, or
        more where more lie within PRUNE of the nearest."""
        beam = min(beam, len(self.centroids))
        seen = {0}
        d0 = float(np.linalg.norm(q - self.centroids[0]))
        todo, kept, best = [(d0, 0)], [(-d0, 0)], d0
        while todo:
            d, c = heapq.heappop(todo)
            if len(kept) >= beam and d > -kept[0][0]:
                break
            new = [n for n in self.links[c].tolist() if n not in seen]
            if not new:
                continue
            seen.update(new)
            for dist, n in zip(np.linalg.norm(self.centroids[new] - q, axis=1).tolist(), new):
                best = min(best, dist)
                if len(kept) < beam or dist < -kept[0][0] or dist <= PRUNE * best:
                    heapq.heappush(todo, (dist, n))
                    heapq.heappush(kept, (-dist, n))
                    while len(kept) > beam and -kept[0][0] > PRUNE * best:
                        heapq.heappop(kept)
        return sorted((-d, c) for d, c in kept)

    def read(self, q: np.ndarray, owned: np.ndarray, need: int) -> list[int]:
        """Lists a lifted query reads: up to PRUNE times the distance within which lists own `need` vectors.

        Where the walk ends short of that distance, all centroids are compared.
        """
        found = self.walk(q)
        dist, order = np.array([d for d, _ in found]), np.array([c for _, c in found])
        sums = owned[order].cumsum()
        if len(order) < len(self.centroids) and (sums[-1] < need or dist[-1] < PRUNE * dist[np.searchsorted(sums, need)]):
            dist = np.linalg.norm(self.centroids - q, axis=1)
            order = np.argsort(dist, kind="stable")
            dist, sums = dist[order], owned[order].cumsum()
        reach = dist[min(int(np.searchsorted(sums, need)), len(dist) - 1)]
        return order[dist <= PRUNE * reach + 1e-12].tolist()

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        """Clusters each lifted vector is put into, the nearest first."""
        gaps = np.linalg.norm(self.centroids[:, None] - self.centroids[None], axis=2) if len(self.centroids) <= 512 else None
        dist = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids ** 2).sum(1)[None], 0))
        out = []
        near = np.argsort(dist, axis=1, kind="stable")[:, : 4 * REPLICAS]
        for row, order in zip(dist, near):
            chosen = [int(order[0])]
            for c in order[1:].tolist():
                if len(chosen) == REPLICAS or row[c] > CLOSE * row[order[0]] + 1e-12:
                    break
                between = gaps[c, chosen] if gaps is not None else np.linalg.norm(self.centroids[chosen] - self.centroids[c], axis=1)
                if (between >= 0.75 * row[c]).all():
                    chosen.append(c)
            out.append(chosen)
        return out


def fit_lists(sample: np.ndarray, count: int, top: float, wanted: int | None = None) -> Lists:
    """Centroids of about `wanted` (else count / LIST) balanced clusters of distinct vectors, and their graph."""
    lists = Lists(np.zeros((0, 0)), np.zeros((0, 0), int), top)
    x = lists.lift(sample, False)
    k = max(1, min(CENTROIDS, wanted or math.ceil(count / LIST), len(x)))
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    spread = float(x.var(axis=0).sum())
    sizes = np.full(k, len(x) / k)
    for _ in range(8):
        d = (x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1)[None]
        d += 0.15 * spread * (sizes / (len(x) / k) - 1)  # crowded clusters seem farther away
        own = d.argmin(axis=1)
        now = np.bincount(own, minlength=k)
        sizes = 0.5 * sizes + 0.5 * now
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(now[:, None] > 0, sums / np.maximum(now, 1)[:, None], c)
    c = c[np.sort(np.unique(c, axis=0, return_index=True)[1])]  # equal centroids would link to each other only
    k = len(c)
    near = np.argsort(((c ** 2).sum(1)[:, None] - 2 * c @ c.T + (c ** 2).sum(1)[None]), axis=1, kind="stable")[:, 1: DEGREE + 1]
    # a ring through all centroids keeps the graph connected
    ring = np.roll(np.arange(k), -1)[:, None]
    return Lists(c, np.hstack([near, ring, np.roll(np.arange(k), 1)[:, None]]) if k > 1 else np.zeros((1, 0), int), top)


def pruning_lists(sample: np.ndarray, count: int, top: float, need: int) -> Lists:
    """Lists as fine as they pay: where sampled queries read more than READS of them, fewer are made.

    Which distances a query reads is the same for any number of lists; only the pieces it reads are larger.
    """
    lists = fit_lists(sample, count, top)
    while len(lists.centroids) > READS:
        c, x = lists.centroids, lists.lift(sample, False)
        nearest_list = ((c ** 2).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
        owned = np.bincount(nearest_list, minlength=len(c)) * count / len(x)
        reads = np.mean([len(lists.read(q, owned, need)) for q in lists.lift(sample[:TRIAL], True)])
        if reads <= READS:
            break
        lists = fit_lists(sample, count, top, min(len(c) - 1, max(READS, int(len(c) * READS / reads))))
    return lists


def best_pairs(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of the k best vectors of each query, its own id left out; ties to smaller ids.

    A matrix product leaves out what is surely worse than the k best by its rounding; the rest is scored
    in one order of summing, so that equal vectors get equal scores.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near = q @ m.T
        near[np.isnan(near)] = np.inf
        near[query_ids[:, None] == ids[None]] = -np.inf
        floor = np.full(len(q), -np.inf)
        if len(ids) > k:
            rounding = 16 * np.finfo(float).eps * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(m, axis=1).max() + 1e-300
            floor = np.partition(near, -k, axis=1)[:, -k] - rounding
            floor[~np.isfinite(floor)] = -np.inf
        row, col = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        score = np.concatenate([np.zeros(0), *[(m[col[i: i + PAIRS]] * q[row[i: i + PAIRS]]).sum(axis=1) for i in range(0, len(row), PAIRS)]])
    keep = score > -np.inf
    row, col, score = row[keep], col[keep], score[keep]
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return query_ids[row[keep]], ids[col[keep]], score[keep]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: an id, no null or non-finite component, not zero, and of
    the most frequent length (the smaller length on ties)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(col: pa.Array | pd.Series) -> np.ndarray:
    return np.array(col.to_pylist() if isinstance(col, pa.Array) else col.tolist(), np.float64)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id `every` divides.

    Vectors that are null, zero, of another length, or with null or non-finite components take no part.
    Ties in score go to the smaller vec_id. Rows of one vec_id are one vector (any, if they differ). An
    empty table gives none; other columns are not looked at.
    """
    steps = Steps(vectors.sparkSession, "neighbours")
    rows = steps.write(usable(vectors).dropDuplicates(["vec_id"]))
    count, top = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = steps.write(rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1))
    # one row of each vector: a common one would start many centroids at one point
    picked = kept.filter("_copy = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    lists = pruning_lists(_matrix(picked), kept.count(), float(top), k + 1)

    def post() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = lists.lists_of(lists.lift(_matrix(column(batch, "v")), False))
            at = np.repeat(np.arange(len(own)), [len(o) for o in own])
            owner = [i == 0 for o in own for i in range(len(o))]
            return pa.RecordBatch.from_arrays([pa.array([c for o in own for c in o], pa.int32()), pa.array(owner, pa.bool_()),
                                               *[col.take(pa.array(at)) for col in batch.columns]], ["list", "owner", *batch.schema.names])

        return step

    def probe() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [lists.read(q, owned, k + 1) for q in lists.lift(_matrix(column(batch, "v")), True)]
            at = np.repeat(np.arange(len(own)), [len(o) for o in own])
            return pa.RecordBatch.from_arrays([pa.array([c for o in own for c in o], pa.int32()), *[col.take(pa.array(at)) for col in batch.columns]],
                                              ["list", *batch.schema.names])

        return step

    posted = steps.write(per_batch(kept.select("vec_id", "v"), post, "list int, owner boolean, vec_id long, v array<double>"))
    owned = np.zeros(len(lists.centroids), np.int64)
    for row in posted.filter("owner").groupBy("list").count().collect():
        owned[row["list"]] = row["count"]
    probes = steps.write(per_batch(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v"), probe, "list int, vec_id long, v array<double>"))
    # long lists and popular ones are dealt into parts: blocks of vectors times turns of queries
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    turns = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
    dealt = blocks.join(turns, "list")

    def each(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n: str) -> F.Column:
        return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    member = posted.join(dealt, "list").select("list", one("blocks").alias("block"), each("turns").alias("turn"), "vec_id", "v")
    query = probes.join(dealt, "list").select(F.col("list").alias("q_list"), each("blocks").alias("q_block"), one("turns").alias("q_turn"),
                                              F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(members):
            query_ids, q = queries["query_id"].to_numpy(), _matrix(queries["q"])
            ids, m = members["vec_id"].to_numpy(), _matrix(members["v"])
            out += [best_pairs(query_ids[i: i + SCORED], q[i: i + SCORED], ids, m, k) for i in range(0, len(q), SCORED)]
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    found = query.groupBy("q_list", "q_block", "q_turn").cogroup(member.groupBy("list", "block", "turn")).applyInPandas(
        compare, "query_id long, vec_id long, score double")
    # a replicated vector comes from several lists
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
