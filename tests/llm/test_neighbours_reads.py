"""Lists a query of op7 reads: as many for a larger table without clusters; scores of a block are exact."""

import numpy as np

from adloom.llm import neighbours


def reads(spark, monkeypatch, x: np.ndarray) -> tuple[float, float]:
    """Rows of the table of (list, query) per query, and the share of the 20 best scores reached."""
    rows = {}

    class Counted(neighbours.Steps):
        def write(self, df):
            out = super().write(df)
            if out.columns == ["list", "vec_id", "v"]:
                rows["probes"] = out.count()
            return out

    monkeypatch.setattr(neighbours, "Steps", Counted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(df, every=20).collect()
    queries = len(range(0, len(x), 20))
    assert len(got) == 20 * queries
    best = {q: np.sort(np.delete(x @ x[q], q))[-20] for q in range(0, len(x), 20)}
    return rows["probes"] / queries, sum(r.score >= best[r.query_id] - 1e-9 for r in got) / len(got)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_reads_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 8)
    r = np.random.default_rng(8)
    small, found_small = reads(spark, monkeypatch, unit(r.normal(size=(1_000, 32))))
    large, found_large = reads(spark, monkeypatch, unit(r.normal(size=(4_000, 32))))
    assert large <= 1.3 * small and large <= 80
    assert min(found_small, found_large) >= 0.98


def test_clustered_vectors_keep_fine_lists():
    r = np.random.default_rng(9)
    x = unit(np.repeat(unit(r.normal(size=(400, 32))), 20, axis=0) + 0.02 * r.normal(size=(8_000, 32)))
    lists = neighbours.pruning_lists(x, 128 * 400, 1.0, 21)
    assert len(lists.centroids) > 300


def test_scores_of_a_block_are_those_of_one_by_one():
    r = np.random.default_rng(10)
    for size in (1, 5, 21, 300):
        m = r.integers(-2, 3, (size, 6)) / 3  # many ties
        ids = r.permutation(size).astype(np.int64)
        want = []
        for i, q in zip(ids[:30], m[:30]):
            score = (m * q).sum(axis=1)
            want += [(i, ids[b], score[b]) for b in np.lexsort((ids, -score)) if ids[b] != i][:20]
        assert list(zip(*neighbours.best_pairs(ids[:30], m[:30], ids, m, 20))) == want
