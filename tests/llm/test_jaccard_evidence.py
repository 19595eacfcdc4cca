"""op2 and the pipeline's near copies: only classes that share as much as a link needs go on to be compared."""

import random

import numpy as np

from adloom.llm import jaccard


def prose(r: random.Random, n: int) -> str:
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_a_frequent_passage_alone_compares_no_sets(spark, monkeypatch):
    r = random.Random(11)
    passage = prose(r, 30)
    rows = [(i, f"{prose(r, 150)} {passage} {prose(r, 150)}") for i in range(60)]
    base = prose(r, 300).split()
    near = [*base[:290], *prose(r, 10).split()]
    rows += [(100, " ".join(base)), (101, " ".join(near)), (102, prose(r, 300))]
    seen, sets = [], jaccard._sets

    def counted(docs, wanted, words):
        seen.extend(x.doc_id for x in wanted.collect())
        return sets(docs, wanted, words)

    monkeypatch.setattr(jaccard, "_sets", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_join(docs, 5, 80).collect()}
    assert got == {i: i for i, _ in rows} | {101: 100}
    assert sorted(seen) == [100, 101]


def test_links_share_the_signatures_that_are_counted():
    r = np.random.default_rng(6)
    starts = jaccard.band_starts()
    tried = 0
    for percent in (80, 90, 99):
        least = jaccard.parts_of(np.arange(len(starts) - 1), starts, percent)[2]
        for n in (4, 9, 11, 40, 130, 399, 700):
            for _ in range(12):
                a = r.integers(0, 2**63, n).astype(np.uint64)
                keep = -(-2 * n * percent // (100 + percent))
                for b in (np.concatenate([a[:keep], r.integers(0, 2**63, n - keep).astype(np.uint64)]), a[: -(-n * percent // 100)]):
                    x, y = np.unique(a), np.unique(b)
                    if jaccard.linked(x, y, percent) and len(np.setxor1d(x, y)):
                        both = np.intersect1d(*jaccard.signatures([x, y], percent))
                        deal, count = np.unique(both.astype(np.int64) & (1 << jaccard.DEAL_BITS) - 1, return_counts=True)
                        assert (count >= least[deal // jaccard.SCHEMES]).any(), (percent, n)
                        tried += 1
    assert tried > 300
