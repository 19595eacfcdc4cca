"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adloom.llm.work import Steps


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, comp) for every node of (a, b) edges; comp is the smallest node reachable.

    In a round every node moves to the smallest node next to it, and the edges are rewritten between
    the targets, until none is left. The smallest node of a component never moves, so the last target
    is it. Degrees do not matter: minima are combined before the shuffle, joins split hot keys, and
    what a round needs from the one before is a written table; tables of a finished round are deleted.
    """
    edges = steps.write(edges.select("a", "b").filter("a <> b"))
    names = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        target = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp"))
        target = steps.write(target)
        if names is None:
            new_names = target
        else:
            step = target.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
            new_names = steps.write(names.join(step, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp")))
        left = target.select(F.col("node").alias("a"), F.col("comp").alias("_a"))
        right = target.select(F.col("node").alias("b"), F.col("comp").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").filter("_a <> _b")
        moved = steps.write(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        # what this round read is not read again: its files go, so disk holds about one round
        spent = [edges, *([names] if names is not None else []), *([target] if new_names is not target else [])]
        edges, names = moved, new_names
        steps.drop(*spent)
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
