"""Conversation prefix trie: nodes are distinct turn prefixes of rebuilt conversations, with subtree totals.

Method: count-min screening of prefix digests. Every (conversation, depth) gets a 128-bit digest of its first
`depth` turns: two running XORs (`bit_xor` window) of 64-bit hashes of (position, role, text), which is a
digest of the set of positioned turns and so of the sequence. A count-min sketch of all digests (counters
saturated at two; `DEPTH` rows of `width` buckets, width from the number of digests, at most `MAX_WIDTH`) is
made by a map-side-combined aggregation and joined back by broadcast (its size is bounded by the parameters).
A prefix with estimate one is proven to belong to one conversation; from the first such depth on, a
conversation's nodes form a chain that is emitted where it lies, without a shuffle. Only prefixes that may be
shared are grouped exactly by digest. Subtree totals use no tree walk: every node is credited to its smallest
member at its depth, and a reverse running sum over each conversation's depths, summed over a node's members,
gives the total of its subtree (a node's subtree is exactly the nodes credited to its members at depths at or
below it). The decimal ids of members that end at a node are hashed in order by a secondary-sorted
`mapInArrow` stream, so no group is gathered in one row.

Defined results for awkward inputs:
* null turn sorts first; ties in turn by role, then text; null role or text is empty;
* null conv_id rows belong to no conversation and are no base; negative ids follow SQL remainder (c - c % 5);
* conv_ids without rows do not exist; a conversation rebuilt to no turns is a member of the root only;
* empty table: no rows, not even the root; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adloom.llm.rows import bounded
from adloom.llm.work import Steps

#: Rows of the count-min sketch, and the largest number of buckets in a row.
DEPTH, MAX_WIDTH = 3, 1 << 22
GROUP, HEAD = 5, 9

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0-based order by turn, nulls first, then role, text), role, text; nulls in role/text empty."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    w = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("c", (F.row_number().over(w) - 1).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of rebuilt conversations: c, pos, role, text; every conv_id c with h and its length n)."""
    h = (F.crc32(F.col("c").cast("string")) % HEAD).cast("long")
    ids = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own")).withColumn("h", h)
    ids = ids.withColumn("base", F.col("c") - F.col("c") % GROUP)
    # the base's first h turns: every base row with pos < 8 meets at most five conversations
    head = (turns.where(F.col("pos") < HEAD - 1).withColumnRenamed("c", "base")
            .join(ids.select("c", "base", "h"), "base").where(F.col("pos") < F.col("h"))
            .select("c", "pos", "role", "text"))
    tail = turns.join(ids.select("c", "h"), "c").where(F.col("pos") >= F.col("h")).select("c", "pos", "role", "text")
    # lengths: base turns taken, plus own turns after h
    taken = (turns.groupBy(F.col("c").alias("base")).agg(F.count(F.lit(1)).alias("base_n"))
             .join(ids.select("c", "base", "h", "own"), "base", "right"))
    lengths = taken.select(
        "c", (F.least(F.coalesce(F.col("base_n"), F.lit(0)), F.col("h"))
              + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return head.unionByName(tail), lengths


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and depth 0..n: c, d, n, digest (da, db), parent digest (pa, pb), bytes of the
    last text."""
    # positions of rebuilt turns are gapless from 0: base rows fill 0..h-1 exactly when the conversation has
    # own turns beyond h; otherwise the rebuilt rows are re-numbered
    w = Window.partitionBy("c").orderBy("pos")
    rows = turns.withColumn("d", F.row_number().over(w))
    ha = F.xxhash64(F.lit("a"), F.col("d"), F.col("role"), F.col("text"))
    hb = F.xxhash64(F.lit("b"), F.col("d"), F.col("role"), F.col("text"))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("c", "d", F.bit_xor(ha).over(run).alias("da"), F.bit_xor(hb).over(run).alias("db"),
                       F.length(F.encode("text", "UTF-8")).cast("long").alias("bytes"))
    wd = Window.partitionBy("c").orderBy("d")
    rows = rows.select("*", F.lag("da", 1, 0).over(wd).alias("pa"), F.lag("db", 1, 0).over(wd).alias("pb"))
    root = lengths.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("da"),
                          F.lit(0).cast("long").alias("db"), F.lit(0).cast("long").alias("bytes"),
                          F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    return rows.withColumn("d", F.col("d").cast("long")).unionByName(root).join(lengths, "c")


def screened(rows: DataFrame, n_rows: int) -> DataFrame:
    """Adds `local`: from the first depth whose sketch estimate is one, the conversation's nodes are its own."""
    width = min(MAX_WIDTH, 1 << max(10, math.ceil(math.log2(max(2, 2 * n_rows)))))
    marked = rows
    for i in range(DEPTH):
        bucket = F.pmod(F.xxhash64(F.lit(i), "da", "db"), F.lit(width))
        marked = marked.withColumn(f"_b{i}", bucket)
        heavy = (marked.where(F.col("d") > 0).groupBy(f"_b{i}").agg(F.count(F.lit(1)).alias("_k"))
                 .where(F.col("_k") >= 2).select(f"_b{i}", F.lit(True).alias(f"_h{i}")))
        marked = marked.join(F.broadcast(heavy), f"_b{i}", "left")
    single = (F.col("d") > 0) & ~(F.coalesce(F.col("_h0"), F.lit(False)) & F.coalesce(F.col("_h1"), F.lit(False))
                                   & F.coalesce(F.col("_h2"), F.lit(False)))
    w = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.max(single.cast("int")).over(w) == 1
    marked = marked.withColumn("local", first).drop(*[f"_b{i}" for i in range(DEPTH)], *[f"_h{i}" for i in range(DEPTH)])
    return marked.withColumn("_top", F.col("local") & ~F.lag("local", 1, False).over(Window.partitionBy("c").orderBy("d")))


def ends_digests(ends: DataFrame) -> DataFrame:
    """d, da, db, ends_sha256 of nodes with members that end there, by a stream over sorted ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {"d": [], "da": [], "db": [], "ends_sha256": []}
        key, sha, first = None, None, True
        for batch in batches:
            cols = batch.to_pydict()
            for d, da, db, c in zip(cols["d"], cols["da"], cols["db"], cols["c"]):
                if (d, da, db) != key:
                    if key is not None:
                        out["d"].append(key[0]); out["da"].append(key[1]); out["db"].append(key[2])
                        out["ends_sha256"].append(sha.hexdigest())
                    key, sha, first = (d, da, db), hashlib.sha256(), True
                sha.update(str(c).encode() if first else b"," + str(c).encode())
                first = False
            if len(out["d"]) >= 4096:
                yield pa.RecordBatch.from_pydict(out)
                out = {k: [] for k in out}
        if key is not None:
            out["d"].append(key[0]); out["da"].append(key[1]); out["db"].append(key[2])
            out["ends_sha256"].append(sha.hexdigest())
        if out["d"]:
            yield pa.RecordBatch.from_pydict(out)

    return (ends.repartition("d", "da", "db").sortWithinPartitions("d", "da", "db", "c")
            .mapInArrow(run, "d long, da long, db long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    spark = bounded(conversations.sparkSession)
    steps = Steps(spark, "trie")
    turns, lengths = rebuilt(steps.write(ordered_turns(conversations)))
    rows = steps.write(prefixes(turns, lengths))
    rows = steps.write(screened(rows, rows.count()))
    key = ["d", "da", "db"]

    shared = rows.where(~F.col("local"))
    nodes = shared.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.first("pa").alias("pa"),
        F.first("pb").alias("pb"), F.first("bytes").alias("bytes"),
        F.count(F.when(F.col("n") == F.col("d"), 1)).alias("n_ends"))
    # children: shared nodes below, and the first local node of each conversation that has one
    tops = rows.where(F.col("_top"))
    child_links = nodes.where(F.col("d") > 0).select((F.col("d") - 1).alias("d"), F.col("pa").alias("da"),
                                                     F.col("pb").alias("db"))
    child_links = child_links.unionByName(tops.select((F.col("d") - 1).alias("d"), F.col("pa").alias("da"),
                                                      F.col("pb").alias("db")))
    children = child_links.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = steps.write(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.select(F.col("d").alias("_pd"), F.col("da").alias("_pa"), F.col("db").alias("_pb"),
                           F.col("conv_id").alias("parent_conv_id"))

    # credits of each node at (its smallest member, its depth); local nodes: a leaf at the end, no savings
    credit = nodes.select(F.col("conv_id").alias("c"), "d", (F.col("n_children") == 0).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    per_row = rows.join(credit, ["c", "d"], "left")
    own_leaf = F.when(F.col("local") & (F.col("d") == F.col("n")), 1).otherwise(0)
    per_row = per_row.withColumn("leaf", F.coalesce("leaf", F.lit(0)) + own_leaf).withColumn(
        "saved", F.coalesce("saved", F.lit(0)))
    below = Window.partitionBy("c").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_row = per_row.select("*", F.sum("leaf").over(below).alias("sub_leaves"), F.sum("saved").over(below).alias("sub_saved"))

    totals = per_row.where(~F.col("local")).groupBy(*key).agg(
        F.sum("sub_leaves").alias("n_leaves"), F.sum("sub_saved").alias("saved_tokens"))
    ends = ends_digests(shared.where(F.col("n") == F.col("d")).select(*key, "c"))
    shared_out = (nodes.join(totals, key).join(ends, key, "left")
                  .join(parents, (F.col("_pd") == F.col("d") - 1) & (F.col("_pa") == F.col("pa")) & (F.col("_pb") == F.col("pb")), "left")
                  .select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                          "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))

    local = per_row.where(F.col("local"))
    local = local.join(parents, F.col("_top") & (F.col("_pd") == F.col("d") - 1) & (F.col("_pa") == F.col("pa"))
                       & (F.col("_pb") == F.col("pb")), "left")
    local_out = local.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("_top"), F.col("parent_conv_id")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("d") < F.col("n")).cast("long").alias("n_children"),
        F.col("sub_leaves").cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("n"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA))
        .alias("ends_sha256"))
    out = shared_out.unionByName(local_out)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs",
                                                                   "n_children", "n_leaves", "saved_tokens")],
                      "ends_sha256")
