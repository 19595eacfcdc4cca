"""N-gram Jaccard join with a token-group matrix.

A document is the set of hashes of its word shingles; equal sets form a class, named by a hash of the
set, and only classes are compared. Two sets with similarity t or more differ in at most
(1 - t) / (1 + t) of their summed sizes, d tokens. The token space is dealt into parts, the same for all
sets of a band of sizes, and a set gives the signatures (hash of all tokens) of its first d + m parts that
are not empty. The d differing tokens reach d parts at most, so of the set whose last signature comes
first, m are the other's too. A set with fewer than d + m such parts is dealt once more with another seed,
up to SCHEMES times, and the last time an empty part has a signature too. Hence two linked classes share
at least m signatures of one deal, and a class that shares fewer with all others together has no link
there: its rows of that deal go before any set is compared. So a few frequent passages alone lead nowhere.

1. Classes that share a signature are compared with the smallest of them, a row per member. The links
   found give first components.
2. A signature whose classes are all in one component needs no more work, which settles groups of
   copies without comparing all pairs.
3. The classes of the other signatures are partitioned into groups of similar sets (those that met the
   same smallest class, split into blocks of about BLOCK tokens). The matrix row of a group is the union of
   its tokens. For a query that shares a signature with a group, the overlap with that union bounds
   the overlap with every member; only groups whose bound reaches the threshold are opened.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from adloom.llm.components import components
from adloom.llm.hashes import mix, sequences, word_hashes
from adloom.llm.rows import column, per_batch, texts
from adloom.llm.work import Steps

RATIO = 1.25  # sizes of a band
SCHEMES = 4
DEAL_BITS = 9  # lowest bits of a signature: band and scheme
BLOCK = 1 << 16  # tokens of a group, and of the queries that meet it in one call


def tokens(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, ASCII letters lowered; one for all words where they are fewer."""
    h = word_hashes(text.lower().split())
    if 0 < len(h) < words:
        return sequences(h, len(h), len(h) + 7)
    return np.unique(sequences(h, words))


def band_starts(limit: int = 1 << 40) -> np.ndarray:
    """First size of each band: 1, 2, 3, 4, 5, 6, 7, 8, 10, ... growing by RATIO."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


def parts_of(band: np.ndarray, starts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest difference d, slack g, signatures m that a link shares) of sets whose larger one is in the band.

    The smallest set that is dealt for a band leaves about k * exp(-n / k) of its k = d + g parts empty;
    the slack is that, two deviations and m, so that few sets are dealt again.
    """
    d = 2 * (starts[band + 1] - 1) * (100 - percent) // (100 + percent)
    m = d // 10 + 1
    least = np.maximum(percent * starts[band] // 100, 1)
    g = m.astype(float)
    for _ in range(30):
        empty = (d + g) * np.exp(-least / (d + g))
        g = np.maximum(g, m + np.where(empty > 0.02, np.ceil(empty + 2 * np.sqrt(empty)), 0))
        g = np.minimum(g, d + m)
    return d, g.astype(np.int64), m


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Signatures of each set, for its own band and for the next one if a linked set can be in it."""
    starts = band_starts()
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.flatnonzero(sizes > 0)
    band = np.searchsorted(starts, sizes[owner], "right") - 1
    reach = 100 * sizes[owner] >= percent * starts[band + 1]
    owner, band = np.concatenate([owner, owner[reach]]), np.concatenate([band, band[reach] + 1])
    got: list[list[np.ndarray]] = [[] for _ in sets]
    d, g, m = parts_of(band, starts, percent)
    # what this set and a linked one of the band can differ in, and the signatures it gives
    largest = np.minimum(100 * sizes[owner] // percent, starts[band + 1] - 1)
    own = (sizes[owner] + largest) * (100 - percent) // (100 + percent)
    live = own > 0  # no difference allowed: only equal sets are linked, and they are one class
    owner, band, k, give = owner[live], band[live], (d + g)[live], (own + m)[live]
    for scheme in range(SCHEMES):
        if not len(owner):
            break
        n = sizes[owner]
        row = np.repeat(np.arange(len(owner)), n)
        flat = mix(np.concatenate([sets[o] for o in owner]) ^ np.uint64(scheme * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1))
        offset = np.concatenate([[0], np.cumsum(k)])
        part = offset[row] + ((flat >> np.uint64(32)) % k[row].astype(np.uint64)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]]))
        sums = np.add.reduceat(mix(flat)[order], first)
        used = sorted_part[first]
        whose = np.searchsorted(offset, used, "right") - 1
        deal = (band * SCHEMES + scheme).astype(np.uint64)
        place = mix((deal[whose] << np.uint64(40)) + (used - offset[whose]).astype(np.uint64))
        sig = mix(sums ^ place) << np.uint64(DEAL_BITS) | deal[whose]
        filled = np.bincount(whose, minlength=len(owner))
        bounds = np.concatenate([[0], np.cumsum(filled)])
        again = filled < give
        for i, o in enumerate(owner):
            got[o].append(sig[bounds[i]: min(bounds[i + 1], bounds[i] + give[i])])
            if again[i] and scheme == SCHEMES - 1:
                empty = np.setdiff1d(np.arange(k[i]), used[bounds[i]: bounds[i + 1]] - offset[i])
                got[o].append(mix(mix(empty.astype(np.uint64) + (deal[i] << np.uint64(40))) + np.uint64(77)) << np.uint64(DEAL_BITS) | deal[i])
        owner, band, k, give = owner[again], band[again], k[again], give[again]
    return [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in got]


def deal_of(sig: Column) -> Column:
    """Band and scheme of a signature."""
    return sig.bitwiseAND((1 << DEAL_BITS) - 1)


def shared_by_link(sig: Column, percent: int) -> Column:
    """How many signatures of this one's deal two linked classes share at least."""
    starts = band_starts()
    least = parts_of(np.arange(len(starts) - 1), starts, percent)[2]
    return F.get(F.lit(least.tolist()), F.floor(deal_of(sig) / SCHEMES).cast("int"))


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, class per row."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [tokens(t, words) for t in texts(batch)]
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "node"])

        return step

    return per_batch(docs.select("doc_id", "text"), start, "doc_id long, n long, node long")


def _shared_signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, node: the classes that share a signature.

    Signatures are made from the texts again instead of being kept, and are shuffled once: they are the
    largest thing this join makes. A key has at most one row per document of the hundreds each document
    has, and the window over it spills.
    """

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [tokens(t, words) for t in texts(batch)]
            sigs = signatures(sets, percent)
            nodes = np.array([node_of(s) if len(s) else 0 for s in sets], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(nodes, [len(s) for s in sigs]))], ["sig", "node"])

        return step

    rows = per_batch(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), start, "sig long, node long")
    return _of_several(rows).select("sig", "node").distinct()


def _of_several(rows: DataFrame) -> DataFrame:
    """The rows (sig, node) whose signature has several classes, with the smallest of them as leader."""
    same = Window.partitionBy("sig")
    rows = rows.select("sig", "node", F.min("node").over(same).alias("leader"), F.max("node").over(same).alias("_last"))
    return rows.filter("leader < _last").drop("_last")


def _enough_shared(shared: DataFrame, percent: int) -> DataFrame:
    """sig, node, leader: the rows of classes that share as many signatures of a deal as a link needs."""
    count = F.count(F.lit(1)).over(Window.partitionBy("node", deal_of(F.col("sig"))))
    rows = shared.select("sig", "node", count.alias("_count"))
    return _of_several(rows.filter(F.col("_count") >= shared_by_link(F.col("sig"), percent)).drop("_count"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, n, toks (packed) of the classes in `wanted` (doc_id, node)."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [tokens(t, words) for t in texts(batch)]
            return pa.RecordBatch.from_arrays(
                [column(batch, "node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "n", "toks"])

        return step

    rows = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")
    return per_batch(rows, start, "node long, n long, toks binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _true_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked pairs among (a, b)."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = column(batch, "ta").to_pylist(), column(batch, "tb").to_pylist()
            yes = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            return pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

        return step

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    sized = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b")
    sized = sized.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    return per_batch(sized.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), start, "a long, b long")


def _open_groups(shared: DataFrame, sets: DataFrame, steps: Steps, percent: int) -> DataFrame:
    """Links between classes of different components that share a signature (sig, node, leader, comp)."""
    home = shared.groupBy("node").agg(F.min("leader").alias("home"), F.min("comp").alias("comp"))
    # classes that meet have the same home where that takes one more step
    near = shared.select("sig", "node").join(home, "node").groupBy("sig").agg(F.min("home").alias("near"))
    home = shared.select("sig", "node", "comp").join(near, "sig").groupBy("node").agg(F.min("near").alias("home"), F.min("comp").alias("comp"))
    home = home.join(sets.select("node", "n"), "node")
    size = home.groupBy("home").agg(F.sum("n").alias("size"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    home = steps.write(home.join(size, "home").select("node", "n", "comp", block.alias("block")))
    rows = steps.write(shared.select("sig", "node").join(home.drop("n"), "node"))
    groups = rows.groupBy("sig", F.col("block").alias("group")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # of two blocks, the queries of the smaller one meet the larger one, by the signatures that members
    # of another component hold there: any other link would join what is joined already
    meet = rows.join(groups, "sig").filter("block <= group AND NOT (lo = hi AND comp = lo)")
    meet = steps.write(meet.select("node", "group", "comp").distinct())
    steps.drop(rows)
    load = meet.join(home.select("node", "n"), "node").groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("turns"))
    query = meet.join(load, "group").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(3)), F.col("turns")).cast("int"))
    query = query.join(sets, "node").select(*[F.col(c).alias(f"q_{c}") for c in ("group", "turn", "node", "comp", "toks")])
    member = home.drop("n").withColumnRenamed("block", "group").join(load, "group").join(sets, "node")
    member = member.select("group", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "node", "comp", "toks")

    def open_(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(members):
            inside = [(int(n), c, np.frombuffer(t, np.uint64)) for n, c, t in zip(members["node"], members["comp"], members["toks"])]
            union = np.unique(np.concatenate([t for _, _, t in inside]))
            for node, comp, packed in zip(queries["q_node"], queries["q_comp"], queries["q_toks"]):
                q = np.frombuffer(packed, np.uint64)
                at = np.searchsorted(union, q)
                at[at == len(union)] = 0
                if 100 * np.count_nonzero(union[at] == q) < percent * len(q):
                    continue  # no member can share enough
                met = {comp}
                for other, c, t in inside:
                    if c not in met and linked(q, t, percent):
                        met.add(c)
                        found.append((int(node), other))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    found = steps.write(query.groupBy("q_group", "q_turn").cogroup(member.groupBy("group", "turn")).applyInPandas(open_, "a long, b long"))
    steps.drop(home, meet)
    return found


#: Smallest threshold for which no link was lost (measured: 0 of 400 near-threshold pairs lost at 80 and 90).
LEAST_PERCENT = 80


def jaccard_join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id per row.

    component_id is the smallest doc_id reachable over links 100 * intersection >= percent * union. A
    null or empty text, or one without a word, has no shingles and stands alone, and so does a row
    without a doc_id (component null). Repeated rows each give a row. An empty table gives none; other
    columns are not looked at. Sets are compared whole; 64-bit hashes stand for shingles and classes.

    The signature bands are proven lossless for thresholds of LEAST_PERCENT to 99 only; other values raise
    ValueError instead of losing links.
    """
    if not LEAST_PERCENT <= percent <= 99:
        raise ValueError(f"percent={percent}: the signatures lose no link only for {LEAST_PERCENT} to 99")
    steps = Steps(docs.sparkSession, "jaccard")
    classes = steps.write(_classes(docs, words))
    named = classes.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    first = steps.write(named.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    met = steps.write(_shared_signatures(docs, words, percent))
    shared = steps.write(_enough_shared(met, percent))
    steps.drop(met)
    wanted = steps.write(shared.select("node").distinct().join(first, "node"))
    sets = steps.write(_sets(docs, wanted, words).dropDuplicates(["node"]))
    steps.drop(wanted)
    stars = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = steps.write(_true_pairs(stars, sets, percent))
    comps = components(links, steps)
    labelled = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = labelled.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi")
    open_rows = steps.write(labelled.join(mixed.select("sig"), "sig"))
    steps.drop(shared)  # the signatures of all classes: only those of mixed groups go on
    more = _open_groups(open_rows, sets, steps, percent)
    steps.drop(open_rows, sets)
    comps = components(links.union(more), steps)
    of_node = first.join(comps, "node", "left").select("node", F.col("doc_id").alias("class_id"), F.coalesce("comp", "node").alias("comp"))
    low = of_node.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    of_node = steps.write(of_node.join(low, "comp").select("node", "class_id", "component_id"))
    steps.drop(links, more, first)
    out = classes.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = out.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest doc_id of their component.

    Of repeated rows of one doc_id one stays (the smallest text); rows without a doc_id stay.
    """
    joined = jaccard_join(docs, words, percent)
    other, rank = (f"_{k}_{uuid.uuid4().hex[:12]}" for k in ("other", "rank"))  # no column of docs has these names
    others = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    left = docs.join(others, F.col("doc_id") == F.col(other), "left_anti")
    order = Window.partitionBy("doc_id").orderBy("text")
    ranked = left.withColumn(rank, F.row_number().over(order))
    return ranked.filter((F.col(rank) == 1) | F.col("doc_id").isNull()).drop(rank)
