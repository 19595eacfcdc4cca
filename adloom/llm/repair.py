"""Conversation structure repair: damage, fault counts, and the cheapest edit script to a legal role sequence.

Method: secondary-sorted streaming. Spark damages the rows, orders each conversation, marks faults (blank,
duplicate by a window on (conversation, role, text), truncated) and counts them. Rows are then repartitioned
by conversation and sorted by position, last first, and one `mapInArrow` task streams them: the cost-to-go of
the four grammar states is the DP state carried across Arrow batches, and each row leaves a compact
backpointer (the optimal letters of each state, 2 bytes) with its role and text in a spool that moves to the
task's scratch disk beyond `SPOOL_BYTES`. At the end of a conversation the backpointers are walked from its
first row, taking the ASCII-least optimal letter, which gives the ASCII-least cheapest audit, and the repaired
rows are hashed in order. No conversation is held whole in memory; a lost executor re-runs its tasks.

Grammar of role initials: `(s?(ua)+)?`. Edits: Keep 0, Rerole to user/assistant 3, Delete 4 (the only edit of
blank and duplicate rows), Insert an empty user/assistant row 3; an undeleted truncated row adds 3.

Defined results for awkward inputs:
* null role or text: one space before damage; a null conv_id or turn is written as one space in the damage key;
  rows with null conv_id form one conversation whose conv_id is null;
* a role's initial is its first character, case as given; an empty role has none and cannot be kept;
* ties in turn: rows are ordered by turn (nulls first), then role, then text; equal rows are interchangeable;
* conversations whose rows are all dropped, and empty tables: zeros, empty audit, hash of the empty string;
* extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adloom.llm.rows import bounded

#: Bytes of spooled rows kept in memory per task before the spool moves to the task's scratch disk.
SPOOL_BYTES = 64 << 20

WS = r"\x20\x09-\x0D"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# grammar states and edit letters (letters in ASCII order)
START, SYS, USER, ASSIST = 0, 1, 2, 3
D, I, K, R = 0, 1, 2, 3
LETTERS = "DIKR"
KEEP = {"s": (SYS, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSIST, -1)}
REROLE = (USER, USER, ASSIST, USER)
INSERT = (USER, USER, ASSIST, USER)
ROLE_OF = {USER: "user", ASSIST: "assistant"}
END = (0, 6, 3, 0)
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3

OUT = "conv_id long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text (nulls: one space), `copy` telling repeated rows apart."""
    space = F.lit(" ")
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    code = F.crc32(F.encode(key, "UTF-8")) % 20
    base = base.withColumn("_code", code).where(F.col("_code") != 0)
    return base.select(
        "conv_id", "turn",
        F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Adds pos (order in the conversation), initial, previous initial and fault (first fault of the row)."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), F.col("copy"))
    blank = ~F.col("text").rlike(f"[^{WS}]")
    truncated = ~F.col("text").rlike(f"[.!?][{WS}]*\\z")
    rows = rows.withColumn("_seen", F.row_number().over(same) > 1)
    rows = rows.select(
        "*", F.row_number().over(conv).alias("pos"), F.substring("role", 1, 1).alias("initial"))
    rows = rows.withColumn("prev_initial", F.lag("initial").over(conv))
    fault = (F.when(blank, BLANK).when(F.col("_seen"), DUPLICATE).when(truncated, TRUNCATED).otherwise(NONE))
    return rows.withColumn("fault", fault).drop("_seen")


def counts(marked: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal."""
    pair = F.concat(F.col("prev_initial"), F.col("initial"))
    illegal = F.col("prev_initial").isNotNull() & ~pair.isin("su", "ua", "au")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return marked.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        F.count(F.when(F.col("fault") == BLANK, 1)).alias("blank"),
        F.count(F.when(F.col("fault") == DUPLICATE, 1)).alias("duplicate"),
        F.count(F.when(F.col("fault") == TRUNCATED, 1)).alias("truncated"),
        F.count(F.when(illegal, 1)).alias("illegal"),
    )


def step(after: tuple[int, ...], fault: int, initial: str) -> tuple[tuple[int, ...], int]:
    """Cost-to-go before a row from the one after it, and the optimal letters of each state (4 bits each)."""
    costs, bits = [0, 0, 0, 0], [0, 0, 0, 0]
    keep = KEEP.get(initial, (-1, -1, -1, -1))
    extra = 3 if fault == TRUNCATED else 0
    for x in range(4):
        best, b = after[x] + 4, 1 << D
        if fault not in (BLANK, DUPLICATE):
            if keep[x] >= 0:
                v = extra + after[keep[x]]
                best, b = (v, 1 << K) if v < best else (best, b | (1 << K)) if v == best else (best, b)
            v = 3 + extra + after[REROLE[x]]
            best, b = (v, 1 << R) if v < best else (best, b | (1 << R)) if v == best else (best, b)
        costs[x], bits[x] = best, b
    return relax(costs, bits)


def relax(costs: list[int], bits: list[int]) -> tuple[tuple[int, ...], int]:
    """Inserts inside one layer: a state may insert and go on from the state the insert leads to."""
    for _ in range(4):
        for x in range(4):
            v = 3 + costs[INSERT[x]]
            if v < costs[x]:
                costs[x], bits[x] = v, 1 << I
    for x in range(4):
        if 3 + costs[INSERT[x]] == costs[x]:
            bits[x] |= 1 << I
    return tuple(costs), bits[0] | bits[1] << 4 | bits[2] << 8 | bits[3] << 12


class Spool:
    """Per-row backpointers and (role, text) of one conversation, in memory up to SPOOL_BYTES, then on disk."""

    REC = struct.Struct("<qH")

    def __init__(self):
        self.index = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.data = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.n = 0

    def add(self, bits: int, role: str, text: str) -> None:
        self.index.write(self.REC.pack(self.data.tell(), bits))
        self.data.write(role.encode() + b"\0" + text.encode())
        self.n += 1

    def get(self, i: int) -> tuple[int, bytes, bytes]:
        self.index.seek(i * self.REC.size)
        start, bits = self.REC.unpack(self.index.read(self.REC.size))
        end = self.REC.unpack(self.index.read(self.REC.size))[0] if i + 1 < self.n else None
        self.index.seek(0, 2)
        self.data.seek(start)
        raw = self.data.read() if end is None else self.data.read(end - start)
        self.data.seek(0, 2)
        role, _, text = raw.partition(b"\0")
        return bits, role, text

    def close(self) -> None:
        self.index.close()
        self.data.close()


def walk(spool: Spool, first: tuple[int, ...]) -> tuple[int, str, str]:
    """(cost, audit, repaired_sha256) from the first row on; spool rows are stored last row first."""
    n, sha, audit, lines = spool.n, hashlib.sha256(), [], 0
    i, x = 0, START

    def emit(line: bytes) -> None:
        nonlocal lines
        sha.update(b"\n" + line if lines else line)
        lines += 1

    while True:
        if i == n:
            if x in (START, ASSIST):
                break
            x = INSERT[x]
            audit.append("I")
            emit(ROLE_OF[x].encode() + b":")
            continue
        bits, role, text = spool.get(n - 1 - i)
        mine = (bits >> (4 * x)) & 15
        letter = next(b for b in range(4) if mine >> b & 1)
        audit.append(LETTERS[letter])
        if letter == D:
            i += 1
        elif letter == I:
            x = INSERT[x]
            emit(ROLE_OF[x].encode() + b":")
        elif letter == K:
            x = KEEP[role.decode()[:1]][x]
            emit(role + b":" + text)
            i += 1
        else:
            x = REROLE[x]
            emit(ROLE_OF[x].encode() + b":" + text)
            i += 1
    return first[START], "".join(audit), sha.hexdigest()


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, then position last first; one output row per conversation."""
    out: dict[str, list] = {"conv_id": [], "cost": [], "audit": [], "repaired_sha256": []}
    current, costs, spool = object(), END, None

    def finish():
        cost, audit, digest = walk(spool, costs)
        spool.close()
        out["conv_id"].append(current)
        out["cost"].append(cost)
        out["audit"].append(audit)
        out["repaired_sha256"].append(digest)

    for batch in batches:
        cols = batch.to_pydict()
        for conv, fault, initial, role, text in zip(cols["conv_id"], cols["fault"], cols["initial"], cols["role"], cols["text"]):
            if conv != current or spool is None:
                if spool is not None:
                    finish()
                current, costs, spool = conv, END, Spool()
            costs, bits = step(costs, fault, initial)
            spool.add(bits, role, text)
        if len(out["conv_id"]) >= 512:
            yield pa.RecordBatch.from_pydict(out)
            out = {k: [] for k in out}
    if spool is not None:
        finish()
    if out["conv_id"]:
        yield pa.RecordBatch.from_pydict(out)


def repair(conversations: DataFrame) -> DataFrame:
    """Every original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    bounded(conversations.sparkSession)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    marked = faults(damaged(conversations))
    per_conv = counts(marked)
    scripts = (marked.select("conv_id", "pos", "fault", "initial", "role", "text")
               .repartition("conv_id").sortWithinPartitions("conv_id", F.col("pos").desc())
               .mapInArrow(stream, OUT))
    joined = (ids.join(per_conv, ids.conv_id.eqNullSafe(per_conv.conv_id), "left").drop(per_conv.conv_id)
              .join(scripts, ids.conv_id.eqNullSafe(scripts.conv_id), "left").drop(scripts.conv_id))
    zero = F.lit(0).cast("long")
    return joined.select(
        ids.conv_id.alias("conv_id"),
        *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.col("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.col("repaired_sha256"), F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
