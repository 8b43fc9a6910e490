"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words. A document of a source is wanted target / size-of-source
times, the same for all its documents: a whole number of copies and a fraction. Fractions are
rounded in pairs: two documents exchange probability so that the words they are expected to give
stay the same, until one of the two is taken or left for good; the direction is drawn so that every
document keeps its expected copies. What one pair leaves undecided meets the next document. Blocks
of documents are rounded side by side, each leaves a few undecided documents, and those are rounded
again in blocks, up a tree, until one block of each source is left. That one decides all.

The last step isn't pivotal rounding: of the last block, at most TURNS documents of a source are turned over,
each the one that brings the source's words nearest to its target, as one large document left to chance
could miss it by its whole size. It biases what it touches: such a document's expected copies aren't its
fraction any more. It is a choice of at most BLOCK documents of a source, whatever the source's size; all
other documents keep their expected copies.

Documents that are alike in id, size and source are counted before they are shuffled and numbered from their
count, so that a block holds a bounded number of rows, whichever ids or copies the rows share.

Edge cases: a null text has size 0 and is never taken more than its whole number of copies; a null
source is a source of its own, last in order; an empty table gives no rows; rows that repeat are
documents of their own. Draws are hashes of the seed, the id and the level: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelattice.llm.common import WORD, mix, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
#: Documents, or undecided ones, rounded by one task at a time.
BLOCK = 1024
#: Small documents that a block leaves undecided beside its last one.
RESERVE = 3
#: Most documents of a source that are turned over at the end.
TURNS = 32
#: Copies of like documents that one task makes out of their count.
COPIES = 100_000
#: Most sources that are broadcast; the list of more is joined by a shuffle.
BROADCAST_SOURCES = 100_000
_SCHEMA = "doc_id long, size long, source_size long, target double, taken long, source_at int, count long, left double, draw long"


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Words for each source: weights share the total, none over `most` times its size, the excess reshared."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = rest / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * share
            return out
        for i in over:
            out[i] = most * sizes[i]
        free = [i for i in free if i not in over]
    return out


def _exchange(la: float, lb: float, wa: float, wb: float, dice: float) -> tuple[float, float]:
    """New fractions of a pair with the same expected words, one of them 0 or 1, each the old one on average."""
    up, down = min((1 - la) * wa, lb * wb), min(la * wa, (1 - lb) * wb)
    if dice * (up + down) < down:  # a gains `up` words from b
        la, lb = (1.0, lb - up / wb) if (1 - la) * wa <= lb * wb else (la + up / wa, 0.0)
    else:
        la, lb = (0.0, lb + down / wb) if la * wa <= (1 - lb) * wb else (la - down / wa, 1.0)
    snap = lambda x: 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
    return snap(la), snap(lb)


def round_block(size: np.ndarray, left: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """New fractions of a block, in the order given.

    All become 0 or 1, but for one and RESERVE of the smallest, which go up the tree. The last block
    decides these too, and then turns over the few documents that bring its words nearest to what
    was expected.
    """
    new = left.copy()
    open_ = np.flatnonzero((left > 0) & (left < 1) & (size > 0))
    dice = (mix(draw.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    paired = open_ if last else np.sort(open_[np.argsort(size[open_], kind="stable")][RESERVE:])
    a = -1
    for b in paired.tolist():
        if a >= 0:
            new[a], new[b] = _exchange(float(new[a]), float(new[b]), float(size[a]), float(size[b]), float(dice[b]))
        if a < 0 or not 0 < new[a] < 1:
            a = b if 0 < new[b] < 1 else -1
    if last:
        if a >= 0:
            new[a] = 1.0 if dice[a] < new[a] else 0.0
        change = np.where(new[open_] > 0, -size[open_], size[open_]).astype(np.float64)
        error = float((size[open_] * (new[open_] - left[open_])).sum())
        for _ in range(TURNS if len(open_) else 0):
            k = int(np.argmin(np.abs(error + change)))
            if abs(error + change[k]) >= abs(error):
                break
            error += change[k]
            new[open_[k]] = 1 - new[open_[k]]
            change[k] = -change[k]
    new[(size == 0) & (new < 1)] = 0.0  # no words either way
    return new


def _rounder(last: bool):
    def run(table: pa.Table) -> pa.Table:
        cols = {k: table.column(k).to_numpy() for k in ("size", "left", "draw", "taken")}
        ids = table.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        order = np.lexsort((cols["size"], ids, cols["draw"]))  # the same order in every run
        left = np.empty(len(order))
        left[order] = round_block(cols["size"][order], cols["left"][order], cols["draw"][order], last)
        taken = cols["taken"] + np.where(left >= 1, cols["size"], 0)
        left = np.where((left > 0) & (left < 1), left, 0.0)
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        new = {"taken": pa.array(taken, pa.int64()), "left": pa.array(left, pa.float64())}
        return pa.Table.from_arrays([new.get(k, table.column(k)) for k in names], names)

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    Sources, in code-point order with null last, weigh `weights` in turn. The list of sources
    is a catalogue the driver can hold; documents and undecided documents stay on the executors.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col("source").cast("string").alias("source"))
    alike = written(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    sums = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("size"), F.sum("alike").alias("n"), F.max("alike").alias("most"))
    catalogue = sorted(sums.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    if not catalogue:
        return alike.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    sizes, counts = [int(r["size"]) for r in catalogue], [int(r["n"]) for r in catalogue]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    plan = sized.sparkSession.createDataFrame([(r["source"], i, sizes[i], counts[i], wanted[i], wanted[i] / sizes[i] if sizes[i] else 0.0) for i, r in enumerate(catalogue)], "plan_source string, source_at int, source_size long, count long, target double, copies double")
    if len(catalogue) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    whole = F.floor("copies")
    rows = _numbered(alike, max(int(r["most"]) for r in catalogue)).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * whole).cast("long").alias("taken"), "source_at", "count", (F.col("copies") - whole).alias("left"), F.xxhash64(F.lit(seed), "doc_id", "size", "number").alias("draw"))

    undecided, done, level, largest = rows, [], 0, max(counts)
    while True:
        last = largest <= block
        blocks = F.ceil(F.col("count") / block)
        key = F.pmod(F.xxhash64("draw", F.lit(level)), blocks)
        rounded = undecided.withColumn("draw", F.xxhash64("draw", F.lit(f"level {level}"))).groupBy("source_at", key.alias("block")).applyInArrow(_rounder(last), _SCHEMA)
        if last:
            done.append(rounded)
            break
        rounded = written(rounded, f"mix-{level}")
        done.append(rounded.where("left = 0"))
        undecided, level = rounded.where("left > 0").withColumn("count", (blocks * (RESERVE + 1)).cast("long")), level + 1
        largest = -(-largest // block) * (RESERVE + 1)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _numbered(alike: DataFrame, most: int) -> DataFrame:
    """A row with a number for each of the documents that a row of `alike` counts."""
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    if most <= COPIES:
        return alike.withColumn("number", copies(F.col("alike")))
    few, many = alike.where(F.col("alike") <= COPIES), alike.where(F.col("alike") > COPIES)
    parts = many.withColumn("part", copies(F.ceil(F.col("alike") / COPIES))).repartition("source", "doc_id", "size", "part")
    own = F.least(F.lit(COPIES).cast("long"), F.col("alike") - F.col("part") * COPIES)
    numbered = parts.withColumn("at", copies(own)).withColumn("number", F.col("part") * COPIES + F.col("at")).drop("part", "at")
    return few.withColumn("number", copies(F.col("alike"))).unionByName(numbered)
