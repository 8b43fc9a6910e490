"""SimHash near duplicates over a hierarchical index in Gray order.

Fingerprints: one bit for each of the 64 bit places of the XXH64 values of the 4-word shingles, set
where more than half of them have a 1. Two fingerprints link at 4 or fewer differing bits.

Index: distinct fingerprints are dealt out by blocks of bits, such that two that link agree in one
block at least. Within a block's bucket they are sorted by Gray rank, so that neighbours share long bit
patterns. Upper nodes hold the pattern that a run of them shares under a mask; pairs of nodes are
visited from the top, differences under each mask add up, and a pair of whole groups is dropped as
soon as the sum exceeds the limit. What reaches the leaves is a link.

Edge cases: null texts and texts without words have fingerprint zero, which links like any other;
texts of fewer than four words have one shingle, the whole sequence; repeated rows and equal
fingerprints are one class; a null doc_id is ordered after all others and returned as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.llm.common import NO_ID, dropped, map_batches, order_key, written
from scorelattice.llm.components import components

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Widths of the masks, from the top of the Gray-ordered word down.
LEVELS = (8, 8, 16, 16, 16)
#: Pairs of nodes looked at in one go.
WORK = 2_000_000
#: A bucket with more fingerprints is cut into tiles of this many, which are paired in separate tasks.
TILE = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """order_id (the id, or the largest number for null), fp (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["order_id", "fp"])

    return map_batches(docs.select(order_key(F.col("doc_id")).alias("order_id"), "text"), run, "order_id long, fp long")


def gray_rank(words: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def linked(fps: np.ndarray, buckets: np.ndarray | None = None, limit: int = LIMIT, levels: tuple[int, ...] = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints of one bucket that differ in at most `limit` bits, a part at a time."""
    buckets = np.zeros(len(fps), np.int64) if buckets is None else buckets
    order = np.lexsort((gray_rank(fps), buckets))
    words, buckets = fps[order], buckets[order]
    edge = np.concatenate((np.ones(min(1, len(words)), bool), buckets[1:] != buckets[:-1]))
    nodes, patterns, bits = [np.append(np.flatnonzero(edge), len(words))], [], 64
    for width in levels:  # where the nodes of each level start, and the pattern a node shares under its mask
        bits -= width
        prefix = words >> np.uint64(bits)
        starts = np.flatnonzero(edge | np.concatenate((edge[:1], prefix[1:] != prefix[:-1])))
        nodes.append(np.append(starts, len(words)))
        patterns.append(prefix[starts] & np.uint64((1 << width) - 1))
    tops = np.arange(len(nodes[0]) - 1)
    stack = [(0, tops, tops, np.zeros(len(tops), np.uint8))]
    while stack:
        level, a, b, spent = stack.pop()
        if level == len(levels):
            i, j = nodes[level][a], nodes[level][b]
            keep = i != j
            if keep.any():
                yield order[i[keep]], order[j[keep]]
            continue
        first = np.searchsorted(nodes[level + 1], nodes[level])
        nb = first[b + 1] - first[b]
        work = (first[a + 1] - first[a]) * nb
        if work.sum() > WORK:  # bounded memory
            if len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], spent[half:]), (level, a[:half], b[:half], spent[:half])]
                continue
            strip = max(1, WORK // int(nb[0]))  # one very wide pair of nodes: by strips of a's children
            below = np.arange(first[b[0]], first[b[0] + 1])
            for s in range(int(first[a[0]]), int(first[a[0] + 1]), strip):
                own = np.arange(s, min(s + strip, int(first[a[0] + 1])))
                stack += _survivors(np.repeat(own, len(below)), np.tile(below, len(own)), np.full(len(own) * len(below), spent[0]), patterns[level], limit, level)
            continue
        pair = np.repeat(np.arange(len(a)), work)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(work) - work, work)
        ca, cb = first[a][pair] + within // nb[pair], first[b][pair] + within % nb[pair]
        stack += _survivors(ca, cb, spent[pair], patterns[level], limit, level)


def _survivors(ca: np.ndarray, cb: np.ndarray, spent: np.ndarray, patterns: np.ndarray, limit: int, level: int) -> list:
    spent = spent + np.bitwise_count(patterns[ca] ^ patterns[cb])
    keep = (spent <= limit) & (ca <= cb)
    return [(level + 1, ca[keep], cb[keep], spent[keep])] if keep.any() else []


class Forest:
    """Union-find over a task's rows, so that it hands on a spanning forest and not every link."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the classes of a and b, all pairs at once: hook to the smaller root, then jump."""
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return moved, self.root[moved]


def masks(rows: int) -> list[int]:
    """Bit masks such that two words within LIMIT bits agree under one of them; wider ones for more rows.

    With m blocks and LIMIT differences, m - LIMIT blocks at least are the same in both words.
    """
    m = 5 if rows < 1 << 22 else 6 if rows < 1 << 30 else 8
    cuts = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(block[i] for i in own) for own in combinations(range(m), m - LIMIT)]


def _slice_links(limit: int):
    def run(table: pa.Table) -> pa.Table:
        fps, ids = table.column("fp").to_numpy().view(np.uint64), table.column("id").to_numpy()
        key = [table.column(k).to_numpy() for k in ("at", "bits", "i", "j")]
        order = np.lexsort(key)
        change = np.zeros(len(order), bool)
        for k in key:
            change[1:] |= k[order][1:] != k[order][:-1]
        buckets = np.empty(len(order), np.int64)
        buckets[order] = np.cumsum(change)
        forest = Forest(len(fps))
        for a, b in linked(fps, buckets, limit):
            forest.add(a, b)
        a, b = forest.edges()
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


def fingerprint_links(classes: DataFrame, limit: int = LIMIT, tile: int = TILE, most_broadcast: int = 100_000) -> DataFrame:
    """Edges between ids of distinct fingerprints (fp, id) that connect what links of at most `limit` bits connect.

    A bucket of more than `tile` fingerprints is cut into tiles; each pair of tiles is searched by itself.
    """
    rows = classes.count()
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    keys = F.array(*[F.struct(F.lit(k).alias("at"), F.col("fp").bitwiseAND(signed(m)).alias("bits")) for k, m in enumerate(masks(rows))])
    dealt = classes.select("fp", "id", F.explode(keys).alias("key")).select("fp", "id", "key.at", "key.bits")
    large = written(dealt.groupBy("at", "bits").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("at", "bits", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "simhash-large")
    n_large = large.count()
    if n_large:
        dealt = dealt.join(F.broadcast(large) if n_large <= most_broadcast else large, ["at", "bits"], "left")
        own = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"), F.lit(0))
        meets = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
        dealt = dealt.select("fp", "id", "at", "bits", F.explode(meets).alias("pair")).select("fp", "id", "at", "bits", "pair.i", "pair.j")
    else:
        dealt = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    slices = max(64, rows // 2000)
    cut = F.pmod(F.xxhash64("at", "bits", "i", "j"), F.lit(slices))
    return dealt.groupBy(cut.alias("slice")).applyInArrow(_slice_links(limit), "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    marked = written(with_fingerprints(docs), "simhash-fps")
    classes = written(marked.groupBy("fp").agg(F.min("order_id").alias("id")), "simhash-classes")
    groups = components(fingerprint_links(classes, limit))  # node, root over the ids of classes with a link
    named = classes.join(groups, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "id").alias("component_id"))
    out = marked.join(written(named, "simhash-named"), F.col("fp") == F.col("class_fp"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("order_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component_id").alias("component_id"))


def kept_rows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs less near duplicates: of each component of linked fingerprints the row with the smallest id, then content.

    Components run over fingerprints, so that rows with the same id, or without one, only meet through their texts.
    """
    # a null has no hash of its own, so which columns are null counts too
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["kept_id", "kept_row", "fp"])

    rows = docs.select(order_key(F.col("doc_id")).alias("kept_id"), row.alias("kept_row"), "text")
    marked = written(map_batches(rows, run, "kept_id long, kept_row long, fp long"), "simhash-rows")
    # of each fingerprint its first row, and how many rows are just like it
    alike = marked.groupBy("fp", "kept_id", "kept_row").agg(F.count("*").alias("n"))
    classes = written(alike.groupBy("fp").agg(F.min(F.struct("kept_id", "kept_row", "n")).alias("first")), "simhash-classes")
    groups = components(fingerprint_links(classes.select("fp", F.col("fp").alias("id")), limit))
    grouped = classes.join(groups, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first"))
    first = written(grouped.select("first.*"), "simhash-kept")
    dropped(marked, classes)
    # a row travels as one column, so that no name of its own can clash
    kept = docs.select(order_key(F.col("doc_id")).alias("kept_id"), row.alias("kept_row"), F.struct("*").alias("row")).join(first, ["kept_id", "kept_row"])
    # rows alike in every column: one of them
    many = kept.where("n > 1").withColumn("at", F.row_number().over(Window.partitionBy("kept_id", "kept_row").orderBy("n"))).where("at = 1").drop("at")
    return kept.where("n = 1").unionByName(many).select("row.*")
