"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring words: some positions count, the others are ignored, so that
a hit survives substituted words at ignored places. Test items and documents are hashed under each of
the masks; equal hashes are hits. Around a hit the two word sequences are laid over each other and
the longest stretch with few enough substitutions is measured. An overlap counts if it is long
enough, or covers most of a short item.

The masks leave no accepted stretch out. A stretch of L words has at most k = L // 5 substitutions and
so L - k equal words in at most k + 1 runs; both its ends are equal. From L >= 4k + 4 on, one run has
four words, which the first mask finds. That leaves L = 5, 6, 7, 10, 11 and 15. At 10, 11 and 15
there are three runs or more unless one has four words, and two neighbouring runs (one place apart)
have at least 3 and 1, or 1 and 3 words; at 6 and 7 likewise; at 5 also 2 and 2, and at 6 2 and 3.

Words are compared without case and outer punctuation. The test items are cut into parts of bounded
size; each part is broadcast and scanned for over all documents, so a growing benchmark costs more
passes and never more memory.

Edge cases: null texts and texts without words have no overlap; items of fewer than SHORTEST words
never match; repeated rows and items are judged each; extra columns are ignored by overlaps() and kept
by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelattice.llm.common import SEPARATOR, chunks, fold, map_batches, utf8, word_bounds, word_hashes

#: Positions of a seed that count.
SEEDS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4))
#: An overlap has at least so many words, of which at least this share is equal.
LEAST_WORDS, LEAST_EQUAL = 13, 0.8
#: ... or this share of all words of the item.
LEAST_COVER = 0.8
SHORTEST = 5
#: Items of one broadcast part, and the characters beyond which it takes no further one.
PART_ITEMS, PART_CHARS = 20_000, 32_000_000
#: Words compared in one go around hits.
COMPARED = 1 << 20
_EDGE_MARKS = np.zeros(256, bool)
_EDGE_MARKS[list(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""")] = True


def folded_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without outer marks, first word of each document) of lower-case texts."""
    soft = SEPARATOR[data] | _EDGE_MARKS[data]
    starts, ends, first = word_bounds(data, offs)
    # outer marks: the first and the last byte of a word that isn't one
    solid = np.flatnonzero(~soft)
    if len(starts) and len(solid):
        lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        bare = lo > hi  # nothing but marks: stays as it is
        starts = np.where(bare, starts, solid[np.minimum(lo, len(solid) - 1)])
        ends = np.where(bare, ends, solid[np.maximum(hi, 0)] + 1)
    return word_hashes(data, starts, ends), first


class Items:
    """Seeds of a part of the test items, sorted by hash, with a bit table in front."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        self.words, self.first = folded_words(*utf8(pc.utf8_lower(pa.array(texts, pa.large_string()))))
        self.ids = np.array(ids, np.int64)
        self.n = np.diff(self.first)
        # words of an overlap at least
        self.need = np.minimum(LEAST_WORDS, np.maximum(SHORTEST, np.ceil(LEAST_COVER * self.n).astype(np.int64)))
        self.hashes, self.places = [], []
        for seed in SEEDS:
            span = seed[-1] + 1
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(f, f + n - span + 1) for f, n in zip(self.first, self.n, strict=False) if n >= SHORTEST]])
            self._add(fold(self.words, seed, len(self.words) - span + 1)[at] if len(at) else np.zeros(0, np.uint64), at)
        self.doc_of_word = np.repeat(np.arange(len(self.n)), self.n)

    def _add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes.append(hashes[order])
        self.places.append(places[order])

    def tables(self) -> list[np.ndarray]:
        out = []
        for h in self.hashes:
            bits = np.zeros(1 << 22, bool)
            bits[(h >> np.uint64(42)).astype(np.int64)] = True
            out.append(bits)
        return out


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest (start, end) that begins and ends equal and is equal for LEAST_EQUAL of its length; the first of such."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, round((1 - LEAST_EQUAL) * 1000), -round(LEAST_EQUAL * 1000)))))
    starts, ends = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    lows: list[int] = []  # starts with a smaller sum than every start before
    for i in starts.tolist():
        if not lows or sums[i] < sums[lows[-1]]:
            lows.append(i)
    best = (0, 0)
    for j in ends[::-1].tolist():
        while lows and sums[lows[-1]] <= sums[j]:
            i = lows.pop()
            if j - i > best[1] - best[0] or (j - i == best[1] - best[0] and i < best[0]):
                best = (i, j)
    return best


def _hits(items: Items, tables: list[np.ndarray], words: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word of the documents, word of the items) of equal seeds, a part at a time."""
    for seed, hashes, places, table in zip(SEEDS, items.hashes, items.places, tables, strict=True):
        span = seed[-1] + 1
        if len(words) < span or not len(hashes):
            continue
        h = fold(words, seed, len(words) - span + 1)
        at = np.flatnonzero(table[(h >> np.uint64(42)).astype(np.int64)])
        at = at[doc_of[at] == doc_of[at + span - 1]]
        lo = np.searchsorted(hashes, h[at], "left")
        n = np.searchsorted(hashes, h[at], "right") - lo
        total = np.concatenate(([0], np.cumsum(n)))
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + COMPARED, "right")) - 1)
            own = n[begin:end]
            within = np.arange(total[end] - total[begin]) - np.repeat(total[begin:end] - total[begin], own)
            yield np.repeat(at[begin:end], own), places[np.repeat(lo[begin:end], own) + within]
            begin = end


def _overlaps(items: Items, tables: list[np.ndarray], words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, end) of the accepted overlaps of a chunk of documents."""
    out: dict[tuple[int, int, int], tuple[int, int]] = {}
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for w, p in _hits(items, tables, words, doc_of):
        # each alignment once: a document, an item and how far one lies from the other
        pairs = np.unique(np.column_stack((doc_of[w], items.doc_of_word[p], w - p)), axis=0)
        d, item, shift = pairs.T
        a = np.maximum(items.first[item], first[d] - shift)
        b = np.minimum(items.first[item + 1], first[d + 1] - shift)
        keep = b - a >= items.need[item]
        d, item, shift, a, b = d[keep], item[keep], shift[keep], a[keep], b[keep]
        total = np.concatenate(([0], np.cumsum(b - a)))
        begin = 0
        while begin < len(a):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + COMPARED, "right")) - 1)
            n = (b - a)[begin:end]
            cut = total[begin : end + 1] - total[begin]
            at = np.arange(cut[-1]) + np.repeat(a[begin:end] - cut[:-1], n)
            equal = items.words[at] == words[at + np.repeat(shift[begin:end], n)]
            # fewer equal words in all than the shortest overlap has: not worth a closer look
            likely = np.add.reduceat(equal, cut[:-1], dtype=np.int64) >= LEAST_EQUAL * items.need[item[begin:end]] - 1e-9
            for k in np.flatnonzero(likely).tolist():
                x = begin + k
                key = (int(d[x]), int(item[x]), int(shift[x]))
                if key in out:
                    continue
                s, e = longest_stretch(equal[cut[k] : cut[k + 1]])
                if e - s >= items.need[item[x]]:
                    start = int(a[x] + shift[x] - first[d[x]])
                    out[key] = (start + s, start + e)
            begin = end
    return [(d, item, *span) for (d, item, _), span in out.items()]


def item_parts(benchmark: DataFrame, most: int = PART_ITEMS) -> Iterator[Items]:
    """The items in parts of bounded size, one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator()
    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += len(row["text"])
        if len(part) >= most or chars >= PART_CHARS:
            yield Items([r["item_id"] for r in part], [r["text"] for r in part])
            part, chars = [], 0
    if part:
        yield Items([r["item_id"] for r in part], [r["text"] for r in part])


def _batch_overlaps(items: Items, tables: list[np.ndarray], column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    data, offs = utf8(pc.utf8_lower(column))
    for i, j in chunks(offs):
        words, first = folded_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for d, item, s, e in _overlaps(items, tables, words, first):
            yield i + d, item, s, e


_FOUND = "doc_id long, text string, n_overlaps long, longest long, items array<long>"


def _scanner(shared):
    """Adds a part's overlaps to what the parts before found in the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, tables = shared.value, shared.value.tables()
        for batch in batches:
            n, words, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [set(x) for x in batch.column(4).to_pylist()]
            for d, item, s, e in _batch_overlaps(items, tables, batch.column(1)):
                n[d] += 1
                words[d] = max(words[d], e - s)
                ids[d].add(int(items.ids[item]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(pa.int64()))], ["doc_id", "text", "n_overlaps", "longest", "items"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, most: int = PART_ITEMS) -> DataFrame:
    """doc_id, contaminated, n_overlaps, longest (words), items of every row."""
    none = F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("n_overlaps"), none.alias("longest"), F.array().cast("array<long>").alias("items"))
    for part in item_parts(benchmark, most):
        rows = map_batches(rows, _scanner(docs.sparkSession.sparkContext.broadcast(part)), _FOUND)
    return rows.select("doc_id", (F.col("n_overlaps") > 0).alias("contaminated"), "n_overlaps", "longest", "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item, unchanged."""
    at = docs.columns.index("text")

    def filtered(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, tables = shared.value, shared.value.tables()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for d, *_ in _batch_overlaps(items, tables, batch.column(at)):
                    keep[d] = False
                yield batch.filter(pa.array(keep))

        return run

    for part in item_parts(benchmark):
        docs = map_batches(docs, filtered(docs.sparkSession.sparkContext.broadcast(part)), docs.schema)
    return docs
