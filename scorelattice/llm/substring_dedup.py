"""Incremental substring deduplication over a log-structured fingerprint index.

Every window of `width` words has a 128-bit fingerprint, made of two hashes of its words that share no
arithmetic. Documents come in batches in the order of their ids; the index is a list of immutable
runs, each the sorted distinct fingerprints of a batch, cut into buckets by the leading bits. A bucket of
a new batch is sorted and merge-joined with the same bucket of every run and with itself: a window is a
repeat if a run has it, or a document of the batch with a smaller id. The batch then becomes a run;
every `fan_in` runs are merged into one (compaction).

Documents are read in chunks of about CHUNK_TEXT bytes. Equal windows of a chunk are one before anything
is shuffled: the first stands for all, and what the others need to know stays with the chunk's list of
documents, which is sent once. A chunk gives a row for each bucket, for up to `fan` buckets; beyond that it
gives a row for each group of buckets, and groups are cut into buckets, and replies into chunks,
by a second shuffle. So a chunk's rows don't grow with the index.

Verification: the merge compares 80 stored bits, 48 of one hash and 32 of the other, beside the leading bits of
the first that chose the bucket. Among n windows some two unlike ones are taken for equal with a chance of about
n^2 / 2^(81 + log2(buckets)): 5e-11 at 0.5 GB, 5e-9 at 30 GB (1,900 buckets), 2e-5 at 100 TB (6 million
buckets). Marks are only applied to the very text, by its hash, that they were made from.

Edge cases: null texts and texts without words have no words; texts of fewer than `width` words lose
nothing; a null doc_id comes after all others; rows that share a doc_id are one document in the
comparison and each give a row; a window that repeats only inside its own document is kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.llm.common import NO_ID, chunks, fold, map_batches, order_key, release_memory, utf8, word_bounds, word_hashes, written

WIDTH = 13
#: Ends of the batches, as shares of the ids in order: four small ones that make runs, compacted into one, and the rest.
BATCH_ENDS = (0.02, 0.04, 0.06, 0.08, 1.0)
FAN_IN = 4
LEAST_BUCKETS = 64
BUCKET_BYTES = 16_000_000
#: Most rows that a chunk sends to the buckets.
FAN = 4096
CHUNK_TEXT = 2 << 20
#: Bytes that a task of the second shuffle gathers before it cuts them.
HELD_BYTES = 48 << 20
_FLAT = "bucket int, kind string, chunk long, segments binary, ids binary, hashes binary, gaps binary, parts binary"
_NAMES = [x.split()[0] for x in _FLAT.split(", ")]
_TYPES = (pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 5)
_LEAST = np.iinfo(np.int64).min


# --- packing --------------------------------------------------------------


def plane(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all first bytes before all second ones: compresses well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplane(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def deltas(values: np.ndarray, width: int) -> bytes:
    """Differences of whole numbers, modulo their width."""
    v = values.astype(np.int64).view(np.uint64)
    return plane(np.diff(v, prepend=np.uint64(0)), width)


def undeltas(data: bytes, width: int) -> np.ndarray:
    sums = np.cumsum(unplane(data, width), dtype=np.uint64)
    return (sums if width == 8 else sums & np.uint64((1 << 8 * width) - 1)).view(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _row(bucket: int, kind: str, chunk: int = 0, segments: bytes = b"", ids: bytes = b"", hashes: bytes = b"", gaps: bytes = b"", parts: bytes = b"") -> tuple:
    return bucket, kind, chunk, segments, ids, hashes, gaps, parts


def _segments(chunk: np.ndarray) -> bytes:
    """Runs of equal chunk numbers: the numbers, then how long each run is."""
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(chunk)), bool), chunk[1:] != chunk[:-1])))
    return plane(chunk[start], 8) + plane(np.diff(np.append(start, len(chunk))), 4)


def _unsegments(data: bytes) -> np.ndarray:
    n = len(data) // 12
    return np.repeat(unplane(data[: 8 * n], 8).view(np.int64), unplane(data[8 * n :], 4).astype(np.int64))


def _pack_docs(ids: np.ndarray, per: np.ndarray) -> bytes:
    """Documents in the order of their ids: differences of the ids, window counts."""
    return deltas(ids, 8) + plane(per, 4)


def _unpack_docs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return undeltas(data[: 8 * n], 8), unplane(data[8 * n :], 4).astype(np.int64)


def _pack_hashes(a: np.ndarray, b: np.ndarray) -> bytes:
    return plane(a, 8) + plane(b, 2)


def _unpack_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 10
    return unplane(data[: 8 * n], 8), unplane(data[8 * n :], 2).astype(np.uint16)


# --- windows --------------------------------------------------------------


class Buckets:
    """How many buckets there are, and how they are grouped: at most `fan` groups."""

    def __init__(self, n: int, fan: int = FAN) -> None:
        self.n, self.fan = n, fan
        self.per = -(-n // fan)
        self.groups = -(-n // self.per)

    def of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)


def window_hashes(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, other hash of every window, windows of each document) of documents laid end to end."""
    starts, ends, first = word_bounds(data, offs)
    per = np.maximum(np.diff(first) - width + 1, 0)
    if not per.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), per
    n = len(starts) - width + 1
    at = np.repeat(first[:-1] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    one, other = (fold(word_hashes(data, starts, ends, k), range(width), n, k)[at] for k in (0, 1))
    return one, other, per


def _stored(one: np.ndarray, other: np.ndarray, per: np.ndarray, buckets: Buckets) -> tuple[np.ndarray, ...]:
    """(64 bits, 16 bits that are stored of each window, its bucket, windows of each document)."""
    a = (one & np.uint64((1 << 48) - 1)) | (other << np.uint64(48))
    return a, (other >> np.uint64(16)).astype(np.uint16), buckets.of(one).astype(np.int32), per


def ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by (a, b), where in that order a new pair starts)."""
    order = np.argsort(a, kind="stable")
    sa, sb = a[order], b[order]
    same = sa[1:] == sa[:-1]
    if (same & (sb[1:] != sb[:-1])).any():  # equal in a only: hardly ever
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        same = sa[1:] == sa[:-1]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), ~(same & (sb[1:] == sb[:-1])))))


def chunk_rows(ids: np.ndarray, sigs: np.ndarray, text: pa.Array, width: int, buckets: Buckets) -> list[tuple]:
    """The rows of a chunk of documents in the order of their ids: one with the documents, one for each group of buckets."""
    data, offs = utf8(text)
    found = [_stored(*window_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width), buckets) for i, j in chunks(offs)]
    per = np.concatenate([np.zeros(0, np.int64), *[f[3] for f in found]])
    some = per > 0
    if not some.any():
        return []
    a, b, at = (np.concatenate([f[k] for f in found]) for k in range(3))
    del found
    ids, sigs, per = ids[some], sigs[some], per[some]
    # the first of equal windows stands for the others
    order, start = ordered(a, (at.astype(np.uint64) << np.uint64(16)) | b)
    stands = np.empty(len(a), np.int32)
    stands[order] = np.repeat(order[start], np.diff(np.append(start, len(a))))
    del order, start
    firsts = stands == np.arange(len(a), dtype=np.int32)
    sent, rest = np.flatnonzero(firsts), np.flatnonzero(~firsts)
    owner = np.repeat(ids, per)
    later = owner[rest] > owner[stands[rest]]
    tied = rest[~later]  # of the same document as their first: repeats if that one is
    docs = _pack_docs(ids, per)
    chunk = xxhash.xxh64_intdigest(docs + sigs.tobytes()) - (1 << 63)
    rows = [_row(chunk % buckets.n, "docs", chunk, deltas(tied, 4) + plane(stands[tied], 4), docs, sigs.tobytes(), deltas(rest[later], 4))]
    del stands, rest, later, tied, firsts
    group = at[sent] // buckets.per
    by = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[by], np.arange(buckets.groups + 1))
    for g in np.flatnonzero(np.diff(cut)).tolist():
        own = sent[by[cut[g] : cut[g + 1]]]
        rows.append(_row(g, "new", 0, _segments(np.full(len(own), chunk)), deltas(owner[own], 8), _pack_hashes(a[own], b[own]), deltas(own, 4), plane(at[own] - g * buckets.per, 4) if buckets.per > 1 else b""))
    return rows


def _flatten(width: int, buckets: Buckets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.argsort(table.column(0).to_numpy(), kind="stable"))).combine_chunks()
            column = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in table.columns]
            rows = chunk_rows(column[0].to_numpy(), column[1].to_numpy(), column[2], width, buckets)
            if rows:
                yield _batch(rows)

        for batch in batches:
            step = max(1, batch.num_rows * CHUNK_TEXT // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += held[-1].nbytes
                if size >= CHUNK_TEXT:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


# --- merging --------------------------------------------------------------


def _new(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(a, b, id, chunk, position) of all windows of some rows, a column at a time and in the least width."""

    def column(field: str, read, kind: type) -> np.ndarray:
        parts = [read(r[field]).astype(kind, copy=False) for r in rows]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    a, b = column("hashes", lambda x: _unpack_hashes(x)[0], np.uint64), column("hashes", lambda x: _unpack_hashes(x)[1], np.uint16)
    return a, b, column("ids", lambda x: undeltas(x, 8), np.int64), column("segments", _unsegments, np.int64), column("gaps", lambda x: undeltas(x, 4), np.int32)


def _known(a: np.ndarray, b: np.ndarray, old_a: np.ndarray, old_b: np.ndarray) -> np.ndarray:
    """Which distinct pairs a sorted run has."""
    out = np.zeros(len(a), bool)
    at, k = np.arange(len(a)), np.searchsorted(old_a, a)
    while len(at):  # more than one step only for pairs that are equal in a alone
        fits = k < len(old_a)
        at, k = at[fits], k[fits]
        fits = old_a[k] == a[at]
        at, k = at[fits], k[fits]
        same = old_b[k] == b[at]
        out[at[same]] = True
        at, k = at[~same], k[~same] + 1
    return out


def _merge(keep: bool, compact: bool, replies: int):
    """Merge-joins one bucket of a batch with the runs; gives hits by chunk, and the bucket of the next run.

    With `replies` the hits of many chunks share a row, by that many groups of chunks.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, out = rows[0]["bucket"], [tuple(r[n] for n in _NAMES) for r in rows if r["kind"] == "docs"]
        runs = [_unpack_hashes(r["hashes"]) for r in rows if r["kind"] == "run"]
        a, b, ids, chunk, at = _new([r for r in rows if r["kind"] == "new"])
        del rows
        order, start = ordered(a, b)
        da, db = a[order[start]], b[order[start]]
        if len(order):
            del a, b
            ids = ids[order]
            first = np.minimum.reduceat(ids, start)
            for old in runs:
                first[_known(da, db, *old)] = _LEAST
            hit = np.empty(len(order), bool)
            hit[order] = ids > np.repeat(first, np.diff(np.append(start, len(order))))
            del order, start, ids, first
            out += _replies(bucket, chunk[hit], at[hit], replies)
            del chunk, at
        if keep:
            if compact and runs:
                a, b = np.concatenate([da, *[r[0] for r in runs]]), np.concatenate([db, *[r[1] for r in runs]])
                order, start = ordered(a, b)
                da, db = a[order[start]], b[order[start]]
            if len(da):
                out.append(_row(bucket, "run", hashes=_pack_hashes(da, db)))
        release_memory()
        return pa.Table.from_batches([_batch(out)] if out else [], pa.schema(zip(_NAMES, _TYPES, strict=True)))

    return run


def _replies(bucket: int, chunk: np.ndarray, at: np.ndarray, groups: int) -> list[tuple]:
    if not len(chunk):
        return []
    order = np.lexsort((at, chunk))
    chunk, at = chunk[order], at[order]
    key = chunk if not groups else chunk % groups
    if groups:
        order = np.argsort(key, kind="stable")
        chunk, at, key = chunk[order], at[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(cut[1:], len(key))
    return [_row(bucket, "hits" if groups else "hit", int(key[s]), _segments(chunk[s:e]) if groups else b"", gaps=deltas(at[s:e], 4)) for s, e in zip(cut.tolist(), ends.tolist(), strict=True)]


def _regrouped(rows: DataFrame, key: str, cut) -> DataFrame:
    """Packed rows of groups, shuffled by group and cut finer: a second shuffle of rows as large as the first's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == "docs":
                    yield _batch([tuple(r[n] for n in _NAMES)])
                    continue
                held.setdefault(r[key], []).append(r)
                sizes[r[key]] = sizes.get(r[key], 0) + len(r["hashes"]) + len(r["ids"]) + len(r["gaps"])
                if sum(sizes.values()) >= HELD_BYTES:
                    most = max(sizes, key=sizes.get)
                    yield _batch(cut(most, held.pop(most)))
                    del sizes[most]
        for group, own in held.items():
            yield _batch(cut(group, own))

    return rows.repartition(key).mapInArrow(run, _FLAT)


def _cut_buckets(buckets: Buckets):
    def cut(group: int, rows: list[dict]) -> list[tuple]:
        a, b, ids, chunk, at = _new(rows)
        bucket = group * buckets.per + np.concatenate([unplane(r["parts"], 4) for r in rows]).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out = []
        for s, e in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), strict=True):
            own = order[s:e]
            out.append(_row(int(bucket[own[0]]), "new", 0, _segments(chunk[own]), deltas(ids[own], 8), _pack_hashes(a[own], b[own]), deltas(at[own], 4)))
        return out

    return cut


def _cut_chunks(_: int, rows: list[dict]) -> list[tuple]:
    chunk, at = np.concatenate([_unsegments(r["segments"]) for r in rows]), np.concatenate([undeltas(r["gaps"], 4) for r in rows])
    return _replies(0, chunk, at, 0)


def _marks(table: pa.Table) -> pa.Table:
    """For each document of a chunk with hits: its id, signature and the runs (start, length) of repeated windows."""
    rows = table.to_pylist()
    docs = next(r for r in rows if r["kind"] == "docs")
    ids, per = _unpack_docs(docs["ids"])
    sigs = np.frombuffer(docs["hashes"], np.int64)
    hit = np.zeros(int(per.sum()), bool)
    for r in rows:
        if r["kind"] == "hit":
            hit[undeltas(r["gaps"], 4)] = True
    half = len(docs["segments"]) // 2
    tied = undeltas(docs["segments"][:half], 4)
    hit[tied] = hit[unplane(docs["segments"][half:], 4).astype(np.int64)]
    hit[undeltas(docs["gaps"], 4)] = True
    out: tuple[list, list, list] = ([], [], [])
    at = np.flatnonzero(hit)
    if len(at):
        begin = np.cumsum(per) - per
        doc = np.searchsorted(begin + per, at, "right")
        edge = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])))
        start = np.flatnonzero(edge)
        length, owner = np.diff(np.append(start, len(at))), doc[start]
        pairs = np.column_stack((at[start] - begin[owner], length)).astype(np.int32)
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for col, v in zip(out, (ids[owner[a]], sigs[owner[a]], pairs[a:b].tobytes()), strict=True):
                col.append(v)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["mark_id", "mark_sig", "marks"])


class FingerprintIndex:
    """Runs of the windows of all documents added so far. Ids must grow from batch to batch.

    With a folder the runs stay there, and an index opened on it later, with the same buckets, goes on from them.
    """

    def __init__(self, spark: SparkSession, buckets: int = LEAST_BUCKETS, width: int = WIDTH, fan_in: int = FAN_IN, fan: int = FAN, folder: str | None = None) -> None:
        self.spark, self.buckets, self.width, self.fan_in = spark, Buckets(buckets, fan), width, fan_in
        self.folder = folder and f"{folder.rstrip('/')}/width={width}/buckets={buckets}"
        self.runs: list[DataFrame] = [] if folder is None else [spark.read.parquet(p) for p in _tables(spark, self.folder)]

    def add(self, keyed: DataFrame, keep: bool = True) -> DataFrame:
        """Marks (mark_id, mark_sig, marks) of a batch of (order_id, sig, text); with `keep` the batch joins the index."""
        wide = self.buckets.per > 1
        rows = map_batches(keyed.select("order_id", "sig", "text"), _flatten(self.width, self.buckets), _FLAT)
        if wide:
            rows = _regrouped(rows, "bucket", _cut_buckets(self.buckets))
        for old in self.runs:
            rows = rows.unionByName(old)
        compact = keep and len(self.runs) + 1 >= self.fan_in
        found = written(rows.groupBy("bucket").applyInArrow(_merge(keep, compact, self.buckets.fan if wide else 0), _FLAT), "window-hits")
        if keep:
            run = found.where("kind = 'run'")
            if self.folder:
                run = written(run, "run", self.folder)
            if compact:
                _forget(self.spark, self.runs)
            self.runs = ([] if compact else self.runs) + [run]
        hits = found.where("kind = 'hit'")
        if wide:
            hits = _regrouped(found.where("kind = 'hits'"), "chunk", _cut_chunks)
        marks = found.where("kind = 'docs'").unionByName(hits).groupBy("chunk").applyInArrow(_marks, "mark_id long, mark_sig long, marks binary")
        return marks.dropDuplicates(["mark_id", "mark_sig"])


def _tables(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the finished tables of a folder, which need not exist."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listStatus(path) if system.exists(path) else []
    return sorted(str(f.getPath()) for f in found if system.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def _forget(spark: SparkSession, runs: list[DataFrame]) -> None:
    """Removes the runs that a compacted one replaces; one that stays behind by an accident does no harm."""
    from scorelattice.llm.common import _remove

    for run in runs:
        folders = {f.rsplit("/", 1)[0] for f in run.inputFiles()}
        for f in folders:
            if f.rsplit("/", 1)[1].startswith("run-"):
                _remove(spark, f)


def _remove_words(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                words, gone, marks = (text.as_py() or "").encode().split(), 0, marks.as_py()
                totals.append(len(words))
                if marks:
                    parts, at = [], 0
                    for start, length in np.frombuffer(marks, np.int32).reshape(-1, 2).tolist():
                        if start > at:
                            parts += words[at:start]
                        gone += start + length + width - 1 - max(at, start)
                        at = start + length + width - 1
                    words = parts + words[at:]
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, batch_ends: tuple[float, ...] = BATCH_ENDS, buckets: int | None = None, fan: int = FAN, folder: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row.

    With a folder the index is kept there, the last batch included.
    """
    spark, doc_id = docs.sparkSession, F.col("doc_id").cast("long")
    keyed = lambda df: df.select(order_key(F.col("doc_id")).alias("order_id"), F.xxhash64("text").alias("sig"), "text")
    shape = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx(doc_id, list(batch_ends[:-1]), 1000).alias("ends")).first()
    index = FingerprintIndex(spark, buckets or max(LEAST_BUCKETS, (shape["bytes"] or 0) // BUCKET_BYTES), width, fan=fan, folder=folder)
    bounds = [None, *sorted(set(shape["ends"] or [])), None]
    marks = None
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        batch = docs if hi is None else docs.where(doc_id <= hi)
        if lo is not None:  # documents without an id are in the last batch
            batch = batch.where(((doc_id > lo) | doc_id.isNull()) if hi is None else doc_id > lo)
        found = index.add(keyed(batch), keep=folder is not None or k < len(bounds) - 2)
        marks = found if marks is None else marks.unionByName(found)
    joined = keyed(docs).join(marks, (F.col("order_id") == F.col("mark_id")) & (F.col("sig") == F.col("mark_sig")), "left")
    real = F.when(F.col("order_id") != NO_ID, F.col("order_id")).alias("doc_id")
    return map_batches(joined.select(real, "text", "marks"), _remove_words(width), "doc_id long, n_words long, n_removed long, kept string")
