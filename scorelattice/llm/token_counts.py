"""Edit-aware token counts.

A text is cut into pre-tokens; their characters and token counts are the leaves of a segment tree
whose inner nodes hold sums. An edit replaces a range of characters. Cutting is done again from a few
pre-tokens before the range until a cut falls on an old one after it; from there on nothing can
differ, since where a pre-token ends depends on what follows its start only. Only the new pre-tokens are
encoded, and the sums above the touched leaves are brought up to date.

Leaves hold blocks of pre-tokens, so that a block takes in what an edit adds; a block that grows too
large is split by building the tree anew.

Edge cases: null and empty texts have no pre-token and count 0; edits beyond the text's end act at
its end; edits of a null text insert into an empty one; repeated rows are counted each; other columns
are ignored. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.llm.common import map_batches

#: The vocabulary: a list of tokens and ranks. A parameter of every entry point; executors needn't have the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the public vocabulary was trained with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens before an edit that are cut again: a cut looks at most two pre-tokens ahead.
CONTEXT = 3
BLOCK = 64
MOST_CACHED, LONGEST_CACHED = 200_000, 24


class Encoder:
    """Token counts of pre-tokens, the short ones remembered."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST_CACHED:
                if len(self.known) >= MOST_CACHED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        get = self.known.get
        return [n if (n := get(p)) is not None else self.count(p) for p in pieces]


def vocabulary(path: str = VOCABULARY, spark: SparkSession | None = None) -> bytes:
    """The vocabulary's bytes, read by the driver, or by Spark where the path names a store. Tens of thousands of tokens: it travels with the tasks."""
    if "://" in path and spark is not None:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def encoder_of(data: bytes, pattern: str = PATTERN) -> Encoder:
    return Encoder(data, pattern)


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    return encoder_of(vocabulary(path), pattern)


class TokenTree:
    """The pre-tokens of one text under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, by: Encoder) -> None:
        self.by, self.encoded, self.rebuilt = by, 0, 0
        pieces = by.cut.findall(text)
        self._build(pieces, by.counts(pieces))

    def _build(self, pieces: list[str], tokens: list[int]) -> None:
        self.pieces = [pieces[i : i + BLOCK] for i in range(0, max(1, len(pieces)), BLOCK)]
        self.tokens = [tokens[i : i + BLOCK] for i in range(0, max(1, len(tokens)), BLOCK)]
        size = 1
        while size < len(self.pieces):
            size *= 2
        self.size = size
        sums = np.zeros((2 * size, 2), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        edges = np.arange(0, len(pieces), BLOCK)
        if len(pieces):
            sums[size : size + len(edges), 0] = np.add.reduceat(lengths, edges)
            sums[size : size + len(edges), 1] = np.add.reduceat(np.array(tokens, np.int64), edges)
        width = size
        while width > 1:
            sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2, 2).sum(axis=1)
            width //= 2
        self.sums = sums

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.pieces))

    def text(self) -> str:
        return "".join("".join(b) for b in self.pieces)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(block that holds character `at`, its first character), by descent."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def _update(self, block: int) -> None:
        node = block + self.size
        self.sums[node] = sum(map(len, self.pieces[block])), sum(self.tokens[block])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _step_back(self, block: int, k: int, at: int, steps: int) -> tuple[int, int, int]:
        """`steps` pre-tokens before pre-token k of the block, which begins at character `at`."""
        while steps:
            if k:
                k -= 1
                at -= len(self.pieces[block][k])
                steps -= 1
            elif block:
                block -= 1
                k = len(self.pieces[block])
            else:
                break
        return block, k, at

    def edit(self, start: int, end: int, insert: str) -> None:
        """Replaces characters start to end (exclusive) by `insert`."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if start == end and not insert:
            return
        block, at = self._leaf(start)
        k = 0
        while k < len(self.pieces[block]) and at + len(self.pieces[block][k]) <= start:
            at += len(self.pieces[block][k])
            k += 1
        block, k, at = self._step_back(block, k, at, CONTEXT)
        # old pre-tokens from there on, taken in as far as they are needed
        b, j, reach = block, k, at  # the next old pre-token is j of block b and begins at `reach`
        buffer = ""

        def take(n: int) -> None:
            nonlocal b, j, reach, buffer
            parts = []
            while b < len(self.pieces) and (reach < end or n > 0):
                if j >= len(self.pieces[b]):
                    b, j = b + 1, 0
                    continue
                parts.append(self.pieces[b][j])
                n -= 1
                reach += len(self.pieces[b][j])
                j += 1
            buffer += "".join(parts)

        take(0)
        while True:
            take(CONTEXT + 1)
            whole = b >= len(self.pieces) or not any(len(self.pieces[x]) - (j if x == b else 0) for x in range(b, len(self.pieces)))
            new = buffer[: start - at] + insert + buffer[end - at :]
            fresh = self.by.cut.findall(new)
            if whole:
                break
            # cuts of the new text that are old cuts too, with an old pre-token after them as context
            shift, ends, p = len(insert) - (end - start), {}, at
            for n, piece in enumerate(fresh):
                p += len(piece)
                ends[p] = n + 1
            old, limit, found = at, reach, None
            for x, y in self._between(block, k, b, j):
                old += len(self.pieces[x][y])
                if old >= end and old + shift in ends and old < limit and ends[old + shift] < len(fresh):
                    found = (old, ends[old + shift], x, y + 1)
                    break
            if found:
                _, n, b, j = found
                fresh = fresh[:n]
                break
        tokens = self.by.counts(fresh)
        self.encoded += len(fresh)
        if b >= len(self.pieces):
            b, j = len(self.pieces) - 1, len(self.pieces[-1])
        tail, tail_tokens = self.pieces[b][j:], self.tokens[b][j:]
        self.pieces[block] = self.pieces[block][:k] + fresh + (tail if b == block else [])
        self.tokens[block] = self.tokens[block][:k] + tokens + (tail_tokens if b == block else [])
        for x in range(block + 1, b):
            self.pieces[x], self.tokens[x] = [], []
            self._update(x)
        if b != block:
            self.pieces[b], self.tokens[b] = tail, tail_tokens
            self._update(b)
        self._update(block)
        if len(self.pieces[block]) > 4 * BLOCK:
            self.rebuilt += 1
            self._build([p for x in self.pieces for p in x], [t for x in self.tokens for t in x])

    def _between(self, block: int, k: int, b: int, j: int) -> Iterator[tuple[int, int]]:
        for x in range(block, min(b, len(self.pieces) - 1) + 1):
            first, last = (k if x == block else 0), (j if x == b else len(self.pieces[x]))
            for y in range(first, last):
                yield x, y


def count_tokens(docs: DataFrame, edits: DataFrame | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_tokens, n_edits, n_tokens_after, n_encoded of every row.

    edits has doc_id, seq, start, end, insert: they are applied in order of seq (then of the others),
    each to the text that the ones before it left. n_encoded counts the pre-tokens that the edits encoded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if edits is None:
        rows = rows.withColumn("edits", F.array().cast("array<struct<seq:long,start:long,end:long,insert:string>>"))
    else:
        one = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("seq", "long"), ("start", "long"), ("end", "long"), ("insert", "string"))])
        lists = edits.groupBy(F.col("doc_id").cast("long").alias("edited_id")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
        rows = rows.join(lists, F.col("doc_id") == F.col("edited_id"), "left").drop("edited_id")
    return apply_edits(rows, path)


def apply_edits(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """As count_tokens, over rows (doc_id, text, edits)."""

    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path, spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder_of(shared.value)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", by)
                before, edits = (tree.n_chars, tree.n_pieces, tree.n_tokens), edits.as_py() or []
                for e in edits:
                    tree.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["insert"] or "")
                for col, v in zip(out, (*before, len(edits), tree.n_tokens, tree.encoded), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out]], ["doc_id", "n_chars", "n_pieces", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    return map_batches(rows.select("doc_id", "text", "edits"), run, "doc_id long, n_chars long, n_pieces long, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")


def sample_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """rows (doc_id, text, edits): n edits of each text at places drawn by a hash of its id, for the query over whole tables."""
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    draw = lambda k, what: F.pmod(F.xxhash64("doc_id", F.lit(f"{what} {k}")), F.greatest(size, F.lit(1)).cast("long"))
    words = ("", " seven", "'ll", "\n\n  x", "été ", "42", ".")
    one = [F.struct(F.lit(k).cast("long").alias("seq"), draw(k, "start").alias("start"), (draw(k, "start") + F.pmod(F.xxhash64("doc_id", F.lit(f"length {k}")), F.lit(12))).alias("end"), F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("doc_id", F.lit(f"insert {k}")), F.lit(len(words))) + 1).cast("int")).alias("insert")) for k in range(n)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array(*one).alias("edits"))
