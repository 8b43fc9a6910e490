"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, a word's ends count as a
letter) of a language. A document's own most frequent n-grams are compared to each profile:
every n-gram adds the distance between its two ranks, or the full profile length if the
profile lacks it. The language with the smallest sum wins; ties go to the first in code-point order.

Edge cases: a null text, or one without a letter (Unicode L*), gets `und` with score 0. With no
profile at all (no labelled training row) every document is `und`. Repeated rows are each
predicted. Documents of any length are counted whole. Null languages are not learned.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelattice.llm.common import crc_bucket, dropped, map_batches, written

#: n-grams in a profile, and of a document that are ranked.
PROFILE = 400
#: About so many training documents a language, for callers that learn from fewer than all.
TRAIN_DOCS = 400
#: Characters whose n-grams are counted in one go, and distinct n-grams that a task holds before it hands them on.
COUNTED, HELD = 1 << 18, 1 << 20
#: Parts of the range of scores that are counted first to find a quantile.
SCORE_PARTS = 4096
#: Words of the excerpts that show how texts of each length score.
EXCERPTS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: A text is in no known language if it scores below this share of what this quantile of training texts of its length reaches.
FLOOR_QUANTILE, FLOOR_SHARE = 0.001, 0.9
#: Fewer training scores of a length also count those of the lengths beside it.
FLOOR_SCORES = 500
UNDETERMINED = "und"
_EDGE = np.int64(0x20)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether its category is L*."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _grams(points: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None] | None:
    """(codes, numbers) of the n-grams of lower-case code points, or None if none is a letter; a number is that of a letter of the n-gram."""
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, _EDGE)
    points = np.concatenate(([_EDGE], points, [_EDGE]))
    inside = points != _EDGE
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[:-1] |= inside[1:]
    points, inside = points[keep], inside[keep]
    both = inside[:-1] | inside[1:]  # not two edges of neighbouring words
    pairs = (points[:-1] << 21 | points[1:])[both]
    triples = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside[1:-1]]
    codes = np.concatenate((points[inside], pairs, triples))
    if number is not None:
        number = np.concatenate((number[:1], number, number[-1:]))[keep]
        number = np.concatenate((number[inside], np.where(inside[:-1], number[:-1], number[1:])[both], number[1:-1][inside[1:-1]]))
    return codes, number


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes, counts) of a text's n-grams, or None if it has no letter.

    A code holds up to three code points of 21 bits each.
    """
    found = _grams(_points(text)) if text else None
    if found is None:
        return None
    codes = np.sort(found[0])
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes)))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) with the counts of equal codes added up."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.add.reduceat(counts[order], at)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, most frequent first; ties by code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        sure = counts >= least
        codes, counts = codes[sure], counts[sure]
    return codes[np.lexsort((codes, -counts))][:n]


class Profiles:
    """Rank tables of the learned languages: small (languages x n-grams), so it travels with the tasks."""

    def __init__(self, ranks: dict[str, np.ndarray], size: int) -> None:
        self.langs, self.size = sorted(ranks), size
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *ranks.values()]))
        self.table = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.table[np.searchsorted(self.codes, ranks[lang]), k] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is how far below the greatest possible distance the best one lies."""
        return self.measured(text)[:2]

    def measured(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, length class); the class is the number of bits of the count of n-grams."""
        found = gram_counts(text)
        if found is None or not self.langs:
            return UNDETERMINED, 0.0, 0
        best, score = self._nearest(self._ranks(ranked(*found, self.size)))
        return self.langs[best], score, int(found[1].sum()).bit_length()

    def excerpts(self, text: str, sizes: tuple[int, ...] = EXCERPTS) -> list[tuple[float, int]]:
        """(score, length class) of the first so many words of a text, for each size below its number of words.

        As measured() gives them, from one encoding of the longest; excerpts without a letter are left out.
        """
        words = text.split(None, sizes[-1])
        sizes = [n for n in sizes if n < len(words)]
        if not sizes or not self.langs:
            return []
        points = _points(" ".join(words[: sizes[-1]]))
        found = _grams(points, np.cumsum(points == _EDGE))
        if found is None:
            return []
        order = np.argsort(found[1], kind="stable")
        codes, own = np.unique(found[0][order], return_inverse=True)
        ranks, out = self._ranks(codes), []
        for end in np.searchsorted(found[1][order], sizes).tolist():
            if end:
                counts = np.bincount(own[:end])
                at = np.flatnonzero(counts)
                at = at[np.argsort(-counts[at], kind="stable")][: self.size]
                out.append((self._nearest(ranks[at])[1], end.bit_length()))
        return out

    def _ranks(self, own: np.ndarray) -> np.ndarray:
        """Each code's rank in each language, -1 where it has none."""
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        return self.table[np.where(known, at, len(self.codes))]

    def _nearest(self, ranks: np.ndarray) -> tuple[int, float]:
        """(language, score) of n-grams, most frequent first, by their ranks."""
        place = np.arange(len(ranks))[:, None]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - place)).sum(axis=0)
        best = int(np.argmin(distance))
        return best, float(1 - distance[best] / (len(ranks) * self.size))


def _training_rows(docs: DataFrame, bucket: int) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id")) != bucket))


def _drawn(rows: DataFrame, per_language: int) -> DataFrame:
    """About so many rows of each language, chosen by a hash of the id."""
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return rows
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(draw < share[F.col("lang")])


def train(docs: DataFrame, bucket: int = 0, per_language: int | None = None, size: int = PROFILE) -> Profiles:
    """Profiles from all rows whose id's bucket isn't `bucket` and whose language is known.

    With `per_language` only about so many documents of each language are read, chosen by a hash of the id.
    """
    rows = _training_rows(docs, bucket)
    if per_language is not None:
        rows = _drawn(rows, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        total = 0
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for text in _joined(own):
                    if found := gram_counts(text):
                        held.setdefault(lang, []).append(found)
                        total += len(found[0])
                    if total > HELD:
                        held = {k: [summed(x)] for k, x in held.items()}
                        total = sum(len(x[0][0]) for x in held.values())
                        if total > HELD // 2:
                            yield from handed_on(held)
                            held, total = {}, 0
        yield from handed_on(held)

    def handed_on(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(codes)), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])

    counted = map_batches(rows.select("lang", "text"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the `size` best of each language, cut before they are brought together: bounded, whatever the corpus holds
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best: dict[str, list[tuple[int, int]]] = {}
    for r in counted.withColumn("place", place).where(F.col("place") <= size).collect():
        best.setdefault(r["lang"], []).append((r["place"], r["code"]))
    return Profiles({lang: np.array([code for _, code in sorted(own)], np.int64) for lang, own in best.items()}, size)


def _joined(texts: list[str]) -> Iterator[str]:
    """The texts with spaces between, COUNTED characters at a time, but longer texts whole: n-grams don't cross a space."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > COUNTED:
            yield " ".join(part)
            part, size = [], 0
        part.append(text)
        size += len(text)
    yield " ".join(part)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row; reads ids and texts only."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, lang_pred string, score double")


def floors(docs: DataFrame, profiles: Profiles, bucket: int = 0) -> np.ndarray:
    """The least score of a text in a known language, by length class, from all training rows and their first words.

    Short texts score lower than long ones, in a known language and out of one, so that each length has a floor of its own.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                lang, *own = profiles.measured(text)
                if lang != UNDETERMINED:
                    found += [own, *profiles.excerpts(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.float64())], ["length", "score"])

    scores = map_batches(_training_rows(docs, bucket).select("text"), measure, "length int, score double")
    low = low_scores(scores, FLOOR_QUANTILE)
    out = np.zeros(64)
    for at in range(64) if low else ():
        # outwards from the length, until there are scores enough
        near, n = [], 0
        for away in range(64):
            own = [low[k] for k in {at - away, at + away} if k in low]
            near += [x for x, _ in own]
            n += sum(m for _, m in own)
            if n >= FLOOR_SCORES:
                break
        out[at] = FLOOR_SHARE * min(near)
    return out


def low_scores(scores: DataFrame, share: float) -> dict[int, tuple[float, int]]:
    """For each length (the least score that `share` of its scores don't exceed, their number), from (length, score) rows.

    Exact: parts of the range of scores are counted first, then the scores of the part that holds the quantile. A score is a
    whole distance over one of PROFILE products, so a part has a bounded number of different ones, however many rows there are.
    """
    alike = written(scores.groupBy("length", "score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") * SCORE_PARTS)), "language-scores")
    parts: dict[int, list[tuple[float, int]]] = {}
    for r in alike.groupBy("length", "part").agg(F.sum("n").alias("n")).collect():
        parts.setdefault(r["length"], []).append((r["part"], r["n"]))
    totals = {length: sum(n for _, n in own) for length, own in parts.items()}
    held = {length: _reaching(own, share * totals[length]) for length, own in parts.items()}
    out: dict[int, tuple[float, int]] = {}
    if held:
        part = F.create_map(*[F.lit(x) for length, (k, _) in held.items() for x in (length, k)])
        near: dict[int, list[tuple[float, int]]] = {}
        for r in alike.where(F.col("part") == part[F.col("length")]).collect():
            near.setdefault(r["length"], []).append((r["score"], r["n"]))
        out = {length: (_reaching(own, share * totals[length] - held[length][1])[0], totals[length]) for length, own in near.items()}
    dropped(alike)
    return out


def _reaching(counted: list[tuple[float, int]], wanted: float) -> tuple[float, int]:
    """(the least value with which the counts of it and all smaller ones reach what is wanted, the count of the smaller ones)."""
    below = 0
    for value, n in sorted(counted):
        if below + n >= wanted:
            break
        below += n
    else:  # by a rounding
        below -= n
    return value, below


def keep_known(docs: DataFrame, profiles: Profiles, least: np.ndarray) -> DataFrame:
    """The rows of docs whose language is determined with at least the score of their length class, unchanged."""
    at = docs.columns.index("text")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.measured(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x[0] != UNDETERMINED and x[1] >= least[x[2]] for x in found], pa.bool_()))

    return map_batches(docs, known, docs.schema)


def with_fold(predicted: DataFrame) -> DataFrame:
    return predicted.select("doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
