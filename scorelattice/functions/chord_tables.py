"""Chord readings of pitch-class sets, as dimension tables.

A set of pitch classes is a 12-bit mask. The finite domain of (mask, bass in mask), 24,576 rows at
most, is classified once; classifying any number of chords is then a broadcast join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from scorelattice.functions.pitch import NAMES

# Intervals above the root of each quality, in the order of preference.
TRIADS = {"maj": (0, 4, 7), "min": (0, 3, 7), "dim": (0, 3, 6), "aug": (0, 4, 8)}
SEVENTHS = {"maj7": (0, 4, 7, 11), "dom7": (0, 4, 7, 10), "min7": (0, 3, 7, 10), "m7b5": (0, 3, 6, 10), "dim7": (0, 3, 6, 9), "minMaj7": (0, 3, 7, 11)}
TRIADS_EX = {"maj": (0, 4, 7), "min": (0, 3, 7), "sus4": (0, 5, 7), "sus2": (0, 2, 7), "dim": (0, 3, 6), "aug": (0, 4, 8)}
FOURS_EX = {"6": (0, 4, 7, 9), "m6": (0, 3, 7, 9), **SEVENTHS, "7sus4": (0, 5, 7, 10), "aug7": (0, 4, 8, 10), "add9": (0, 2, 4, 7), "madd9": (0, 2, 3, 7)}
PREFERRED = ("maj7", "dom7", "min7", "m7b5", "dim7", "minMaj7", "aug7")
DISPLAY = {"maj": "", "min": "m", "dim": "dim", "aug": "aug", "maj7": "M7", "dom7": "7", "min7": "m7", "m7b5": "m7b5", "dim7": "dim7", "minMaj7": "mM7", "sus4": "sus4", "sus2": "sus2", "6": "6", "m6": "m6", "7sus4": "7sus4", "aug7": "aug7", "add9": "add9", "madd9": "madd9"}
DEGREES = ("Ⅰ", "♭Ⅱ", "Ⅱ", "♭Ⅲ", "Ⅲ", "Ⅳ", "#Ⅳ", "Ⅴ", "♭Ⅵ", "Ⅵ", "♭Ⅶ", "Ⅶ")
DIATONIC = {0: ("maj", "maj7", "add9"), 2: ("min", "min7", "madd9"), 4: ("min", "min7"), 5: ("maj", "maj7", "add9"), 7: ("maj", "dom7"), 9: ("min", "min7", "madd9"), 11: ("dim", "m7b5")}

_shape = lambda intervals: sum(1 << i for i in intervals)
_BASIC = {_shape(v): k for k, v in (TRIADS | SEVENTHS).items()}
_EXTENDED = {_shape(v): k for k, v in (TRIADS_EX | FOURS_EX).items()}
_INTERVALS = TRIADS_EX | FOURS_EX


@dataclass(frozen=True)
class Reading:
    root: int
    quality: str
    bass: int
    inversion: int
    is_on: bool
    confidence: str
    omitted_fifth: bool = False
    alternatives: tuple[tuple[int, str], ...] = ()

    @property
    def absolute(self) -> str:
        own = NAMES[self.root] + DISPLAY[self.quality] + ("(o5)" if self.omitted_fifth else "")
        if self.root == self.bass:
            return own
        return f"{own}/{NAMES[self.bass]}" + ("" if self.is_on else str(self.inversion))


def members(mask: int) -> list[int]:
    return [pc for pc in range(12) if mask >> pc & 1]


def turned(mask: int, root: int) -> int:
    """The set as intervals above a root."""
    return (mask >> root | mask << (12 - root)) & 0xFFF


def roots(mask: int, bass: int) -> list[int]:
    """Candidate roots: the bass if it belongs to the set, then the others upwards."""
    return sorted(members(mask), key=lambda pc: (pc != bass, pc))


def exact(mask: int, bass: int, table: dict[int, str]) -> Iterator[tuple[int, str]]:
    """Every (root, quality) that the whole set spells, best first."""
    return ((r, q) for r in roots(mask, bass) if (q := table.get(turned(mask, r))))


def placed(root: int, quality: str, bass: int, confidence: str, **more) -> Reading:
    """A reading with its inversion: the place of the bass among the chord's intervals, or none."""
    intervals = _INTERVALS[quality]
    above = (bass - root) % 12
    return Reading(root, quality, bass, intervals.index(above) if above in intervals else 0, False, confidence, **more)


def without(mask: int, bass: int, size: int) -> Iterator[int]:
    """Subsets of a size that keep the bass; higher notes go first, at most two of them."""
    spare = [pc for pc in reversed(members(mask)) if pc != bass]
    drop = mask.bit_count() - size
    if drop == 1:
        yield from (mask & ~(1 << a) for a in spare)
    elif drop == 2:
        yield from (mask & ~(1 << a) & ~(1 << b) for a in spare for b in spare if a != b)


def _whole(mask: int, bass: int) -> Reading | None:
    found = list(exact(mask, bass, _EXTENDED)) if mask.bit_count() in (3, 4) else []
    if not found:
        return None
    rest = tuple(found[1:])
    return placed(*found[0], bass, "ambiguous" if rest else "definite", alternatives=rest)


def _reduced_to_four(mask: int, bass: int) -> Reading | None:
    if mask.bit_count() != 5:
        return None
    found = [placed(*best, bass, "likely") for sub in without(mask, bass, 4) if (best := next(exact(sub, bass, _EXTENDED), None))]
    rank = lambda r: 0 if r.inversion == 0 and r.quality in PREFERRED else 1 if r.inversion == 0 else 2
    return min(found, key=rank, default=None)


def _with_fifth(mask: int, bass: int) -> Reading | None:
    if mask.bit_count() != 3:
        return None
    for root in roots(mask, bass):
        fifth = 1 << (root + 7) % 12
        quality = None if mask & fifth else _EXTENDED.get(turned(mask | fifth, root))
        if quality:
            return placed(root, quality, bass, "incomplete", omitted_fifth=True)
    return None


def _over_bass(mask: int, bass: int) -> Reading | None:
    upper = mask & ~(1 << bass)
    if upper.bit_count() not in (3, 4):
        return None
    best = next(exact(upper, members(upper)[0], _EXTENDED), None)
    return best and Reading(*best, bass, 0, True, "likely")


def _reduced_to_three(mask: int, bass: int) -> Reading | None:
    if mask.bit_count() not in (4, 5):
        return None
    best = next((b for sub in without(mask, bass, 3) if (b := next(exact(sub, bass, _EXTENDED), None))), None)
    return best and placed(*best, bass, "likely")


def _power(mask: int, bass: int) -> Reading | None:
    if mask.bit_count() != 2:
        return None
    low, high = members(mask)
    if high - low != 7:
        return None
    return Reading(low, "maj", bass, 0 if bass == low else 1, False, "incomplete")


#: The cascade: the first that reads the set wins.
_CASCADE = (_whole, _reduced_to_four, _with_fifth, _over_bass, _reduced_to_three, _power)


@lru_cache(maxsize=None)
def extended(mask: int, bass: int) -> Reading | None:
    return next((r for f in _CASCADE if (r := f(mask, bass))), None)


def basic(mask: int, bass: int) -> tuple[int, str] | None:
    return next(exact(mask, bass, _BASIC), None)


def _sets() -> Iterator[tuple[int, int]]:
    return ((mask, bass) for mask in range(1, 1 << 12) for bass in members(mask))


def basic_table(spark: SparkSession) -> DataFrame:
    """mask, bass_pc, root, quality, bass, inverted, symbol of every set that is a triad or seventh."""
    rows = []
    for mask, bass in _sets():
        if found := basic(mask, bass):
            root, quality = found
            own = NAMES[root] + quality
            rows.append((mask, bass, NAMES[root], quality, NAMES[bass], root != bass, own if root == bass else f"{own}/{NAMES[bass]}"))
    return spark.createDataFrame(rows, "mask long, bass_pc long, root string, quality string, bass string, inverted boolean, symbol string")


def extended_table(spark: SparkSession) -> DataFrame:
    """mask, bass_pc and the reading of every set that has one; degrees depend on the key and are added later."""
    rows = []
    for mask, bass in _sets():
        if r := extended(mask, bass):
            alternatives = [(NAMES[a], q, replace(placed(a, q, bass, "")).absolute) for a, q in r.alternatives]
            rows.append((mask, bass, r.root, NAMES[r.root], r.quality, NAMES[bass], r.inversion, r.is_on, r.absolute, DISPLAY[r.quality], r.confidence, r.omitted_fifth, alternatives))
    return spark.createDataFrame(rows, "mask long, bass_pc long, root_pc long, root string, quality string, bass string, inversion int, is_on boolean, absolute string, display string, confidence string, omitted_fifth boolean, alternatives array<struct<root:string,quality:string,absolute:string>>")
