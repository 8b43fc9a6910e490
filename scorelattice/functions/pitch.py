"""Pitch arithmetic as column expressions. An absolute semitone is octave * 12 + pitch class."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the pitch classes, the semitone of each step, the orders of sharps and flats.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLAT_NAMES = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARPS, FLATS = "FCGDAEB", "BEADGCF"
LETTER_FIFTHS = {"C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F": -1}


def lookup(values: dict | tuple | list, key: Column) -> Column:
    """The value for a key of a small constant table, null if there is none."""
    pairs = values.items() if isinstance(values, dict) else enumerate(values)
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pitch_class(semitone: Column) -> Column:
    return F.pmod(semitone, F.lit(12))


def step_semitone(step: Column) -> Column:
    return lookup(STEPS, F.upper(step)).cast("long")


def absolute(step: Column, octave: Column, alter: Column) -> Column:
    return octave * 12 + step_semitone(step) + alter


def midi(step: Column, octave: Column, alter: Column) -> Column:
    return absolute(step, octave, alter) + 12


def pc_name(pc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NAMES]), (pc + 1).cast("int"))


def pc_bit(pc: Column) -> Column:
    """The pitch class as one bit of a 12-bit set."""
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(12)]), (pc + 1).cast("int"))


def rotated(pcs: Column, root: Column) -> Column:
    """Intervals of the pitch classes above the root, ascending."""
    return F.array_sort(F.transform(pcs, lambda p: F.pmod(p - root, F.lit(12))))


def key_root(fifths: Column) -> Column:
    return F.pmod(fifths * 7, F.lit(12))


def letter_fifths(letter: Column, accidental: Column, minor: Column) -> Column:
    """Fifths of a key letter: a sharp adds seven, a flat takes seven, minor takes three."""
    base = lookup(LETTER_FIFTHS, F.upper(letter))
    return base + F.when(accidental == "#", 7).when(accidental.isin("b", "♭"), -7).otherwise(0) + F.when(minor, -3).otherwise(0)


def fifths_shift(semitones: Column) -> Column:
    """Steps on the circle of fifths of a transposition, -5 to 6."""
    raw = F.pmod(semitones * 7, F.lit(12))
    return F.when(raw > 6, raw - 12).otherwise(raw)


def transposed_key(fifths: Column, semitones: Column) -> Column:
    """The new key, brought back to seven signs at most."""
    moved = fifths + fifths_shift(semitones)
    folded = F.when(moved > 7, moved - 12 * F.ceil((moved - 7) / 12)).when(moved < -7, moved + 12 * F.ceil((-7 - moved) / 12)).otherwise(moved)
    return F.when(semitones == 0, fifths).otherwise(folded)


def spelled(semitone: Column, fifths: Column) -> Column:
    """struct(step, octave, alter): keys without flats spell with sharps, the others with flats."""
    pc = pitch_class(semitone)
    name = F.when(fifths >= 0, pc_name(pc)).otherwise(F.element_at(F.array(*[F.lit(x) for x in FLAT_NAMES]), (pc + 1).cast("int")))
    alter = F.when(F.length(name) == 1, 0).when(fifths >= 0, 1).otherwise(-1)
    return F.struct(F.substring(name, 1, 1).alias("step"), F.floor(semitone / 12).alias("octave"), alter.cast("long").alias("alter"))


def transposed(step: Column, octave: Column, alter: Column, semitones: Column, new_fifths: Column) -> Column:
    """The pitch moved and spelled anew; a move by nothing keeps the spelling."""
    same = F.struct(F.upper(step).alias("step"), octave.cast("long").alias("octave"), alter.cast("long").alias("alter"))
    return F.when(semitones == 0, same).otherwise(spelled(absolute(step, octave, alter) + semitones, new_fifths))


def key_alter(step: Column, fifths: Column) -> Column:
    """What the key signature does to a step: 1, 0 or -1."""
    sharp, flat = F.instr(F.lit(SHARPS), F.upper(step)), F.instr(F.lit(FLATS), F.upper(step))
    return F.when((fifths > 0) & (sharp <= fifths), 1).when((fifths < 0) & (flat <= -fifths), -1).otherwise(0).cast("long")


def clamped_alter(alter: Column) -> Column:
    return F.greatest(F.lit(-2), F.least(F.lit(2), alter))


def half_up(value: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def units_of(letter: Column, div: Column) -> Column:
    """Units of a length letter g to n: powers of two at DIV 64, scaled and rounded elsewhere."""
    power = F.ascii(F.lower(letter)) - F.lit(ord("g"))
    return half_up(F.pow(F.lit(2.0), power) * div / 64)


def dotted(units: Column, dots: Column) -> Column:
    """Up to three dots: 1.5, 1.75 and 1.875 times, rounded."""
    factor = F.when(dots == 1, 1.5).when(dots == 2, 1.75).when(dots == 3, 1.875).otherwise(1.0)
    return half_up(units * factor)


def diatonic(step: Column, octave: Column) -> Column:
    """Place on the white keys: octave * 7 + step."""
    return octave * 7 + F.instr(F.lit("CDEFGAB"), F.upper(step)) - 1


def from_diatonic(place: Column) -> Column:
    at = F.pmod(place, F.lit(7)).cast("int")
    return F.struct(F.substring(F.lit("CDEFGAB"), at + 1, F.lit(1)).alias("step"), F.floor(place / 7).alias("octave"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive numbers, by as many of Euclid's steps as the smaller one can need."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))
    steps = F.ceil(1.45 * F.log2(F.least(F.abs(a), F.abs(b)) + 1)).cast("int") + 2
    found = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])
    return F.when(found == 0, 1).otherwise(found)


def first_of(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE WHEN over (condition, value) in order."""
    (first, value), *rest = pairs
    out = reduce(lambda c, p: c.when(p[0], p[1]), rest, F.when(first, value))
    return out if otherwise is None else out.otherwise(otherwise)
