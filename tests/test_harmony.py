import re

import pytest
from pyspark.sql import functions as F

from scorelattice.functions import chord_tables
from scorelattice.functions.pitch import NAMES
from scorelattice.operators import harmony, voice_leading

STEP = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def semitone(name):
    step, sign, octave = re.fullmatch(r"([A-G])([#b]*)(\d)", name).groups()
    return int(octave) * 12 + STEP[step] + sign.count("#") - sign.count("b")


def mask_bass(text):
    tones = [semitone(x) for x in text.split()]
    return sum(1 << pc for pc in {t % 12 for t in tones}), min(tones) % 12


def basic_symbol(text):
    mask, bass = mask_bass(text)
    found = chord_tables.basic(mask, bass)
    return found and NAMES[found[0]] + found[1] + ("" if found[0] == bass else "/" + NAMES[bass])


@pytest.mark.parametrize(
    "pitches, symbol",
    [("C4 E4 G4", "Cmaj"), ("E3 G3 C4", "Cmaj/E"), ("C3 E4 A4", "Amin/C"), ("C4 E4 G#4", "Caug"), ("E4 G#4 C5", "Eaug"), ("C4 E4 G4 Bb4", "Cdom7"), ("B3 D4 F4 A4", "Bm7b5"), ("C4 Eb4 Gb4 A4", "Cdim7"), ("C4 Eb4 G4 B4", "CminMaj7"), ("C4 C#4 D4", None), ("C4 E4", None), ("C4", None), ("C4 D4 E4 F4 G4", None)],
)
def test_triads_and_sevenths(pitches, symbol):
    assert basic_symbol(pitches) == symbol


@pytest.mark.parametrize(
    "pitches, root, quality, confidence, more",
    [
        ("G2 A3 C4 E4", "C", "6", "ambiguous", {"alternatives": ((9, "min7"),)}),
        ("C3 E4 B4", "C", "maj7", "incomplete", {"omitted_fifth": True}),
        ("G2 D4 F4 A4", "D", "min", "likely", {"is_on": True}),
        ("C3 G3", "C", "maj", "incomplete", {}),
        ("C3 F3 G3", "C", "sus4", "ambiguous", {}),
        ("C3 E3 G3 B3 D4", "C", "maj7", "likely", {"inversion": 0}),
    ],
)
def test_extended_readings(pitches, root, quality, confidence, more):
    r = chord_tables.extended(*mask_bass(pitches))
    assert (NAMES[r.root], r.quality, r.confidence) == (root, quality, confidence)
    for k, v in more.items():
        assert getattr(r, k) == v


def test_no_reading_of_a_single_pitch_or_a_third():
    assert chord_tables.extended(*mask_bass("C4")) is None
    assert chord_tables.extended(*mask_bass("C4 E4")) is None


def voices(spark, *parts):
    rows = [(1, p, m, 0, semitone(x)) for p, line in enumerate(parts) for m, x in enumerate(line.split()) if x != "-"]
    return spark.createDataFrame(rows, "score_id long, part_idx long, measure_index long, seq long, abs_semitone long")


@pytest.mark.parametrize("a, b, kind", [("C5 D5", "F4 G4", "parallelFifths"), ("C5 D5", "C4 D4", "parallelOctaves"), ("C5 D5", "E4 G4", "directFifths"), ("D5 E5", "C4 E4", "directOctaves"), ("C5 D5", "F4 F4", None), ("C5 D5", "G4 F4", None)])
def test_parallels(spark, a, b, kind):
    found = voice_leading.parallels(voice_leading.transitions(voice_leading.representatives(voices(spark, a, b)))).collect()
    assert [r["kind"] for r in found] == ([kind] if kind else [])


def test_crossing_and_leaps(spark):
    notes = voices(spark, "C5 E4", "G4 G4")
    reps = voice_leading.representatives(notes)
    crossed = voice_leading.crossings(reps, notes.select("score_id", "part_idx").distinct()).collect()
    assert [(r["measure_index"], r["part_a"], r["part_b"]) for r in crossed] == [(1, 0, 1)]
    leap = lambda line: voice_leading.large_leaps(voice_leading.transitions(voice_leading.representatives(voices(spark, line)))).count()
    assert (leap("C4 C#5"), leap("C4 C5")) == (1, 0)


def test_a_missing_measure_breaks_a_transition(spark):
    assert voice_leading.transitions(voice_leading.representatives(voices(spark, "C5 - D5"))).count() == 0


def test_progression_prefers_falling_fifths(spark):
    alternatives = "array<struct<root:string,quality:string,absolute:string>>"
    rows = [(1, 0, "E", "min", "Em", "definite", [], 0), (1, 1, "C", "6", "C6", "ambiguous", [("A", "min7", "Am7")], 0), (1, 2, "D", "min", "Dm", "definite", [], 0)]
    df = spark.createDataFrame(rows, f"score_id long, measure_index long, root string, quality string, absolute string, confidence string, alternatives {alternatives}, fifths int")
    out = {r["measure_index"]: r for r in harmony.resolve_progression(df).collect()}
    assert (out[1]["root"], out[1]["confidence"], out[1]["resolved"]) == ("A", "likely", True)
    assert not out[0]["resolved"] and not out[2]["resolved"]


def test_degrees_follow_the_key(spark):
    mask, bass = mask_bass("G3 B3 D4")
    sets = spark.createDataFrame([(mask, bass)], "mask long, bass_pc long")
    assert harmony.extended_labels(sets, F.lit(0)).first()["combined"] == "Ⅴ/G"
    assert harmony.extended_labels(sets, F.lit(1)).first()["combined"] == "Ⅰ/G"
