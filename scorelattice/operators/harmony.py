"""Chords of measures and of moments in time.

notes: score_id, part_idx, measure_index, seq, units, abs_semitone (and start, end for moments).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.functions import chord_tables
from scorelattice.functions.pitch import NAMES, key_root, lookup, pc_bit, pitch_class
from scorelattice.operators import folds

MEASURE = ("score_id", "measure_index")


def pitch_sets(notes: DataFrame, *keys: str) -> DataFrame:
    """The set of pitch classes (a 12-bit mask) and the lowest note of each group: one aggregation, no sort."""
    pc = pitch_class(F.col("abs_semitone"))
    return notes.groupBy(*keys).agg(F.bit_or(pc_bit(pc)).cast("long").alias("mask"), pitch_class(F.min("abs_semitone")).cast("long").alias("bass_pc"))


def pitch_classes(notes: DataFrame) -> DataFrame:
    """Distinct pitch classes of each measure, ascending, as text."""
    sets = notes.groupBy(*MEASURE).agg(F.array_sort(F.collect_set(pitch_class(F.col("abs_semitone")))).alias("set"))
    return sets.select(*MEASURE, F.array_join("set", ",").alias("pcs"), F.size("set").cast("long").alias("n_pcs"))


def measure_labels(notes: DataFrame) -> DataFrame:
    """Triads and sevenths of whole measures; measures that are none of them give no row."""
    table = F.broadcast(chord_tables.basic_table(notes.sparkSession))
    return pitch_sets(notes, *MEASURE).join(table, ["mask", "bass_pc"]).select(*MEASURE, "root", "quality", "bass", "inverted", "symbol")


def extended_labels(sets: DataFrame, fifths: Column) -> DataFrame:
    """sets (with mask, bass_pc) and their extended reading in a key; null where there is none."""
    table = F.broadcast(chord_tables.extended_table(sets.sparkSession))
    out = sets.join(table, ["mask", "bass_pc"], "left")
    degree = lookup(chord_tables.DEGREES, F.pmod(F.col("root_pc") - key_root(fifths), F.lit(12)).cast("int"))
    out = out.withColumn("degree", degree).withColumn("relative", F.concat("degree", "display"))
    return out.withColumn("combined", F.concat_ws("/", "relative", "absolute"))


def chord_name(absolute: Column, confidence: Column, alternatives: Column) -> Column:
    """The displayed name; an ambiguous chord shows its first alternative too."""
    return F.when((confidence == "ambiguous") & (F.size(alternatives) > 0), F.concat(absolute, F.lit("~"), F.get(alternatives, F.lit(0))["absolute"])).otherwise(absolute)


def is_diatonic(root_pc: Column, quality: Column, fifths: Column) -> Column:
    degree = F.pmod(root_pc - key_root(fifths), F.lit(12))
    out = F.lit(False)
    for d, own in chord_tables.DIATONIC.items():
        out = out | ((degree == d) & quality.isin(*own))
    return out


def onsets(notes: DataFrame) -> DataFrame:
    """notes with start and end: running sums within a cell; graces (if marked) advance like the others."""
    w = Window.partitionBy("score_id", "measure_index", "part_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("units").over(w), F.lit(0)).cast("long")
    return notes.withColumn("start", start).withColumn("end", (F.col("start") + F.col("units")).cast("long"))


def merge_ties(events: DataFrame) -> DataFrame:
    """Events (start, end, abs_semitone, tie) with tied equal pitches made one: islands within a cell."""
    w = Window.partitionBy("score_id", "measure_index", "part_idx").orderBy("start", "seq")
    goes_on = F.coalesce(F.lag("tie").over(w) & (F.lag("abs_semitone").over(w) == F.col("abs_semitone")), F.lit(False))
    island = F.sum(F.when(goes_on, 0).otherwise(1)).over(w)
    return events.withColumn("island", island).groupBy("score_id", "measure_index", "part_idx", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("abs_semitone").alias("abs_semitone")).drop("island")


def moment_sets(events: DataFrame, beat: int) -> DataFrame:
    """mask and bass_pc at every moment of each measure; mask 0 where nothing sounds.

    Moments are the beats and the note starts within a measure's length, which is that of its first part's
    cell. A note sounds where start <= moment < end. A measure's notes are few: they are gathered once, and
    lengths, moments and what sounds are read from them without another shuffle.
    """
    note = F.struct("part_idx", "start", "end", "units", "abs_semitone")
    measures = events.groupBy(*MEASURE).agg(F.collect_list(note).alias("notes"), F.min("part_idx").alias("first"))
    own = F.filter("notes", lambda n: n["part_idx"] == F.col("first"))
    length = F.aggregate(own, F.lit(0).cast("long"), lambda acc, n: acc + n["units"])
    measures = measures.withColumn("length", length).where("length > 0")
    beats = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(beat).cast("long"))
    starts = F.filter(F.transform("notes", lambda n: n["start"]), lambda s: s < F.col("length"))
    at = measures.select(*MEASURE, "notes", F.explode(F.array_distinct(F.concat(beats, starts))).alias("offset"))
    heard = F.transform(F.filter("notes", lambda n: (n["start"] <= F.col("offset")) & (n["end"] > F.col("offset"))), lambda n: n["abs_semitone"])
    at = at.select(*MEASURE, "offset", heard.alias("heard"))
    mask = F.aggregate("heard", F.lit(0), lambda acc, p: acc.bitwiseOR(pc_bit(pitch_class(p))))
    return at.select(*MEASURE, "offset", mask.cast("long").alias("mask"), pitch_class(F.array_min("heard")).cast("long").alias("bass_pc"))


def beat_chords(chords: DataFrame, beat: int) -> DataFrame:
    """The chord of each beat: that of its first moment."""
    return chords.withColumn("beat", F.floor(F.col("offset") / beat)).where(F.col("offset") == F.col("beat") * beat).drop("offset")


def segments(beats: DataFrame, beat: int) -> DataFrame:
    """Runs of beats with the same root, quality and bass (or none), with their length."""
    w = Window.partitionBy(*MEASURE).orderBy("beat")
    same = F.lit(True)
    for c in ("root", "quality", "bass"):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    island = F.sum(F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w)
    return beats.withColumn("segment", (island - 1).cast("long")).groupBy(*MEASURE, "segment").agg(F.first("root").alias("root"), F.first("quality").alias("quality"), F.first("bass").alias("bass"), (F.count("*") * beat).cast("long").alias("units"), F.min_by("name", "beat").alias("name") if "name" in beats.columns else F.min("beat").alias("first_beat"))


_PROGRESSION = "score_id long, measure_index long, root string, quality string, absolute string, confidence string, resolved boolean"


def resolve_progression(summaries: DataFrame) -> DataFrame:
    """Ambiguous chords settled by their neighbours, from left to right.

    summaries: one row a measure with root, quality, absolute, confidence, alternatives, fifths. The
    left neighbour counts as it was settled, the right one as it stands: a fold along one score.
    """

    place = {n: i for i, n in enumerate(NAMES)}
    motion = {5: 3, 7: 2, 2: 1, 10: 1}

    def fold(score: list) -> Iterator[tuple]:
        left = None
        for row in score:
            chosen, confidence = (row.root, row.quality, row.absolute), row.confidence
            options = [chosen, *[(a["root"], a["quality"], a["absolute"]) for a in row.alternatives or ()]]
            resolved = False
            if confidence == "ambiguous" and len(options) > 1 and (left or row.right):
                tonic = row.fifths * 7 % 12

                def fitness(option: tuple, row=row, left=left, tonic=tonic) -> int:
                    root = place[option[0]]
                    near = motion.get((root - place[left]) % 12, 0) if left else 0
                    far = motion.get((place[row.right] - root) % 12, 0) if row.right else 0
                    return near + far + (option[1] in chord_tables.DIATONIC.get((root - tonic) % 12, ()))

                best = max(options, key=fitness)  # the first of equals
                if best is not chosen and fitness(best) > 0:
                    chosen, confidence, resolved = best, "likely", True
            left = chosen[0]
            yield row.score_id, row.measure_index, *chosen, confidence, resolved

    right = F.lead("root").over(Window.partitionBy("score_id").orderBy("measure_index"))
    rows = summaries.select("score_id", "measure_index", "root", "quality", "absolute", "confidence", "alternatives", "fifths", right.alias("right"))
    return folds.by_key(rows, ["score_id"], ["measure_index"], fold, _PROGRESSION)


def chord_row(runs: DataFrame, summaries: DataFrame, div: Column) -> DataFrame:
    """score_id, row: the chord line of a score, a cell for each measure: the first chord's degree, then names with lengths.

    runs: segments with name and units; summaries: score_id, measure_index, relative (null without a chord).
    """
    from scorelattice.operators.durations import segment_letters

    shown = F.coalesce("name", F.lit("?"))
    words = F.array_join(F.transform(segment_letters(F.col("units"), div), lambda x: F.concat(shown, F.lit("_"), x)), " ")
    cells = runs.withColumn("words", words).groupBy(*MEASURE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "words"))), lambda x: x["words"]), " ").alias("words"))
    prefixed = cells.join(summaries.select(*MEASURE, "relative"), list(MEASURE), "left").withColumn("cell", F.concat(F.coalesce(F.concat("relative", F.lit("/ ")), F.lit("")), "words"))
    return prefixed.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("measure_index", "cell"))).alias("cs")).select("score_id", F.concat(F.lit("[C]| "), F.array_join(F.transform("cs", lambda c: c["cell"]), " | "), F.lit(" |")).alias("row"))
