"""Motion of voices from measure to measure.

notes: score_id, part_idx, measure_index, seq, abs_semitone. A voice's representative in a measure is
the lowest pitch of its first note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LARGE_LEAP = 12


def representatives(notes: DataFrame) -> DataFrame:
    """rep of each cell: a minimum over (seq, pitch), no sort."""
    least = F.min(F.struct("seq", "abs_semitone"))
    return notes.groupBy("score_id", "measure_index", "part_idx").agg(least.alias("m")).select("score_id", "measure_index", "part_idx", F.col("m.abs_semitone").alias("rep"))


def transitions(reps: DataFrame) -> DataFrame:
    """delta of each voice between measures that follow each other directly."""
    w = Window.partitionBy("score_id", "part_idx").orderBy("measure_index")
    paired = reps.withColumns({"to_measure": F.lead("measure_index").over(w), "next_rep": F.lead("rep").over(w)})
    paired = paired.where(F.col("to_measure") == F.col("measure_index") + 1)
    return paired.select("score_id", "part_idx", F.col("measure_index").alias("from_measure"), "to_measure", F.col("rep").alias("from_rep"), F.col("next_rep").alias("to_rep"), (F.col("next_rep") - F.col("rep")).alias("delta"))


def large_leaps(moves: DataFrame, limit: int = LARGE_LEAP) -> DataFrame:
    return moves.where(F.abs("delta") > limit)


def parallels(moves: DataFrame) -> DataFrame:
    """Parallel and direct fifths and octaves of every pair of voices that move the same way.

    Pairs of voices within one transition: an equi-join on the measure, and a few voices each.
    """
    key = ["score_id", "from_measure", "to_measure"]
    # voices that stand still can't take part: dropped before the join
    moving = moves.where("delta != 0").withColumn("up", F.col("delta") > 0)
    a = moving.select(*key, "up", F.col("part_idx").alias("part_a"), F.col("from_rep").alias("a0"), F.col("to_rep").alias("a1"))
    b = moving.select(*key, "up", F.col("part_idx").alias("part_b"), F.col("from_rep").alias("b0"), F.col("to_rep").alias("b1"))
    pairs = a.join(b, [*key, "up"]).where("part_a < part_b")
    before, after = F.pmod(F.abs(F.col("a0") - F.col("b0")), F.lit(12)), F.pmod(F.abs(F.col("a1") - F.col("b1")), F.lit(12))
    kind = F.when((after == 7) & (before == 7), "parallelFifths").when(after == 7, "directFifths").when((after == 0) & (before == 0), "parallelOctaves").when(after == 0, "directOctaves")
    return pairs.withColumn("kind", kind).where("kind is not null").select("kind", *key, "part_a", "part_b")


def crossings(reps: DataFrame, parts: DataFrame) -> DataFrame:
    """Neighbouring declared parts of which the upper one lies below the lower one.

    parts: score_id, part_idx of every declared part. A part that is silent breaks the pair.
    """
    order = Window.partitionBy("score_id").orderBy("part_idx")
    below = parts.select("score_id", "part_idx", F.lead("part_idx").over(order).alias("lower"))
    upper = reps.join(below, ["score_id", "part_idx"]).where("lower is not null")
    lower = reps.select("score_id", "measure_index", F.col("part_idx").alias("lower"), F.col("rep").alias("lower_rep"))
    return upper.join(lower, ["score_id", "measure_index", "lower"]).where("rep < lower_rep").select("score_id", "measure_index", F.col("part_idx").alias("part_a"), F.col("lower").alias("part_b"))
