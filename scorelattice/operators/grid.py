"""The part-by-measure grid: cells, consistency issues, alignment, padding, repeats."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.functions.pitch import let
from scorelattice.operators import folds

CELL = ("score_id", "measure_index", "part_idx")


def cell_lengths(notes: DataFrame) -> DataFrame:
    """length of each cell. Graces (a boolean column `grace`, if there is one) add nothing."""
    units = F.when(F.coalesce(F.col("grace"), F.lit(False)), 0).otherwise(F.col("units")) if "grace" in notes.columns else F.col("units")
    return notes.groupBy(*CELL).agg(F.sum(units).cast("long").alias("length"))


def duration_issues(cells: DataFrame, expected: Column) -> DataFrame:
    """A row for each cell that differs from the header, and one for each that differs from its measure's first cell.

    One cell may give both.
    """
    w = Window.partitionBy("score_id", "measure_index").orderBy("part_idx")
    both = cells.withColumn("reference", F.first("length").over(w)).withColumn("expected", expected.cast("long"))
    kinds = F.array_compact(F.array(F.when(F.col("length") != F.col("expected"), F.struct(F.lit("header").alias("against"), F.col("expected").alias("wanted"))), F.when(F.col("length") != F.col("reference"), F.struct(F.lit("part").alias("against"), F.col("reference").alias("wanted")))))
    return both.withColumn("issue", F.explode(kinds)).select(F.lit("measureDurationMismatch").alias("kind"), *CELL, "length", "issue.against", "issue.wanted")


def measure_counts(cells: DataFrame) -> DataFrame:
    """n_measures of each part: one more than its last measure index."""
    return cells.groupBy("score_id", "part_idx").agg((F.max("measure_index") + 1).cast("long").alias("n_measures"))


def count_issues(counts: DataFrame) -> DataFrame:
    """Parts with fewer measures than the longest part of their score."""
    most = F.max("n_measures").over(Window.partitionBy("score_id"))
    return counts.withColumn("most", most).where("n_measures <> most").select(F.lit("measureCountMismatch").alias("kind"), "score_id", "part_idx", "n_measures", "most")


def aligned_scores(counts: DataFrame) -> DataFrame:
    """Whether all parts of a score have the same number of measures."""
    return counts.groupBy("score_id").agg(F.count("*").alias("n_parts"), (F.min("n_measures") == F.max("n_measures")).alias("aligned"))


def padding(part_lengths: DataFrame, units_per_measure: Column) -> DataFrame:
    """Whole-measure rests that bring each part of a score to the longest, rounded up to a measure.

    part_lengths: score_id, part_idx, length. Single parts aren't padded. The last rest takes what is left.
    """
    w = Window.partitionBy("score_id")
    sized = part_lengths.withColumns({"upm": units_per_measure.cast("long"), "most": F.max("length").over(w), "n_parts": F.count("*").over(w)})
    sized = sized.withColumn("missing", (F.ceil(F.col("most") / F.col("upm")) * F.col("upm") - F.col("length")).cast("long")).where("n_parts > 1 and missing > 0")
    rests = F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1, F.col("upm")))
    return sized.withColumn("at", rests).select("score_id", "part_idx", (F.col("at") / F.col("upm")).cast("long").alias("rest_idx"), F.least("upm", F.col("missing") - F.col("at")).alias("units"), "missing")


def alignment(measures: DataFrame) -> DataFrame:
    """Every part at every measure number of its score; missing cells are filled, with the time in force.

    measures: score_id, part_idx, number, upm (null where a measure sets no time). The time carried is
    that of the measures before.
    """
    numbers = measures.select("score_id", "number").distinct()
    parts = measures.select("score_id", "part_idx").distinct()
    grid = numbers.join(parts, "score_id").join(measures.withColumn("present", F.lit(True)), ["score_id", "part_idx", "number"], "left")
    before = Window.partitionBy("score_id", "part_idx").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce("upm", F.last("upm", ignorenulls=True).over(before))
    return grid.select("score_id", "part_idx", "number", F.coalesce("present", F.lit(False)).alias("present"), carried.alias("upm"))


def numbered_twice(numbers: DataFrame) -> DataFrame:
    """Names of measures whose number was seen before in their part: n, n§1, n§2. Columns score_id, part_idx, pos, number."""
    k = F.row_number().over(Window.partitionBy("score_id", "part_idx", "number").orderBy("pos")) - 1
    return numbers.withColumn("seen", k).withColumn("name", F.when(F.col("seen") > 0, F.concat(F.col("number").cast("string"), F.lit("§"), F.col("seen").cast("string"))).otherwise(F.col("number").cast("string"))).drop("seen")


def number_order(name: Column) -> list[Column]:
    """Sort keys of measure names: the number, then the suffix, then the text."""
    return [F.regexp_extract(name, r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double").asc_nulls_last(), F.coalesce(F.regexp_extract(name, r"§(\d+)$", 1).try_cast("int"), F.lit(0)), name]


def expand_repeats(tokens: DataFrame, depth: int = 1) -> DataFrame:
    """Members of repeat groups as often as they are played.

    tokens: score_id, idx, and for each level k from 1 (innermost) a group id g{k} (null outside) and
    its count n{k}. Copies are ordered by the outer passes first.
    """
    out, order = tokens, []
    for k in range(depth, 0, -1):
        times = F.when(F.col(f"g{k}").isNull(), 1).otherwise(F.greatest(F.lit(1), F.floor(F.col(f"n{k}")))).cast("int")
        out = out.withColumn(f"pass{k}", F.explode(F.sequence(F.lit(1), times)))
        order += [f"first{k}", f"pass{k}"]
        out = out.withColumn(f"first{k}", F.when(F.col(f"g{k}").isNull(), F.col("idx")).otherwise(F.min("idx").over(Window.partitionBy("score_id", f"g{k}"))))
    at = F.row_number().over(Window.partitionBy("score_id").orderBy(*order, "idx")) - 1
    return out.withColumn("out_idx", at.cast("long")).drop(*order)


def tuplet_scale(members: DataFrame) -> DataFrame:
    """The smallest factor that makes every tuplet member of a score a whole number of units.

    members: score_id, target, total. The least common multiple of total / gcd(target, total), which
    doesn't depend on the order of the members.
    """
    from scorelattice.functions.pitch import gcd

    factors = members.select("score_id", "target", "total").distinct().withColumn("d", (F.col("total") / gcd(F.col("target"), F.col("total"))).cast("long"))
    lcm = lambda a, d: (a * d / gcd(a, d)).cast("long")
    return factors.groupBy("score_id").agg(F.collect_set("d").alias("ds")).select("score_id", F.aggregate("ds", F.lit(1).cast("long"), lcm).alias("scale"))


def last_clefs(changes: DataFrame) -> DataFrame:
    """The clef of each part: the last one that its tokens name. Columns score_id, part_idx, idx, clef."""
    return changes.where("clef is not null").groupBy("score_id", "part_idx").agg(F.max_by("clef", "idx").alias("clef"))


def first_tempo(tokens: DataFrame) -> DataFrame:
    """The first tempo of each score, by part and then by token. Columns score_id, part_idx, idx, bpm."""
    return tokens.where("bpm is not null").groupBy("score_id").agg(F.min_by("bpm", F.struct("part_idx", "idx")).alias("bpm"))


def inferred_clefs(notes: DataFrame) -> DataFrame:
    """The clef whose range the notes of a part leave least: treble 64 to 77, bass 43 to 57; treble on ties."""
    midi = F.col("abs_semitone") + 12
    out_of = lambda lo, hi: F.sum(F.greatest(F.lit(0), F.lit(lo) - midi, midi - F.lit(hi)))
    sums = notes.groupBy("score_id", "part_idx").agg(out_of(64, 77).alias("treble"), out_of(43, 57).alias("bass"))
    return sums.select("score_id", "part_idx", F.when(F.col("bass") < F.col("treble"), "BASS").otherwise("TREBLE").alias("clef"), F.least("treble", "bass").cast("long").alias("distance"))


def accidental_display(notes: DataFrame, fifths: Column) -> DataFrame:
    """show: whether a note's accidental is written, given the key and the notes before it in its measure.

    notes: score_id, part_idx, measure_index, seq, step, octave, alter. Exact while the key holds for a
    whole measure: after a note its own alteration is in force.
    """
    from scorelattice.functions.pitch import key_alter

    w = Window.partitionBy("score_id", "part_idx", "measure_index", "step", "octave").orderBy("seq")
    in_force = F.coalesce(F.lag("alter").over(w), key_alter(F.col("step"), fifths))
    return notes.withColumn("in_force", in_force.cast("long")).withColumn("show", F.col("alter") != F.col("in_force"))


def carried_alter(heads: DataFrame, fifths: Column) -> DataFrame:
    """alter of each head: its own accidental, else the last one of its place in the measure, else the key's.

    heads: score_id, part_idx, measure_index, x, tie, step, octave, explicit (null without an accidental).
    """
    from scorelattice.functions.pitch import key_alter

    w = Window.partitionBy("score_id", "part_idx", "measure_index", "step", "octave").orderBy("x", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("explicit", ignorenulls=True).over(w)
    source = F.when(F.col("explicit").isNotNull(), "explicit").when(carried.isNotNull(), "carried").otherwise("key")
    return heads.withColumn("alter", F.coalesce(carried, key_alter(F.col("step"), fifths)).cast("long")).withColumn("source", source)


_BUCKETS = "score_id long, part_idx long, seq long, piece long, measure_index long, at long, units long, tie_out boolean"


def bucketize(notes: DataFrame, units_per_measure: int) -> DataFrame:
    """Notes of a part poured into measures of a fixed length, in order.

    A note longer than what is left of the measure opens the next one; a note longer than a whole
    measure is split into tied pieces. A fold along one part, which bounds the memory of a task.
    """

    def pour(part: list) -> Iterator[tuple]:
        measure, used = 0, 0
        for order, row in enumerate(part):
            left, piece = row.units, 0
            while left > units_per_measure - used:
                room = units_per_measure - used
                if room > 0 and left > units_per_measure:
                    yield row.score_id, row.part_idx, order, piece, measure, used, room, True
                    left, piece = left - room, piece + 1
                measure, used = measure + 1, 0
            yield row.score_id, row.part_idx, order, piece, measure, used, left, False
            used += left
            if used >= units_per_measure:
                measure, used = measure + 1, 0

    return folds.by_key(notes.select("score_id", "part_idx", "measure_index", "seq", "units"), ["score_id", "part_idx"], ["measure_index", "seq"], pour, _BUCKETS)


def played_order(signs: Column, empty: Column, last: Column) -> Column:
    """Cells of a part in the order they are played, an array of indexes.

    signs: array of struct(cell, ends) of the repeat signs, sorted; empty: the indexes of empty cells;
    last: the last index. A repeat end plays again what follows the last start, or the first cell that
    isn't empty of all that was played so far; either way leading empty cells are skipped. Empty cells at
    both ends are dropped.
    """
    empty_cells = "array<long>"
    up_to = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast(empty_cells))

    def after_empty(order: Column) -> Column:
        first = F.array_position(F.transform(order, lambda c: F.array_contains(empty, c)), False)
        return F.when(first > 0, F.slice(order, first.cast("int"), F.size(order))).otherwise(F.array().cast(empty_cells))

    def step(acc: Column, sign: Column) -> Column:
        to = sign["cell"] - F.when(sign["ends"], 0).otherwise(1)
        order = F.concat(acc["order"], up_to(acc["next"], to))
        following = F.greatest(acc["next"], to + 1)
        again = let(order, lambda o: F.concat(o, after_empty(F.slice(o, acc["mark"] + 1, F.size(o)))))
        started = F.struct(order.alias("order"), F.size(order).alias("mark"), following.alias("next"))
        return F.when(sign["ends"], F.struct(again.alias("order"), F.lit(0).alias("mark"), following.alias("next"))).otherwise(started)

    start = F.struct(F.array().cast(empty_cells).alias("order"), F.lit(0).alias("mark"), F.lit(0).cast("long").alias("next"))
    order = F.aggregate(signs, start, step, lambda acc: F.concat(acc["order"], up_to(acc["next"], last)))
    trimmed = let(let(order, after_empty), lambda o: let(F.reverse(o), after_empty))
    return F.reverse(trimmed)


def expand_barline_repeats(cells: DataFrame) -> DataFrame:
    """Which cells are played in which order, given their repeat signs: score_id, part_idx, out_index, cell_index.

    cells: score_id, part_idx, cell_index, empty, starts, ends; a row for each cell from 0 on.
    """
    index = F.col("cell_index").cast("long")
    sign = lambda has, ends: F.collect_list(F.when(F.col(has), F.struct(index.alias("cell"), F.lit(ends).alias("ends"))))
    parts = cells.groupBy("score_id", "part_idx").agg(F.concat(sign("starts", False), sign("ends", True)).alias("signs"), F.collect_list(F.when(F.col("empty"), index)).alias("none"), F.max(index).alias("last"))
    order = parts.select("score_id", "part_idx", F.posexplode(played_order(F.array_sort("signs"), F.col("none"), F.col("last"))).alias("out_index", "cell_index"))
    return order.withColumn("out_index", F.col("out_index").cast("long"))


def pagination(measure_index: Column, usable_width: Column, measure_width: int = 200, margin: int = 60) -> Column:
    """The system a measure is drawn in: as many measures as fit side by side, at least one."""
    return F.floor(measure_index / F.greatest(F.lit(1), F.floor((usable_width - margin) / measure_width)))
