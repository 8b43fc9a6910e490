"""Queries on the grid: lengths, counts, padding, alignment, accidentals, clefs, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.catalog import query
from scorelattice.functions.pitch import spelled
from scorelattice.operators import durations, grid
from scorelattice.plans.bridge import NOTES_SQL, notes

EXPECTED = 64
_CELLS_SQL = "cells AS (SELECT score_id, measure_index, part_idx, CAST(sum(units) AS BIGINT) AS length FROM notes GROUP BY ALL)"
_COUNTS_SQL = "counts AS (SELECT score_id, part_idx, max(measure_index) + 1 AS n_measures FROM notes GROUP BY ALL)"


@query(f"""WITH {NOTES_SQL}, {_CELLS_SQL},
referred AS (SELECT *, first_value(length) OVER (PARTITION BY score_id, measure_index ORDER BY part_idx) AS reference FROM cells)
SELECT 'measureDurationMismatch' AS kind, score_id, measure_index, part_idx, length, 'header' AS against, CAST({EXPECTED} AS BIGINT) AS wanted FROM referred WHERE length <> {EXPECTED}
UNION ALL SELECT 'measureDurationMismatch', score_id, measure_index, part_idx, length, 'part', reference FROM referred WHERE length <> reference""")
def cell_duration_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.duration_issues(grid.cell_lengths(notes(spark, sf_dir)), F.lit(EXPECTED))


@query(f"""WITH {NOTES_SQL}, {_COUNTS_SQL}, most AS (SELECT *, max(n_measures) OVER (PARTITION BY score_id) AS most FROM counts)
SELECT 'measureCountMismatch' AS kind, * FROM most WHERE n_measures <> most""")
def measure_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.count_issues(grid.measure_counts(notes(spark, sf_dir)))


@query(f"""WITH {NOTES_SQL}, {_COUNTS_SQL}
SELECT score_id, count(*) AS n_parts, min(n_measures) = max(n_measures) AS aligned FROM counts GROUP BY ALL""")
def score_alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.aligned_scores(grid.measure_counts(notes(spark, sf_dir)))


@query(f"""WITH {NOTES_SQL},
lengths AS (SELECT score_id, part_idx, CAST(sum(units) AS BIGINT) AS length FROM notes GROUP BY ALL),
sized AS (SELECT *, CAST(ceil(max(length) OVER (PARTITION BY score_id) / {EXPECTED}.0) * {EXPECTED} AS BIGINT) - length AS missing, count(*) OVER (PARTITION BY score_id) AS n FROM lengths)
SELECT score_id, part_idx, CAST(i AS BIGINT) AS rest_idx, least({EXPECTED}, missing - i * {EXPECTED}) AS units, missing
FROM sized, unnest(range(0, CAST(ceil(missing / {EXPECTED}.0) AS BIGINT))) AS r(i) WHERE n > 1 AND missing > 0""")
def part_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = notes(spark, sf_dir).groupBy("score_id", "part_idx").agg(F.sum("units").alias("length"))
    return grid.padding(lengths, F.lit(EXPECTED))


@query(f"""WITH {NOTES_SQL},
measures AS (SELECT DISTINCT score_id, part_idx, measure_index AS number, CASE WHEN (score_id + measure_index) % 3 = 0 THEN 32 + 16 * (measure_index % 4) END AS upm FROM notes),
grid AS (SELECT n.score_id, p.part_idx, n.number, m.number IS NOT NULL AS present, m.upm FROM (SELECT DISTINCT score_id, number FROM measures) n
  JOIN (SELECT DISTINCT score_id, part_idx FROM measures) p USING (score_id) LEFT JOIN measures m ON m.score_id = n.score_id AND m.part_idx = p.part_idx AND m.number = n.number)
SELECT score_id, part_idx, number, present, CAST(coalesce(last_value(upm IGNORE NULLS) OVER (PARTITION BY score_id, part_idx ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {EXPECTED}) AS BIGINT) AS upm FROM grid""")
def measure_alignment_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("measure_index")
    upm = F.when((F.col("score_id") + number) % 3 == 0, 32 + 16 * (number % 4))
    measures = notes(spark, sf_dir).select("score_id", "part_idx", number.alias("number"), upm.alias("upm")).distinct()
    out = grid.alignment(measures)
    return out.withColumn("upm", F.coalesce("upm", F.lit(EXPECTED)).cast("long"))


_SPELLED_SQL = """spelled AS (SELECT *, score_id % 15 - 7 AS fifths, CASE WHEN score_id % 2 = 0 THEN ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(abs_semitone % 12 + 1 AS INT)] ELSE ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'][CAST(abs_semitone % 12 + 1 AS INT)] END AS name, abs_semitone // 12 AS octave FROM notes),
stepped AS (SELECT *, name[1:1] AS step, CASE WHEN len(name) = 1 THEN 0 WHEN name[2:2] = '#' THEN 1 ELSE -1 END AS alter FROM spelled),
signed AS (SELECT *, CASE WHEN fifths > 0 AND instr('FCGDAEB', step) <= fifths THEN 1 WHEN fifths < 0 AND instr('BEADGCF', step) <= -fifths THEN -1 ELSE 0 END AS by_key FROM stepped)"""


def _spelled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = spelled(F.col("abs_semitone"), F.when(F.col("score_id") % 2 == 0, 0).otherwise(-1))
    return notes(spark, sf_dir).withColumn("p", name).select("*", "p.step", "p.octave", "p.alter").drop("p")


@query(f"""WITH {NOTES_SQL}, {_SPELLED_SQL},
forced AS (SELECT *, coalesce(lag(alter) OVER (PARTITION BY score_id, part_idx, measure_index, step, octave ORDER BY seq), by_key) AS in_force FROM signed)
SELECT score_id, part_idx, measure_index, seq, step, CAST(octave AS BIGINT) AS octave, CAST(alter AS BIGINT) AS alter, CAST(in_force AS BIGINT) AS in_force, alter <> in_force AS show FROM forced""")
def accidental_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.accidental_display(_spelled_notes(spark, sf_dir), F.col("score_id") % 15 - 7)
    return out.select("score_id", "part_idx", "measure_index", "seq", "step", "octave", "alter", "in_force", "show")


@query(f"""WITH {NOTES_SQL}, {_SPELLED_SQL},
heads AS (SELECT *, CASE WHEN units % 3 = 0 THEN alter END AS explicit FROM signed),
carried AS (SELECT *, last_value(explicit IGNORE NULLS) OVER (PARTITION BY score_id, part_idx, measure_index, step, octave ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM heads)
SELECT score_id, part_idx, measure_index, seq, step, CAST(octave AS BIGINT) AS octave, CAST(coalesce(c, by_key) AS BIGINT) AS alter, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN c IS NOT NULL THEN 'carried' ELSE 'key' END AS source FROM carried""")
def accidental_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _spelled_notes(spark, sf_dir).withColumns({"explicit": F.when(F.col("units") % 3 == 0, F.col("alter")), "x": F.col("seq"), "tie": F.col("seq")}).drop("alter")
    return grid.carried_alter(heads, F.col("score_id") % 15 - 7).select("score_id", "part_idx", "measure_index", "seq", "step", "octave", "alter", "source")


@query(f"""WITH {NOTES_SQL},
copies AS (SELECT score_id, part_idx, measure_index, seq, k, abs_semitone FROM notes, unnest(range(1, 2 + part_idx % 3)) AS r(k))
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY part_idx, k, measure_index, seq) - 1 AS BIGINT) AS out_idx, abs_semitone FROM copies""")
def repeat_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a repeat group, played 1 + part % 3 times."""
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.partitionBy("score_id").orderBy("part_idx", "measure_index", "seq")) - 1
    tokens = notes(spark, sf_dir).withColumns({"idx": order.cast("long"), "g1": F.col("part_idx"), "n1": 1 + F.col("part_idx") % 3})
    return grid.expand_repeats(tokens).select("score_id", "out_idx", "abs_semitone")


@query(f"""WITH RECURSIVE {NOTES_SQL},
factors AS (SELECT DISTINCT score_id, (2 + part_idx) // gcd(units, 2 + part_idx) AS d FROM notes),
ordered AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY d) AS rn FROM factors),
folded AS (SELECT score_id, rn, d AS scale FROM ordered WHERE rn = 1 UNION ALL SELECT f.score_id, o.rn, lcm(f.scale, o.d) FROM folded f JOIN ordered o ON o.score_id = f.score_id AND o.rn = f.rn + 1)
SELECT score_id, CAST(max(scale) AS BIGINT) AS scale FROM folded GROUP BY score_id""")
def tuplet_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tuplet_scale(notes(spark, sf_dir).select("score_id", F.col("units").alias("target"), (2 + F.col("part_idx")).alias("total")))


@query(f"""WITH {NOTES_SQL},
sums AS (SELECT score_id, part_idx, sum(greatest(0, 64 - abs_semitone - 12, abs_semitone + 12 - 77)) AS treble, sum(greatest(0, 43 - abs_semitone - 12, abs_semitone + 12 - 57)) AS bass FROM notes GROUP BY ALL)
SELECT score_id, part_idx, CASE WHEN bass < treble THEN 'BASS' ELSE 'TREBLE' END AS clef, CAST(least(treble, bass) AS BIGINT) AS distance FROM sums""")
def clef_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.inferred_clefs(notes(spark, sf_dir))


@query(f"""WITH {NOTES_SQL},
changes AS (SELECT score_id, part_idx, measure_index * 1000 + seq AS idx, CASE WHEN abs_semitone % 5 = 0 THEN ['TREBLE','BASS','ALTO'][CAST(units % 3 + 1 AS INT)] END AS clef FROM notes)
SELECT score_id, part_idx, arg_max(clef, idx) AS clef FROM changes WHERE clef IS NOT NULL GROUP BY ALL""")
def last_clef(spark: SparkSession, sf_dir: str) -> DataFrame:
    clef = F.when(F.col("abs_semitone") % 5 == 0, F.element_at(F.array(F.lit("TREBLE"), F.lit("BASS"), F.lit("ALTO")), (F.col("units") % 3 + 1).cast("int")))
    return grid.last_clefs(notes(spark, sf_dir).select("score_id", "part_idx", (F.col("measure_index") * 1000 + F.col("seq")).alias("idx"), clef.alias("clef")))


@query(f"""WITH {NOTES_SQL}
SELECT score_id, arg_min(units * 5 + 40, part_idx * 1000000 + measure_index * 1000 + seq) AS bpm FROM notes WHERE abs_semitone % 7 = 0 GROUP BY ALL""")
def first_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpm = F.when(F.col("abs_semitone") % 7 == 0, F.col("units") * 5 + 40)
    return grid.first_tempo(notes(spark, sf_dir).select("score_id", "part_idx", (F.col("measure_index") * 1000 + F.col("seq")).alias("idx"), bpm.alias("bpm")))


#: Notes of queue (score_id, part_idx, seq from 0, units) poured into measures: out_seq, out_piece, measure_index, begin_at, units, tie_out.
POUR_SQL = f"""pour AS (
  SELECT score_id, part_idx, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS piece, units AS due, CAST(0 AS BIGINT) AS measure, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS begin_at, CAST(NULL AS BIGINT) AS units, false AS tie_out, CAST(0 AS BIGINT) AS measure_index, CAST(0 AS BIGINT) AS out_seq, CAST(0 AS BIGINT) AS out_piece FROM queue WHERE seq = 0
  UNION ALL SELECT score_id, part_idx, CASE WHEN fits THEN seq + 1 ELSE seq END, CASE WHEN fits THEN 0 WHEN splits THEN piece + 1 ELSE piece END,
    CASE WHEN fits THEN next_units WHEN splits THEN due - room ELSE due END, CASE WHEN fits AND used + due < {EXPECTED} THEN measure ELSE measure + 1 END, CASE WHEN fits AND used + due < {EXPECTED} THEN used + due ELSE 0 END,
    CASE WHEN fits OR splits THEN used END, CASE WHEN fits THEN due WHEN splits THEN room END, splits, measure, seq, piece
  FROM (SELECT p.* EXCLUDE (begin_at, units, tie_out, measure_index, out_seq, out_piece), {EXPECTED} - used AS room, due <= {EXPECTED} - used AS fits, due > {EXPECTED} - used AND used < {EXPECTED} AND due > {EXPECTED} AS splits, q.units AS next_units
    FROM pour p LEFT JOIN queue q ON q.score_id = p.score_id AND q.part_idx = p.part_idx AND q.seq = p.seq + 1 WHERE due IS NOT NULL)),
poured AS (SELECT * FROM pour WHERE begin_at IS NOT NULL)"""


@query(f"""WITH RECURSIVE {NOTES_SQL},
queue AS (SELECT score_id, part_idx, row_number() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index, seq) - 1 AS seq, units * CASE WHEN abs_semitone % 5 = 0 THEN 6 ELSE 1 END AS units FROM notes),
{POUR_SQL}
SELECT score_id, part_idx, out_seq AS seq, out_piece AS piece, measure_index, begin_at AS "at", units, tie_out FROM poured""")
def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part poured into measures; a fifth of the notes are made long, so that they are split."""
    return grid.bucketize(notes(spark, sf_dir).withColumn("units", F.col("units") * F.when(F.col("abs_semitone") % 5 == 0, 6).otherwise(1)), EXPECTED)


@query(f"""WITH RECURSIVE {NOTES_SQL},
cells AS (SELECT score_id, part_idx, row_number() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index) - 1 AS cell, min(abs_semitone) % 3 = 0 AS empty, max(abs_semitone) % 4 = 0 AS starts, min(abs_semitone) % 5 = 0 AS ends FROM notes GROUP BY score_id, part_idx, measure_index),
parts AS (SELECT score_id, part_idx, coalesce(list(cell) FILTER (empty), []) AS none FROM cells GROUP BY ALL),
play AS (
  SELECT score_id, part_idx, CAST(-1 AS BIGINT) AS cell, CAST([] AS BIGINT[]) AS played, 0 AS mark FROM parts
  UNION ALL SELECT score_id, part_idx, cell, CASE WHEN ends THEN list_concat(so_far, coalesce(again[list_position(list_transform(again, lambda c: list_contains(none, c)), false):], [])) ELSE so_far END, CASE WHEN ends THEN 0 ELSE mark END
  FROM (SELECT *, so_far[mark + 1:] AS again FROM (SELECT c.score_id, c.part_idx, c.cell, c.ends, x.none, list_append(p.played, c.cell) AS so_far, CASE WHEN c.starts THEN len(p.played) ELSE p.mark END AS mark
    FROM play p JOIN cells c ON c.score_id = p.score_id AND c.part_idx = p.part_idx AND c.cell = p.cell + 1 JOIN parts x ON x.score_id = p.score_id AND x.part_idx = p.part_idx))),
final AS (SELECT p.*, none, list_transform(played, lambda c: list_contains(none, c)) AS gaps FROM play p JOIN parts x USING (score_id, part_idx)
  WHERE cell = (SELECT max(cell) FROM cells c WHERE c.score_id = p.score_id AND c.part_idx = p.part_idx)),
cut AS (SELECT score_id, part_idx, played[list_position(gaps, false):len(gaps) - list_position(list_reverse(gaps), false) + 1] AS played FROM final WHERE list_contains(gaps, false))
SELECT score_id, part_idx, CAST(i - 1 AS BIGINT) AS out_index, played[i] AS cell_index FROM cut, unnest(range(1, len(played) + 1)) AS r(i)""")
def grid_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every part in played order; the signs, and which cells are empty, come from the notes."""
    from pyspark.sql.window import Window

    low, high = F.min("abs_semitone"), F.max("abs_semitone")
    cells = notes(spark, sf_dir).groupBy("score_id", "part_idx", "measure_index").agg((low % 3 == 0).alias("empty"), (high % 4 == 0).alias("starts"), (low % 5 == 0).alias("ends"))
    index = F.row_number().over(Window.partitionBy("score_id", "part_idx").orderBy("measure_index")) - 1
    return grid.expand_barline_repeats(cells.withColumn("cell_index", index))


_LETTERS_SQL = ", ".join(f"({k}, '{c}', {u})" for k, (c, u) in enumerate(durations.LETTERS.items()))


@query(f"""WITH RECURSIVE {NOTES_SQL},
asked AS (SELECT DISTINCT units * 3 + seq AS units, div FROM notes, (VALUES (16), (64), (96)) AS d(div)),
letters(place, letter, at64) AS (VALUES {_LETTERS_SQL}),
bases AS (SELECT place, letter, div, floor(at64 * div / 64.0 + 0.5) AS base FROM letters, (VALUES (16), (64), (96)) AS d(div)),
lengths AS (SELECT place, div, base, dots, letter || repeat('.', dots) AS name, CAST(floor(base * factor + 0.5) AS BIGINT) AS len FROM bases, (VALUES (0, 1.0), (1, 1.5), (2, 1.75), (3, 1.875)) AS x(dots, factor) WHERE base > 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY div ORDER BY len DESC, place, dots DESC) AS rn FROM lengths WHERE len > 0),
greedy AS (SELECT units, div, CAST(0 AS BIGINT) AS rn, units AS rest, CAST([] AS VARCHAR[]) AS chain FROM asked
  UNION ALL SELECT units, g.div, o.rn, rest - (rest // len) * len, list_concat(chain, list_resize([name], rest // len, name)) FROM greedy g JOIN ordered o ON o.div = g.div AND o.rn = g.rn + 1),
chains AS (SELECT units, div, chain FROM greedy WHERE rn = (SELECT max(rn) FROM ordered o WHERE o.div = greedy.div)),
singles AS (SELECT a.units, a.div, arg_min(name, CASE WHEN dots = 0 THEN place ELSE 100 + 10 * place + dots END) AS single FROM asked a JOIN lengths l ON l.div = a.div AND l.len = a.units GROUP BY ALL)
SELECT c.units, c.div, array_to_string(chain, ' ') AS chain, single, coalesce('R' || single, array_to_string(list_transform(chain, lambda x: 'R' || x), ' ')) AS rests FROM chains c LEFT JOIN singles s ON s.units = c.units AND s.div = c.div""")
def duration_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written lengths of every sounding length in the table, at three divisions."""
    units = notes(spark, sf_dir).select((F.col("units") * 3 + F.col("seq")).alias("units")).distinct()
    return durations.decompose(units.withColumn("div", F.explode(F.array(F.lit(16), F.lit(64), F.lit(96)))))


@query(f"""WITH {NOTES_SQL},
scored AS (SELECT score_id, measure_index, part_idx, min((abs_semitone - 36) / 48.0 + 0.02 * units / 32.0) AS confidence, sum(units) <> {EXPECTED} AND sum(units) % 3 = 0 AS mismatch FROM notes GROUP BY ALL)
SELECT score_id, measure_index, part_idx, CASE WHEN mismatch THEN 'low' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.55 THEN 'mid' ELSE 'low' END AS bin FROM scored""")
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelattice.operators.assembly import confidence_bin

    value = (F.col("abs_semitone") - 36) / F.lit(48.0) + F.lit(0.02) * F.col("units") / F.lit(32.0)
    scored = notes(spark, sf_dir).groupBy("score_id", "measure_index", "part_idx").agg(F.min(value).alias("confidence"), ((F.sum("units") != EXPECTED) & (F.sum("units") % 3 == 0)).alias("mismatch"))
    return scored.select("score_id", "measure_index", "part_idx", confidence_bin(F.col("confidence"), F.col("mismatch")).alias("bin"))
