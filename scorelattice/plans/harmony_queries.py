"""Queries on chords, time and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.catalog import query
from scorelattice.functions import chord_tables
from scorelattice.functions.pitch import NAMES, key_root, letter_fifths, spelled, transposed, transposed_key
from scorelattice.operators import harmony, voice_leading
from scorelattice.plans.bridge import NOTES_SQL, notes

BEAT = 16
_NAMES_SQL = "[" + ",".join(f"'{n}'" for n in NAMES) + "]"


def _templates_sql(table: dict[str, tuple[int, ...]], name: str) -> str:
    rows = ", ".join(f"({k}, '{q}', {list(v)})" for k, (q, v) in enumerate(table.items()))
    return f"{name}(place, quality, shape) AS (VALUES {rows})"


_BASIC_SQL = _templates_sql(chord_tables.TRIADS | chord_tables.SEVENTHS, "templates")
_EXACT_SQL = _templates_sql(chord_tables.TRIADS_EX | chord_tables.FOURS_EX, "templates")

#: The whole cascade for distinct sets (pcs ascending, bass_pc): a row for each set that has a reading.
_READINGS_SQL = f"""
shapes_ex(place, quality, shape, display) AS (VALUES {", ".join(f"({k}, '{q}', {list(v)}, '{chord_tables.DISPLAY[q]}')" for k, (q, v) in enumerate((chord_tables.TRIADS_EX | chord_tables.FOURS_EX).items()))}),
dsets AS (SELECT DISTINCT pcs, bass_pc FROM sets),
spare AS (SELECT pcs, bass_pc, unnest(pcs) AS x FROM dsets),
subs AS (
  SELECT pcs, bass_pc, 1 AS stage, 0 AS ord, pcs AS sub, bass_pc AS sub_bass FROM dsets
  UNION ALL SELECT pcs, bass_pc, 2, -x, list_filter(pcs, lambda p: p <> x), bass_pc FROM spare WHERE len(pcs) = 5 AND x <> bass_pc
  UNION ALL SELECT pcs, bass_pc, 4, 0, list_filter(pcs, lambda p: p <> bass_pc), list_min(list_filter(pcs, lambda p: p <> bass_pc)) FROM dsets
  UNION ALL SELECT pcs, bass_pc, 5, -x, list_filter(pcs, lambda p: p <> x), bass_pc FROM spare WHERE len(pcs) = 4 AND x <> bass_pc
  UNION ALL SELECT a.pcs, a.bass_pc, 5, -100 * a.x - b.x, list_filter(a.pcs, lambda p: p <> a.x AND p <> b.x), a.bass_pc FROM spare a JOIN spare b
    ON a.pcs = b.pcs AND a.bass_pc = b.bass_pc AND a.x <> b.x WHERE len(a.pcs) = 5 AND a.x <> a.bass_pc AND b.x <> a.bass_pc),
rooted AS (SELECT *, unnest(sub) AS root, false AS filled FROM subs WHERE len(sub) IN (3, 4)
  UNION ALL SELECT pcs, bass_pc, 3, 0, list_append(pcs, (x + 7) % 12), bass_pc, x, true FROM spare WHERE len(pcs) = 3 AND NOT list_contains(pcs, (x + 7) % 12)),
turned AS (SELECT *, list_sort(list_transform(sub, lambda p: (p - root + 12) % 12)) AS shape FROM rooted),
hits AS (SELECT t.*, quality, display, row_number() OVER s AS rn, count(*) OVER (PARTITION BY pcs, bass_pc, stage, ord) AS n, coalesce(list_position(f.shape, (bass_pc - root + 12) % 12) - 1, 0) AS place_of_bass
  FROM turned t JOIN shapes_ex f ON f.shape = t.shape WINDOW s AS (PARTITION BY pcs, bass_pc, stage, ord ORDER BY root <> sub_bass, root, place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pcs, bass_pc ORDER BY stage, CASE WHEN stage <> 2 THEN 0 WHEN place_of_bass = 0 AND quality IN ('maj7', 'dom7', 'min7', 'm7b5', 'dim7', 'minMaj7', 'aug7') THEN 0 WHEN place_of_bass = 0 THEN 1 ELSE 2 END, ord) AS best
  FROM hits WHERE rn = 1),
readings AS (SELECT pcs, bass_pc, root, quality, display, CASE WHEN stage = 4 THEN 0 ELSE place_of_bass END AS inversion, stage = 4 AS is_on, filled,
    CASE WHEN stage = 1 AND n = 1 THEN 'definite' WHEN stage = 1 THEN 'ambiguous' WHEN stage = 3 THEN 'incomplete' ELSE 'likely' END AS confidence FROM ranked WHERE best = 1
  UNION ALL SELECT pcs, bass_pc, pcs[1], 'maj', '', CASE WHEN bass_pc = pcs[1] THEN 0 ELSE 1 END, false, false, 'incomplete' FROM dsets WHERE len(pcs) = 2 AND pcs[2] - pcs[1] = 7),
others AS (SELECT pcs, bass_pc, list({{'root': root, 'quality': quality, 'absolute': {_NAMES_SQL}[root + 1] || display || CASE WHEN root = bass_pc THEN '' ELSE '/' || {_NAMES_SQL}[bass_pc + 1] || place_of_bass END}} ORDER BY rn) AS alternatives FROM hits WHERE stage = 1 AND rn > 1 GROUP BY ALL),
named AS (SELECT r.*, alternatives, {_NAMES_SQL}[root + 1] || display || CASE WHEN filled THEN '(o5)' ELSE '' END || CASE WHEN root = r.bass_pc THEN '' ELSE '/' || {_NAMES_SQL}[r.bass_pc + 1] || CASE WHEN is_on THEN '' ELSE CAST(inversion AS VARCHAR) END END AS absolute
  FROM readings r LEFT JOIN others o ON o.pcs = r.pcs AND o.bass_pc = r.bass_pc)"""
_DEGREES_SQL = "[" + ",".join(f"'{d}'" for d in chord_tables.DEGREES) + "]"
_MOMENT_SETS_SQL = """sets AS (SELECT score_id, measure_index, "offset", list_sort(list(DISTINCT CAST(abs_semitone % 12 AS INT))) AS pcs, CAST(min(abs_semitone) % 12 AS INT) AS bass_pc FROM sounding WHERE abs_semitone IS NOT NULL GROUP BY ALL)"""

#: Chords of sets (keys, pcs, bass_pc): the best template over the best root.
_LABELS_SQL = """
roots AS (SELECT *, unnest(pcs) AS root FROM sets WHERE len(pcs) IN (3, 4)),
shapes AS (SELECT *, list_sort(list_transform(pcs, lambda p: (p - root + 12) % 12)) AS shape FROM roots),
found AS (SELECT s.*, t.quality, row_number() OVER (PARTITION BY {keys} ORDER BY root <> bass_pc, root, place) AS rn
  FROM shapes s JOIN templates t ON t.shape = s.shape)"""


_SYMBOL_SQL = f"""SELECT score_id, measure_index, {_NAMES_SQL}[root + 1] AS root, quality, {_NAMES_SQL}[bass_pc + 1] AS bass, root <> bass_pc AS inverted,
  {_NAMES_SQL}[root + 1] || quality || CASE WHEN root <> bass_pc THEN '/' || {_NAMES_SQL}[bass_pc + 1] ELSE '' END AS symbol
FROM found WHERE rn = 1"""


@query(f"""WITH {NOTES_SQL}
SELECT score_id, measure_index, array_to_string(list_sort(list(DISTINCT abs_semitone % 12)), ',') AS pcs, count(DISTINCT abs_semitone % 12) AS n_pcs
FROM notes GROUP BY ALL""")
def measure_pitch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmony.pitch_classes(notes(spark, sf_dir))


@query(f"""WITH {NOTES_SQL}, {_BASIC_SQL},
sets AS (SELECT score_id, measure_index, list_sort(list(DISTINCT CAST(abs_semitone % 12 AS INT))) AS pcs, CAST(min(abs_semitone) % 12 AS INT) AS bass_pc FROM notes GROUP BY ALL),
{_LABELS_SQL.format(keys="score_id, measure_index")}
{_SYMBOL_SQL}""")
def measure_chord_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmony.measure_labels(notes(spark, sf_dir))


_REPS_SQL = """reps AS (SELECT score_id, measure_index, part_idx, arg_min(abs_semitone, seq) AS rep FROM notes GROUP BY ALL)"""
_MOVES_SQL = f"""{_REPS_SQL},
moves AS (SELECT a.score_id, a.part_idx, a.measure_index AS from_measure, b.measure_index AS to_measure, a.rep AS from_rep, b.rep AS to_rep, b.rep - a.rep AS delta
  FROM reps a JOIN reps b ON a.score_id = b.score_id AND a.part_idx = b.part_idx AND b.measure_index = a.measure_index + 1)"""


@query(f"WITH {NOTES_SQL}, {_REPS_SQL} SELECT * FROM reps")
def cell_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_leading.representatives(notes(spark, sf_dir))


@query(f"WITH {NOTES_SQL}, {_MOVES_SQL} SELECT score_id, part_idx, from_measure, to_measure, delta FROM moves")
def voice_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_leading.transitions(voice_leading.representatives(notes(spark, sf_dir))).drop("from_rep", "to_rep")


@query(f"WITH {NOTES_SQL}, {_MOVES_SQL} SELECT score_id, part_idx, from_measure, to_measure, delta FROM moves WHERE abs(delta) > 12")
def large_leap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_leading.large_leaps(voice_leading.transitions(voice_leading.representatives(notes(spark, sf_dir)))).drop("from_rep", "to_rep")


@query(f"""WITH {NOTES_SQL}, {_MOVES_SQL},
pairs AS (SELECT a.score_id, a.from_measure, a.to_measure, a.part_idx AS part_a, b.part_idx AS part_b, abs(a.from_rep - b.from_rep) % 12 AS i, abs(a.to_rep - b.to_rep) % 12 AS j
  FROM moves a JOIN moves b ON a.score_id = b.score_id AND a.from_measure = b.from_measure AND a.part_idx < b.part_idx
  WHERE a.delta <> 0 AND b.delta <> 0 AND sign(a.delta) = sign(b.delta))
SELECT CASE WHEN j = 7 AND i = 7 THEN 'parallelFifths' WHEN j = 7 THEN 'directFifths' WHEN i = 0 THEN 'parallelOctaves' ELSE 'directOctaves' END AS kind,
  score_id, from_measure, to_measure, part_a, part_b FROM pairs WHERE j IN (0, 7)""")
def parallel_direct_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice_leading.parallels(voice_leading.transitions(voice_leading.representatives(notes(spark, sf_dir))))


@query(f"""WITH {NOTES_SQL}, {_REPS_SQL},
parts AS (SELECT score_id, part_idx, lead(part_idx) OVER (PARTITION BY score_id ORDER BY part_idx) AS lower FROM (SELECT DISTINCT score_id, part_idx FROM notes))
SELECT u.score_id, u.measure_index, u.part_idx AS part_a, l.part_idx AS part_b
FROM reps u JOIN parts p ON p.score_id = u.score_id AND p.part_idx = u.part_idx
JOIN reps l ON l.score_id = u.score_id AND l.measure_index = u.measure_index AND l.part_idx = p.lower WHERE u.rep < l.rep""")
def voice_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    return voice_leading.crossings(voice_leading.representatives(rows), rows.select("score_id", "part_idx").distinct())


_ONSETS_SQL = """timed AS (SELECT *, CAST(coalesce(sum(units) OVER (PARTITION BY score_id, measure_index, part_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM notes)"""


@query(f"""WITH {NOTES_SQL}, {_ONSETS_SQL} SELECT score_id, measure_index, part_idx, seq, abs_semitone, start, start + units AS "end" FROM timed""")
def note_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmony.onsets(notes(spark, sf_dir)).drop("units", "tie")


@query(f"""WITH {NOTES_SQL}, {_ONSETS_SQL},
flagged AS (SELECT *, CASE WHEN lag(tie) OVER w AND lag(abs_semitone) OVER w = abs_semitone THEN 0 ELSE 1 END AS opens FROM timed WINDOW w AS (PARTITION BY score_id, measure_index, part_idx ORDER BY seq)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY score_id, measure_index, part_idx ORDER BY seq) AS island FROM flagged)
SELECT score_id, measure_index, part_idx, min(start) AS start, max(start + units) AS "end", any_value(abs_semitone) AS abs_semitone FROM islands GROUP BY score_id, measure_index, part_idx, island""")
def tie_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmony.merge_ties(harmony.onsets(notes(spark, sf_dir)))


_MOMENTS_SQL = f"""{_ONSETS_SQL},
cells AS (SELECT score_id, measure_index, part_idx, sum(units) AS length FROM notes GROUP BY ALL),
lengths AS (SELECT score_id, measure_index, CAST(arg_min(length, part_idx) AS BIGINT) AS length FROM cells GROUP BY ALL),
moments AS (SELECT score_id, measure_index, CAST(t AS BIGINT) AS "offset" FROM lengths, unnest(range(0, length, {BEAT})) AS r(t)
  UNION SELECT score_id, measure_index, start FROM timed JOIN lengths USING (score_id, measure_index) WHERE start < length),
sounding AS (SELECT m.score_id, m.measure_index, m."offset", n.abs_semitone FROM moments m LEFT JOIN timed n
  ON n.score_id = m.score_id AND n.measure_index = m.measure_index AND n.start <= m."offset" AND n.start + n.units > m."offset")"""


def _moment_chords(spark: SparkSession, sf_dir: str, fifths: int = 0) -> DataFrame:
    sets = harmony.moment_sets(harmony.onsets(notes(spark, sf_dir)), BEAT)
    return harmony.extended_labels(sets, F.lit(fifths))


@query(f"""WITH {NOTES_SQL}, {_MOMENTS_SQL}
SELECT score_id, measure_index, "offset", coalesce(array_to_string(list_sort(list(DISTINCT abs_semitone % 12) FILTER (abs_semitone IS NOT NULL)), ','), '') AS pcs, coalesce(min(abs_semitone) % 12, -1) AS bass_pc
FROM sounding GROUP BY ALL""")
def beat_grid_sounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = harmony.moment_sets(harmony.onsets(notes(spark, sf_dir)), BEAT)
    members = F.array_join(F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(i)) for i in range(12)]), lambda x: x.isNotNull()), ",")
    return sets.select("score_id", "measure_index", "offset", members.alias("pcs"), F.coalesce("bass_pc", F.lit(-1)).cast("long").alias("bass_pc"))


@query(f"""WITH {NOTES_SQL}, {_EXACT_SQL}, {_MOMENTS_SQL},
sets AS (SELECT score_id, measure_index, "offset", list_sort(list(DISTINCT CAST(abs_semitone % 12 AS INT))) AS pcs, CAST(min(abs_semitone) % 12 AS INT) AS bass_pc FROM sounding WHERE abs_semitone IS NOT NULL GROUP BY ALL),
{_LABELS_SQL.format(keys='score_id, measure_index, "offset"')},
counted AS (SELECT *, count(*) OVER (PARTITION BY score_id, measure_index, "offset") AS n FROM found)
SELECT score_id, measure_index, "offset", {_NAMES_SQL}[root + 1] AS root, quality, {_NAMES_SQL}[bass_pc + 1] AS bass,
  CAST(list_position(shape, (bass_pc - root + 12) % 12) - 1 AS BIGINT) AS inversion, CASE WHEN n = 1 THEN 'definite' ELSE 'ambiguous' END AS confidence
FROM counted WHERE rn = 1""")
def chord_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-set readings of every moment; the further stages of the cascade are in chord_cascade."""
    found = _moment_chords(spark, sf_dir).where(F.col("confidence").isin("definite", "ambiguous"))
    return found.select("score_id", "measure_index", "offset", "root", "quality", "bass", F.col("inversion").cast("long").alias("inversion"), "confidence")


@query(f"""WITH {NOTES_SQL}, {_MOMENTS_SQL}, {_MOMENT_SETS_SQL}, {_READINGS_SQL}
SELECT score_id, measure_index, "offset", {_NAMES_SQL}[root + 1] AS root, quality, {_NAMES_SQL}[n.bass_pc + 1] AS bass, CAST(inversion AS INT) AS inversion, is_on, {_DEGREES_SQL}[root + 1] AS degree, absolute,
  {_DEGREES_SQL}[root + 1] || display AS relative, {_DEGREES_SQL}[root + 1] || display || '/' || absolute AS combined, confidence, filled AS omitted_fifth,
  CASE WHEN confidence = 'ambiguous' THEN absolute || '~' || alternatives[1].absolute ELSE absolute END AS name
FROM sets JOIN named n ON n.pcs = sets.pcs AND n.bass_pc = sets.bass_pc""")
def chord_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every moment's reading, with degrees and display names."""
    found = _moment_chords(spark, sf_dir).where("root is not null")
    name = harmony.chord_name(F.col("absolute"), F.col("confidence"), F.col("alternatives"))
    return found.select("score_id", "measure_index", "offset", "root", "quality", "bass", "inversion", "is_on", "degree", "absolute", "relative", "combined", "confidence", "omitted_fifth", name.alias("name"))


@query(f"""WITH {NOTES_SQL}, {_BASIC_SQL}, {_MOMENTS_SQL},
sets AS (SELECT score_id, measure_index, "offset", list_sort(list(DISTINCT CAST(abs_semitone % 12 AS INT))) AS pcs, CAST(min(abs_semitone) % 12 AS INT) AS bass_pc FROM sounding WHERE abs_semitone IS NOT NULL GROUP BY ALL),
{_LABELS_SQL.format(keys='score_id, measure_index, "offset"')},
beats AS (SELECT m.score_id, m.measure_index, m."offset" // {BEAT} AS beat, root, quality, bass_pc FROM moments m LEFT JOIN (SELECT * FROM found WHERE rn = 1) f USING (score_id, measure_index, "offset") WHERE m."offset" % {BEAT} = 0),
flagged AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(root) OVER w IS NOT DISTINCT FROM root AND lag(quality) OVER w IS NOT DISTINCT FROM quality AND lag(CASE WHEN root IS NULL THEN NULL ELSE bass_pc END) OVER w IS NOT DISTINCT FROM (CASE WHEN root IS NULL THEN NULL ELSE bass_pc END) THEN 0 ELSE 1 END AS opens FROM beats WINDOW w AS (PARTITION BY score_id, measure_index ORDER BY beat)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY score_id, measure_index ORDER BY beat) - 1 AS segment FROM flagged)
SELECT score_id, measure_index, CAST(segment AS BIGINT) AS segment, coalesce(any_value({_NAMES_SQL}[root + 1]), '?') AS root, coalesce(any_value(quality), '?') AS quality, CAST(count(*) * {BEAT} AS BIGINT) AS units FROM islands GROUP BY score_id, measure_index, segment""")
def chord_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal triads and sevenths over the beats."""
    sets = harmony.moment_sets(harmony.onsets(notes(spark, sf_dir)), BEAT)
    beats = harmony.beat_chords(sets.join(F.broadcast(chord_tables.basic_table(spark)), ["mask", "bass_pc"], "left"), BEAT)
    found = harmony.segments(beats.select("score_id", "measure_index", "beat", "root", "quality", "bass"), BEAT)
    return found.select("score_id", "measure_index", "segment", F.coalesce("root", F.lit("?")).alias("root"), F.coalesce("quality", F.lit("?")).alias("quality"), "units")


_MOTION_SQL = "CASE ({0} + 12) % 12 WHEN 5 THEN 3 WHEN 7 THEN 2 WHEN 2 THEN 1 WHEN 10 THEN 1 ELSE 0 END"
_IS_DIATONIC_SQL = " OR ".join(f"(z.root = {d} AND z.quality IN ({', '.join(repr(x) for x in q)}))" for d, q in chord_tables.DIATONIC.items())


@query(f"""WITH RECURSIVE {NOTES_SQL}, {_MOMENTS_SQL}, {_MOMENT_SETS_SQL}, {_READINGS_SQL},
firsts AS (SELECT score_id, measure_index, row_number() OVER s AS rn, n.root, quality, absolute, confidence, alternatives, lead(n.root) OVER s AS next_root
  FROM moments m LEFT JOIN sets USING (score_id, measure_index, "offset") LEFT JOIN named n ON n.pcs = sets.pcs AND n.bass_pc = sets.bass_pc
  WHERE m."offset" = 0 WINDOW s AS (PARTITION BY score_id ORDER BY measure_index)),
optional AS (SELECT *, list_concat([{{'root': root, 'quality': quality, 'absolute': absolute}}], coalesce(alternatives, [])) AS options FROM firsts),
fold AS (
  SELECT DISTINCT score_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS measure_index, CAST(NULL AS INT) AS root, CAST(NULL AS VARCHAR) AS quality, CAST(NULL AS VARCHAR) AS absolute, CAST(NULL AS VARCHAR) AS confidence, false AS resolved FROM firsts
  UNION ALL SELECT score_id, rn, measure_index, options[pick].root, options[pick].quality, options[pick].absolute, CASE WHEN pick > 1 THEN 'likely' ELSE confidence END, pick > 1 FROM (
    SELECT *, CASE WHEN confidence = 'ambiguous' AND len(options) > 1 AND (left_root IS NOT NULL OR next_root IS NOT NULL) AND list_max(fits) > 0 THEN list_position(fits, list_max(fits)) ELSE 1 END AS pick FROM (
      SELECT o.*, f.root AS left_root, list_transform(o.options, lambda z: CASE WHEN f.root IS NULL THEN 0 ELSE {_MOTION_SQL.format("z.root - f.root")} END + CASE WHEN next_root IS NULL THEN 0 ELSE {_MOTION_SQL.format("next_root - z.root")} END + CASE WHEN {_IS_DIATONIC_SQL} THEN 1 ELSE 0 END) AS fits
      FROM fold f JOIN optional o ON o.score_id = f.score_id AND o.rn = f.rn + 1)))
SELECT score_id, measure_index, {_NAMES_SQL}[root + 1] AS root, quality, absolute, confidence, resolved FROM fold WHERE rn > 0""")
def chord_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chord of each measure, ambiguous ones settled by their neighbours."""
    first = _moment_chords(spark, sf_dir).where(F.col("offset") == 0)
    return harmony.resolve_progression(first.select("score_id", "measure_index", "root", "quality", "absolute", "confidence", "alternatives", F.lit(0).alias("fifths")))


_KEYS = [(c, a, m) for c in "CDEFGAB" for a in ("", "#", "b") for m in (False, True)]
_KEYS_SQL = ", ".join(f"('{c}', '{a}', {str(m).lower()})" for c, a, m in _KEYS)


@query(f"""WITH keys(letter, accidental, minor) AS (VALUES {_KEYS_SQL}),
f AS (SELECT *, CAST(CASE letter WHEN 'C' THEN 0 WHEN 'G' THEN 1 WHEN 'D' THEN 2 WHEN 'A' THEN 3 WHEN 'E' THEN 4 WHEN 'B' THEN 5 ELSE -1 END + CASE accidental WHEN '#' THEN 7 WHEN 'b' THEN -7 ELSE 0 END - CASE WHEN minor THEN 3 ELSE 0 END AS BIGINT) AS fifths FROM keys)
SELECT letter, accidental, minor, fifths, CAST(((fifths * 7) % 12 + 12) % 12 AS BIGINT) AS root_pc FROM f""")
def key_from_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame(_KEYS, "letter string, accidental string, minor boolean")
    keys = keys.withColumn("fifths", letter_fifths(F.col("letter"), F.col("accidental"), F.col("minor")).cast("long"))
    return keys.withColumn("root_pc", key_root(F.col("fifths")).cast("long"))


@query(f"""WITH {NOTES_SQL},
shifts AS (SELECT *, part_idx * 3 - 11 AS shift, score_id % 15 - 7 AS fifths FROM notes),
keyed AS (SELECT *, ((shift * 7) % 12 + 12) % 12 AS raw FROM shifts),
moved AS (SELECT *, fifths + CASE WHEN raw > 6 THEN raw - 12 ELSE raw END AS new_key FROM keyed),
folded AS (SELECT *, CASE WHEN shift = 0 THEN fifths WHEN new_key > 7 THEN new_key - 12 WHEN new_key < -7 THEN new_key + 12 ELSE new_key END AS new_fifths, abs_semitone + shift AS s FROM moved),
named AS (SELECT *, CASE WHEN shift = 0 THEN CASE WHEN fifths >= 0 THEN {_NAMES_SQL}[CAST(s % 12 + 1 AS INT)] ELSE ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'][CAST(s % 12 + 1 AS INT)] END
  WHEN new_fifths >= 0 THEN {_NAMES_SQL}[CAST(s % 12 + 1 AS INT)] ELSE ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'][CAST(s % 12 + 1 AS INT)] END AS name FROM folded)
SELECT score_id, measure_index, part_idx, seq, CAST(new_fifths AS BIGINT) AS new_fifths, name[1:1] AS step, CAST(s // 12 AS BIGINT) AS octave,
  CAST(CASE WHEN len(name) = 1 THEN 0 WHEN name[2:2] = '#' THEN 1 ELSE -1 END AS BIGINT) AS alter FROM named""")
def transpose_respell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part moved by its own number of semitones, spelled for the new key."""
    rows = notes(spark, sf_dir).withColumns({"shift": F.col("part_idx") * 3 - 11, "fifths": F.col("score_id") % 15 - 7})
    old = spelled(F.col("abs_semitone"), F.col("fifths"))
    rows = rows.withColumn("new_fifths", transposed_key(F.col("fifths"), F.col("shift")).cast("long")).withColumn("old", old)
    moved = transposed(F.col("old.step"), F.col("old.octave"), F.col("old.alter"), F.col("shift"), F.col("new_fifths"))
    return rows.withColumn("new", moved).select("score_id", "measure_index", "part_idx", "seq", "new_fifths", "new.step", "new.octave", "new.alter")
