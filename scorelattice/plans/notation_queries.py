"""Queries on rich notation text, composed from the notes by expressions that SQL's engine shares.

Every note gets a number h, and what is written for it follows from h; the SQL works the expected result out
from the same numbers without reading a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.catalog import query
from scorelattice.operators import lexing, parsing
from scorelattice.plans.bridge import NOTES_SQL, notes

_H = "abs_semitone * 7 + units * 3 + seq * 5 + part_idx * 11 + measure_index * 13"
_ORDER = "measure_index, part_idx, seq"


def pick(choices: str, index: str) -> str:
    """SQL for one of some comma-separated texts, by a number from 0."""
    return f"split_part('{choices}', ',', CAST({index} AS INT) + 1)"


def third(h: str) -> str:
    return f"CAST(floor({h} / 3) AS BIGINT)"


def with_fields(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    rows = rows.selectExpr("*", f"CAST({_H} AS BIGINT) AS h")
    for name, sql in fields.items():
        rows = rows.withColumn(name, F.expr(sql))
    return rows


def fields_sql(fields: dict[str, str], name: str = "rich") -> str:
    """The same columns in SQL; each may name those before it."""
    out = f"{name}_0 AS (SELECT *, CAST({_H} AS BIGINT) AS h FROM notes)"
    for k, (column, sql) in enumerate(fields.items()):
        out += f", {name}_{k + 1} AS (SELECT *, {sql} AS {column} FROM {name}_{k})"
    return f"{out}, {name} AS (SELECT * FROM {name}_{len(fields)})"


def texts(rows: DataFrame, between: str = " ") -> DataFrame:
    """score_id, source: the words of each score in order."""
    words = rows.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "), "word"))).alias("ws"))
    return words.select("score_id", F.array_join(F.transform("ws", lambda w: w["word"]), between).alias("source"))


def numbered(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("n", (F.row_number().over(Window.partitionBy("score_id").orderBy("tok_idx")) - 1).cast("long"))


_N_SQL = f"row_number() OVER (PARTITION BY score_id ORDER BY {_ORDER}) - 1"

# --- notes ----------------------------------------------------------------


def _pitch(i: int) -> dict[str, str]:
    """Fields of the i-th pitch: letter, accidentals before and after the octave, and what they amount to."""
    letters = "CDEFGABcdefga" if i == 0 else "CDEFGAB"
    alter = "CASE {} WHEN '#' THEN 1 WHEN 'x' THEN 2 WHEN 'b' THEN -1 WHEN 'bb' THEN -2 ELSE 0 END"
    return {
        f"l{i}": f"substr('{letters}', CAST((h + {3 * i}) % {len(letters)} AS INT) + 1, 1)",
        f"a{i}": pick(",#,b,x,bb,*", f"(h + {i}) % 6"),
        f"b{i}": f"CASE WHEN a{i} = '*' THEN '' ELSE {pick(',#,b,x,*', f'({third("h")} + {i}) % 5')} END",
        f"p{i}": f"l{i} || a{i} || CAST(3 + (h + {i}) % 4 AS VARCHAR(1)) || b{i}",
        f"e{i}": f"upper(l{i}) || CAST(3 + (h + {i}) % 4 AS VARCHAR(1)) || ':' || CAST(CASE WHEN b{i} = '*' THEN 0 ELSE greatest(-2, least(2, {alter.format(f'a{i}')} + {alter.format(f'b{i}')})) END AS VARCHAR(2))",
    }


_SUFFIXES = ",tr,mr~,s>,_^,z2-,jf,ar~s,vb,TN~l,Ogl"
_MARKS = ",trill,mordent fermata,staccato accent,slurEnd marcato,tremolo2 tenuto,fall,arpeggio fermataShort,vibrato,invertedTurn fermataLong,harmonic glissando"
_NOTE_FIELDS = {
    **_pitch(0), **_pitch(1), **_pitch(2),
    "grace_mark": pick("`,``,,,,,", "h % 7"),
    "head_mark": pick(",!d,!x,!/,!t", "h % 5"),
    "length": "substr('hijklmHIJKLM', CAST(h % 12 AS INT) + 1, 1)",
    "n_dots": "h % 4",
    "word": f"grace_mark || p0 || CASE WHEN h % 3 > 0 THEN p1 ELSE '' END || CASE WHEN h % 3 > 1 THEN p2 ELSE '' END || head_mark || length || repeat('.', CAST(n_dots AS INT)) || {pick(_SUFFIXES, f'{third("h")} % 11')}",
}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_NOTE_FIELDS)}
SELECT score_id, {_N_SQL} AS n, word AS raw, e0 || CASE WHEN h % 3 > 0 THEN ' ' || e1 ELSE '' END || CASE WHEN h % 3 > 1 THEN ' ' || e2 ELSE '' END AS pitches,
  CAST(floor(2 ** (h % 6 + 1) * CASE n_dots WHEN 1 THEN 1.5 WHEN 2 THEN 1.75 WHEN 3 THEN 1.875 ELSE 1 END + 0.5) AS BIGINT) AS units, CAST(n_dots AS BIGINT) AS dots,
  {pick(_MARKS, f'{third("h")} % 11')} AS marks, {pick(',diamond,x,slash,triangle', 'h % 5')} AS head, {pick('grace,acciaccatura,,,,,', 'h % 7')} AS grace, h % 7 > 1 AND ascii(l0) >= 97 AS slur_start FROM rich""")
def note_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords with accidentals on either side of the octave, heads, dots, graces, slurs and marks."""
    rows = numbered(lexing.tokens(texts(with_fields(notes(spark, sf_dir), _NOTE_FIELDS))))
    pitch = F.transform("pitches", lambda p: F.concat(p["step"], p["octave"].cast("string"), F.lit(":"), p["alter"].cast("string")))
    none = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("score_id", "n", "raw", F.array_join(pitch, " ").alias("pitches"), F.col("units").cast("long").alias("units"), F.col("dots").cast("long").alias("dots"), F.array_join("marks", " ").alias("marks"), none("head").alias("head"), none("grace").alias("grace"), "slur_start")


# --- everything else that a text holds ------------------------------------

_KIND_OF = "barline,measureBarrier,measureBarrier,measureBarrier,measureBarrier,repeatBoundary,repeatBoundary,tupletOpen,tupletClose,tie,lyric,lyric,rest,comment,comment,measureBarrier,note,lyric"
_WORDS = [*"| , ,, ,: :, : :3 24( ) + lu 'C4k Rk..".split(), "/* a /b */", ";x", ",-", "C4k", "17"]
_STYLES = ["", "single", "double", "repeatStart", "repeatEnd", *[""] * 10, "dashed", "", ""]
_PIECE_FIELDS = {
    "k": f"h % {len(_WORDS)}",
    "word": "CASE k " + " ".join(f"""WHEN {k} THEN '{w.replace("'", "''")}'""" for k, w in enumerate(_WORDS)) + " END",
    # a comment to the end of the line needs that end
    "gap": "CASE WHEN k = 14 OR h % 4 = 0 THEN chr(10) ELSE ' ' END",
}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_PIECE_FIELDS)},
placed AS (SELECT *, CAST(coalesce(sum(len(word) + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(CASE WHEN gap = ' ' THEN 0 ELSE 1 END) OVER w, 0) AS BIGINT) AS lines,
  coalesce(max(CASE WHEN gap <> ' ' THEN rn END) OVER w, 0) AS line_rn FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY {_ORDER}) AS rn FROM rich) WINDOW w AS (PARTITION BY score_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lined AS (SELECT *, start - first_value(start) OVER (PARTITION BY score_id, line_rn ORDER BY rn) + 1 AS col FROM placed)
SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY rn) - 1 AS n, {pick(_KIND_OF, "k")} AS kind, word AS raw, start AS "offset", lines + 1 AS line, col AS "column",
  CASE k {" ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_STYLES))} END AS barline, CASE k WHEN 6 THEN 3 WHEN 7 THEN 24 WHEN 12 THEN 28 WHEN 16 THEN 16 ELSE -1 END AS number,
  CASE k WHEN 10 THEN 'lu' WHEN 11 THEN 'C4k' WHEN 17 THEN '17' ELSE '' END AS lyric
FROM lined WHERE k NOT IN (13, 14)""")
def piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barlines, barriers, repeats, tuplet marks, ties, lyrics, rests and comments, with their places in the text."""
    rows = with_fields(notes(spark, sf_dir), _PIECE_FIELDS).withColumn("word", F.concat("word", "gap"))
    source = texts(rows, "")
    at = lexing.line_column(F.col("source"), F.col("offset"))
    found = numbered(lexing.tokens(source)).join(source, "score_id").withColumn("at", at)
    number = F.coalesce("repeat_count", "tuplet_units", "units", F.lit(-1))
    none = lambda c: F.coalesce(c, F.lit(""))
    return found.select("score_id", "n", "kind", "raw", F.col("offset").cast("long").alias("offset"), F.col("at.line").cast("long").alias("line"), F.col("at.column").cast("long").alias("column"), none("barline").alias("barline"), number.cast("int").alias("number"), none("lyric").alias("lyric"))


# --- headers --------------------------------------------------------------

_CLEF_NAMES, _CLEF_OF = "TREBLE,BASS,ALTO,TENOR,PERCUSSION,treble,T8,XYZ", "TREBLE,BASS,ALTO,TENOR,PERCUSSION,TREBLE,TREBLE,TREBLE"
_SHORT_CLEFS, _SHORT_OF = "T,B,Al,Te,Pe,So,Br,A,Bass", "TREBLE,BASS,ALTO,TENOR,PERCUSSION,SOPRANO,BARITONE,ALTO,BASS"
_KEYS, _FIFTHS = "C,G,D,Bb,F#m,Cm,-3,H", "0,1,2,-2,3,-3,-3,0"
_SHORT_KEYS, _SHORT_FIFTHS = "KC,KG,KBb,KAm,KF#m,KEbm", "0,1,-2,0,3,-6"
_HEADER_FIELDS = {
    "form": "h % 4",
    "time": pick("4/4,3/4,6/8,2/2,3/7", "h % 5"),
    "d": pick("64,32,16,128", f"{third('h')} % 4"),
    "long_text": f"'[CLEF:' || {pick(_CLEF_NAMES, 'h % 8')} || ' TIME:' || time || ' KEY:' || {pick(_KEYS, third('h') + ' % 8')} || ' DIV:' || d || ']'",
    "short_text": f"'[' || {pick(_SHORT_CLEFS, 'h % 9')} || ' ' || time || ' ' || {pick(_SHORT_KEYS, third('h') + ' % 6')} || ' D' || d || ']'",
    "source": "CASE form WHEN 0 THEN '; first' || chr(10) || long_text || ' C4k' WHEN 1 THEN short_text || ' C4k' WHEN 2 THEN '[K+' || CAST(h % 6 AS VARCHAR(1)) || ' ' || time || '] C4k' ELSE '[1]| C4k |' END",
}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_HEADER_FIELDS)},
read AS (SELECT *, CASE WHEN form < 3 THEN CAST(split_part(time, '/', 1) AS INT) ELSE 4 END AS time_num, CASE WHEN form < 3 THEN CAST(split_part(time, '/', 2) AS INT) ELSE 4 END AS time_den, CASE WHEN form < 2 THEN CAST(d AS INT) ELSE 64 END AS div FROM rich)
SELECT score_id, {_ORDER}, form < 3 AS given, CASE form WHEN 0 THEN {pick(_CLEF_OF, 'h % 8')} WHEN 1 THEN {pick(_SHORT_OF, 'h % 9')} ELSE 'TREBLE' END AS clef, time_num, time_den, div,
  CASE form WHEN 0 THEN CAST({pick(_FIFTHS, third('h') + ' % 8')} AS INT) WHEN 1 THEN CAST({pick(_SHORT_FIFTHS, third('h') + ' % 6')} AS INT) ELSE 0 END AS key_fifths, CASE WHEN form = 2 THEN CAST(h % 6 AS INT) ELSE 0 END AS transpose,
  CASE WHEN form = 0 AND h % 8 IN (6, 7) THEN 'clef' WHEN form = 0 AND {third('h')} % 8 = 7 THEN 'key' WHEN (time_num * div) % time_den <> 0 THEN 'divTime' ELSE '' END AS error FROM read""")
def score_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in both forms, after a comment, with a transposition, wrong ones, and texts without one."""
    rows = with_fields(notes(spark, sf_dir), _HEADER_FIELDS).withColumn("header", lexing.header(F.col("source")))
    return rows.select("score_id", *_ORDER.split(", "), *[f"header.{c}" for c in ("given", "clef", "time_num", "time_den", "div", "key_fifths", "transpose")], F.coalesce("header.error", F.lit("")).alias("error"))


# --- commands -------------------------------------------------------------

#: What is written, what it is, and its value.
_COMMANDS = [
    ("T120", "tempo", "120"), ("T:Allegro", "tempoText", "Allegro"), ("M3/4", "time", "3/4"), ("K-2", "transpose", "-2"), ("KBb", "key", "Bb"), ("KF#m", "key", "F#m"), ("Dff", "dynamics", "ff"), ("Dsfz", "dynamics", "sfz"),
    ("D<", "dynamics", "<"), ("V1", "volta", "1"), ("/V2", "voltaEnd", "2"), ("DC.fine", "jump", "DC.fine"), ("DS", "jump", "DS"), ("8va/", "ottava", "8va/"), ("ped", "pedal", "ped"), ("C:Am7", "chord", "Am7"), ("F:3", "fingering", "3"),
    ("S:2", "stringNumber", "2"), ("mmr:8", "multiRest", "8"), ("R:A", "rehearsal", "A"), ("text:dolce", "text", "dolce"), ("expr:con moto", "expression", "con moto"), ("breath", "breath", "breath"), ("Fine", "fine", "Fine"), ("segno", "segno", "segno"),
    ("%", "measureRepeat", "%"), ("swing", "swing", "swing"), ("3B:Tenor", "partSwitch", "3"), ("2", "partSwitch", "2"), ("P", "partSwitch", "P"), ("1:Flute", "partSwitch", "1"), ("So", "clefChange", "So"), ("zzz", "error", ""), ("Dzz", "error", ""),
]
_of = lambda part: "CASE k " + " ".join(f"WHEN {k} THEN '{c[part]}'" for k, c in enumerate(_COMMANDS)) + " END"
_COMMAND_FIELDS = {"k": f"h % {len(_COMMANDS)}", "word": "'[' || " + _of(0) + " || ']'"}
_SPECIAL = {c[0]: k for k, c in enumerate(_COMMANDS)}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_COMMAND_FIELDS)}
SELECT score_id, {_N_SQL} + 1 AS n, {_of(1)} AS meta_type, {_of(2)} AS meta_value, CASE k WHEN {_SPECIAL["3B:Tenor"]} THEN 'Tenor' WHEN {_SPECIAL["1:Flute"]} THEN 'Flute' ELSE '' END AS instrument,
  CASE k WHEN {_SPECIAL["3B:Tenor"]} THEN 'BASS' WHEN {_SPECIAL["So"]} THEN 'SOPRANO' ELSE '' END AS clef, CASE WHEN k IN ({_SPECIAL["zzz"]}, {_SPECIAL["Dzz"]}) THEN 'unknown meta command ' || word ELSE '' END AS error,
  CASE k WHEN {_SPECIAL["3B:Tenor"]} THEN 'P_V3 Tenor 53' WHEN {_SPECIAL["2"]} THEN 'P_V2 Voice 2 53' WHEN {_SPECIAL["P"]} THEN 'P_VP Voice Percussion 53' WHEN {_SPECIAL["1:Flute"]} THEN 'P_V1 Flute 53' ELSE '' END AS part_meta FROM rich""")
def command_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of every type, part switches with clefs and names, unknown ones."""
    source = texts(with_fields(notes(spark, sf_dir), _COMMAND_FIELDS)).withColumn("source", F.concat(F.lit("C4k "), "source"))
    rows = numbered(lexing.tokens(source)).where("n > 0")
    m = lexing.part_meta(F.col("part_label"), F.col("instrument"))
    none = lambda c: F.coalesce(c, F.lit(""))
    told = F.when(F.col("part_label").isNotNull(), F.concat_ws(" ", m["part_id"], m["display_name"], m["midi_program"].cast("string")))
    return rows.select("score_id", "n", "meta_type", *[none(c).alias(c) for c in ("meta_value", "instrument", "clef", "error")], none(told).alias("part_meta"))


# --- lyrics and ties ------------------------------------------------------

_SUNG_FIELDS = {
    "rest": "h % 9 = 0",
    "lyric": pick("lu,lo,,mi,,", "h % 6"),
    "word": "CASE WHEN rest THEN 'Rk' ELSE 'C4k' END || CASE WHEN tie THEN '+' ELSE '' END || ' ' || lyric || CASE WHEN h % 5 = 0 THEN ' [Dp] ho' ELSE '' END || CASE WHEN h % 7 = 0 THEN ' |' ELSE '' END",
}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_SUNG_FIELDS)}
SELECT score_id, {_N_SQL} AS n, CASE WHEN rest THEN 'rest' ELSE 'note' END AS kind, tie, CASE WHEN rest THEN '' ELSE lyric || CASE WHEN h % 5 = 0 THEN 'ho' ELSE '' END END AS lyric FROM rich""")
def lyric_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables join the note before them, over commands and bars, and are lost after a rest."""
    rows = parsing.attached(lexing.tokens(texts(with_fields(notes(spark, sf_dir), _SUNG_FIELDS)))).where("kind in ('note', 'rest')")
    return numbered(rows).select("score_id", "n", "kind", "tie", F.coalesce("lyric", F.lit("")).alias("lyric"))


@query(f"""WITH {NOTES_SQL}, {fields_sql(_SUNG_FIELDS)}
SELECT score_id, CAST(sum(CASE WHEN rest AND lyric <> '' THEN 1 ELSE 0 END + CASE WHEN rest AND h % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_loose FROM rich GROUP BY score_id HAVING n_loose > 0""")
def loose_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.loose_marks(lexing.tokens(texts(with_fields(notes(spark, sf_dir), _SUNG_FIELDS))))
    return rows.groupBy("score_id").agg(F.count("*").alias("n_loose"))


# --- tuplets --------------------------------------------------------------

_LETTER = "substr('hijklm', CAST(abs_semitone % 6 AS INT) + 1, 1)"
_TUPLET_FIELDS = {
    "last": "lead(seq) OVER (PARTITION BY score_id, part_idx, measure_index ORDER BY seq) IS NULL",
    "grouped": "(score_id + measure_index + part_idx) % 3 > 0",
    "target": "8 + 4 * (measure_index % 5)",
    "word": f"CASE WHEN seq = 0 AND part_idx = 1 AND measure_index % 2 = 0 THEN '[Dp] ' ELSE '' END || CASE WHEN grouped AND seq = 0 THEN CAST(target AS VARCHAR(3)) || '(' ELSE '' END || 'C4' || {_LETTER} || CASE WHEN last THEN CASE WHEN grouped THEN ')' ELSE '' END ELSE '' END",
}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_TUPLET_FIELDS)},
sized AS (SELECT *, CAST(2 ** (abs_semitone % 6 + 1) AS BIGINT) AS u FROM rich)
SELECT score_id, {_N_SQL} AS n, u AS units, grouped, CASE WHEN grouped THEN CAST(floor(u * (target * 1.0 / sum(u) OVER (PARTITION BY score_id, part_idx, measure_index)) + 0.5) AS BIGINT) ELSE u END AS played FROM sized""")
def tuplet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups scaled to what the group lasts."""
    cells = parsing.with_tuplet_units(parsing.grid_cells(lexing.tokens(texts(with_fields(notes(spark, sf_dir), _TUPLET_FIELDS))))).where("kind = 'note'")
    return numbered(cells).select("score_id", "n", F.col("units").cast("long").alias("units"), F.col("tuplet").isNotNull().alias("grouped"), F.coalesce("played_units", F.col("units").cast("long")).alias("played"))


# --- repeats --------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with six levels of repeats: a score, twice over itself, its parts, its measures and single notes."""
    rows = notes(spark, sf_dir).where("measure_index < 6")
    pitch = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")]), (F.col("abs_semitone") % 12 + 1).cast("int")), F.floor(F.col("abs_semitone") / 12).cast("string"), F.lit("k"))
    word = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(":"), pitch, F.lit(":2"))).otherwise(pitch)
    join = lambda df, keys, order, out, end: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, out))).alias("x")).withColumn(out, F.concat(F.lit(":"), F.array_join(F.transform("x", lambda w: w[out]), " "), end)).drop("x")
    count = lambda c: F.concat(F.lit(":"), c.cast("string"))
    cells = join(rows.withColumn("w", word), ["score_id", "part_idx", "measure_index"], ["seq"], "w", count(1 + F.col("measure_index") % 2))
    parts = join(cells, ["score_id", "part_idx"], ["measure_index"], "w", count(1 + F.col("part_idx") % 3))
    whole = join(parts, ["score_id"], ["part_idx"], "w", count(1 + F.col("score_id") % 2))
    return whole.select("score_id", F.concat(F.lit("::"), "w", F.lit(":1 :0")).alias("source"))


@query(f"""WITH {NOTES_SQL},
played AS (SELECT n.*, a, b, c, d FROM notes n, unnest(range(0, 1 + n.score_id % 2)) AS r(a), unnest(range(0, 1 + n.part_idx % 3)) AS s(b), unnest(range(0, 1 + n.measure_index % 2)) AS t(c), unnest(range(0, CASE WHEN n.seq % 2 = 0 THEN 2 ELSE 1 END)) AS u(d) WHERE measure_index < 6)
SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY a, part_idx, b, measure_index, c, seq, d) - 1 AS out_idx, abs_semitone FROM played""")
def nested_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexing.notes_of(parsing.flattened_repeats(lexing.tokens(_nested(spark, sf_dir))))
    at = F.row_number().over(Window.partitionBy("score_id").orderBy("play_idx")) - 1
    return rows.select("score_id", at.cast("long").alias("out_idx"), "abs_semitone")


_NEST_FIELDS = {"word": pick("C4k,:,:2,4(,),C4k,C4k", "h % 7")}


@query(f"""WITH {NOTES_SQL}, {fields_sql(_NEST_FIELDS)},
steps AS (SELECT score_id, {_N_SQL} AS n, CASE word WHEN ':' THEN 1 WHEN ':2' THEN -1 ELSE 0 END AS r, CASE word WHEN '4(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS t FROM rich),
depths AS (SELECT score_id, n, t, sum(r) OVER (PARTITION BY score_id ORDER BY n) AS depth FROM steps),
sums AS (SELECT score_id, sum(t) AS tuplets, min(depth) AS lowest, arg_max(depth, n) AS final FROM depths GROUP BY score_id)
SELECT score_id, 'tupletNotClosed' AS issue, 'error' AS level FROM sums WHERE tuplets > 0 UNION ALL SELECT score_id, 'strayTupletClose', 'warning' FROM sums WHERE tuplets < 0
UNION ALL SELECT score_id, 'strayRepeatEnd', 'warning' FROM sums WHERE lowest < 0 UNION ALL SELECT score_id, 'repeatNotClosed', 'error' FROM sums WHERE final > least(0, lowest)""")
def nesting_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.group_issues(lexing.tokens(texts(with_fields(notes(spark, sf_dir), _NEST_FIELDS))))


# --- parts and cells ------------------------------------------------------

_PART_FIELDS = {"word": "CASE WHEN seq = 0 THEN '[' || CAST(part_idx AS VARCHAR(2)) || CASE WHEN part_idx = 2 THEN ':Oboe' ELSE '' END || '] ' ELSE '' END || 'C4k'"}


@query(f"""WITH {NOTES_SQL},
openers AS (SELECT score_id, arg_min(CAST(part_idx AS VARCHAR), measure_index * 1000 + part_idx) AS first_part FROM notes GROUP BY score_id),
counts AS (SELECT n.score_id, CAST(part_idx AS VARCHAR) AS part, count(*) + CASE WHEN n.score_id % 3 = 1 AND CAST(part_idx AS VARCHAR) = any_value(first_part) THEN 1 ELSE 0 END AS n_tokens, count(*) AS n_notes, CASE WHEN part_idx = 2 THEN 'Oboe' ELSE '' END AS instrument FROM notes n JOIN openers USING (score_id) GROUP BY n.score_id, part_idx)
SELECT * FROM counts UNION ALL SELECT DISTINCT score_id, 'M', 1, 1, '' FROM notes WHERE score_id % 3 = 2""")
def preamble_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first part: a command joins that part, a note makes a part of its own."""
    source = texts(with_fields(notes(spark, sf_dir), _PART_FIELDS))
    source = source.withColumn("source", F.concat(F.when(F.col("score_id") % 3 == 1, "[T120] ").when(F.col("score_id") % 3 == 2, "C4k ").otherwise(""), "source"))
    rows = parsing.merged_preamble(parsing.with_parts(lexing.tokens(source)))
    return rows.groupBy("score_id", "part").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("kind") == "note").alias("n_notes"), F.coalesce(F.max("instrument"), F.lit("")).alias("instrument"))


def _long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for every four measures: longer than a measure more often than not."""
    rows = notes(spark, sf_dir).withColumn("cell", F.floor(F.col("measure_index") / 4))
    word = F.concat(F.lit("C4"), F.expr(_LETTER))
    cell = rows.groupBy("score_id", "part_idx", "cell").agg(F.array_sort(F.collect_list(F.struct("measure_index", "seq", word.alias("w")))).alias("ws"))
    part = cell.withColumn("t", F.array_join(F.transform("ws", lambda w: w["w"]), " ")).groupBy("score_id", "part_idx").agg(F.array_sort(F.collect_list(F.struct("cell", "t"))).alias("cs"))
    line = F.concat(F.lit("["), F.col("part_idx").cast("string"), F.lit("]| "), F.array_join(F.transform("cs", lambda c: c["t"]), " | "), F.lit(" |"))
    return part.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("part_idx", line.alias("line")))).alias("ls")).select("score_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("source"))


@query(f"""WITH RECURSIVE {NOTES_SQL},
queue AS (SELECT score_id, dense_rank() OVER (PARTITION BY score_id ORDER BY part_idx) - 1 AS part_idx, row_number() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index, seq) AS rn, CAST(2 ** (abs_semitone % 6 + 1) AS BIGINT) AS u,
    sum(2 ** (abs_semitone % 6 + 1)) OVER (PARTITION BY score_id, part_idx, measure_index // 4) > 64 AS long, measure_index // 4 AS cell, lead(measure_index // 4) OVER (PARTITION BY score_id, part_idx ORDER BY measure_index, seq) IS DISTINCT FROM measure_index // 4 AS last FROM notes),
walk AS (SELECT DISTINCT score_id, part_idx, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS here, CAST(0 AS BIGINT) AS begin_at, CAST(0 AS BIGINT) AS units, CAST(0 AS BIGINT) AS out, CAST(0 AS BIGINT) AS used FROM queue
  UNION ALL SELECT score_id, part_idx, rn, here, begin_at, u, here + CASE WHEN long AND begin_at + u >= 64 THEN 1 WHEN last THEN 1 ELSE 0 END, CASE WHEN last OR (long AND begin_at + u >= 64) THEN 0 ELSE begin_at + u END
  FROM (SELECT q.*, CASE WHEN q.long AND w.used > 0 AND w.used + q.u > 64 THEN w.out + 1 ELSE w.out END AS here, CASE WHEN q.long AND w.used > 0 AND w.used + q.u > 64 THEN 0 ELSE w.used END AS begin_at
    FROM walk w JOIN queue q ON q.score_id = w.score_id AND q.part_idx = w.part_idx AND q.rn = w.rn + 1))
SELECT score_id, part_idx, rn - 1 AS n, here AS measure_index, begin_at AS start, units FROM walk WHERE rn > 0""")
def long_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells longer than a measure, cut at measure lengths."""
    source = _long_cells(spark, sf_dir)
    cells = parsing.split_long_cells(parsing.grid_cells(lexing.tokens(source)), source.select("score_id", F.lit(64).alias("upm"))).where("kind = 'note'")
    n = F.row_number().over(Window.partitionBy("score_id", "part_idx").orderBy("tok_idx")) - 1
    return cells.select("score_id", "part_idx", n.cast("long").alias("n"), "measure_index", "start", F.col("units").cast("long").alias("units"))


@query(f"""WITH {NOTES_SQL},
cells AS (SELECT DISTINCT score_id, dense_rank() OVER (PARTITION BY score_id ORDER BY part_idx) - 1 AS part_idx, CAST(part_idx AS VARCHAR) AS part, dense_rank() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index) AS cell, (score_id + measure_index + part_idx) % 4 AS k FROM notes)
SELECT 'cellParseError' AS kind, score_id, part, CAST(part_idx AS BIGINT) AS part_idx, CAST(cell AS BIGINT) AS cell_index FROM cells WHERE k IN (1, 2)""")
def cell_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a repeat or a tuplet that doesn't close within them."""
    rows = notes(spark, sf_dir).select("score_id", "part_idx", "measure_index").distinct()
    k = (F.col("score_id") + F.col("measure_index") + F.col("part_idx")) % 4
    cell = F.when(k == 1, ":C4k").when(k == 2, "8(C4k").when(k == 3, "8(C4kC4k) :C4k:2").otherwise("C4k")
    part = rows.withColumn("t", cell).groupBy("score_id", "part_idx").agg(F.array_sort(F.collect_list(F.struct("measure_index", "t"))).alias("cs"))
    line = F.concat(F.lit("["), F.col("part_idx").cast("string"), F.lit("]| "), F.array_join(F.transform("cs", lambda c: c["t"]), " | "), F.lit(" |"))
    source = part.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("part_idx", line.alias("line")))).alias("ls")).select("score_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("source"))
    return parsing.cell_errors(lexing.tokens(source))
