"""Queries on documents: MusicXML out and in, text sinks, the chord row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.catalog import query
from scorelattice.operators import harmony, lexing, musicxml_in, musicxml_out, parsing
from scorelattice.plans.bridge import NOTES_SQL, SOURCES_SQL, notes, read, sources
from scorelattice.plans.grid_queries import POUR_SQL
from scorelattice.plans.notation_queries import fields_sql, texts, third, with_fields
from scorelattice.sources import scores as files

_STEP_SQL = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(abs_semitone % 12 + 1 AS INT)]"


def _each(text: Column, begin: str, end: str) -> Column:
    """What stands between a mark and the next end mark, each time: cut at fixed texts, which takes one pass."""
    cut = F.split(text, f"\\Q{begin}\\E", -1)
    return F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda x: F.substring_index(x, end, 1))


@query(f"""WITH RECURSIVE {NOTES_SQL},
ordered AS (SELECT score_id, dense_rank() OVER (PARTITION BY score_id ORDER BY part_idx) - 1 AS part_idx, row_number() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index, seq) - 1 AS seq, CAST(2 ** (abs_semitone % 6 + 1) AS BIGINT) AS units, {_STEP_SQL} AS name, abs_semitone // 12 AS octave, tie FROM notes),
queue AS (SELECT * FROM ordered), {POUR_SQL}
SELECT o.score_id, o.part_idx, p.measure_index, row_number() OVER (PARTITION BY o.score_id, o.part_idx, p.measure_index ORDER BY o.seq) - 1 AS pos, name[1:1] AS step, CASE WHEN len(name) = 2 THEN 1 ELSE 0 END AS alter, CAST(octave AS INT) AS octave, p.units AS duration, tie AS tie_start
FROM poured p JOIN ordered o ON o.score_id = p.score_id AND o.part_idx = p.part_idx AND o.seq = p.out_seq""")
def music_xml_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compiled to documents; the notes of every measure read back from the mark-up."""
    docs = musicxml_out.documents(sources(spark, sf_dir))
    parts = docs.select("score_id", F.posexplode(_each(F.col("music_xml"), '<part id="', "</part>")).alias("part_idx", "part"))
    measures = parts.select("score_id", "part_idx", F.posexplode(_each(F.col("part"), '<measure number="', "</measure>")).alias("measure_index", "measure"))
    own = F.filter(_each(F.col("measure"), "<note>", "</note>"), lambda n: n.contains("<pitch>"))
    rows = measures.select("score_id", "part_idx", "measure_index", F.posexplode(own).alias("pos", "note"))
    get = lambda tag: F.regexp_extract("note", f"<{tag}>([^<]*)</{tag}>", 1)
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("score_id", long("part_idx"), long("measure_index"), long("pos"), get("step").alias("step"), F.coalesce(F.nullif(get("alter"), F.lit("")).cast("int"), F.lit(0)).alias("alter"), get("octave").cast("int").alias("octave"), get("duration").cast("long").alias("duration"), F.col("note").contains('<tie type="start"/>').alias("tie_start"))


#: A command, marks of a note, a barrier; and what each must write once.
_COMMANDS = {"[Dff]": "<dynamics><ff/></dynamics>", "[D<]": 'type="crescendo"', "[C:Am7]": 'text="Am7">minor-seventh<', "[C:Bb]": "<root-alter>-1<", "[segno]": "<segno/>", "[DC.fine]": "D.C. al Fine", "[R:A]": "<rehearsal>A<", "[text:a & b]": "a &amp; b", "[expr:dolce]": 'font-style="italic"', "[8va]": 'type="up" size="8"', "[ped/]": '<pedal type="stop"', "[So]": "<line>1</line>", "[KG]": "<attributes><key><fifths>1<", "[V1]": '<ending number="1" type="start"', "": "no such text"}
_SUFFIX_OF = {"tr": "<trill-mark/>", ">": "<accent/>", "~l": 'shape="square"', "_": '<slur type="stop"', "z2": '<tremolo type="single">2<', "jf": "<falloff/>", "V": "<up-bow/>", "ar": "<arpeggiate/>", "": "no such text"}
_BARRIER_OF = {",": "no such text", ",,": "light-light", ":,": '<repeat direction="backward"', ",-": "<bar-style>dashed<", ",.": "<bar-style>none<"}
_HEADS = {"": "no such text", "!d": "<notehead>diamond<", "!x": "<notehead>x<"}
_GRACES = {"": "no such text", "`": "<grace/>", "``": '<grace slash="yes"/>'}
_choice = lambda table, index: "CASE CAST(" + index + " AS INT) " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(table)) + " END"
_DIRECTION_FIELDS = {
    "own": _choice(_COMMANDS, f"h % {len(_COMMANDS)}"), "mark": _choice(_SUFFIX_OF, f"{third('h')} % {len(_SUFFIX_OF)}"), "barrier": _choice(_BARRIER_OF, f"(h + 1) % {len(_BARRIER_OF)}"), "head": _choice(_HEADS, "(h + part_idx) % 3"), "ornament": _choice(_GRACES, f"({third('h')} + seq) % 3"),
    "word": "own || ' ' || ornament || 'C4' || head || 'k' || mark || ' ' || barrier",
}
_COUNTED = [(c, k, x) for c, table in (("own", _COMMANDS), ("mark", _SUFFIX_OF), ("barrier", _BARRIER_OF), ("head", _HEADS), ("ornament", _GRACES)) for k, x in table.items() if x != "no such text"]


@query(f"""WITH {NOTES_SQL}, {fields_sql(_DIRECTION_FIELDS)}
SELECT score_id, count(*) + 1 AS n_measures, {", ".join(f"count(*) FILTER ({c} = '{k}') AS c{i}" for i, (c, k, _) in enumerate(_COUNTED))} FROM rich GROUP BY score_id""")
def music_xml_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each command, mark, head, grace and barline stands in the documents of a text that has them all."""
    source = texts(with_fields(notes(spark, sf_dir), _DIRECTION_FIELDS))
    docs = musicxml_out.documents(source.withColumn("source", F.concat(F.lit("C4k , "), "source")))
    count = lambda x: F.size(F.split("music_xml", "\\Q" + x + "\\E", -1)) - 1
    return docs.select("score_id", F.col("n_measures").cast("long").alias("n_measures"), *[count(x).cast("long").alias(f"c{i}") for i, (_, _, x) in enumerate(_COUNTED)])


# --- import ---------------------------------------------------------------

_XML_FIELDS = {
    "u": "CAST(4 * power(2, (units / 4) % 4) AS BIGINT)",
    "joined": "seq > 0 AND measure_index % 5 > 0 AND abs_semitone % 4 = 0",
    "voice": "CASE WHEN measure_index % 5 = 0 AND seq > 0 THEN 2 ELSE 1 END",
}
_XML_NOTE = """'<note>' || CASE WHEN joined THEN '<chord/>' ELSE '' END || '<pitch><step>' || substr(name, 1, 1) || '</step>' || CASE WHEN length(name) = 2 THEN '<alter>1</alter>' ELSE '' END || '<octave>' || CAST(octave AS VARCHAR(2)) || '</octave></pitch><duration>' || CAST(u AS VARCHAR(3)) || '</duration><voice>' || CAST(voice AS VARCHAR(1)) || '</voice></note>'"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MusicXML of the notes: part by part or, for every second score, measure by measure; with comments and part names."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")]), (F.col("abs_semitone") % 12 + 1).cast("int"))
    rows = with_fields(notes(spark, sf_dir), _XML_FIELDS).withColumns({"name": name, "octave": F.floor(F.col("abs_semitone") / 12)}).withColumn("xml", F.expr(_XML_NOTE))
    gathered = lambda df, keys, order, out: df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, out))), lambda x: x[out]), "").alias(out))
    cells = gathered(rows, ["score_id", "part_idx", "measure_index"], ["seq"], "xml")
    opens = F.col("measure_index") == F.min("measure_index").over(Window.partitionBy("score_id", "part_idx"))
    cells = cells.withColumn("xml", F.concat(F.when(opens, "<attributes><divisions>16</divisions></attributes>").otherwise("<!-- no <note> here -->"), "xml"))
    number = F.concat(F.lit('<measure number="'), (F.col("measure_index") + 1).cast("string"), F.lit('">'))
    part = F.concat(F.lit('<part id="P'), F.col("part_idx").cast("string"), F.lit('">'))
    end = lambda x, tag: F.concat(x, "xml", F.lit(f"</{tag}>"))
    by_part = gathered(cells.where("score_id % 2 = 0").withColumn("xml", end(number, "measure")), ["score_id", "part_idx"], ["measure_index"], "xml").withColumn("xml", end(part, "part"))
    by_part = gathered(by_part, ["score_id"], ["part_idx"], "xml").select("score_id", F.lit("partwise").alias("form"), "xml")
    by_time = gathered(cells.where("score_id % 2 = 1").withColumn("xml", end(part, "part")), ["score_id", "measure_index"], ["part_idx"], "xml").withColumn("xml", end(number, "measure"))
    by_time = gathered(by_time, ["score_id"], ["measure_index"], "xml").select("score_id", F.lit("timewise").alias("form"), "xml")
    shown = F.concat(F.lit('<score-part id="P'), F.col("part_idx").cast("string"), F.lit('"><part-name>'), F.when(F.col("part_idx") % 2 == 0, "Alto").otherwise(F.concat(F.lit("Part "), F.col("part_idx").cast("string"))), F.lit("</part-name></score-part>"))
    listed = gathered(rows.select("score_id", "part_idx").distinct().withColumn("names", shown), ["score_id"], ["part_idx"], "names")
    root = F.concat(F.lit("<score-"), "form", F.lit("><part-list>"), "names", F.lit("</part-list>"), "xml", F.lit("</score-"), "form", F.lit(">"))
    return by_part.unionByName(by_time).join(listed, "score_id").select("score_id", root.alias("xml"))


# In a document of parts the first of them to stand anywhere comes first; in one of measures, the first to sound.
_PLACES_SQL = """places AS (SELECT score_id, part_idx, dense_rank() OVER (PARTITION BY score_id ORDER BY CASE WHEN score_id % 2 = 1 THEN min(measure_index) ELSE 0 END, part_idx) - 1 AS place FROM notes GROUP BY score_id, part_idx)"""


@query(f"""WITH {NOTES_SQL}, {fields_sql(_XML_FIELDS)}, {_PLACES_SQL},
heads AS (SELECT *, max(CASE WHEN NOT joined THEN seq END) OVER (PARTITION BY score_id, part_idx, measure_index ORDER BY seq) AS head, dense_rank() OVER (PARTITION BY score_id ORDER BY measure_index) - 1 AS at FROM rich WHERE voice = 1)
SELECT h.score_id, place AS part_idx, CASE WHEN h.part_idx % 2 = 0 THEN 'Alto' ELSE '' END AS instrument, h.at AS measure_index, h.abs_semitone, f.u AS units
FROM heads h JOIN rich f ON f.score_id = h.score_id AND f.part_idx = h.part_idx AND f.measure_index = h.measure_index AND f.seq = h.head JOIN places p ON p.score_id = h.score_id AND p.part_idx = h.part_idx""")
def music_xml_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of both forms converted to text, lexed and cut into cells: first voices, chords, names, aligned measures."""
    found = musicxml_in.sources(_documents(spark, sf_dir)).select("score_id", "source")
    cells = lexing.notes_of(parsing.grid_cells(lexing.tokens(found)))
    return cells.select("score_id", "part_idx", F.coalesce("instrument", F.lit("")).alias("instrument"), "measure_index", "abs_semitone", F.col("units").cast("long").alias("units"))


@query(f"""WITH {NOTES_SQL}, {fields_sql(_XML_FIELDS)}, {_PLACES_SQL},
measures AS (SELECT score_id, part_idx, measure_index, count(DISTINCT voice) AS voices FROM rich GROUP BY ALL),
parts AS (SELECT score_id, part_idx, count(*) AS n FROM measures GROUP BY ALL), totals AS (SELECT score_id, count(DISTINCT measure_index) AS total FROM measures GROUP BY ALL)
SELECT m.score_id, place AS part_index, 'multipleVoices' AS kind, count(*) AS n FROM measures m JOIN places p USING (score_id, part_idx) WHERE voices > 1 GROUP BY ALL
UNION ALL SELECT score_id, place, 'partMeasureCountMismatch', 1 FROM parts JOIN totals USING (score_id) JOIN places USING (score_id, part_idx) WHERE n < total""")
def import_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.diagnostics(musicxml_in.sources(_documents(spark, sf_dir)))
    return found.groupBy("score_id", F.col("part_index").cast("long").alias("part_index"), "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {NOTES_SQL}, measures AS (SELECT DISTINCT score_id, part_idx, measure_index FROM notes),
parts AS (SELECT score_id, part_idx, count(*) AS n FROM measures GROUP BY ALL), totals AS (SELECT score_id, count(DISTINCT measure_index) AS total FROM measures GROUP BY ALL)
SELECT score_id, count(*) AS n_parts, any_value(total) AS n_measures, count(*) FILTER (n < total) AS n_short FROM parts JOIN totals USING (score_id) GROUP BY ALL""")
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a converted corpus."""
    rows = files.corpus_index(musicxml_in.sources(_documents(spark, sf_dir)))
    short = F.filter("diagnostics", lambda d: d["kind"] == "partMeasureCountMismatch")
    return rows.select("score_id", F.col("n_parts").cast("long").alias("n_parts"), F.col("n_measures").cast("long").alias("n_measures"), F.coalesce(F.get(short, F.lit(0))["n"], F.lit(0)).cast("long").alias("n_short"))


# --- text sinks -----------------------------------------------------------


@query(f"WITH {NOTES_SQL}, {SOURCES_SQL} SELECT score_id, '[KEY:G]' || chr(10) || source AS source FROM sources")
def grid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as notation text: a header, a line a part, bars between cells."""
    rows = notes(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(x) for x in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")]), (F.col("abs_semitone") % 12 + 1).cast("int"))
    word = F.concat(name, F.floor(F.col("abs_semitone") / 12).cast("string"), F.expr("substr('hijklm', CAST(abs_semitone % 6 AS INT) + 1, 1)"), F.when(F.col("tie"), "+").otherwise(""))
    cells = rows.withColumn("w", word).groupBy("score_id", "part_idx", "measure_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "w"))), lambda x: x["w"]), " ").alias("text"))
    return files.grid_text(cells.withColumn("label", F.col("part_idx").cast("string")), F.lit("[KEY:G]"))


_RUN_NAME = "CASE score % 4 WHEN 0 THEN NULL WHEN 1 THEN 'C' WHEN 2 THEN 'Am7' ELSE 'G7/B2' END"
_DEGREE = "CASE score % 3 WHEN 0 THEN NULL WHEN 1 THEN 'I' ELSE 'V7' END"


@query(f"""WITH {NOTES_SQL},
runs AS (SELECT score_id, measure_index, part_idx AS segment, sum(units) AS u, score_id + measure_index + part_idx AS score FROM notes GROUP BY ALL),
lengths(letter, size, above, place) AS (VALUES ('m', 64, 1000000, 0), ('l', 32, 64, 1), ('k', 16, 32, 2), ('j', 8, 16, 3), ('i', 4, 8, 4), ('h', 2, 4, 5)),
pieces AS (SELECT score_id, measure_index, segment, place, r.i, coalesce({_RUN_NAME}, '?') || '_' || letter AS word FROM runs, lengths, unnest(range(0, CAST((u % above) // size AS BIGINT))) AS r(i)),
cells AS (SELECT score_id, measure_index, string_agg(word, ' ' ORDER BY segment, place, i) AS words, score_id + measure_index AS score FROM pieces GROUP BY ALL)
SELECT score_id, '[C]| ' || string_agg(coalesce({_DEGREE} || '/ ', '') || words, ' | ' ORDER BY measure_index) || ' |' AS row FROM cells GROUP BY score_id""")
def chord_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chord line of a score: degrees, names, and lengths written out."""
    runs = notes(spark, sf_dir).groupBy("score_id", "measure_index", F.col("part_idx").alias("segment")).agg(F.sum("units").alias("units")).withColumn("score", F.expr("score_id + measure_index + segment"))
    summaries = notes(spark, sf_dir).select("score_id", "measure_index").distinct().withColumn("score", F.expr("score_id + measure_index"))
    return harmony.chord_row(runs.withColumn("name", F.expr(_RUN_NAME)), summaries.withColumn("relative", F.expr(_DEGREE)), F.lit(64))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM documents WHERE text IS NOT NULL")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(musicxml_out.escaped(F.col("text")).cast("binary")).alias("digest"))


