"""Queries on notation text and on replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.catalog import query
from scorelattice.operators import harmony, lexing, parsing, proposals
from scorelattice.plans.bridge import NOTES_SQL, SOURCES_SQL, notes, sources
from scorelattice.plans.harmony_queries import _BASIC_SQL, _LABELS_SQL, _SYMBOL_SQL

#: The composed texts need no look-ahead: a pattern that SQL's engine has too cuts them the same way.
_TOKENS_SQL = f"""{NOTES_SQL}, {SOURCES_SQL},
cut AS (SELECT score_id, source, regexp_extract_all(source, '\\[[0-9]+\\]|\\||[A-G]#?[0-9][hijklm]|\\+') AS raws FROM sources),
tokens AS (SELECT score_id, i, raws[i] AS raw, CASE WHEN raws[i][1:1] = '[' THEN 'meta' WHEN raws[i] = '|' THEN 'barline' WHEN raws[i] = '+' THEN 'tie' ELSE 'note' END AS kind FROM cut, unnest(range(1, len(raws) + 1)) AS r(i))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexing.tokens(sources(spark, sf_dir))


@query(f"""WITH {_TOKENS_SQL}
SELECT score_id, i - 1 AS n, kind, raw, CASE WHEN kind = 'note' THEN CAST(2 ** (strpos('hijklm', raw[-1:])) AS BIGINT) ELSE -1 END AS units FROM tokens""")
def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = _tokens(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("score_id").orderBy("tok_idx")) - 1
    return rows.select("score_id", n.cast("long").alias("n"), "kind", "raw", F.coalesce("units", F.lit(-1)).cast("long").alias("units"))


@query(f"""WITH {_TOKENS_SQL},
marked AS (SELECT *, last_value(CASE WHEN kind = 'meta' THEN raw[2:-2] END IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM tokens)
SELECT score_id, part, count(*) AS n_tokens, count(*) FILTER (kind = 'note') AS n_notes, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY min(i)) - 1 AS BIGINT) AS part_idx FROM marked WHERE kind <> 'meta' GROUP BY score_id, part""")
def part_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.with_parts(_tokens(spark, sf_dir))
    return rows.groupBy("score_id", "part", "part_idx").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("kind") == "note").alias("n_notes"))


@query(f"""WITH {NOTES_SQL}
SELECT score_id, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY part_idx) - 1 AS BIGINT) AS part_idx,
  CAST(dense_rank() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index) - 1 AS BIGINT) AS measure_index,
  count(*) AS n_notes, CAST(sum(2 ** (abs_semitone % 6 + 1)) AS BIGINT) AS units, min(abs_semitone) AS lowest FROM notes GROUP BY score_id, part_idx, measure_index""".replace("GROUP BY score_id, part_idx, measure_index", "GROUP BY notes.score_id, notes.part_idx, notes.measure_index"))
def cells_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed texts lexed and cut into cells: the cells of the notes that they were written from."""
    cells = parsing.grid_cells(_tokens(spark, sf_dir))
    rows = lexing.notes_of(cells)
    return rows.groupBy("score_id", "part_idx", F.col("measure_index").cast("long").alias("measure_index")).agg(F.count("*").alias("n_notes"), F.sum("units").cast("long").alias("units"), F.min("abs_semitone").alias("lowest"))


@query(f"""WITH {NOTES_SQL},
texts AS (SELECT score_id, measure_index, part_idx, tie, lag(seq) OVER (PARTITION BY score_id, part_idx, measure_index ORDER BY seq) AS b FROM notes)
SELECT score_id, count(*) AS n_notes, count(*) FILTER (tie) AS n_ties FROM texts GROUP BY score_id""")
def tie_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.attached(_tokens(spark, sf_dir)).where("kind = 'note'")
    return rows.groupBy("score_id").agg(F.count("*").alias("n_notes"), F.count_if(F.col("tie")).alias("n_ties"))


@query(f"""WITH {NOTES_SQL}, {_BASIC_SQL},
cells AS (SELECT *, dense_rank() OVER (PARTITION BY score_id, part_idx ORDER BY measure_index) - 1 AS cell FROM notes),
sets AS (SELECT score_id, CAST(cell AS BIGINT) AS measure_index, list_sort(list(DISTINCT CAST(abs_semitone % 12 AS INT))) AS pcs, CAST(min(abs_semitone) % 12 AS INT) AS bass_pc FROM cells GROUP BY ALL),
{_LABELS_SQL.format(keys="score_id, measure_index")}
{_SYMBOL_SQL}""")
def text_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to chords: lex, cut into parts and cells, label every measure."""
    return harmony.measure_labels(lexing.notes_of(parsing.grid_cells(_tokens(spark, sf_dir))))


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the first part's bars doubled for some scores: the reply to compare."""
    return sources(spark, sf_dir).withColumn("source", F.when(F.col("score_id") % 3 == 0, F.regexp_replace("source", r"\[1\]\|", "[1]| Rm |")).otherwise(F.col("source")))


@query(f"""WITH {NOTES_SQL}, {SOURCES_SQL},
revised AS (SELECT score_id, CASE WHEN score_id % 3 = 0 THEN regexp_replace(source, '\\[1\\]\\|', '[1]| Rm |') ELSE source END AS source FROM sources),
a AS (SELECT score_id, i - 1 AS line_no, string_split(source, chr(10))[i] AS line FROM sources, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS r(i)),
b AS (SELECT score_id, i - 1 AS line_no, string_split(source, chr(10))[i] AS line FROM revised, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS r(i))
SELECT score_id, 'removed' AS change, line_no, line FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.score_id = a.score_id AND b.line = a.line)
UNION ALL SELECT score_id, 'added', line_no, line FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.score_id = b.score_id AND a.line = b.line)""")
def proposal_line_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.line_delta(sources(spark, sf_dir), _revised(spark, sf_dir), "score_id")


@query(f"""WITH {NOTES_SQL}, {SOURCES_SQL},
revised AS (SELECT score_id, CASE WHEN score_id % 3 = 0 THEN regexp_replace(source, '\\[1\\]\\|', '[1]| Rm |') ELSE source END AS source FROM sources)
SELECT DISTINCT s.score_id, '1' AS label, 'changed' AS change FROM sources s JOIN revised r ON r.score_id = s.score_id WHERE s.source <> r.source""")
def changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as fenced blocks: extracted, then compared part by part with the original."""
    reply = _revised(spark, sf_dir).select(F.col("score_id").alias("response_id"), F.concat(F.lit("A bar more.\n\n```score\n"), "source", F.lit("\n```\n")).alias("text"))
    found = proposals.proposals(reply, "score").select(F.col("response_id").alias("score_id"), "source")
    return proposals.changed_parts(proposals.part_lines(sources(spark, sf_dir), "score_id"), proposals.part_lines(found, "score_id"), "score_id")


_PITCHES_SQL = """cells AS (SELECT score_id, measure_index, part_idx, list(abs_semitone ORDER BY seq) AS pitches FROM notes GROUP BY ALL),
other AS (SELECT score_id, measure_index, part_idx, list(abs_semitone + CASE WHEN (score_id + measure_index) % 4 = 0 THEN 1 ELSE 0 END ORDER BY seq) AS pitches FROM notes WHERE (score_id + measure_index + part_idx) % 11 <> 0 GROUP BY ALL)"""


@query(f"""WITH {NOTES_SQL}, {_PITCHES_SQL}
SELECT DISTINCT coalesce(a.score_id, b.score_id) AS score_id, coalesce(a.measure_index, b.measure_index) AS measure_index FROM cells a FULL JOIN other b
  ON a.score_id = b.score_id AND a.measure_index = b.measure_index AND a.part_idx = b.part_idx
WHERE a.pitches IS DISTINCT FROM b.pitches AND NOT coalesce(a.measure_index, b.measure_index) + 1 BETWEEN 3 AND 5""")
def leaked_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    key = ["score_id", "measure_index", "part_idx"]
    cells = lambda df: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "abs_semitone"))), lambda x: x["abs_semitone"]).alias("pitches"))
    moved = rows.where("(score_id + measure_index + part_idx) % 11 <> 0").withColumn("abs_semitone", F.col("abs_semitone") + F.when((F.col("score_id") + F.col("measure_index")) % 4 == 0, 1).otherwise(0))
    return proposals.leaked_measures(cells(rows), cells(moved), F.lit(3), F.lit(5))


@query(f"""WITH {NOTES_SQL},
ids AS (SELECT score_id, measure_index, part_idx, seq, 'p' || measure_index % 3 || 's' || measure_index || 'i' || part_idx || 'm' || seq AS cell_id FROM notes),
asked AS (SELECT DISTINCT score_id AS key, cell_id FROM ids WHERE part_idx % 2 = 0),
given AS (SELECT score_id AS key, cell_id, part_idx, measure_index, row_number() OVER (PARTITION BY score_id, cell_id ORDER BY k) AS rank, cell_id || '/' || k AS text FROM ids, (VALUES (0), (1)) AS c(k) WHERE part_idx % 3 <> 0 AND (k = 0 OR measure_index % 2 = 0))
SELECT key, cell_id, CASE WHEN EXISTS (SELECT 1 FROM asked a WHERE a.key = g.key AND a.cell_id = g.cell_id) THEN CASE WHEN rank = 1 THEN 'accepted' ELSE 'repeated' END ELSE 'unexpected' END AS status, text FROM given g
UNION ALL SELECT key, cell_id, 'missing', '-' FROM asked a WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.key = a.key AND g.cell_id = a.cell_id)""")
def override_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelattice.operators.assembly import cell_id

    ids = notes(spark, sf_dir).withColumn("cell_id", cell_id(F.col("measure_index") % 3, F.col("measure_index"), F.col("part_idx"), F.col("seq"))).withColumn("key", F.col("score_id"))
    asked = ids.where("part_idx % 2 = 0").select("key", "cell_id")
    given = ids.where("part_idx % 3 <> 0").withColumn("at", F.explode(F.array(F.lit(0), F.lit(1)))).where("at = 0 or measure_index % 2 = 0")
    given = given.select("key", "cell_id", "at", F.concat("cell_id", F.lit("/"), F.col("at").cast("string")).alias("text"))
    return proposals.reconcile(asked, given).withColumn("text", F.coalesce("text", F.lit("-")))
