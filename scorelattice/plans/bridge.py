"""Score relations made from the driver's tables, so that operators can be checked against SQL.

notes: orders are the measures of a customer's score, line items its notes. pixels: embeddings are page
rows. sources: notation texts written from the notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.functions.pitch import pc_name
from scorelattice.operators import shares


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_id, measure_index, part_idx, seq, units, abs_semitone, tie: a note for each line item."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    # measures are numbered over the few orders of a customer, before the line items come in
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    used = orders.join(items.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    measure = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    numbered = used.select("o_orderkey", F.col("o_custkey").cast("long").alias("score_id"), measure.cast("long").alias("measure_index"))
    rows = items.join(numbered, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.col("l_quantity").cast("long")
    rows = rows.select("score_id", "measure_index", F.col("l_linenumber").cast("long").alias("part_idx"), (F.lit(36) + F.col("l_partkey") % 48).cast("long").alias("abs_semitone"), (4 * (1 + (quantity - 1) % 8)).cast("long").alias("units"), (F.col("l_returnflag") == "R").alias("tie"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # dealt out by score once: whatever gathers, orders or reads notes by score finds them so
    rows = shares.dealt(rows, "score_id")
    order = Window.partitionBy("score_id", "measure_index", "part_idx").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select("score_id", "measure_index", "part_idx", "abs_semitone", "units", "tie", (F.row_number().over(order) - 1).cast("long").alias("seq"))


NOTES_SQL = """
raw_notes AS (
  SELECT CAST(o_custkey AS BIGINT) AS score_id,
    CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS measure_index,
    CAST(l_linenumber AS BIGINT) AS part_idx, CAST(36 + l_partkey % 48 AS BIGINT) AS abs_semitone,
    CAST(4 * (1 + (CAST(l_quantity AS BIGINT) - 1) % 8) AS BIGINT) AS units, l_returnflag = 'R' AS tie,
    l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
notes AS (
  SELECT score_id, measure_index, part_idx, abs_semitone, units, tie,
    CAST(row_number() OVER (PARTITION BY score_id, measure_index, part_idx ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS seq
  FROM raw_notes)"""


def pixels(spark: SparkSession, sf_dir: str, page_rows: int = 100) -> DataFrame:
    """page_id, y, x, gray: a row of pixels for each vector, `page_rows` of them a page."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    gray = F.floor((F.col("v").cast("double") + 1) * 127.5)
    return rows.select(F.floor(F.col("vec_id") / page_rows).cast("long").alias("page_id"), (F.col("vec_id") % page_rows).cast("long").alias("y"), F.col("x").cast("long").alias("x"), gray.cast("long").alias("gray"))


PIXELS_SQL = """
pixels AS (
  SELECT CAST(vec_id // 100 AS BIGINT) AS page_id, CAST(vec_id % 100 AS BIGINT) AS y, CAST(i - 1 AS BIGINT) AS x,
    CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS BIGINT) AS gray
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_id, source: a line for each part, cells between bars, a note written like C#4k."""
    rows = notes(spark, sf_dir)
    letter = F.element_at(F.array(*[F.lit(x) for x in "hijklm"]), (F.col("abs_semitone") % 6 + 1).cast("int"))
    word = F.concat(pc_name(F.col("abs_semitone") % 12), F.floor(F.col("abs_semitone") / 12).cast("string"), letter, F.when(F.col("tie"), "+").otherwise(""))
    cell = rows.withColumn("word", word).groupBy("score_id", "part_idx", "measure_index").agg(F.array_sort(F.collect_list(F.struct("seq", "word"))).alias("ws"))
    cell = cell.withColumn("cell", F.array_join(F.transform("ws", lambda w: w["word"]), " "))
    part = cell.groupBy("score_id", "part_idx").agg(F.array_sort(F.collect_list(F.struct("measure_index", "cell"))).alias("cs"))
    line = F.concat(F.lit("["), F.col("part_idx").cast("string"), F.lit("]| "), F.array_join(F.transform("cs", lambda c: c["cell"]), " | "), F.lit(" |"))
    text = part.withColumn("line", line).groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("part_idx", "line"))).alias("ls"))
    return text.select("score_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("source"))


SOURCES_SQL = """
words AS (SELECT score_id, part_idx, measure_index, seq,
    ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(abs_semitone % 12 + 1 AS INT)] || CAST(abs_semitone // 12 AS VARCHAR)
    || ['h','i','j','k','l','m'][CAST(abs_semitone % 6 + 1 AS INT)] || CASE WHEN tie THEN '+' ELSE '' END AS word FROM notes),
cell_texts AS (SELECT score_id, part_idx, measure_index, string_agg(word, ' ' ORDER BY seq) AS cell FROM words GROUP BY score_id, part_idx, measure_index),
line_texts AS (SELECT score_id, part_idx, '[' || CAST(part_idx AS VARCHAR) || ']| ' || string_agg(cell, ' | ' ORDER BY measure_index) || ' |' AS line FROM cell_texts GROUP BY score_id, part_idx),
sources AS (SELECT score_id, string_agg(line, chr(10) ORDER BY part_idx) AS source FROM line_texts GROUP BY score_id)"""
