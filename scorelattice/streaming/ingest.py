"""Score files as they arrive. An extension: batch readers of the package see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelattice.operators import harmony, lexing, parsing


def read_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """score_id, path, source of every new file."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    path = F.input_file_name()
    return rows.select(F.xxhash64(path).alias("score_id"), path.alias("path"), F.col("value").alias("source"))


def label_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chord labels of new scores, appended as Parquet. Scores don't depend on each other, so a batch is analysed as a table."""

    def one(batch: DataFrame, number: int) -> None:
        labels = harmony.measure_labels(lexing.notes_of(parsing.grid_cells(lexing.tokens(batch))))
        labels.withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
