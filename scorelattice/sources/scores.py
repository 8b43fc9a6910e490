"""Files of scores in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.operators.musicxml_in import score_of_archive


def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """score_id, path, source: a row for each file. A folder with a name filter is listed once, unlike a path glob."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    path = F.input_file_name()
    return rows.select(F.xxhash64(path).alias("score_id"), path.alias("path"), F.col("value").alias("source"))


def read_music_xml(spark: SparkSession, folder: str) -> DataFrame:
    """score_id, path, xml of plain documents."""
    rows = read_texts(spark, folder, "*.{xml,musicxml}")
    return rows.withColumnRenamed("source", "xml")


def read_archives(spark: SparkSession, folder: str, glob: str = "*.mxl") -> DataFrame:
    """score_id, path, xml of compressed containers; null where a container holds no score."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1):
                try:
                    out.append(score_of_archive(data.as_py()))
                except Exception:  # a damaged container is a row without a score
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "xml"])

    rows = files.select("path", "content").mapInArrow(unpack, "path string, xml string")
    return rows.select(F.xxhash64("path").alias("score_id"), "path", "xml")


def has_extension(name: Column, extension: str) -> Column:
    return F.lower(name).endswith("." + extension.lower())


def write_texts(rows: DataFrame, folder: str, column: str = "source") -> None:
    """One text a line of JSON, with its score_id: a sink that splits and can be read again."""
    rows.select("score_id", column).write.mode("overwrite").json(folder)


def grid_text(cells: DataFrame, header: Column) -> DataFrame:
    """Notation text of cells (score_id, part_idx, label, measure_index, text): a header line and a line a part."""
    lines = cells.groupBy("score_id", "part_idx", "label").agg(F.array_sort(F.collect_list(F.struct("measure_index", "text"))).alias("cs"))
    line = F.concat(F.lit("["), F.col("label"), F.lit("]| "), F.array_join(F.transform("cs", lambda c: c["text"]), " | "), F.lit(" |"))
    whole = lines.select("score_id", "part_idx", line.alias("line")).groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("part_idx", "line"))).alias("ls"))
    return whole.select("score_id", F.concat_ws("\n", F.nullif(header, F.lit("")), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("source"))


def corpus_index(converted: DataFrame) -> DataFrame:
    """Statistics of a converted corpus, a row a score: parts, measures, size and the kinds of its diagnostics."""
    kinds = F.transform(F.array_sort(F.array_distinct(F.transform("diagnostics", lambda d: d["kind"]))), lambda k: F.struct(k.alias("kind"), F.size(F.filter("diagnostics", lambda d: d["kind"] == k)).alias("n")))
    return converted.select("score_id", "n_parts", "n_measures", F.length("source").alias("n_chars"), kinds.alias("diagnostics"), "error")


def diagnostics(converted: DataFrame) -> DataFrame:
    """A row for each diagnostic."""
    return converted.select("score_id", F.explode("diagnostics").alias("d")).select("score_id", "d.*")


def with_external(rows: DataFrame, call: Callable[[str], str], column: str, out: str) -> DataFrame:
    """Rows with the reply of an outside program to a text column. The program is the caller's; there is no default."""
    from pyspark.sql.types import StringType, StructField, StructType

    at = rows.columns.index(column)
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = pa.array([call(x.as_py()) if x.is_valid else None for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, replies], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def rasters(files: DataFrame, rasterise: Callable[[bytes], list[tuple[int, int, bytes]]]) -> DataFrame:
    """page_id, path, width, height, rgba of documents (path, content), by a rasteriser that the caller brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, path.as_py(), w, h, rgba) for path, data in zip(batch.column(0), batch.column(1), strict=True) for k, (w, h, rgba) in enumerate(rasterise(data.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["page_index", "path", "width", "height", "rgba"])

    pages = files.select("path", "content").mapInArrow(run, "page_index long, path string, width int, height int, rgba binary")
    return pages.withColumn("page_id", F.xxhash64("path", "page_index"))
