"""How many shares rows are dealt out to, so that a task's share stays the same size however large the input is.

Texts and numbers of notes are small as they are moved and many times larger as tokens, so that shuffles sized by what
they move give tasks that grow with the input. The number of shares grows with the files that are read instead.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

#: Bytes of files for each share; small inputs are cut finer, down to the least, so that every core has some.
SHARE, LEAST = 4 << 20, 1 << 17


def read_bytes(rows: DataFrame) -> int | None:
    """Bytes of the files that rows are read from, each counted once; null where that isn't known. Runs nothing."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    sizes: dict[str, int] = {}
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and "HadoopFsRelation" in leaf.relation().getClass().getSimpleName():
            sizes[leaf.relation().location().rootPaths().mkString(",")] = leaf.relation().sizeInBytes()
        elif kind in ("LocalRelation", "OneRowRelation", "Range"):
            sizes[f"{k}"] = int(leaf.stats().sizeInBytes().toString())
        else:
            return None
    return sum(sizes.values())


def count(rows: DataFrame) -> int:
    """Shares for rows; the session's number of shuffle partitions where the size of their input isn't known."""
    spark = rows.sparkSession
    size = read_bytes(rows)
    if size is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, ceil(size / SHARE), min(2 * spark.sparkContext.defaultParallelism, ceil(size / LEAST)))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many shares as their input asks for. Nothing moves where they lie so already."""
    return rows.repartition(count(rows), *keys)
