"""Page rasters as pixel rows: thresholds, projections, staves, cells, components.

pixels: page_id, y, x, gray (0 to 255) or ink (0 or 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gray_of(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """Integer luma; transparent pixels are white."""
    return F.when(alpha == 0, 255).otherwise(F.shiftright(77 * r + 150 * g + 29 * b, 8))


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("page_id", "gray").agg(F.count("*").alias("n"))


def otsu(counts: DataFrame) -> DataFrame:
    """The threshold of each page: the first gray of the greatest variance between classes; 128 for one colour."""
    w, upto = Window.partitionBy("page_id"), Window.partitionBy("page_id").orderBy("gray")
    n, total = F.sum("n").over(w).cast("double"), F.sum(F.col("gray") * F.col("n")).over(w).cast("double")
    back, sum_back = F.sum("n").over(upto).cast("double"), F.sum(F.col("gray") * F.col("n")).over(upto).cast("double")
    rows = counts.withColumns({"wb": back, "sb": sum_back, "all": n, "sum": total}).withColumn("wf", F.col("all") - F.col("wb"))
    diff = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / F.col("wf")
    rows = rows.withColumn("between", F.when(F.col("wf") > 0, F.col("wb") * F.col("wf") * diff * diff))
    best = rows.where("between > 0").groupBy("page_id").agg(F.max(F.struct("between", -F.col("gray"))).alias("m"))
    best = best.select("page_id", (-F.col("m").getField("col2")).alias("best"))
    return counts.select("page_id").distinct().join(best, "page_id", "left").select("page_id", F.coalesce("best", F.lit(128)).cast("long").alias("threshold"))


def binarize(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """ink is 1 where gray is at most the page's threshold."""
    return pixels.join(thresholds, "page_id").withColumn("ink", (F.col("gray") <= F.col("threshold")).cast("long"))


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part of each page inside a box, moved to its corner; the box is clipped to the page."""
    inside = pixels.where((F.col("x") >= max(0, x)) & (F.col("x") < x + w) & (F.col("y") >= max(0, y)) & (F.col("y") < y + h))
    return inside.withColumns({"x": F.col("x") - max(0, x), "y": F.col("y") - max(0, y)})


def row_projection(ink: DataFrame) -> DataFrame:
    return ink.groupBy("page_id", "y").agg(F.sum("ink").cast("long").alias("ink"))


def band_projection(ink: DataFrame, y0: int, y1: int) -> DataFrame:
    """Ink of each column between two rows (the second excluded)."""
    return ink.where((F.col("y") >= y0) & (F.col("y") < y1)).groupBy("page_id", "x").agg(F.sum("ink").cast("long").alias("ink"))


def runs(lines: DataFrame, at: str, *keys: str) -> DataFrame:
    """Islands of neighbouring positions: first, last and centre."""
    w = Window.partitionBy(*keys).orderBy(at)
    island = F.col(at) - F.row_number().over(w)
    found = lines.withColumn("island", island).groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return found.select(*keys, "first", "last", ((F.col("first") + F.col("last")) / 2).alias("centre"))


def staff_lines(projection: DataFrame, share: float, width: Column) -> DataFrame:
    """Centres of the runs of rows with ink on at least a share of the width."""
    return runs(projection.where(F.col("ink") >= width * share), "y", "page_id")


def staves(lines: DataFrame, size: int = 5) -> DataFrame:
    """Lines by fives: staff_idx, its lines, the median gap and whether the gaps are irregular; a remainder is dropped."""
    w = Window.partitionBy("page_id").orderBy("centre")
    numbered = lines.withColumn("staff_idx", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    found = numbered.groupBy("page_id", "staff_idx").agg(F.array_sort(F.collect_list("centre")).alias("line_ys")).where(F.size("line_ys") == size)
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda i: F.get(F.col("line_ys"), i) - F.get(F.col("line_ys"), i - 1)))
    n = size - 1
    middle = (F.get("gaps", F.lit((n - 1) // 2)) + F.get("gaps", F.lit(n // 2))) / 2
    out = found.withColumn("gaps", gaps).withColumn("line_spacing", middle)
    least, most = F.get("gaps", F.lit(0)), F.get("gaps", F.lit(n - 1))
    irregular = (most > least * 1.5) & (most - least > 2)
    return out.select("page_id", "staff_idx", "line_ys", "line_spacing", irregular.alias("irregular"))


def leftover_lines(lines: DataFrame, size: int = 5) -> DataFrame:
    """Lines that no staff takes, as a warning count."""
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines")).select("page_id", (F.col("n_lines") % size).cast("long").alias("leftover")).where("leftover > 0")


def systems(staff_rows: DataFrame, per_system: int) -> DataFrame:
    """staves with system_idx and their place in it."""
    return staff_rows.withColumn("system_idx", F.floor(F.col("staff_idx") / per_system).cast("long")).withColumn("part_idx", (F.col("staff_idx") % per_system).cast("long"))


def barline_columns(columns: DataFrame, n_staves: Column | int) -> DataFrame:
    """Columns that are candidates in every staff of a system. columns: page_id, system_idx, staff_idx, x."""
    n = n_staves if isinstance(n_staves, Column) else F.lit(n_staves)
    # distinct pairs first, so that a plain count decides
    found = columns.select("page_id", "system_idx", "staff_idx", "x").distinct().groupBy("page_id", "system_idx", "x").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == n).drop("n")


def cell_boxes(barlines: DataFrame, staff_rows: DataFrame) -> DataFrame:
    """A box for each pair of neighbouring barlines and each staff of their system.

    barlines: page_id, system_idx, bar_x; staff_rows: page_id, system_idx, staff_idx, top, bottom.
    """
    w = Window.partitionBy("page_id", "system_idx").orderBy("bar_x")
    pairs = barlines.withColumns({"right": F.lead("bar_x").over(w), "measure_idx": (F.row_number().over(w) - 1).cast("long")}).where("right is not null")
    boxes = pairs.join(staff_rows, ["page_id", "system_idx"])
    return boxes.select("page_id", "system_idx", "staff_idx", "measure_idx", F.col("bar_x").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("bar_x")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))


def reading_order(cells: DataFrame) -> DataFrame:
    """Global measure index of each cell along its staff place in its document: page, system, measure."""
    w = Window.partitionBy("doc_id", "part_idx").orderBy("page_id", "system_idx", "measure_idx")
    return cells.withColumn("global_measure", (F.row_number().over(w) - 1).cast("long"))


def remove_lines(ink: DataFrame, lines: DataFrame, reach: int = 2) -> DataFrame:
    """Clears ink on staff lines that has no ink `reach` rows above or below. lines: page_id, y.

    Only the pixels around line rows move through the join; pixels off the lines stay as they are.
    """
    w = Window.partitionBy("page_id", "x").orderBy("y")
    near = lambda k: F.coalesce(F.when(F.lag("y", k).over(w) == F.col("y") - k, F.lag("ink", k).over(w)) if k > 0 else F.when(F.lead("y", -k).over(w) == F.col("y") - k, F.lead("ink", -k).over(w)), F.lit(0))
    seen = ink.withColumns({"above": near(reach), "below": near(-reach)})
    marked = seen.join(lines.select("page_id", "y").distinct().withColumn("on_line", F.lit(True)), ["page_id", "y"], "left")
    return marked.select("page_id", "y", "x", F.when(F.col("on_line") & (F.col("above") == 0) & (F.col("below") == 0), 0).otherwise(F.col("ink")).alias("ink"))


_COMPONENTS = "page_id long, component long, x long, y long, w long, h long, area long, cx double, cy double"


def label_components(bits: np.ndarray) -> np.ndarray:
    """4-connected labels (0 is background), numbered by their first pixel in reading order."""
    places = np.flatnonzero(bits)
    # inked pixels only, numbered in reading order: what isn't inked takes no part in the steps below
    ids = np.full(bits.shape, -1, np.int64)
    ids.ravel()[places] = np.arange(len(places))
    parent = np.arange(len(places))
    pairs = [(ids[:, :-1][m], ids[:, 1:][m]) for m in [bits[:, :-1] & bits[:, 1:]]] + [(ids[:-1][m], ids[1:][m]) for m in [bits[:-1] & bits[1:]]]
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        ra, rb = parent[a], parent[b]
        if (ra == rb).all():
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    out = np.zeros(bits.size, np.int64)
    _, out[places] = np.unique(parent, return_inverse=True)
    out[places] += 1
    return out.reshape(bits.shape)


def component_boxes(labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """x0, x1, y0, y1, area, and the sums of x and of y of every label, in order."""
    y, x = np.nonzero(labels)
    of = labels[y, x] - 1
    n = int(of.max(initial=-1)) + 1
    x0, y0, x1, y1 = (np.full(n, labels.size), np.full(n, labels.size), np.zeros(n, np.int64), np.zeros(n, np.int64))
    for at, low, high in ((x, x0, x1), (y, y0, y1)):
        np.minimum.at(low, of, at)
        np.maximum.at(high, of, at)
    sums = [np.bincount(of, at, n) for at in (x, y)]
    return x0, x1, y0, y1, np.bincount(of, minlength=n), *sums


def component_table(labels: np.ndarray) -> pd.DataFrame:
    """Box, area and centroid of every label."""
    x0, x1, y0, y1, area, sx, sy = component_boxes(labels)
    return pd.DataFrame({"component": np.arange(len(area)), "x": x0, "y": y0, "w": x1 - x0 + 1, "h": y1 - y0 + 1, "area": area, "cx": sx / area, "cy": sy / area})


def components(ink: DataFrame) -> DataFrame:
    """Connected components of each page; a page is one task's work, its pixels are bounded."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((int(page.y.max()) + 1, int(page.x.max()) + 1), bool)
        bits[page.y, page.x] = page.ink.to_numpy() > 0
        table = component_table(label_components(bits))
        table.insert(0, "page_id", page.page_id.iloc[0])
        return table

    return ink.groupBy("page_id").applyInPandas(run, _COMPONENTS)


def pixels_from_images(images: DataFrame) -> DataFrame:
    """pixels of (page_id, width, height, rgba) rows with row-major RGBA bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rgba = np.frombuffer(row.rgba, np.uint8).reshape(row.height, row.width, 4).astype(np.int64)
                gray = (77 * rgba[..., 0] + 150 * rgba[..., 1] + 29 * rgba[..., 2]) >> 8
                gray = np.where(rgba[..., 3] == 0, 255, gray)
                y, x = np.indices(gray.shape)
                yield pd.DataFrame({"page_id": row.page_id, "y": y.ravel(), "x": x.ravel(), "gray": gray.ravel()})

    return images.mapInPandas(run, "page_id long, y long, x long, gray long")
