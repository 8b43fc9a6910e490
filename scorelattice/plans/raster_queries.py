"""Queries on page rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.catalog import query
from scorelattice.operators import raster
from scorelattice.plans.bridge import PIXELS_SQL, pixels

_INK_SQL = f"{PIXELS_SQL}, ink AS (SELECT page_id, y, x, CAST(gray <= 127 AS BIGINT) AS ink FROM pixels)"


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("page_id", "y", "x", (F.col("gray") <= 127).cast("long").alias("ink"))


@query(f"WITH {PIXELS_SQL} SELECT page_id, gray, count(*) AS n FROM pixels GROUP BY ALL")
def gray_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(pixels(spark, sf_dir))


@query(f"""WITH {PIXELS_SQL}, counts AS (SELECT page_id, gray, CAST(count(*) AS DOUBLE) AS n FROM pixels GROUP BY ALL),
sums AS (SELECT page_id, gray, sum(n) OVER b AS wb, sum(gray * n) OVER b AS sb, sum(n) OVER w - sum(n) OVER b AS wf, sum(gray * n) OVER w AS total
  FROM counts WINDOW w AS (PARTITION BY page_id), b AS (PARTITION BY page_id ORDER BY gray)),
scored AS (SELECT page_id, gray, wb * wf * (sb / wb - (total - sb) / wf) * (sb / wb - (total - sb) / wf) AS v FROM sums WHERE wf > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v DESC, gray) AS rn FROM scored)
SELECT page_id, CAST(gray AS BIGINT) AS threshold FROM ranked WHERE rn = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.otsu(raster.histogram(pixels(spark, sf_dir)))


@query(f"WITH {_INK_SQL} SELECT page_id, y, CAST(sum(ink) AS BIGINT) AS ink FROM ink GROUP BY ALL")
def row_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.row_projection(_ink(spark, sf_dir))


@query(f"WITH {_INK_SQL} SELECT page_id, x, CAST(sum(ink) AS BIGINT) AS ink FROM ink WHERE y >= 20 AND y < 60 GROUP BY ALL")
def band_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.band_projection(_ink(spark, sf_dir), 20, 60)


@query(f"WITH {PIXELS_SQL} SELECT page_id, y - 10 AS y, x - 5 AS x, gray FROM pixels WHERE x >= 5 AND x < 45 AND y >= 10 AND y < 70")
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.crop(pixels(spark, sf_dir), 5, 10, 40, 60).select("page_id", "y", "x", "gray")


_LINES_SQL = f"""{_INK_SQL}, proj AS (SELECT page_id, y, sum(ink) AS ink FROM ink GROUP BY ALL),
bright AS (SELECT page_id, y, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM proj WHERE ink >= 64 * 0.5),
lines AS (SELECT page_id, min(y) AS first, max(y) AS last, (min(y) + max(y)) / 2.0 AS centre FROM bright GROUP BY page_id, island)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.staff_lines(raster.row_projection(_ink(spark, sf_dir)), 0.5, F.lit(64))


@query(f"WITH {_LINES_SQL} SELECT page_id, first, last, CAST(centre AS DOUBLE) AS centre FROM lines")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


_STAVES_SQL = f"""{_LINES_SQL},
numbered AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY centre) - 1) // 5 AS staff_idx FROM lines),
staves AS (SELECT page_id, CAST(staff_idx AS BIGINT) AS staff_idx, list(CAST(centre AS DOUBLE) ORDER BY centre) AS ys FROM numbered GROUP BY page_id, staff_idx HAVING count(*) = 5),
gapped AS (SELECT *, list_sort([ys[2] - ys[1], ys[3] - ys[2], ys[4] - ys[3], ys[5] - ys[4]]) AS gaps FROM staves)"""


@query(f"WITH {_STAVES_SQL} SELECT page_id, staff_idx, ys[1] AS top, ys[5] AS bottom, (gaps[2] + gaps[3]) / 2 AS line_spacing, gaps[4] > gaps[1] * 1.5 AND gaps[4] - gaps[1] > 2 AS irregular FROM gapped")
def staff_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.staves(_lines(spark, sf_dir))
    return found.select("page_id", "staff_idx", F.get("line_ys", F.lit(0)).alias("top"), F.get("line_ys", F.lit(4)).alias("bottom"), "line_spacing", "irregular")


@query(f"WITH {_STAVES_SQL} SELECT page_id, staff_idx, staff_idx // 2 AS system_idx, staff_idx % 2 AS part_idx FROM staves")
def system_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.systems(raster.staves(_lines(spark, sf_dir)), 2).select("page_id", "staff_idx", "system_idx", "part_idx")


_COLUMNS_SQL = f"{PIXELS_SQL}, candidates AS (SELECT DISTINCT page_id, y // 40 AS system_idx, (y // 20) % 2 AS staff_idx, x FROM pixels WHERE gray < 105 AND y < 80)"


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).where("gray < 105 and y < 80")
    return rows.select("page_id", F.floor(F.col("y") / 40).cast("long").alias("system_idx"), (F.floor(F.col("y") / 20) % 2).cast("long").alias("staff_idx"), "x")


@query(f"WITH {_COLUMNS_SQL} SELECT page_id, system_idx, x FROM candidates GROUP BY ALL HAVING count(*) = 2")
def barline_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.barline_columns(_columns(spark, sf_dir), 2)


@query(f"""WITH {_COLUMNS_SQL}, bars AS (SELECT page_id, system_idx, x FROM candidates GROUP BY ALL HAVING count(*) = 2),
pairs AS (SELECT *, lead(x) OVER w AS nx, row_number() OVER w - 1 AS measure_idx FROM bars WINDOW w AS (PARTITION BY page_id, system_idx ORDER BY x)),
strips(staff_idx, top, bottom) AS (VALUES (0, 2, 18), (1, 22, 38))
SELECT page_id, system_idx, CAST(staff_idx AS BIGINT) AS staff_idx, measure_idx, x, CAST(system_idx * 40 + top AS BIGINT) AS y, nx - x AS w, CAST(bottom - top AS BIGINT) AS h FROM pairs, strips WHERE nx IS NOT NULL""")
def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _columns(spark, sf_dir)
    bars = raster.barline_columns(columns, 2).withColumnRenamed("x", "bar_x")
    strips = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("staff_idx"), F.lit(t).alias("top"), F.lit(b).alias("bottom")) for k, t, b in ((0, 2, 18), (1, 22, 38))]))
    staff_rows = columns.select("page_id", "system_idx").distinct().withColumn("s", strips)
    staff_rows = staff_rows.select("page_id", "system_idx", "s.staff_idx", (F.col("system_idx") * 40 + F.col("s.top")).alias("top"), (F.col("system_idx") * 40 + F.col("s.bottom")).alias("bottom"))
    return raster.cell_boxes(bars, staff_rows)


@query(f"""WITH {_INK_SQL}, near AS (SELECT *, coalesce(lag(ink, 2) OVER w, 0) AS above, coalesce(lead(ink, 2) OVER w, 0) AS below FROM ink WINDOW w AS (PARTITION BY page_id, x ORDER BY y))
SELECT page_id, y, x, CAST(CASE WHEN y % 10 = 5 AND above = 0 AND below = 0 THEN 0 ELSE ink END AS BIGINT) AS ink FROM near""")
def line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = _ink(spark, sf_dir)
    out = raster.remove_lines(ink, ink.where("y % 10 = 5").select("page_id", "y"))
    return out.select("page_id", "y", "x", F.col("ink").cast("long").alias("ink"))


@query(f"""WITH RECURSIVE {_INK_SQL},
dots AS (SELECT page_id, y, x, y * 64 + x AS id FROM ink WHERE ink > 0),
pairs AS (SELECT a.page_id, a.id, b.id AS other FROM dots a JOIN dots b ON b.page_id = a.page_id AND b.id = a.id + 64 UNION ALL SELECT a.page_id, a.id, b.id FROM dots a JOIN dots b ON b.page_id = a.page_id AND b.id = a.id + 1 AND b.y = a.y),
near AS MATERIALIZED (SELECT * FROM pairs UNION ALL SELECT page_id, other, id FROM pairs),
label(page_id, id, root) USING KEY (page_id, id) AS (
  SELECT page_id, id, id AS root FROM dots
  UNION SELECT n.page_id, n.other, min(l.root) FROM label l JOIN near n ON n.page_id = l.page_id AND n.id = l.id JOIN recurring.label k ON k.page_id = n.page_id AND k.id = n.other WHERE l.root < k.root GROUP BY n.page_id, n.other),
boxes AS (SELECT page_id, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM label JOIN dots USING (page_id, id) GROUP BY page_id, root)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY root) - 1 AS component, * EXCLUDE (page_id, root) FROM boxes""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.components(_ink(spark, sf_dir))
