"""From detected noteheads to notation text.

heads: page_id, system_idx, staff_idx, measure_idx, cx, w, letter, octave, alter, units, confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.operators import folds

HIGH, MID = 0.85, 0.55
CELL = ["page_id", "system_idx", "staff_idx", "measure_idx"]
#: Lengths of the assembled text in units at DIV 32, and the signs.
LETTERS = {"m": 32, "l": 16, "k": 8, "j": 4, "i": 2, "h": 1}
_SIGNS = {0: "", 1: "#", 2: "x", -1: "b", -2: "bb"}


def confidence_bin(confidence: Column, mismatch: Column) -> Column:
    """high, mid, low; a wrong duration is low, nothing detected is unknown."""
    return F.when(confidence.isNull(), "unknown").when(mismatch, "low").when(confidence >= HIGH, "high").when(confidence >= MID, "mid").otherwise("low")


def chord_tolerance(heads: DataFrame) -> DataFrame:
    """Distance within which heads of a cell belong to one chord: 0.6 of the upper median width."""
    widths = heads.groupBy(*CELL).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return widths.select(*CELL, (F.get("ws", F.floor(F.size("ws") / 2).cast("int")) * 0.6).alias("tolerance"))


def voice_staves(staves: DataFrame) -> DataFrame:
    """Staves of a page with the role of a voice, numbered from 1; the others are marked `skipped`. Columns page_id, staff_idx, role."""
    w = Window.partitionBy("page_id").orderBy("staff_idx")
    voice = F.col("role") == "voice"
    return staves.withColumn("label", F.when(voice, F.sum(F.when(voice, 1).otherwise(0)).over(w).cast("string"))).withColumn("skipped", ~voice)


_CHORDS = "page_id long, system_idx long, staff_idx long, measure_idx long, chord_idx long, token string, units long, confidence double, x double"


def letter_of(units: int) -> str:
    """The letter of a length; of one that has none, the next shorter, at least the shortest."""
    return next((k for k, v in LETTERS.items() if v <= units), "h")


def chords(heads: DataFrame) -> DataFrame:
    """Chord tokens of each cell, left to right: heads near a running midpoint are one chord. A fold along a cell."""

    def fold(cell: list) -> Iterator[tuple]:
        near = sorted(h.w for h in cell)[len(cell) // 2] * 0.6
        groups: list[tuple[float, list]] = []
        for head in cell:
            if groups and abs(head.cx - groups[-1][0]) <= near:
                x, own = groups.pop()
                groups.append(((x + head.cx) / 2, [*own, head]))
            else:
                groups.append((head.cx, [head]))
        for k, (x, own) in enumerate(groups):
            own.sort(key=lambda h: h.octave * 7 + "CDEFGAB".index(h.letter))
            pitches = "".join(h.letter + _SIGNS[h.alter] + str(h.octave) for h in own)
            units = min(own, key=lambda h: (h.cx, h.letter, h.octave)).units
            yield *own[0][:4], k, pitches + letter_of(units), units, min(h.confidence for h in own), x

    rows = heads.select(*CELL, "cx", "w", "letter", "octave", "alter", "units", "confidence")
    return folds.by_key(rows, CELL, ["cx", "letter", "octave"], fold, _CHORDS)


def cells(boxes: DataFrame, chord_rows: DataFrame, units_per_measure: Column) -> DataFrame:
    """Text, confidence and bin of every cell; cells without a head are a measure's rest and unknown."""
    texts = chord_rows.groupBy(*CELL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chord_idx", "token"))), lambda t: t["token"]), " ").alias("text"), F.sum("units").alias("units"), F.min("confidence").alias("confidence"))
    joined = boxes.join(texts, CELL, "left").withColumn("expected", units_per_measure)
    mismatch = F.coalesce(F.col("units") != F.col("expected"), F.lit(False))
    return joined.withColumns({"bin": confidence_bin(F.col("confidence"), mismatch), "mismatch": mismatch, "text": F.coalesce("text", F.lit("Rm"))})


def cell_id(page: Column, system: Column, staff: Column, measure: Column) -> Column:
    return F.format_string("p%ds%di%dm%d", page, system, staff, measure)


def low_share(cell_rows: DataFrame) -> DataFrame:
    """Share of cells of each page that aren't high."""
    return cell_rows.groupBy("page_id").agg(F.avg((F.col("bin") != "high").cast("double")).alias("share"))


def documents(cell_rows: DataFrame, header: Column) -> DataFrame:
    """doc_id, source: the assembled text of each document, a header and a line for each staff place, cells in reading order."""
    order = F.struct("page_id", "system_idx", "measure_idx", "text")
    lines = cell_rows.groupBy("doc_id", "part_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda c: c["text"]), " | ").alias("body"))
    line = F.concat(F.lit("["), (F.col("part_idx") + 1).cast("string"), F.lit("]| "), "body", F.lit(" |")).alias("line")
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_idx", line))).alias("ls"))
    return rows.select("doc_id", F.concat_ws("\n", F.nullif(header, F.lit("")), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("source"))
