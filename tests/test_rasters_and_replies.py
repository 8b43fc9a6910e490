import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelattice.functions import glyphs
from scorelattice.operators import assembly, durations, noteheads, prompts, proposals, raster
from scorelattice.streaming import ingest


def pixels(spark, array, column="gray"):
    rows = [(1, y, x, int(v)) for y, line in enumerate(array) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"page_id long, y long, x long, {column} long")


def test_threshold_and_ink(spark):
    page = pixels(spark, [[0, 255, 0, 255, 0, 255]])
    limit = raster.otsu(raster.histogram(page))
    assert [r["ink"] for r in raster.binarize(page, limit).orderBy("x").collect()] == [1, 0, 1, 0, 1, 0]
    assert raster.otsu(raster.histogram(pixels(spark, [[7, 7], [7, 7]]))).first()["threshold"] == 128


def test_staff_and_cells(spark):
    page = np.zeros((40, 100), int)
    page[[10, 15, 20, 25, 30]] = 1
    page[10:31, [5, 50, 95]] = 1
    ink = pixels(spark, page, "ink")
    staves = raster.staves(raster.staff_lines(raster.row_projection(ink), 0.5, F.lit(100)))
    row = staves.first()
    assert (staves.count(), row["line_spacing"], row["irregular"], row["line_ys"]) == (1, 5.0, False, [10, 15, 20, 25, 30])
    tall = raster.band_projection(ink, 10, 31).where("ink = 21")
    columns = tall.select("page_id", F.lit(0).alias("system_idx"), F.lit(0).alias("staff_idx"), "x")
    boxes = raster.cell_boxes(raster.barline_columns(columns, 1).withColumnRenamed("x", "bar_x"), spark.createDataFrame([(1, 0, 0, 10, 30)], "page_id long, system_idx int, staff_idx int, top int, bottom int"))
    assert [(r["x"], r["w"], r["h"]) for r in boxes.orderBy("x").collect()] == [(5, 45, 20), (50, 45, 20)]


def test_components(spark):
    page = np.zeros((6, 8), int)
    page[1:3, 1:3] = 1
    page[4, 5:8] = 1
    page[3, 3] = 1  # touches by a corner only
    rows = raster.components(pixels(spark, page, "ink")).orderBy("component").collect()
    assert [(r["x"], r["y"], r["w"], r["h"], r["area"]) for r in rows] == [(1, 1, 2, 2, 4), (3, 3, 1, 1, 1), (5, 4, 3, 1, 3)]


def test_line_removal_keeps_what_crosses(spark):
    page = np.zeros((9, 3), int)
    page[4] = 1
    page[2:7, 1] = 1
    ink = pixels(spark, page, "ink")
    rows = raster.remove_lines(ink, spark.createDataFrame([(1, 4)], "page_id long, y long")).where("y = 4").orderBy("x").collect()
    assert [r["ink"] for r in rows] == [0, 1, 0]


def test_heads_are_read(spark):
    shapes, size = glyphs.table(), 12
    ink = np.zeros((200, 220), bool)
    lines = [76.0 + size * k for k in range(5)]
    for y in lines:
        ink[int(y)] = True
    for cx, cy, name in ((60, 76 + 48, "noteheadBlack"), (150, 76 + 24, "noteheadHalf")):
        g = shapes[name, size]
        h, w = g.shape
        ink[cy - h // 2 : cy - h // 2 + h, cx - w // 2 : cx - w // 2 + w] |= g
        ink[cy - 42 : cy, cx + w // 2 - 2] = True
    rows = spark.createDataFrame([(1, 0, 0, 0, lines, float(size), "TREBLE", 1, bytearray(ink.astype(np.uint8).tobytes()), 220, 200, 0, 0)], "page_id long, system_idx long, staff_idx long, measure_idx long, line_ys array<double>, line_spacing double, clef string, fifths int, ink binary, ink_w int, ink_h int, ink_x int, ink_y int")
    found = noteheads.detect_all(rows).orderBy("cx").collect()
    assert [(r["letter"], r["octave"], r["kind"], r["stem"], r["units"]) for r in found] == [("E", 4, "filled", "up", 8), ("B", 4, "hollow", "up", 16)]


def test_chords_of_heads(spark):
    rows = [(1, 0, 0, 0, 10.0, 12.0, "C", 4, 0, 8, 0.9), (1, 0, 0, 0, 12.0, 12.0, "E", 4, -1, 8, 0.8), (1, 0, 0, 0, 60.0, 12.0, "F", 4, 1, 16, 0.7)]
    heads = spark.createDataFrame(rows, "page_id long, system_idx long, staff_idx long, measure_idx long, cx double, w double, letter string, octave int, alter int, units int, confidence double")
    chords = assembly.chords(heads)
    assert [r["token"] for r in chords.orderBy("chord_idx").collect()] == ["C4Eb4k", "F#4l"]
    boxes = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 0, 1, 0)], "page_id long, system_idx long, staff_idx long, measure_idx long, part_idx int")
    cells = assembly.cells(boxes, chords, F.lit(32)).orderBy("measure_idx").collect()
    assert [(c["text"], c["bin"]) for c in cells] == [("C4Eb4k F#4l", "low"), ("Rm", "unknown")]


@pytest.mark.parametrize("units, div, chain", [(24, 64, "k."), (5, 32, "i... g"), (20, 64, "k h..."), (64, 64, "m"), (0, 64, "")])
def test_lengths(spark, units, div, chain):
    row = spark.createDataFrame([(units, div)], "units long, div int").select(F.array_join(durations.chain(F.col("units"), F.col("div")), " ")).first()
    assert row[0] == chain


REPLY = "Moved the bass.\n\nOption A\n```score\n[1]| C4m |\n```\nthen\n```score\n[1]| D4m |\n```\n"


def test_replies(spark):
    rows = spark.createDataFrame([(1, REPLY), (2, "I would rather not."), (3, "")], "response_id long, text string")
    flags = {r["response_id"]: r for r in rows.select("response_id", proposals.summary(F.col("text")).alias("s"), proposals.declined(F.col("text")).alias("d")).collect()}
    assert flags[1]["s"].startswith("Moved the bass.") and not flags[1]["d"] and flags[2]["d"] and not flags[3]["d"]
    found = proposals.proposals(rows, "score").orderBy("proposal_idx").collect()
    assert [(r["source"], r["label"]) for r in found] == [("[1]| C4m |", "Option A"), ("[1]| D4m |", None)] or found[0]["label"] == "Option A"


def test_context(spark):
    good = '```json\n{"voicePartsCount": 4, "hasPiano": false, "hasPercussion": false, "stavesPerSystem": 1, "staffRoles": ["voice"], "clefsPerStaff": ["TREBLE"], "initialTimeSignature": {"numerator": 4, "denominator": 4}, "initialKeyFifths": 0, "lyricsRows": 1, "totalMeasures": 8, "keyChanges": [{"measure": 3, "fifths": 9}, {"measure": 4, "fifths": 1}]}\n```'
    rows = spark.createDataFrame([(1, good), (2, "no json"), (3, "```json\n{\"voicePartsCount\": 1}\n```")], "response_id long, text string")
    got = {r["response_id"]: r for r in proposals.score_context(rows).collect()}
    assert got[1]["errors"] == [] and got[1]["dropped"] == 1 and len(got[1]["key_changes"]) == 1
    assert got[2]["errors"][0] == "noJson" and got[2]["context"] is None
    assert "staffRoles" in got[3]["errors"] and "voicePartsCount" not in got[3]["errors"]


def test_unresolved_and_numbers(spark):
    row = spark.range(1).select(proposals.unresolved(F.lit("x\nUNRESOLVED:\n- p0s0\n* p1s1\n\nend")).alias("u"), proposals.numbered(F.lit("a\nb")).alias("n"), proposals.measure_texts(F.lit("[1]| C4m  D4m | E4m |")).alias("m")).first()
    assert (row["u"], row["n"], row["m"]) == (["p0s0", "p1s1"], "1: a\n2: b", ["C4m D4m", "E4m"])


def test_review_falls_back(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "key string, at int, text string")
    new = spark.createDataFrame([("a", 0, "X", 10.0), ("a", 1, "Y", 10.0)], "key string, at int, text string, units double")
    got = {r["at"]: (r["text"], r["reason"]) for r in proposals.reviewed_part(old, new).collect()}
    assert got == {0: ("X", None), 1: ("y", "duration")}


def test_prompts(spark):
    task = F.struct(F.lit("continue").alias("kind"), F.lit(None).cast("int").alias("from_measure"), F.lit(None).cast("int").alias("to_measure"), F.lit(None).cast("string").alias("part_label"), F.lit(2).alias("measures_to_add"))
    rows = spark.createDataFrame([(1, "[1]| C4m |")], "score_id long, source string").withColumn("task", task)
    labels = spark.createDataFrame([(1, 0, "Cmaj")], "score_id long, measure_index long, symbol string")
    seen = spark.createDataFrame([(1, "largeLeap", 0, 1, "1", None)], "score_id long, kind string, from_measure long, to_measure long, part_a string, part_b string")
    counts = spark.createDataFrame([(1, 1, ["1"])], "score_id long, n_measures int, labels array<string>")
    row = prompts.harmony_prompt(rows, labels, seen, counts).first()
    assert row["errors"] == [] and "measure 1: Cmaj" in row["prompt"] and "largeLeap" in row["prompt"] and "2 more measures" in row["prompt"]
    assert "staffRoles" in prompts.structure_prompt()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("[1]| C4m |\n[2]| E4m |\n[3]| G4m |")
    ingest.label_stream(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["symbol"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Cmaj"]


def test_cells_are_cut_from_pages(spark):
    page = np.zeros((60, 80), int)
    page[30:34, 20:26] = 1
    pages = noteheads.page_ink(pixels(spark, page, "ink"))
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10.0, 30.0, 30.0, 5.0)], "page_id long, system_idx long, staff_idx long, measure_idx long, x double, y double, w double, h double")
    staff_rows = spark.createDataFrame([(1, 0, 0, [30.0, 31.0, 32.0, 33.0, 34.0], 2.0, "TREBLE", 0)], "page_id long, system_idx long, staff_idx long, line_ys array<double>, line_spacing double, clef string, fifths int")
    c = noteheads.cut_cells(pages, boxes, staff_rows).first()
    assert (c["ink_w"], c["ink_h"], c["ink_x"], c["ink_y"]) == (30, 21, 10, 22)
    assert np.frombuffer(c["ink"], np.uint8).sum() == 24


def test_documents_are_put_together(spark):
    rows = [("d", 0, 1, 0, 1, "D4m"), ("d", 0, 1, 0, 0, "C4m"), ("d", 1, 1, 0, 0, "E4m"), ("e", 0, 9, 0, 0, "Rm")]
    cells = spark.createDataFrame(rows, "doc_id string, part_idx int, page_id long, system_idx long, measure_idx long, text string")
    out = {r["doc_id"]: r["source"] for r in assembly.documents(cells, F.lit("[KEY:G]")).collect()}
    assert out == {"d": "[KEY:G]\n[1]| C4m | D4m |\n[2]| E4m |", "e": "[KEY:G]\n[1]| Rm |"}
    order = {(r["text"]): r["global_measure"] for r in raster.reading_order(cells).collect()}
    assert order == {"C4m": 0, "D4m": 1, "E4m": 0, "Rm": 0}
