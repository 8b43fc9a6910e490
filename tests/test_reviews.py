from pyspark.sql import functions as F

from scorelattice.operators import harmony, lexing, parsing, reviews


def scores(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "score_id long, source string")


GOOD = "[1]| C5m | D5m |\n[2]| E4m | F4m |\n[3]| G4m | A4m |"


def test_analysis_counts(spark):
    with reviews.Analysed(scores(spark, GOOD, "[1]| C5m | [Dzz] D5l |\n[2]| C4m |")) as of:
        rows = {r["score_id"]: r for r in reviews.analysis(of).collect()}
    assert (rows[0]["n_measures"], rows[0]["n_chords"], rows[0]["kinds"]) == (2, 2, [])
    assert rows[1]["kinds"] == ["measureCountMismatch", "measureDurationMismatch", "parseError"]


def test_long_cells_are_cut(spark):
    cells = reviews.cells_of(scores(spark, "C4k D4k E4k F4k G4k A4k B4k C5k", "[1] C4l 32(D4kE4kF4k) G4m"))
    rows = lexing.notes_of(cells).orderBy("score_id", "tok_idx").collect()
    assert [(r["measure_index"], r["start"]) for r in rows if r["score_id"] == 0] == [(m, s) for m in (0, 1) for s in (0, 16, 32, 48)]
    assert [(r["measure_index"], r["start"]) for r in rows if r["score_id"] == 1] == [(0, 0), (0, 32), (0, 43), (0, 54), (1, 0)]


def test_proposals_are_judged(spark):
    worse = GOOD.replace("D5m", "B7m")
    replies = spark.createDataFrame([(7, 0, f"Try this.\n```score\n{worse}\n```\nor\n```score\n[1]| C5m [Dzz] |\n```")], "response_id long, score_id long, text string")
    found = reviews.versions(replies)
    with reviews.Analysed(scores(spark, GOOD)) as before, reviews.Analysed(found.select(F.col("proposal_id").alias("score_id"), "source")) as after:
        rows = {r["proposal_idx"]: r for r in reviews.judged(before, found, after).collect()}
    assert not before.cells.is_cached and not after.tokens.is_cached
    assert rows[0]["valid"] and rows[0]["measure_delta"] == 0 and rows[0]["chord_delta"] == -1 and rows[0]["observation_delta"] > 0
    assert not rows[1]["valid"]


TASKS = [
    (("continue", None, None, None, 1), "[1]| C5m | D5m | E5m |\n[2]| E4m | F4m | G4m |\n[3]| G4m | A4m | C5m |", None),
    (("continue", None, None, None, 3), GOOD, "measures"),
    (("addPart", None, None, "4", None), GOOD + "\n[4]| C3m | D3m |", None),
    (("addPart", None, None, "4", None), GOOD, "label"),
    (("fixSection", 2, 2, None, None), GOOD.replace("F4m", "F#4m"), None),
    (("fixSection", 2, 2, None, None), GOOD.replace("E4m", "D4m"), "leaked"),
    (("reharmonize", 1, 2, None, None), GOOD.replace("C5m", "B4m"), "melody"),
    (("reharmonize", 1, 2, None, None), GOOD.replace("G4m", "A4m"), None),
]


def test_tasks(spark):
    """Each task beside a version of its score, all in one table."""
    kind = "struct<kind:string,from_measure:int,to_measure:int,part_label:string,measures_to_add:int>"
    before = spark.createDataFrame([(k, GOOD, t) for k, (t, _, _) in enumerate(TASKS)], f"score_id long, source string, task {kind}")
    rows = {r["score_id"]: r["reason"] for r in reviews.task_check(before, scores(spark, *[after for _, after, _ in TASKS]), F.col("task")).collect()}
    assert rows == {k: reason for k, (_, _, reason) in enumerate(TASKS)}


def test_cell_errors_and_chord_row(spark):
    bad = parsing.cell_errors(lexing.tokens(scores(spark, "[1]| :C4k | D4k:2 |", GOOD))).collect()
    assert {(r["score_id"], r["cell_index"]) for r in bad} == {(0, 1), (0, 2)}
    runs = spark.createDataFrame([(1, 0, 0, "C", 32), (1, 0, 1, None, 32), (1, 1, 0, "G7", 64)], "score_id long, measure_index long, segment long, name string, units long")
    summaries = spark.createDataFrame([(1, 0, "Ⅰ"), (1, 1, "Ⅴ7")], "score_id long, measure_index long, relative string")
    assert harmony.chord_row(runs, summaries, F.lit(64)).first()["row"] == "[C]| Ⅰ/ C_l ?_l | Ⅴ7/ G7_m |"
