import os
import re

import pytest
from pyspark.sql import functions as F

from scorelattice.operators import grid, lexing, musicxml_in, musicxml_out, parsing
from scorelattice.sources import scores as files


def scores(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "score_id long, source string")


def tokens(spark, text):
    return [r.asDict(recursive=True) for r in lexing.tokens(scores(spark, text)).orderBy("tok_idx").collect()]


def pitch_text(p):
    return p["step"] + {0: "", 1: "#", 2: "x", -1: "b", -2: "bb"}[p["alter"]] + str(p["octave"])


@pytest.mark.parametrize(
    "text, pitches, units, dots",
    [("C4k", "C4", 16, 0), ("C#4k.", "C#4", 24, 1), ("Cb4l..", "Cb4", 56, 2), ("C4#4k", None, None, None), ("C4E4G4m", "C4 E4 G4", 64, 0), ("C4b4k", "C4 B4", 16, 0), ("C4bk", "Cb4", 16, 0), ("C#4#k", "Cx4", 16, 0), ("F*4k", "F4", 16, 0), ("C4G4g", "C4 G4", 1, 0), ("C4g", "C4", 1, 0), ("Cx4xk", "Cx4", 16, 0), ("c4n...", "C4", 240, 3)],
)
def test_notes(spark, text, pitches, units, dots):
    t = tokens(spark, text)[0]
    if pitches is None:
        assert t["kind"] == "lyric"
    else:
        assert (" ".join(map(pitch_text, t["pitches"])), t["units"], t["dots"]) == (pitches, units, dots)


def test_marks_heads_grace_and_slurs(spark):
    a, b, c = tokens(spark, "c4!dk.tr>~l_ `D4j ``e4j")
    assert (a["marks"], a["head"], a["slur_start"]) == (["trill", "accent", "fermataLong", "slurEnd"], "diamond", True)
    assert (b["grace"], c["grace"], c["slur_start"]) == ("grace", "acciaccatura", False)


def test_kinds(spark):
    text = "[1]| C4k , C4k ,, :C4k:3 8(C4jD4jE4j) +la 'R Rk. [T120] ,,, ,: :, ,- ,. ; comment\n/* more */ )"
    assert [t["kind"] for t in tokens(spark, text)] == "meta barline note measureBarrier note measureBarrier repeatBoundary note repeatBoundary tupletOpen note note note tupletClose tie lyric lyric lyric rest meta measureBarrier measureBarrier measureBarrier measureBarrier measureBarrier tupletClose".split()


def test_pieces_cover_the_text(spark):
    text = "[T]  C4k;x\n'C4k lá R12 ~~ /*a*/ (] `z"
    rows = lexing.pieces(scores(spark, text)).orderBy("piece").collect()
    start = rows[0]["offset"]
    assert "".join(r["raw"] for r in rows) == text[start:]
    assert all(text[r["offset"] : r["offset"] + len(r["raw"])] == r["raw"] for r in rows)


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("[CLEF:BASS TIME:3/4 KEY:D DIV:32] C4k", {"clef": "BASS", "time_num": 3, "time_den": 4, "key_fifths": 2, "div": 32, "error": None}),
        ("[T 6/8 KBbm D64] C4k", {"clef": "TREBLE", "time_num": 6, "time_den": 8, "key_fifths": -5, "div": 64}),
        ("; c\n[K+2 3/4]", {"transpose": 2, "time_num": 3, "key_fifths": 0}),
        ("[KEY:-3]", {"key_fifths": -3}),
        ("[KEY:F#m]", {"key_fifths": 3}),
        ("C4k", {"given": False, "div": 64, "time_num": 4}),
        ("[1]C4k", {"given": False}),
        ("[T:Allegro]C4k", {"given": False}),
        ("[TIME:3/7 DIV:64]", {"error": "divTime"}),
        ("[CLEF:XYZ]", {"error": "clef"}),
        ("[KEY:H]", {"error": "key"}),
    ],
)
def test_headers(spark, source, wanted):
    got = scores(spark, source).select(lexing.header(F.col("source")).alias("h")).first()["h"].asDict()
    assert {k: got[k] for k in wanted} == wanted


@pytest.mark.parametrize(
    "inside, kind, value",
    [("T120", "tempo", "120"), ("T:Allegro", "tempoText", "Allegro"), ("M3/4", "time", "3/4"), ("K-2", "transpose", "-2"), ("KBb", "key", "Bb"), ("Dff", "dynamics", "ff"), ("D<", "dynamics", "<"), ("V1", "volta", "1"), ("/V2", "voltaEnd", "2"), ("DC.fine", "jump", "DC.fine"), ("8va/", "ottava", "8va/"), ("C:Am7", "chord", "Am7"), ("3B:Tenor", "partSwitch", "3"), ("1:Piano", "partSwitch", "1"), ("P", "partSwitch", "P"), ("12", "partSwitch", "12"), ("So", "clefChange", "So"), ("R:A", "rehearsal", "A"), ("Dxx", "error", None), ("C", "error", None), ("mmr:8", "multiRest", "8")],
)
def test_commands(spark, inside, kind, value):
    t = tokens(spark, f"C4k [{inside}]")[1]
    assert t["meta_type"] == kind
    if value is not None:
        assert t["meta_value"] == value


def test_part_switch_details(spark):
    t = tokens(spark, "[3B:Tenor]")[0]
    assert (t["part_label"], t["clef"], t["instrument"]) == ("3", "BASS", "Tenor")


def test_positions(spark):
    row = spark.range(1).select(lexing.line_column(F.lit("ab\ncd"), F.lit(4)).alias("p"), lexing.snippet(F.lit("ab\ncd"), F.lit(4)).alias("s")).first()
    assert (row["p"]["line"], row["p"]["column"], row["s"]) == (2, 2, "cd\n ^")


def attached(spark, text):
    return [r.asDict() for r in parsing.attached(lexing.tokens(scores(spark, text))).orderBy("tok_idx").collect()]


def test_ties_and_lyrics(spark):
    a, b = [t for t in attached(spark, "C4k+ la [Dp] la D4k") if t["kind"] == "note"]
    assert (a["tie"], a["lyric"], b["tie"], b["lyric"]) == (True, "la" "la", False, None)
    assert attached(spark, "C4k [Dp] +")[0]["tie"] is False
    loose = parsing.loose_marks(lexing.tokens(scores(spark, "C4k [Dp] + Rk lu"))).collect()
    assert sorted(r["kind"] for r in loose) == ["lyric", "lyric", "tie"] or sorted(r["kind"] for r in loose)[0] == "lyric"


def play(spark, text):
    rows = parsing.flattened_repeats(lexing.tokens(scores(spark, text))).where("kind = 'note'").orderBy("play_idx").collect()
    return " ".join(pitch_text(r["pitches"][0].asDict()) for r in rows)


@pytest.mark.parametrize("text, out", [(":C4k D4k:2", "C4 D4 C4 D4"), ("::C4k:2 D4k:3", "C4 C4 D4 C4 C4 D4 C4 C4 D4"), ("C4k :D4k:2 E4k :F4k:2", "C4 D4 D4 E4 F4 F4"), (":C4k:0", "C4")])
def test_repeats(spark, text, out):
    assert play(spark, text) == out


def test_nesting_is_checked(spark):
    issues = parsing.group_issues(lexing.tokens(scores(spark, ":C4k", "C4k:2", "8(C4k", "C4k)", ":C4k:2"))).collect()
    assert sorted((r["score_id"], r["issue"]) for r in issues) == [(0, "repeatNotClosed"), (1, "strayRepeatEnd"), (2, "tupletNotClosed"), (3, "strayTupletClose")]


def cells(spark, text):
    rows = lexing.notes_of(parsing.grid_cells(lexing.tokens(scores(spark, text)))).groupBy("part_idx", "measure_index").agg(F.count("*").alias("n")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["part_idx"], {})[r["measure_index"]] = r["n"]
    return out


def test_grid(spark):
    grid_text = "[1]| C5m | B4m | C5m |\n[2]| E4m | E4m | E4m |\n[3]| G4m | G4m | G4m |\n[4]| C3m | G2m | C3m |"
    assert cells(spark, grid_text) == {p: {0: 1, 1: 1, 2: 1} for p in range(4)}
    assert cells(spark, "C4m|D4m|E4m|F4m") == {0: {0: 1, 1: 1, 2: 1, 3: 1}}
    assert cells(spark, "[1]C5m[2]E4m[3]G4m[4]C3m") == {p: {0: 1} for p in range(4)}
    assert cells(spark, "[1]| C4k | | D4k |") == {0: {0: 1, 2: 1}}
    assert cells(spark, "[1]| C4k , | D4k ,, |") == {0: {0: 1, 1: 1}}


def test_barline_repeats(spark):
    rows = lexing.notes_of(parsing.grid_cells(lexing.tokens(scores(spark, "[1]| C5m , ,: D5m :, E5m , |")))).orderBy("measure_index").collect()
    assert [r["abs_semitone"] % 12 for r in rows] == [0, 2, 2, 4]


def test_issues(spark):
    rows = spark.createDataFrame([(1, 0, 0, 64), (1, 1, 0, 64), (1, 0, 1, 64), (1, 1, 1, 32), (1, 2, 0, 64)], "score_id long, measure_index long, part_idx long, length long")
    found = grid.duration_issues(rows, F.lit(64)).collect()
    assert sorted((r["measure_index"], r["part_idx"], r["against"]) for r in found) == [(1, 1, "header"), (1, 1, "part")]
    assert [r["part_idx"] for r in grid.count_issues(grid.measure_counts(rows)).collect()] == [1]


SAMPLE = "[TIME:3/4 KEY:G]\n[1:Flute]| G4k A4k B4k , | [Dff] C5l. :, |\n[2B]| G3l. , | 24(F#3kG3kA3k) Rk. , |"


def test_music_xml_round_trip(spark):
    doc = musicxml_out.documents(scores(spark, SAMPLE)).first()
    assert (doc["n_parts"], doc["n_measures"]) == (2, 2)
    back = musicxml_in.convert(doc["music_xml"])
    assert back["error"] is None and back["n_parts"] == 2
    one = {(r["part_idx"], r["abs_semitone"], r["units"]) for r in lexing.notes_of(parsing.grid_cells(lexing.tokens(scores(spark, SAMPLE)))).collect()}
    two = {(r["part_idx"], r["abs_semitone"], r["units"]) for r in lexing.notes_of(parsing.grid_cells(lexing.tokens(scores(spark, back["source"])))).collect()}
    assert {x[:2] for x in one} == {x[:2] for x in two}
    assert "[1:Flute]" in back["source"] and "[Dff]" in back["source"] and ":," in back["source"]


def test_transposed_document(spark):
    xml = musicxml_out.documents(scores(spark, "[K+2] C4k F4k")).first()["music_xml"]
    assert re.findall(r"<step>(\w)</step>(?:<alter>(-?\d)</alter>)?", xml) == [("D", ""), ("G", "")]
    assert "<fifths>2</fifths>" in xml


XML = "<score-partwise><part-list><score-part id='a'><part-name>Alto</part-name></score-part><score-part id='b'><part-name>Part 2</part-name></score-part></part-list>{}</score-partwise>"
NOTE = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>{}</duration>{}</note>"


def test_import_aligns_parts():
    measure = "<measure number='{}'>" + "<attributes><divisions>8</divisions></attributes>" + NOTE.format(32, "") + "</measure>"
    xml = XML.format("<part id='a'>" + "".join(measure.format(n) for n in (1, 2, 3)) + "</part><part id='b'>" + "".join(measure.format(n) for n in (1, 3)) + "</part>")
    got = musicxml_in.convert(xml)
    assert [d["kind"] for d in got["diagnostics"]] == ["multipleAttributes", "partMeasureCountMismatch"]
    assert got["source"].split("\n")[1:] == ["[1:Alto]| C4m , | C4m , | C4m , |", "[2]| C4m , | Rm , | C4m , |"]


def test_import_of_odd_lengths_voices_and_chords():
    two = "<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>5</duration></note>"
    other = NOTE.format(5, "<voice>2</voice>")
    xml = XML.format("<part id='a'><measure number='1'><attributes><divisions>8</divisions></attributes>" + NOTE.format(5, "<voice>1</voice>") + two + other + "</measure></part>")
    got = musicxml_in.convert(xml)
    assert "C4E4i...+C4E4g" in got["source"]
    assert {d["kind"] for d in got["diagnostics"]} == {"multipleVoices", "nonStandardDuration"}


def test_import_of_timewise_and_broken_documents(spark):
    xml = "<score-timewise><measure number='1'><part id='a'>" + NOTE.format(32, "") + "</part></measure></score-timewise>"
    assert musicxml_in.convert(xml)["source"].endswith("[1]| C4m , |")
    assert "not well-formed" in musicxml_in.convert("<score")["error"]
    rows = spark.createDataFrame([(1, None), (2, xml)], "score_id long, xml string")
    got = {r["score_id"]: r for r in musicxml_in.sources(rows).collect()}
    assert got[1]["error"] == "no document" and got[2]["n_measures"] == 1


#: Scores of our own, unless SCORE_CORPUS names a folder of others.
CORPUS = os.environ.get("SCORE_CORPUS") or os.path.join(os.path.dirname(__file__), "corpus")


def test_corpus_reads(spark):
    """Every file lexes, has cells of every part, compiles, and reads back with the same notes."""
    texts = files.read_texts(spark, CORPUS).cache()
    rows = lexing.tokens(texts).cache()
    assert texts.count() >= 5 and rows.where("error is not null").count() == 0
    assert parsing.group_issues(rows).where("level = 'error'").count() == 0
    assert parsing.grid_cells(rows).select("score_id").distinct().count() == texts.count()
    docs = musicxml_out.documents(texts)
    back = musicxml_in.sources(docs.select("score_id", F.col("music_xml").alias("xml")))
    assert back.where("error is not null or n_parts = 0").count() == 0
    diagnostics = files.diagnostics(back).where("kind <> 'nonStandardDuration'")
    assert diagnostics.count() == 0
    rows.unpersist()
    texts.unpersist()


@pytest.mark.parametrize("text, out", [(":::::C4k:2:2:2:2:2", 32), (":" * 9 + "C4k" + ":2" * 9, 512), (":2 C4k :D4k:3", 4), (":C4k :D4k:2", 3)])
def test_repeats_of_any_depth(spark, text, out):
    tokens = lexing.tokens(scores(spark, text))
    assert parsing.flattened_repeats(tokens).where("kind = 'note'").count() == out


def test_lexing_takes_linear_time(spark):
    import time

    def seconds(n):
        df = scores(spark, "C4k " * n).cache()
        df.count()
        began = time.perf_counter()
        assert lexing.tokens(df).selectExpr("max(offset)", "count(*)").first()[0] == 4 * (n - 1)
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(80_000) for _ in range(2)) < 2.5 * min(seconds(40_000) for _ in range(2)) + 0.3
