"""What keeps the work of a task, and of all tasks, in proportion to the input."""

import numpy as np
from pyspark.sql import functions as F

from scorelattice.operators import folds, lexing, musicxml_in, musicxml_out, noteheads, parsing, shares
from scorelattice.plans import bridge, page_queries

SMALL = "/root/testdata/sf0.001"


def test_pages_are_packed_from_inked_pixels_alone(spark):
    ink = np.zeros((5, 7), int)
    ink[1, 2:5] = ink[4, 0] = 1
    rows = [(1, int(y), int(x), 1) for y, x in zip(*np.nonzero(ink), strict=True)] + [(1, 4, 6, 0)]
    page = noteheads.page_ink(spark.createDataFrame(rows, "page_id long, y long, x long, ink long")).first()
    assert (page["width"], page["height"]) == (7, 5)
    assert (np.frombuffer(page["ink"], np.uint8).reshape(5, 7) == ink).all()


def test_drawn_pages_hold_only_what_is_inked(spark):
    drawn = page_queries._drawn_cells(page_queries._drawn_heads(spark, SMALL))
    counts = drawn.groupBy("page_id").agg(F.count_if(F.col("ink") == 0).alias("blank"), F.count("*").alias("n"), F.count_distinct("y", "x").alias("places")).collect()
    assert counts and all(r["blank"] == 1 and r["n"] == r["places"] < 3000 for r in counts)


def test_signs_left_of_a_head_as_each_place_alone_would_give():
    rng = np.random.default_rng(5)
    for _ in range(20):
        ink, glyph = rng.random((30, 40)) < 0.35, rng.random((9, 5)) < 0.5
        left, cy, spacing = int(rng.integers(0, 38)), float(rng.uniform(0, 30)), 6.0
        h, w = glyph.shape
        pad, best = h + w + 4, 0.0
        wide = np.pad(ink, pad)
        for y in range(int(np.floor(cy - spacing + 0.5)), int(np.floor(cy + spacing + 0.5)) + 1):
            for x in range(int(np.floor(left - 2 * spacing + 0.5)), int(np.floor(left - 0.4 * spacing + 0.5)) + 1):
                sy, sx = y - h // 2 + pad, x - w // 2 + pad
                if sy >= 0 and sx >= 0 and sy + h <= wide.shape[0] and sx + w <= wide.shape[1]:
                    part = wide[sy : sy + h, sx : sx + w]
                    if np.count_nonzero(part & glyph) >= np.count_nonzero(glyph) / 2:
                        best = max(best, np.count_nonzero(part == glyph) / glyph.size)
        assert noteheads.agreement_left(ink, left, cy, glyph, spacing) == best


def _orders(spark, folder, scores):
    """Tables of so many scores with one measure of 40 notes each."""
    ids = spark.range(scores)
    ids.select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    lines = ids.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40))))
    number = lambda k: F.xxhash64("id", "n", F.lit(k))
    lines.select(F.col("id").alias("l_orderkey"), (F.col("n") % 7 + 1).cast("int").alias("l_linenumber"), F.abs(number(1) % 1000000).alias("l_partkey"), F.abs(number(2) % 1000000).alias("l_suppkey"), F.abs(number(3) % 50).cast("double").alias("l_quantity"), F.abs(number(4) % 100000000).cast("double").alias("l_extendedprice"), F.lit("R").alias("l_returnflag")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_shares_grow_with_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shares, "SHARE", 1 << 19)
    few, many = _orders(spark, tmp_path / "few", 100), _orders(spark, tmp_path / "many", 12_000)
    for made in (bridge.notes, lambda s, d: lexing.tokens(bridge.sources(s, d)), lambda s, d: parsing.grid_cells(lexing.tokens(bridge.sources(s, d)))):
        a, b = made(spark, few).rdd.getNumPartitions(), made(spark, many).rdd.getNumPartitions()
        assert b > 8 and b > 2 * a


def test_what_is_played_of_long_repeats_takes_room_in_proportion(spark):
    """A segment is told by where its turns begin, not by a list of its own looked for in all that is played."""
    text = " ".join(f":C4k:{1 + k % 3}" for k in range(300))
    rows = parsing.flattened_repeats(lexing.tokens(spark.createDataFrame([(1, f":{text}:2")], "score_id long, source string")))
    got = [r["offset"] for r in rows.where("kind = 'note'").orderBy("play_idx").select("offset").collect()]
    once = [k * 7 + 2 for k in range(300) for _ in range(1 + k % 3)]
    assert got == once * 2
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "turns" in plan and "begins" in plan


def test_tokens_reach_the_document_fold_as_few_columns(spark, monkeypatch):
    seen = {}
    real = folds.by_key

    def by_key(df, *rest):
        seen["types"] = dict(df.dtypes)
        return real(df, *rest)

    monkeypatch.setattr(musicxml_out.folds, "by_key", by_key)
    musicxml_out.documents(spark.createDataFrame([(1, "[K+2] C4k F4k")], "score_id long, source string"))
    assert len(seen["types"]) <= 10 and not any("array" in t or "struct" in t for t in seen["types"].values())


def test_notes_are_written_once_for_all_alike():
    musicxml_out._note_xml.cache_clear()
    head = "1\x1f1\x1f64\x1f0\x1f0\x1fTREBLE".replace("1\x1f1", "4\x1f4", 1)
    note = "16\x1f0\x1f\x1f\x1f\x1ffalse\x1f\x1f\x1f\x1fC 4 0\x1f\x1f"
    tokens = [musicxml_out._Token(1, 0, "1", None, "note", False, None, *musicxml_out._unsealed(note, head)) for _ in range(200)]
    list(musicxml_out._written(tokens))
    assert musicxml_out._note_xml.cache_info().misses == 1


def test_a_plain_note_of_a_document_is_looked_through_once(monkeypatch):
    searched = []
    real = musicxml_in._typed
    monkeypatch.setattr(musicxml_in, "_typed", lambda el, tag, kind: searched.append(tag) or real(el, tag, kind))
    note = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>16</duration><voice>1</voice></note>"
    xml = f'<score-partwise><part-list/><part id="P1"><measure number="1"><attributes><divisions>16</divisions></attributes>{note * 4}</measure></part></score-partwise>'
    assert musicxml_in.convert(xml)["source"].endswith("[1]| C4k C4k C4k C4k , |")
    assert not {"slur", "tie"} & set(searched)


def test_a_header_is_searched_once_for_each_of_its_parts(spark):
    """Each pattern stands once in the plan: what is found isn't searched for again to be counted."""
    rows = spark.createDataFrame([(1, "[T 3/4 KG D32] C4k")], "score_id long, source string").select(lexing.header(F.col("source")).alias("h"))
    assert rows.first()["h"]["time_num"] == 3
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("K([A-G][#b]?m?)") == 1 and plan.count("|Soprano|Baritone|Te|Al|Pe|So|Br|T|B|A|N)") <= 3
