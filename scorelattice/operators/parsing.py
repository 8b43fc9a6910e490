"""Structure over token rows: ties, lyrics, tuplets, repeats, parts, cells.

All of it is window logic within a score; tokens keep their order in tok_idx.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from scorelattice.functions.pitch import let
from scorelattice.operators import folds, grid

#: Kinds that fill a cell.
PLAYED = ("note", "rest", "tupletOpen", "tupletClose", "repeatBoundary")


def _to_here() -> WindowSpec:
    """A score's tokens up to the current one."""
    return Window.partitionBy("score_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_groups(tokens: DataFrame) -> DataFrame:
    """tuplet (its opening token, null outside), depth of repeats, and what is wrong with the nesting."""
    opens = F.when(F.col("kind") == "tupletOpen", 1).when(F.col("kind") == "tupletClose", -1).otherwise(0)
    starts = (F.col("kind") == "repeatBoundary") & F.col("repeat_count").isNull()
    ends = (F.col("kind") == "repeatBoundary") & F.col("repeat_count").isNotNull()
    out = tokens.withColumns({"_level": F.sum(opens).over(_to_here()), "depth": F.sum(F.when(starts, 1).when(ends, -1).otherwise(0)).over(_to_here())})
    last_open = F.last(F.when(F.col("kind") == "tupletOpen", F.col("tok_idx")), ignorenulls=True).over(_to_here())
    last_units = F.last(F.when(F.col("kind") == "tupletOpen", F.col("tuplet_units")), ignorenulls=True).over(_to_here())
    inside = (F.col("_level") > 0) & ~F.col("kind").isin("tupletOpen", "tupletClose")
    return out.withColumns({"tuplet": F.when(inside, last_open), "target_units": F.when(inside, last_units)}).drop("_level")


def group_issues(tokens: DataFrame) -> DataFrame:
    """One row for each score whose repeats or tuplets don't nest: kind and whether it is an error or a warning."""
    marked = with_groups(tokens)
    opens = F.sum(F.when(F.col("kind") == "tupletOpen", 1).when(F.col("kind") == "tupletClose", -1).otherwise(0))
    sums = marked.groupBy("score_id").agg(opens.alias("tuplets"), F.min("depth").alias("lowest"), F.max_by("depth", "tok_idx").alias("final"))
    kinds = F.array_compact(F.array(F.when(F.col("tuplets") > 0, F.struct(F.lit("tupletNotClosed").alias("issue"), F.lit("error").alias("level"))), F.when(F.col("tuplets") < 0, F.struct(F.lit("strayTupletClose").alias("issue"), F.lit("warning").alias("level"))), F.when(F.col("lowest") < 0, F.struct(F.lit("strayRepeatEnd").alias("issue"), F.lit("warning").alias("level"))), F.when(F.col("final") > F.least(F.lit(0), F.col("lowest")), F.struct(F.lit("repeatNotClosed").alias("issue"), F.lit("error").alias("level")))))
    return sums.select("score_id", F.explode(kinds).alias("i")).select("score_id", "i.issue", "i.level")


def attached(tokens: DataFrame) -> DataFrame:
    """Notes, rests, metas and barriers with `tie` (tied to the next) and the lyric they carry.

    A tie belongs to what stands directly before it; lyrics, ties and barlines don't come between, a
    meta, a barrier or a closed group does. A lyric goes to the nearest note before it, over metas,
    barriers and groups, but not over a rest.
    """
    opaque = ~F.col("kind").isin("lyric", "tie", "barline")
    holder = F.last(F.when(opaque, F.struct("tok_idx", "kind")), ignorenulls=True).over(_to_here())
    target = F.last(F.when(F.col("kind").isin("note", "rest"), F.struct("tok_idx", "kind")), ignorenulls=True).over(_to_here())
    marked = tokens.withColumns({"_holder": holder, "_target": target})
    owner = F.when((F.col("kind") == "tie") & F.col("_holder.kind").isin("note", "rest"), F.col("_holder.tok_idx")).when((F.col("kind") == "lyric") & (F.col("_target.kind") == "note"), F.col("_target.tok_idx")).when(F.col("kind").isin("tie", "lyric"), F.lit(None).cast("int")).otherwise(F.col("tok_idx"))
    own = Window.partitionBy("score_id", "_owner").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = marked.withColumn("_owner", owner)
    marked = marked.withColumns({"tie": F.max(F.col("kind") == "tie").over(own) & F.col("_owner").isNotNull(), "sung": F.array_join(F.collect_list(F.when(F.col("kind") == "lyric", F.col("lyric"))).over(own), "")})
    kept = marked.where(~F.col("kind").isin("tie", "lyric"))
    return kept.withColumn("lyric", F.nullif(F.col("sung"), F.lit(""))).drop("_holder", "_target", "_owner", "sung")


def loose_marks(tokens: DataFrame) -> DataFrame:
    """Ties and lyrics that belong to nothing: warnings."""
    opaque = ~F.col("kind").isin("lyric", "tie", "barline")
    holder = F.last(F.when(opaque, F.col("kind")), ignorenulls=True).over(_to_here())
    target = F.last(F.when(F.col("kind").isin("note", "rest"), F.col("kind")), ignorenulls=True).over(_to_here())
    marked = tokens.withColumns({"_holder": holder, "_target": target})
    loose = ((F.col("kind") == "tie") & ~F.coalesce(F.col("_holder").isin("note", "rest"), F.lit(False))) | ((F.col("kind") == "lyric") & (F.coalesce(F.col("_target"), F.lit("")) != "note"))
    return marked.where(loose).select("score_id", "tok_idx", "kind", "raw", "offset")


def _played_segments(marks: Column) -> Column:
    """The turns at which the segments between repeat marks are played: turns by segment, and where each begins.

    marks: the repeat counts of a score's marks in order, null for a start. Bodies of open groups are kept on a
    stack; an end puts its group's body, as often as it is played, onto the one below. A group that isn't closed
    is played once; an end without a start counts for nothing. Work and room are in proportion to what is played.
    """
    none = F.array().cast("array<int>")
    all_but = lambda stack, n: F.slice(stack, 1, F.size(stack) - n)
    pushed = lambda stack, body, n: F.concat(all_but(stack, n), F.array(body))

    def step(acc: Column, mark: Column) -> Column:
        stack = acc["stack"]
        often = F.flatten(F.array_repeat(F.element_at(stack, -1), F.greatest(F.lit(1), mark["count"])))
        closed = pushed(stack, F.concat(F.element_at(stack, F.when(F.size(stack) > 1, -2).otherwise(-1)), often), 2)
        after = F.when(mark["count"].isNull(), F.concat(stack, F.array(none))).when(F.size(stack) > 1, closed).otherwise(stack)
        following = acc["next"]
        return let(after, lambda s: F.struct(pushed(s, F.concat(F.element_at(s, -1), F.array(following)), 1).alias("stack"), (following + 1).alias("next")))

    start = F.struct(F.array(F.array(F.lit(0))).alias("stack"), F.lit(1).alias("next"))
    order = F.aggregate(marks, start, step, lambda acc: F.flatten(acc["stack"]))
    # (segment, turn) as one number each, sorted: a segment's turns lie together, and each segment has one at least
    pairs = let(order, lambda o: F.sort_array(F.transform(o, lambda s, i: F.shiftleft(s.cast("long"), 32) + i)))
    segment = lambda p: F.shiftright(p, 32)
    first = lambda ps, i: (i == 0) | (segment(F.get(ps, i)) != segment(F.get(ps, i - 1)))
    begins = lambda ps: F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: first(ps, i))
    return let(pairs, lambda ps: F.struct(F.transform(ps, lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("turns"), F.concat(begins(ps), F.array(F.size(ps))).alias("begins")))


def _turns(plays: Column, segment: Column) -> Column:
    """The turns of one segment."""
    begin = F.get(plays["begins"], segment)
    return F.slice(plays["turns"], begin + 1, F.get(plays["begins"], segment + 1) - begin)


def flattened_repeats(tokens: DataFrame) -> DataFrame:
    """Tokens in the order they are played, repeat marks gone; play_idx grows within a score and isn't dense.

    Groups nest to any depth. What a score's marks say of each segment between two of them is worked out once, on
    the score's first row, and only for scores that have marks.
    """
    is_mark = F.col("kind") == "repeatBoundary"
    ordered = Window.partitionBy("score_id").orderBy("tok_idx")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = F.collect_list(F.when(is_mark, F.struct(F.col("repeat_count").alias("count")))).over(every)
    rows = with_groups(tokens).withColumns({"_segment": F.count_if(is_mark).over(_to_here()).cast("int"), "_marks": marks, "_row": F.row_number().over(ordered)})
    first = F.when((F.col("_row") == 1) & (F.size("_marks") > 0), _played_segments(F.col("_marks")))
    rows = rows.withColumn("_first", first).drop("_marks", "_row").withColumn("_plays", F.first("_first").over(every)).where(~is_mark)
    turns = F.when(F.col("_plays").isNull(), F.array("_segment")).otherwise(_turns(F.col("_plays"), F.col("_segment")))
    played = rows.withColumn("_turn", F.explode(turns))
    return played.withColumn("play_idx", F.shiftleft(F.col("_turn").cast("long"), 32) + F.col("tok_idx")).drop("_segment", "_first", "_plays", "_turn")


def with_parts(tokens: DataFrame, order: str = "tok_idx", default: str = "M") -> DataFrame:
    """part_label of every token: the last part named before it; the naming tokens are dropped.

    part_idx numbers the parts of a score by first appearance, the default part first if it has tokens.
    """
    ordered = Window.partitionBy("score_id").orderBy(order)
    here, before = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.unboundedPreceding, -1)
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    label = F.coalesce(F.last("part_label", ignorenulls=True).over(here), F.lit(default))
    known = F.array_contains(F.collect_set("part_label").over(before), F.col("part_label"))
    seen = tokens.withColumns({"part": label, "_new": F.when(~F.coalesce(known, F.lit(False)), F.col("part_label")), "_unnamed": F.first("part_label").over(every).isNull()})
    # the names in the order they first stand in; a score has few
    seen = seen.withColumn("_names", F.collect_list("_new").over(every))
    places = F.concat(F.when(F.col("_unnamed"), F.array(F.lit(default))).otherwise(F.array().cast("array<string>")), F.col("_names"))
    seen = seen.withColumn("part_idx", (F.array_position(places, F.col("part")) - 1).cast("long")).drop("_new", "_unnamed", "_names")
    # what the naming tokens say of a part stays with its tokens
    own = Window.partitionBy("score_id", "part")
    named = seen.withColumn("instrument", F.max_by("instrument", F.when(F.col("instrument").isNotNull(), F.col(order))).over(own))
    return named.where("part_label is null")


def merged_preamble(tokens: DataFrame, order: str = "tok_idx") -> DataFrame:
    """A default part without anything to play joins the first real part."""
    whole = Window.partitionBy("score_id")
    playable = F.col("kind").isin("note", "rest", "measureBarrier", "tupletOpen")
    silent = ~F.coalesce(F.max(playable & (F.col("part") == "M")).over(whole), F.lit(False))
    named = F.max(F.col("part") != "M").over(whole)
    first_real = F.min_by(F.when(F.col("part") != "M", F.col("part")), F.when(F.col("part") != "M", F.col("part_idx"))).over(whole)
    first_idx = F.min(F.when(F.col("part") != "M", F.col("part_idx"))).over(whole)
    moved = (F.col("part") == "M") & silent & named
    out = tokens.withColumns({"_m": moved, "_label": first_real, "_idx": first_idx})
    return out.withColumns({"part": F.when(F.col("_m"), F.col("_label")).otherwise(F.col("part")), "part_idx": F.when(F.col("_m"), F.col("_idx")).otherwise(F.col("part_idx"))}).drop("_m", "_label", "_idx")


def without_preamble(tokens: DataFrame) -> DataFrame:
    """The grid's rule: what comes before the first part is left out, unless no part is named at all."""
    named = F.max(F.col("part") != "M").over(Window.partitionBy("score_id"))
    return tokens.withColumn("_named", named).where((F.col("part") != "M") | ~F.col("_named")).drop("_named")


def with_cells(tokens: DataFrame) -> DataFrame:
    """cell_index of every token of a part: separators are `|` and barriers other than a repeat start.

    Separators of different kinds with nothing played between them are one; of the same kind they leave
    an empty cell. The separators themselves are kept, marked by `separator`.
    """
    w = Window.partitionBy("score_id", "part_idx").orderBy("tok_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    barrier = (F.col("kind") == "measureBarrier") & (F.col("barline") != "repeatStart")
    separator = F.when(F.col("kind") == "barline", "barline").when(barrier, "measureBarrier")
    played = F.col("kind").isin(*PLAYED)
    # what was last seen of separators and things played: a separator of the other kind joins the one before
    seen = F.last(F.when(separator.isNotNull(), separator).when(played, F.lit("played")), ignorenulls=True).over(before)
    joined = separator.isNotNull() & seen.isin("barline", "measureBarrier") & (seen != separator)
    closes = separator.isNotNull() & ~F.coalesce(joined, F.lit(False))
    out = tokens.withColumns({"separator": separator, "_closes": closes, "_played": played})
    index = F.coalesce(F.sum(F.when(F.col("_closes"), 1).otherwise(0)).over(before), F.lit(0))
    return out.withColumn("cell_index", index.cast("long")).drop("_closes", "_played")


def grid_cells(tokens: DataFrame) -> DataFrame:
    """Tokens by part and measure, repeats of both notations played out: the columns of with_cells and measure_index.

    tok_idx orders played tokens; source_idx is the token's own place. A cell without a token of its own
    gives a row of nulls. Empty cells at both ends of a part give none.
    """
    flat = flattened_repeats(tokens).withColumn("source_idx", F.col("tok_idx")).withColumn("tok_idx", F.col("play_idx")).drop("play_idx")
    celled = with_cells(without_preamble(with_parts(flat)))
    w = Window.partitionBy("score_id", "part_idx").orderBy("tok_idx")
    here, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell, style = F.col("cell_index"), F.coalesce("barline", F.lit(""))
    played = F.col("kind").isin(*PLAYED)
    own = F.col("separator").isNull() & (style != "repeatStart")
    closes = F.col("separator").isNotNull() & ~F.coalesce(F.lead("cell_index").over(w) == cell, F.lit(False))
    rows = celled.withColumns({"_closes": closes, "_own": own, "_n_own": F.count_if(own).over(here), "_n_played": F.count_if(played).over(here), "_first": F.min(F.when(played, cell)).over(every), "_full": F.max(F.when(played, cell)).over(every), "_last": F.max(cell).over(every), "_signs": F.max(style.isin("repeatStart", "repeatEnd")).over(every)})
    at_close = lambda c: F.coalesce(F.last(F.when(F.col("_closes"), F.col(c)), ignorenulls=True).over(before), F.lit(0))
    rows = rows.withColumns({"_bare": F.col("_closes") & (F.col("_n_own") == at_close("_n_own")), "_silent": F.col("_closes") & (F.col("_n_played") == at_close("_n_played"))})
    # the order of a part with repeat signs is worked out once, on its first row
    ends = style == "repeatEnd"
    # a repeat end closes the cell it stands in, or (joined to another separator) the one before
    sign = F.struct((cell - F.when(ends & ~F.col("_closes"), 1).otherwise(0)).alias("cell"), ends.alias("ends"))
    rows = rows.withColumns({"_sign": F.collect_list(F.when(style.isin("repeatStart", "repeatEnd"), sign)).over(every), "_none": F.collect_list(F.when(F.col("_signs") & F.col("_silent"), cell)).over(every), "_row": F.row_number().over(w)})
    none = F.when(F.col("_full") < F.col("_last"), F.concat("_none", F.array("_last"))).otherwise(F.col("_none"))
    rows = rows.withColumn("_order", F.when(F.col("_signs") & (F.col("_row") == 1) & F.col("_full").isNotNull(), grid.played_order(F.array_sort("_sign"), none, F.col("_last"))))
    rows = rows.withColumn("_order", F.first("_order").over(every)).where("_own or _bare")
    in_order = let(F.col("_order"), lambda o: F.filter(F.transform(o, lambda c, i: F.when(c == cell, i.cast("long"))), lambda i: i.isNotNull()))
    at = F.when(F.col("_order").isNotNull(), in_order).when(cell.between(F.col("_first"), F.col("_full")), F.array(cell - F.col("_first")))
    rows = rows.withColumn("measure_index", F.explode(at))
    keys = ("score_id", "part_idx", "part", "cell_index", "measure_index")
    return rows.select(*[c if c in keys else F.when(F.col("_own"), F.col(c)).alias(c) for c in (*celled.columns, "measure_index")])


def cell_errors(tokens: DataFrame) -> DataFrame:
    """Cells whose repeats or tuplets don't close within the cell: kind cellParseError."""
    celled = with_cells(without_preamble(with_parts(tokens)))
    is_repeat = F.col("kind") == "repeatBoundary"
    sums = celled.groupBy("score_id", "part", "part_idx", "cell_index").agg(F.sum(F.when(is_repeat & F.col("repeat_count").isNull(), 1).when(is_repeat, -1).otherwise(0)).alias("repeats"), F.sum(F.when(F.col("kind") == "tupletOpen", 1).when(F.col("kind") == "tupletClose", -1).otherwise(0)).alias("tuplets"))
    return sums.where("repeats <> 0 or tuplets > 0").select(F.lit("cellParseError").alias("kind"), "score_id", "part", "part_idx", "cell_index")


_SPLIT = "score_id long, part_idx long, tok_idx long, old_measure long, measure_index long, start long"


def split_long_cells(cells: DataFrame, units_per_measure: DataFrame) -> DataFrame:
    """Cells longer than a measure are cut at measure lengths; tuplets stay whole. Adds start, the place in the new cell.

    units_per_measure: score_id, upm. A fold along one part.
    """
    rows = with_tuplet_units(cells).join(units_per_measure, "score_id")
    rows = rows.withColumn("adds", attached_units(rows)).withColumn("sounds", F.coalesce("played_units", "adds"))

    def cut(part: list) -> Iterator[tuple]:
        out = 0
        for _, own in groupby(part, key=lambda r: r.measure_index):
            cell = list(own)
            long = sum(r.adds or 0 for r in cell) > cell[0].upm > 0
            used = at = 0
            for r in cell:
                adds = r.adds or 0
                if long and adds > 0 and used > 0 and used + adds > r.upm:
                    out, used, at = out + 1, 0, 0
                if r.tok_idx is not None:
                    yield r.score_id, r.part_idx, r.tok_idx, r.measure_index, out, at
                at += r.sounds or 0
                used += adds
                inside = r.in_tuplet or r.kind == "tupletOpen"
                if long and used >= r.upm and not inside:
                    out, used, at = out + 1, 0, 0
                elif long and r.kind == "tupletClose" and used >= r.upm:
                    out, used, at = out + 1, 0, 0
            if not (long and used == 0):
                out += 1

    found = folds.by_key(rows.select("score_id", "part_idx", "measure_index", "tok_idx", "kind", "adds", "sounds", "upm", F.col("tuplet").isNotNull().alias("in_tuplet")), ["score_id", "part_idx"], ["measure_index", "tok_idx"], cut, _SPLIT)
    return cells.withColumnRenamed("measure_index", "old_measure").join(found, ["score_id", "part_idx", "tok_idx", "old_measure"])


def with_tuplet_units(tokens: DataFrame) -> DataFrame:
    """played_units of tuplet members: their written units scaled to the group's, rounded; null elsewhere."""
    w = Window.partitionBy("score_id", "part_idx", "measure_index", "tuplet")
    written = F.sum(F.when(F.col("kind").isin("note", "rest"), F.col("units"))).over(w)
    copies = F.count_if(F.col("kind").isin("note", "rest")).over(w) / F.greatest(F.lit(1), F.size(F.collect_set(F.when(F.col("kind").isin("note", "rest"), F.col("source_idx"))).over(w)))
    scale = F.col("target_units") * copies / F.nullif(written, F.lit(0))
    inside = F.col("tuplet").isNotNull() & F.col("kind").isin("note", "rest")
    zero = F.when(F.col("kind").isin("tupletOpen", "tupletClose"), 0)
    return tokens.withColumn("played_units", F.coalesce(F.when(inside, F.floor(F.col("units") * scale + 0.5)), zero).cast("long"))


def attached_units(tokens: DataFrame) -> Column:
    """Units a token adds to its cell: graces nothing, tuplet members their group's units on the opening token."""
    inside = F.col("tuplet").isNotNull() if "tuplet" in tokens.columns else F.lit(False)
    return F.when(inside | F.col("grace").isNotNull(), 0).when(F.col("kind") == "tupletOpen", F.col("tuplet_units")).when(F.col("kind").isin("note", "rest"), F.col("units")).otherwise(0)
