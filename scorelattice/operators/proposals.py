"""Replies to prompts: extraction, validation against the score, differences. Text in, text out.

responses: response_id, text and, where they are compared, original (a notation source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FENCE = r"(?s)```{tag}[ \t]*\r?\n(.*?)```"


def blocks(text: Column, tag: str) -> Column:
    """Contents of the fenced blocks with a tag, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_FENCE.format(tag=tag)), F.lit(1)), lambda b: F.regexp_replace(b, r"\s+\z", ""))


def json_block(text: Column) -> Column:
    """The first fenced json block, else any fenced block that begins with a brace, else the text if it does."""
    fenced, plain = blocks(text, "json"), F.filter(blocks(text, ""), lambda b: F.ltrim(b).startswith("{"))
    return F.coalesce(F.get(fenced, F.lit(0)), F.get(plain, F.lit(0)), F.when(F.ltrim(text).startswith("{"), F.trim(text)))


def summary(text: Column) -> Column:
    """What stands before the first fence."""
    return F.trim(F.split_part(text, F.lit("```"), F.lit(1)))


def declined(text: Column) -> Column:
    """A reply without a fence that says something."""
    return ~text.contains("```") & (F.length(F.trim(text)) > 0)


def proposals(responses: DataFrame, tag: str) -> DataFrame:
    """A row for each block: proposal_idx, source and the label announced before it."""
    found = responses.select("response_id", "text", F.posexplode(blocks(F.col("text"), tag)).alias("proposal_idx", "source"))
    before = F.get(F.split(F.col("text"), rf"```{tag}"), F.col("proposal_idx"))
    window = F.expr("right(before, 1024)")
    lines = F.filter(F.transform(F.split("window", "\n"), F.trim), lambda x: F.length(x) > 0)
    last = F.expr("slice(lines, greatest(1, size(lines) - 9), 10)")
    named = F.filter("last", lambda x: x.rlike(r"(?i)^(?:#+\s*|\*+\s*)?(?:alternative|option|proposal|plan)\b"))
    return found.withColumn("before", before).withColumn("window", window).withColumn("lines", lines).withColumn("last", last).withColumn("label", F.element_at(F.when(F.size(named) > 0, named), -1)).select("response_id", "proposal_idx", "source", "label")


def part_lines(sources: DataFrame, key: str) -> DataFrame:
    """key, label, line of every part line ([n]...) of the sources; the last of a label counts."""
    lines = sources.select(key, F.posexplode(F.split("source", r"\r?\n")).alias("at", "line")).withColumn("label", F.regexp_extract("line", r"^\s*\[(\d+|P)", 1)).where("label <> ''")
    return lines.groupBy(key, "label").agg(F.max_by(F.trim("line"), "at").alias("line"))


def changed_parts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Parts that were added, removed or changed: a full outer join by label."""
    a = before.select(key, "label", F.col("line").alias("old"))
    b = after.select(key, "label", F.col("line").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, [key, "label"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "label", change.alias("change"))


def line_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Lines of one side that the other side lacks, repeats kept, in order. Columns key, source on both sides."""
    cut = lambda df: df.select(key, F.posexplode(F.split("source", "\n")).alias("at", "line"))
    a, b = cut(before), cut(after)
    gone = a.join(b.select(key, "line").distinct(), [key, "line"], "left_anti").withColumn("change", F.lit("removed"))
    new = b.join(a.select(key, "line").distinct(), [key, "line"], "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new).select(key, "change", F.col("at").cast("long").alias("line_no"), "line")


def leaked_measures(before: DataFrame, after: DataFrame, first: Column, last: Column) -> DataFrame:
    """Measures outside first..last (from 1) whose cells differ. Cells: score_id, measure_index, part_idx, pitches."""
    key = ["score_id", "measure_index", "part_idx"]
    a, b = before.select(*key, F.col("pitches").alias("old"), F.lit(True).alias("in_a")), after.select(*key, F.col("pitches").alias("new"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    differs = F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    outside = ~(F.col("measure_index") + 1).between(first, last)
    return both.where(differs & outside).select("score_id", "measure_index").distinct()


def melody_kept(before: DataFrame, after: DataFrame, part: Column) -> DataFrame:
    """Whether one part's pitches are the same in both versions of a score."""
    key = ["score_id", "measure_index", "part_idx"]
    a, b = before.where(F.col("part_idx") == part), after.where(F.col("part_idx") == part)
    both = a.select(*key, F.col("pitches").alias("old")).join(b.select(*key, F.col("pitches").alias("new")), key, "full_outer")
    return both.groupBy("score_id").agg(F.min(F.col("old").eqNullSafe(F.col("new"))).alias("kept"))


def continued(counts_before: DataFrame, counts_after: DataFrame, wanted: Column) -> DataFrame:
    """Whether a continuation has the measures asked for: a whole score or the new part alone, one more at most."""
    both = counts_before.select("score_id", F.col("n_measures").alias("old")).join(counts_after.select("score_id", F.col("n_measures").alias("new")), "score_id")
    whole = F.col("new") >= F.col("old")
    added = F.when(whole, F.col("new") - F.col("old")).otherwise(F.col("new"))
    return both.select("score_id", F.when(whole, "full").otherwise("snippet").alias("form"), added.alias("added"), ((added >= wanted) & (added <= wanted + 1)).alias("ok"))


def reconcile(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Overrides against the cells that were asked for: accepted (the first of each id), unexpected, missing, repeated.

    expected: key, cell_id; given: key, cell_id, at, text.
    """
    first = F.row_number().over(Window.partitionBy("key", "cell_id").orderBy("at"))
    ranked = given.withColumn("rank", first)
    asked = expected.select("key", "cell_id").distinct()
    accepted = ranked.where("rank = 1").join(asked, ["key", "cell_id"], "left_semi").withColumn("status", F.lit("accepted"))
    repeated = ranked.where("rank > 1").join(asked, ["key", "cell_id"], "left_semi").withColumn("status", F.lit("repeated"))
    unexpected = ranked.join(asked, ["key", "cell_id"], "left_anti").withColumn("status", F.lit("unexpected"))
    out = accepted.unionByName(repeated).unionByName(unexpected).select("key", "cell_id", "status", "text")
    missing = asked.join(given.select("key", "cell_id"), ["key", "cell_id"], "left_anti").select("key", "cell_id", F.lit("missing").alias("status"), F.lit(None).cast("string").alias("text"))
    return out.unionByName(missing)


def unresolved(text: Column) -> Column:
    """Entries of the UNRESOLVED list: the lines after its heading up to an empty one, bullets stripped."""
    after = F.regexp_extract(text, r"(?is)^.*?\bUNRESOLVED\b\s*:?[ \t]*\r?\n(.*)$", 1)
    upto = F.split_part(F.concat(after, F.lit("\n\n")), F.lit("\n\n"), F.lit(1))
    return F.filter(F.transform(F.split(upto, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: F.length(x) > 0)


def uncertain(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:unsure|uncertain|unclear|not sure|maybe|possibly|guess)\b|\?{1,}")


def numbered(source: Column) -> Column:
    """The source with its lines numbered, right-aligned."""
    lines = F.split(source, "\n")
    width = F.length(F.size(lines).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit(": "), x)), "\n")


def measure_texts(line: Column) -> Column:
    """Cells of a part line, white space evened out."""
    body = F.regexp_replace(line, r"^\s*\[[^\]]*\]\s*\|?|\|\s*$", "")
    return F.transform(F.split(body, r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))


def reviewed_part(draft: DataFrame, revised: DataFrame, units: str = "units", expected: int = 64, tolerance: float = 0.5) -> DataFrame:
    """Measures of a reviewed part, each checked: a wrong length falls back to the draft, the first measure is exempt.

    Both sides: key, at, text, units. A revision with another number of measures is rejected as a whole.
    """
    n = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    a = draft.select("key", "at", F.col("text").alias("old"))
    b = revised.select("key", "at", F.col("text").alias("new"), F.col(units).alias("got"))
    both = a.join(b, ["key", "at"], "full_outer").join(n(draft, "n_old"), "key").join(n(revised, "n_new"), "key", "left")
    reason = F.when(~F.col("n_old").eqNullSafe(F.col("n_new")), "measureCount").when((F.col("at") > 0) & (F.abs(F.col("got") - expected) > tolerance), "duration")
    kept = both.withColumn("reason", reason).where("old is not null")
    return kept.select("key", "at", F.when(F.col("reason").isNull(), F.coalesce("new", "old")).otherwise(F.col("old")).alias("text"), "reason")


def issue_kinds(issues: DataFrame, key: str) -> DataFrame:
    return issues.groupBy(key).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


#: The fields of a score's structure and the roles of staves.
CONTEXT_SCHEMA = "voicePartsCount int, hasPiano boolean, hasPercussion boolean, stavesPerSystem int, staffRoles array<string>, clefsPerStaff array<string>, initialTimeSignature struct<numerator:int,denominator:int>, initialKeyFifths int, lyricsRows int, totalMeasures int, title string, composer string, tempo string, timeChanges array<struct<measure:int,numerator:int,denominator:int>>, keyChanges array<struct<measure:int,fifths:int>>, notes array<string>"
ROLES = ("voice", "piano-rh", "piano-lh", "percussion", "other")


def score_context(responses: DataFrame) -> DataFrame:
    """The structure that a reply describes: parsed fields, errors of required ones, optional items dropped with warnings."""
    parsed = responses.withColumn("json", json_block(F.col("text"))).withColumn("c", F.from_json("json", CONTEXT_SCHEMA))
    c = F.col("c")
    checks = {
        "noJson": F.col("json").isNull(),
        "badJson": F.col("json").isNotNull() & F.expr("try_parse_json(json)").isNull(),
        "voicePartsCount": ~(F.coalesce(c["voicePartsCount"], F.lit(-1)) >= 0),
        "hasPiano": c["hasPiano"].isNull(),
        "hasPercussion": c["hasPercussion"].isNull(),
        "stavesPerSystem": ~(F.coalesce(c["stavesPerSystem"], F.lit(0)) >= 1),
        "staffRoles": c["staffRoles"].isNull() | (F.size(c["staffRoles"]) != c["stavesPerSystem"]) | F.exists(F.coalesce(c["staffRoles"], F.array()), lambda r: r.isNull() | ~r.isin(*ROLES)),
        "clefsPerStaff": c["clefsPerStaff"].isNull() | (F.size(c["clefsPerStaff"]) != c["stavesPerSystem"]),
        "initialTimeSignature": c["initialTimeSignature"]["numerator"].isNull() | (c["initialTimeSignature"]["numerator"] < 1) | c["initialTimeSignature"]["denominator"].isNull() | ~c["initialTimeSignature"]["denominator"].isin(1, 2, 4, 8, 16, 32),
        "initialKeyFifths": ~F.coalesce(c["initialKeyFifths"], F.lit(99)).between(-7, 7),
        "lyricsRows": ~(F.coalesce(c["lyricsRows"], F.lit(-1)) >= 0),
        "totalMeasures": ~(F.coalesce(c["totalMeasures"], F.lit(0)) >= 1),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks.items()]))
    times = F.filter(F.coalesce(c["timeChanges"], F.array().cast("array<struct<measure:int,numerator:int,denominator:int>>")), lambda t: (t["measure"] >= 1) & (t["numerator"] >= 1) & (t["denominator"] >= 1))
    keys = F.filter(F.coalesce(c["keyChanges"], F.array().cast("array<struct<measure:int,fifths:int>>")), lambda k: (k["measure"] >= 1) & k["fifths"].between(-7, 7))
    dropped = F.coalesce(F.size(c["timeChanges"]), F.lit(0)) - F.size(times) + F.coalesce(F.size(c["keyChanges"]), F.lit(0)) - F.size(keys)
    return parsed.select("response_id", F.when(F.size(errors) == 0, c).alias("context"), errors.alias("errors"), times.alias("time_changes"), keys.alias("key_changes"), dropped.alias("dropped"))
