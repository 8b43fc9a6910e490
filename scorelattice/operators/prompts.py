"""Prompts over analysed scores, in our own words: sections joined by ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelattice.operators.proposals import CONTEXT_SCHEMA, ROLES, numbered

KINDS = ("analyze", "reharmonize", "addPart", "continue", "fixSection")


def task_errors(task: Column, n_measures: Column, labels: Column) -> Column:
    """What is wrong with a task: struct(kind, from_measure, to_measure, part_label, measures_to_add)."""
    spans = task["kind"].isin("reharmonize", "fixSection")
    start, end = task["from_measure"], task["to_measure"]
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(task["kind"], F.lit("")).isin(*KINDS), "unknown kind"),
            F.when(spans & (F.coalesce(start, F.lit(1)) < 1), "first measure before 1"),
            F.when(spans & (F.coalesce(end, n_measures) > n_measures), "last measure after the end"),
            F.when(spans & (F.coalesce(start, F.lit(1)) > F.coalesce(end, n_measures)), "measures the wrong way round"),
            F.when((task["kind"] == "addPart") & (F.coalesce(F.trim(task["part_label"]), F.lit("")) == ""), "no part label"),
            F.when((task["kind"] == "addPart") & F.array_contains(labels, task["part_label"]), "part label is taken"),
            F.when((task["kind"] == "continue") & ~F.coalesce(task["measures_to_add"] > 0, F.lit(False)), "nothing to add"),
        )
    )


def task_text(task: Column) -> Column:
    kind, span = task["kind"], F.concat(F.lit("measures "), F.coalesce(task["from_measure"].cast("string"), F.lit("1")), F.lit(" to "), F.coalesce(task["to_measure"].cast("string"), F.lit("the end")))
    return (
        F.when(kind == "analyze", "Describe the harmony and the voice leading. Propose changes only where a rule is broken.")
        .when(kind == "reharmonize", F.concat(F.lit("Find new chords for "), span, F.lit(". Leave the melody of the first part as it is.")))
        .when(kind == "addPart", F.concat(F.lit("Write one more part, labelled ["), task["part_label"], F.lit("]. The other parts stay as they are.")))
        .when(kind == "continue", F.concat(F.lit("Write "), task["measures_to_add"].cast("string"), F.lit(" more measures for every part.")))
        .when(kind == "fixSection", F.concat(F.lit("Mend the faults in "), span, F.lit(". Nothing outside may change.")))
    )


def chord_lines(labels: DataFrame) -> DataFrame:
    """score_id, chords: a line for each labelled measure."""
    line = F.concat(F.lit("measure "), (F.col("measure_index") + 1).cast("string"), F.lit(": "), F.col("symbol"))
    return labels.groupBy("score_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("chords"), F.count("*").alias("n_chords"))


def observation_lines(observations: DataFrame) -> DataFrame:
    """score_id, observations: a line each, in order."""
    where = F.concat(F.lit("measures "), (F.col("from_measure") + 1).cast("string"), F.lit("-"), (F.col("to_measure") + 1).cast("string"))
    line = F.concat_ws(" ", F.lit("-"), "kind", F.lit("in"), where, F.concat(F.lit("("), F.concat_ws(", ", F.col("part_a").cast("string"), F.col("part_b").cast("string")), F.lit(")")))
    order = F.struct("from_measure", "kind", "part_a", "part_b", line.alias("line"))
    return observations.groupBy("score_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("observations"), F.count("*").alias("n_observations"))


def harmony_prompt(scores: DataFrame, labels: DataFrame, observations: DataFrame, counts: DataFrame) -> DataFrame:
    """score_id, prompt, errors. scores: score_id, source, task; counts: score_id, n_measures, labels."""
    rows = scores.join(counts, "score_id").join(chord_lines(labels), "score_id", "left").join(observation_lines(observations), "score_id", "left")
    errors = task_errors(F.col("task"), F.col("n_measures"), F.col("labels"))
    section = lambda title, body: F.concat(F.lit(f"\n\n## {title}\n"), F.coalesce(body, F.lit("none")))
    counted = F.concat(F.col("n_measures").cast("string"), F.lit(" measures, "), F.coalesce("n_chords", F.lit(0)).cast("string"), F.lit(" labelled, "), F.coalesce("n_observations", F.lit(0)).cast("string"), F.lit(" observations"))
    text = F.concat(F.lit("You are given a score as text, a line for each part and a bar between measures."), section("Task", task_text(F.col("task"))), section("Summary", counted), section("Score", numbered(F.col("source"))), section("Chords", F.col("chords")), section("Observations", F.col("observations")), F.lit("\n\nAnswer with a short summary, then each version of the whole score in a block fenced as score."))
    return rows.select("score_id", F.when(F.size(errors) == 0, text).alias("prompt"), errors.alias("errors"))


def structure_prompt() -> str:
    """The question about a score's structure; the reply is read by proposals.score_context."""
    fields = "\n".join(f"- {f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in _top_level(CONTEXT_SCHEMA))
    return f"Look at the pages and describe the score as one JSON object, fenced as json, with these fields:\n{fields}\nRoles of staves: {', '.join(ROLES)}. Leave out optional fields that you can't see."


def _top_level(schema: str) -> list[str]:
    out, depth, own = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()]


def cell_prompt(cells: DataFrame, only: tuple[str, ...] = ("low", "unknown")) -> DataFrame:
    """page_id, prompt: the cells of a page that are in doubt, to be written again. cells: page_id, cell_id, bin, text."""
    line = F.concat(F.lit("/* cell "), F.col("cell_id"), F.lit(" */ "), F.col("text"))
    rows = cells.where(F.col("bin").isin(*only)).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n_cells"))
    head = F.lit("These cells were read with doubt. Write each again after its marker, in a block fenced as score. List what you can't read under UNRESOLVED.\n")
    return rows.select("page_id", "n_cells", F.concat(head, "lines").alias("prompt"))


def cell_overrides(responses: DataFrame, tag: str = "score") -> DataFrame:
    """key, cell_id, at, text of the marked cells in replies (key, text)."""
    marked = F.regexp_extract_all("text", F.lit(r"/\*\s*cell\s+(p\d+s\d+i\d+m\d+)\s*\*/([^\n]*)"), F.lit(0))
    rows = responses.select("key", F.posexplode(marked).alias("at", "line"))
    return rows.select("key", F.regexp_extract("line", r"(p\d+s\d+i\d+m\d+)", 1).alias("cell_id"), "at", F.trim(F.regexp_extract("line", r"\*/([^\n]*)", 1)).alias("text"))


def review_prompt(parts: DataFrame, most_warnings: int = 50, most_pages: int = 8) -> DataFrame:
    """key, part, prompt and, if parts has them, the first pages for the review of each part.

    parts: key, part, line, warnings (array), pages (array, optional). Warnings and pages beyond the limits are left out.
    """
    listed = F.array_join(F.slice("warnings", 1, most_warnings), "\n- ")
    text = F.concat(F.lit("Check this part against the pages, measure by measure. Keep the number of measures.\n"), "line", F.when(F.size("warnings") > 0, F.concat(F.lit("\nKnown doubts:\n- "), listed)).otherwise("")).alias("prompt")
    shown = [F.slice("pages", 1, most_pages).alias("pages")] if "pages" in parts.columns else []
    return parts.select("key", "part", text, *shown)
