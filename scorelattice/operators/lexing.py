"""Notation text to token rows, in Spark expressions.

One lossless pattern cuts a text into pieces: every character belongs to a piece, so offsets are
running sums of lengths over a score's pieces. The branch of the pattern that a piece came from shows in
its first character, its last one and its length; further patterns read what is inside. The work
grows in proportion to a text.

scores: score_id, source. tokens: score_id, tok_idx, kind, raw, offset and the columns of ATTRIBUTES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelattice.functions.pitch import absolute, clamped_alter, dotted, half_up, let, letter_fifths, lookup, units_of
from scorelattice.operators import shares

# --- the pieces (fixed values: the notation's own patterns) ----------------

_PITCH = r"[A-Ga-g](?:\*[0-9]|(?:bb|[#bx])?+[0-9](?:bb|b(?![0-9])|[#*x])?+)(?:![dx/t])?+"
_LENGTH = r"(?:[h-nH-N]|[gG](?![0-9#bx*A-Ga-g]))"
_SUFFIX = r"(?:tr|MR|mr|TN|tn|z[123]|ar|gl|j[fdps]|bn|vb|~[sl]|[sS>^\-~_VWOXT])"
_NOTE = rf"(?:{_PITCH})++{_LENGTH}\.{{0,3}}{_SUFFIX}*+"
_LYRIC = r"(?:(?!/\*)[^ \t\n\r|;,\[\]():+'`RA-Ga-g0-9])++"
#: Kinds and their patterns; the first that matches at a place wins.
PIECES = (
    ("space", r"[ \t\n\r]++"),
    ("comment", r";[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"),
    ("unclosedComment", r"/\*[\s\S]*+"),
    ("barline", r"\|"),
    ("measureBarrier", r",,,|,,|,:|,-|,\.|,|:,"),
    ("meta", r"\[[^\]]*+\]"),
    ("unclosedMeta", r"\[[\s\S]*+"),
    ("repeatBoundary", r":[0-9]*+"),
    ("tupletOpen", r"[0-9]++\("),
    ("tupletClose", r"\)"),
    ("tie", r"\+"),
    ("lyric", rf"[0-9]++|'(?:[A-Ga-g](?:bb|[#bx*])?[0-9](?:bb|[#bx*])?[g-nG-N]|[\s\S])"),
    ("space", r"'\z"),
    ("rest", r"R[g-nG-N]\.{0,3}"),
    ("note", rf"``{_NOTE}|`{_NOTE}|{_NOTE}"),
    ("lyric", rf"{_LYRIC}|[\s\S]"),
)
MASTER = "|".join(f"(?:{p})" for _, p in PIECES)
#: What a pitch may hold beside its digit.
_NO_DIGITS = "ABCDEFGabcdefg#x*!/t"
#: The header, if the text begins with one.
_SPACE_OR_COMMENT = r"(?:[ \t\n\r]++|;[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+"
_HEADER_PARTS = r"(?:\d+/\d+|K[+-]\d+|(?i:DIV)\d+|D\d+|K[A-G][#b]?m?|(?:Treble|Bass|Alto|Tenor|Percussion|Soprano|Baritone|Te|Al|Pe|So|Br|T|B|A|N)(?=$|[^A-Za-z0-9]|[\dKD]))"
HEADER = rf"^{_SPACE_OR_COMMENT}\[([^\]]*)\]"
IS_HEADER = rf"^\s*(?:(?:{_HEADER_PARTS}\s*)*|(?i:CLEF|TIME|KEY|DIV)\s*:[\s\S]*)$"

# --- fixed values ---------------------------------------------------------

DYNAMICS = ("pppp", "ppp", "pp", "p", "mp", "mf", "f", "ff", "fff", "ffff", "fp", "fz", "sf", "sfz", "sffz", "sfp", "sfpp", "rfz", "rf", "<", ">", "/")
BARRIERS = {",": "single", ",,": "double", ",,,": "final", ",:": "repeatStart", ":,": "repeatEnd", ",-": "dashed", ",.": "invisible"}
SUFFIXES = {"tr": "trill", "MR": "invertedMordent", "mr": "mordent", "TN": "invertedTurn", "tn": "turn", "z1": "tremolo1", "z2": "tremolo2", "z3": "tremolo3", "ar": "arpeggio", "gl": "glissando", "jf": "fall", "jd": "doit", "jp": "plop", "js": "scoop", "bn": "bend", "vb": "vibrato", "~s": "fermataShort", "~l": "fermataLong", "s": "staccato", "S": "staccatissimo", ">": "accent", "^": "marcato", "-": "tenuto", "~": "fermata", "_": "slurEnd", "V": "upBow", "W": "downBow", "O": "harmonic", "X": "snapPizz", "T": "stopped"}
HEADS = {"!d": "diamond", "!x": "x", "!/": "slash", "!t": "triangle"}
CLEFS = {"TREBLE": "TREBLE", "T": "TREBLE", "BASS": "BASS", "B": "BASS", "T8": "TREBLE_8VA", "T-8": "TREBLE_8VB", "ALTO": "ALTO", "AL": "ALTO", "A": "ALTO", "TENOR": "TENOR", "TE": "TENOR", "PERCUSSION": "PERCUSSION", "PE": "PERCUSSION", "N": "PERCUSSION", "SOPRANO": "SOPRANO", "SO": "SOPRANO", "BARITONE": "BARITONE", "BR": "BARITONE", "TREBLE_8VA": "TREBLE_8VA", "TREBLE_8VB": "TREBLE_8VB"}
#: Clef names that a meta command may consist of.
BARE_CLEFS = {k: CLEFS[k] for k in ("T", "B", "T8", "T-8", "A", "TE", "PE", "N", "SO", "BR")}


def _blank(raw: Column) -> Column:
    """Whether a piece is white space or a comment: a short test, as plans repeat what they filter by."""
    comment = raw.startswith("/*") & raw.endswith("*/") & (F.length(raw) > 3)
    return F.left(raw, F.lit(1)).isin(" ", "\t", "\n", "\r", ";") | comment | (raw == "'")


def with_kind(rows: DataFrame) -> DataFrame:
    """kind of a piece: the branch of the pattern that can begin as the piece does.

    The first character, and whether it is alone, are columns of their own, so that they are worked out once.
    """
    rows = rows.withColumns({"_first": F.left("raw", F.lit(1)), "_alone": F.length("raw") == 1})
    raw, first, alone = F.col("raw"), F.col("_first"), F.col("_alone")
    kind = (
        F.when(first.isin(*"ABCDEFGabcdefg`") & ~alone, "note")
        .when(first.isin(" ", "\t", "\n", "\r"), "space")
        .when(first == "|", "barline")
        .when(first == "[", F.when(~alone & raw.endswith("]"), "meta").otherwise("unclosedMeta"))
        .when((first == ",") | (raw == ":,"), "measureBarrier")
        .when(first == ":", "repeatBoundary")
        .when(first == "+", "tie")
        .when(first == ")", "tupletClose")
        .when((first == "R") & ~alone, "rest")
        .when(first.isin(*"0123456789") & raw.endswith("("), "tupletOpen")
        .when(first == ";", "comment")
        .when(raw.startswith("/*"), F.when(_blank(raw), "comment").otherwise("unclosedComment"))
        .when((first == "'") & alone, "space")
        .otherwise("lyric")
    )
    return rows.withColumn("kind", kind).drop("_first", "_alone")


# --- header ---------------------------------------------------------------


def _last(text: Column, pattern: str) -> Column:
    """What group 1 of the last match holds, null without a match."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def header(source: Column) -> Column:
    """struct of the header's fields, defaults where it has none, and an error where it is wrong."""
    inner = F.when(source.rlike(HEADER), F.regexp_extract(source, HEADER, 1))
    given = let(inner, lambda i: F.when(i.rlike(IS_HEADER), i))
    return let(given, lambda i: let(_header_texts(i), lambda t: let(_header_values(t), lambda v: F.struct(*[v[k].alias(k) for k in (*_DEFAULTS, "error")], i.isNotNull().alias("given")))))


_DEFAULTS = {"clef": "TREBLE", "time_num": 4, "time_den": 4, "key_fifths": 0, "div": 64, "transpose": 0}


def _header_texts(inner: Column) -> Column:
    """The texts of a header's parts, long (KEY:value) and short ones; null where it has none."""
    # a pattern is tried only where the text has what it can't do without; what is left of a text is worked out once
    long_of = lambda key: F.when(inner.contains(":"), _last(inner, rf"(?:^|\s)(?i:{key}):(\S*)")).alias(key.lower())
    with_k = lambda short, pattern: F.when(short.contains("K"), _last(short, pattern))
    bare = lambda short: F.regexp_replace(short, r"(?i)D(?:IV?)?\d+|K[A-G][#b]?m?|K[+-]\d+", " ")
    texts = lambda short: F.struct(
        *[long_of(k) for k in ("CLEF", "TIME", "KEY", "DIV")],
        with_k(short, r"K([A-G][#b]?m?)").alias("short_key"),
        F.when(short.contains("/"), _last(short, r"(\d+/\d+)")).alias("short_time"),
        F.when(short.contains("D") | short.contains("d"), _last(short, r"(?i)D(?:IV?)?(\d+)")).alias("short_div"),
        with_k(short, r"K([+-]\d+)").alias("transpose"),
        F.when(F.trim(short) != "", _last(bare(short), r"(Treble|Bass|Alto|Tenor|Percussion|Soprano|Baritone|Te|Al|Pe|So|Br|T|B|A|N)")).alias("short_clef"),
    )
    return let(F.concat(F.lit(" "), F.when(inner.contains(":"), F.regexp_replace(inner, r"\S*:\S*", " ")).otherwise(inner), F.lit(" ")), texts)


def _header_values(t: Column) -> Column:
    """The values of those texts, and what is wrong with them."""
    of_letter = lambda k: letter_fifths(F.substring(k, 1, 1), F.regexp_extract(k, r"^.([#b♭])", 1), k.rlike(r"^.[#b♭]?m(in)?$"))
    number = F.regexp_extract(t["key"], r"^\s*([+-]?\d+)", 1).try_cast("int")
    fifths = F.coalesce(F.when(t["short_key"].isNotNull(), of_letter(t["short_key"])), number, of_letter(t["key"]), F.lit(0))
    time = F.coalesce(t["short_time"], F.when(t["time"].rlike(r"^\d+/\d+$"), t["time"]), F.lit("4/4"))
    div = F.coalesce(t["short_div"].cast("int"), F.regexp_extract(t["div"], r"^(\d+)", 1).try_cast("int"), F.lit(64))
    name = F.regexp_replace(F.upper(t["clef"]), r"[-\s]", "_")
    long_clef = F.when(F.length(name) > 2, lookup(CLEFS, name))
    fields = F.struct(
        F.coalesce(lookup(CLEFS, F.upper(t["short_clef"])), long_clef, F.lit("TREBLE")).alias("clef"),
        F.split_part(time, F.lit("/"), F.lit(1)).cast("int").alias("time_num"),
        F.split_part(time, F.lit("/"), F.lit(2)).cast("int").alias("time_den"),
        fifths.cast("int").alias("key_fifths"),
        div.alias("div"),
        F.coalesce(t["transpose"].cast("int"), F.lit(0)).alias("transpose"),
        F.when(t["clef"].isNotNull() & long_clef.isNull(), "clef")
        .when(t["time"].isNotNull() & ~t["time"].rlike(r"^\d+/\d+$"), "time")
        .when(t["key"].isNotNull() & number.isNull() & ~t["key"].rlike(r"^[A-Ga-g][#b♭]?(m|min|maj|major|minor)?$"), "key")
        .when(t["div"].isNotNull() & ~t["div"].rlike(r"^\d"), "div")
        .alias("wrong"),
    )

    def checked(f: Column) -> Column:
        upm = f["time_num"] * f["div"] / F.nullif(f["time_den"], F.lit(0))
        fits = F.when(f["div"] <= 0, "div").when(upm.isNull() | (upm < 1) | (F.abs(upm - half_up(upm)) > 1e-9), "divTime")
        return F.struct(*[f[k].alias(k) for k in _DEFAULTS], F.coalesce(f["wrong"], fits).alias("error"))

    return let(fields, checked)


def body_start(source: Column) -> Column:
    """Characters before the body: the header, and what comes before it."""
    given = source.rlike(HEADER) & F.regexp_extract(source, HEADER, 1).rlike(IS_HEADER)
    return F.when(given, F.length(F.regexp_extract(source, HEADER, 0))).otherwise(0)


# --- notes ----------------------------------------------------------------


def _alter(text: Column) -> Column:
    return F.when(text == "#", 1).when(text == "x", 2).when(text == "bb", -2).when(text == "b", -1).otherwise(0)


def _plain(raw: Column) -> Column:
    """Whether a note piece is a letter, a digit and a length, as most are: it needs no pattern."""
    return (F.length(raw) == 3) & raw.substr(2, 1).between("0", "9") & raw.substr(1, 1).between("A", "g")


def _sharp(raw: Column) -> Column:
    """The same with one sharp or flat before the digit."""
    return (F.length(raw) == 4) & raw.substr(2, 1).isin("#", "b") & raw.substr(3, 1).between("0", "9") & raw.substr(1, 1).between("A", "g")


def _pitch_texts(raw: Column) -> Column:
    """The texts of a note piece's pitches. No mark after the length looks like one."""
    only = F.array(F.left(raw, F.length(raw) - 1))
    return F.when(_plain(raw) | _sharp(raw), only).otherwise(F.regexp_extract_all(raw, F.lit(_PITCH), F.lit(0)))


def _pitch(p: Column) -> tuple[Column, Column, Column]:
    """(step, octave, alter) of a pitch's text."""
    digit = F.translate(p, _NO_DIGITS, "")
    at = F.instr(p, digit)
    first, second = p.substr(F.lit(2), at - 2), F.split_part(p.substr(at + 1, F.lit(2)), F.lit("!"), F.lit(1))
    alter = F.when(second == "*", 0).otherwise(_alter(first) + _alter(second))
    return F.upper(F.left(p, F.lit(1))), digit.cast("int"), clamped_alter(alter).cast("int")


def pitches(raw: Column) -> Column:
    """The pitches of a note piece: array of struct(step, octave, alter)."""
    named = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, ("step", "octave", "alter"), strict=True)])
    step, alter = F.upper(F.left(raw, F.lit(1))), F.when(raw.substr(2, 1) == "#", 1).otherwise(-1)
    plain, sharp = F.array(named(step, raw.substr(2, 1).cast("int"), F.lit(0))), F.array(named(step, raw.substr(3, 1).cast("int"), alter))
    return F.when(_plain(raw), plain).when(_sharp(raw), sharp).otherwise(F.transform(F.regexp_extract_all(raw, F.lit(_PITCH), F.lit(0)), lambda p: named(*_pitch(p))))


def _suffixes(raw: Column) -> Column:
    tail = F.regexp_extract(raw, rf"^`{{0,2}}(?:{_PITCH})++{_LENGTH}\.{{0,3}}({_SUFFIX}*+)$", 1)
    return F.when(_plain(raw) | _sharp(raw), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(tail, F.lit(_SUFFIX), F.lit(0)))


# --- meta commands --------------------------------------------------------

#: Type of a command, pattern of its inside, and the group that is its value; the first that matches.
METAS = (
    ("clefChange", r"^\s*(?i:T-8|T8|Te|Pe|So|Br|T|B|A|N)\s*$", 0),
    ("partSwitch", r"^(\d+)(?::[\s\S]+|:|\s*(?i:T-8|T8|Te|Pe|So|Br|T|B|A|N)\s*(?::[\s\S]*)?)$", 1),
    ("segno", r"^(?i:segno2?)$", 0),
    ("coda", r"^(?i:coda2?)$", 0),
    ("fine", r"^(?i:fine)$", 0),
    ("tocoda", r"^(?i:tocoda)$", 0),
    ("jump", r"^(?:DC|DS)(?:\.fine|\.coda)?$", 0),
    ("measureRepeat", r"^%$", 0),
    ("rehearsal", r"^R:([\s\S]*)$", 1),
    ("text", r"^text:([\s\S]*)$", 1),
    ("expression", r"^expr:([\s\S]*)$", 1),
    ("breath", r"^(?i:breath)$", 0),
    ("caesura", r"^(?i:caesura)$", 0),
    ("swing", r"^(?i:swing)$", 0),
    ("straight", r"^(?i:straight)$", 0),
    ("ottava", r"^(?:8va|8vb|15ma|15mb)/?$", 0),
    ("pedal", r"^ped/?$", 0),
    ("chord", r"^C:([\s\S]*)$", 1),
    ("fingering", r"^F:([\s\S]*)$", 1),
    ("stringNumber", r"^S:\s*\+?0*([1-9]\d*)", 1),
    ("multiRest", r"^mmr:\s*\+?0*([1-9]\d*)", 1),
    ("tempoText", r"^T:([\s\S]*)$", 1),
    ("tempo", r"^T(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)", 1),
    ("time", r"^M(\d+/\d+)$", 1),
    ("transpose", r"^K([+-]\d+)$", 1),
    ("key", r"^K([A-Ga-g][#b]?(?:m|min|maj)?|-?[0-7])$", 1),
    ("volta", r"^V(\d+)$", 1),
    ("voltaEnd", r"^/V(\d+)$", 1),
    ("dynamics", "^D(" + "|".join(sorted(DYNAMICS, key=len, reverse=True)) + ")$", 1),
    ("partSwitch", r"^(P|\d+)(?::[\s\S]*)?$", 1),
)


def meta(inner: Column) -> Column:
    """struct(type, value) of the inside of a command; type error if it is none."""
    out = None
    for kind, pattern, group in METAS:
        test, found = inner.rlike(pattern), F.struct(F.lit(kind).alias("type"), F.regexp_extract(inner, pattern, group).alias("value"))
        out = F.when(test, found) if out is None else out.when(test, found)
    return out.otherwise(F.struct(F.lit("error").alias("type"), F.lit(None).cast("string").alias("value")))


ATTRIBUTES = ("units", "dots", "pitches", "marks", "head", "grace", "slur_start", "barline", "repeat_count", "tuplet_units", "lyric", "meta_type", "meta_value", "part_label", "instrument", "clef", "error")


def pieces(scores: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """score_id, div, piece, kind, raw, offset of every piece of the body, spaces and comments too, and the columns to keep.

    Texts are dealt out by score while they are texts, so that nothing shuffles their many pieces, and to as many
    shares as their input asks for, as pieces take many times the room of their texts.
    """
    cut = shares.dealt(scores, "score_id").select("score_id", header(F.col("source"))["div"].alias("div"), body_start(F.col("source")).alias("start"), F.col("source"), *keep)
    found = cut.select("score_id", *keep, "div", "start", F.posexplode(F.regexp_extract_all(F.expr("substring(source, start + 1)"), F.lit(MASTER), F.lit(0))).alias("piece", "raw"))
    before = Window.partitionBy("score_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("start") + F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("int")
    return with_kind(found.select("score_id", *keep, "div", "piece", "raw", offset.alias("offset")))


def tokens(scores: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token rows of each score, with columns of its row to keep. tok_idx grows along the text and isn't dense: it counts pieces."""
    rows = pieces(scores, keep).where(~_blank(F.col("raw")))
    raw, kind = F.col("raw"), F.col("kind")
    is_note, is_meta = kind == "note", kind == "meta"
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    # what follows the pitches: a letter and dots
    by_pattern = F.regexp_extract(raw, rf"^`{{0,2}}(?:{_PITCH})++({_LENGTH}\.{{0,3}})", 1)
    rows = rows.withColumn("_length", F.when(is_note, F.when(_plain(raw) | _sharp(raw), F.right(raw, F.lit(1))).otherwise(by_pattern)).when(kind == "rest", F.expr("substring(raw, 2)")))
    dots = F.length("_length") - 1
    grace = F.when(is_note & raw.startswith("``"), "acciaccatura").when(is_note & raw.startswith("`"), "grace")
    own = F.when(is_meta, inner)
    label_rest = F.regexp_replace(own, r"^(\d+|P)", "")
    values = {
        "units": dotted(units_of(F.left("_length", F.lit(1)), F.col("div")), dots).cast("int"),
        "dots": dots.cast("int"),
        "pitches": F.when(is_note, pitches(raw)),
        "marks": F.when(is_note, F.transform(_suffixes(raw), lambda s: lookup(SUFFIXES, s))),
        "head": F.when(is_note & raw.contains("!"), lookup(HEADS, F.regexp_extract(raw, rf"(![dx/t]){_LENGTH}", 1))),
        "grace": grace,
        "slur_start": F.when(is_note, grace.isNull() & F.left(raw, F.lit(1)).between("a", "g")),
        "barline": F.when(kind == "measureBarrier", lookup(BARRIERS, raw)),
        "repeat_count": F.when(kind == "repeatBoundary", F.substring(raw, 2, 20).try_cast("int")),
        "tuplet_units": F.when(kind == "tupletOpen", F.regexp_extract(raw, r"^([0-9]+)", 1).try_cast("int")),
        "lyric": F.when(kind == "lyric", F.when((F.length(raw) > 1) & raw.startswith("'"), F.expr("substring(raw, 2)")).otherwise(raw)),
        "meta": F.get(F.transform(F.when(is_meta, F.array(inner)), meta), F.lit(0)),
    }
    out = rows.withColumns(values).withColumns({"meta_type": F.col("meta.type"), "meta_value": F.col("meta.value")})
    switch = F.col("meta_type") == "partSwitch"
    clef_text = F.when(F.col("meta_type") == "clefChange", F.trim(own)).when(switch, F.trim(F.regexp_extract(label_rest, r"^([^:]*)", 1)))
    return out.withColumns(
        {
            "part_label": F.when(switch, F.col("meta_value")),
            "instrument": F.when(switch & label_rest.contains(":"), F.regexp_extract(label_rest, r"^[^:]*:([\s\S]*)$", 1)),
            "clef": lookup(BARE_CLEFS, F.upper(clef_text)),
            "error": F.when(F.col("meta_type") == "error", F.concat(F.lit("unknown meta command "), raw)).when(kind.isin("unclosedComment", "unclosedMeta"), kind),
        }
    ).select("score_id", F.col("piece").alias("tok_idx"), "kind", "raw", "offset", *ATTRIBUTES, *keep)


def notes_of(tokens_: DataFrame) -> DataFrame:
    """A row for each pitch of each note: the columns of the token and abs_semitone.

    Pitches are read again from the piece, which is short, so that plans don't carry them through their sorts.
    """
    rows = tokens_.where("kind = 'note'").withColumn("_p", F.explode(_pitch_texts(F.col("raw"))))
    return rows.withColumn("abs_semitone", absolute(*_pitch(F.col("_p"))).cast("long")).drop("_p")


def line_column(source: Column, offset: Column) -> Column:
    """struct(line, column), both from 1, of a character offset."""
    before = F.split(F.substring(source, F.lit(1), offset), "\n")
    return F.struct(F.size(before).alias("line"), (F.length(F.element_at(before, -1)) + 1).alias("column"))


def snippet(source: Column, offset: Column) -> Column:
    """The line of an offset, and a caret under its place."""
    at = line_column(source, offset)
    line = F.get(F.split(source, "\n"), at["line"] - 1)
    return F.concat(line, F.lit("\n"), F.repeat(F.lit(" "), at["column"] - 1), F.lit("^"))


def part_meta(label: Column, instrument: Column) -> Column:
    """struct(part_id, display_name, midi_program) of a part label."""
    number = label.rlike(r"^\d+$")
    part_id = F.when(label == "P", "P_VP").when(number, F.concat(F.lit("P_V"), label)).otherwise(F.concat(F.lit("P_"), label))
    default = F.when(label == "P", "Voice Percussion").when(label == "M", "Voice").when(number, F.concat(F.lit("Voice "), label)).otherwise(label)
    name = F.when(label.isin("P", "M"), default).otherwise(F.coalesce(F.nullif(instrument, F.lit("")), default))
    return F.struct(part_id.alias("part_id"), name.alias("display_name"), F.lit(53).alias("midi_program"))
