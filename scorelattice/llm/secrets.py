"""Secret scans in DataFrame functions only.

Three fixed patterns give the base spans. The method adds `entropy` spans: candidate strings are
slid over by a window, and the Shannon entropy of the window is kept up to date from the counts of
its characters (one count goes up, one goes down, two terms of the sum change). Each character class
has its own alphabet and threshold. Allow-listed candidates (digests announced as checksums, UUIDs,
paths, plain words, repeated patterns) and candidates that overlap a base span are left out.

The work grows in proportion to a text: places are sums of lengths, taken within blocks and then over blocks;
assignments are blotted out before candidates are looked for, so that spans needn't be compared with
each other; a long candidate is slid over in pieces.

Offsets are code points, the end is exclusive. Edge cases: a null or empty text has no span, counts
0 and the digest of the empty string; repeated rows are scanned each; a text is scanned whole,
whatever its length; other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: A match of at least the length needs a run of at least the length; shorter runs can't match in part.
_ACCESS_RUN = r"AKIA[A-Z0-9]{16,}+"
_HEX_RUN = r"(?<![0-9a-f])[0-9a-f]{24,}+"

#: Candidates: runs of token characters with a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
#: Stands for the characters of an assignment; a text's own ones are read as the next.
BLOT, OTHER = "\uffff", "\ufffe"
#: Candidates that don't touch an assignment.
_FREE = CANDIDATE.replace("(?<![", f"(?<![{BLOT}", 1) + f"(?!{BLOT})"
WINDOW = 20
#: Matches whose places are summed in one go; characters that a window slides over in one go.
BLOCK, PIECE = 64, 4096
#: Character class, the characters it allows, and the least entropy of some window, in bits a character.
CLASSES = (("hex", "^[0-9a-fA-F]+$", 3.0), ("upper", "^[A-Z0-9]+$", 3.4), ("lower", "^[a-z0-9]+$", 3.4), ("token", "^[A-Za-z0-9+/_=-]+$", 3.7))
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUID
    r"^[/]?(?:[A-Za-z]+[0-9]{0,4}[/_-]+)++[A-Za-z]*[0-9]{0,4}$",  # words joined by path or name marks, with short numbers
    r"^[A-Za-z]+[0-9]{1,4}$",  # a word and a short number
    r"^[0-9]{1,4}[A-Za-z]+$",
    r"^(.{1,8}?)\1+.{0,8}$",  # one short pattern over and over
    # letters only: a word, or words with capitals between them, of vowels and not too many consonants in a row
    r"^(?=(?:[A-Z]?[a-z]++|[A-Z]++|[a-z]*+(?:[A-Z][a-z]++|[A-Z]{2,6}(?=[A-Z][a-z]))++)$)(?i:(?:[b-df-hj-np-tv-xz]{0,4}+[aeiouy]++)++[b-df-hj-np-tv-xz]{0,4}+)$",
    r"(?i)^(?:(?:md5|sha-?(?:1|224|256|384|512)|checksum|digest|fingerprint)[=_-](?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|sha-?(?:1|256|384|512)-[a-z0-9+/]{27,86}={0,2})$",  # a digest with its name
    r"(?i)(example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdef0123)",
)
#: A digest by its length, and what announces it as a checksum right before.
DIGEST = r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})$"
ANNOUNCED = r"""(?i)(?<![a-z0-9])(?:md5|sha-?(?:1|224|256|384|512)|checksum|digest|fingerprint)(?:sum)?["']?(?:\x20?\([^()]{0,40}\))?\x20?(?:is|of|[:=])?\x20?["']?$"""
ANNOUNCED_CHARS = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(gaps: Column, owns: Column) -> Column:
    """Array of (s, e) of matches, from the lengths between them and their own.

    Running sums within blocks of BLOCK matches, then over the blocks: an array that grows by one costs
    its length each time, so that it mustn't get long.
    """
    lengths = F.filter(F.zip_with(gaps, owns, lambda g, o: F.struct(g.alias("g"), o.alias("o"))), lambda x: x["o"].isNotNull())

    def within(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            return F.struct((s + x["o"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["o"]).alias("e")))).alias("out"))

        return F.aggregate(block, zero, step)

    def shifted(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begins, lambda x, at: F.transform(x["out"], lambda p: F.struct((p["s"] + at).alias("s"), (p["e"] + at).alias("e")))))

    def cut(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.greatest(F.size(n), F.lit(1)), F.lit(BLOCK)), lambda at: at <= F.size(n))

    return _let(lengths, lambda n: _let(F.transform(cut(n), lambda at: within(F.slice(n, at, BLOCK))), shifted))


def _located(text: Column, pattern: str, kind: str, value: int = 0, context: int = 0) -> Column:
    """Array of (kind, s, e, v, before) of a pattern's matches in code points.

    v is the group `value`. What lies between the matches comes from split(), so places are running sums
    of lengths. `before` holds up to `context` characters before a match: of the gap before it and, past
    that, of the match and the gap before.
    """
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value))

    def one(found: Column) -> Callable[[Column], Column]:
        def build(between: Column) -> Column:
            spans = _spans(F.transform(between, F.length), F.transform(found, F.length))
            values = part if value else found
            last = lambda xs, i: F.right(F.get(xs, i), F.lit(context))
            before = lambda i: F.right(F.concat(F.when(i > 0, F.concat(last(between, i - 1), last(found, i - 1))).otherwise(""), last(between, i)), F.lit(context)) if context else F.lit("")
            return _let(values, lambda v: F.transform(spans, lambda p, i: F.struct(F.lit(kind).alias("kind"), p["s"].alias("s"), p["e"].alias("e"), F.get(v, i).alias("v"), before(i).alias("before"))))

        return build

    return _let(whole, lambda found: _let(F.split(text, pattern), one(found)))


def _blotted(text: Column) -> Column:
    """The text, as long as it was, with BLOT in place of every assignment that is a base span."""
    whole, value = (F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(g)) for g in (0, 2))
    hidden = F.zip_with(whole, value, lambda w, v: F.when(F.length(v) >= LEAST_ASSIGN, F.repeat(F.lit(BLOT), F.length(w))).otherwise(w))
    return F.array_join(F.zip_with(F.split(text, ASSIGN), hidden, lambda gap, own: F.concat(gap, F.coalesce(own, F.lit("")))), "")


_NONE = "array<struct<kind:string,s:int,e:int,v:string,before:string>>"


def _where(text: Column, quick: Column, spans: Column) -> Column:
    """The spans, or none where a cheap test says so."""
    return F.when(quick, spans).otherwise(F.array().cast(_NONE))


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy of any `window` neighbouring characters of an ASCII string.

    The state holds the sum of n * log2(n) over the counts of the window's characters; the entropy is
    log2(window) - sum / window. A step moves two counts, that of the character that comes in and that of
    the one that goes out, and the sum by four terms. Long strings are slid over in pieces that overlap.
    """
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("low"))

    def slid(codes: Column) -> Column:
        def move(acc: Column, code: Column) -> Column:
            full = acc["i"] >= window
            out = F.when(full, F.get(codes, acc["i"] - window))
            old = F.slice(codes, F.greatest(acc["i"] - window, F.lit(0)) + 1, F.least(acc["i"], F.lit(window)))
            count = lambda c: F.size(F.filter(old, lambda x: x == c))
            comes = _let(count(code), lambda n: term(n + 1) - term(n))
            goes = F.when(full, _let(count(out), lambda n: term(n - 1) - term(n))).otherwise(F.lit(0.0))
            total = acc["sum"] + F.when(code.eqNullSafe(out), F.lit(0.0)).otherwise(comes + goes)
            return _let(total, lambda t: F.struct((acc["i"] + 1).alias("i"), t.alias("sum"), F.when(acc["i"] >= window - 1, F.least(acc["low"], t)).otherwise(acc["low"]).alias("low")))

        return F.aggregate(codes, zero, move, lambda acc: acc["low"])

    def lows(pieces: Column) -> Column:
        own = lambda p, i: F.concat(F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(window - 1))).otherwise(""), p)
        return F.array_min(F.transform(pieces, lambda p, i: _let(F.filter(F.transform(F.split(own(p, i), ""), lambda c: F.ascii(c)), lambda c: c > 0), slid)))

    low = _let(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lows)
    return _let(low, lambda x: F.when(x == float("inf"), F.lit(0.0)).otherwise(F.log2(F.lit(float(window))) - x / window))


def suspicious(value: Column) -> Column:
    """Whether a candidate is random enough for its character class and not allow-listed."""
    least = F.lit(99.0)
    for _, allowed, bits in reversed(CLASSES):
        least = F.when(value.rlike(allowed), F.lit(bits)).otherwise(least)
    listed = F.lit(False)
    for pattern in ALLOWED:
        listed = listed | value.rlike(pattern)
    # the entropy, which costs most, is only asked for where nothing cheaper decides
    return F.when(listed, F.lit(False)).otherwise(peak_entropy(value) >= least)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row."""
    t = F.col("_t")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    assigned = t.rlike(r"(?i)(?:word|passwd|secret|token|key)[\"']?\x20*[:=]")
    open_text = F.translate(t, BLOT, OTHER)
    rows = rows.select(
        "doc_id",
        _where(t, assigned, F.filter(_located(t, ASSIGN, "assign", 2), lambda x: F.length(x["v"]) >= LEAST_ASSIGN)).alias("_assign"),
        _where(t, t.contains("AKIA"), _located(t, _ACCESS_RUN, "access")).alias("_access"),
        _where(t, t.rlike(r"[0-9a-f]{24}"), _located(t, _HEX_RUN, "hex")).alias("_hex"),
        F.when(t.rlike(CANDIDATE), F.when(assigned, _blotted(open_text)).otherwise(open_text)).alias("_open"),
    )
    free = F.col("_open")
    rows = rows.select("doc_id", "_assign", "_access", "_hex", _where(free, F.coalesce(free.rlike(_FREE), F.lit(False)), _located(free, _FREE, "entropy", 0, ANNOUNCED_CHARS)).alias("_cand"))
    order = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.concat("_assign", "_access", "_hex")
    rows = rows.select("doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("_assign", "n_assign"), ("_access", "n_access"), ("_hex", "n_hex"))], base.alias("_base"), "_cand")
    # an access key or a hex run that lies over a candidate lies in it
    held = lambda c: c["v"].rlike(_ACCESS_RUN) | c["v"].rlike(_HEX_RUN)
    checksum = lambda c: F.when(c["v"].rlike(DIGEST), c["before"].rlike(ANNOUNCED)).otherwise(F.lit(False))
    added = F.filter("_cand", lambda c: F.when(held(c), F.lit(False)).when(checksum(c), F.lit(False)).otherwise(suspicious(c["v"])))
    rows = rows.select("doc_id", "n_assign", "n_access", "n_hex", "_base", F.when(F.size("_cand") > 0, added).otherwise(F.col("_cand")).alias("_added"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(line(order(F.col("_base"))).cast("binary"), 256).alias("base_sha256"), line(order(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_entropy"))
