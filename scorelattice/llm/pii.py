"""Personal data, plain and disguised, with offsets into the source text.

Base spans follow four fixed patterns. The method adds spans of disguised identifiers: a chain of
transducers rewrites homoglyphs (full-width and look-alike letters and digits), spelled digits
("five five oh one") and at/dot disguises ("name [at] host (dot) org") into plain characters, each
carrying the source offsets that it stands for; the same detectors run over the rewritten text, and
what they find is mapped back to source characters.

Offsets are code points, the end is exclusive. Edge cases: a null or empty text has no span and the
digest of the empty string; a text is scanned whole and in time linear in its length; repeated rows
are scanned each; other columns are ignored by detect() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelattice.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
# The base patterns, here anchored where their first characters can be.
_LOCAL_BREAK = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Look-alikes: full-width forms, mathematical monospace, circled and super/subscript digits, and letters of other scripts.
GLYPHS: dict[str, str] = {}
GLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
GLYPHS |= {chr(0x1D670 + i): c for i, c in enumerate(_LETTERS.upper() + _LETTERS)}
GLYPHS |= {chr(0x1D7CE + 10 * k + i): str(i) for k in range(5) for i in range(10)}
GLYPHS |= {chr(0x2460 + i): str(i + 1) for i in range(9)} | {"⓪": "0"}
GLYPHS |= {chr(0x2080 + i): str(i) for i in range(10)} | {chr(0x2074 + i): str(i + 4) for i in range(6)} | {"⁰": "0"}
GLYPHS |= {chr(0x0660 + i): str(i) for i in range(10)} | {chr(0x06F0 + i): str(i) for i in range(10)} | {chr(0x0966 + i): str(i) for i in range(10)}
GLYPHS |= dict(zip("аеорсухіјѕοαν", "aeopcyxijsoav", strict=True))
GLYPHS |= {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
# Capitals and further small letters of other scripts that look like Latin ones.
GLYPHS |= dict(zip("АВЕКМНОРСТУХЅІЈԌԚԜҮ", "ABEKMHOPCTYXSIJGQWY", strict=True))
GLYPHS |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj", strict=True))
GLYPHS |= dict(zip("кмтһӏԁԛԝѵɡɑıικρτυχγεηωσϲօոսհցք", "kmthldqwvgaiikptuxyenwoconuhgp", strict=True))


#: All of Unicode that isn't Han, Hangul, surrogates, private or unassigned.
_BLOCKS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xD7B0, 0xD800), range(0xF900, 0x17000), range(0x1B000, 0x20000), range(0xE0000, 0xE0200))


def _plain(c: str) -> str | None:
    """The one visible ASCII character, digit, space or nothing that a character of Unicode stands for."""
    kind = unicodedata.category(c)
    if kind == "Cf" and "NUMBER" not in (name := unicodedata.name(c, "")) and "AYAH" not in name or 0xFE00 <= ord(c) <= 0xFE0F or ord(c) in (0x034F, 0x115F, 0x1160, 0x3164):
        return ""  # zero width
    if kind == "Zs":
        return " "
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c) else ""
    return folded if len(folded) == 1 and "!" <= folded <= "~" else None


def _class(chars: list[str]) -> str:
    """A character class by ranges: as single characters, those beyond 16 bits would be tried one by one."""
    runs: list[list[int]] = []
    for at in sorted(map(ord, chars)):
        if runs and runs[-1][1] == at - 1:
            runs[-1][1] = at
        else:
            runs.append([at, at])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]"


GLYPHS = {c: by for part in _BLOCKS for c in map(chr, part) if (by := _plain(c)) is not None} | GLYPHS
GLYPHS = {c: by for c, by in GLYPHS.items() if not c.isascii()}
_GLYPH = re.compile(_class(list(GLYPHS)))
# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
_FIGURE = rf"(?:{_DIGIT}(?![A-Za-z0-9])|[0-9]++(?![A-Za-z]))"
_GAP = r"[\x20,.()-]{1,3}"
#: Spelled digits and figures in a row; taken at four spelled ones, or at any beside figures or a plus.
_SPELLED = re.compile(rf"(?ai)(?<![A-Za-z0-9])(?:(?P<plus>\+\x20?|plus[\x20-]+)\(?)?{_FIGURE}(?:{_GAP}{_FIGURE})*+")
_SPELLED_WORD = re.compile(rf"(?ai)plus[\x20-]+|{_DIGIT}(?![A-Za-z0-9])(?:[\x20,-]{{1,2}}(?={_DIGIT}(?![A-Za-z0-9])))?")
_OPEN, _CLOSE = r"[\[({<]\x20?", r"\x20?[\])}>]"
_AT = re.compile(rf"(?ai)\x20?{_OPEN}(?:at|@|arroba){_CLOSE}\x20?")
_DOT = re.compile(rf"(?ai)\x20?{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}\x20?")
#: Bare words only stand for marks where the whole has the shape of an address with a usual ending (fixed values):
#: any country's two letters, or a common longer one.
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|store|tech|cloud|blog|email|mail|agency|arpa|coop|museum|jobs|mobi|tel|travel|example|test|invalid|localhost|local"
_ENDS += "|" + "|".join(
    f"{first}[{second}]"
    for first, second in zip(
        "abcdefghijklmnopqrstuvwyz",
        "cdefgilmoqrstuwxz abdefghijmnorstvwyz acdfghiklmnoruvwxyz ejkmoz cegrstu ijkmor abdefghilmnpqrstuwy kmnrtu delmnoqrst emop eghimnprwyz abcikrstuvy acdeghklmnopqrstuvwxyz acefgilopruz m aefghklmnrstwy a eosuw abcdeghijklmnorstvxyz cdfghjklmnortvwz agksyz aceginu fs et amw".split(),
        strict=True,
    )
)
_LOCAL = r"[A-Za-z0-9._%+-]++"
_BARE = re.compile(rf"(?ai)(?<![A-Za-z0-9._%+-])(?P<local>{_LOCAL}(?:\x20dot\x20{_LOCAL}){{0,3}}?)(?P<at>@|\x20{{1,2}}at\x20{{1,2}})(?P<host>(?P<first>[A-Za-z0-9-]++)(?:(?:\.|\x20{{1,2}}dot\x20{{1,2}})[A-Za-z0-9-]++)*?(?:\.|\x20{{1,2}}dot\x20{{1,2}})(?P<end>{_ENDS}))(?![A-Za-z0-9-])(?!\.[A-Za-z0-9])")
_BARE_DOT = re.compile(r"(?ai)\x20{1,2}dot\x20{1,2}")
#: Endings that are words, after words that no host is called: "look at the dot in the middle".
_WORDS = {"as", "at", "be", "by", "do", "in", "is", "it", "me", "my", "no", "so", "to", "us", "am", "re", "name", "local", "site", "online", "test", "store", "shop", "mail"}
_NO_HOST = {"a", "an", "the", "this", "that", "each", "every", "one", "any", "some", "no", "my", "your", "his", "her", "its", "our", "their"}
#: Words before "at" and a written-out host that name no mailbox: "available at example.com".
_NO_LOCAL = {"a", "all", "also", "and", "are", "article", "articles", "available", "be", "blog", "book", "books", "buy", "code", "docs", "documentation", "download", "downloaded", "edition", "everyone", "file", "files", "find", "found", "free", "here", "home", "hosted", "information", "is", "it", "join", "live", "listed", "located", "look", "looking", "me", "more", "now", "online", "only", "or", "order", "out", "page", "pages", "people", "post", "posted", "posts", "published", "read", "register", "released", "see", "seen", "shop", "sign", "site", "sold", "start", "store", "tickets", "team", "that", "them", "there", "this", "those", "today", "up", "us", "version", "video", "videos", "visit", "was", "watch", "we", "website", "were", "work", "works", "working", "you"}
_DISGUISE = re.compile(
    rf"(?ai){_OPEN}(?:at|@|arroba|dot|punkt|point|punto|\.){_CLOSE}|\x20dot\x20|\x20at\x20{{1,2}}[A-Za-z0-9-]++\.[A-Za-z]"
    rf"|(?<![A-Za-z0-9]){_DIGIT}(?:{_GAP}[0-9]|[\x20,.-]{{1,2}}{_DIGIT}(?![A-Za-z]))|(?:[0-9]{_GAP}|\+\x20?\(?|(?<![A-Za-z])plus[\x20-]+){_DIGIT}(?![A-Za-z])"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of the address pattern, found from their @ signs, so that no run is scanned twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _LOCAL_BREAK.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        elif start < at:
            done = max(done, at)  # a later address can't reach over this sign
        at = text.find("@", max(done, at + 1))


def detect_kinds(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four kinds in one text as it stands."""
    out: dict[str, list[tuple[int, int]]] = {"email": list(emails(text)) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out["card"] = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in text else []
    return out


class Mapped:
    """A rewritten text in which every character knows the source span that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, None, None

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replaces spans, in order and without overlap, by other characters."""
        if not spans:
            return
        starts = list(range(len(self.text))) if self.starts is None else self.starts
        ends = list(range(1, len(self.text) + 1)) if self.ends is None else self.ends
        parts, new_starts, new_ends, at = [], [], [], 0
        for s, e, by in spans:
            parts += [self.text[at:s], by]
            new_starts += starts[at:s] + [starts[s]] * len(by)
            new_ends += ends[at:s] + [ends[e - 1]] * len(by)
            at = e
        parts.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(parts), new_starts + starts[at:], new_ends + ends[at:]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _SPELLED.finditer(text):
        words = [m for m in _SPELLED_WORD.finditer(text, run.start(), run.end())]
        spelled = sum(w[0][0] not in "pP" for w in words)
        if not spelled or not (spelled >= 4 or run["plus"] or any("0" <= c <= "9" for c in run[0])):
            continue
        for word in words:
            key = word[0].strip(" ,-").lower()
            out.append((word.start(), word.end(), "+" if key == "plus" else DIGITS[key]))
    return out


def _marks(text: str) -> list[tuple[int, int, str]]:
    """Marks in brackets."""
    out = sorted([(m.start(), m.end(), "@") for m in _AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(text)])
    return [x for k, x in enumerate(out) if not k or out[k - 1][1] <= x[0]]


def _bare_marks(text: str) -> list[tuple[int, int, str]]:
    """Marks that are words, in what has one such mark at least; the other marks may be plain or were in brackets."""
    out: list[tuple[int, int, str]] = []
    for m in _BARE.finditer(text):
        dots = [d.span() for d in _BARE_DOT.finditer(text, m.start("local"), m.end("local"))], [d.span() for d in _BARE_DOT.finditer(text, m.start("host"), m.end("host"))]
        if m["end"].lower() in _WORDS and m["first"].lower() in _NO_HOST and m["at"] != "@":
            continue
        if not dots[1] and m["at"] != "@" and (m["local"].lower() in _NO_LOCAL or m["first"].lower() == "www"):
            continue
        out += [(s, e, ".") for s, e in dots[0]]
        if m["at"] != "@":
            out.append((*m.span("at"), "@"))
        out += [(s, e, ".") for s, e in dots[1]]
    return out


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, added spans) by kind; an added span lies in no base span of its kind, but may reach beyond one."""
    text = text or ""
    base, added = detect_kinds(text), {k: [] for k in KINDS}
    glyphs = not text.isascii() and _GLYPH.search(text)
    if not glyphs and not _DISGUISE.search(text):
        return base, added
    plain = Mapped(text)
    if glyphs:
        plain.rewrite([(m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(text)])
    plain.rewrite(_spelled(plain.text))
    plain.rewrite(_marks(plain.text))
    if _BARE_DOT.search(plain.text) or " at " in plain.text.lower():
        plain.rewrite(_bare_marks(plain.text))
    if plain.starts is None:
        return base, added
    for kind, spans in detect_kinds(plain.text).items():
        # both in the order of the text and each without overlap: one pass
        k, own = 0, base[kind]
        for span in spans:
            s, e = plain.source(*span)
            while k < len(own) and own[k][1] < e:
                k += 1
            if k == len(own) or own[k][0] > s:
                added[kind].append((s, e))
    return base, added


def _line(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row; counts are of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b, _ in found], pa.string())
            lines = pa.array([_line({k: b[k] + a[k] for k in KINDS}) for b, a in found], pa.string())
            added = pa.array([sum(map(len, a.values())) for _, a in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, lines, added], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the longest one's kind."""
    if not text:
        return text
    base, added = find(text)
    spans = sorted((s, e, k) for found in (base, added) for k in KINDS for s, e in found[k])
    if not spans:
        return text
    unions: list[tuple[int, int, int, str]] = []  # start, end, length of the longest span and its kind
    for s, e, kind in spans:
        if unions and s < unions[-1][1]:
            start, end, longest, named = unions[-1]
            unions[-1] = (start, max(end, e), *((e - s, kind) if e - s > longest else (longest, named)))
        else:
            unions.append((s, e, e - s, kind))
    out, at = [], 0
    for s, e, _, kind in unions:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars (where there is one) brought up to date."""
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t.as_py()) for t in batch.column(at)]
            cols = list(batch.columns)
            if sized is not None:
                kind = cols[sized].type
                cols[sized] = pa.array([old if new == t else len(new) for old, new, t in zip(cols[sized].to_pylist(), texts, batch.column(at).to_pylist(), strict=True)], kind)
            cols[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return map_batches(docs, run, docs.schema)
