"""Played tokens to MusicXML 3.1 partwise documents.

Spark lexes, plays out repeats, attaches ties and lyrics, transposes and deals tokens out by score; one
fold along a score's parts pours them into measures and writes the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import floor, gcd, lcm
from typing import NamedTuple
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelattice.functions.pitch import FLAT_NAMES, FLATS, NAMES, SHARPS, STEPS, transposed_key
from scorelattice.operators import folds, lexing, parsing

# Fixed values of the format.
TYPES = {1: "64th", 2: "32nd", 4: "16th", 8: "eighth", 16: "quarter", 32: "half", 64: "whole", 128: "breve"}
ACCIDENTALS = {2: "double-sharp", 1: "sharp", 0: "natural", -1: "flat", -2: "flat-flat"}
CLEF_SIGNS = {"TREBLE": ("G", 2, 0), "TREBLE_8VA": ("G", 2, 1), "TREBLE_8VB": ("G", 2, -1), "BASS": ("F", 4, 0), "ALTO": ("C", 3, 0), "TENOR": ("C", 4, 0), "SOPRANO": ("C", 1, 0), "BARITONE": ("F", 3, 0), "PERCUSSION": ("percussion", 2, 0)}
BAR_STYLES = {"single": "regular", "double": "light-light", "final": "light-heavy", "repeatStart": "heavy-light", "repeatEnd": "light-heavy", "dashed": "dashed", "invisible": "none"}
ARTICULATIONS = {"staccato": "staccato", "staccatissimo": "staccatissimo", "accent": "accent", "tenuto": "tenuto", "marcato": 'strong-accent type="up"', "fall": "falloff", "doit": "doit", "plop": "plop", "scoop": "scoop"}
ORNAMENTS = {"trill": "trill-mark", "mordent": "mordent", "invertedMordent": "inverted-mordent", "turn": "turn", "invertedTurn": "inverted-turn"}
TECHNICAL = {"upBow": "<up-bow/>", "downBow": "<down-bow/>", "harmonic": "<harmonic><natural/></harmonic>", "snapPizz": "<snap-pizzicato/>", "stopped": "<stopped/>", "bend": "<bend><bend-alter>1</bend-alter></bend>"}
JUMPS = {"DC": "D.C.", "DC.fine": "D.C. al Fine", "DC.coda": "D.C. al Coda", "DS": "D.S.", "DS.fine": "D.S. al Fine", "DS.coda": "D.S. al Coda"}
KINDS = (("maj7", "major-seventh"), ("ma7", "major-seventh"), ("δ", "major-seventh"), ("maj9", "major-ninth"), ("maj", "major"), ("m7b5", "half-diminished"), ("m7(b5)", "half-diminished"), ("ø", "half-diminished"), ("min7", "minor-seventh"), ("m7", "minor-seventh"), ("min9", "minor-ninth"), ("m9", "minor-ninth"), ("min", "minor"), ("m", "minor"), ("dim7", "diminished-seventh"), ("°7", "diminished-seventh"), ("dim", "diminished"), ("°", "diminished"), ("aug7", "augmented-seventh"), ("+7", "augmented-seventh"), ("aug", "augmented"), ("+", "augmented"), ("sus2", "suspended-second"), ("sus", "suspended-fourth"), ("9", "dominant-ninth"), ("13", "dominant-13th"), ("11", "dominant-11th"), ("7", "dominant"), ("6", "major-sixth"))
MIDI_PROGRAM = 53
#: Commands that stay where they stand in a measure.
INLINE = ("tempo", "tempoText", "dynamics", "segno", "coda", "jump", "fine", "tocoda", "rehearsal", "text", "expression", "breath", "caesura", "ottava", "pedal", "chord", "measureRepeat", "clefChange", "key")


def _el(tag: str, *inside: object, **attributes: object) -> str:
    """One element; empty ones are closed at once."""
    head = tag + "".join(f' {k.replace("_", "-")}="{v}"' for k, v in attributes.items())
    body = "".join(map(str, inside))
    return f"<{head}>{body}</{tag}>" if body else f"<{head}/>"


def _text(value: str) -> str:
    return escape(value, {'"': "&quot;", "'": "&apos;"})


def _half_up(x: float) -> int:
    return floor(x + 0.5)


@lru_cache(maxsize=4096)
def note_type(units: float, div: int) -> str:
    """The written value of undotted units; between two values, the shorter."""
    n = _half_up(_half_up(units) * 64 / div)
    return TYPES[max((k for k in TYPES if k <= n), default=1)]


def chord_kind(rest: str) -> str:
    own = rest.split("/")[0].lower()
    return next((kind for prefix, kind in KINDS if own.startswith(prefix)), "major")


def _clef(name: str) -> str:
    sign, line, octave = CLEF_SIGNS[name]
    return _el("clef", _el("sign", sign), _el("line", line), _el("clef-octave-change", octave) if octave else "")


def _direction(*inside: str, sound: str = "", place: str | None = "above") -> str:
    return _el("direction", _el("direction-type", *inside), f"<sound {sound}/>" if sound else "", **({"placement": place} if place else {}))


@lru_cache(maxsize=1024)
def key_alter(step: str, fifths: int) -> int:
    if fifths > 0:
        return int(SHARPS.index(step) < fifths)
    return -int(FLATS.index(step) < -fifths)


@lru_cache(maxsize=4096)
def command(kind: str, value: str, clef: str | None, own: str) -> str:
    """A command that stands in a measure, as a direction or attributes."""
    words = lambda t, **a: _el("words", _text(t), **a)
    if kind == "tempo":
        bpm = float(value)
        shown = int(bpm) if bpm == int(bpm) else bpm
        return _direction(_el("metronome", _el("beat-unit", "quarter"), _el("per-minute", shown)), sound=f'tempo="{shown}"')
    if kind == "dynamics":
        wedge = {"<": "crescendo", ">": "diminuendo", "/": "stop"}.get(value)
        return _direction(_el("wedge", type=wedge) if wedge else _el("dynamics", _el(value)), place="below")
    if kind in ("segno", "coda"):
        return _direction(_el(kind), sound=f'{kind}="{kind}"')
    if kind in ("fine", "tocoda"):
        return _direction(words("Fine" if kind == "fine" else "To Coda", font_weight="bold"), sound='fine="yes"' if kind == "fine" else 'tocoda="coda"')
    if kind == "jump":
        return _direction(words(JUMPS[value], font_weight="bold"), sound='dacapo="yes"' if value.startswith("DC") else 'dalsegno="segno"')
    if kind == "tempoText":
        return _direction(words(value, font_weight="bold"))
    if kind == "rehearsal":
        return _direction(_el("rehearsal", _text(value)))
    if kind == "text":
        return _direction(words(value))
    if kind == "expression":
        return _direction(words(value, font_style="italic"), place="below")
    if kind == "ottava":
        size, up = (15 if value.startswith("15") else 8), "a" in value.rstrip("/")[-1:]
        shift = {"type": "stop"} if value.endswith("/") else {"type": "up" if up else "down", "size": size}
        return _direction(_el("octave-shift", **shift), place=None)
    if kind == "pedal":
        return _direction(_el("pedal", type="stop" if value.endswith("/") else "start"), place="below")
    if kind == "chord" and value:
        sign = {"#": 1, "b": -1}.get(value[1:2], 0) if value[1:3] != "ba" else 0
        root = _el("root", _el("root-step", value[0]), _el("root-alter", sign) if sign else "")
        return _el("harmony", root, _el("kind", chord_kind(value[1 + abs(sign) :]), text=_text(value)))
    if kind == "measureRepeat":
        return _el("attributes", _el("measure-style", _el("measure-repeat", 1, type="start")))
    if kind == "clefChange" and clef:
        return _el("attributes", _clef(clef))
    if kind == "key":
        return _el("attributes", _el("key", _el("fifths", own)))
    return ""


def key_fifths(value: str) -> int:
    """Fifths of a key command's value: a number or a name."""
    if value.lstrip("-").isdigit():
        return int(value)
    base = {"C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F": -1}[value[0].upper()]
    return base + {"#": 7, "b": -7}.get(value[1:2], 0) - (3 if value[1:].lstrip("#b") in ("m", "min") else 0)


# What is written of a note depends on little, and the same notes come again and again: it is kept. What came before
# a note in its measure and its key are told by `by_key` and `shown`.


def _changes(member: tuple[int, int, int, int] | None) -> tuple[str, str]:
    """The time modification and the edges of a tuplet's member."""
    if not member:
        return "", ""
    change = _el("time-modification", _el("actual-notes", member[1]), _el("normal-notes", member[3]))
    return change, (_el("tuplet", type="start", number=1) if member[0] == 0 else "") + (_el("tuplet", type="stop", number=1) if member[0] == member[1] - 1 else "")


def _breath_mark(breath: str | None) -> str:
    return "" if not breath else "<breath-mark/>" if breath == "breath" else "<caesura/>"


@lru_cache(maxsize=4096)
def _rest_xml(length: int, value: str, dots: int, member: tuple[int, int, int, int] | None, breath: str | None) -> str:
    change, edges = _changes(member)
    inner = edges + (_el("articulations", _breath_mark(breath)) if breath else "")
    return _el("note", "<rest/>", _el("duration", length), _el("voice", 1), _el("type", value) + "<dot/>" * dots, change, _el("notations", inner) if inner else "")


@lru_cache(maxsize=1 << 16)
def _note_xml(pitches: tuple, by_key: tuple, shown: tuple, told: str, head: str | None, grace_kind: str | None, slur_start: bool, sung: str | None, length: int, value: str, dots: int, member: tuple[int, int, int, int] | None, stop: bool, start: bool, breath: str | None) -> str:
    marks = set(told.split())
    change, edges = _changes(member)
    tail = _el("type", value) + "<dot/>" * dots
    out = []
    for k, (step, octave, alter) in enumerate(pitches):
        pitch = _el("pitch", _el("step", step), _el("alter", alter) if alter or by_key[k] else "", _el("octave", octave))
        first = k == 0
        notations = ('<tied type="stop"/>' if stop else "") + ('<tied type="start"/>' if start else "")
        if first:
            notations += ('<slur type="start" number="1"/>' if slur_start else "") + ('<slur type="stop" number="1"/>' if "slurEnd" in marks else "") + edges
            for mark, shape in (("fermata", ""), ("fermataShort", ' shape="angled"'), ("fermataLong", ' shape="square"')):
                notations += f'<fermata type="upright"{shape}/>' if mark in marks else ""
            joints = "".join(f"<{v}/>" for m, v in ARTICULATIONS.items() if m in marks) + _breath_mark(breath)
            shakes = "".join(f"<{v}/>" for m, v in ORNAMENTS.items() if m in marks)
            shakes += "".join(f'<tremolo type="single">{n}</tremolo>' for n in (1, 2, 3) if f"tremolo{n}" in marks) + ('<wavy-line type="start"/>' if "vibrato" in marks else "")
            hands = "".join(v for m, v in TECHNICAL.items() if m in marks)
            notations += "".join(_el(t, x) for t, x in (("articulations", joints), ("ornaments", shakes), ("technical", hands)) if x)
            notations += ("<arpeggiate/>" if "arpeggio" in marks else "") + ('<glissando line-type="wavy" type="start">gliss.</glissando>' if "glissando" in marks else "")
        grace = "" if not grace_kind else '<grace slash="yes"/>' if grace_kind == "acciaccatura" else "<grace/>"
        ties = ('<tie type="stop"/>' if stop else "") + ('<tie type="start"/>' if start else "")
        lyric = _el("lyric", _el("syllabic", "single"), _el("text", _text(sung)), number=1) if first and sung else ""
        out.append(_el("note", grace, "" if first else "<chord/>", pitch, "" if grace_kind else _el("duration", length), ties, _el("voice", 1), tail, _el("notehead", head) if head else "", _el("accidental", ACCIDENTALS[alter]) if shown[k] else "", change, _el("notations", notations) if notations else "", lyric))
    return "".join(out)


@lru_cache(maxsize=4096)
def _fill(length: int, scale: int, div: int) -> str:
    """Rests for what a measure lacks: one if its value can be written, else powers of two."""
    rest = lambda length, value, dots: _el("note", "<rest/>", _el("duration", length), _el("voice", 1), _el("type", TYPES[value]), "<dot/>" * dots)
    n = _half_up(length / scale * 64 / div)
    for value in TYPES:
        for dots, factor in ((3, 1.875), (2, 1.75), (1, 1.5), (0, 1)):
            if _half_up(value * factor) == n:
                return rest(length, value, dots)
    out = ""
    for value in sorted(TYPES, reverse=True):
        while n >= value:
            out += rest(_half_up(value * div / 64 * scale), value, 0)
            n -= value
    return out


class _Writer:
    """The measures of one part."""

    def __init__(self, head, scale: int) -> None:
        self.div, self.scale, self.fifths = head.div, scale, head.new_fifths
        self.time = (head.time_num, head.time_den)
        self.upm = _half_up(head.time_num / head.time_den * head.div) * scale
        self.measures: list[dict] = []
        self.left: str | None = None
        self.breath: str | None = None
        self.memory: dict[tuple[str, int], int] = {}
        self.open(self.time)

    def open(self, time: tuple[int, int] | None = None) -> None:
        self.measures.append({"xml": [], "used": 0, "upm": self.upm, "left": self.left, "right": None, "volta": None, "volta_end": None, "time": time, "sounds": False, "any": False})
        self.left, self.memory = None, {}

    @property
    def now(self) -> dict:
        return self.measures[-1]

    def put(self, xml: str) -> None:
        self.now["xml"].append(xml)
        self.now["any"] = True

    def barrier(self, style: str) -> None:
        empty = not self.now["any"] and self.now["used"] == 0
        if style == "repeatStart":
            if empty:
                self.now["left"] = style
            else:
                self.left = style
                self.open()
            return
        target = self.measures[-2] if empty and len(self.measures) > 1 else self.now
        target["right"] = style
        if not empty:
            self.open()

    def meta(self, kind: str, value: str, clef: str | None) -> None:
        if kind in ("breath", "caesura"):
            self.breath, self.now["any"] = kind, True
        elif kind == "volta":
            self.now["volta"] = value
        elif kind == "voltaEnd":
            self.now["volta_end"] = value
        elif kind == "time":
            self.time = tuple(map(int, value.split("/")))
            self.upm = _half_up(self.time[0] / self.time[1] * self.div) * self.scale
            if self.now["sounds"]:
                self.open(self.time)
            else:
                self.now["upm"], self.now["time"] = self.upm, self.time
        elif kind in INLINE:
            if kind == "key":
                self.fifths = key_fifths(value)
            self.put(command(kind, value, clef, str(self.fifths)))

    def sound(self, tok, member: tuple[int, int, int, int] | None = None) -> None:
        """A note or rest; member: place, size, target and normal notes of its tuplet."""
        if tok.grace:
            self.put(self.written(tok, 0, tok.dots, None))
            return
        length = _half_up(member[2] * self.scale / member[1]) if member else tok.units * self.scale
        room = self.now["upm"] - self.now["used"]
        if length > room > 0 and length > self.now["upm"]:
            first = True
            while length > 0:
                piece = min(length, self.now["upm"] - self.now["used"])
                length -= piece
                self.add(self.written(tok, piece, 0, member, units=_half_up(piece / self.scale), tied=(not first, length > 0 or bool(tok.tie))), piece)
                first = False
            return
        if length > room and self.now["used"]:
            self.open()
        self.add(self.written(tok, length, tok.dots, member), length)

    def add(self, xml: str, length: int) -> None:
        self.put(xml)
        self.now["sounds"] = True
        self.now["used"] += length
        if self.now["used"] >= self.now["upm"]:
            self.open()

    def written(self, tok, length: int, dots: int, member, units: int | None = None, tied: tuple[bool, bool] | None = None) -> str:
        units = tok.units if units is None else units
        value = note_type(units / {0: 1, 1: 1.5, 2: 1.75, 3: 1.875}[dots], self.div) if units else "eighth"
        stop, start = tied if tied else (False, bool(tok.tie))
        breath, self.breath = self.breath, None
        if tok.kind == "rest":
            return _rest_xml(length, value, dots, member, breath)
        shown: list[bool] = []
        for step, octave, alter in tok.pitches:
            shown.append(alter != self.memory.get((step, octave), key_alter(step, self.fifths)))
            if shown[-1]:
                self.memory[(step, octave)] = alter
        by_key = tuple(key_alter(step, self.fifths) for step, _, _ in tok.pitches)
        return _note_xml(tok.pitches, by_key, tuple(shown), tok.marks, tok.head, tok.grace, tok.slur_start, tok.lyric, length, value, dots, member, stop, start, breath)

    def finished(self) -> list[dict]:
        while len(self.measures) > 1 and not self.now["any"] and not self.now["left"] and not self.now["right"]:
            self.measures.pop()
        for m in self.measures:
            m["fill"] = _fill(m["upm"] - m["used"], self.scale, self.div) if m["upm"] > m["used"] else ""
        return self.measures


def _barline(side: str, style: str | None, volta: str | None, volta_end: str | None) -> str:
    if style is None and volta is None and volta_end is None:
        return ""
    repeat = {"repeatStart": "forward", "repeatEnd": "backward"}.get(style or "")
    ending = _el("ending", number=volta, type="start") if volta else ""
    ending += _el("ending", number=volta_end, type="discontinue") if volta_end else ""
    return _el("barline", _el("bar-style", BAR_STYLES[style]) if style else "", ending, _el("repeat", direction=repeat) if repeat else "", location=side)


def _measures(part: list, scale: int) -> list[dict]:
    """The measures of one part: body, time, left, right."""
    writer, group, target = _Writer(part[0], scale), None, 0
    for tok in part:
        if tok.kind == "tupletOpen":
            group, target = [], tok.tuplet_units
        elif tok.kind == "tupletClose" and group is not None:
            normal = max(1, _half_up(target / (group[0].units or 1))) if group else 1
            for k, member in enumerate(group):
                writer.sound(member, (k, len(group), target, normal))
            group = None
        elif tok.kind in ("note", "rest"):
            if group is not None:
                group.append(tok)
            else:
                writer.sound(tok)
        elif tok.kind == "meta" and group is None:
            writer.meta(tok.meta_type, tok.meta_value, tok.clef)
        elif tok.kind == "measureBarrier" and group is None:
            writer.barrier(tok.barline)
    return writer.finished()


def _score_scale(parts: list[list]) -> int:
    """The smallest factor that makes every tuplet member of a score a whole number of units."""
    out = 1
    for part in parts:
        target, members = None, 0
        for tok in part:
            if tok.kind == "tupletOpen":
                target, members = tok.tuplet_units, 0
            elif tok.kind == "tupletClose" and target is not None:
                if members and target:
                    out = lcm(out, members // gcd(target, members))
                target = None
            elif target is not None and tok.kind in ("note", "rest"):
                members += 1
    return out


def _length(part: list) -> int:
    """Units that a part plays, its graces left out."""
    out, inside = 0, False
    for tok in part:
        if tok.kind == "tupletOpen":
            out, inside = out + (tok.tuplet_units or 0), True
        elif tok.kind == "tupletClose":
            inside = False
        elif tok.kind in ("note", "rest") and not inside and not tok.grace:
            out += tok.units or 0
    return out


def _padding(head, missing: int, upm: int) -> Iterator:
    """Whole-measure rests, each with a barrier, for what a part lacks."""
    for at in range(0, missing, upm):
        yield head._replace(kind="rest", units=min(upm, missing - at), dots=0, grace=None, tie=False, lyric=None, marks="", pitches=(), head=None, slur_start=False)
        yield head._replace(kind="measureBarrier", barline="single")


def _written(score: list) -> Iterator[tuple]:
    """(score_id, music_xml without its title, n_parts, n_measures) of a score's tokens, by part and in order."""
    first = score[0]
    parts = [list(own) for _, own in groupby(score, key=lambda t: t.part_idx)]
    scale, upm = _score_scale(parts), _half_up(first.time_num / first.time_den * first.div)
    longest = max(map(_length, parts))
    if len(parts) > 1 and upm > 0:
        full = -(-longest // upm) * upm
        parts = [[*p, *_padding(p[0], full - n, upm)] if (n := _length(p)) < full else p for p in parts]
    tempo = next((float(t.meta_value) for p in parts for t in p if t.meta_type == "tempo" and t.kind == "meta"), None)
    written = [_measures(p, scale) for p in parts]
    n_measures = max(map(len, written))
    entries, bodies = [], []
    for k, (part, measures) in enumerate(zip(parts, written, strict=True)):
        pid, name = part_meta(part[0].part, next((t.instrument for t in part if t.instrument is not None), None))
        xml = "".join(_measure(part[0], j, m, scale, measures, tempo if k == 0 else None) for j, m in enumerate(measures))
        whole = int(first.time_num * first.div * scale / first.time_den)
        rest = f'<note><rest measure="yes"/><duration>{whole}</duration><voice>1</voice></note>'
        xml += "".join(f'<measure number="{j + 1}">{rest}</measure>\n' for j in range(len(measures), n_measures))
        instrument = f"{pid}-I1"
        entries.append(_el("score-part", _el("part-name", _text(name)), _el("score-instrument", _el("instrument-name", _text(name)), id=instrument), _el("midi-instrument", _el("midi-channel", 1), _el("midi-program", MIDI_PROGRAM), id=instrument), id=pid))
        bodies.append(f'<part id="{pid}">\n{xml}</part>')
    yield first.score_id, "<part-list>" + "".join(entries) + "</part-list>\n" + "\n".join(bodies), len(parts), n_measures


def _measure(head, at: int, m: dict, scale: int, measures: list[dict], tempo: float | None) -> str:
    """One measure; the first has the attributes of its part, and in the first part the opening tempo."""
    if at == 0:
        shown = "" if tempo is None else f"{int(tempo) if tempo == int(tempo) else tempo}"
        opening = "" if tempo is None else command("tempo", shown, None, "")
        divisions = max(1, head.div // 4 * scale)
        start = _el("attributes", _el("divisions", divisions), _el("key", _el("fifths", head.new_fifths)), _el("time", _el("beats", head.time_num), _el("beat-type", head.time_den)), _clef(head.header_clef))
    else:
        opening = ""
        # the time before is looked up only where a measure names one
        changed = m["time"] and m["time"] != next((measures[j]["time"] for j in range(at - 1, -1, -1) if measures[j]["time"]), (head.time_num, head.time_den))
        start = _el("attributes", _el("time", _el("beats", m["time"][0]), _el("beat-type", m["time"][1]))) if changed else ""
    if m["any"]:
        body = "".join(m["xml"]) + m["fill"]
        if opening and opening in body:  # the opening tempo is written once
            body = body.replace(opening, "", 1)
    else:
        num, den = m["time"] or (head.time_num, head.time_den)
        length = num / den * head.div * scale
        body = _el("note", '<rest measure="yes"/>', _el("duration", int(length) if length == int(length) else length), _el("voice", 1))
    right = m["right"] if m["right"] != "single" else None
    return f'<measure number="{at + 1}">' + _barline("left", m["left"], m["volta"], None) + start + opening + body + _barline("right", right, None, m["volta_end"]) + "</measure>\n"


def part_meta(label: str, instrument: str | None) -> tuple[str, str]:
    """(id, displayed name) of a part label, as lexing.part_meta has them."""
    pid = "P_VP" if label == "P" else f"P_V{label}" if label.isdigit() else f"P_{label}"
    default = {"P": "Voice Percussion", "M": "Voice"}.get(label, f"Voice {label}" if label.isdigit() else label)
    return pid, default if label in ("P", "M") else instrument or default


#: What tokens keep for the fold, sealed into one text while they are sorted and joined; a value that may hold anything is last.
_SEALED = ("units", "dots", "tuplet_units", "head", "grace", "slur_start", "barline", "clef", "meta_type", "pitches", "marks", "meta_value")
_HEADER = ("time_num", "time_den", "div", "transpose", "new_fifths", "header_clef")
_SEAL = "\x1f"


def played_tokens(scores: DataFrame) -> DataFrame:
    """Tokens of scores as they are played, by part, with ties and lyrics; `told` is what else the fold reads, `header` its score's."""
    h = F.col("_h")
    values = (h["time_num"], h["time_den"], h["div"], h["transpose"], transposed_key(h["key_fifths"], h["transpose"]).cast("int"), h["clef"])
    headed = scores.select("score_id", "source", lexing.header(F.col("source")).alias("_h")).select("score_id", "source", F.concat_ws(_SEAL, *[v.cast("string") for v in values]).alias("header"))
    as_text = lambda p: F.concat_ws(" ", p["step"], p["octave"].cast("string"), p["alter"].cast("string"))
    texts = {"pitches": F.array_join(F.transform("pitches", as_text), ";"), "marks": F.array_join("marks", " ")}
    told = F.concat_ws(_SEAL, *[F.coalesce(texts.get(c, F.col(c)).cast("string"), F.lit("")) for c in _SEALED])
    tokens = lexing.tokens(headed, keep=("header",)).select("score_id", "tok_idx", "kind", "repeat_count", "tuplet_units", "lyric", "part_label", "instrument", "header", told.alias("told"))
    rows = parsing.flattened_repeats(parsing.attached(tokens))
    return parsing.merged_preamble(parsing.with_parts(rows, "play_idx"), "play_idx")


class _Token(NamedTuple):
    """A played token, unsealed."""

    score_id: int
    part_idx: int
    part: str
    instrument: str | None
    kind: str
    tie: bool
    lyric: str | None
    units: int | None
    dots: int | None
    tuplet_units: int | None
    head: str | None
    grace: str | None
    slur_start: bool
    barline: str | None
    clef: str | None
    meta_type: str | None
    pitches: tuple
    marks: str
    meta_value: str
    time_num: int
    time_den: int
    div: int
    new_fifths: int
    header_clef: str


@lru_cache(maxsize=1 << 16)
def _unsealed(told: str, header: str) -> tuple:
    """The fields of a token from `units` on: a score's tokens and those of others are mostly the same few."""
    time_num, time_den, div, semitones, new_fifths, header_clef = header.split(_SEAL)
    units, dots, tuplet_units, head, grace, slur_start, barline, clef, meta_type, pitches, marks, meta_value = told.split(_SEAL, len(_SEALED) - 1)
    number = lambda x: int(x) if x else None
    moved = tuple(_moved(p, int(semitones), int(new_fifths)) for p in pitches.split(";") if p)
    return (number(units), number(dots), number(tuplet_units), head or None, grace or None, slur_start == "true", barline or None, clef or None, meta_type or None, moved, marks, meta_value, int(time_num), int(time_den), int(div), int(new_fifths), header_clef)


def _moved(told: str, semitones: int, fifths: int) -> tuple[str, int, int]:
    """(step, octave, alter) of a pitch sent as `C 4 0`, transposed; a move by nothing keeps the spelling."""
    step, octave, alter = told.split(" ")
    if semitones == 0:
        return step, int(octave), int(alter)
    place = 12 * int(octave) + STEPS[step] + int(alter) + semitones
    name = (NAMES if fifths >= 0 else FLAT_NAMES)[place % 12]
    return name[0], place // 12, 0 if len(name) == 1 else 1 if fifths >= 0 else -1


def _unsealed_score(rows: list) -> Iterator[tuple]:
    return _written([_Token(r.score_id, r.part_idx, r.part, r.instrument, r.kind, r.tie, r.lyric, *_unsealed(r.told, r.header)) for r in rows])


_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE score-partwise PUBLIC "-//Recordare//DTD MusicXML 3.1 Partwise//EN" "http://www.musicxml.org/dtds/partwise.dtd">\n<score-partwise version="3.1">\n'


def documents(scores: DataFrame, title: Column | None = None, composer: Column | None = None, lyricist: Column | None = None) -> DataFrame:
    """score_id, music_xml, n_parts, n_measures of every score (score_id, source).

    A score's played tokens are written by one call, part by part: a score is a text of one row, so it fits a task.
    """
    rows = played_tokens(scores).select("score_id", "part_idx", "play_idx", "part", "instrument", "kind", "tie", "lyric", "told", "header")
    found = folds.by_key(rows, ["score_id"], ["part_idx", "play_idx"], _unsealed_score, "score_id long, body string, n_parts int, n_measures int")
    credit = F.lit("")
    if title is not None:
        credit = F.concat(credit, F.lit("<work><work-title>"), escaped(title), F.lit("</work-title></work>"))
    for kind, value in (("composer", composer), ("lyricist", lyricist)):
        if value is not None:
            credit = F.concat(credit, F.lit(f'<identification><creator type="{kind}">'), escaped(value), F.lit("</creator></identification>"))
    if title is not None or composer is not None or lyricist is not None:
        found = found.join(scores.select("score_id", credit.alias("_credit")), "score_id")
    else:
        found = found.withColumn("_credit", F.lit(""))
    return found.select("score_id", F.concat(F.lit(_HEAD), "_credit", "body", F.lit("\n</score-partwise>")).alias("music_xml"), "n_parts", "n_measures")


def escaped(value: Column) -> Column:
    """Escaped text, the ampersand first."""
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(code))
    return value
