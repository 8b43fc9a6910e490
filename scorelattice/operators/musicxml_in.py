"""MusicXML documents to notation text, with diagnostics.

A document is one row; documents are converted independently of each other. The tree is read once
into parts, measures and events; lengths, pitches and marks are then written by small tables.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame

from scorelattice.operators.musicxml_out import key_alter

# Marks by element, in the order they are written; clef, barline, chord and key names.
MARKS = (("staccato", "s"), ("staccatissimo", "S"), ("accent", ">"), ("tenuto", "-"), ("fermata", "~"), ("strong-accent", "^"), ("up-bow", "V"), ("down-bow", "W"), ("harmonic", "O"), ("snap-pizzicato", "X"), ("stopped", "T"), ("trill-mark", "tr"), ("mordent", "mr"), ("inverted-mordent", "MR"), ("turn", "tn"), ("inverted-turn", "TN"), ("tremolo", "z"), ("arpeggiate", "ar"), ("glissando", "gl"), ("wavy-line", "vb"), ("bend", "bn"), ("falloff", "jf"), ("doit", "jd"), ("plop", "jp"), ("scoop", "js"))
CLEF_NAMES = {"TREBLE": "T", "TREBLE_8VA": "T8", "TREBLE_8VB": "T-8", "BASS": "B", "ALTO": "A", "TENOR": "Te", "PERCUSSION": "Pe", "SOPRANO": "So", "BARITONE": "Br"}
BARS = {"light-light": ",,", "heavy-heavy": ",,", "light-heavy": ",,,", "heavy-light": ",:", "regular": ",", "dashed": ",-", "tick": ",-", "short": ",-", "none": ",."}
KIND_NAMES = {"major": "", "minor": "m", "augmented": "aug", "diminished": "dim", "dominant": "7", "major-seventh": "maj7", "minor-seventh": "m7", "diminished-seventh": "dim7", "augmented-seventh": "aug7", "half-diminished": "m7b5", "major-minor": "mMaj7", "major-sixth": "6", "minor-sixth": "m6", "dominant-ninth": "9", "major-ninth": "maj9", "minor-ninth": "m9", "dominant-11th": "11", "major-11th": "maj11", "minor-11th": "m11", "dominant-13th": "13", "major-13th": "maj13", "minor-13th": "m13", "suspended-second": "sus2", "suspended-fourth": "sus4", "power": "5"}
MAJOR_KEYS = ("Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#")
MINOR_KEYS = ("Abm", "Ebm", "Bbm", "Fm", "Cm", "Gm", "Dm", "Am", "Em", "Bm", "F#m", "C#m", "G#m", "D#m", "A#m")
TEMPO_WORDS = ("allegro", "andante", "adagio", "presto", "vivace", "moderato", "largo", "lento", "grave", "rit", "rall", "accel", "atempo", "a tempo")
LETTERS = "ghijklmn"
SIGNS = {2: "x", 1: "#", -1: "b", -2: "bb"}


def half_up(x: float) -> int:
    return floor(x + 0.5)


# --- lengths --------------------------------------------------------------


@lru_cache(maxsize=256)
def _lengths(div: int) -> tuple[dict[int, str], dict[int, str], tuple[tuple[int, str], ...]]:
    """(plain names by units, dotted names by units, all (units, name) from the longest)."""
    plain: dict[int, str] = {}
    dotted: dict[int, str] = {}
    every: list[tuple[int, str]] = []
    for k, letter in enumerate(LETTERS):
        base = half_up((1 << k) * div / 64)
        if base <= 0:
            plain.setdefault(base, letter)
            continue
        plain.setdefault(base, letter)
        for dots, factor in ((1, 1.5), (2, 1.75), (3, 1.875)):
            dotted.setdefault(half_up(base * factor), letter + "." * dots)
        every += [(half_up(base * f), letter + "." * d) for d, f in ((3, 1.875), (2, 1.75), (1, 1.5), (0, 1))]
    return plain, dotted, tuple(sorted(every, key=lambda x: -x[0]))


def chain(units: int, div: int) -> list[str]:
    """Lengths that add up to the units, greedily from the longest."""
    out = []
    for size, name in _lengths(div)[2]:
        if size > 0:
            out += [name] * (units // size)
            units %= size
    return out


@lru_cache(maxsize=4096)
def length_names(units: int, div: int, dots: int) -> list[str]:
    """One name if the length has one (dots as given, or found), else a chain."""
    plain, dotted, _ = _lengths(div)
    if dots:
        letter = plain.get(half_up(units / {1: 1.5, 2: 1.75}.get(dots, 1.875)))
        return [letter + "." * dots] if letter else chain(units, div)
    name = plain.get(units) or dotted.get(units)
    return [name] if name else chain(units, div)


def rest(units: int, div: int, dots: int = 0) -> str:
    return " ".join("R" + n for n in length_names(units, div, dots)) or ("Rk" + "." * dots)


# --- reading --------------------------------------------------------------


def _int(el: ET.Element | None, path: str) -> int | None:
    found = el.findtext(path) if el is not None else None
    return _number(found) if found else None


@lru_cache(maxsize=4096)
def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?\d+", text.strip()) else None


def _has(el: ET.Element, tag: str) -> bool:
    return next(el.iter(tag), None) is not None


def _typed(el: ET.Element, tag: str, kind: str) -> bool:
    return any(x.get("type") == kind for x in el.iter(tag))


def clef_name(attributes: ET.Element | None) -> str | None:
    sign = attributes.findtext(".//sign") if attributes is not None else None
    if not sign:
        return None
    line, octave = _int(attributes, ".//line"), _int(attributes, ".//clef-octave-change")
    by_sign = {"G": {1: "TREBLE_8VA", -1: "TREBLE_8VB"}.get(octave, "TREBLE"), "F": "BARITONE" if line == 3 else "BASS", "C": {1: "SOPRANO", 4: "TENOR"}.get(line, "ALTO"), "PERCUSSION": "PERCUSSION"}
    return by_sign.get(sign.strip().upper(), "TREBLE")


def key_name(fifths: int, mode: str | None) -> str:
    names, default = (MINOR_KEYS, "Am") if (mode or "").lower() == "minor" else (MAJOR_KEYS, "C")
    return names[fifths + 7] if -7 <= fifths <= 7 else default


@dataclass
class Head:
    """What the first attributes say."""

    time: tuple[int, int] = (4, 4)
    fifths: int = 0
    mode: str | None = None
    div: int = 32
    clef: str = "TREBLE"

    def text(self) -> str:
        parts = [f"CLEF:{self.clef}"] * (self.clef != "TREBLE") + [f"TIME:{self.time[0]}/{self.time[1]}"] * (self.time != (4, 4))
        parts += [f"KEY:{key_name(self.fifths, self.mode)}"] * (self.fifths != 0 or (self.mode or "").lower() == "minor") + [f"DIV:{self.div}"] * (self.div != 64)
        return f"[{' '.join(parts)}]" if parts else ""


@dataclass
class Part:
    pid: str
    measures: list[tuple[str, ET.Element]] = field(default_factory=list)

    @property
    def attributes(self) -> list[ET.Element]:
        return [a for _, m in self.measures for a in m.iter("attributes")]


def read_parts(xml: str) -> tuple[list[Part], dict[str, str]]:
    """Parts with their measures in order, of either document form, and the names that say something."""
    root = ET.fromstring(re.sub(r"(?s)<!DOCTYPE.*?>(?=\s*<)", "", xml, count=1))
    parts: dict[str, Part] = {}
    if root.tag == "score-timewise":
        for measure in root.findall("measure"):
            for p in measure.findall("part"):
                moved = ET.Element("measure", measure.attrib)
                moved.extend(list(p))
                parts.setdefault(p.get("id", ""), Part(p.get("id", ""))).measures.append(("", moved))
    else:
        for p in root.iter("part"):
            parts[f"{len(parts)}"] = Part(p.get("id", ""), [("", m) for m in p.findall("measure")])
    for part in parts.values():
        part.measures = list(_numbered(m for _, m in part.measures))
    names = {}
    for s in root.iter("score-part"):
        name = (s.findtext("part-name") or "").strip()
        if name and not re.fullmatch(r"(?i)(MusicXML|Music|Part)\s*\d*", name):
            names[s.get("id", "")] = name
    return list(parts.values()), names


def _numbered(measures: Iterator[ET.Element]) -> Iterator[tuple[str, ET.Element]]:
    """Measures with names: their numbers, n§k when a number comes again, rests over many measures spread out."""
    seen: dict[str, int] = {}

    def name(number: str) -> str:
        k = seen.get(number, 0)
        seen[number] = k + 1
        return f"{number}§{k}" if k else number

    for place, m in enumerate(measures, 1):
        number = m.get("number", str(place))
        yield name(number), m
        many = (_int(m, ".//multiple-rest") if _has(m, "multiple-rest") else None) or 1
        for k in range(1, many):
            try:
                base = float(number) + k
                own = str(int(base)) if base == int(base) else str(base)
            except ValueError:
                own = f"{number}+{k}"
            yield name(own), ET.Element("measure")


def number_key(name: str) -> tuple:
    base, _, suffix = name.partition("§")
    try:
        return 0, float(re.match(r"-?\d+(?:\.\d+)?", base)[0]), int(suffix or 0), name
    except TypeError:
        return 1, 0.0, 0, name


# --- converting -----------------------------------------------------------


def _pitch(note: ET.Element, fifths: int) -> tuple[str, int, int] | None:
    """(step, octave, alter); unpitched notes by their place on the staff."""
    if note.find("rest") is not None:
        return None
    pitch = note.find("pitch")
    step, octave = (pitch.findtext("step"), pitch.findtext("octave")) if pitch is not None else (None, None)
    if not step or not octave:
        pitch = None
        step, octave = note.findtext(".//step") or note.findtext(".//display-step"), note.findtext(".//octave") or note.findtext(".//display-octave")
    if not step or not octave:
        return None
    if _has(note, "unpitched"):
        return step, int(octave), 0
    alter = (pitch.findtext("alter") if pitch is not None else None) or note.findtext(".//alter")
    return step, int(octave), max(-2, min(2, half_up(float(alter)))) if alter else key_alter(step, fifths)


_MARK_TAGS = frozenset(tag for tag, _ in MARKS)
#: What a plain note holds: notes with nothing else are written from their pitch and length alone.
_PLAIN_TAGS = frozenset(("note", "chord", "pitch", "step", "alter", "octave", "duration", "voice", "type", "dot", "accidental", "stem", "beam", "rest"))


def _tags(el: ET.Element) -> set[str]:
    """The elements in one, itself included: looked through once, where each search would look again."""
    return {x.tag for x in el.iter()}


def _marks(note: ET.Element, tags: set[str]) -> str:
    out = ""
    if tags.isdisjoint(_MARK_TAGS):
        return out
    for tag, mark in MARKS:
        if tag not in tags:
            continue
        el = next(note.iter(tag))
        if tag == "fermata":
            mark += {"angled": "s", "square": "l"}.get((el.text or "").strip().lower(), "")
        elif tag == "tremolo":
            n = min(3, max(0, int(el.text or 0)))
            mark = f"z{n}" if n else ""
        elif tag == "wavy-line" and (not _typed(note, "wavy-line", "start") or _has(note, "trill-mark")):
            mark = ""
        out += mark
    return out


class _Converter:
    """One part: running time and key, and what is wrong."""

    def __init__(self, index: int, head: Head, div: int, diagnostics: list[dict]) -> None:
        self.index, self.div, self.key_fifths, self.diagnostics = index, div, head.fifths, diagnostics
        self.time, self.fifths = head.time, head.fifths

    def whole_rest(self) -> str:
        return rest(half_up(self.time[0] / self.time[1] * self.div), self.div)

    def measure(self, at: int, m: ET.Element) -> str:
        has_backup = m.find("backup") is not None
        notes, others = [], []
        time, fifths = self.time, self.fifths
        for place, el in enumerate(m):
            if el.tag == "note":
                notes.append((place, el))
                if not _has(el, "technical"):
                    continue
                for tag, sign in (("fingering", "F"), ("string", "S")):
                    value = el.findtext(f".//technical/{tag}")
                    if value:
                        others.append((place + 0.5, f"[{sign}:{value.strip()}]"))
            elif el.tag == "forward":
                voice, length = _int(el, "voice"), _int(el, "duration") or 0
                if length > 0 and (voice == 1 or (voice is None and not has_backup)):
                    silent = ET.fromstring(f"<note><rest/><duration>{length}</duration><voice>1</voice></note>")
                    notes.append((place, silent))
            elif el.tag == "direction":
                others += [(place, t) for t in direction(el)]
            elif el.tag == "attributes":
                if _typed(el, "measure-repeat", "start"):
                    others.append((-1, "[%]"))
                if at:
                    others += [(place, t) for t in self.changes(el)]
            elif el.tag == "harmony":
                symbol = harmony(el)
                others += [(place, f"[C:{symbol}]")] if symbol else []
        new_time, new_fifths = self.time, self.fifths
        self.time, self.fifths = time, fifths  # a measure's notes are read with the time before it
        voices = list(dict.fromkeys(_int(n, "voice") or 1 for _, n in notes))
        if len(voices) > 1:
            self.diagnostics.append({"kind": "multipleVoices", "part_index": self.index, "measure_index": at, "voices": voices})
            notes = [x for x in notes if (_int(x[1], "voice") or 1) == 1]
        tokens = list(self.notes(notes, at)) or [(0, self.whole_rest())]
        self.time, self.fifths = new_time, new_fifths
        out = [",:"] if self.bar(m, "left") == ",:" else []
        out += [f"[V{e.get('number')}]" for e in m.iter("ending") if e.get("type") == "start" and (e.get("number") or "").isdigit()][:1]
        out += [t for _, t in sorted([*tokens, *others], key=lambda x: x[0])]
        return " ".join([*out, self.bar(m, "right") or ","])

    def changes(self, el: ET.Element) -> Iterator[str]:
        beats, beat_type, fifths = _int(el, ".//beats"), _int(el, ".//beat-type"), _int(el, ".//fifths")
        if beats is not None and beat_type is not None and (beats, beat_type) != self.time:
            self.time = (beats, beat_type)
            yield f"[M{beats}/{beat_type}]"
        if fifths is not None and fifths != self.fifths:
            self.fifths = fifths
            yield f"[K{key_name(fifths, el.findtext('.//mode'))}]"
        clef = clef_name(el)
        if clef:
            yield f"[{CLEF_NAMES[clef]}]"

    @staticmethod
    def bar(m: ET.Element, side: str) -> str | None:
        for b in m.findall("barline"):
            if b.get("location", "right") == side:
                turn = b.find("repeat")
                if turn is not None and turn.get("direction") in ("forward", "backward"):
                    return ",:" if turn.get("direction") == "forward" else ":,"
                return BARS.get((b.findtext("bar-style") or "").strip())
        return None

    def notes(self, notes: list[tuple[int, ET.Element]], at: int) -> Iterator[tuple[float, str]]:
        i = 0
        while i < len(notes):
            place, head = notes[i]
            silent = head.find("rest")
            if silent is not None and silent.get("measure") == "yes":
                yield place, self.whole_rest()
                i += 1
                continue
            if head.find("time-modification") is not None and head.find("chord") is None:
                j = self.tuplet_end(notes, i)
                text = self.tuplet([n for _, n in notes[i:j]], at)
            else:
                j = i + 1
                while silent is None and j < len(notes) and notes[j][1].find("chord") is not None:
                    j += 1
                tags = _tags(head)
                text = self.note([n for _, n in notes[i:j]], _int(head, "duration") or 0, at, tags)
                for tag in ("breath-mark", "caesura"):
                    if tag in tags:
                        text += f" [{tag.removesuffix('-mark')}]"
            if text:
                yield place, text
            i = j

    @staticmethod
    def tuplet_end(notes: list[tuple[int, ET.Element]], i: int) -> int:
        """Where the tuplet that begins at i ends: after its stop mark, else where the time modification ends."""
        j = i
        while j < len(notes):
            n = notes[j][1]
            chord, stop = n.find("chord") is not None, _typed(n, "tuplet", "stop")
            marked = _typed(notes[i][1], "tuplet", "start")
            if j > i and n.find("time-modification") is None and not chord and not (marked and stop):
                break
            j += 1
            if stop and not chord:
                while j < len(notes) and notes[j][1].find("chord") is not None:
                    j += 1
                break
        return j

    def tuplet(self, group: list[ET.Element], at: int) -> str:
        heads = [k for k, n in enumerate(group) if n.find("chord") is None]
        actual, normal = _int(group[0], "time-modification/actual-notes") or 3, _int(group[0], "time-modification/normal-notes") or 2
        total = sum(0 if _has(group[k], "grace") else _int(group[k], "duration") or 0 for k in heads)
        members = []
        for k, after in zip(heads, [*heads[1:], len(group)], strict=True):
            own = _int(group[k], "duration") or 0
            members.append(self.note(group[k:after], half_up(own * actual / normal), at))
        members = [m for m in members if m]
        return f"{total}({' '.join(members)})" if members else ""

    def note(self, chord: list[ET.Element], duration: int, at: int, tags: set[str] | None = None) -> str:
        head = chord[0]
        tags = _tags(head) if tags is None else tags
        dots = len(head.findall("dot"))
        if head.find("rest") is not None:
            return rest(duration, self.div, dots)
        fifths = 0 if "unpitched" in tags else self.key_fifths
        pitches = [p for n in chord if (p := _pitch(n, self.key_fifths))]
        if not pitches:
            return ""
        slurred = "slur" in tags and _typed(head, "slur", "start")
        text = "".join((s.lower() if slurred and k == 0 else s) + (SIGNS.get(a) or ("*" if key_alter(s, fifths) else "")) + str(o) for k, (s, o, a) in enumerate(pitches))
        shape = (head.findtext("notehead") or "").strip().lower() if "notehead" in tags else ""
        text += {"x": "!x", "cross": "!x", "slash": "!/", "diamond": "!d", "triangle": "!t"}.get(shape, "")
        grace = head.find("grace") if "grace" in tags else None
        names = ["j"] if grace is not None else length_names(duration, self.div, dots)
        if not names:
            return ""
        if len(names) > 1:
            self.diagnostics.append({"kind": "nonStandardDuration", "part_index": self.index, "measure_index": at, "units": duration})
        marks = _marks(head, tags)
        out = "+".join(text + name + (marks if k == 0 else "") for k, name in enumerate(names))
        if tags <= _PLAIN_TAGS:
            return out
        out += ("_" if _typed(head, "slur", "stop") else "") + ("+" if _typed(head, "tie", "start") else "")
        if grace is not None:
            out = ("``" if grace.get("slash") == "yes" else "`") + out
        sung = head.find("lyric/text")
        return out + (f" '{re.sub(r'[\r\n]+', '', sung.text)}" if sung is not None and sung.text else "")


def harmony(el: ET.Element) -> str:
    root = el.findtext(".//root-step") or ""
    alter = half_up(float(el.findtext(".//root-alter") or 0))
    kind = el.find("kind")
    shown = kind.get("text") if kind is not None else None
    named = (kind.text or "").strip() if kind is not None else ""
    own = shown if shown else KIND_NAMES.get(named, named)
    if shown and root and shown.startswith(root):  # the shown text may be the whole symbol
        return shown
    return root + SIGNS.get(alter, "") + own


def direction(el: ET.Element) -> list[str]:
    """Commands of a direction."""
    out: list[str] = []
    sound = next(el.iter("sound"), None)
    tempo = sound.get("tempo") if sound is not None else None
    tempo = tempo or el.findtext(".//per-minute")
    if tempo and re.fullmatch(r"[\d.]+", tempo) and half_up(float(tempo)) > 0:
        out.append(f"[T{half_up(float(tempo))}]")
    dynamics = next(el.iter("dynamics"), None)
    if dynamics is not None and len(dynamics):
        out.append(f"[D{dynamics[0].tag}]")
    out += [f"[D{ {'crescendo': '<', 'diminuendo': '>', 'stop': '/'}[w.get('type')]}]" for w in el.iter("wedge") if w.get("type") in ("crescendo", "diminuendo", "stop")][:1]
    out += [f"[{t}]" for t in ("segno", "coda") if _has(el, t)]
    said = " ".join((w.text or "") for w in el.iter("words"))
    if sound is not None:
        for attribute, sign in (("dacapo", "DC"), ("dalsegno", "DS")):
            if sound.get(attribute):
                letters = rf"{sign[0]}\.{sign[1]}\.\s*al\s*"
                goal = ".fine" if sound.get("fine") == "yes" or re.search(letters + "Fine", said, re.I) else ".coda" if re.search(letters + "Coda", said, re.I) else ""
                out.append(f"[{sign}{goal}]")
                break
        else:
            out += ["[fine]"] * (sound.get("fine") == "yes")
        out += ["[tocoda]"] * (sound.get("tocoda") is not None)
    out += [f"[R:{(r.text or '').strip()}]" for r in el.iter("rehearsal")][:1]
    for shift in list(el.iter("octave-shift"))[:1]:
        wide = int(shift.get("size", 8)) >= 15
        out += {"stop": ["[8va/]"], "up": ["[15ma]" if wide else "[8va]"], "down": ["[15mb]" if wide else "[8vb]"]}.get(shift.get("type"), [])
    out += ["[ped/]" if p.get("type") == "stop" else "[ped]" for p in el.iter("pedal")][:1]
    for w in el.iter("words"):
        text = re.sub(r"[\r\n]+", " ", w.text or "").strip()
        if not text:
            continue
        if text.lower().startswith(TEMPO_WORDS):
            out = [t for t in out if not re.fullmatch(r"\[T\d+\]", t)] + [f"[T:{text}]"]
        else:
            out.append(f"[expr:{text}]" if w.get("font-style") == "italic" else f"[text:{text}]")
        out += [f"[{x}]" for x in ("swing", "straight") if x in text.lower()]
    other = " ".join((o.text or "") for o in el.iter("other-direction"))
    return out + [f"[{n}]" for n in ("breath", "caesura") if _has(el, n + "-mark") or _has(el, n) or n in other]


def convert(xml: str, labels: list[str] | None = None) -> dict:
    """source, n_parts, n_measures, diagnostics of a document; error instead where it can't be read."""
    try:
        parts, names = read_parts(xml)
    except ET.ParseError as e:
        return {"source": None, "n_parts": 0, "n_measures": 0, "diagnostics": [], "error": f"not well-formed: {e}"}
    if not parts:
        return {"source": None, "n_parts": 0, "n_measures": 0, "diagnostics": [], "error": "no part"}
    diagnostics: list[dict] = []
    given = parts[0].attributes
    first = given[0] if given else None
    head = Head(time=(_int(first, ".//beats") or 4, _int(first, ".//beat-type") or 4), fifths=_int(first, ".//fifths") or 0, mode=first.findtext(".//mode") if first is not None else None, div=4 * (_int(first, ".//divisions") or 8), clef=clef_name(first) or "TREBLE")
    if len(given) > 1:
        diagnostics.append({"kind": "multipleAttributes", "part_index": 0})
    numbers = sorted({n for p in parts for n, _ in p.measures}, key=number_key)
    lines = [head.text()]
    for k, part in enumerate(parts):
        own = part.attributes[0] if part.attributes else None
        one = _Converter(k, head, 4 * (_int(own, ".//divisions") or head.div // 4), diagnostics)
        by_number = dict(part.measures)
        cells = [one.measure(at, by_number[n]) if n in by_number else f"{one.whole_rest()} ," for at, n in enumerate(numbers)]
        if len(part.measures) < len(numbers):
            diagnostics.append({"kind": "partMeasureCountMismatch", "part_index": k, "got": len(part.measures), "expected": len(numbers)})
        label = labels[k] if labels and k < len(labels) else f"{k + 1}:{names[part.pid]}" if part.pid in names else f"{k + 1}"
        clef = clef_name(own) if k else None
        if clef and clef != head.clef:
            number, colon, name = label.partition(":")
            label = number + CLEF_NAMES[clef] + colon + name
        lines.append(f"[{label}]| {' | '.join(cells)} |")
    return {"source": "\n".join(lines), "n_parts": len(parts), "n_measures": len(numbers), "diagnostics": diagnostics, "error": None}


_DIAGNOSTIC = pa.struct([("kind", pa.string()), ("part_index", pa.int32()), ("measure_index", pa.int32()), ("got", pa.int32()), ("expected", pa.int32()), ("units", pa.int32()), ("voices", pa.list_(pa.int32()))])
_SCHEMA = "score_id long, source string, n_parts int, n_measures int, diagnostics array<struct<kind:string,part_index:int,measure_index:int,got:int,expected:int,units:int,voices:array<int>>>, error string"


def sources(documents: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Notation text of MusicXML documents (score_id, xml). A null document has the error `no document`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = {"source": None, "n_parts": 0, "n_measures": 0, "diagnostics": [], "error": "no document"}
            found = [convert(x.as_py(), labels) if x.is_valid else none for x in batch.column(1)]
            cols = [pa.array([f[k] for f in found], t) for k, t in (("source", pa.string()), ("n_parts", pa.int32()), ("n_measures", pa.int32()), ("diagnostics", pa.list_(_DIAGNOSTIC)), ("error", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["score_id", "source", "n_parts", "n_measures", "diagnostics", "error"])

    return documents.select("score_id", "xml").mapInArrow(run, _SCHEMA)


def score_of_archive(data: bytes) -> str | None:
    """The score document of a compressed container: the one its index names, else its first XML file."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        names = box.namelist()
        if "META-INF/container.xml" in names:
            index = ET.fromstring(box.read("META-INF/container.xml"))
            named = next((e.get("full-path") for e in index.iter() if e.tag.endswith("rootfile")), None)
            if named in names:
                return box.read(named).decode("utf-8", "replace")
        own = sorted(n for n in names if n.lower().endswith((".xml", ".musicxml")) and not n.startswith("META-INF/"))
        return box.read(own[0]).decode("utf-8", "replace") if own else None
