"""Personal data in texts, plain and disguised, as spans of the source's characters.

Plain identifiers are found in the text as it is.  Then transducers rewrite it: look-alike characters become ASCII and invisible ones go, spelled digits
become digits, disguises of @ and . become these.  Each rewriting keeps for every character the source characters it came from, so what is found in the
normalised text is mapped back.  One pass of Arrow batches over the texts, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, text_array, text_buffer

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, and no digit is given back, so no text takes more than linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def identifiers(text: str) -> list[Span]:
    """Plain identifiers, leftmost and without overlap within a kind, by start and kind; matches that fail their check are dropped and not tried again."""
    found, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(end, text.rfind("@", end, at) + 1)
        local = text[low:at]
        start = low + len(local.rstrip(_LOCAL))
        if start < at:
            end = m.end()
            found.append((0, start, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0]))


class Tape:
    """A rewritten text that knows, for each of its characters, where in the source it came from."""

    def __init__(self, text: str):
        self.text, self._stages = text, []

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> bool:
        """Replaces the ranges (start, end, by) of the present text, which rise and don't overlap; whether there were any."""
        out, starts, places, done, size = [], [], [], 0, 0
        for start, end, by in edits:
            if start > done:
                out.append(self.text[done:start])
                starts.append(size)
                places.append((done, None))
                size += start - done
            if by:
                out.append(by)
                starts.append(size)
                places.append((start, end))
                size += len(by)
            done = end
        if not done:
            return False
        out.append(self.text[done:])
        starts.append(size)
        places.append((done, None))
        self.text = "".join(out)
        self._stages.append((starts, places))
        return True

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters of a non-empty range of the present text."""
        for starts, places in reversed(self._stages):
            a, b = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            first, last = places[a], places[b]
            start, end = first[0] + (start - starts[a] if first[1] is None else 0), last[0] + end - starts[b] if last[1] is None else last[1]
        return start, end


# Letters that look like others (Cyrillic, Greek, Armenian), dashes and dots; full-width and styled forms follow from compatibility normalisation, digits of other scripts from their decimal value.
_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅοναικρτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧոսօ", "aeopcyxijshdqwABEKMHOPCTXYIJSovaikptuxwABEZHIKMNOPTYXnuo", strict=True)) | dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("․。", ".")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")


class _Alike(dict):
    """Translation of single characters to ASCII look-alikes; others stay."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        to = " " if c == "\xa0" else c
        if point >= 0x100:
            to = _ALIKE.get(c) or (str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else unicodedata.normalize("NFKC", c))
            to = to if len(to) == 1 and to < "\x7f" else c
        self[point] = ord(to)
        return self[point]


_TO_ASCII = _Alike()

# Digit words in English, German, French and Spanish, and the words for @ and . there.
_WORDS = ("zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
_AT_WORDS, _DOT_WORDS = "at|arroba", "dot|punkt|point|punto"
_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk us de fr es it nl eu ch at be pt ru jp cn in br au ca pl se no fi dk ie cz app dev me tv xyz online site mx ar example test".split())

_DIGIT = {w: str(k) for k, own in enumerate(_WORDS) for w in own.split()}
_WORD = "|".join(sorted(_DIGIT, key=lambda w: (-len(w), w)))
_SAID = re.compile(rf"(?i)(?<!\w)(?:{_WORD})(?!\w)")
_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ -]+|\+ ?)?(?:(?:(?:double|triple)[ -]+)?(?:{_WORD})|[0-9]++)(?:[ ,.()-]++(?:(?:{_DOT_WORDS})[ ,-]++)?(?:(?:(?:double|triple)[ -]+)?(?:{_WORD})(?!\w)|[0-9]++(?!\w)))++")
_RUN_PART = re.compile(rf"(?i)(?P<plus>plus)(?!\w)|(?P<times>double|triple)(?!\w)|(?P<dot>{_DOT_WORDS})(?!\w)|(?P<word>{_WORD})(?!\w)|(?P<digits>[0-9]+)|(?P<other>[ ,.()-]+)")
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OolI]*[0-9])(?=[0-9]*[OolI])[0-9OolI]++(?![A-Za-z0-9])")
_CLOSED = r"\s{{0,4}}[\[({{<]\s{{0,4}}(?:{0})\s{{0,4}}[\])}}>]\s{{0,4}}"
_HINT = re.compile(rf"(?i)[\[({{<]\s{{0,4}}(?:{_AT_WORDS}|{_DOT_WORDS}|[@.])\s{{0,4}}[\])}}>]|[A-Za-z0-9] @ ?[A-Za-z0-9]|[ _](?:{_DOT_WORDS})[ _]")
_AT = re.compile(rf"(?i)(?P<closed>{_CLOSED.format(_AT_WORDS + '|@')})|(?P<bare>[ _]{{1,4}}(?:{_AT_WORDS})[ _]{{1,4}})|(?P<spaced> @ )|@")
_DOT = rf"(?:{_CLOSED.format(_DOT_WORDS + r'|\.')}|[ _]{{1,4}}(?:{_DOT_WORDS})[ _]{{1,4}}|\.)"
_DOTS = re.compile(rf"(?i){_DOT}")
_RIGHT = re.compile(rf"(?i)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+")
_DOT_BEFORE = re.compile(rf"(?i){_DOT}\Z")
_NAME = _LOCAL.replace(".", "")


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn runs of at least three digit words (with numbers between) into digits, and O, o, l, I within numbers into 0 and 1."""
    edits = []
    if sum(1 for _, m in zip(range(3), _SAID.finditer(text), strict=False)) == 3:
        for run in _RUN.finditer(text):
            parts = list(_RUN_PART.finditer(text, run.start(), run.end()))
            if sum(p.lastgroup == "word" for p in parts) < 3:
                continue
            times = 1
            for k, p in enumerate(parts):
                kind = p.lastgroup
                if kind == "times":
                    times = 2 if p[0].lower() == "double" else 3
                    edits.append((p.start(), p.end(), ""))
                elif kind == "word":
                    edits.append((p.start(), p.end(), _DIGIT[p[0].lower()] * times))
                    times = 1
                elif kind in ("plus", "dot"):
                    edits.append((p.start(), p.end(), "+" if kind == "plus" else "."))
                elif kind == "other" and not (p[0] == "." and k and parts[k - 1].lastgroup == "digits"):
                    edits.append((p.start(), p.end(), ""))
    taken = [(a, b) for a, b, _ in edits]
    for m in _MIXED.finditer(text):
        edits += [(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for k, c in enumerate(m[0]) if c in "OolI"]
    return iter(sorted(edits)) if not taken else iter(_apart(sorted(edits)))


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguises of @ and . into these, where a whole address is disguised.

    A bare word (`` at ``) counts only with a disguised dot after it; where both are bare words the last label must be a known ending, else 2 to 24 letters.
    """
    edits: list[tuple[int, int, str]] = []
    end = 0
    if not _HINT.search(text):
        return edits
    for at in _AT.finditer(text):
        if at.start() < end:
            continue
        right = _RIGHT.match(text, at.end())
        low = end
        while right is not None:
            last = None
            dots = [m for m in _DOTS.finditer(text, right.start(), right.end())]
            label = text[dots[-1].end() : right.end()]
            if label.isalpha() and label.isascii() and 2 <= len(label) <= 24:
                break
            last = dots[-1].start()
            right = _RIGHT.match(text, at.end(), last)
        if right is None:
            continue
        hidden = [m for m in dots if m[0] != "."]
        if at.lastgroup == "bare" and (not hidden or (all(m[0][0] in " _" and m[0].strip(" _").isalpha() for m in hidden) and label.lower() not in _ENDINGS)):
            continue
        own, stop = [], at.start()
        while True:
            piece = text[max(low, stop - 256) : stop]
            begin = stop - (len(piece) - len(piece.rstrip(_NAME)))
            if begin == stop:
                break
            start, before = begin, _DOT_BEFORE.search(text, max(low, begin - 24), begin)
            if begin == max(low, stop - 256) or before is None:
                break
            own.append(before)
            stop = before.start()
        if stop == at.start() and begin == stop:
            continue
        own = [m for m in own if m.end() > start]
        if at[0] == "@" and not hidden and not any(m[0] != "." for m in own):
            continue
        edits += [(m.start(), m.end(), ".") for m in reversed(own) if m[0] != "."]
        if at[0] != "@":
            edits.append((at.start(), at.end(), "@"))
        edits += [(m.start(), m.end(), ".") for m in hidden]
        end = right.end()
    return _apart(edits)


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, as spans of ``text``; those within a plain one of their kind are left out."""
    tape, changed = Tape(text), False
    if not text.isascii():
        try:
            text.encode("latin-1")
            narrow = True
        except UnicodeEncodeError:
            narrow = False
        if not narrow or "\xa0" in text:
            tape.text = text.translate(_TO_ASCII)
            changed = tape.text != text
        if not narrow or "\xad" in text:
            changed |= tape.edit((m.start(), m.end(), "") for m in _INVISIBLE.finditer(tape.text))
    changed |= tape.edit(_spelled(tape.text))
    changed |= tape.edit(_disguised(tape.text))
    if not changed:
        return []
    own = [[s for s in plain if s[0] == k] for k in range(len(KINDS))]
    starts = [[s[1] for s in o] for o in own]
    found = []
    for kind, a, b in identifiers(tape.text):
        a, b = tape.source(a, b)
        k = bisect_right(starts[kind], a) - 1
        if k < 0 or own[kind][k][2] < b:
            found.append((kind, a, b))
    return found


def _written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: its id, the numbers of plain identifiers of each kind, base_sha256 (of the list of plain spans) and spans (the list of all).

    A span is ``kind:start:end`` in code points, end exclusive; lists are by start, then email, ip, card, phone.  Null text counts as empty; repeated
    rows give a row each; texts of any length are read whole, about a megabyte of shorter ones at a time.  All steps take time linear in the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), text_array(batch.column("text"))
            for a, b in row_slices(text_buffer(texts)[1]):
                counts: list[list[int]] = [[] for _ in KINDS]
                base, spans = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    plain = identifiers(text)
                    for k, column in enumerate(counts):
                        column.append(sum(s[0] == k for s in plain))
                    base.append(hashlib.sha256(_written(plain).encode()).hexdigest())
                    spans.append(_written(sorted({*plain, *disguised(text, plain)}, key=lambda s: (s[1], s[0], s[2]))))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(scan, schema)
