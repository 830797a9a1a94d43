"""Personal data with offset-preserving deobfuscation.

The plain forms are found in the text as it is. A transducer then rewrites disguises
(look-alike letters and digits, invisible characters, spelled digits, `at` and `dot`
in words or brackets) and keeps, for each replacement, where it began and ended in the
source. The same detectors run on the rewritten text, and every span is mapped back to
whole source characters. A found span that overlaps none of its kind is added; plain
ones always stay.

Detectors are linear in the text: they start at rare characters or run over maximal
runs, so that long junk cannot make them backtrack.

Defined cases: NULL text is empty and has no span; offsets count code points, the end
exclusive; repeated rows are judged row by row; masking replaces overlapping spans of
several kinds once, by the kind that begins first.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBERS = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _NUMBERS.finditer(text):
        if run[0].count(".") >= 3:
            for match in _IP.finditer(text, run.start(), run.end()):
                # length first, without leading zeros: int() refuses very long runs of digits
                parts = [part.lstrip("0") for part in match[0].split(".")]
                if all(len(part) <= 3 and int(part or "0") <= 255 for part in parts):
                    yield match.span()


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _DIGITS.finditer(text):
        if 14 <= match.end() - match.start() <= 37:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        match = _PHONE.match(text, at + 1)
        if match and 10 <= sum(map(str.isdigit, match[0])) <= 15:
            yield at, match.end()
        at = text.find("+", match.end() if match else at + 1)


_DETECTORS = list(zip(KINDS, (_emails, _ips, _cards, _phones)))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the undisguised data, in order."""
    return sorted((start, kind, end) for kind, (_, found) in enumerate(_DETECTORS) for start, end in found(text))


# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "＠": "@", "﹫": "@",
}
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# The digits in four languages.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: Two or more digit words in a row; what joins them goes, a point is kept as one.
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ -])?(?:{_WORD})(?:(?:[ ,-]|, | (?:dot|point) )(?:{_WORD}))+(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)plus|dot|point|{_WORD}")
_BRACKETED = re.compile(r"(?i) ?[\[({<] ?(?P<what>at|@|dot|\.|punkt|point|punto) ?[\])}>] ?")
# Endings that make a bare `at` and `dot` an address rather than prose.
_ENDINGS = "com|org|net|edu|gov|info|biz|io|co|dev|app|eu|uk|us|de|fr|es|it|nl|pl|ch|at|be|ca|au|in|jp"
_BARE = re.compile(rf"(?i)(?<=[a-z0-9_%+-]) at (?=(?:[a-z0-9-]++(?: dot |\.))+(?:{_ENDINGS})(?![a-z0-9-]))")
_BARE_DOT = re.compile(r"(?i)(?<=[a-z0-9]) dot (?=[a-z0-9])")
_WIDE = re.compile(r"[^\x00-\xff]|\xad")


class Rewriting:
    """A text after replacements, and the way back to its source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """`edits` (start, end, replacement) are in order and do not overlap."""
        parts, self.starts, self.shifts, at, length = [], [0], [(0, 0, False)], 0, 0
        for start, end, new in edits:
            parts += [source[at:start], new]
            length += start - at
            if new:
                self.starts.append(length)
                self.shifts.append((start, end, True))
            length += len(new)
            self.starts.append(length)
            self.shifts.append((end, end, False))
            at = end
        parts.append(source[at:])
        self.text = "".join(parts)

    def _source(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.starts, at) - 1
        start, end, whole = self.shifts[i]
        if whole:
            return start, end
        return start + at - self.starts[i], start + at - self.starts[i] + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source characters behind a span of the rewritten text."""
        return self._source(start)[0], self._source(end - 1)[1]


def _letters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for match in () if text.isascii() else _WIDE.finditer(text):
        char = match[0]
        if char in _INVISIBLE:
            new = ""
        else:
            new = _LOOK_ALIKES.get(char) or unicodedata.normalize("NFKC", char)
            if not new.isascii():
                digit = unicodedata.digit(char, None)
                new = char if digit is None else str(digit)
        if new != char:
            edits.append((*match.span(), new))
    return edits


def _words(text: str) -> list[str]:
    return text.lower().replace(",", " ").replace("-", " ").replace(".", " ").split()


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if _SPELLED.keys().isdisjoint(_words(text)):
        return edits
    for run in _SPELLED_RUN.finditer(text):
        parts = [part[0].lower() for part in _SPELLED_PART.finditer(text, *run.span())]
        new = "".join(_SPELLED.get(part) or ("+" if part == "plus" else ".") for part in parts)
        edits.append((*run.span(), new))
    return edits


def _separators(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if any(c in text for c in "[({<"):
        edits += [(*m.span(), "@" if m["what"].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(text)]
    lower = text.lower()
    if " at " in lower:
        edits += [(*m.span(), "@") for m in _BARE.finditer(text)]
    if " dot " in lower:
        edits += [(*m.span(), ".") for m in _BARE_DOT.finditer(text)]
    edits.sort()
    return [e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]]


#: In this order: letters first, so that the words of the others are readable.
_TRANSDUCERS = [_letters, _spelled, _separators]


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of what only the rewritten text shows, in source characters."""
    steps, current = [], text
    for transducer in _TRANSDUCERS:
        edits = transducer(current)
        if edits:
            steps.append(Rewriting(current, edits))
            current = steps[-1].text
    if not steps:
        return []
    found = []
    for start, kind, end in plain_spans(current):
        for step in reversed(steps):
            start, end = step.back(start, end)
        found.append((start, kind, end))
    return found


def find_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans, and all spans."""
    text = text or ""
    plain = plain_spans(text)
    taken = {kind: [s for s in plain if s[1] == kind] for kind in range(len(KINDS))}
    added = []
    for span in disguised_spans(text):
        own = taken[span[1]]
        i = bisect_right(own, (span[0], span[1], len(text) + 1))
        before = i and own[i - 1][2] > span[0]
        after = i < len(own) and own[i][0] < span[2]
        if not before and not after and not (added and added[-1][1] == span[1] and added[-1][2] > span[0]):
            added.append(span)
    return plain, sorted(plain + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with a mark such as `<EMAIL>` for each span."""
    if not spans:
        return text
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, the plain counts per kind, `base_spans` and `spans` as text, per row."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, plain, all_spans, shas = [[] for _ in KINDS], [], [], []
            for value in batch.column("text"):
                base, spans = find_spans(value.as_py())
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in base))
                plain.append(written(base))
                all_spans.append(written(spans))
                shas.append(hashlib.sha256(plain[-1].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts),
                 *(pa.array(c, pa.string()) for c in (shas, plain, all_spans))],
                names=["id", *names, "base_sha256", "base_spans", "spans"])

    return slim.mapInArrow(scanned, f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, "
                                    "base_sha256 string, base_spans string, spans string")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with every span of `text` masked."""
    at = docs.columns.index(text)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = (value.as_py() for value in column)
            new = pa.array([masked(t, find_spans(t)[1]) for t in texts], column.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(cleaned, docs.schema)
