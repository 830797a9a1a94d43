"""Byte-level BPE, and token counts attributed to sections of a text.

Attribution encodes a document once, never its sections: tokens that a section alone
would not produce stay as they are in the document. A token is joined to the section
intervals it overlaps; the rule for a token across a boundary is explicit, see `RULES`.

Defined cases: NULL text is empty and has no tokens, but keeps its (empty) first
section; an empty section has none; repeated rows give repeated counts.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space but for blanks and line breaks.
_RARE = re.compile(r"[^\S \n]")
#: Who owns a token whose characters lie in several sections: the section of its first
#: or last character, or the one with most of its characters (the earlier on a tie).
RULES = ("first", "last", "most")


class Encoder:
    """Ids as packed unsigned 32-bit numbers in the machine's (little-endian) order.

    The look-ahead of the split pattern only matters where two white spaces meet.
    Other texts are split by the pattern without it, which a faster engine runs.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.exact, self.plain = (
            tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for name, p in (("exact", pattern), ("plain", pattern.replace(r"|\s+(?!\S)", ""))))
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE.search(text)
        return array("I", (self.exact if runs else self.plain)(text)).tobytes()

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the character after its last one.

        A token that holds a part of a character counts as touching it.
        """
        sizes = self.sizes[np.frombuffer(ids, "<u4")]
        ends = np.cumsum(sizes)
        if text.isascii():
            return ends - sizes, ends
        data = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        return char_of[ends - sizes], char_of[ends - 1] + 1


def shared_encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per Python worker, kept between its tasks."""
    held = sys.modules.setdefault("_tidewatch_held", types.ModuleType("_tidewatch_held"))
    encoders = held.__dict__.setdefault("encoders", {})
    if vocabulary not in encoders:
        encoders[vocabulary] = Encoder(vocabulary)
    return encoders[vocabulary]


def owners(first: np.ndarray, stop: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section that owns each token; section i is [bounds[i], bounds[i + 1])."""
    a = np.searchsorted(bounds, first, side="right") - 1
    b = np.searchsorted(bounds, stop - 1, side="right") - 1
    if rule == "first":
        return a
    if rule == "last":
        return b
    best, most = a.copy(), np.minimum(stop, bounds[a + 1]) - first
    for step in range(1, int((b - a).max(initial=0)) + 1):
        at = np.minimum(a + step, b)
        inside = np.minimum(stop, bounds[at + 1]) - np.maximum(first, bounds[at])
        better = (a + step <= b) & (inside > most)
        best, most = np.where(better, at, best), np.where(better, inside, most)
    return best


def section_counts(encoder: Encoder, text: str, ids: bytes, bounds: np.ndarray,
                   rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens owned by each section, and how many of them lie across a boundary."""
    n = len(bounds) - 1
    first, stop = encoder.spans(text, ids)
    own = owners(first, stop, bounds, rule)
    over = np.searchsorted(bounds, first, side="right") != np.searchsorted(bounds, stop - 1, side="right")
    return np.bincount(own, minlength=n), np.bincount(own[over], minlength=n)


def line_bounds(text: str) -> np.ndarray:
    """Sections are the lines of a text; a line break ends its line."""
    breaks = [m.end() for m in re.finditer("\n", text)]
    if not breaks or breaks[-1] != len(text):
        breaks.append(len(text))
    return np.array([0, *breaks], np.int64)


def count_by_section(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: str = "first",
                     vocabulary: str = VOCABULARY) -> DataFrame:
    """`id`, `section` (from 0), `start`, `stop` (characters), `n_tokens`, `n_crossing` per line of each text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary)
        for batch in batches:
            rows, parts = [], []
            for row, value in enumerate(batch.column("text")):
                body = value.as_py() or ""
                bounds = line_bounds(body)
                counts, crossing = section_counts(encoder, body, encoder.encode(body), bounds, rule)
                rows.append(np.full(len(counts), row))
                parts.append((np.arange(len(counts)), bounds[:-1], bounds[1:], counts, crossing))
            if rows:
                at = pa.array(np.concatenate(rows))
                section, *rest = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), pa.array(section.astype(np.int32)), *map(pa.array, rest)],
                    names=["id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return slim.mapInArrow(
        counted, f"id {kind}, section int, start bigint, stop bigint, n_tokens bigint, n_crossing bigint")
