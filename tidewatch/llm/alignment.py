"""Alignment of two tokenizers' vocabularies over a corpus, by inverted pair bitmaps.

Each text is encoded by both tokenizers. Where tokens of both end at the same byte, the
text is cut into groups, and the two tokens that end there are linked. An index over the
links answers how often a pair of ids is linked in the whole corpus: for each pair, a
bitmap of the documents that link it, with the number of links beyond the first in binary
as further bitmaps (multiplicity planes).

Documents are numbered in chunks of at most 4096 texts and 4 MB, and a bitmap is stored
per chunk in one of two forms: the positions of its documents as 16-bit numbers, or, from
256 documents on, 4096 bits. Bitmaps of a chunk's batches are merged by OR while the chunk
is written; those of different chunks lie side by side. Counting their bits gives a pair's
documents, and its links when each plane has the weight of its binary place. Counts are
summed before they are shuffled, so a pair that every document links costs a row per chunk.

The postings return the scores: a pair's count goes to its bitmaps, and these to their
chunk, where each set bit adds the count to its document. A chunk is bounded, so is the
work of one group; nothing depends on the size of the corpus but the number of rows.

Defined cases: texts that are NULL, empty, or not restored exactly by a tokenizer's tokens
(such as those that hold U+2581) have no tokens, zeros and an empty group text; repeated
rows and NULL ids are documents of their own. Tokens have a byte at least, so at most one
pair of them ends at a byte.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.llm.tokens import VOCABULARY, shared_encoder
from tidewatch.session import stored

PIECES = "piece_bpe_32k.model"
#: Documents and bytes of text of a chunk, and the size of a bitmap of one bit for each.
CHUNK_DOCS, CHUNK_BYTES = 4096, 4 << 20
BITMAP_BYTES = CHUNK_DOCS // 8
#: Chunks of a task follow its number in the chunk's number.
TASK_SHIFT = 33


class Pieces:
    """A sentence-piece model with the bytes of each of its pieces."""

    def __init__(self, model: str = PIECES):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
                      for i, name in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def shared_pieces(model: str = PIECES) -> Pieces:
    """One model per Python worker, kept between its tasks."""
    held = sys.modules.setdefault("_tidewatch_held", types.ModuleType("_tidewatch_held"))
    models = held.__dict__.setdefault("pieces", {})
    if model not in models:
        models[model] = Pieces(model)
    return models[model]


def encoded(encoder, pieces: Pieces, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a space and the text by both tokenizers; none if either does not restore it."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return nothing
    a, b = encoder.encode(" " + text), pieces.encode(text)
    whole = (" " + text).encode()
    a = np.frombuffer(a, "<u4").astype(np.int64)
    if encoder.sizes[a].sum() != len(whole) or b"".join(map(pieces.bytes.__getitem__, b)) != whole:
        return nothing
    return a, np.array(b, np.int64)


def common_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of either side that end where one of the other side does."""
    a, b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = np.flatnonzero(b[at] == a)
    return hit, at[hit]


class GroupText:
    """Writes groups as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n_ids: int):
        self.n = n_ids
        self.parts = [f"{i}{sign}" for sign in ",|;" for i in range(n_ids)]

    def write(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        if not len(a_ends):
            return ""
        a_sign, b_sign = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sign[a_ends], b_sign[b_ends] = self.n, 2 * self.n
        # groups in order, and within a group its tokens of a before those of b
        a_group = np.searchsorted(a_ends, np.arange(len(a)))
        b_group = np.searchsorted(b_ends, np.arange(len(b)))
        place = np.empty(len(a) + len(b), np.int64)
        a_place = np.arange(len(a)) + np.concatenate(([0], b_ends + 1))[a_group]
        b_place = np.arange(len(b)) + (a_ends + 1)[b_group]
        place[a_place], place[b_place] = a + a_sign, b + b_sign
        return "".join(map(self.parts.__getitem__, place.tolist()))[:-1]


def containers(positions: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """A bitmap for each run of `positions` from one start to the next, and how many bits it has."""
    sizes = np.diff(np.append(starts, len(positions)))
    large = np.flatnonzero(2 * sizes >= BITMAP_BYTES)
    lengths = 2 * sizes
    lengths[large] = BITMAP_BYTES
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = np.zeros(offsets[-1], np.uint8)
    small = np.ones(len(sizes), bool)
    small[large] = False
    listed = np.repeat(small, sizes)
    data[np.repeat(small, lengths)] = positions[listed].astype("<u2").view(np.uint8)
    for i in large:
        bits = np.zeros(CHUNK_DOCS, np.uint8)
        bits[positions[starts[i]:starts[i] + sizes[i]]] = 1
        data[offsets[i]:offsets[i + 1]] = np.packbits(bits, bitorder="little")
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary()), sizes


def members(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The positions set in all bitmaps, and the index of the bitmap of each."""
    sizes = np.asarray(pc.binary_length(bitmaps).to_numpy(zero_copy_only=False), np.int64)
    is_list = sizes < BITMAP_BYTES
    joined = b"".join(bitmaps.filter(pa.array(is_list)).to_pylist())
    found = [np.frombuffer(joined, "<u2").astype(np.int64)]
    owner = [np.repeat(np.flatnonzero(is_list), sizes[is_list] // 2)]
    for i in np.flatnonzero(~is_list):
        bits = np.unpackbits(np.frombuffer(bitmaps[int(i)].as_py(), np.uint8), bitorder="little")
        at = np.flatnonzero(bits)
        found.append(at)
        owner.append(np.full(len(at), i))
    return np.concatenate(found), np.concatenate(owner)


def bitmaps_of(keys: np.ndarray, times: np.ndarray, positions: np.ndarray) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
    """For each plane its pairs and their bitmaps: first the documents, then the bits of the links beyond the first."""
    order = np.lexsort((positions, keys))
    keys, more, positions = keys[order], times[order] - 1, positions[order]
    for plane in range(-1, int(more.max(initial=0)).bit_length()):
        held = slice(None) if plane < 0 else (more >> plane & 1).astype(bool)
        k, p = keys[held], positions[held]
        if len(k):
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            yield k[starts], plane, containers(p, starts)[0]


_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
          model: str = PIECES) -> DataFrame:
    """The index of all links, in one table of two kinds of rows.

    Documents: `chunk`, `at` (position in it), `id`, `n_a`, `n_b`, `n_groups`, `n_links`, `groups_sha256`.
    Bitmaps: `chunk`, `pair` (id of the first tokenizer in the upper, of the second in the lower 32 bits),
    `plane` (-1: the documents; k: those with bit k in their number of further links), `docs`.
    """
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = shared_encoder(vocabulary), shared_pieces(model)
        writer = GroupText(max(len(encoder.sizes), len(pieces.sizes)))
        chunk, at, size, held = TaskContext.get().partitionId() << TASK_SHIFT, 0, 0, []
        id_type = None

        def closed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, times, positions = (np.concatenate(x) for x in zip(*held))
            for pairs, plane, bitmaps in bitmaps_of(keys, times, positions):
                n = len(pairs)
                yield batch_of(n, {"chunk": pa.array(np.full(n, chunk)), "pair": pa.array(pairs),
                                   "plane": pa.array(np.full(n, plane, np.int8)), "docs": bitmaps})

        def batch_of(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            types = {"chunk": pa.int64(), "at": pa.int32(), "id": id_type, **dict.fromkeys(_MEASURES, pa.int64()),
                     "groups_sha256": pa.string(), "pair": pa.int64(), "plane": pa.int8(), "docs": pa.binary()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in types.items()],
                                              names=list(types))

        for batch in batches:
            id_type = batch.column("id").type
            rows = []
            for value in batch.column("text"):
                body = value.as_py()
                long = len(body or "")
                if at == CHUNK_DOCS or at and size + long > CHUNK_BYTES:
                    yield from closed()
                    chunk, at, size, held = chunk + 1, 0, 0, []
                a, b = encoded(encoder, pieces, body)
                a_ends, b_ends = common_ends(encoder.sizes[a], pieces.sizes[b])
                groups = writer.write(a, b, a_ends, b_ends)
                rows.append((chunk, at, len(a), len(b), len(a_ends), len(a_ends),
                             hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                if len(a_ends):
                    keys, times = np.unique(a[a_ends] << 32 | b[b_ends], return_counts=True)
                    held.append((keys, times, np.full(len(keys), at)))
                at, size = at + 1, size + long
            if rows:
                names = ["chunk", "at", *_MEASURES, "groups_sha256"]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * len(_MEASURES), pa.string()]
                found = {c: pa.array(x, t) for c, t, x in zip(names, kinds, zip(*rows))}
                yield batch_of(len(rows), {**found, "id": batch.column("id")})
        yield from closed()

    measures = ", ".join(f"{c} bigint" for c in _MEASURES)
    return slim.mapInArrow(indexed, f"chunk bigint, at int, id {kind}, {measures}, groups_sha256 string, "
                                    "pair bigint, plane tinyint, docs binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """`pair`, `b`, `n_docs`, `n_links` and `best` (most links of its id `b`, ties included) of stored index rows."""
    size = F.octet_length("docs")
    bits = F.when(size < BITMAP_BYTES, F.expr("octet_length(docs) div 2")).otherwise(F.bitmap_count("docs"))
    weight = F.expr("shiftleft(1L, greatest(plane, 0))")
    counted = rows.filter("pair is not null").select("pair", "plane", bits.alias("bits"), weight.alias("weight"))
    pairs = counted.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("bits"))).alias("n_docs"),
                                        F.sum(F.col("bits") * F.col("weight")).alias("n_links"))
    pairs = stored(pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    most = pairs.groupBy("b").agg(F.max("n_links").alias("most"))
    return spread_join(pairs, most, ["b"]).select("pair", "b", "n_docs", "n_links",
                                                  (F.col("n_links") == F.col("most")).alias("best"))


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Adds `n_best` and `count_sum` to the documents of a chunk from its bitmaps with their pairs' counts."""
    place = left["at"].to_numpy()
    n = int(place.max()) + 1 if len(place) else 0
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if right.num_rows and n:
        at, owner = members(right["docs"].combine_chunks())
        weight = np.left_shift(1, np.maximum(right["plane"].to_numpy().astype(np.int64), 0))
        np.add.at(total, at, (weight * right["n_links"].to_numpy())[owner])
        np.add.at(best, at, (weight * right["best"].to_numpy().astype(np.int64))[owner])
    out = left.select(["id", *_MEASURES, "groups_sha256"])
    return out.append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place]))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
          model: str = PIECES) -> DataFrame:
    """`id`, `n_a`, `n_b`, `n_groups`, `n_links`, `groups_sha256`, `n_best`, `count_sum` of every document.

    `n_best` is the number of links whose pair is linked most often of all pairs with its
    second id, `count_sum` the sum over links of how often their pair is linked.
    """
    rows = stored(index(docs, key, text, vocabulary, model), "pair-index")
    scores = stored(pair_counts(rows), "pair-counts").select("pair", "n_links", "best")
    bitmaps = spread_join(rows.filter("pair is not null").select("pair", "chunk", "plane", "docs"), scores, ["pair"])
    found = rows.filter("pair is null").select("chunk", "at", "id", *_MEASURES, "groups_sha256")
    kind = rows.schema["id"].dataType.simpleString()
    measures = ", ".join(f"{c} bigint" for c in _MEASURES)
    # both sides come from one table, so the key of one is renamed
    scored = bitmaps.select(F.col("chunk").alias("of"), "plane", "docs", "n_links", "best").groupBy("of")
    return found.groupBy("chunk").cogroup(scored).applyInArrow(
        _scored, f"id {kind}, {measures}, groups_sha256 string, n_best bigint, count_sum bigint")
