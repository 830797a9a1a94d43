"""Packing: bounded-space online best-fit.

Documents stream through a packer with a fixed number of open bins. The free space of
every open bin is a bit of one number, so the tightest bin that still fits a piece is
the lowest set bit from the piece's length upwards. If nothing fits and all bins are
open, the fullest one closes. A task holds no more than its open bins.

Each input partition is packed on its own. The bins still open at its end are not
closed half empty: their pieces go through the packer again, many partitions' leftovers
together, until one round has a single partition. Both rounds are written to the
shared folder, so a repeated task cannot place a piece twice.

Defined cases: NULL text is empty, and an empty text is its end mark alone; only texts
above the capacity are cut, the remainder first and full pieces after it; repeated
rows and ids are packed row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tokens import VOCABULARY, shared_encoder
from tidewatch.session import stored

CAPACITY = 2048
OPEN_BINS = 64
#: Partitions whose leftovers are packed together in the next round.
GATHERED = 32
END = (0).to_bytes(4, "little")
#: Pieces per batch that a task hands on.
BATCH = 512


class Packer:
    """Places pieces of at most `capacity` into bins; at most `open_bins` are open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set if an open bin has f places left
        self.by_free: dict[int, list[list]] = {}
        self.open = 0

    def _take(self, space: int) -> list:
        bins = self.by_free[space]
        taken = bins.pop()
        if not bins:
            del self.by_free[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return taken

    def _put(self, space: int, content: list) -> None:
        self.by_free.setdefault(space, []).append(content)
        self.free |= 1 << space
        self.open += 1

    def add(self, length: int, piece) -> list | None:
        """The content of a bin that closes now, if any."""
        if length == self.capacity:
            return [piece]
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            content = self._take(space)
            content.append(piece)
            if space == length:
                return content
            self._put(space - length, content)
            return None
        closed = None
        if self.open == self.open_bins:
            closed = self._take((self.free & -self.free).bit_length() - 1)
        self._put(self.capacity - length, [piece])
        return closed

    def rest(self) -> list[list]:
        """The bins that are still open."""
        return [content for space in sorted(self.by_free) for content in self.by_free[space]]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of `n` tokens; the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    full = [(at, capacity) for at in range(head, n, capacity)]
    return [(0, head), *full] if head else full


def _emit(kind: pa.DataType, round_no: int):
    """Collects closed bins; returns add(content, open) and take(force) for the batches."""
    rows: list[list] = [[] for _ in range(8)]
    state = {"bin": 0}
    prefix = (round_no << 56) | (TaskContext.get().partitionId() << 28)
    names = ["id", "piece", "start", "length", "ids", "sequence_id", "offset", "open"]
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]

    def add(content: list, still_open: bool) -> None:
        offset = 0
        for doc, piece, start, ids in content:
            length = len(ids) // 4
            for column, value in zip(rows, (doc, piece, start, length, ids, prefix | state["bin"], offset, still_open)):
                column.append(value)
            offset += length
        state["bin"] += 1

    def take(force: bool) -> pa.RecordBatch | None:
        if not rows[0] or not force and len(rows[0]) < BATCH:
            return None
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)
        for column in rows:
            column.clear()
        return batch

    return add, take


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per piece: id, piece, start, length, ids (packed unsigned 32-bit), sequence_id, offset."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, "
              "`offset` bigint, open boolean")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, out = shared_encoder(vocabulary), Packer(capacity, open_bins), None
        for batch in batches:
            out = out or _emit(batch.schema.field("id").type, 0)
            add, take = out
            for doc, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = encoder.encode(value.as_py()) + END
                for piece, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    closed = packer.add(length, (doc, piece, start, ids[4 * start:4 * (start + length)]))
                    if closed:
                        add(closed, False)
                        if ready := take(False):
                            yield ready
        if out:
            for content in packer.rest():
                out[0](content, True)
            if ready := out[1](True):
                yield ready

    def again(round_no: int):
        def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, out = Packer(capacity, open_bins), None
            for batch in batches:
                out = out or _emit(batch.schema.field("id").type, round_no)
                add, take = out
                for doc, piece, start, ids in zip(*(batch.column(c) for c in ("id", "piece", "start", "ids"))):
                    piece = (doc.as_py(), piece.as_py(), start.as_py(), ids.as_py())
                    closed = packer.add(len(piece[3]) // 4, piece)
                    if closed:
                        add(closed, False)
                        if ready := take(False):
                            yield ready
            if out:
                for content in packer.rest():
                    out[0](content, True)
                if ready := out[1](True):
                    yield ready
        return repacked

    packed = stored(slim.mapInArrow(first, schema), "packed")
    done = [packed.filter("not open")]
    left, parts, round_no = packed.filter("open"), packed.rdd.getNumPartitions(), 0
    while parts > 1:
        parts, round_no = -(-parts // GATHERED), round_no + 1
        # the longest pieces first: they are the hardest to place
        rest = left.repartition(parts).sortWithinPartitions(F.desc("length"), "id", "piece")
        left = stored(rest.mapInArrow(again(round_no), schema), "repacked")
        done.append(left.filter("not open"))
        left = left.filter("open")
    out = left
    for part in done:
        out = out.unionAll(part)
    return out.drop("open")
