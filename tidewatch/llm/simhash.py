"""Near-duplicates by SimHash, with pivot distance tables.

Every distinct fingerprint is given its Hamming distances to a row of reference
fingerprints (pivots). Two fingerprints that differ in at most 3 bits differ by at
most 3 in every one of these coordinates (triangle inequality), so a pair whose
largest coordinate difference is above 3 is discarded; survivors are verified bit
by bit. In 64 dimensions all coordinates lie near 32, so they separate pairs well
but cannot say which pairs to look at. Candidates therefore meet in buckets: of
five blocks of the 64 bits, three differing bits leave at least two untouched, so a
linked pair agrees on one of ten pairs of blocks. Nothing linked is lost.

A bucket never emits all its pairs. First each member is tested against the smallest
and the largest fingerprint of its bucket, and these stars are joined to components.
Then only members outside the component of their bucket's majority are paired with
the rest, so a dense group of near copies costs a row per copy and bucket. A bucket of
more than 64 members that are not one component is dealt anew: its free bits are cut
into four parts, of which three differing bits leave one untouched, and members meet
where a part agrees, too. Three such rounds fix 48 bits or more, so that the members
that one fingerprint can meet are bounded whatever the data.

Defined cases: NULL and empty texts have no words and the fingerprint zero, which is
linked like any other; repeated rows and NULL ids keep their rows, a component's id
is the smallest id that is not NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.llm.graph import components
from tidewatch.session import stored

MAX_BITS = 3
SHINGLE = 3
PIVOTS = 16
#: Widths of the five bit blocks; two of them form a bucket.
BLOCKS = [13, 13, 13, 13, 12]
#: Members of a bucket that are paired without dealing the bucket anew, and rounds of dealing.
BUCKET, ROUNDS = 64, 3
#: Windows hashed at a time; bounds the memory for one very long text.
SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, SLICE):
        stop = min(at + SLICE, total)
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1:stop + width - 1].tolist())
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, stop - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
        keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), marks],
            names=[*(batch.schema.names[i] for i in keep), "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and `fp` (the signed 64-bit fingerprint) of every row."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_fingerprints, f"id {kind}, fp bigint")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the XXH64 of their index, signed."""
    return [int(np.array(xxhash.xxh64_intdigest(str(i), 0), np.uint64).view(np.int64)) for i in range(n)]


def distance_table(fps: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Adds the coordinates `p`: the number of bits in which `fp` differs from each pivot."""
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("bigint"))).cast("tinyint") for p in pivots(n)]
    return fps.withColumn("p", F.array(*distances))


def _near(a: str, b: str, n: int, most: int) -> Column:
    """Coordinates first, then the bits themselves."""
    near = F.lit(True)
    for i in range(n):
        near = near & (F.abs(F.get(f"{a}.p", F.lit(i)).cast("int") - F.get(f"{b}.p", F.lit(i)).cast("int")) <= most)
    return near & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= most)


def _bucket_masks() -> list[int]:
    """For each pair of blocks the mask of its bits."""
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(masks, 2)]


def _narrower(masks: list[int]) -> list[int]:
    """Each mask with one quarter of its free bits added, four in a row for each."""
    out = []
    for mask in masks:
        free = [i for i in range(64) if not mask >> i & 1]
        for k in range(4):
            part = free[k * len(free) // 4:(k + 1) * len(free) // 4]
            out.append(mask | sum(1 << i for i in part))
    return out


def _masked(fp: str, mask: Column) -> Column:
    return F.col(fp).bitwiseAND(mask)


def _literals(masks: list[int]) -> list[Column]:
    return [F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks]


def _bucket_keys() -> list[Column]:
    """For each pair of blocks, its number and the bits of the two blocks."""
    return [F.struct(F.lit(i).cast("int").alias("t"), _masked("fp", mask).alias("bits"))
            for i, mask in enumerate(_literals(_bucket_masks()))]


def _dealt(large: DataFrame, masks: list[int]) -> DataFrame:
    """Members of large buckets in the four narrower buckets of each; `masks` are those of the new round."""
    known = F.array(*_literals(masks))
    number = F.explode(F.array(*(F.col("t") * 4 + F.lit(k) for k in range(4)))).alias("t")
    rows = large.select(number, "x", "label")
    return rows.select("t", _masked("x.fp", F.get(known, F.col("t"))).alias("bits"), "x", "label")


def _across(open_buckets: DataFrame, most: int, n: int) -> DataFrame:
    """Labels `u`, `v` of linked members (`t`, `bits`, `x`, `label`) of one bucket with different labels."""
    masks, out = _bucket_masks(), None
    for at in range(ROUNDS + 1):
        major = open_buckets.groupBy("t", "bits", "label").agg(F.count("*").alias("n")).groupBy("t", "bits").agg(
            F.max(F.struct("n", "label"))["label"].alias("major"), F.count("*").alias("labels"),
            F.sum("n").alias("members"))
        # buckets that are one component already need no further pairs
        split = spread_join(open_buckets, major.filter("labels > 1").drop("labels"), ["t", "bits"])
        split = stored(split, "split-buckets")
        ready = split if at == ROUNDS else split.filter(F.col("members") <= BUCKET)
        a = ready.filter(F.col("label") != F.col("major")).select("t", "bits", F.col("x").alias("a"),
                                                                  F.col("label").alias("la"))
        b = ready.select("t", "bits", F.col("x").alias("b"), F.col("label").alias("lb"))
        pairs = a.join(b, ["t", "bits"]).filter((F.col("la") != F.col("lb")) & _near("a", "b", n, most))
        found = pairs.select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct()
        out = found if out is None else out.unionAll(found)
        large = split.filter(F.col("members") > BUCKET)
        if at == ROUNDS or large.isEmpty():
            return out
        masks = _narrower(masks)
        open_buckets = _dealt(large, masks)


def links(fps: DataFrame, most: int = MAX_BITS, n: int = PIVOTS) -> DataFrame:
    """`node`, `component` over distinct fingerprints, for those that have a partner."""
    if most >= len(BLOCKS) - 1:
        raise ValueError("the blocks find at most three differing bits")
    placed = fps.select("fp").distinct().select("fp", F.explode(F.array(*_bucket_keys())).alias("k"))
    placed = stored(placed.select("k.t", "k.bits", "fp"), "placed")
    shared = placed.groupBy("t", "bits").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = stored(shared, "buckets")
    # only fingerprints that share a bucket need coordinates
    members = distance_table(spread_join(placed, shared, ["t", "bits"]), n)
    members = stored(members.select("t", "bits", F.struct("fp", "p").alias("x")), "pivot-table")
    ends = members.groupBy("t", "bits").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    members = stored(spread_join(members, ends, ["t", "bits"]), "members")
    stars = members.filter((F.col("x.fp") != F.col("low.fp")) & _near("x", "low", n, most)).select(
        F.col("x.fp").alias("u"), F.col("low.fp").alias("v"))
    stars = stars.unionAll(
        members.filter((F.col("x.fp") != F.col("high.fp")) & _near("x", "high", n, most)).select(
            F.col("x.fp").alias("u"), F.col("high.fp").alias("v")))
    found = stored(components(stars), "stars")
    labelled = spread_join(members.select("t", "bits", "x", F.col("x.fp").alias("node")), found, ["node"], "left")
    labelled = stored(labelled.select("t", "bits", "x", F.coalesce("component", "node").alias("label")), "labelled")
    across = _across(labelled, most, n)
    return components(across.unionAll(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def _grouped(marked: DataFrame, most: int, n: int) -> DataFrame:
    """`fp` and `root` (one fingerprint per component) of every distinct fingerprint of stored rows."""
    nodes = links(marked, most, n).select(F.col("node").alias("fp"), F.col("component").alias("linked"))
    return stored(marked.select("fp").distinct().join(nodes, "fp", "left")
                  .select("fp", F.coalesce("linked", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_BITS,
                    n: int = PIVOTS) -> DataFrame:
    """`id`, `fp` and `component` (smallest id reachable) of every row."""
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    roots = _grouped(marked, most, n)
    smallest = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = roots.join(smallest, "fp")
    named = roots.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(roots.select("fp", "root").join(named, "root").select("fp", "component"), "components")
    return spread_join(marked, named, ["fp"]).select("id", "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_BITS,
                n: int = PIVOTS) -> DataFrame:
    """The rows of `docs`, one per component: that of the smallest id, whatever is repeated.

    The rows are stored once with a number of their own, so that equal rows are told
    apart and the texts are moved by one join on that number.
    """
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(row, F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = stored(rows, "numbered")
    marked = stored(fingerprints(rows.select(F.struct(F.col(f"row.{key}").alias("key"), "at").alias("id"), "text"),
                                 "id", "text"), "fingerprints")
    roots = _grouped(marked, most, n)
    # NULL ids come after all others
    order = F.struct(F.col("id.key").isNull().alias("none"), F.col("id.key").alias("key"), F.col("id.at").alias("at"))
    first = marked.groupBy("fp").agg(F.min(order).alias("first")).join(roots, "fp")
    kept = first.groupBy("root").agg(F.min("first")["at"].alias("at"))
    return rows.join(kept.select("at"), "at", "left_semi").select("row.*")
