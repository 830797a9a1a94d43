"""Planned items: verdict documents, similarity search, attribution and migration checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join
from tidewatch.operators.registry import orphans
from tidewatch.session import stored

# Rows per block: together some 150 MB of 768-wide vectors per task. Larger query
# blocks copy the corpus less often; the product is taken in slices of a block.
QUERY_BLOCK = 4_000
CORPUS_BLOCK = 20_000
SLICE = 256
#: Cells of the index: the square root of the corpus, but no more. Their centroids (6 MB at
#: 768 dimensions) go to every task.
MAX_CELLS = 1024
#: Similarities are rounded to six places; a bound that is lower by more cannot win.
SLACK = 2e-6


def verdict_documents(ar: DataFrame, ti: DataFrame, dns: DataFrame) -> DataFrame:
    """One summary text per verdict, from its newest indicator's DNS query.

    The address is kept as a payload column but never becomes part of the text.
    Optional columns of `ar` (owner, family, rationale) are included if present.
    """
    newest = ti.groupBy(F.col("analysis_result_id").alias("verdict_id")).agg(
        F.max_by("dns_query_id", F.struct("last_scan", "id")).alias("dns_query_id"),
        F.max("last_scan").alias("last_scan"))
    seen = dns.select(F.col("id").alias("dns_query_id"), F.col("domain").alias("fqdn"),
                      F.col("response_ip").alias("observable_ip"))
    rows = (ar.withColumnRenamed("id", "verdict_id").join(newest, "verdict_id", "left")
            .join(seen, "dns_query_id", "left"))
    optional = [c for c in ("vt_owner", "malware_family") if c in ar.columns]
    reason = [c for c in ("scoring_rationale",) if c in ar.columns]
    parts = ["fqdn", "threat_label", F.concat(F.lit("score "), F.col("threat_score").cast("string")),
             *optional, "verdict_summary_en", *reason, F.date_format("last_scan", "yyyy-MM-dd HH:mm:ss")]
    return rows.select("verdict_id", "observable_ip", "threat_score", "last_scan",
                       F.concat_ws(" | ", *parts).alias("document"))


def missing_embeddings(ar: DataFrame, meta: DataFrame) -> DataFrame:
    """Verdicts that no embedding exists for; `meta` has verdict_id."""
    return ar.join(meta.select(F.col("verdict_id").alias("id")), "id", "left_anti")


def verdict_corpus(vectors: DataFrame, ar: DataFrame, ti: DataFrame, now: Column, min_score: int = 3,
                   days: int = 30) -> DataFrame:
    """Vectors of verdicts of at least `min_score` that were scanned in the last `days` days."""
    recent = (ti.filter(F.col("last_scan") > now - F.make_dt_interval(F.lit(days)))
              .select(F.col("analysis_result_id").alias("verdict_id")).distinct())
    scored = ar.filter(F.col("threat_score") >= min_score).select(F.col("id").alias("verdict_id"), "threat_score")
    return vectors.join(scored, "verdict_id").join(recent, "verdict_id", "left_semi")


@dataclass(frozen=True)
class CellIndex:
    """A corpus cut into cells around centroids.

    `rows` (verdict_id, vector, cell, part) is stored; a part of a cell holds no more than about
    `CORPUS_BLOCK` rows. `low` and `high` are the smallest and largest angle between a cell's
    centroid and its vectors, `sizes` and `parts` its rows and parts.
    """
    rows: DataFrame
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    parts: np.ndarray

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """The largest similarity that each vector (row) can have in each cell (column).

        By the triangle inequality of angles, a vector of the cell is at least as far away as
        the angle to the centroid lies outside the cell's range.
        """
        angles = np.arccos(np.clip(units @ self.centroids.T, -1, 1))
        return np.cos(np.maximum(np.maximum(angles - self.high, self.low - angles), 0))


def cell_index(corpus: DataFrame) -> CellIndex | None:
    """The index of a corpus (verdict_id, vector), None if no vector of it has a direction.

    Centroids are the vectors with the smallest hashes of their ids, a sample of bounded
    size; every vector goes to the nearest one.
    """
    corpus = stored(_with_direction(corpus.select("verdict_id", "vector")), "corpus")
    n = corpus.count()
    if not n:
        return None
    drawn = corpus.orderBy(F.xxhash64("verdict_id"), "verdict_id").limit(min(MAX_CELLS, isqrt(n - 1) + 1)).select("vector")
    centroids = np.unique(_unit_rows(drawn.toPandas()["vector"]), axis=0)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosines = _unit_rows(batch["vector"]) @ centroids.T
                nearest = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(batch)), nearest], -1, 1))
                yield batch.assign(cell=nearest.astype(np.int32), angle=angle)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.schema)
    rows = stored(corpus.mapInPandas(placed, f"{fields}, cell int, angle double"), "cells")
    low, high, sizes = np.full(len(centroids), np.pi), np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for cell in rows.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect():
        low[cell[0]], high[cell[0]], sizes[cell[0]] = cell[1:]
    parts = np.maximum(1, -(-sizes // CORPUS_BLOCK))
    known = F.array(*(F.lit(int(p)) for p in parts))
    part = F.pmod(F.xxhash64("verdict_id"), F.get(known, F.col("cell"))).cast("int")
    return CellIndex(rows.select("verdict_id", "vector", "cell", part.alias("part")), centroids, low, high, sizes, parts)


def visits(queries: DataFrame, index: CellIndex, k: int, floor: float) -> DataFrame:
    """`query_id`, `cell` of the cells that a query looks at.

    Without a column `found` these are its most promising cells, until they hold `k` vectors.
    With it (the `k`-th best similarity so far, NULL if there are fewer) they are the other
    cells that can hold a better one. A bound below `floor` is never looked at.
    """
    second = "found" in queries.columns
    held = CellIndex(None, index.centroids, index.low, index.high, index.sizes, index.parts)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                some = batch[start:start + SLICE]
                bounds = held.bounds(_unit_rows(some["vector"]))
                bounds[:, held.sizes == 0] = -2
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(held.sizes[order], axis=1) - held.sizes[order]
                first = np.zeros(bounds.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                wanted = (bounds >= floor - SLACK) & first
                if second:
                    found = some["found"].to_numpy(np.float64, na_value=-1.0)
                    wanted = (bounds >= np.maximum(found, floor)[:, None] - SLACK) & ~first & (bounds > -2)
                row, cell = np.nonzero(wanted)
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[row], "cell": cell.astype(np.int32)})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(chosen, f"query_id {kind}, cell int")


def _sliced(queries: DataFrame, index: CellIndex) -> DataFrame:
    """Adds `slice`: about `QUERY_BLOCK` queries each, neighbours together, so that a slice looks at few cells."""
    centroids = index.centroids

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = (_unit_rows(batch["vector"]) @ centroids.T).argmax(axis=1)
                yield batch.assign(near=near.astype(np.int32))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    queries = stored(queries.mapInPandas(nearest, f"{fields}, near int"), "queries")
    sizes = np.zeros(len(centroids), np.int64)
    for cell in queries.groupBy("near").count().collect():
        sizes[cell[0]] = cell[1]
    first = (np.cumsum(sizes) - sizes) // QUERY_BLOCK
    parts = np.maximum(1, -(-sizes // QUERY_BLOCK))
    known = [F.get(F.array(*(F.lit(int(x)) for x in values)), F.col("near")) for values in (first, parts)]
    return queries.withColumn("slice", (known[0] + F.pmod(F.xxhash64("query_id"), known[1])).cast("int")).drop("near")


def _looked_up(queries: DataFrame, wanted: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """The best `k` of each wanted cell part for each query; a block of vectors on either side is one group."""
    wanted = stored(wanted, "visits")
    parts = F.array(*(F.lit(int(p)) for p in index.parts))
    left = spread_join(wanted, queries, ["query_id"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)))
    pairs = spread_join(wanted, queries.select("query_id", "slice"), ["query_id"]).select("cell", "slice").distinct()
    right = index.rows.join(pairs, "cell").select("verdict_id", "vector", F.col("cell").alias("c"), F.col("part").alias("p"),
                                                  F.col("slice").alias("s"))
    id_types = [queries.schema["query_id"].dataType.simpleString(), index.rows.schema["verdict_id"].dataType.simpleString()]

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _block_top_k(q, c, k)

    return left.groupBy("cell", "part", "slice").cogroup(right.groupBy("c", "p", "s")).applyInPandas(
        best, f"query_id {id_types[0]}, verdict_id {id_types[1]}, similarity double")


def top_similar(queries: DataFrame, corpus: DataFrame, k: int = 5, min_similarity: float | None = None) -> DataFrame:
    """Exact top `k` of the corpus per query by cosine, rounded to six places, lower id on a tie.

    Queries (query_id, vector) and corpus (verdict_id, vector) have one row per id. The corpus
    is cut into cells around centroids. A query first looks at its most promising cells; its
    `k`-th best there then rules out every cell whose angular bound is lower, and only the
    others are looked at. Vectors meet in blocks of bounded size on both sides, as a matrix
    product that passes on `k` rows per query; no pair of vectors becomes a row and neither
    side is broadcast. Vectors that are NULL, hold a NULL or have no length have no direction:
    such queries and entries have no result.
    """
    floor = -1.0 if min_similarity is None else min_similarity
    queries = _with_direction(queries.select("query_id", "vector"))
    index = cell_index(corpus)
    if index is None:
        kind = corpus.schema["verdict_id"].dataType.simpleString()
        return queries.filter("false").select("query_id", F.lit(None).cast(kind).alias("verdict_id"),
                                              F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("rank"))
    queries = stored(_sliced(queries, index), "sliced")
    near = stored(_looked_up(queries, visits(queries.select("query_id", "vector"), index, k, floor), index, k), "near")
    smallest = F.expr(f"get(array_sort(collect_list(-similarity)), {k - 1})")
    found = near.groupBy("query_id").agg((-smallest).alias("found"))
    open_queries = spread_join(queries.select("query_id", "vector"), found, ["query_id"], "left")
    rest = _looked_up(queries, visits(open_queries, index, k, floor), index, k)
    both = near.unionAll(rest)
    if min_similarity is not None:
        both = both.filter(F.col("similarity") >= min_similarity)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "verdict_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def _with_direction(df: DataFrame) -> DataFrame:
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return df.filter(squares > 0)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _block_top_k(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k per query within one pair of blocks; sorting by id first settles ties."""
    if q.empty or c.empty:
        return pd.DataFrame({"query_id": q["query_id"][:0], "verdict_id": c["verdict_id"][:0],
                             "similarity": np.zeros(0)})
    c = c.sort_values("verdict_id")
    left, right, names = _unit_rows(q["vector"]), _unit_rows(c["vector"]).T, c["verdict_id"].to_numpy()
    parts = []
    for start in range(0, len(q), SLICE):
        sims = np.round(left[start:start + SLICE] @ right, 6)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        parts.append(pd.DataFrame({
            "query_id": np.repeat(q["query_id"].to_numpy()[start:start + SLICE], order.shape[1]),
            "verdict_id": names[order.ravel()],
            "similarity": np.take_along_axis(sims, order, axis=1).ravel()}))
    return pd.concat(parts)


def similar_verdicts(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Historical context: the most similar earlier verdicts of each observable."""
    return top_similar(queries, corpus, k)


def reference_material(queries: DataFrame, knowledge: DataFrame, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """Knowledge-base entries that are at least as similar as `threshold`."""
    return top_similar(queries, knowledge, k, threshold)


def attribute_users(dns: DataFrame, devices: DataFrame) -> DataFrame:
    """DNS rows with the user of the client address, NULL if unknown.

    Replies carry no client. As they are most of the rows and share one value,
    each gets a key of its own that no device has, which spreads them evenly.
    """
    key = F.when(F.col("source_ip") == "N/A", F.concat(F.lit("N/A#"), F.col("id").cast("string")))
    keyed = dns.withColumn("_client", F.coalesce(key, F.col("source_ip")))
    known = devices.filter("source_ip <> 'N/A'").withColumnRenamed("source_ip", "_client")
    return keyed.join(known, "_client", "left").drop("_client")


def hash_mismatches(current: DataFrame, master: DataFrame) -> DataFrame:
    """Files whose latest hash differs from the master list, or that one side lacks.

    `current` has path, hash, seen_at and may hold many observations of a file;
    they are reduced to the latest before the join; of several at one time, the
    greatest hash counts.
    """
    now = current.groupBy("path").agg(F.max(F.struct("seen_at", "hash"))["hash"].alias("current_hash"))
    known = master.select("path", F.col("hash").alias("master_hash"))
    both = now.join(known, "path", "full_outer").filter(~F.col("current_hash").eqNullSafe(F.col("master_hash")))
    status = (F.when(F.col("current_hash").isNull(), "missing")
              .when(F.col("master_hash").isNull(), "unexpected").otherwise("changed"))
    return both.withColumn("status", status)


def verdict_equivalence(a: DataFrame, b: DataFrame, gate: float = 0.95) -> DataFrame:
    """Share of observables on which two runs agree; a verdict on one side only is a difference.

    Both sides have dns_query_id, threat_score, last_scan; the newest score counts.
    """
    def newest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("dns_query_id").agg(F.max(F.struct("last_scan", "threat_score"))["threat_score"].alias(name))

    both = newest(a, "a").join(newest(b, "b"), "dns_query_id", "full_outer")
    same = F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0))
    rate = same / F.count("*")
    return both.agg(F.count("*").alias("observables"), same.alias("equivalent"),
                    F.round(rate, 4).alias("rate"), (rate >= gate).alias("passed"))


def migration_report(old: dict[str, DataFrame], new: dict[str, DataFrame], raw: DataFrame) -> DataFrame:
    """Checks after a move: row counts per table, reachable indicator links, payloads with content.

    Each check is one row with the expected and the found number of rows.
    """
    def size(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count("*").alias(side))

    checks = [(f"rows {name}", size(df, "expected"), size(new[name], "found")) for name, df in old.items()]
    nothing = F.lit(0).cast("bigint").alias("expected")
    lost = orphans(new["threat_indicator_details"], new["threat_indicators"], "indicator_id")
    empty = raw.filter(F.try_variant_get(F.try_parse_json("raw_data"), "$.data", "variant").isNull())
    rows = None
    for name, expected, found in [*checks, ("unreachable indicator links", None, size(lost, "found")),
                                  ("payloads without data", None, size(empty, "found"))]:
        # Both sides are one aggregated row; a scalar subquery puts them side by side.
        wanted = nothing if expected is None else expected.scalar().alias("expected")
        row = found.select(F.lit(name).alias("check"), wanted, "found")
        rows = row if rows is None else rows.unionAll(row)
    return rows.withColumn("ok", F.col("expected") == F.col("found"))
