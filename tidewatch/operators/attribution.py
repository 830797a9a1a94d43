"""Who asked: replies joined to the query they answer, as of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import spread_join


def _second(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def last_query(replies: DataFrame, queries: DataFrame, within: int, domain: str = "domain", ts: str = "timestamp",
               key: str = "id", client: str = "source_ip") -> DataFrame:
    """Replies with `asked_by`, `asked_at` and `query_id` of the last query of their domain, at most `within` seconds ago.

    A query of the reply's own second counts; of several queries in one second the greatest
    key is taken. Replies without such a query, or without domain or time, keep NULLs;
    domains are compared without regard to case.

    Queries are first reduced to one per domain and second, where they are. Time is cut into
    buckets as long as the bound, so a reply finds all it can take in its own bucket and the
    one before; the queries of these are one sorted list of at most two bucket lengths of
    seconds, however many there were. Replies are joined to the lists by an equi-join in which
    a hot domain can be split; they never meet in one group.
    """
    if within < 1:
        raise ValueError("within must be a second at least")
    asked = queries.select(F.lower(domain).alias("_name"), _second(ts).alias("s"), F.col(key).alias("k"),
                           F.col(client).alias("c")).filter("_name is not null and s is not null")
    asked = asked.groupBy("_name", "s").agg(F.max(F.struct("k", "c")).alias("q"))
    bucket = F.expr(f"s div {within} - if(s < 0 and s % {within} <> 0, 1, 0)")
    placed = asked.withColumn("b", bucket).select(
        "_name", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("_bucket"), F.struct("s", "q.k", "q.c").alias("e"))
    lists = placed.groupBy("_name", "_bucket").agg(F.sort_array(F.collect_list("e")).alias("_asked"))
    rows = replies.withColumns({"_name": F.lower(domain), "_at": _second(ts)})
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / within))
    joined = spread_join(rows, lists, ["_name", "_bucket"], "left")
    fits = F.filter("_asked", lambda e: (e["s"] <= F.col("_at")) & (e["s"] >= F.col("_at") - within))
    found = joined.withColumn("_found", F.try_element_at(fits, F.lit(-1)))
    return found.withColumns({
        "asked_by": F.col("_found.c"), "query_id": F.col("_found.k"),
        "asked_at": F.timestamp_seconds("_found.s").cast("timestamp_ntz"),
    }).drop("_name", "_at", "_bucket", "_asked", "_found")


def attribute_replies(dns: DataFrame, devices: DataFrame, within: int) -> DataFrame:
    """Reply rows of a DNS table with the client that asked and its user, NULL if unknown.

    `devices` has source_ip, user_name, device; several devices on one address give a row each.
    """
    replies, queries = (dns.filter(F.col("query_type") == kind) for kind in ("reply", "query"))
    found = last_query(replies, queries, within)
    known = devices.filter("source_ip is not null").withColumnRenamed("source_ip", "_client")
    # replies that nobody asked for get a key each, which spreads them
    key = F.coalesce("asked_by", F.concat(F.lit("none#"), F.col("id").cast("string")))
    return found.withColumn("_client", key).join(known, "_client", "left").drop("_client")
