"""Replies joined to the query they answer, against a plain search."""

import random
from datetime import datetime, timedelta

import pytest

from tidewatch.operators import attribution

START = datetime(2024, 1, 1)
QUERY = "id long, timestamp timestamp_ntz, query_type string, domain string, source_ip string"


def plain(replies, queries, within):
    found = []
    for key, at, _, name, _ in replies:
        fits = [(t, k, c) for k, t, _, n, c in queries if None not in (name, n, at, t) and n.lower() == name.lower()
                and 0 <= (at - t).total_seconds() <= within]
        last = max(fits, default=(None, None, None))
        found.append((key, last[1], last[2], last[0]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("within,spread", [(5, 60), (60, 400), (3_600, 20_000), (1, 30)])
def test_last_query_equals_a_plain_search(spark, rows, within, spread):
    draw = random.Random(within)
    names = ["a.com", "A.com", "b.com", "c.com", None]
    data = [(i, START + timedelta(seconds=draw.randrange(-spread, spread)) if i % 17 else None,
             draw.choice(["query", "reply"]), draw.choice(names), f"10.0.0.{draw.randrange(5)}") for i in range(600)]
    queries = [r for r in data if r[2] == "query"]
    replies = [r for r in data if r[2] == "reply"]
    found = attribution.last_query(spark.createDataFrame(replies, QUERY), spark.createDataFrame(queries, QUERY), within)
    expected = plain(replies, queries, within)
    assert rows(found, "id", "query_id", "asked_by", "asked_at") == expected
    assert 20 < sum(e[1] is not None for e in expected) < len(expected)


def test_the_greatest_key_of_a_second_and_fractions_of_it(spark, rows):
    at = START + timedelta(seconds=10, microseconds=900_000)
    queries = spark.createDataFrame([(1, START + timedelta(seconds=10), "query", "a.com", "x"),
                                     (2, START + timedelta(seconds=10), "query", "a.com", "y"),
                                     (2, START + timedelta(seconds=10), "query", "a.com", "y")], QUERY)
    replies = spark.createDataFrame([(7, at, "reply", "a.com", "N/A"), (7, at, "reply", "a.com", "N/A"),
                                     (8, START, "reply", "a.com", "N/A")], QUERY)
    found = attribution.last_query(replies, queries, 60)
    assert rows(found, "id", "query_id", "asked_by") == [(7, 2, "y"), (7, 2, "y"), (8, None, None)]
    assert attribution.last_query(replies, queries.limit(0), 60).filter("asked_by is null").count() == 3
    assert attribution.last_query(replies.limit(0), queries, 60).count() == 0


def test_devices_of_replies(spark, rows):
    dns = spark.createDataFrame([(1, START, "query", "a.com", "10.0.0.1"), (2, START, "reply", "a.com", "N/A"),
                                 (3, START, "query", "b.com", "10.0.0.2"), (4, START, "reply", "b.com", "N/A"),
                                 (5, START, "reply", "c.com", "N/A")], QUERY)
    devices = spark.createDataFrame([("10.0.0.1", "ann", "pc"), ("10.0.0.1", "ann", "phone"), (None, "nobody", "-"),
                                     ("N/A", "nobody", "-")], "source_ip string, user_name string, device string")
    found = attribution.attribute_replies(dns, devices, 60)
    assert rows(found, "id", "asked_by", "user_name", "device") == sorted(
        [(2, "10.0.0.1", "ann", "pc"), (2, "10.0.0.1", "ann", "phone"), (4, "10.0.0.2", None, None),
         (5, None, None, None)], key=repr)


def test_lists_are_bounded_by_time_not_by_rows(spark):
    """A hot domain: a third of a million rows in one minute are one entry a second."""
    hot = spark.range(200_000).selectExpr("id", f"timestamp_ntz '{START}' + make_interval(0, 0, 0, 0, 0, 0, id % 60) as timestamp",
                                          "'query' as query_type", "'hot.com' as domain", "concat('c', id) as source_ip")
    replies = hot.selectExpr("id", "timestamp", "'reply' as query_type", "domain", "'N/A' as source_ip")
    found = attribution.last_query(replies, hot, 60)
    assert found.filter("query_id % 60 <> id % 60 or query_id < 199940").count() == 0 and found.count() == 200_000
