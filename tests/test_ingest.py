import random
import re
from datetime import datetime

import pytest

from tidewatch.functions.net import ACCESS_RANGES, PRIVATE_RANGES, in_cidr, is_ipv4
from tidewatch.functions.times import ntz
from tidewatch.sources import lists, logs, raw_reports
from tidewatch.streaming import jobs

NOW = "2026-08-31 10:00:00"
CASES = [
    ("query[A] d1.example.com from 192.168.1.2", ("query", "A", "d1.example.com", "192.168.1.2", None)),
    ("reply d1.example.com is 1.2.3.4", ("reply", "A", "d1.example.com", "N/A", "1.2.3.4")),
    ("forwarded x to 10.10.10.2", None),
    ("query[type=65] z.com from 192.168.1.2", None),
    ("reply c.com is <CNAME>", ("reply", "OTHER", "c.com", "N/A", "<CNAME>")),
    ("reply n.com is NXDOMAIN", ("reply", "N/A", "n.com", "N/A", "NXDOMAIN")),
    ("reply v6.com is 2001:db8::1", ("reply", "AAAA", "v6.com", "N/A", "2001:db8::1")),
    ("reply m.com is ::ffff:1.2.3.4", ("reply", "AAAA", "m.com", "N/A", "::ffff:1.2.3.4")),
    ("reply 1.1.168.192.in-addr.arpa is host.lan",
     ("reply", "A", "1.1.168.192.in-addr.arpa", "N/A", "host.lan")),
    ("reply e.com is NODATA-IPv6", ("reply", "OTHER", "e.com", "N/A", "NODATA-IPv6")),
    ("reply e.com is NODATA", ("reply", "OTHER", "e.com", "N/A", "NODATA")),
    ("query[HTTPS]   h.com \t from   10.0.0.1 tail", ("query", "HTTPS", "h.com", "10.0.0.1", None)),
    ("reply [x] y from z", None),
    ("", None),
]


@pytest.mark.parametrize("line,expected", CASES)
def test_parse_line(spark, line, expected):
    lines = spark.createDataFrame([("Jan 1 00:00:00 dnsmasq[7]: " + line,)], "value string")
    found = logs.parse_dns_lines(lines, ntz(NOW)).collect()
    if expected is None:
        assert found == []
    else:
        assert [tuple(r)[1:] for r in found] == [expected]
        assert found[0].timestamp == datetime(2026, 8, 31, 10)


def test_parse_random_lines_like_a_plain_search(spark):
    """The same pattern and rules applied line by line in Python."""
    rnd = random.Random(11)
    words = ["query", "reply", "query[A]", "reply[AAAA]", "query[a]", "from", "is", "to", "d.com", "1.2.3.4", "::1",
             "<CNAME>", "NODATA", "NXDOMAIN", "cached", "reply[X]y"]
    texts = ["".join(w + rnd.choice([" ", "  ", "\t"]) for w in rnd.choices(words, k=rnd.randrange(2, 9)))
             for _ in range(3000)]

    def plain(text):
        found = re.search(logs.LINE_PATTERN, text)
        if not found:
            return None
        action, kind, domain, value = found.groups()
        if not kind:
            kind = ("N/A" if value == "NXDOMAIN" else "AAAA" if ":" in value
                    else "A" if "." in value and value not in ("<CNAME>", "NODATA") else "OTHER")
        return action, kind, domain, value if action == "query" else "N/A", value if action == "reply" else None

    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    found = [tuple(r)[1:] for r in logs.parse_dns_lines(lines, ntz(NOW)).collect()]
    expected = [row for row in map(plain, texts) if row]
    assert len(expected) > 100 and sorted(found, key=repr) == sorted(expected, key=repr)


def test_long_domain_is_rejected_and_kept_apart(spark, tmp_path):
    lines = spark.createDataFrame(
        [(f"reply {'a' * n} is 1.2.3.4",) for n in (255, 256)], "value string")
    path = str(tmp_path / "dns")
    logs.write_dns(logs.parse_dns_lines(lines, ntz(NOW)), path)
    assert [len(r.domain) for r in logs.read_dns(spark, path).collect()] == [255]
    assert [len(r.domain) for r in logs.read_dns(spark, path, "rejected").collect()] == [256]
    assert {str(r.ym) for r in logs.read_dns(spark, path).collect()} == {"202608"}


def test_stored_rows_have_lower_case_and_whole_seconds(spark, tmp_path):
    lines = spark.createDataFrame([("reply MiXed.Com is 1.2.3.4",)], "value string")
    path = str(tmp_path / "dns")
    for text in ("2026-08-31 23:59:59.500000", "2026-08-31 10:00:00.499999"):
        logs.write_dns(logs.parse_dns_lines(lines, ntz(text)), path)
    stored = logs.read_dns(spark, path).orderBy("timestamp").collect()
    assert [(r.timestamp, r.domain, r.ym) for r in stored] == [
        (datetime(2026, 8, 31, 10), "mixed.com", "202608"), (datetime(2026, 9, 1), "mixed.com", "202609")]


@pytest.mark.parametrize("text,expected", [
    ("0.0.0.0", True), ("255.255.255.255", True), ("010.001.2.3", True), ("256.1.1.1", False), ("999.1.2.3", False),
    ("1.2.3", False), ("1.2.3.4.5", False), ("2001:db8::1", False), ("1.2.3.4 ", False), (None, False)])
def test_is_ipv4(spark, text, expected):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(is_ipv4(df.a)).first()[0] is expected


@pytest.mark.parametrize("text,private,allowed", [
    ("192.168.3.4", True, True), ("192.169.0.1", False, False), ("172.15.255.255", False, False),
    ("172.16.0.0", True, False), ("172.31.255.255", True, False), ("172.32.0.0", False, False),
    ("10.10.10.77", True, True), ("10.10.11.1", True, False), ("010.1.2.3", True, False),
    ("127.0.0.1", False, True), ("127.0.0.2", False, False), ("169.254.9.9", True, False),
    ("100.1.2.3", False, False), ("10.1.2.3.4", False, False), ("fd12::1", True, False), ("FE80::1", True, False),
    ("febf::1", True, False), ("fec0::1", False, False), ("fd::1", False, False), ("::1", False, False),
    ("N/A", False, False), (None, False, False)])
def test_ranges(spark, text, private, allowed):
    df = spark.createDataFrame([(text,)], "a string")
    assert tuple(df.select(in_cidr(df.a, PRIVATE_RANGES), in_cidr(df.a, ACCESS_RANGES)).first()) == (private, allowed)


def test_range_octets_against_every_value(spark):
    df = spark.range(256).selectExpr("concat('172.', id, '.0.9') AS a", "id")
    inside = {r.id for r in df.filter(in_cidr(df.a, ["172.16.0.0/12"])).collect()}
    assert inside == set(range(16, 32))
    df = spark.range(256).selectExpr("concat('10.0.0.', id) AS a", "id")
    assert {r.id for r in df.filter(in_cidr(df.a, ["10.0.0.64/27"])).collect()} == set(range(64, 96))


def test_text_that_is_no_range_is_refused(spark):
    with pytest.raises(ValueError):
        in_cidr(spark.range(1).id, ["2001:db8::/129"])


def test_blocklists(spark, rows):
    text = ["# comment", "", "0.0.0.0 Ads.example.com # why", "127.0.0.1 localhost", "plain.example.com ",
            "0.0.0.0 ads.example.com", "::1 a.example.com b.example.com"]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    assert rows(lists.compile_blocklist(lines)) == [
        ("a.example.com",), ("ads.example.com",), ("b.example.com",), ("plain.example.com",)]


def test_list_addresses_and_seeds_are_idempotent(spark, rows, tmp_path):
    file = tmp_path / "lists.txt"
    file.write_text(" https://a/x \n\n   \nhttps://b/y\nhttps://a/x\n")
    loaded = lists.load_blocklist_sources(spark, str(file))
    assert rows(loaded) == [("https://a/x", 1), ("https://b/y", 1)]
    again = lists.seed_dictionary(loaded, loaded, "address")
    assert rows(again) == rows(loaded)


def _docs(spark, data):
    return spark.createDataFrame(
        data, "doc_id string, resource string, type string, source_provider string, scan_date string, raw_data string")


def test_latest_raw_prefers_newest_then_higher_id(spark, rows):
    docs = _docs(spark, [("1", "r", "IP", "A", "2024-01-01", "x"), ("2", "r", "IP", "B", "2024-01-02", "y"),
                         ("3", "r", "IP", "A", "2024-01-02", "z"), ("4", "s", "IP", "A", "2023-01-01", "x")])
    assert rows(raw_reports.latest_raw(docs), "resource", "doc_id") == [("r", "3"), ("s", "4")]
    wide = raw_reports.latest_by_provider(docs, {"a": "A", "b": "B"})
    assert rows(wide, "resource", "a_doc_id", "b_doc_id") == [("r", "3", "2"), ("s", "4", None)]
    assert rows(raw_reports.dedupe_payloads(docs), "doc_id", "copies") == [("2", 1), ("3", 1), ("4", 2)]


def _ingest(spark, inbox, out, state):
    jobs.stream_dns(spark, inbox, out, state, ntz(NOW), availableNow=True).awaitTermination()


def test_stream_ingest_takes_new_files_once(spark, rows, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("reply a.com is 1.1.1.1\nnoise\n")
    _ingest(spark, inbox, out, state)
    (tmp_path / "in" / "b.log").write_text("query[A] b.com from 10.0.0.1\n")
    _ingest(spark, inbox, out, state)
    _ingest(spark, inbox, out, state)
    stored = logs.read_dns(spark, out)
    assert rows(stored, "query_type", "domain") == [("query", "b.com"), ("reply", "a.com")]


def test_replayed_batch_replaces_itself(spark, rows, tmp_path):
    from pyspark.sql import functions as F
    out = str(tmp_path / "out")
    for batch, name in ((0, "a"), (1, "b"), (1, "b")):
        lines = spark.createDataFrame([(f"reply {name}.com is 1.1.1.1",)], "value string")
        df = logs.parse_dns_lines(lines, ntz(NOW)).withColumn("batch_id", F.lit(batch))
        logs.write_dns(df, out, "overwrite", ["batch_id"])
    assert rows(logs.read_dns(spark, out), "domain") == [("a.com",), ("b.com",)]


def test_equal_lines_are_rows_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "RUN", 10)
    line = "query[A] a.com from 10.0.0.1"
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "one.log").write_text("\n".join([line] * 137 + ["reply a.com is 1.2.3.4", "other"]) + "\n")
    (folder / "two.log").write_text("\n".join(["reply a.com is 1.2.3.4", "", ""] + [line] * 4) + "\n")
    first = logs.read_dns_log(spark, str(folder))
    ids = sorted(r.id for r in first.collect())
    assert len(ids) == len(set(ids)) == 146
    assert logs.parse_dns_lines(first).count() == 143
    # the same files give the same ids, however they are read
    assert sorted(r.id for r in logs.read_dns_log(spark, str(folder)).repartition(7).collect()) == ids


def test_ids_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    folder, out, state = tmp_path / "log", str(tmp_path / "dns"), str(tmp_path / "state")
    folder.mkdir()
    stored = []
    for name in ("one.log", "two.log"):
        (folder / name).write_text("query[A] a.com from 10.0.0.1\n" * 5 + "reply a.com is 1.2.3.4\n")
        for _ in range(2):  # the second run finds nothing new
            jobs.stream_dns(spark, str(folder), out, state, ntz(NOW), availableNow=True).awaitTermination()
        stored.append(sorted(r.id for r in logs.read_dns(spark, out).collect()))
    assert len(stored[0]) == 6 and set(stored[0]) < set(stored[1]) and len(set(stored[1])) == 12
    assert stored[1] == sorted(r.id for r in logs.read_dns_log(spark, str(folder)).collect())
