"""Tables and queues that are kept up to date: state, late rows, merges and declared rules."""

import glob
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bursts, constraints, reports, upsert
from tidewatch.schemas import DNS_QUERIES
from tidewatch.streaming import queue, rollups

START = datetime(2024, 1, 1)


def dns_row(i, at=START, ip="1.2.3.4"):
    return str(i), at, "reply", "A", f"d{i}.com", "N/A", ip


def test_queue_rows_leave_when_answered_and_come_back(spark, rows, tmp_path):
    dns, ti, out, state = (str(tmp_path / n) for n in ("dns", "ti", "out", "state"))

    def run(queries, answers, again=3600):
        spark.createDataFrame(queries, DNS_QUERIES).write.mode("append").parquet(dns)
        spark.createDataFrame([(str(a),) for a in answers], "dns_query_id string").write.mode("append").parquet(ti)
        queue.stream_queue(spark.readStream.schema(DNS_QUERIES).parquet(dns),
                           spark.readStream.schema("dns_query_id string").parquet(ti), out, state, again,
                           availableNow=True).awaitTermination(120)
        return rows(queue.open_entries(spark.read.parquet(out)), "dns_query_id", "attempt")

    assert run([dns_row(0), dns_row(1), dns_row(2), dns_row(3, ip="::1"), dns_row(1)], [2, 9], again=1) == [("0", 1), ("1", 1)]
    # nothing answers in time, so the entries come back; 9 was answered before it was seen
    found = run([dns_row(9), dns_row(5)], [])
    assert [k for k, _ in found] == ["0", "1", "5"] and all(n > 1 for k, n in found if k != "5")
    # a late answer ends an entry however often it came back; a second one changes nothing
    assert [k for k, _ in run([dns_row(6)], [0, 2, 5])] == ["1", "6"]
    assert [k for k, _ in run([], [1, 6])] == []


def test_queue_state_over_many_batches_equals_a_plain_model(spark, rows, tmp_path, monkeypatch):
    """Waiting, answered, handed out again, remembered and forgotten, with batches that run twice and merged state."""
    monkeypatch.setattr(queue, "MERGE_EVERY", 2)
    draw, out, state = random.Random(5), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "dns_query_id string, answer boolean, source_ip string, fqdn string, observable_ip string, first_seen timestamp_ntz, arrived_ms bigint"
    again, keep, model, expected = 150, 250, {}, []
    for number in range(7):
        now = 1000 + 100 * number
        asked = [(str(draw.randrange(12)), START + timedelta(seconds=draw.randrange(9))) for _ in range(4)]
        answered = [str(draw.randrange(12)) for _ in range(3)] + ["hot"] * 50
        batch = spark.createDataFrame([(k, False, "N/A", f"d{k}", "1.2.3.4", at, now) for k, at in asked]
                                      + [(k, True, None, None, None, None, now) for k in answered], schema)
        for _ in range(1 + number % 2):  # odd batches run twice
            queue.add_batch(batch, out, state, number, again, keep)
        for k in sorted({k for k, _ in asked} | set(answered) | set(model)):
            held = model.get(k)
            if held and held[0] == "answered" and held[1] <= now:
                held = model.pop(k) and None
            if held and held[0] == "answered":
                continue
            first = min((at for q, at in asked if q == k), default=None)
            if k in answered:
                if held:
                    expected.append((k, "answered", *held[2:], number))
                model[k] = ("answered", now + keep)
            elif held and held[1] <= now:
                model[k] = ("waiting", held[1] + again, held[2], held[3] + 1)
                expected.append((k, "waiting", *model[k][2:], number))
            elif not held and first is not None:
                model[k] = ("waiting", now + again, first, 1)
                expected.append((k, "waiting", first, 1, number))
    events = spark.read.parquet(out)
    assert rows(events, "dns_query_id", "state", "first_seen", "attempt", "batch_id") == sorted(expected, key=repr)
    assert {e[1] for e in expected} == {"waiting", "answered"} and max(e[3] for e in expected) > 1
    ended = {e[0] for e in expected if e[1] == "answered"}  # an entry that was answered stays ended
    waiting = sorted((k, m[3]) for k, m in model.items() if m[0] == "waiting" and k not in ended)
    assert rows(queue.open_entries(events), "dns_query_id", "attempt") == waiting
    assert sorted(f.rsplit("/", 1)[1] for f in glob.glob(f"{state}/*")) == ["base=4", "base=6"]  # older state is deleted


def test_queue_runs_without_a_worker_per_key(spark, tmp_path):
    dns, ti, out, state = (str(tmp_path / n) for n in ("dns", "ti", "out", "state"))
    spark.createDataFrame([dns_row(0)], DNS_QUERIES).write.parquet(dns)
    spark.range(1, 5_000).selectExpr("cast(id as string) as dns_query_id").write.parquet(ti)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    stream = queue.stream_queue(spark.readStream.schema(DNS_QUERIES).parquet(dns),
                                spark.readStream.schema("dns_query_id string").parquet(ti), out, state, availableNow=True)
    stream.awaitTermination(120)
    assert [r.dns_query_id for r in queue.open_entries(spark.read.parquet(out)).collect()] == ["0"]
    assert not any(p["stateOperators"] for p in stream.recentProgress)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the stream's session is its own
    try:
        spark.createDataFrame([dns_row(6_000)], DNS_QUERIES).write.mode("append").parquet(dns)
        queue.stream_queue(spark.readStream.schema(DNS_QUERIES).parquet(dns),
                           spark.readStream.schema("dns_query_id string").parquet(ti), out, state, availableNow=True).awaitTermination(120)
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_late_rows_count_in_the_traffic_roll_up(spark, rows, tmp_path):
    draw, path = random.Random(2), str(tmp_path / "traffic")
    data = [(str(i), START + timedelta(minutes=draw.randrange(4_000)), "query", "A", draw.choice(["a", "b", None, f"n{i}"]),
             f"10.0.0.{i % 7}", None) for i in range(600)]
    schema = "id string, timestamp timestamp_ntz, query_type string, record_type string, domain string, source_ip string, response_ip string"
    batches = [data[:200], data[200:400], data[400:]]  # in no order of time

    def add(numbers):
        for number in numbers:
            rollups.add_traffic(spark.createDataFrame(batches[number], schema), path, number)

    add([0, 1, 1])
    rollups.compact(spark, path, (START + timedelta(days=2) - datetime(1970, 1, 1)).days)
    kept = {f for f in glob.glob(f"{path}/*/*/*.parquet") if "batch_id=-1" in f}
    assert kept and not [f for f in glob.glob(f"{path}/day=19723/*/*.parquet") if "batch_id=-1" not in f]
    add([2])
    expected = rows(reports.dns_hourly_traffic(spark.createDataFrame(data, schema)).drop("raw_time"),
                    "time_sec", "total_queries", "unique_domains", "unique_sources", "latest_query", "hour_group")
    columns = ["time_sec", "total_queries", "unique_domains", "unique_sources", "latest_query", "hour_group"]
    assert rows(rollups.hourly_traffic(spark, path), *columns) == expected
    assert kept <= set(glob.glob(f"{path}/*/*/*.parquet"))  # new rows are added beside the merged ones
    day = rollups.hourly_traffic(spark, path, 19724, 19724)
    assert rows(day, *columns) == [r for r in expected if r[0] // 86400 == 19724]
    rollups.compact(spark, path, 30_000)
    assert rows(rollups.hourly_traffic(spark, path), *columns) == expected
    assert all("batch_id=-1" in f for f in glob.glob(f"{path}/*/*/*.parquet"))
    before = sorted(glob.glob(f"{path}/*/*/*.parquet"))
    rollups.compact(spark, path, 30_000)
    assert sorted(glob.glob(f"{path}/*/*/*.parquet")) == before


@pytest.mark.parametrize("seed,window,n", [(1, 600, 3), (2, 90_000, 4), (3, 60, 2)])
def test_late_failures_equal_the_batch_rule(spark, rows, tmp_path, seed, window, n):
    draw, path = random.Random(seed), str(tmp_path / "bursts")
    data = [(draw.choice("aaabc"), START + timedelta(seconds=draw.randrange(window * 12))) for _ in range(150)]
    schema = "who string, at timestamp_ntz"
    for number in (0, 1, 2, 2):
        some = spark.createDataFrame(data[number * 50:(number + 1) * 50], schema)
        rollups.add_failures(some, "who", "at", path, number, n, window)
        so_far = spark.createDataFrame(data[:(number + 1) * 50], schema)
        expected = bursts.burst_offenders(so_far, "who", "at", n, window)
        assert rows(rollups.burst_rows(spark, path), "source", "flagged_at", "failures", "banned_until") == rows(
            expected, "who", "flagged_at", "failures", "banned_until")
    assert rollups.burst_rows(spark, path).count() > 5


KEYS = ["q", "a", "last_scan"]
SCANS = "id string, q long, a long, last_scan timestamp_ntz, scan_count int"


def test_upsert_writes_only_what_changes(spark, rows, tmp_path):
    path = str(tmp_path / "table")
    months = [datetime(2024, m, 5) for m in (1, 2, 3)]

    def batch(data, number):
        return upsert.upsert(spark, spark.createDataFrame(data, SCANS), path, KEYS, "last_scan", number, buckets=4)

    def files():
        return {f: open(f, "rb").read() for f in glob.glob(f"{path}/*/*/*.parquet")}

    first = [(f"x{i}", i, 1, months[i % 3], 1) for i in range(30)]
    assert batch(first, 1) == len({f.rsplit("/", 1)[0] for f in files()}) > 6
    before = files()
    # one known key, one that is new, twice: one month, two key ranges at most
    changed = batch([("y", 0, 1, months[0], 2), ("y", 99, 1, months[0], 5), ("w", 99, 1, months[0], 1)], 2)
    assert 1 <= changed <= 2
    after = files()
    assert all(after.get(f) == body for f, body in before.items() if "ym=202401" not in f)
    assert sum(f not in after for f in before) <= changed
    expected = sorted([(i, k, 3 if i == "x0" else n) for i, k, _, _, n in first] + [("w", 99, 6)], key=repr)
    table = upsert.read_upserted(spark, path)
    assert rows(table, "id", "q", "scan_count") == expected and table.columns == ["id", "q", "a", "last_scan", "scan_count", "ym"]
    # batches that run again change no file
    assert batch([("y", 0, 1, months[0], 2), ("y", 99, 1, months[0], 5), ("w", 99, 1, months[0], 1)], 2) == 0
    assert batch(first, 1) == 0 and batch([], 3) == 0 and files() == after
    # a batch that failed half way is completed: one of its two rows is there already
    assert batch([("z", 0, 1, months[0], 4)], 4) == 1
    assert batch([("z", 0, 1, months[0], 4), ("z", 5, 1, months[2], 4)], 4) == 1
    found = {r.q: r.scan_count for r in upsert.read_upserted(spark, path).collect()}
    assert found[0] == 7 and found[5] == 5
    with pytest.raises(ValueError):
        upsert.upsert(spark, spark.createDataFrame(first, SCANS), path, ["q", "a"], "last_scan", 5)


def test_upsert_moves_each_row_once(spark, rows, tmp_path, monkeypatch):
    """No copies beside the table; large folders shared by tasks, many rows of one key and NULL in keys."""
    draw, path, shared = random.Random(4), str(tmp_path / "table"), spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(upsert, "ROWS", 40)
    months, before = [datetime(2024, m, 5) for m in (1, 2)], set(glob.glob(f"{shared}/*"))
    plain = {}

    def batch(data, number):
        merged = {}
        for i, q, a, at, n in data:
            least, total = merged.get((q, a, at), (i, 0))
            merged[q, a, at] = min(least, i), total + n
        for key, (i, n) in merged.items():
            kept, total, newest = plain.get(key, (i, 0, 0))
            plain[key] = (kept, total + n, number) if newest < number else (kept, total, newest)
        upsert.upsert(spark, spark.createDataFrame(data, SCANS), path, KEYS, "last_scan", number, buckets=3)

    def some(n):
        return [(f"x{draw.randrange(10**6)}", draw.randrange(300), draw.choice([1, None]), draw.choice(months), draw.randrange(9))
                for _ in range(n)]

    first, second = some(400), some(300) + [("w", 7, 1, months[0], 1)] * 500
    for data, number in ((first, 1), (second, 2), (second + some(50), 2), (first, 1)):
        batch(data, number)
        expected = sorted([(i, *key, n) for key, (i, n, _) in plain.items()], key=repr)
        assert rows(upsert.read_upserted(spark, path), "id", *KEYS, "scan_count") == expected
    nothing = [("n", 1, 1, None, 1), ("m", 1, 1, None, 2)]  # no time, so no month
    for number in (3, 3, 4):
        batch(nothing, number)
    assert rows(upsert.read_upserted(spark, path).filter("ym is null"), "id", "q", "scan_count") == [("m", 1, 6)]
    assert set(glob.glob(f"{shared}/*")) == before


def test_every_broken_rule_of_a_row_is_named(spark):
    levels = spark.createDataFrame([(i,) for i in range(1, 6)] + [(5,)], "score int")
    verdicts = spark.createDataFrame(
        [(1, 3, "ok", Decimal("99.999")), (2, 9, "x" * 51, Decimal("999.995")), (3, None, None, None), (4, 1, "é" * 50, Decimal("-1000"))],
        "id int, threat_score int, threat_label string, confidence_score decimal(12, 3)")
    found = constraints.checked(verdicts, "ai_analysis_results", {"dic_threat_levels": levels})
    assert {r.id: r.violations for r in found.collect()} == {
        1: [], 2: ["threat_label has more than 50 characters", "confidence_score is out of range",
                   "threat_score is not in dic_threat_levels"],
        3: ["threat_score is missing"], 4: ["confidence_score is out of range"]}
    good, bad = constraints.split_valid(verdicts, "ai_analysis_results", {"dic_threat_levels": levels})
    assert good.columns == verdicts.columns and [r.id for r in good.collect()] == [1] and bad.count() == 3


def test_keys_and_missing_columns(spark):
    scans = spark.createDataFrame([(1, 2, 3, START), (1, 2, 3, START), (1, 2, 4, START), (None, 2, 4, START)],
                                  "dns_query_id int, type_id int, analysis_result_id int, last_scan timestamp_ntz")
    types = spark.createDataFrame([(2, "IP")], "id int, name string")
    found = constraints.checked(scans, "threat_indicators", {"dic_indicator_types": types})
    twice = "dns_query_id, analysis_result_id, last_scan is not unique"
    assert sorted(str(r.violations) for r in found.collect()) == sorted(
        [str([twice])] * 2 + ["[]", "['dns_query_id is missing']"])
    lacking = constraints.checked(scans.select("type_id"), "threat_indicators")
    assert all(len(r.violations) == 3 for r in lacking.collect())
    assert set(constraints.TABLES) >= {"dic_threat_levels", "network_events"} and len(constraints.TABLES) == 8
    empty = constraints.violations_by_rule({"threat_indicators": scans.limit(0)}, {"dic_indicator_types": types})
    assert empty.filter(F.col("rows") > 0).count() == 0
