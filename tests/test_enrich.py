import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.styles import pick_severity
from tidewatch.functions.times import ntz
from tidewatch.operators import enrich, filters, registry

NO_DATA = dict(vt=True, tf=True, uh=True, big=False, family=None, active=False, uh_active=False, hit=False)
POLICY = [
    (dict(big=True), 5, 1), (dict(), 5, 2),
    (dict(vt=False, big=True), 5, 2),
    (dict(vt=False, tf=False, big=True, family="Fam"), 5, 5),
    (dict(tf=False, active=True, family="Fam", hit=True), 1, 4),
    (dict(vt=False, uh=False, uh_active=True, hit=True), 3, 4),
    (dict(uh=False, uh_active=True), 3, 3),
    (dict(vt=False, uh=False, uh_active=True, hit=True), 5, 5),
    # An active entry without a family: the floor wins over the cap.
    (dict(vt=False, tf=False, big=True, active=True, hit=True), 2, 4),
    (dict(vt=False), 9, 5), (dict(vt=False), 0, 1),
]


@pytest.mark.parametrize("facts,candidate,expected", POLICY)
def test_score_policy(spark, facts, candidate, expected):
    f = {**NO_DATA, **facts}
    row = (f["vt"], f["tf"], f["uh"], f["big"], f["family"], f["active"], f["uh_active"], f["hit"], candidate)
    ctx = spark.createDataFrame([row], (
        "vt_no_data boolean, tf_no_data boolean, uh_no_data boolean, vt_is_big_player boolean, tf_families string, "
        "tf_active boolean, uh_active boolean, primary_hit boolean, primary_score int"))
    out = enrich.apply_score_policy(ctx, schemas.threat_levels(spark)).first()
    assert (out.score, out.is_malicious) == (expected, expected >= 4)


@pytest.mark.parametrize("payload,hit", [
    ('{"data":{"attributes":{"last_analysis_stats":{"malicious":0,"suspicious":0}}}}', False),
    ('{"data":{"attributes":{"last_analysis_stats":{"malicious":1,"suspicious":0}}}}', True),
    ('{"data":{"attributes":{"last_analysis_stats":{"malicious":0,"suspicious":1}}}}', True),
    ('{"error":{}}', False), ("not json", False), (None, False)])
def test_virustotal_gate(spark, payload, hit):
    df = spark.createDataFrame([(payload,)], "raw_data string")
    assert (filters.vt_hit(df).count() == 1) is hit


@pytest.mark.parametrize("payload,hit", [
    ('{"query_status":"ok"}', True), ('{"query_status":"no_result"}', False), ("{}", False), ("broken", False)])
def test_abuse_gate(spark, payload, hit):
    df = spark.createDataFrame([(payload,)], "raw_data string")
    assert (filters.abuse_hit(df).count() == 1) is hit


def test_reductions_of_missing_payloads_are_no_data(spark):
    df = spark.createDataFrame([(None,), ("broken",), ("{}",)], "raw_data string")
    assert all(r.vt_no_data and r.vt_report is None for r in enrich.reduce_virustotal(df).collect())
    assert all(r.tf_no_data and not r.tf_active for r in enrich.reduce_threatfox(df).collect())
    assert all(r.uh_no_data and not r.uh_active for r in enrich.reduce_urlhaus(df).collect())


GOOD = '{"threat_score": 4, "is_malicious": true, "verdict_en": "x", "active_providers": ["virustotal"]}'


@pytest.mark.parametrize("text,good", [
    (GOOD, True),
    (f"```json\n{GOOD}\n```", True),
    ("  \n" + GOOD.replace(", ", ",\r\n") + "\n", True),
    (GOOD + " and a remark", False),
    (GOOD + ", " + GOOD, False),
    (GOOD + "]", False),
    (GOOD[:-1], False),
    ('{"threat_score": 4}', False),
    ("", False), (None, False)])
def test_parse_verdicts(spark, text, good):
    df = spark.createDataFrame([(1, text)], "dns_query_id int, output string")
    out = enrich.parse_verdicts(df).first()
    assert (out.error is None) is good
    if good:
        assert (out.score, out.is_malicious, out.active_providers, out.raw_received) == (4, True, ["virustotal"], None)
    else:
        assert (out.score, out.error, out.raw_received) == (None, "Parsing failed", text)


def test_provider_without_document_is_left_out(spark, rows):
    verdicts = spark.createDataFrame(
        [(1, "d.com", "1.1.1.1", ["virustotal", "threatfox", "other"], None)],
        "dns_query_id int, fqdn string, observable_ip string, active_providers array<string>, error string")
    docs = spark.createDataFrame(
        [("1.1.1.1", "VirusTotal", "0", "2023"), ("1.1.1.1", "VirusTotal", "a", "2024"),
         ("d.com", "Abuse_URLhaus", "b", "2024")],
        "resource string, source_provider string, doc_id string, scan_date string")
    assert rows(enrich.provider_details(verdicts, docs), "dns_query_id", "source_provider", "doc_id") == [
        (1, "VirusTotal", "a")]


def test_detection_first_states(spark, rows):
    ctx = spark.createDataFrame(
        [(1, False, False, True, "r", "l"), (2, True, True, False, None, None), (3, True, False, True, "r", "l")],
        "id int, primary_hit boolean, uh_no_data boolean, uh_active boolean, uh_report string, uh_reference string")
    assert rows(enrich.detection_first(ctx), "id", "uh_status", "uh_active", "uh_report") == [
        (1, "skip", False, None), (2, "no_result", False, None), (3, "real", True, "r")]


def test_severity_bands_and_alert_gate(spark, rows):
    df = spark.createDataFrame([(s, s >= 4) for s in range(1, 6)], "score int, is_malicious boolean")
    styled = {r.score: (r.accent, r.badge) for r in pick_severity(df).collect()}
    assert styled[1] == styled[2] == ("#4caf50", "Clean / Monitor")
    assert styled[3] == ("#ff9800", "Suspicious")
    assert styled[4] == styled[5] == ("#f44336", "Malicious / Critical")
    assert rows(filters.needs_alert(df), "score") == [(3,), (4,), (5,)]
    assert pick_severity(df, product="Desk").first().header_text == "✅ INFO: Desk"


def test_threat_scale_line_is_null_if_a_part_is(spark):
    levels = spark.createDataFrame([(2, "b", None), (1, "a", "Allow")], "score int, description string, "
                                   "action_recommended string")
    assert [r.formatted_line for r in filters.threat_scale(levels).collect()] == ["1 | a (Action: Allow)", None]


def test_keys_are_stable_and_shared(spark):
    verdicts = spark.createDataFrame([(7, 4, "v", "p", None)], "dns_query_id int, score int, verdict_en string, "
                                     "analysis_pl string, error string")
    details = spark.createDataFrame([(7, "VirusTotal", "doc"), (7, "Unknown", "doc")],
                                    "dns_query_id int, source_provider string, doc_id string")
    run = [registry.register_verdicts(verdicts, details, schemas.indicator_types(spark),
                                      schemas.source_providers(spark), ntz("2026-01-02 03:04:05")) for _ in range(2)]
    results, indicators, links = ([tuple(r) for r in df.collect()] for df in run[0])
    assert results == [tuple(r) for r in run[1][0].collect()]
    assert results[0][0] == indicators[0][0] == indicators[0][3] == links[0][1] == "7-ai-20260102030405"
    assert [link[2:] for link in links] == [(1, "doc", None)]


def test_unique_and_orphans(spark, rows):
    df = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (2, 1, "c"), (None, 1, "d")], "k int, j int, v string")
    assert rows(registry.enforce_unique(df, ["k", "j"], ["v"]), "k", "v") == [(1, "a"), (2, "c"), (None, "d")]
    target = df.filter("k = 1")
    assert rows(registry.enforce_unique(df, ["k", "j"], ["v"], target), "v") == [("c",), ("d",)]
    parents = spark.createDataFrame([(1,)], "id int")
    assert rows(registry.orphans(df, parents, "k"), "v") == [("c",)]


def test_remap(spark):
    df = spark.range(0, 12).select(F.col("id").cast("int").alias("old"), F.col("id").cast("int").alias("threat_score"))
    new = {r.old: r.threat_score for r in registry.remap_scores(df).collect()}
    assert new == {0: None, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 7: 4, 8: 5, 9: 5, 10: 5, 11: None}


def test_providers_named_in_a_text_are_accepted(spark, rows):
    texts = ['{"threat_score": 3, "active_providers": "virustotal, threatfox"}',
             '{"threat_score": 3, "active_providers": ""}', '{"threat_score": 3, "active_providers": {"a": 1}}',
             '{"threat_score": 3, "active_providers": ["urlhaus"]}', '{"threat_score": 3, "active_providers": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, output string")
    assert rows(enrich.parse_verdicts(df), "n", "active_providers", "error") == [
        (0, ["virustotal", "threatfox"], None), (1, [], None), (2, None, "Parsing failed"), (3, ["urlhaus"], None),
        (4, None, "Parsing failed")]


def test_context_of_the_queue_equals_the_wide_form(spark, rows):
    from tests.conftest import SMALL
    from tidewatch.plans.catalog import CONTEXT_PROVIDERS, Data
    from tidewatch.sources import raw_reports
    data = Data(spark, SMALL)
    queue = data.pending().drop("first_seen", "query_count")
    wide = enrich.merge_context(queue, raw_reports.latest_by_provider(data.raw_reports, CONTEXT_PROVIDERS), data.levels)
    lean = enrich.context_of_queue(queue, data.raw_reports, data.levels, CONTEXT_PROVIDERS)
    assert rows(lean, *wide.columns) == rows(wide) and wide.count() > 50
