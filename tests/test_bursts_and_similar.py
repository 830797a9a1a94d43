import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewatch.operators import bursts, similar
from tidewatch.functions.times import ntz

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed,window,n", [(1, 600, 3), (2, 60, 2), (3, 7, 2)])
def test_bursts_against_brute_force(spark, rows, seed, window, n):
    rnd = random.Random(seed)
    data = [(rnd.choice("aaab"), START + timedelta(seconds=rnd.randrange(6000))) for _ in range(300)]
    df = spark.createDataFrame(data, "who string, at timestamp_ntz")
    expected = set()
    for who, at in data:
        hits = sum(1 for w, t in data if w == who and 0 <= (at - t).total_seconds() <= window)
        if hits >= n:
            expected.add((who, at, hits, at + timedelta(days=1)))
    found = bursts.burst_offenders(df, "who", "at", n, window)
    assert rows(found, "who", "flagged_at", "failures", "banned_until") == sorted(expected, key=repr)


@pytest.mark.parametrize("query_block,corpus_block", [(500, 20_000), (7, 11), (1, 1)])
def test_top_similar_in_blocks_equals_brute_force(spark, rows, monkeypatch, query_block, corpus_block):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(13, 8)), rng.normal(size=(24, 8))
    c[10] = c[3] * 2  # equal similarity, so the lower id comes first
    monkeypatch.setattr(similar, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(similar, "CORPUS_BLOCK", corpus_block)
    monkeypatch.setattr(similar, "SLICE", 3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    corpus = spark.createDataFrame([(f"v{i:02}", v.tolist()) for i, v in enumerate(c)],
                                   "verdict_id string, vector array<double>")
    sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 6)
    expected = []
    for i, row in enumerate(sims):
        best = sorted((-s, f"v{j:02}") for j, s in enumerate(row))[:5]
        expected += [(i, name, rank, -s) for rank, (s, name) in enumerate(best, 1)]
    found = similar.top_similar(queries, corpus)
    assert rows(found, "query_id", "verdict_id", "rank", "similarity") == sorted(expected, key=repr)
    high = similar.reference_material(queries, corpus, threshold=0.75)
    assert rows(high, "query_id", "verdict_id") == sorted(
        [(i, v) for i, v, _, s in expected if s >= 0.75], key=repr)


def _clustered(seed, clusters, each, spread=0.05, size=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, size))
    return np.concatenate([m + rng.normal(size=(each, size)) * spread * np.linalg.norm(m) / 4 for m in middles])


def test_cells_that_cannot_win_are_not_visited(spark, rows, monkeypatch):
    c = np.concatenate([_clustered(3, 20, 12)] * 10)  # a corpus copied ten times
    q = _clustered(3, 20, 2)[::2] + 0.001
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "verdict_id int, vector array<double>")
    monkeypatch.setattr(similar, "CORPUS_BLOCK", 50)
    index = similar.cell_index(corpus)
    cells = int((index.sizes > 0).sum())
    assert cells >= 20 and index.sizes.sum() == len(c) and index.parts.max() > 1
    first = similar.visits(queries, index, 5, -1.0)
    found = similar.top_similar(queries, corpus)
    kth = found.filter("rank = 5").selectExpr("query_id", "similarity as found")
    rest = similar.visits(queries.join(kth, "query_id"), index, 5, -1.0)
    looked = first.count() + rest.count()
    assert first.select("query_id").distinct().count() == len(q)
    assert looked < 0.25 * len(q) * cells
    sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T, 6)
    expected = [(i, j, r + 1, s) for i, row in enumerate(sims)
                for r, (s, j) in enumerate((-s, j) for s, j in sorted((-s, j) for j, s in enumerate(row))[:5])]
    assert rows(found, "query_id", "verdict_id", "rank", "similarity") == sorted(expected, key=repr)
    # nothing but a threshold leaves still less to look at
    assert similar.visits(queries, index, 5, 1.1).count() == 0


def test_bounds_hold_for_every_vector(spark):
    c, q = _clustered(8, 6, 20, 0.6), _clustered(9, 6, 5, 0.9)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "verdict_id int, vector array<double>")
    index = similar.cell_index(corpus)
    units = q / np.linalg.norm(q, axis=1)[:, None]
    bounds = index.bounds(units)
    for r in index.rows.collect():
        v = np.array(r.vector)
        assert (units @ (v / np.linalg.norm(v)) <= bounds[:, r.cell] + 1e-9).all()


def test_similar_with_an_empty_side(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    nothing = spark.createDataFrame([], "verdict_id int, vector array<double>")
    assert similar.similar_verdicts(queries, nothing).count() == 0


def test_corpus_keeps_recent_suspicious_verdicts(spark, rows):
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(4)], "verdict_id int, vector array<double>")
    ar = spark.createDataFrame([(0, 2), (1, 3), (2, 5), (3, 5)], "id int, threat_score int")
    ti = spark.createDataFrame([(0, START), (1, START), (2, START - timedelta(days=31)), (2, START), (2, START),
                                (3, START - timedelta(days=30))], "analysis_result_id int, last_scan timestamp_ntz")
    assert rows(similar.verdict_corpus(vectors, ar, ti, ntz("2024-01-01 00:00:00")), "verdict_id") == [(1,), (2,)]


def test_replies_have_no_user_and_are_kept(spark, rows):
    dns = spark.createDataFrame([(1, "10.0.0.1"), (2, "N/A"), (3, "N/A"), (4, "10.0.0.9")], "id int, source_ip string")
    devices = spark.createDataFrame([("10.0.0.1", "ann"), ("N/A", "nobody")], "source_ip string, user_name string")
    assert rows(similar.attribute_users(dns, devices), "id", "user_name") == [
        (1, "ann"), (2, None), (3, None), (4, None)]


def test_hash_states(spark, rows):
    current = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("c", "1", 1)],
                                    "path string, hash string, seen_at int")
    master = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1")], "path string, hash string")
    assert rows(similar.hash_mismatches(current, master), "path", "status") == [
        ("a", "changed"), ("c", "unexpected"), ("d", "missing")]


def test_equivalence_counts_missing_verdicts(spark):
    a = spark.createDataFrame([(1, 4, 1), (1, 5, 2), (2, 3, 1), (3, 1, 1)], "dns_query_id int, threat_score int, last_scan int")
    b = spark.createDataFrame([(1, 5, 9), (2, 2, 9)], "dns_query_id int, threat_score int, last_scan int")
    assert tuple(similar.verdict_equivalence(a, b).first()) == (3, 1, 0.3333, False)
    assert similar.verdict_equivalence(b, b).first().passed


def test_document_holds_no_address(spark):
    ar = spark.createDataFrame([(1, 4, "lab", "text", "Owner")], "id int, threat_score int, threat_label string, "
                               "verdict_summary_en string, vt_owner string")
    ti = spark.createDataFrame([("x", 9, 1, START)], "id string, dns_query_id int, analysis_result_id int, "
                               "last_scan timestamp_ntz")
    dns = spark.createDataFrame([(9, "d.com", "1.2.3.4")], "id int, domain string, response_ip string")
    row = similar.verdict_documents(ar, ti, dns).first()
    assert row.document == "d.com | lab | score 4 | Owner | text | 2024-01-01 00:00:00"
    assert row.observable_ip == "1.2.3.4"


def test_vectors_without_direction_have_no_result(spark, rows):
    kind = "vector array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None])], f"query_id int, {kind}")
    corpus = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], f"verdict_id int, {kind}")
    assert rows(similar.similar_verdicts(queries, corpus), "query_id", "verdict_id", "similarity") == [(1, 7, 1.0)]


def test_hashes_seen_at_one_time_do_not_depend_on_order(spark):
    master = spark.createDataFrame([("f", "b")], "path string, hash string")
    for order in ([("f", "a", 1), ("f", "b", 1)], [("f", "b", 1), ("f", "a", 1)]):
        current = spark.createDataFrame(order, "path string, hash string, seen_at int")
        assert similar.hash_mismatches(current, master).count() == 0
