"""The pipeline as a whole and stage by stage on awkward rows, against plain versions."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, tables
from tidewatch.llm import packing, pii, queries, tokens

PASSAGE = " ".join(f"exam{i}" for i in range(30))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, words=120):
    draw = random.Random(seed)
    letters = "etaoinshrdlucmfw"
    return " ".join("".join(draw.choices(letters, k=draw.randint(3, 7))) for _ in range(words))


def documents():
    rows = [(100 + i, prose(i, 80 + 5 * i), "en", "a") for i in range(30)]
    rows += [(200 + i, prose(50 + i), None, None) for i in range(4)]
    # a copy of a smaller id, rows that are repeated, and a copy without an id
    rows += [(300, prose(3, 95), "en", "b"), (301, prose(80), "en", "b"), (301, prose(80), "en", "b"), (None, prose(80), "en", "b")]
    rows += [(None, prose(81), "en", "a"), (302, prose(82, 30_000), "en", "b")]
    rows += [(303, f"{prose(83, 60)} {PASSAGE} {prose(84, 60)}", "en", "a")]
    rows += [(304, f"{prose(85)} mail joe.doe@example.org or joe at example dot org", "en", "a")]
    return AWKWARD + rows


BENCH = [(1, PASSAGE), (2, None), (3, ""), (4, PASSAGE)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("pipeline"), documents(), BENCH)


def known(rows):
    return [(None if pd.isna(k) else int(k), t) for k, t in rows]


def one_of_each(rows):
    """One row of each component: the smallest id, NULL after all others."""
    roots = brute.components(list(range(len(rows))), [brute.simhash(t) for _, t in rows])
    first = {}
    for root, row in zip(roots, rows):
        if root not in first or (row[0] is None, row[0] or 0) < (first[root][0] is None, first[root][0] or 0):
            first[root] = row
    return list(first.values())


def without_leaks(rows):
    hits = brute.leaks([t for _, t in rows], BENCH)
    return [row for row, (_, hit, _) in zip(rows, hits) if not hit]


def masked(rows):
    return [(k, None if t is None else pii.masked(t, pii.find_spans(t)[1])) for k, t in rows]


def packed_ids(rows):
    encoder = tokens.Encoder()
    return sorted(((k, encoder.encode(t or "") + packing.END) for k, t in rows), key=repr)


def collected(df):
    return known((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_whole_run_on_awkward_rows(spark, folder):
    con = duckdb.connect()
    # the SQL tells rows apart by id, so each gets its place in the table as one
    con.execute(f"""CREATE VIEW documents AS SELECT file_row_number AS doc_id, * EXCLUDE (doc_id, file_row_number)
                    FROM read_parquet('{folder}/documents.parquet', file_row_number = true)""")
    verdicts = con.execute(queries.SQL["op10_quality"]).fetchdf()
    good = set(verdicts.doc_id[verdicts.kept])
    rows = [(d[0], d[1]) for i, d in enumerate(documents()) if i in good]
    rows = masked(without_leaks(one_of_each(rows)))
    left = [k for k, _ in rows]
    assert len(rows) > 20 and not {303, 300, 1, 2, 9} & set(left) and left.count(301) == 1 and left.count(None) <= 1
    out = corpus_pipeline.run(spark, folder).collect()
    found, filled = {}, {}
    for r in sorted(out, key=lambda r: r.piece):
        found[r.doc_id] = found.get(r.doc_id, b"") + bytes(r.ids)
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert found == dict(packed_ids(rows))
    assert max(filled.values()) <= 2048


def test_each_stage_on_awkward_rows(spark, folder):
    """Every row as it comes, without the stages before: NULL texts and ids, repeated and very long rows."""
    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), [(d[0], d[1]) for d in documents()]
    stage = dict(corpus_pipeline.STAGES)
    expected = {"near_duplicates": one_of_each, "decontamination": without_leaks, "personal_data": masked}
    for name, plain in expected.items():
        out = stage[name](spark, docs, folder)
        assert out.columns == COLUMNS, name
        assert sorted(collected(out), key=repr) == sorted(plain(rows), key=repr), name
    out = stage["personal_data"](spark, docs, folder).select("text", "n_chars").collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    pieces = stage["packing"](spark, docs, folder).toPandas()
    assert pieces.length.sum() == sum(len(ids) // 4 for _, ids in packed_ids(rows))
    assert sorted(np.unique(pieces.groupby("sequence_id").offset.min())) == [0]


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(tmp_path, [], [])).count() == 0
