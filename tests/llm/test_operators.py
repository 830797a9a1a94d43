"""Each query against a plain version, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm import brute
from tidewatch.llm import queries

KINDS = ["email", "ip", "card", "phone"]
LINE = "the quick brown fox jumps over the lazy dog and runs away from seven angry bears today"
AWKWARD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, LINE, "en", "a"), (4, LINE, "en", "a"),
    (5, LINE.upper(), "en", "b"), (6, "é " * 3000 + LINE, "fr", "b"), (7, "$$$ ### a|b", "de", "b"),
    (8, "same line here\n" * 40, "en", "a"), (9, "x" * 200_000, "en", "a"), (10, "one two", "en", "a"),
    (None, LINE, "en", "a"), (11, "mail a.b@c.org or +1 (222) 333-4444, 10.0.0.1, 4111 1111 1111 1111", "en", "a"),
    (-3, "ÀÉ ß 日本語 a b \x1c c", None, None), (12, "a " * 12, "en", "a"), (13, LINE + " " + LINE, "en", "a"),
]
BENCH = [(1, LINE), (2, "Two words"), (3, None), (4, "..."), (5, LINE), (6, "one two")]
PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/", None), (4, "http://d/", ""),
         (5, "http://e/", "é" * 40_000), (6, "http://f/\r\nX: y", "WARC/1.1\r\n\r\n" * 9), (7, "u", "é" * 40_000)]


def write(folder, name, rows, columns, types):
    arrays = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), types)] if rows else [
        pa.array([], kind) for kind in types]
    pq.write_table(pa.table(arrays, names=columns), f"{folder}/{name}.parquet")


def tables(folder, docs, bench=BENCH, pages=PAGES):
    """Tables with one more column each, whose names clash with those used inside."""
    docs = [(*d, len(d[1] or ""), i) for i, d in enumerate(docs)]
    write(folder, "documents", docs, ["doc_id", "text", "lang", "source", "n_chars", "words"],
          [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])
    write(folder, "benchmark", [(*b, 0) for b in bench], ["item_id", "text", "window"],
          [pa.int64(), pa.string(), pa.int64()])
    write(folder, "pages", [(*p, "x") for p in pages], ["page_id", "url", "html", "digest"],
          [pa.int64(), pa.string(), pa.string(), pa.string()])
    return str(folder)


@pytest.fixture(scope="module", params=["small", "awkward"])
def folder(request, tmp_path_factory):
    if request.param == "small":
        return SMALL
    return tables(tmp_path_factory.mktemp("awkward"), AWKWARD)


@pytest.fixture(scope="module")
def docs(folder):
    return pd.read_parquet(f"{folder}/documents.parquet").astype({"doc_id": object, "text": object}).replace(
        {np.nan: None})


def got(spark, name, folder, *columns):
    return [tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()]


def same(left, right):
    assert sorted(left, key=repr) == sorted(right, key=repr)


def test_language(spark, folder, docs):
    rows = queries.op1_language(spark, folder).toPandas()
    assert len(rows) == len(docs)
    held = [None if k is None else zlib.crc32(str(int(k)).encode()) % 5 == 0 for k in docs.doc_id]
    same([(k, h) for k, h in zip(rows.doc_id.astype(object).replace({np.nan: None}), rows.held_out)],
         [(k, bool(h)) for k, h in zip(docs.doc_id, held)])
    assert rows.score.between(0, 1).all()
    texts = dict(zip(docs.doc_id, docs.text))
    learned = set(docs.lang.dropna())
    for r in rows.dropna().itertuples():
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in learned | {"und"}


def test_language_accuracy_on_held_out_rows(spark):
    rows = queries.op1_language(spark, SMALL.replace("0.001", "0.01")).toPandas()
    known = pd.read_parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet").merge(rows, on="doc_id")
    held = known[known.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97


def test_simhash(spark, folder, docs):
    marks = [brute.simhash(t) for t in docs.text]
    roots = brute.components([None if k is None else int(k) for k in docs.doc_id], marks)
    same(got(spark, "op2_simhash", folder, "doc_id", "fingerprint", "component_id"),
         [(k, f"{m:016x}", c) for k, m, c in zip(docs.doc_id, marks, roots)])


def test_personal_data(spark, folder, docs):
    expected = []
    for key, text in zip(docs.doc_id, docs.text):
        spans = brute.personal(text)
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = [sum(s[1] == k for s in spans) for k in range(4)]
        expected.append((key, *counts, hashlib.sha256(line.encode()).hexdigest()))
    same(got(spark, "op3_personal_data", folder, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
         expected)


def test_packing(spark, folder, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = queries.op4_packing(spark, folder).toPandas()
    expected = []
    for key, text in zip(docs.doc_id, docs.text):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(head or 2048, len(ids), 2048), len(ids)]
        expected += [(key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in
                     enumerate(zip(cuts, cuts[1:]))]
    rows = rows.astype(object).replace({np.nan: None})
    same(zip(*(rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))), expected)
    total = 0
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == [0, *np.cumsum(list(group.length))[:-1]]
        assert group.length.sum() <= 2048
        total += 1
    assert total <= 1.2 * sum(rows.length) / 2048 + 2


def test_decontamination(spark, folder, docs):
    bench = pd.read_parquet(f"{folder}/benchmark.parquet")
    found = brute.leaks(docs.text, zip(bench.item_id, bench.text))
    sha = [hashlib.sha256(",".join(items).encode()).hexdigest() for _, _, items in found]
    same(got(spark, "op6_decontaminate", folder, "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
             "contaminated"),
         [(k, n, h, len(i), s, h > 0) for k, (n, h, i), s in zip(docs.doc_id, found, sha)])


def test_sharding(spark, folder, docs):
    rows = queries.op8_sharding(spark, folder).toPandas()
    bodies = [(t or "").encode() for t in docs.text]
    same(zip(rows.doc_id.astype(object).replace({np.nan: None}), rows["size"], rows.text_crc32),
         [(k, len(b) + 1, zlib.crc32(b)) for k, b in zip(docs.doc_id, bodies)])
    for _, group in rows.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert ((rows.grown_shard == rows.shard) | (rows.grown_shard == 16)).all()
    assert rows.groupby("doc_id").shard.nunique().max() == 1 and rows.shard.between(0, 15).all()


def test_quality(spark, folder, docs):
    same(got(spark, "op10_quality", folder, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
             "n_repeat_words", "base_failed"),
         [(k, *brute.quality(t)) for k, t in zip(docs.doc_id, docs.text)])
    rows = queries.op10_quality(spark, folder).toPandas()
    assert not (rows.kept & rows.base_failed).any()


def test_warc(spark, folder):
    pages = pd.read_parquet(f"{folder}/pages.parquet")
    bodies = [(h or "").encode() for h in pages.html]
    first = {}
    for key, body in zip(pages.page_id, bodies):
        first[body] = min(key, first.get(body, key))
    same(got(spark, "op9_warc", folder, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
             "error"),
         [(k, len(b), brute.digest32(b), "response" if first[b] == k else "revisit",
           None if first[b] == k else first[b], None) for k, b in zip(pages.page_id, bodies)])


def test_token_counts(spark, folder, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = []
    for key, text in zip(docs.doc_id, docs.text):
        text = text or ""
        lines = text.splitlines(keepends=True) if text.isascii() and not set(text) & set("\r\v\f\x1c\x1d\x1e") else [
            x for x in text.replace("\n", "\n\0").split("\0") if x]
        starts = np.cumsum([0, *map(len, lines or [""])])
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        own = np.searchsorted(starts, [a for a, _ in offsets], side="right") - 1
        n = np.bincount(own.astype(int), minlength=len(starts) - 1)
        expected += [(key, i, int(starts[i]), int(starts[i + 1]), int(n[i])) for i in range(len(starts) - 1)]
    same(got(spark, "op7_token_counts", folder, "doc_id", "section", "start", "stop", "n_tokens"), expected)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, tables(tmp_path, [], [], [])).collect() == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op9_warc", "op11_main_text", "op13_spelling"}))
def test_empty_benchmark_and_single_row(spark, tmp_path, name):
    rows = queries.QUERIES[name](spark, tables(tmp_path, [(7, LINE, "en", "a")], []))
    assert [r.doc_id for r in rows.collect()] == [7]
