"""Cross-tokenizer alignment against a count of all links in plain Python, and the bitmaps alone."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.test_operators import AWKWARD, tables
from tidewatch.llm import alignment, queries

MORE = [(20, "Price ▁ stays", "en", "a"), (21, "<s> and <|endoftext|> are text", "en", "a"), (22, "the " * 5_000, "en", "a"),
        (23, " a  b \n\tc\r\n", "en", "a"), (24, "日本語 🙂 é", "en", "a")]


def byte_letters():
    """The character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def expected(docs):
    letters = byte_letters()
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    names = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items() if all(c in letters for c in t)}
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = []
    for key, text in docs:
        a, b = [], []
        if text:
            ids = first.encode(" " + text, add_special_tokens=False).ids
            a = [(i, names[i]) for i in ids]
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                byte = piece.startswith("<0x") and len(piece) == 6
                b.append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) if side else set() for side in (a, b)]
        cuts, groups, links, at = sorted(ends[0] & ends[1]), [], [], [0, 0]
        for cut in cuts:
            group = []
            for k, side in enumerate((a, b)):
                ids, size = [], 0
                start = at[k]
                while at[k] < len(side) and sum(len(x) for _, x in side[start:at[k]]) + (cuts[len(groups) - 1] if groups else 0) < cut:
                    ids.append(side[at[k]][0])
                    at[k] += 1
                group.append(ids)
            groups.append(group)
            links.append((group[0][-1], group[1][-1]))
        found.append((key, len(a), len(b), groups, links))
    count = Counter(pair for *_, links in found for pair in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for key, n_a, n_b, groups, links in found:
        line = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)
        rows.append((key, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                     sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if n_a else ""))
    return rows, count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_a_plain_count(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    rows = queries.op12_alignment(spark, SMALL).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows)) == sorted(expected(zip(docs.doc_id, docs.text))[0])


@pytest.mark.parametrize("per_chunk", [4096, 3])
def test_awkward_documents(spark, tmp_path, monkeypatch, per_chunk):
    monkeypatch.setattr(alignment, "CHUNK_DOCS", per_chunk if per_chunk > 8 else 8)
    monkeypatch.setattr(alignment, "BITMAP_BYTES", alignment.CHUNK_DOCS // 8)
    docs = [d for d in [*AWKWARD, *MORE] if len(d[1] or "") < 50_000]
    folder = tables(tmp_path, docs)
    rows = sorted(map(tuple, queries.op12_alignment(spark, folder).select(*COLUMNS).collect()), key=repr)
    plain, _ = expected([(d[0], d[1]) for d in docs])
    assert rows == sorted(plain, key=repr)
    by_key = {r[0]: r for r in plain}
    assert by_key[20][1:] == (0, 0, 0, 0, 0, 0, "") and by_key[22][6] > 5_000 ** 2 / 2 and by_key[21][1] > 0


def test_pairs_have_documents_and_links(spark):
    docs = [(1, "the cat the cat the"), (2, "the dog"), (3, None), (4, "the cat")] + [(i, "the") for i in range(5, 400)]
    rows = alignment.stored(alignment.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)), "x")
    assert rows.filter("pair is not null and octet_length(docs) = 512").count() == 1
    got = {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r.n_docs, r.n_links) for r in alignment.pair_counts(rows).collect()}
    _, count = expected(docs)
    held = Counter()
    for doc in docs:
        held.update(set(expected([doc])[1]))
    assert got == {pair: (held[pair], n) for pair, n in count.items()}


def test_long_texts_start_chunks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 100)
    docs = spark.createDataFrame([(i, "word " * 30) for i in range(4)] + [(9, "x"), (10, "y")], "doc_id long, text string")
    rows = alignment.index(docs.coalesce(1)).filter("pair is null").select("chunk", "at").collect()
    assert [tuple(r) for r in rows] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 4095), min_size=1, max_size=600), min_size=1, max_size=6))
def test_bitmaps_round_trip(sets):
    positions = np.concatenate([sorted(s) for s in sets]).astype(np.int64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    bitmaps, sizes = alignment.containers(positions, starts)
    assert list(sizes) == list(map(len, sets))
    assert all(len(b) == (512 if len(s) >= 256 else 2 * len(s)) for b, s in zip(bitmaps.to_pylist(), sets))
    at, owner = alignment.members(bitmaps)
    back = [set(at[owner == i].tolist()) for i in range(len(sets))]
    assert back == sets


def test_planes_add_up_to_the_multiplicity():
    keys = np.array([7, 7, 7, 9, 9], np.int64)
    times = np.array([1, 2, 6, 1, 1], np.int64)
    positions = np.array([5, 0, 3, 2, 1], np.int64)
    total = Counter()
    for pairs, plane, bitmaps in alignment.bitmaps_of(keys, times, positions):
        at, owner = alignment.members(bitmaps)
        for place, i in zip(at.tolist(), owner.tolist()):
            total[int(pairs[i]), place] += 1 << max(plane, 0)
    assert total == {(7, 5): 1, (7, 0): 2, (7, 3): 6, (9, 2): 1, (9, 1): 1}


def test_only_exact_restorations_count():
    encoder, pieces = alignment.shared_encoder(), alignment.shared_pieces()
    a, b = alignment.encoded(encoder, pieces, "x▁y")
    assert len(a) == len(b) == 0
    assert min(pieces.sizes) > 0 and isinstance(alignment.containers(np.empty(0, np.int64), np.empty(0, np.int64))[0], pa.Array)
