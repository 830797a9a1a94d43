"""Spelling variants against all pairs of words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pandas as pd

from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, tables
from tidewatch.llm import queries, spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def table(count, factor=5):
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    by_size, form, number = {}, {}, {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w, n in words.items():
        found = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(k, []) if near(w, v)]
        number[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, number[w], words.get(form[w])) for w, n in words.items()]


def misspelled(docs):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.A_TO_Z)
            h = zlib.crc32(f"{'' if key is None else int(key)}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return count


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_all_pairs(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    expected = table(misspelled(zip(docs.doc_id, docs.text)))
    assert rows_of(queries.op13_spelling(spark, SMALL)) == sorted(expected, key=repr)
    assert len(expected) > 300 and sum(r[4] for r in expected) > 50


def test_awkward_documents(spark, tmp_path):
    more = [(30 + i, "Übergröße ÜBERGRÖSSE " * 7 + "×××÷÷÷ " * 5 + "letter lettr lettter " * (i + 1), "de", "a") for i in range(4)]
    docs = [*AWKWARD, *more]
    expected = table(misspelled((d[0], d[1]) for d in docs))
    assert rows_of(queries.op13_spelling(spark, tables(tmp_path, docs))) == sorted(expected, key=repr)
    assert {"letter", "lettter", "×××÷÷÷"} <= {r[0] for r in expected}


def test_dense_words_ties_runs_and_chains(spark):
    draw, count = random.Random(3), {}
    for _ in range(1_500):
        word = "".join(draw.choice("ab") for _ in range(draw.randint(6, 9)))
        count[word] = draw.choice([5, 5, 25, 30, 125, 700, 4_000])
    count |= {"mmmmmm": 5, "mmmmmmm": 25, "mmmmmmmm": 125, "mmmmmmmmm": 625, "mmmmmmmmmm": 3_125, "mmmmmmmmmmm": 15_625}
    count |= {"stands": 5, "strands": 30, "stinds": 30}
    got = rows_of(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert got == sorted(table(count), key=repr)
    found = {r[0]: r for r in got}
    assert found["mmmmmm"][2] == "mmmmmmmmmmm" and found["stands"][1] == "stinds"
    assert sum(r[4] for r in got) > 3_000


def test_a_range_is_no_larger_than_the_alphabet(spark):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    words = [f"worte{c}x" for c in letters] + ["wortex"]
    sizes = spelling.rotations(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).groupBy("range").count()
    assert sizes.agg({"count": "max"}).first()[0] == len(words)
    near_rows = spelling.neighbours(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    # a doubled letter counts once, although it can be left out in two ways
    assert {r.word: r.n_near for r in near_rows} == dict.fromkeys(words, len(words) - 1)
    assert {r.best for r in near_rows if r.word != "worteax"} == {"worteax"}


def test_nothing(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).collect() == []
