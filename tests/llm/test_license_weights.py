"""License scores with the true document frequency of every term."""

from __future__ import annotations

from collections import Counter

import numpy as np

from tests.llm import brute
from tidewatch.llm import licenses


def test_common_words_beside_a_template_weigh_little(spark):
    lines = ["Our work here is licensed under the Apache License, Version 2.0.",
             "Licensed under CC BY-NC 4.0 unless noted.", "Licensed under CC BY-NC 4.0 zyx wvu tsr qpo nml kji."]
    texts = lines + [f"our work is here unless noted otherwise {i}" for i in range(500)]
    df = spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, t in enumerate(texts)], "n int, path string, text string")
    found = {r.row.n: (r.own_license, r.own_score) for r in licenses.scan(df).collect()}
    counts, total = Counter(t for text in texts for t in set(brute.bench_words(text))), len(texts)

    def vector(text):
        return {t: n * (np.log((total + 1) / (counts[t] + 1)) + 1) for t, n in Counter(brute.bench_words(text)).items()}

    def cosine(a, b):
        dot = sum(x * b.get(t, 0) for t, x in a.items())
        return dot / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    for i, text in enumerate(texts):
        low, name = min((-cosine(vector(text), vector(t)), name) for name, t in licenses.TEMPLATES)
        if -low >= licenses.THRESHOLD:
            assert found[i][0] == name and abs(found[i][1] + low) < 2e-6
        else:
            assert found[i] == (None, None)
    assert [found[i][0] for i in range(2)] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert found[0][1] > 0.99 and found[1][1] > 0.99  # 0.86 and 0.84 if "our work is here" counted as never seen
