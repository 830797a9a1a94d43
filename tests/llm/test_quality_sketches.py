"""Thresholds from sketches that meet in two steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import quality


def _measures(spark, n, slices):
    rows = spark.range(0, n, 1, slices)
    lang = F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 7 == 0, None).otherwise("de")
    source = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 != 0, F.concat(F.lit("s"), F.col("id") % 11))
    values = {m: (F.col("id") * (7919 + 2 * i) % 10007) / 100 for i, m in enumerate(quality.MEASURES)}
    return rows.select("id", lang.alias("lang"), source.alias("source"), F.lit(9).alias("n_words"),
                       *(v.alias(m) for m, v in values.items()))


def _lower(values, p):
    return sorted(values)[int(np.ceil(p * len(values))) - 1]


def test_quartiles_of_all_levels_equal_sorted_values(spark):
    measures = _measures(spark, 4000, 90)  # more tasks than parts
    rows = measures.toPandas().astype({"lang": object, "source": object})
    rows = rows.where(rows.notna(), None)
    levels = zip(quality.quartiles(measures), (["lang", "source"], ["lang"], []))
    for found, keys in levels:
        found = found.collect()
        groups = {}
        for r in rows.itertuples():
            groups.setdefault(tuple(getattr(r, k) for k in keys), []).append(r)
        assert len(found) == len(groups)
        for r in found:
            members = groups[tuple(r[k] for k in keys)]
            assert r.n == len(members)
            for m in quality.MEASURES:
                values = [getattr(x, m) for x in members]
                assert list(r.q[m]) == [_lower(values, 0.25), _lower(values, 0.75)]


def test_small_sketches_stay_near_the_true_rank(spark):
    measures = _measures(spark, 60_000, 40)
    whole = quality.quartiles(measures, sketch=400)[2].first()
    for m in quality.MEASURES:
        values = np.sort(measures.select(m).toPandas()[m].to_numpy())
        for got, p in zip(whole.q[m], (0.25, 0.75)):
            assert abs(np.searchsorted(values, got) / len(values) - p) < 0.03


def test_no_rows_give_no_fences(spark):
    assert quality.fences(_measures(spark, 100, 2).filter("id < 0")).count() == 0
    assert quality.fences(_measures(spark, 100, 2).withColumn("n_words", F.lit(0))).count() == 0
