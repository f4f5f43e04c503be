"""Correlograms against all pairs, and where all pairs would be too many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltair.operators import trains


@pytest.mark.parametrize("auto", [False, True])
@pytest.mark.parametrize(("width", "bin_us", "piece"), [(40, 10, 1 << 19), (25, 10, 7), (7, 10, 5)])
def test_lags_against_all_pairs(spark, monkeypatch, auto, width, bin_us, piece):
    monkeypatch.setattr(trains, "SLICE", piece)
    monkeypatch.setattr(trains, "WIDTHS", 2)
    r = np.random.default_rng(5)
    rows = [(str(r.choice(["a", "b", "c"])), int(r.integers(-200, 200)), int(r.integers(0, 100))) for _ in range(160)]
    rows += rows[:5] + [(None, 3, 1), ("a", None, 2), ("b", 4, None)]
    want = {}
    for u, x, i in rows:
        for w, y, j in rows:
            if None in (u, x, w, y) or abs(x - y) >= width or (u != w or None in (i, j) or i == j if auto else u >= w):
                continue
            key = (u, w, (x - y) // bin_us)
            want[key] = want.get(key, 0) + 1
    found = trains.correlogram(spark.createDataFrame(rows, "unit string, us long, spike long"), width, bin_us, auto)
    assert {(x.unit1, x.unit2, x.bin): x.n for x in found.collect()} == want


def test_lags_of_a_crowded_instant(spark):
    """All pairs would be 4e10."""
    train = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("unit"), F.lit(5).cast("long").alias("us"), F.col("id").alias("spike"))
    assert [tuple(x) for x in trains.correlogram(train, 60, 10).collect()] == [("a", "b", 0, 200_000**2)]
    assert sorted(tuple(x) for x in trains.correlogram(train, 60, 10, auto=True).collect()) == [(u, u, 0, 200_000 * 199_999) for u in "ab"]
