"""Values find the first range that holds them, as a loop over all ranges does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import ranges as R


def by_hand(values, spans):
    out = []
    for v in values:
        held = [o for lo, hi, o in spans if v is not None and v == v and lo is not None and hi is not None and o is not None and lo <= v <= hi]
        out.append(min(held, default=None))
    return out


def run(spark, values, spans):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").repartition(3)
    given = spark.createDataFrame(spans, "lo double, hi double, o long")
    return [r.first for r in R.first_range(rows, "v", given, "lo", "hi", "o").orderBy("k").collect()]


@pytest.mark.parametrize("held", [1 << 20, 1])
@pytest.mark.parametrize("ends", [4096, 7])
def test_against_a_loop(spark, monkeypatch, held, ends):
    monkeypatch.setattr(R, "BROADCAST", held)
    monkeypatch.setattr(R, "ENDS", ends)
    monkeypatch.setattr(R, "ROWS", 60)
    rng = np.random.default_rng(ends)
    lo = np.round(rng.uniform(0, 10, 120), 1)
    spans = [(a, round(a + w, 1), o) for a, w, o in zip(lo.tolist(), rng.choice([0, 0.1, 1, 9, -1], 120).tolist(), rng.permutation(120).tolist(), strict=True)]
    spans += [(None, 5.0, 200), (1.0, None, 201), (0.0, 9.0, None), (float("-inf"), 0.5, 300), (9.5, float("inf"), 301), (0.0, 10.0, 302)]
    values = np.round(rng.uniform(-1, 12, 300), 1).tolist() + [4.0] * 150 + [None, float("nan")]
    assert run(spark, values, spans) == by_hand(values, spans)


def test_few_and_none(spark):
    assert run(spark, [1.0, 2.0], []) == [None, None]
    assert run(spark, [], [(0.0, 1.0, 1)]) == []
    assert run(spark, [0.0, 1.0, 1.1], [(0.0, 1.0, 5), (1.0, 2.0, 6)]) == [5, 5, 6]


def test_many_ranges_without_a_nested_loop(spark):
    """10^5 ranges, half of them long, over 10^5 values: in seconds."""
    n = 100_000
    given = spark.range(n).select((F.col("id") * 7919 % n / 100.0).alias("lo"), ((F.col("id") * 7919 % n + F.when(F.col("id") % 2 == 0, 3).otherwise(40_000)) / 100.0).alias("hi"), (F.col("id") * 31 % n).alias("o"))
    rows = spark.range(n).select("id", (F.col("id") * 104_729 % (2 * n) / 150.0).alias("v"))
    got = R.first_range(rows, "v", given, "lo", "hi", "o").orderBy("id").toPandas()
    table = given.toPandas()
    for k in np.random.default_rng(0).integers(0, n, 300):
        held = table.o[(table.lo <= got.v[k]) & (table.hi >= got.v[k])]
        assert (got["first"][k] == held.min()) if len(held) else np.isnan(got["first"][k])
