"""Sketched quantiles: exact through brackets, mergeable over days, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import sketches

SHARES = [0.0, 0.001, 0.25, 0.5, 0.95, 0.999, 1.0]


def _rows(spark):
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(size=30_000), "ties": rng.integers(0, 5, 20_000) * 1.0, "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "long tail": np.exp(rng.normal(size=20_000) * 4)}
    rows = [(k, int(i % 9), float(x)) for k, v in values.items() for i, x in enumerate(v)] + [("normal", 1, None), ("normal", 1, float("nan")), ("null", 1, None), (None, 1, 3.0)]
    return values, spark.createDataFrame(rows, "k string, day int, v double").repartition(7).cache()


def test_exact_quantiles_equal_numpy_and_rollups_stay_within_the_bound(spark):
    values, df = _rows(spark)
    got = {r["k"]: r for r in sketches.exact_quantiles(df, ["k"], "v", SHARES).collect() if r["k"] is not None}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert np.allclose([got[k][sketches.name(q)] for q in SHARES], np.quantile(v, SHARES), rtol=1e-12, atol=0), k
    daily = sketches.daily_sketches(df, ["k"], "day", "v")
    for r in sketches.quantiles(sketches.merged(daily, ["k"]), ["k"], SHARES).collect():
        if r["k"] in values:
            v = values[r["k"]]
            assert (r["n"], r["least"], r["most"]) == (len(v), v.min(), v.max()) and abs(r["mean"] - v.mean()) < 1e-9 * max(1, abs(v).max())
            for q in SHARES:
                x = r[sketches.name(q)]
                assert (v < x).mean() <= q + sketches.rank_error() and (v <= x).mean() >= q - sketches.rank_error(), (r["k"], q)


def test_brackets_that_miss_are_widened(spark):
    values, df = _rows(spark)
    wrong = df.filter("v is not null and not isnan(v) and k is not null").groupBy("k").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("v") + 1e9, F.lit(1024)).alias("sketch"))
    for r in sketches.exact_quantiles(df, ["k"], "v", [0.3, 0.9], wrong).collect():
        assert np.allclose([r["p30"], r["p90"]], np.quantile(values[r["k"]], [0.3, 0.9]), rtol=1e-12), r["k"]


def test_no_rows(spark):
    _, df = _rows(spark)
    assert sketches.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).isEmpty()
    assert sketches.merged(sketches.daily_sketches(df.limit(0), ["k"], "day", "v"), ["k"]).isEmpty()


@pytest.mark.parametrize("share, name", [(0.5, "p50"), (0.999, "p99_9"), (0.07, "p7")])
def test_names(share, name):
    assert sketches.name(share) == name
