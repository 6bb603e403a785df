"""Factors and labels of one pass; metrics from one reading of the scored rows."""

from pyspark.sql import functions as F

from tickweave.operators import evaluation, features
from tickweave.sources.ticks import ticks_from_events


def test_one_pass_gives_the_rows_of_the_join(spark, sf):
    t, names = ticks_from_events(spark, sf), ["spread", "return_10", "volatility_20", "mid"]
    got = features.factors_and_labels(t, names, (10, 3), 2)
    want = evaluation.training_set(features.compute_factors(t, names), features.compute_labels(t, (10, 3), 2))
    rows = lambda df: sorted(map(str, df.select(got.columns).collect()))
    assert rows(got) == rows(want)


def test_metrics_read_the_scored_rows_once(spark):
    rows = [("a", 0, 0, 0.5, 0.5, 0.0), ("a", 1, 0, 0.6, 0.2, 0.2), ("a", 1, 1, 0.1, 0.8, 0.1), ("a", None, 1, 0.1, 0.8, 0.1), ("b", 2, 2, 0.0, 0.0, 1.0), ("b", 1, 2, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, label int, prediction int, p0 double, p1 double, p2 double")
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda v: (seen.add(1), v)[1], "int").asNondeterministic()
    out = evaluation.classification_metrics(df.withColumn("prediction", read("prediction")), ["symbol"], probability=["p0", "p1", "p2"])
    got = {r["symbol"]: (r["n"], round(r["accuracy"], 9), round(r["f1_macro"], 9), round(r["f1_weighted"], 9), round(r["log_loss"], 6)) for r in out.collect()}
    assert got == {"a": (3, round(2 / 3, 9), round(2 / 3, 9), round(2 / 3, 9), 0.84191), "b": (2, 0.5, round(1 / 3, 9), round(1 / 3, 9), 11.512925)}
    assert seen.value == len(rows)


def test_fits_and_scores_read_rows_written_once(spark, sf):
    from tickweave.plans import queries, research

    for rows in (queries._labelled(spark, sf), research._units(spark, sf)):
        assert "parquet" not in rows._jdf.queryExecution().executedPlan().toString().lower()
