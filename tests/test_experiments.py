"""Fits of many units against a plain Newton solver; failures stay alone; guards and the daily run."""

import datetime as dt
import pickle

import numpy as np
from pyspark.sql import functions as F

from tickweave.operators import experiments

SCHEMA = "symbol string, split_id int, role string, trading_day date, datetime_ns long, row_hash long, mid double, a double, b double, label long"
DAY = dt.date(2024, 1, 1)


def _rows(seed=4):
    rng, rows = np.random.default_rng(seed), []
    for symbol, n in (("good", 400), ("few", 20), ("flat", 200), ("split", 150)):
        for i in range(n):
            a, b = rng.normal(), rng.normal() * 3 + 1
            y = 1 if symbol == "flat" else int(np.clip(round(1 + 0.8 * a - 0.2 * b + rng.normal()), 0, 2))
            if symbol == "split":
                y = 2 if a > 0 else 0  # no finite fit without a penalty
            for split in (0, 1):
                role = "train" if i < n * (0.6 + 0.1 * split) else "val" if i < n * 0.85 else "test"
                rows.append((symbol, split, role, DAY, i, i, 100.0, float(a) if i % 50 else None, float(b), y if i % 37 else None))
    return rows


def _plain(rows, l2):
    """Newton on one unit's rows."""
    x = np.array([[r[7] or 0.0, r[8]] for r in rows])
    y = np.array([r[9] for r in rows])
    m, s = x.mean(0), x.std(0)
    x = np.hstack((np.ones((len(x), 1)), (x - m) / s))
    w, free = np.zeros(6), np.array([0, 1, 1, 0, 1, 1.0])
    for _ in range(100):
        z = np.hstack((np.zeros((len(x), 1)), x @ w.reshape(2, 3).T))
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        g = np.concatenate([((p[:, k] - (y == k))[:, None] * x).mean(0) for k in (1, 2)]) + l2 * free * w
        h = np.block([[(x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x / len(x) for j in (1, 2)] for i in (1, 2)]) + np.diag(l2 * free)
        w = w - np.linalg.solve(h, g)
    return w.reshape(2, 3)


def test_fits_equal_plain_newton_and_failures_stay_alone(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    options = [{"l2": 0.01}, {"l2": 0.0}]
    fits = experiments.fit_units(df, ["a", "b"], "label", options, min_rows=50).cache()
    got = {(r["symbol"], r["split_id"], r["option"]): r for r in fits.collect()}
    assert len(got) == 16
    for split in (0, 1):
        own = [r for r in rows if r[0] == "good" and r[1] == split and r[2] == "train" and r[9] is not None]
        for o, option in enumerate(options):
            r = got["good", split, o]
            assert r["status"] == "fitted" and r["n"] == len(own) and r["error"] is None
            assert np.allclose(pickle.loads(r["model"])[0], _plain(own, option["l2"]), atol=1e-7)
        assert (got["few", split, 0]["status"], got["few", split, 0]["error"][:4]) == ("skipped", "rows")
        assert (got["flat", split, 0]["status"], got["flat", split, 0]["error"]) == ("skipped", "one class")
        assert got["split", split, 0]["status"] == "fitted" and got["split", split, 1]["status"] == "failed"
    scored = experiments.score_units(df, ["a", "b"], "label", fits).cache()
    assert {(r["symbol"], r["option"]) for r in scored.select("symbol", "option").distinct().collect()} == {("good", 0), ("good", 1), ("split", 0)}
    bad = scored.filter((F.abs(F.col("p_down") + F.col("p_flat") + F.col("p_up") - 1) > 1e-9) | (F.col("role") == "train"))
    assert bad.isEmpty()
    table = {(r["symbol"], r["option"]): r for r in experiments.benchmark(scored).collect()}
    assert table.keys() == {("good", 0), ("good", 1), ("split", 0)}
    best = {r["symbol"]: r for r in experiments.best_options(scored).collect()}
    accuracy = {(r["symbol"], r["option"]): r["x"] for r in scored.filter("role = 'val' and label is not null").groupBy("symbol", "option").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("x")).collect()}
    assert best.keys() == {"good", "split"} and all(abs(b["accuracy"] - max(v for k, v in accuracy.items() if k[0] == s)) < 1e-12 for s, b in best.items())
    assert experiments.fit_units(df.limit(0), ["a", "b"], "label", options).isEmpty()


def test_guards(spark):
    fields = "symbol string, ticks_kind string, dataset_version string, row_hash_algo string, schedule_hash string"
    f = [("a", "main_l5", "v2", "x", "h"), ("b", "raw", "v2", "x", None), ("c", "main_l5", "v2", "x", "h"), ("d", "main_l5", "v2", "x", None), ("e", "raw", "v2", "x", None), ("KQ.m@f", "raw", "v2", None, None), ("g", "raw", "v2", "x", None), ("i", "raw", "v2", None, None)]
    lab = [("a", "main_l5", "v2", "x", "h"), ("b", "main_l5", "v2", "x", "h"), ("c", "main_l5", "v2", "x", "k"), ("d", "main_l5", "v2", "x", "h"), ("e", "raw", "v3", "x", None), ("KQ.m@f", "raw", "v2", None, None), ("g", "raw", "v2", "y", None), ("h", "raw", "v2", "x", None), ("i", "raw", "v2", "x", "h")]
    got = {r["symbol"]: r["reason"] for r in experiments.training_guards(spark.createDataFrame(f, fields), spark.createDataFrame(lab, fields)).collect()}
    assert got == {"a": None, "b": "ticks_kind_mismatch", "c": "schedule_hash_mismatch", "d": "missing_schedule", "e": "dataset_version_mismatch", "KQ.m@f": "continuous_needs_main_l5", "g": "row_hash_algo_mismatch", "h": "missing_build", "i": None}


def test_daily_run_keeps_a_state_for_each_symbol(spark, sf):
    from tickweave.sources.ticks import ticks_from_events

    t = ticks_from_events(spark, sf)
    short = t.filter("symbol = 'error' and row_hash < 200").withColumn("symbol", F.lit("short"))
    t = t.filter("symbol in ('click', 'view', 'error')").unionByName(short)
    guards = spark.createDataFrame([("click", None), ("error", None), ("short", None), ("view", "ticks_kind_mismatch")], "symbol string, reason string")
    got = {(r["symbol"], r["step"]): (r["state"], r["detail"]) for r in experiments.daily_run(t, guards, ["spread", "imbalance_1"], 10, [{"l2": 0.01}], n_splits=2, min_train=40).collect()}
    assert {s for s, _ in got} == {"click", "view", "error", "short"}
    assert got["view", "guard"] == ("held", "ticks_kind_mismatch") and {k[1] for k in got if k[0] == "view"} == {"guard"}
    assert got["short", "fit"][0] == "failed" and ("short", "evaluation") not in got and got["short", "features"][0] == "built"
    for s in ("click", "error"):
        assert got[s, "fit"][0] == "fitted" and got[s, "evaluation"][0] in ("better_than_chance", "not_better") and got[s, "promotion"][0] in ("held", "promoted")


def test_units_of_a_batch_and_rows_dealt_to_splits_by_their_reader(spark):
    import pyarrow as pa

    from tickweave.operators import evaluation

    batch = pa.RecordBatch.from_pydict({"symbol": ["b", "a", "b", "b"], "split_id": pa.array([-1, 2, 2, -1], pa.int32()), "_x0": [1.0, 2.0, 3.0, 4.0], "y": pa.array([0, 1, 2, 1], pa.int32())})
    found = {u: (x.ravel().tolist(), y.tolist()) for u, x, y in experiments._units_of(batch, 1)}
    assert found == {("b", -1): ([1.0, 4.0], [0, 1]), ("a", 2): ([2.0], [1]), ("b", 2): ([3.0], [2])}
    rows = spark.range(70).selectExpr("'s' AS symbol", "id AS pos")
    split = evaluation.walk_forward_by_symbol(rows, min_train=1)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert split.groupBy("split_id").count().orderBy("split_id").collect() == [(i, 10 * (i + 3)) for i in range(5)]


def test_daily_run_scores_the_newest_split_alone(spark, sf, monkeypatch):
    from tickweave.plans import research

    seen, score = [], experiments.score_units
    monkeypatch.setattr(experiments, "score_units", lambda rows, *a: seen.append(rows) or score(rows, *a))
    research.k17_daily_run(spark, sf)
    splits = {r["symbol"]: r["n"] for r in seen[0].groupBy("symbol").agg(F.count_distinct("split_id").alias("n")).collect()}
    assert splits and set(splits.values()) == {1}
