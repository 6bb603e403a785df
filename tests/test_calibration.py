"""Delayed labels and online calibration against a plain loop, across micro-batches."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from tickweave.streaming import online

SCHEMA = "symbol string, datetime_ns long, row_hash long, mid double, x double"


def _plain(rows, horizon, threshold, rate=0.01, decay=0.999, l2=1e-3, clip=1.0):
    w, n, seen, out = np.zeros((3, 2)), 0, [], {}
    for _, _, i, mid, x in rows:
        label = None
        if len(seen) >= horizon and mid is not None:
            features, before = seen[-horizon]
            label = 2 if mid - before >= threshold else 0 if mid - before <= -threshold else 1
            p = np.exp(w @ features) / np.exp(w @ features).sum()
            g = np.outer(p - np.eye(3)[label], features) + l2 * w
            w = w - rate * decay**n * g * min(1.0, clip / np.linalg.norm(g))
            n += 1
        features = np.array([1.0, x or 0.0])
        p = np.exp(w @ features)
        out[i] = (label, *(p / p.sum()))
        if mid is not None:
            seen.append((features, mid))
    return out


def test_online_calibration_equals_a_plain_loop_however_it_is_cut(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{i % 2}", i // 2, i, None if i % 31 == 0 else float(100 + rng.integers(-3, 4)), None if i % 17 == 0 else float(rng.normal())) for i in range(200)]
    want = {}
    for s in ("s0", "s1"):
        want |= _plain([r for r in rows if r[0] == s], 3, 1.0)
    for cut in (200, 60):
        root = tempfile.mkdtemp(prefix="spark-")
        for k, a in enumerate(range(0, 200, cut)):
            spark.createDataFrame(rows[a : a + cut], SCHEMA).coalesce(1).write.parquet(f"{root}/in/{k}")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/*")
            got = online.run_to_end(online.online_calibration(stream, ["x"], 3, 1.0), root)
        found = {r["row_hash"]: r for r in got.collect()}
        assert found.keys() == want.keys()
        for i, (label, *p) in want.items():
            r = found[i]
            assert r["delayed_label"] == label and np.allclose([r["p_down"], r["p_flat"], r["p_up"]], p, atol=1e-12)


def test_blank_and_repeated_messages(spark):
    rows = [("a", 1), ("a", 2), (" ", 3), (None, 4), ("", 5), ("b", 6)]
    root = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "message string, n long").coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("message string, n long").parquet(f"{root}/in").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")))
    got = online.run_to_end(online.unique_ids(stream, "message").drop("ts"), root)
    assert sorted(r["message"] for r in got.collect()) == ["a", "b"]
