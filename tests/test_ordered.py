"""Ticks pass a step in order, an Arrow batch at a time, their state carried over batches and micro-batches."""

import tempfile

import pandas as pd
import pytest

from tickweave.streaming import online, ordered

SCHEMA = "symbol string, datetime_ns long, row_hash long, size long"


def _counted(symbol, rows, state):
    """Each tick's number, how many came with it, and the tick before."""
    n, before = state or (0, None)
    ids = rows["row_hash"].tolist()
    out = rows[["symbol", "datetime_ns", "row_hash"]].assign(nth=range(n, n + len(ids)), together=len(ids), before=pd.array([before, *ids[:-1]], dtype="Int64"), size=rows["size"])
    return out, (n + len(ids), ids[-1])


def test_a_step_sees_few_ticks_at_a_time_and_all_in_order(spark):
    big = 1_700_000_000_000_000_000
    rows = [((None, "a", "b")[i % 3], big + (i // 6) * 7, i, big + i) for i in range(900)] + [("late", big + 10**6, 900, 1)]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "40")
    try:
        root = tempfile.mkdtemp(prefix="spark-")
        for k, part in enumerate((rows[:500], rows[500:800], rows[800:])):
            spark.createDataFrame(part[::-1], SCHEMA).coalesce(1).write.parquet(f"{root}/in/{k}")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/*")
            got = online.run_to_end(ordered.InOrder(stream, _counted, "symbol string, datetime_ns long, row_hash long, nth long, together long, before long, size long"), root)
        found = {r["row_hash"]: r for r in got.collect()}
    finally:
        spark.conf.set(limit, was)
    assert found.keys() == set(range(901)) and got.count() == 901
    assert max(r["together"] for r in found.values()) <= 40
    for i in range(900):
        assert (found[i]["nth"], found[i]["before"], found[i]["size"]) == (i // 3, i - 3 if i > 2 else None, big + i)
    assert found[900]["nth"] == 0 and found[900]["before"] is None


@pytest.mark.parametrize("name", ["n1_stream_factors", "m2_m3_stream_factors", "m4_m5_online_calibration"])
def test_queries_of_streams_hold_no_whole_micro_batch(spark, sf, monkeypatch, name):
    from tickweave.plans.queries import QUERIES

    seen = []
    whole = ordered.InOrder.run_to_end
    monkeypatch.setattr(ordered.InOrder, "run_to_end", lambda self, path: seen.append(self) or whole(self, path))
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(seen) == 1
