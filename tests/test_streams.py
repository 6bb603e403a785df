"""Stateful streams: store, silent features, targets, late ticks; cuts, restarts, order and odd rows."""

import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickweave.streaming import online, state
from tickweave.streaming.late import DayTable

UPDATES = "op string, symbol string, feature string, value double, at long, seq long, ttl_s long"
SEEN = "symbol string, feature string, ms long, ttl_s long"
TICKS = "symbol string, datetime_ns long, row_hash long, trading_day date, last_price double"
DAY = 86_400_000_000_000


class Feed:
    """Batches of rows written one after the other into the folder of a stream."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.root, self.n = spark, schema, tempfile.mkdtemp(prefix="spark-"), 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.root}/in/{self.n}")
        self.n += 1
        return self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in/*")


def _final(updates):
    """Store after all updates, by plain rules."""
    clears = [u for u in updates if u[0] != "put"]
    out = {}
    for _, s, f, v, at, seq, ttl in sorted((u for u in updates if u[0] == "put" and u[1] and u[2]), key=lambda u: (u[4], u[5])):
        if not any((c[4], c[5]) >= (at, seq) and (c[0] == "clear_all" or c[1] == s) for c in clears):
            out[s, f] = (v, at, 60 if ttl is None else ttl)
        else:
            out.pop((s, f), None)
    return out


def test_store_is_the_same_however_updates_arrive(spark):
    updates = [("put", f"s{i % 3}", f"f{i % 4}", float(i), 100 + (i * 7) % 40, i, [None, 0, 30][i % 3]) for i in range(40)]
    updates += [("clear", "s1", None, None, 118, 900, None), ("clear_all", None, None, None, 109, 901, None), ("put", "s0", "f9", None, 130, 902, 5), ("put", None, "f0", 1.0, 999, 903, 5), ("put", "s0", None, 1.0, 999, 904, 5), ("clear", None, None, None, 999, 905, None)]
    for order in (updates, updates[::-1]):
        feed = Feed(spark, UPDATES)
        store = state.FeatureStore(f"{feed.root}/state", buckets=3)
        for a in range(0, len(order), 16):
            store.feed(feed.add(order[a : a + 16]))
        got = {(r["symbol"], r["feature"]): (r["value"], r["at"], r["ttl_s"]) for r in store.entries(spark).collect()}
        assert got == _final(updates) and ("s0", "f9") in got


def test_store_get_batch_get_and_clears(spark):
    feed = Feed(spark, UPDATES)
    store, seen = state.FeatureStore(f"{feed.root}/state", buckets=2), []
    keep = lambda batch, _: seen.extend((r["symbol"], r["feature"], r["change"]) for r in batch.collect())
    store.feed(feed.add([("put", "a", "x", 1.0, 100, 1, 60), ("put", "a", "y", 2.0, 150, 2, 0), ("put", "b", "x", 3.0, 190, 3, None)]), keep)
    wanted = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "none")], "symbol string, feature string")
    look = lambda now, stale=False: {(r["symbol"], r["feature"]): (r["value"], r["is_stale"]) for r in state.lookup(store.entries(spark), wanted, now, stale).collect()}
    assert look(200) == {("a", "x"): (None, True), ("a", "y"): (2.0, False), ("b", "x"): (3.0, False), ("b", "none"): (None, False)}
    assert look(160)["a", "x"] == (1.0, False) and look(161)["a", "x"] == (None, True)  # ttl 60: stale beyond it
    assert look(10**6, True) == {("a", "x"): (1.0, True), ("a", "y"): (2.0, False), ("b", "x"): (3.0, True), ("b", "none"): (None, False)}
    store.feed(feed.add([("clear", "a", None, None, 200, 4, None)]), keep)
    assert {r["symbol"] for r in store.entries(spark).collect()} == {"b"}
    store.feed(feed.add([("clear_all", None, None, None, 300, 5, None), ("put", "c", "x", 9.0, 301, 6, 1), ("put", "b", "x", 9.0, 299, 7, 1)]), keep)
    assert [(r["symbol"], r["at"]) for r in store.entries(spark).collect()] == [("c", 301)]
    assert sorted(seen) == sorted([("a", "x", "put"), ("a", "y", "put"), ("b", "x", "put"), ("a", "x", "cleared"), ("a", "y", "cleared"), ("b", "x", "cleared"), ("c", "x", "put")])


def test_ttl_of_an_update_then_registry_then_default(spark):
    rows = spark.createDataFrame([("x", 5), ("x", None), ("y", None), (None, None)], "feature string, ttl_s int")
    registry = spark.createDataFrame([("x", 7), ("x", 7)], "feature string, ttl_s int")
    assert sorted(r["ttl_s"] for r in state.with_ttl(rows, registry, 60).collect()) == [5, 7, 60, 60]
    assert sorted(r["ttl_s"] for r in state.with_ttl(rows.drop("ttl_s"), None, 9).collect()) == [9] * 4


def test_silent_features_survive_restarts_and_disorder(spark):
    rows = [(f"s{i % 2}", f"f{i % 3}", 10_000 + (i * 977) % 400_000, [2, 30, 0][i % 3]) for i in range(150)]
    rows += [("s0", "f0", 1_000_000, 2), (None, "f0", 1000, 2), ("s0", None, 1000, 2), ("s0", "f0", None, 2)]
    for cut in (154, 40):
        feed, events = Feed(spark, SEEN), []
        ordered = sorted(rows, key=lambda r: (r[2] or 0) // 50_000)  # shuffled inside spans that the delay covers
        for a in range(0, len(ordered), cut):
            stream = feed.add(ordered[a : a + cut]).withColumn("ts", F.timestamp_millis("ms"))
            state.run(state.watch(stream, "100 seconds"), f"{feed.root}/state", handler=lambda batch, _: events.extend(tuple(r) for r in batch.collect()))
        plain = spark.createDataFrame(rows, SEEN).withColumn("ts", F.timestamp_millis("ms"))
        want = sorted(tuple(r) for r in state.silent_events(plain, 100_000).collect())
        assert sorted(events) == want and len({e[3] for e in want}) == 2 and not any(e[1] == "f2" for e in want)
        # the timer fired without an update of its own key
        assert ("s1", "f0") in {e[:2] for e in events if e[3] == "stale" and e[2] > 140_000}


def test_runs_merge_in_any_order():
    assert state.merged_runs([(0, 5), (20, 30)], [12, 40, 3], 7) == [(0, 12), (20, 30), (40, 40)]
    assert state.merged_runs([], [], 7) == [] and state.merged_runs([(0, 1)], [8, 15, 22], 7) == [(0, 22)]


def test_targets_of_a_fitted_model_change_as_in_batch(spark):
    rows = [(f"s{i % 2}", i // 2, i, float((i * 37) % 11), float((i * 13) % 7), float((i * 37) % 11 > (i * 13) % 7)) for i in range(240)]
    schema = "symbol string, datetime_ns long, row_hash long, a double, b double, label double"
    ticks = spark.createDataFrame(rows, schema)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep"), LogisticRegression(maxIter=5)]).fit(ticks)
    up = vector_to_array("probability")[1]
    target = state.target_of(up, 1 - up, 0.6, 0.7, 3)
    want = sorted((r["symbol"], r["row_hash"], r["target"]) for r in online.target_changes(model.transform(ticks).withColumn("target", target)).collect())
    feed, got = Feed(spark, schema), []
    for a in range(0, 240, 50):
        state.run(state.score_changes(feed.add(rows[a : a + 50][::-1]), model, target), f"{feed.root}/state", handler=lambda batch, _: got.extend((r["symbol"], r["row_hash"], r["target"]) for r in batch.collect()))
    assert sorted(got) == want and {t for _, _, t in want} >= {3, -3}
    # without a prediction the target is null until one comes
    feed, got = Feed(spark, schema), []
    odd = [("s", 1, 1, None, 1.0, 0.0), ("s", 2, 2, None, 1.0, 0.0), ("s", 3, 3, 1.0, 1.0, 0.0), ("s", 4, 4, None, 1.0, 0.0), (None, 5, 5, 1.0, 1.0, 0.0)]
    steps = Pipeline(stages=[]).fit(ticks)
    for r in odd:
        state.run(state.score_changes(feed.add([r]), steps, F.col("a")), f"{feed.root}/state", handler=lambda batch, _: got.extend((x["row_hash"], x["target"]) for x in batch.collect()))
    assert got == [(1, None), (3, 1), (4, None)]


def _tick(day, second, i, price=1.0, symbol="s"):
    return (symbol, day * DAY + second * 10**9, i, None, price)


def _sums(ticks):
    return ticks.groupBy("symbol", "trading_day").agg(F.count("*").alias("n"), F.sum("last_price").alias("total"))


def test_late_ticks_mend_their_days_and_replays_change_nothing(spark):
    feed = Feed(spark, TICKS)
    table = DayTable(spark, f"{feed.root}/days", _sums, 3600)
    arrivals = [
        [_tick(0, 100, 1), _tick(0, 200, 2), _tick(1, 100, 3)],
        [_tick(2, 7200, 4), _tick(0, 300, 5), _tick(0, 200, 2)],  # behind the watermark: a new tick of day 0 and a repeated one
        [_tick(1, 50, 6, 5.0), _tick(2, 7300, 7)],
        [],
        [_tick(4, 100, 8)],
    ]
    every = []
    for rows in arrivals:
        stream = feed.add(rows).withColumn("trading_day", F.to_date(F.timestamp_seconds(F.expr("datetime_ns div 1000000000"))))
        state.run(stream, f"{feed.root}/state", handler=table.take)
        every += rows
        if every and table.ledger().count():
            ledger = table.ledger().agg(F.max("watermark_ns")).first()[0]
            plain = {}
            for s, ns, i, _, p in set(every):
                plain.setdefault((s, ns // DAY), []).append(p)
            want = {k: (len(v), sum(v)) for k, v in plain.items() if (k[1] + 1) * DAY <= ledger // DAY * DAY}
            got = {(r["symbol"], r["trading_day"].toordinal() - 719163): (r["n"], r["total"]) for r in table.built().collect()}
            assert got == want
    assert sorted((r["row_hash"], r["batch"]) for r in table.late().collect()) == [(2, 1), (5, 1), (6, 2)]
    before, days = sorted(map(str, table.ledger().collect())), sorted(map(str, table.built().collect()))
    for number in (0, 1, 2):
        table.take(table.ticks().filter(F.col("batch") == number).drop("batch", "is_late"), number)
    assert sorted(map(str, table.ledger().collect())) == before and sorted(map(str, table.built().collect())) == days
    assert len(days) == 3


def test_a_batch_that_failed_before_its_ledger_row_is_not_seen(spark):
    calls = []

    def build(ticks):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return _sums(ticks)

    table = DayTable(spark, tempfile.mkdtemp(prefix="spark-"), build, 0)
    day = F.to_date(F.timestamp_seconds(F.expr("datetime_ns div 1000000000")))
    batch = lambda rows: spark.createDataFrame(rows, TICKS).withColumn("trading_day", day)
    table.take(batch([_tick(0, 1, 1), _tick(1, 1, 2)]), 0)
    with pytest.raises(RuntimeError):
        table.take(batch([_tick(0, 2, 3), _tick(2, 1, 4)]), 1)
    assert table.ticks().count() == 2 and [r["n"] for r in table.built().collect()] == [1]
    table.take(batch([_tick(0, 2, 3), _tick(2, 1, 4)]), 1)
    assert table.ticks().count() == 4 and sorted(r["n"] for r in table.built().collect()) == [1, 2]
