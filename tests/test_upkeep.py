"""Odd rows in reads with fallbacks, the day worker, schedule checks, coverage, boards, reports and regime rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.functions import scalars
from tickweave.operators import features, ledgers, quality, schedule
from tickweave.sources import ticks as T
from tickweave.streaming import incremental, online

DAY = dt.date(2024, 1, 10)
BASE = 1_704_844_800  # its midnight, UTC


def raw(spark, rows):
    """symbol, trading_day, seconds after midnight UTC, depth of level 2."""
    df = spark.createDataFrame(rows, "symbol string, trading_day date, s long, bid_volume2 double")
    return df.select("symbol", "trading_day", ((F.lit(BASE) + F.col("s")) * 1_000_000_000).alias("datetime_ns"), "bid_volume2")


def test_day_rows_by_windows_own_day_and_reasons(spark):
    other = DAY + dt.timedelta(days=1)
    rows = [("a", DAY, 100, 1.0), ("a", DAY, 200, 1.0), ("a", DAY, 201, 1.0), ("a", DAY, 150, 0.0), ("a", DAY, None, 1.0), ("b", DAY, 99, 1.0), ("c", DAY, 150, None)]
    rows += [("a", other, 86400, 1.0), ("b", other, 3600, 1.0), (None, other, 86400, 1.0)]  # 08:00 and the day before's 09:00 local
    windows = spark.createDataFrame([(DAY, BASE + 100, BASE + 200), (DAY, BASE + 50, BASE + 60)], "day date, start_s long, end_s long")
    kept, counts = ledgers.day_rows(raw(spark, rows), windows)
    assert sorted((r.symbol or "", r.trading_day, r.datetime_ns // 10**9 - BASE) for r in kept.collect()) == [("", other, 86400), ("a", DAY, 100), ("a", DAY, 200), ("a", other, 86400)]
    assert {"amount", "row_hash", "schedule_hash"} <= set(kept.columns)
    got = {(r.symbol, r.trading_day): (r.fetched, r.depth, r.stored, r.reason) for r in counts.collect()}
    assert got == {("a", DAY): (5, 4, 2, None), ("b", DAY): (1, 1, 0, "outside_sessions"), ("c", DAY): (1, 0, 0, "no_depth"), ("a", other): (1, 1, 1, None), ("b", other): (1, 1, 0, "other_day"), (None, other): (1, 1, 1, None)}
    assert ledgers.day_rows(raw(spark, []), windows)[1].count() == 0


def test_ticks_of_a_day_with_and_without_provenance(spark):
    old = raw(spark, [("a", DAY, 2, 1.0), ("a", DAY, 1, 1.0), ("b", DAY, 1, 1.0)])
    assert [(r.datetime_ns // 10**9 - BASE, r.row_hash, r.schedule_hash) for r in T.ticks_for_day(old, "a", "2024-01-10").collect()] == [(1, 0, None), (2, 0, None)]
    assert not set(T.PROVENANCE) & set(T.ticks_for_day(old, "a", "2024-01-10", provenance=False).columns)
    newest = T.export_rows(T.with_identity(old), per_day=1, descending=True, provenance=False)
    assert [(r.symbol, r.datetime_ns // 10**9 - BASE) for r in newest.collect()] == [("a", 2), ("b", 1)]


PLAN = "symbol string, day date, contract string, segment_id long, schedule_hash string"


def test_schedule_health_names_the_first_failed_check(spark):
    d = [DAY + dt.timedelta(days=i) for i in range(3)]
    expected = [(s, x, "c1", 0, "h") for s in "abcdefg" for x in d[:2]]
    stored = [("a", d[0], "c1", 0, "h"), ("a", d[1], "c1", 0, "h"), ("b", d[0], "c1", 0, "h"), ("c", d[0], "c1", 0, "h"), ("c", d[2], "c1", 0, "h")]
    stored += [("d", d[0], "c2", 0, "h"), ("d", d[1], "c1", 0, "h"), ("e", d[0], "c1", None, "h"), ("e", d[1], "c1", 0, "h"), ("f", d[0], "c1", 0, "h"), ("f", d[1], "c1", 0, "x")]
    stored += [("a", None, "c1", 0, "h"), ("a", d[2], None, 0, "h"), ("z", d[0], "c1", 0, "h")]  # rows without day or contract don't count
    out = schedule.schedule_health(spark.createDataFrame(stored, PLAN), spark.createDataFrame(expected, PLAN))
    assert {r.symbol: r.state for r in out.collect()} == {"a": "ok", "b": "rows", "c": "days", "d": "contracts", "e": "segments", "f": "hashes", "g": "rows", "z": "rows"}
    blank = spark.createDataFrame([("a", d[0], "c1", 0, " "), ("a", d[1], "c1", 0, None), ("b", d[0], "c", 1, "h2"), ("b", d[1], "c", 1, "h1 ")], PLAN)
    assert {r.symbol: r.hashes for r in schedule.stored_schedule_state(blank).collect()} == {"a": [], "b": ["h1", "h2"]}


def test_health_needs_a_validation_state(spark):
    missing = spark.createDataFrame([], "symbol string, day date, segment_id long, cause string")
    hashes = spark.createDataFrame([(s, 1) for s in "abcd"], "symbol string, n_hashes long")
    states = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "warn")], "symbol string, overall_state string")
    assert {r.symbol: r.healthy for r in schedule.health(missing, hashes, 0, states).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_coverage_leaves_out_contracts_with_neither(spark):
    t = raw(spark, [("a", DAY, 1, 0.0), ("b", DAY, 2, 1.0), ("c", DAY, 3, 1.0)]).withColumn("underlying_contract", F.col("symbol"))
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), ("x",), ("s",)], "contract string")
    full = T.with_missing_columns(t)
    series = full.filter("symbol = 'b'").unionByName(full.filter("symbol = 'c'").withColumn("underlying_contract", F.lit("s")))
    got = {r.contract: (r.last_tick_day, r.last_depth_day) for r in schedule.coverage(wanted, full, series, last_only=True).collect()}
    assert got == {"a": (DAY, None), "b": (DAY, DAY), "s": (None, DAY)}
    assert {r.contract: (r.tick_days, r.depth_days) for r in schedule.coverage(wanted, full).collect()} == {"a": (1, 0), "b": (1, 1)}
    assert schedule.coverage(wanted.limit(0), full, series).count() == 0


def test_board_and_totals_of_nothing_and_of_nulls(spark):
    contracts = spark.createDataFrame([("a", False, True, 5.0), ("b", True, None, 9.0), ("c", False, False, None)], "symbol string, expired boolean, complete boolean, age_s double")
    core = [f"null_{c}" for c in quality.CORE]
    fields = spark.createDataFrame([("a", DAY, *[0.0] * 5, 0.0), ("a", DAY - dt.timedelta(days=1), *[1.0] * 5, 1.0), ("b", DAY, 0.5, None, None, None, None, 0.0)], "symbol string, trading_day date, " + ", ".join(f"{c} double" for c in [*core, "null_book"]))
    gaps = spark.createDataFrame([("a", DAY, 0, 1, 7), ("b", DAY, None, None, None)], "symbol string, trading_day date, abnormal_gaps long, critical_gaps long, max_interval_ms long")
    board = quality.quality_board(contracts, fields, gaps)
    assert {r.symbol: (r.score, r.anomalies, r.status) for r in board.collect()} == {"a": (100.0, 1, "warning"), "b": (50.0, 0, "error"), "c": (None, 0, "ok")}
    assert sorted(r.symbol for r in quality.quality_board(contracts, fields, gaps, only_issues=True).collect()) == ["a", "b"]
    total = quality.quality_totals(board).first()
    assert (total.symbols, round(total.complete_pct, 4), total.score_pct, total.anomalies, total.max_age_s) == (3, 33.3333, 75.0, 1, 5.0)
    nothing = quality.quality_totals(quality.quality_board(contracts.limit(0), fields, gaps)).first()
    assert (nothing.symbols, nothing.complete_pct, nothing.score_pct, nothing.anomalies) == (0, None, None, 0)


def test_contract_report_of_an_empty_table_and_without_hashes(spark):
    t = T.with_missing_columns(raw(spark, [("a", DAY, i, 1.0) for i in range(40)]))
    hashed = t.withColumn("row_hash", scalars.row_hash(F.col("datetime_ns")))
    checks, sums = quality.contract_report(hashed, max_core_null=1.0, max_book_null=1.0)
    assert checks.filter("not passed").count() == 0
    assert sums.first().n_rows == 40 and sums.first().hash_sum is not None
    failed = lambda df: {r["check"] for r in quality.contract_report(df, max_core_null=1.0, max_book_null=1.0)[0].filter("not passed").collect()}
    assert failed(hashed.drop("row_hash", "bid_price1")) == {"missing_column:bid_price1", "rows_without_hash"}
    assert failed(hashed.limit(0)) == {"rows"}
    assert failed(hashed.withColumn("bid_price1", F.lit(2.0))) == {"rows_with_another_hash"}


def test_latest_reports_by_any_case(spark):
    rows = [("shfe", "CU", "s ", "2024-01-01", "old"), ("SHFE", "cu", "s", "2024-01-02", "new"), ("SHFE", "cu", "s", "2024-01-03", None), ("DCE", "m", "x", "2024-01-01", "d"), (None, None, None, "2024-01-01", "n")]
    reports = spark.createDataFrame(rows, "exchange string, variety string, symbol string, created_at string, report string")
    assert [(r.symbol, r.report) for r in ledgers.latest_reports(reports, "shfe ", "Cu", "s").collect()] == [("s", "new")]
    assert sorted(r.report for r in ledgers.latest_reports(reports).collect()) == ["d", "n", "new"]


def test_regime_rows_keep_the_latest_of_a_configuration(spark, tmp_path):
    states = spark.createDataFrame([("a", DAY, 0, "quiet", "[1.0]"), ("a", DAY + dt.timedelta(days=1), 1, "volatile", "[0.5]")], "symbol string, trading_day date, state int, regime string, probabilities string")
    path = str(tmp_path / "regimes")
    for config, at, n in (("k=2", "1", 2), ("k=3", "1", 2), ("k=3", "3", 1), ("k=3", "2", 2)):
        ledgers.store_regimes(spark, path, ledgers.regime_rows(states.limit(n), "mixture", config, at))
    got = spark.read.parquet(path).groupBy("trading_day").agg(F.count("*").alias("n"), F.max("updated_at").alias("at")).orderBy("trading_day").collect()
    assert [(r.n, r["at"]) for r in got] == [(2, "3"), (2, "2")]


def test_varieties_by_rollup_then_ticks(spark):
    symbols = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    out = schedule.symbols_by_variety(symbols("KQ.m@SHFE.cu", None), symbols("KQ.m@SHFE.cu", "shfe.CU2401", "SHFE.au2401", None), ["cu", "AU", "au", " ", "zn"])
    assert {r.variety: (r.symbols, r.origin) for r in out.collect()} == {"cu": (1, "rollup"), "au": (1, "ticks"), "zn": (0, "ticks")}


def test_registered_factors_over_several_batches_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    n = events.count()
    for i in range(5):  # in order of time, cut within days
        events.filter((F.col("event_id") * 5 >= i * n) & (F.col("event_id") * 5 < (i + 1) * n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.ticks_of(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream = stream.withColumn("note", F.lit("x"))
    # a factor and its step registered from outside
    features.register_factor("volume_delta_3", ("volume",), 3)(lambda: F.col("volume") - features.before(F.col("volume"), 3))
    try:
        with pytest.raises(ValueError, match="volume_delta_3"):
            incremental.incremental_factors(stream)
        incremental.register_step("volume_delta_3")(lambda trail: trail.columns["volume"] - trail.back(trail.columns["volume"], 3))
        got = online.run_to_end(incremental.incremental_factors(stream), str(tmp_path / "run"))
        want = features.compute_factors(T.ticks_from_events(spark, sf), list(features.FACTORS), ("row_hash",))
        rounded = lambda df: sorted((r["row_hash"], *[None if r[c] is None else round(r[c], 9) for c in features.FACTORS]) for r in df.collect())
        assert rounded(got) == rounded(want)
    finally:
        features.FACTORS.pop("volume_delta_3")
        incremental.STEPS.pop("volume_delta_3", None)


def test_trail_reaches_one_day_back_and_never_across_a_roll():
    trail = incremental.Trail({"bid_price1": np.array([1.0, 3, 5, 7]), "ask_price1": np.array([3.0, 5, np.nan, 9])}, np.array([0, 0, 0, 1]), np.array([1, 2, 3, 3]))
    assert trail.near(1).tolist() == [False, True, True, False] and trail.near(2).tolist() == [False] * 4
    assert np.isnan(trail.back(trail.mid, 1)).tolist() == [True, False, False, True]
    assert np.isnan(trail.deviation(trail.mid, 9)).all()
