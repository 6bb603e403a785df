"""Literal cases and edge rules of the tick operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickweave.functions import calendars, scalars
from tickweave.operators import features, quality, schedule, validation
from tickweave.sources import ticks as T

DAY = dt.date(2025, 1, 2)


def _book(spark, rows):
    cols = "symbol string, segment_id long, trading_day date, datetime_ns long, row_hash long, bid_price1 double, ask_price1 double, bid_volume1 double, ask_volume1 double"
    return spark.createDataFrame([("a", 0, DAY, i, i, *r) for i, r in enumerate(rows)], cols)


def test_fill_labels_first_offsets(spark):
    df = _book(spark, [(100.0, 102.0, 10.0, 14.0), (102.0, 103.0, 1.0, 1.0), (100.0, 101.0, 1.0, 1.0), (99.0, 100.0, 1.0, 1.0)])
    rows = features.fill_labels(df, (1, 3), (0,)).filter("row_hash = 0").collect()
    got = {r["side"]: r for r in rows}
    assert got["bid"]["fill_prob_1"] == 0 and got["bid"]["time_to_fill_1"] is None and got["bid"]["time_to_fill_3"] == 3
    assert got["ask"]["time_to_fill_1"] == 1


def test_fill_labels_levels(spark):
    rows = features.fill_labels(_book(spark, [(100.0, 101.0, 5.0, 7.0)] * 2), (1,), (1,)).filter("row_hash = 0").collect()
    got = {r["side"]: (r["order_price"], r["queue_position"]) for r in rows}
    assert got == {"bid": (99.0, 10.0), "ask": (102.0, 14.0)}


def _gaps(spark, seconds, threshold):
    iv = spark.createDataFrame([("a", DAY, "day", 1, 0, 5)], "symbol string, trading_day date, session string, seq int, start_s long, end_s long")
    sec = spark.createDataFrame([("a", DAY, s, n) for s, n in seconds], "symbol string, trading_day date, sec long, n long")
    return validation.day_summary(sec, iv, default_threshold=threshold).head(), validation.with_threshold(validation.gap_segments(sec, iv), {}, threshold).filter("is_gap").collect()


def test_gap_stats_event_day(spark):
    day, gaps = _gaps(spark, [(1, 1), (4, 1)], 5)
    assert (day["expected_seconds"], day["strict_seconds"], day["missing_seconds"], day["missing_segments"], day["end_lag_s"]) == (6, 4, 2, 0, 1)
    assert day["cadence"] == "event" and not gaps


def test_gap_stats_fixed_day(spark):
    day, gaps = _gaps(spark, [(1, 2), (4, 2)], 2)
    assert day["missing_half_seconds"] == 2 and day["gap_2_5"] == 1
    assert [(g["gap_start"], g["gap_end"]) for g in gaps] == [(2, 3)]


def test_gap_stats_missing_day(spark):
    day, _ = _gaps(spark, [(9, 1)], 2)
    assert day["missing_day"] and day["outside_seconds"] == 1 and day["missing_segments"] == 1


def test_roll_schedule(spark):
    days = spark.createDataFrame([(dt.date(2025, 1, d),) for d in (2, 3, 4)], "day date")
    events = spark.createDataFrame([("cu", dt.date(2025, 1, 2), "cu2501"), ("cu", dt.date(2025, 1, 4), "cu2502")], "symbol string, day date, contract string")
    got = [(r["contract"], r["segment_id"]) for r in schedule.daily_schedule(days, events).orderBy("day").collect()]
    assert got == [("cu2501", 0), ("cu2501", 0), ("cu2502", 1)]


def test_session_shift_and_skip(spark):
    sessions = calendars.sessions_from_json(spark.createDataFrame([('{"night": [["21:00", "25:00"]], "day": [["9:00:00", "11:30:00"]]}',)], "json string"))
    days = spark.createDataFrame([(dt.date(2019, 12, 26), dt.date(2019, 12, 25))], "day date, previous date")
    intervals = calendars.session_intervals(days, sessions)
    make = "exchange string, variety string, session string, action string, start_day date, end_day date, start_time string, end_time string"
    shift = spark.createDataFrame([("SHFE", None, "night", "shift_start", dt.date(2019, 12, 26), dt.date(2019, 12, 26), "22:30", None)], make)
    night = calendars.apply_events(intervals, shift).filter("session = 'night'").head()
    assert night["start_s"] == int(dt.datetime(2019, 12, 25, 14, 30, tzinfo=dt.timezone.utc).timestamp())
    skip = shift.withColumn("action", F.lit("skip"))
    assert [r["session"] for r in calendars.apply_events(intervals, skip).collect()] == ["day"]


def test_scalars(spark):
    df = spark.createDataFrame([(" shfe.CU2501 ",), ("ag2412",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.contract_symbol(F.col("s"), "SHFE")).collect()] == ["SHFE.cu2501", "SHFE.ag2412", None, None]
    clock = spark.createDataFrame([("25:00:00",), ("9:30",), ("x",)], "s string").select(scalars.clock_seconds(F.col("s"))).collect()
    assert [r[0] for r in clock] == [90000, 34200, None]
    dates = spark.createDataFrame([("20250102",), ("2025-01-02",), ("1735776000",), ("no",)], "s string").select(scalars.any_date(F.col("s"))).collect()
    assert [r[0] for r in dates] == ["2025-01-02", "2025-01-02", "2025-01-02", None]
    start = spark.createDataFrame([("SHFE.cu2513",), ("SHFE.cu2512",), ("SHFE.cu",)], "s string").select(scalars.contract_start_month(F.col("s"))).collect()
    assert [r[0] for r in start] == [None, dt.date(2025, 12, 1), None]


def test_holidays_in_three_shapes(spark):
    df = spark.createDataFrame([('["2025-01-01"]',), ('{"holidays": ["20250501"]}',), ('{"2025": ["2025-10-01"]}',)], "json string")
    assert sorted(str(r["day"]) for r in calendars.holidays_from_json(df).collect()) == ["2025-01-01", "2025-05-01", "2025-10-01"]


def test_book_invariants(spark):
    df = T.with_missing_columns(T.synthetic_ticks(spark, 5).withColumnRenamed("datetime", "datetime_ns").withColumn("trading_day", F.lit(DAY)))
    bad = df.withColumn("bid_price1", F.when(F.col("volume") == 1, F.col("ask_price1") + 1).otherwise(F.col("bid_price1"))).withColumn("ask_volume1", F.when(F.col("volume") == 2, -1.0).otherwise(F.col("ask_volume1")))
    row = quality.field_quality(bad).head()
    assert (row["n_rows"], row["crossed"], row["negative_volumes"], row["negative_prices"]) == (5, 1, 1, 0)
    assert quality.data_contract(T.synthetic_ticks(spark, 3)).count() == 0


def test_upsert_keeps_latest_and_other_days(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k string, v long, trading_day date"
    T.upsert(spark, path, spark.createDataFrame([("a", 1, DAY), ("b", 1, dt.date(2025, 1, 3))], schema), ["trading_day", "k"], "v")
    T.upsert(spark, path, spark.createDataFrame([("a", 2, DAY), ("c", 1, DAY)], schema), ["trading_day", "k"], "v")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_readers_and_schema(spark, tmp_path):
    df = T.synthetic_ticks(spark, 4)
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert T.read_ticks(spark, str(tmp_path / "t.parquet")).count() == 4
    with pytest.raises(ValueError):
        T.read_ticks(spark, "x.xlsx")
    got = {(r["kind"], r["column"]) for r in T.schema_problems(df.drop("volume"), ["symbol", "volume"]).collect()}
    assert ("missing", "volume") in got and ("extra", "datetime") in got
    with pytest.raises(ValueError):
        T.read_only_sql(spark, "drop table x")
    assert T.read_only_sql(spark, "select 1 as a").head()["a"] == "1"


def test_no_label_beyond_the_next_day(spark):
    rows = [("a", 0, dt.date(2025, 1, d), d * 10 + i, d * 10 + i, 100.0 + d, 101.0 + d) for d in (2, 3, 4) for i in range(2)]
    df = spark.createDataFrame(rows, "symbol string, segment_id long, trading_day date, datetime_ns long, row_hash long, bid_price1 double, ask_price1 double")
    got = {r["row_hash"]: r["label_3"] for r in features.compute_labels(df, (3,)).collect()}
    assert got == {20: 2, 21: None, 30: 2, 31: None, 40: None, 41: None} or got[20] == 2 and got[21] is None


def test_walk_forward_reaches_the_end_of_every_symbol(spark, sf):
    from tickweave.plans.queries import QUERIES
    from tickweave.sources.ticks import ticks_from_events

    sizes = {r["symbol"]: r["count"] for r in ticks_from_events(spark, sf).groupBy("symbol").count().collect()}
    last = {r["symbol"]: r["n"] for r in QUERIES["k2_k3_walk_forward_by_symbol"](spark, sf).filter("split_id = 4").groupBy("symbol").agg({"n": "sum"}).toDF("symbol", "n").collect()}
    assert {s: n // 7 * 7 for s, n in sizes.items() if int(n // 7 * 7 * 0.7) >= 100} == last and last


def test_row_hash_bits_equals_plain_integers(spark):
    import struct

    rows = [(5, 1.5, None), (1_735_689_600_000_000_000, -0.25, 3.0), (0, 0.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t long, a double, b double").coalesce(1).select(scalars.row_hash_bits(F.col("t"), ["a", "b"])).collect()]
    for (t, a, b), h in zip(rows, got, strict=True):
        want = scalars.HASH_START
        for bits in (t, *(struct.unpack("<q", struct.pack("<d", x or 0.0))[0] for x in (a, b))):
            want = ((want ^ (bits % 2**64)) * scalars.HASH_PRIME) % 2**64
        assert h == (want - 2**64 if want >= 2**63 else want)


def test_negative_volumes_queue_at_zero_and_fills_reach_500_ticks(spark):
    df = _book(spark, [(100.0, 101.0, -5.0, 7.0)] + [(100.0, 102.0, 1.0, 1.0)] * 498 + [(99.0, 100.0, 1.0, 1.0)])
    rows = {r["side"]: r for r in features.fill_labels(df).filter("row_hash = 0 and price_level = 0").collect()}
    assert rows["bid"]["queue_position"] == 0 and rows["bid"]["time_to_fill_500"] == 499 and rows["bid"]["fill_prob_100"] == 0


def test_lent_rows_reach_one_day_and_not_across_segments(spark):
    def tick(day, i, segment):
        return ("s", f"2024-01-{day:02d}", day * 1_000_000 + i, day * 100 + i, segment, 100.0 + day, 101.0 + day)

    rows = [tick(1, i, 0) for i in range(3)] + [tick(2, i, 0) for i in range(2)] + [tick(4, i, 1) for i in range(2)]
    df = spark.createDataFrame(rows, "symbol string, trading_day string, datetime_ns long, row_hash long, segment_id long, bid_price1 double, ask_price1 double")
    out = {r["row_hash"]: r["label_2"] for r in features.compute_labels(df, (2,)).collect()}
    assert out == {100: 1, 101: 2, 102: 2, 200: None, 201: None, 400: None, 401: None}


def test_stream_factors_over_several_batches_equal_batch_factors(spark, sf, tmp_path):
    from tickweave.plans.queries import ticks_from_events_stream
    from tickweave.streaming import online

    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(4):
        events.filter(F.col("event_id") * 4 >= i * events.count()).filter(F.col("event_id") * 4 < (i + 1) * events.count()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = online.run_to_end(online.stream_factors(ticks_from_events_stream(stream)), str(tmp_path / "run"))
    want = features.compute_factors(T.ticks_from_events(spark, sf), online.FEATURES, ("row_hash",))
    rounded = lambda df: sorted(((r["row_hash"], *[None if r[c] is None else round(r[c], 9) for c in online.FEATURES]) for r in df.collect()))
    assert rounded(got) == rounded(want)
