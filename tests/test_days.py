"""Operators stitched over days against plain passes over whole series, and the sweep of gaps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickweave.operators import days, extras, validation

SCHEMA = "symbol string, trading_day date, datetime_ns long, row_hash long, value long, price double"
DAY0, DAY_NS = dt.date(2024, 1, 1), 86_400_000_000_000


def _series(seed, n=400):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([1, 1, 1, 50, DAY_NS // 3, 2 * DAY_NS])
        rows.append((rng.choice(["a", "b", "c"]), DAY0 + dt.timedelta(days=at // DAY_NS), at, i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, float(i)])))
    return rows


def _by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_and_runs(spark, seed):
    rows = _series(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want, want_null, runs = set(), set(), []
    for symbol, own in _by_symbol(rows).items():
        for k, r in enumerate(own):
            if k == 0 or r[4] != own[k - 1][4]:
                want.add(r[3])
                if k or r[4] is not None:
                    want_null.add(r[3])
        start = None
        for k, r in enumerate([*own, (symbol, None, None, None, 0, None)]):
            if r[4] == 1:
                start = k if start is None else start
            elif start is not None:
                runs.append((symbol, k - start, own[start][2], own[k - 1][2]))
                start = None
    assert {r["row_hash"] for r in days.changes(df, ["symbol"], "trading_day", "value").collect()} == want
    assert {r["row_hash"] for r in days.changes(df, ["symbol"], "trading_day", "value", first_null=False).collect()} == want_null
    assert sorted(tuple(r) for r in extras.runs(df, F.col("value") == 1, 2).collect()) == sorted(r for r in runs if r[1] >= 2)
    assert extras.runs(df.limit(0), F.col("value") == 1, 2).isEmpty() and days.changes(df.limit(0), ["symbol"], "trading_day", "value").isEmpty()


@pytest.mark.parametrize("n", [1, 7, 60])
def test_preceding_rows_come_from_any_day(spark, n):
    rows = _series(4, 200)
    got = days.with_preceding(spark.createDataFrame(rows, SCHEMA), n, ["symbol"], "trading_day").collect()
    assert sorted(r["row_hash"] for r in got if r["own"]) == list(range(200))
    want = set()
    for own in _by_symbol(rows).values():
        for k, r in enumerate(own):
            if k and own[k - 1][1] != r[1]:
                want |= {(r[1], x[3]) for x in own[max(0, k - n) : k]}
    assert sorted((r["trading_day"], r["row_hash"]) for r in got if not r["own"]) == sorted(want)


def test_as_of_takes_the_last_value_of_any_earlier_day(spark):
    rows = _series(5)
    asked = [(r[0], r[2] + d, 1000 + r[3], 1.0) for r in rows[::3] for d in (-1, 0, 5)] + [("none", 5, 1, 1.0)]
    fills = spark.createDataFrame(asked, "symbol string, datetime_ns long, row_hash long, price double")
    ticks = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("price", "last_price")
    got = sorted(((r["symbol"], r["row_hash"], r["arrival"]) for r in extras.slippage(fills, ticks).collect()), key=str)
    series = _by_symbol(rows)
    last = lambda s, at: next((r[5] for r in reversed(series.get(s, [])) if r[2] <= at and r[5] is not None), None)
    assert got == sorted(((s, h, last(s, at)) for s, at, h, _ in asked), key=str)


def test_execution_cost_parts_add_up(spark):
    rows = [("a", DAY0, i * 10, i, 0, 100.0 + i) for i in range(10)]
    ticks = spark.createDataFrame(rows, SCHEMA).select("symbol", "trading_day", "datetime_ns", "row_hash", F.col("price").alias("last_price"), (F.col("row_hash") * 5.0).alias("volume"))
    orders = spark.createDataFrame([("a", 1, 1, 15, 45, 103.5), ("a", 2, -1, 15, 45, 103.5), ("a", 3, 1, 41, 45, 104.0), ("a", 4, 1, -5, -1, 1.0), ("b", 5, 1, 1, 2, 1.0)], "symbol string, order_id long, side int, arrival_ns long, fill_ns long, price double")
    got = {r["order_id"]: r for r in extras.execution_cost(orders, ticks).collect()}
    assert (got[1]["arrival"], got[1]["vwap"], got[1]["slippage"], got[1]["timing"], got[1]["execution"]) == (101.0, 103.0, 2.5, 2.0, 0.5)
    assert (got[2]["slippage"], got[2]["timing"], got[2]["execution"]) == (-2.5, -2.0, -0.5)
    assert got[3]["vwap"] is None and got[3]["slippage"] == 0.0 and got[3]["timing"] is None
    assert got[4]["arrival"] is None and got[4]["slippage"] is None and got[5]["vwap"] is None


def test_sweep_finds_provider_ticks_in_gaps(spark):
    rng = random.Random(6)
    gaps, ticks = [], []
    for symbol in "ab":
        for seq in range(40):
            start = rng.randrange(1000)
            gaps.append((symbol, DAY0, "day", seq, start, start + rng.randrange(30), 1))
        ticks += [(symbol, DAY0, s * 1_000_000_000, i, *[1.0] * 20) for i, s in enumerate([*rng.sample(range(1100), 40), 5, 5])]
    book = [f"{s}_{k}{lv}" for lv in range(1, 6) for s in ("bid", "ask") for k in ("price", "volume")]
    provider = spark.createDataFrame(ticks, f"symbol string, trading_day date, datetime_ns long, row_hash long, {', '.join(b + ' double' for b in book)}")
    frame = spark.createDataFrame(gaps + [("c", DAY0, "day", 0, 5, 9, 1)], "symbol string, trading_day date, session string, seq long, gap_start long, gap_end long, duration_s int")
    got = {(r["symbol"], r["seq"]): r["provider_has_ticks"] for r in validation.attribute_gaps(frame, provider).collect()}
    seconds = {(t[0], t[2] // 1_000_000_000) for t in ticks}
    assert got == {(s, q): any((s, x) in seconds for x in range(a, b + 1)) for s, _, _, q, a, b, _ in gaps} | {("c", 0): False}
    assert {True, False} == set(got.values())


def test_half_second_ratio_counts_fixed_days_alone(spark):
    fields = "symbol string, strict_seconds long, missing_half_seconds long, cadence string, missing_segments long, missing_seconds long, outside_seconds long, gap_gt_30 long, max_gap_s long, end_lag_s long, missing_day boolean"
    day = lambda s, strict, half, cadence: (s, strict, half, cadence, 0, 0, 0, 0, 0, 0, False)
    summary = spark.createDataFrame([day("a", 100, 8, "fixed_0p5s"), day("a", 900, 0, "event"), day("b", 900, 0, "event"), day("c", 900, 3, "event")], fields)
    got = {r["symbol"]: (r["half_ratio"], r["half_state"]) for r in validation.states(validation.run_totals(summary)).collect()}
    assert got == {"a": (0.08, "error"), "b": (0.0, "ok"), "c": (0.0, "error")}
