"""Microstructure factors, event-time labels and fill labels.

Windows are keyed by symbol, segment and trading day, so nothing crosses a roll
and a segment's days are worked on apart.  An offset may reach into one
neighbouring available day: its last or first rows are lent to the day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions.scalars import short_id
from tickweave.sources.ticks import LEVELS


def series() -> WindowSpec:
    return Window.partitionBy("symbol", "segment_id", "trading_day").orderBy("datetime_ns", "row_hash")


@dataclass(frozen=True)
class Factor:
    name: str
    inputs: tuple[str, ...]
    lookback: int
    build: Callable[[], Column]
    ttl_s: int = 60


FACTORS: dict[str, Factor] = {}


def register_factor(name: str, inputs: tuple[str, ...], lookback: int = 0, ttl_s: int = 60) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Decorator: a function that returns the factor's Column over ticks."""

    def added(build: Callable[[], Column]) -> Callable[[], Column]:
        FACTORS[name] = Factor(name, inputs, lookback, build, ttl_s)
        return build

    return added


def _sum(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def before(column: Column, n: int) -> Column:
    """Value n rows back in the segment, null beyond the previous available day; for rows of with_neighbours."""
    return F.lag(column, n).over(series())


def after(column: Column, n: int) -> Column:
    return F.lead(column, n).over(series())


def mid() -> Column:
    return (F.col("bid_price1") + F.col("ask_price1")) / 2


@register_factor("spread", ("bid_price1", "ask_price1"))
def _spread() -> Column:
    return F.col("ask_price1") - F.col("bid_price1")


@register_factor("mid", ("bid_price1", "ask_price1"))
def _mid() -> Column:
    return mid()


@register_factor("microprice", ("bid_price1", "ask_price1", "bid_volume1", "ask_volume1"))
def _microprice() -> Column:
    b, a = F.col("bid_volume1"), F.col("ask_volume1")
    return F.when(b + a > 0, F.try_divide(F.col("ask_price1") * b + F.col("bid_price1") * a, b + a)).otherwise(mid())


@register_factor("imbalance_1", ("bid_volume1", "ask_volume1"))
def _imbalance_1() -> Column:
    b, a = F.col("bid_volume1"), F.col("ask_volume1")
    return F.when(b + a > 0, F.try_divide(b - a, b + a)).otherwise(0.0)


@register_factor("imbalance_total", tuple(f"{s}_volume{i}" for s in ("bid", "ask") for i in LEVELS))
def _imbalance_total() -> Column:
    b, a = (_sum([F.col(f"{s}_volume{i}") for i in LEVELS]) for s in ("bid", "ask"))
    return F.when(b + a > 0, F.try_divide(b - a, b + a)).otherwise(0.0)


@register_factor("depth_weighted_price", tuple(f"{s}_{w}{i}" for s in ("bid", "ask") for w in ("price", "volume") for i in LEVELS))
def _depth_weighted_price() -> Column:
    total = _sum([F.col(f"{s}_volume{i}") for s in ("bid", "ask") for i in LEVELS])
    value = _sum([F.col(f"{s}_price{i}") * F.col(f"{s}_volume{i}") for s in ("bid", "ask") for i in LEVELS])
    return F.when(total > 0, F.try_divide(value, total))


@register_factor("return_10", ("bid_price1", "ask_price1"), 10)
def _return_10() -> Column:
    return F.try_divide(F.col("_mid"), before(F.col("_mid"), 10)) - 1


@register_factor("volatility_20", ("bid_price1", "ask_price1"), 20)
def _volatility_20() -> Column:
    frame = series().rowsBetween(-19, 0)
    near = F.lag(F.lit(1), 20).over(series()).isNotNull()
    return F.when(near & (F.count("_ret").over(frame) == 20), F.stddev_samp("_ret").over(frame))


@register_factor("volume_delta_10", ("volume",), 10)
def _volume_delta_10() -> Column:
    return F.col("volume") - before(F.col("volume"), 10)


@register_factor("oi_delta_10", ("open_interest",), 10)
def _oi_delta_10() -> Column:
    return F.col("open_interest") - before(F.col("open_interest"), 10)


@register_factor("book_slope", tuple(f"{s}_volume{i}" for s in ("bid", "ask") for i in LEVELS))
def _book_slope() -> Column:
    b, a = (_sum([F.coalesce(F.col(f"{s}_volume{i}"), F.lit(0.0)) * i for i in LEVELS]) for s in ("bid", "ask"))
    return F.when(b + a > 0, F.try_divide(b - a, b + a)).otherwise(0.0)


def with_neighbours(ticks: DataFrame, back: int, ahead: int, days: DataFrame | None = None) -> DataFrame:
    """Ticks, and to each (symbol, segment, day) the last ``back`` and first ``ahead`` rows of the symbol's neighbouring available days of the segment.

    Column own is false for lent rows.  days: symbol, trading_day of the
    available days (the rollup has them); without it they are gathered from
    the ticks.  Lending moves at most back + ahead rows for each day.
    """
    days = (ticks if days is None else days).select("symbol", "trading_day").distinct()
    by = Window.partitionBy("symbol").orderBy("trading_day")
    near = days.select("symbol", "trading_day", F.lead("trading_day").over(by).alias("_next"), F.lag("trading_day").over(by).alias("_previous"))
    rows = ticks.withColumn("own", F.lit(True))
    for n, order, target in ((back, [F.desc("datetime_ns"), F.desc("row_hash")], "_next"), (ahead, ["datetime_ns", "row_hash"], "_previous")):
        if n:
            nth = F.row_number().over(Window.partitionBy("symbol", "segment_id", "trading_day").orderBy(*order))
            lent = ticks.withColumn("_n", nth).filter(F.col("_n") <= n).join(near.select("symbol", "trading_day", target), ["symbol", "trading_day"]).filter(F.col(target).isNotNull())
            rows = rows.unionByName(lent.withColumn("trading_day", F.col(target)).select(*ticks.columns, F.lit(False).alias("own")))
    return rows


def compute_factors(ticks: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ("symbol", "trading_day", "datetime_ns", "row_hash", "segment_id"), days: DataFrame | None = None) -> DataFrame:
    """All factors in one pass; one shuffle on (symbol, segment, day)."""
    names = names or list(FACTORS)
    inputs = dict.fromkeys([*keep, "symbol", "segment_id", "trading_day", "datetime_ns", "row_hash", "bid_price1", "ask_price1", *[c for n in names for c in FACTORS[n].inputs]])
    rows = with_neighbours(ticks.select(*inputs), max(FACTORS[n].lookback for n in names), 0, days).withColumn("_mid", mid())
    if "volatility_20" in names:
        rows = rows.withColumn("_ret", F.try_divide("_mid", F.lag("_mid").over(series())) - 1)
    return rows.select("own", *keep, *[FACTORS[n].build().alias(n) for n in names]).filter("own").drop("own")


def generated(ticks: DataFrame, names: list[str], lags: tuple[int, ...] = (1, 5), windows: tuple[int, ...] = ()) -> DataFrame:
    """Candidate features from factors: lagged values, differences, products and ratios of pairs, and mean and deviation of full windows.

    A window reaches at most one available day back, as offsets do.
    """
    keys = ["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id"]
    rows = with_neighbours(ticks.select(*dict.fromkeys([*keys, "bid_price1", "ask_price1", *[c for n in names for c in FACTORS[n].inputs]])), max(*lags, *windows, 1), 0).withColumn("_mid", mid())
    rows = rows.select("own", *keys, *[FACTORS[n].build().alias(n) for n in names])
    out = [x for n in names for k in lags for x in (before(F.col(n), k).alias(f"{n}_lag_{k}"), (F.col(n) - before(F.col(n), k)).alias(f"{n}_diff_{k}"))]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out += [x for a, b in pairs for x in ((F.col(a) * F.col(b)).alias(f"{a}_x_{b}"), F.try_divide(a, b).alias(f"{a}_per_{b}"))]
    for n in names:
        for k in windows:
            frame = series().rowsBetween(-(k - 1), 0)
            whole = F.count(n).over(frame) == k
            out += [F.when(whole, F.avg(n).over(frame)).alias(f"{n}_mean_{k}"), F.when(whole, F.stddev_samp(n).over(frame)).alias(f"{n}_std_{k}")]
    return rows.select("own", *keys, *out).filter("own").drop("own")


def factor_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, list(f.inputs), f.lookback, f.ttl_s, "double") for f in FACTORS.values()], "name string, inputs array<string>, lookback int, ttl_s int, dtype string")


def label(horizon: int, threshold: float, column: str = "_mid") -> Column:
    """2 up, 0 down, 1 flat by the mid ``horizon`` ticks ahead; null without such a row, flat where a mid is missing."""
    delta = after(F.col(column), horizon) - F.col(column)
    cls = F.when(delta >= threshold, 2).when(delta <= -threshold, 0).otherwise(1)
    return F.when(after(F.lit(1), horizon).isNotNull(), cls)


def compute_labels(ticks: DataFrame, horizons: tuple[int, ...] = (10, 50), k: float = 1, tick: float = 1.0) -> DataFrame:
    keys = ["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id"]
    rows = with_neighbours(ticks.select(*keys, "bid_price1", "ask_price1"), 0, max(horizons)).withColumn("_mid", mid())
    return rows.select("own", *keys, *[label(h, k * tick).alias(f"label_{h}") for h in horizons]).filter("own").drop("own")


def factors_and_labels(ticks: DataFrame, names: list[str], horizons: tuple[int, ...], k: float = 1, tick: float = 1.0) -> DataFrame:
    """Rows of compute_factors with the columns of compute_labels, in one pass without a join of the two."""
    keys = ["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id"]
    inputs = dict.fromkeys([*keys, "bid_price1", "ask_price1", *[c for n in names for c in FACTORS[n].inputs]])
    rows = with_neighbours(ticks.select(*inputs), max(FACTORS[n].lookback for n in names), max(horizons)).withColumn("_mid", mid())
    if "volatility_20" in names:
        rows = rows.withColumn("_ret", F.try_divide("_mid", F.lag("_mid").over(series())) - 1)
    return rows.select("own", *keys, *[FACTORS[n].build().alias(n) for n in names], *[label(h, k * tick).alias(f"label_{h}") for h in horizons]).filter("own").drop("own")


def first_fills(price: np.ndarray, quotes: np.ndarray, most: int, buying: bool) -> np.ndarray:
    """For an order at each position the number of rows until a quote is at or beyond its price, at most ``most``; 0 if none is."""
    out = np.zeros(len(price), np.int64)
    open_ = np.arange(len(price))
    for k in range(1, most + 1):
        open_ = open_[open_ + k < len(price)]
        if not len(open_):
            break
        hit = quotes[open_ + k] <= price[open_] if buying else quotes[open_ + k] >= price[open_]
        out[open_[hit]] = k
        open_ = open_[~hit]
    return out


def fill_labels(ticks: DataFrame, horizons: tuple[int, ...] = (10, 50, 100, 500), levels: tuple[int, ...] = (0, 1), tick: float = 1.0) -> DataFrame:
    """A row for each tick, side and level: order price, queue, time_to_fill_h and fill_prob_h.

    A bid order fills at the first of the next h ticks of the day whose ask is
    at or under its price, an ask order where the bid is at or over it; a
    missing quote counts as 0, a missing or negative volume too.  A symbol's
    day is one group; only offsets leave the search.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    volume = lambda c: F.greatest(zero(c), F.lit(0.0))
    keys = ["symbol", "trading_day", "datetime_ns", "row_hash"]
    rows = ticks.select(*keys, zero("bid_price1").alias("b"), zero("ask_price1").alias("a"), volume("bid_volume1").alias("bv"), volume("ask_volume1").alias("av"))
    orders = [(side, lv) for side in ("bid", "ask") for lv in levels]

    def searched(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["datetime_ns", "row_hash"], ignore_index=True)
        bid, ask = day["b"].to_numpy(), day["a"].to_numpy()
        for side, lv in orders:
            own, other, sign = (bid, ask, -1) if side == "bid" else (ask, bid, 1)
            day[f"{side}_{lv}"] = first_fills(own + sign * lv * tick, other, max(horizons), side == "bid")
        return day

    found = rows.groupBy("symbol", "trading_day").applyInPandas(searched, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {s}_{lv} long" for s, lv in orders))
    each = [
        F.struct(F.lit(s).alias("side"), F.lit(lv).alias("price_level"), (F.col("b" if s == "bid" else "a") + (-lv if s == "bid" else lv) * tick).alias("order_price"), (F.col("bv" if s == "bid" else "av") * (1 + lv)).alias("queue_position"), F.col(f"{s}_{lv}").alias("first"))
        for s, lv in orders
    ]
    out = found.select(*keys, F.inline(F.array(*each)))
    within = lambda h: (F.col("first") > 0) & (F.col("first") <= h)
    return out.select(*keys, "side", "price_level", "order_price", "queue_position", *[x for h in horizons for x in (F.when(within(h), F.col("first")).alias(f"time_to_fill_{h}"), within(h).cast("int").alias(f"fill_prob_{h}"))])


def build_record(kind: str, symbol: str, parameters: str, rows: DataFrame, created_at: str) -> DataFrame:
    """One row about a build: id, parameters, row count, day range."""
    return rows.agg(F.count("*").alias("n_rows"), F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day")).select(
        short_id(F.lit(kind), F.lit(symbol), F.lit(parameters)).alias("build_id"), F.lit(kind).alias("kind"), F.lit(symbol).alias("symbol"), F.lit(created_at).alias("created_at"), "n_rows", "first_day", "last_day"
    )


def build_records(kind: str, parameters: str, rows: DataFrame, created_at: str) -> DataFrame:
    """The same of every symbol of rows."""
    return rows.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day")).select(
        short_id(F.lit(kind), F.col("symbol"), F.lit(parameters)).alias("build_id"), F.lit(kind).alias("kind"), "symbol", F.lit(created_at).alias("created_at"), "n_rows", "first_day", "last_day"
    )


def read_latest_build(rows: DataFrame, builds: DataFrame, preferred: str) -> DataFrame:
    """Rows of each symbol's newest build, of the preferred kind if there is one."""
    chosen = builds.groupBy("symbol").agg(F.max_by("build_id", F.struct((F.col("kind") == preferred).alias("p"), "created_at")).alias("build_id"))
    return rows.join(chosen, ["symbol", "build_id"], "left_semi")


def register_definitions(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows to append: a new version where no active row of the name has the hash."""
    active = registry.filter("deprecated_at is null").select("name", "hash")
    versions = registry.groupBy("name").agg(F.max("version").alias("_v"))
    fresh = new.join(active, ["name", "hash"], "left_anti").join(versions, "name", "left")
    return fresh.select("name", "hash", (F.coalesce("_v", F.lit(0)) + 1).alias("version"))
