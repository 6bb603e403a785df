"""Outliers, runs, tick intervals, expected counts, correlation and execution cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions.scalars import whole
from tickweave.operators import days

DAY_NS = 86_400_000_000_000


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol", "trading_day").orderBy("datetime_ns", "row_hash")


def tick_intervals(ticks: DataFrame, suspicious_s: float = 30, critical_s: float = 300) -> DataFrame:
    """Seconds between ticks of a day: count, median, p95, p99, largest, and how many are suspicious or critical."""
    rows = ticks.select("symbol", "trading_day", ((F.col("datetime_ns") - F.lag("datetime_ns").over(by_day())) / 1e9).alias("s"))
    return rows.groupBy("symbol", "trading_day").agg(F.count("s").alias("n"), F.round(F.percentile("s", F.lit(0.5)), 4).alias("median_s"), F.round(F.percentile("s", F.lit(0.95)), 4).alias("p95_s"), F.round(F.percentile("s", F.lit(0.99)), 4).alias("p99_s"), F.round(F.max("s"), 4).alias("max_s"), F.count_if(F.col("s") > suspicious_s).alias("suspicious"), F.count_if(F.col("s") > critical_s).alias("critical"))


def runs(ticks: DataFrame, condition: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive ticks of a symbol that meet the condition, also across days."""
    return days.runs(ticks, condition, least, ["symbol"], "trading_day")


def outliers(ticks: DataFrame) -> DataFrame:
    """Per (symbol, day): price jumps over 5 deviations of the last 20, volumes over 10 times the median of the last 20, spreads over 3 times the day's p95."""
    frame = by_day().rowsBetween(-20, -1)
    jump = F.col("last_price") - F.lag("last_price").over(by_day())
    rows = ticks.withColumn("_jump", jump).withColumn("_v", F.col("volume") - F.lag("volume").over(by_day())).withColumn("_s", F.col("ask_price1") - F.col("bid_price1"))
    rows = rows.withColumn("_sd", F.stddev_samp("_jump").over(frame)).withColumn("_med", F.percentile("_v", F.lit(0.5)).over(frame))
    wide = rows.groupBy("symbol", "trading_day").agg(F.percentile("_s", F.lit(0.95)).alias("_p95"))
    joined = rows.join(wide, ["symbol", "trading_day"])
    return joined.groupBy("symbol", "trading_day").agg(F.count_if((F.col("_sd") > 0) & (F.abs("_jump") > 5 * F.col("_sd"))).alias("price_jumps"), F.count_if((F.col("_med") > 0) & (F.col("_v") > 10 * F.col("_med"))).alias("volume_spikes"), F.count_if((F.col("_p95") > 0) & (F.col("_s") > 3 * F.col("_p95"))).alias("wide_spreads"))


def expected_ticks(rollup: DataFrame, days: int) -> DataFrame:
    """p10, p50 and p90 of the row counts of the days before."""
    before = Window.partitionBy("symbol").orderBy("trading_day").rowsBetween(-days, -1)
    return rollup.select("symbol", "trading_day", "n_rows", *[F.percentile("n_rows", F.lit(q)).over(before).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


def bucket_correlation(ticks: DataFrame, bucket_ns: int) -> DataFrame:
    """Correlation of mean prices of symbol pairs over common time buckets."""
    means = ticks.groupBy("symbol", whole(F.col("datetime_ns"), bucket_ns).alias("h")).agg(F.avg("last_price").alias("p"))
    x, y = means.select(F.col("symbol").alias("a"), "h", F.col("p").alias("x")), means.select(F.col("symbol").alias("b"), "h", F.col("p").alias("y"))
    return x.join(y, "h").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("corr"))


def lead_lag(ticks: DataFrame, wanted: DataFrame, bucket_ns: int) -> DataFrame:
    """Correlation of a's mean price with b's ``lag`` buckets later, for the wanted (a, b, lag)."""
    means = ticks.groupBy("symbol", whole(F.col("datetime_ns"), bucket_ns).alias("h")).agg(F.avg("last_price").alias("p"))
    x = wanted.join(means.select(F.col("symbol").alias("a"), "h", F.col("p").alias("x")), "a").withColumn("h", F.col("h") + F.col("lag"))
    y = means.select(F.col("symbol").alias("b"), "h", F.col("p").alias("y"))
    return x.join(y, ["b", "h"]).groupBy("a", "b", "lag").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("corr"))


def _by_time(rows: DataFrame, at: str = "datetime_ns") -> DataFrame:
    return rows.withColumn("_day", whole(F.col(at), DAY_NS))


def slippage(fills: DataFrame, ticks: DataFrame, by_place: bool = False) -> DataFrame:
    """Fill price against the last price at arrival: backward as-of join by days.

    Where fills have the time and row_hash of the tick they follow, by_place
    finds that tick also among others of its time.
    """
    rows = _by_time(ticks.select("symbol", "datetime_ns", "row_hash", F.col("last_price").alias("arrival")))
    out = days.as_of(_by_time(fills.select("symbol", "datetime_ns", "row_hash", "price")), rows, ["arrival"], ["symbol"], "_day", by_place=by_place)
    return out.select("symbol", "row_hash", "price", "arrival", (F.col("price") - F.col("arrival")).alias("slippage"))


def execution_cost(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Cost of orders (symbol, order_id, side 1 or -1, arrival_ns, fill_ns, price) and what it comes from.

    arrival is the last price at arrival_ns, vwap the mean price between
    arrival and fill weighted by traded volume (null without any).  slippage =
    timing (arrival to vwap) + execution (vwap to price), each with the side's
    sign; without a vwap only slippage is known, without an arrival nothing.
    Running sums are taken within days and carried by the table of days.
    """
    by = by_day()
    rows = ticks.withColumn("_dv", F.greatest(F.col("volume") - F.lag("volume").over(by), F.lit(0.0))).withColumn("_pv", F.coalesce(F.col("last_price") * F.col("_dv"), F.lit(0.0)))
    sums = [("_v", "_dv"), ("_w", "_pv")]
    total = rows.groupBy("symbol", "trading_day").agg(*[F.sum(c).alias(f"_day{n}") for n, c in sums])
    over = Window.partitionBy("symbol").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("symbol", "trading_day", *[F.coalesce(F.sum(f"_day{n}").over(over), F.lit(0.0)).alias(f"_to{n}") for n, _ in sums])
    rows = rows.join(total, ["symbol", "trading_day"]).select("symbol", "datetime_ns", "row_hash", "last_price", *[(F.col(f"_to{n}") + F.sum(c).over(by)).alias(n) for n, c in sums])
    both = orders.withColumn("row_hash", F.col("order_id").cast("long")).select("*", F.inline(F.array(F.struct(F.lit(0).alias("_end"), F.col("arrival_ns").alias("datetime_ns")), F.struct(F.lit(1).alias("_end"), F.col("fill_ns").alias("datetime_ns")))))
    met = days.as_of(_by_time(both), _by_time(rows), ["last_price", "_v", "_w"], ["symbol"], "_day")
    at = lambda c, end: F.max(F.when(F.col("_end") == end, F.col(c)))
    out = met.groupBy("symbol", "order_id", "side", "price").agg(at("last_price", 0).alias("arrival"), (at("_v", 1) - F.coalesce(at("_v", 0), F.lit(0.0))).alias("_dv"), (at("_w", 1) - F.coalesce(at("_w", 0), F.lit(0.0))).alias("_dw"))
    out = out.withColumn("vwap", F.when(F.col("_dv") > 0, F.col("_dw") / F.col("_dv")))
    signed = lambda x, y: F.col("side") * (F.col(x) - F.col(y))
    return out.select("symbol", "order_id", "price", "arrival", "vwap", signed("price", "arrival").alias("slippage"), signed("vwap", "arrival").alias("timing"), signed("price", "vwap").alias("execution"))


def vwap(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean price weighted by the change of the running volume."""
    dv = F.greatest(F.col("volume") - F.lag("volume").over(by_day()), F.lit(0.0))
    rows = ticks.withColumn("_dv", dv)
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("last_price") * F.col("_dv")), F.sum("_dv")).alias("vwap"))
