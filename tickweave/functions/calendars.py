"""Trading calendar, sessions, exchange events and the tick's trading day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import MARKET_ZONE, any_date, clock_seconds, whole


def holidays_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Holiday dates from a list, an object with holidays, holiday or data, or lists by year."""
    t = F.col(column)
    lists = F.concat(
        F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>")),
        *[F.coalesce(F.from_json(F.get_json_object(t, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("holidays", "holiday", "data")],
        F.coalesce(F.flatten(F.map_values(F.map_filter(F.from_json(t, "map<string,array<string>>"), lambda k, v: k.rlike(r"^\d{4}$") & v.isNotNull()))), F.array().cast("array<string>")),
    )
    return texts.select(F.explode(lists).alias("d")).select(any_date(F.col("d")).cast("date").alias("day")).filter("day is not null").distinct()


def sessions_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """session, start, stop (seconds, hours may pass 24), crosses of day and night windows."""
    windows = F.from_json(column, "map<string,array<array<string>>>")
    rows = texts.select(F.explode(windows).alias("session", "list")).select("session", F.explode("list").alias("w"))
    rows = rows.select("session", clock_seconds(F.get("w", F.lit(0))).alias("start"), clock_seconds(F.get("w", F.lit(1))).alias("stop"))
    return rows.filter("session in ('day', 'night') and start is not null and stop is not null").withColumn("crosses", (F.col("stop") >= 86400) | (F.col("stop") <= F.col("start")))


def exchange_events(raw: DataFrame, defaults: DataFrame, exchange: str, variety: str | None = None) -> DataFrame:
    """Events of an exchange (and of a variety or of all): names normalised, inverted ranges swapped."""
    rows = raw.unionByName(defaults, allowMissingColumns=True)
    rows = rows.select(F.upper("exchange").alias("exchange"), F.lower("variety").alias("variety"), F.lower("session").alias("session"), F.lower("action").alias("action"), F.least("start_day", "end_day").alias("start_day"), F.greatest("start_day", "end_day").alias("end_day"), "start_time", "end_time")
    keep = F.col("exchange") == exchange.upper()
    return rows.filter(keep if variety is None else keep & (F.col("variety").isNull() | (F.col("variety") == variety.lower())))


def trading_days(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays of a range without holidays."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day").filter(F.weekday("day") < 5)
    return days if holidays is None else days.join(F.broadcast(holidays), "day", "left_anti")


def neighbours(days: DataFrame) -> DataFrame:
    """day with the previous and next trading day.  A calendar is a small dimension; one window over it is."""
    by = Window.orderBy("day")
    return days.select("day", F.lag("day").over(by).alias("previous"), F.lead("day").over(by).alias("next"))


def next_day_map(days: DataFrame) -> DataFrame:
    """Every calendar date of the range with is_trading, the last trading day <= it and the first one after it (within 14 days)."""
    bounds = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    joined = every.join(days.select(F.col("day").alias("date"), F.col("day")), "date", "left")
    up, down = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("date").rowsBetween(1, 14)
    return joined.select("date", F.col("day").isNotNull().alias("is_trading"), F.last("day", True).over(up).alias("last_leq"), F.min("day").over(down).alias("following"))


def trading_day(df: DataFrame, ns: Column, calendar: DataFrame | None) -> DataFrame:
    """Column trading_day: from 18:00 local the following trading day, before 06:00 on a non-trading date too; without a calendar + 1 day."""
    local = F.from_utc_timestamp(F.timestamp_micros(whole(ns, 1000)), MARKET_ZONE)
    rows = df.withColumn("_date", F.to_date(local)).withColumn("_hour", F.hour(local))
    if calendar is None:
        return rows.withColumn("trading_day", F.when(F.col("_hour") >= 18, F.date_add("_date", 1)).otherwise(F.col("_date"))).drop("_date", "_hour")
    rows = rows.join(F.broadcast(calendar.select(F.col("date").alias("_date"), F.col("is_trading").alias("_open"), F.col("following").alias("_next"))), "_date", "left")
    shift = (F.col("_hour") >= 18) | ((F.col("_hour") < 6) & ~F.coalesce("_open", F.lit(False)))
    return rows.withColumn("trading_day", F.when(shift, F.coalesce("_next", F.date_add("_date", 1))).otherwise(F.col("_date"))).drop("_date", "_hour", "_open", "_next")


def session_intervals(days: DataFrame, sessions: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """day, session, seq, start_s, end_s in UTC epoch seconds.

    days has day and previous.  Night windows start on the previous trading
    day; they are dropped when a holiday lies between the two.
    """
    night = F.col("session") == "night"
    both = days.withColumn("_k", F.lit(1)).join(F.broadcast(sessions.withColumn("_k", F.lit(1))), "_k").drop("_k")
    if holidays is not None:
        # the days between two trading days are a few, so that holidays meet them by equality
        between = days.filter(F.datediff("day", "previous") > 1).select("day", F.explode(F.sequence(F.date_add("previous", 1), F.date_sub("day", 1))).alias("holiday"))
        broken = between.join(holidays.select(F.col("day").alias("holiday")), "holiday", "left_semi").select("day", F.lit("night").alias("session")).distinct()
        both = both.join(broken, ["day", "session"], "left_anti")
    base = F.unix_timestamp(F.to_utc_timestamp(F.when(night, F.col("previous")).otherwise(F.col("day")).cast("timestamp"), MARKET_ZONE))
    stop = F.when(F.col("stop") <= F.col("start"), F.col("stop") + 86400).otherwise(F.col("stop"))
    out = both.filter(~night | F.col("previous").isNotNull()).select("day", "session", (base + F.col("start")).alias("start_s"), (base + stop).alias("end_s"))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("day", "session").orderBy("start_s", "end_s")))


def apply_events(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Skips first; then shift_start on a session's first and shift_end on its last interval, unless that would invert it."""
    active = events.withColumn("day", F.explode(F.sequence("start_day", "end_day")))
    skipped = active.filter("action = 'skip'").select("day", "session").distinct()
    left = intervals.join(skipped, ["day", "session"], "left_anti")
    local = F.unix_timestamp(F.to_utc_timestamp(F.col("day").cast("timestamp"), MARKET_ZONE))
    shifts = active.filter("action in ('shift_start', 'shift_end')").groupBy("day", "session").agg(
        F.max(F.when(F.col("action") == "shift_start", clock_seconds(F.col("start_time")))).alias("new_start"), F.max(F.when(F.col("action") == "shift_end", clock_seconds(F.col("end_time")))).alias("new_end")
    )
    by = Window.partitionBy("day", "session")
    rows = left.withColumn("_last", F.max("seq").over(by)).join(shifts, ["day", "session"], "left")
    # clock times count from the local midnight before the interval
    midnight = local + F.floor((F.col("start_s") - local) / 86400) * 86400
    start = F.when((F.col("seq") == 1) & (midnight + F.col("new_start") < F.col("end_s")), midnight + F.col("new_start")).otherwise(F.col("start_s"))
    end = F.when((F.col("seq") == F.col("_last")) & (midnight + F.col("new_end") > start), midnight + F.col("new_end")).otherwise(F.col("end_s"))
    return rows.select("day", "session", "seq", start.cast("long").alias("start_s"), end.cast("long").alias("end_s"))


def events_for_day(events: DataFrame, day: str) -> DataFrame:
    return events.filter(F.lit(day).cast("date").between(F.col("start_day"), F.col("end_day")))


def window_counts(ticks: DataFrame, intervals: DataFrame) -> DataFrame:
    """trading_day, kept, dropped: ticks inside and outside the windows of their day, in one pass; a day's windows are a handful."""
    windows = intervals.groupBy("day").agg(F.collect_list(F.struct("start_s", "end_s")).alias("_windows"))
    second = whole(F.col("datetime_ns"), 1_000_000_000)
    inside = F.coalesce(F.exists("_windows", lambda w: second.between(w["start_s"], w["end_s"])), F.lit(False))
    joined = ticks.select("trading_day", "datetime_ns").join(windows, F.col("trading_day") == F.col("day"), "left")
    return joined.groupBy("trading_day").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))
