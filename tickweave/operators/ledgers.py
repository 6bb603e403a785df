"""Reads and upkeep of the validation ledgers, the schedule and the daily rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions.calendars import trading_day
from tickweave.functions.scalars import HASH_TAG, schema_hash, short_id, whole
from tickweave.operators.schedule import daily_aggregate
from tickweave.operators.validation import DAY, issue_days
from tickweave.sources.ticks import delete_where, has_depth, manifest, upsert, with_missing_columns


def _first(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each symbol."""
    by = Window.partitionBy("symbol").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def _clamp(n: int, most: int) -> int:
    return max(1, min(n, most))


def _of_schedule(rows: DataFrame, schedule_hash: str | None) -> DataFrame:
    return rows if schedule_hash is None else rows.filter(F.col("schedule_hash") == schedule_hash)


def latest_days(summary: DataFrame, n: int = 30, schedule_hash: str | None = None) -> DataFrame:
    """The newest n (1..3650) summary rows of each symbol, of one schedule if it is named."""
    return _first(_of_schedule(summary, schedule_hash), [F.desc("trading_day")], _clamp(n, 3650))


def top_gap_days(summary: DataFrame, n: int = 10, schedule_hash: str | None = None) -> DataFrame:
    """The n (1..200) days of each symbol with the longest gaps, of one schedule if it is named."""
    return _first(_of_schedule(summary, schedule_hash).filter("max_gap_s > 0"), [F.desc("max_gap_s"), F.desc("missing_segments"), F.desc("trading_day")], _clamp(n, 200))


def top_lag_days(summary: DataFrame, n: int = 10, schedule_hash: str | None = None) -> DataFrame:
    """The n (1..200) days of each symbol that end longest before their session, of one schedule if it is named."""
    return _first(_of_schedule(summary, schedule_hash).filter("end_lag_s is not null"), [F.desc("end_lag_s"), F.desc("trading_day")], _clamp(n, 200))


def list_gaps(gaps: DataFrame, start: str | None = None, end: str | None = None, least_s: int | None = None, n: int = 500, schedule_hash: str | None = None) -> DataFrame:
    """The newest n (1..10,000) gaps of each symbol in a day range, of a least length, of one schedule if it is named."""
    rows = _of_schedule(gaps, schedule_hash)
    if start is not None:
        rows = rows.filter(F.col("trading_day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("trading_day") <= F.lit(end).cast("date"))
    if least_s is not None:
        rows = rows.filter(F.col("duration_s") >= least_s)
    return _first(rows, [F.desc("gap_start"), F.asc("session")], _clamp(n, 10_000))


def list_tick_gaps(ledger: DataFrame, kind: str = "main_l5", version: str = "v2", n: int = 200) -> DataFrame:
    """The newest n (1..5000) rows of each symbol in the tick-gap ledger, of one kind and dataset version; missing counts are 0."""
    rows = _first(ledger.filter((F.col("ticks_kind") == kind) & (F.col("dataset_version") == version)), [F.desc("trading_day")], _clamp(n, 5000))
    return rows.fillna(0, [c for c in ("expected_min", "expected_max", "max_interval_ms", "abnormal_gaps", "critical_gaps") if c in rows.columns])


def latest_reports(reports: DataFrame, exchange: str | None = None, variety: str | None = None, symbol: str | None = None) -> DataFrame:
    """The newest report of each (exchange, variety, symbol), or of those asked for; names in any case.

    Reports without a text don't count; of equal times the greatest text.
    """
    names = {"exchange": F.upper(F.trim("exchange")), "variety": F.lower(F.trim("variety")), "symbol": F.trim("symbol")}
    rows = reports.filter("report is not null").withColumns(names)
    for column, asked in (("exchange", exchange and exchange.strip().upper()), ("variety", variety and variety.strip().lower()), ("symbol", symbol and symbol.strip())):
        rows = rows if asked is None else rows.filter(F.col(column) == asked)
    newest = rows.groupBy(*names).agg(F.max(F.struct("created_at", "report")).alias("_r"))
    return newest.select(*names, "_r.created_at", "_r.report")


def ingest_manifest(ticks: DataFrame, run_id: str, created_at: str) -> DataFrame:
    """The manifest's row with the fingerprint of the canonical schema and the tag of the row hash."""
    return manifest(ticks, run_id, created_at).withColumns({"schema_hash": F.lit(schema_hash()), "hash_algorithm": F.lit(HASH_TAG)})


def day_rows(raw: DataFrame, windows: DataFrame, calendar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to store, a count row for each symbol and trading day) of fetched ticks.

    Missing tick columns are null.  Depth ticks stay; of days with session
    windows those inside one, ends included, of other days those whose own
    trading day it is.  windows: day, start_s, end_s; a day has a handful.
    The counts end in the reason of a day without rows: no_depth,
    outside_sessions or other_day.
    """
    spans = windows.groupBy("day").agg(F.collect_list(F.struct("start_s", "end_s")).alias("_windows")).withColumnRenamed("day", "trading_day")
    rows = with_missing_columns(raw).withColumn("_asked", F.col("trading_day"))
    rows = trading_day(rows, F.col("datetime_ns"), calendar).withColumn("_own", F.col("trading_day")).withColumn("trading_day", F.col("_asked")).drop("_asked")
    second = whole(F.col("datetime_ns"), 1_000_000_000)
    inside = F.exists("_windows", lambda w: second.between(w["start_s"], w["end_s"]))
    joined = rows.join(spans, "trading_day", "left").withColumn("_has", F.col("_windows").isNotNull()).withColumn("_deep", has_depth())
    joined = joined.withColumn("_kept", F.col("_deep") & F.coalesce(F.when(F.col("_has"), inside).otherwise(F.col("_own") == F.col("trading_day")), F.lit(False)))
    counts = joined.groupBy(*DAY).agg(F.count("*").alias("fetched"), F.count_if("_deep").alias("depth"), F.count_if("_kept").alias("stored"), F.bool_or("_has").alias("_has"))
    reason = F.when(F.col("stored") > 0, None).when(F.col("depth") == 0, "no_depth").when(F.col("_has"), "outside_sessions").otherwise("other_day")
    return joined.filter("_kept").drop("_windows", "_has", "_deep", "_kept", "_own"), counts.withColumn("reason", reason).drop("_has")


def readiness(states: DataFrame) -> DataFrame:
    """States and reason of each symbol with the rates that operations watch."""
    return states.select("symbol", "overall_state", "engineering_state", "source_state", "policy_state", "reason_code", F.coalesce(F.try_divide("missing_days", "days"), F.lit(0.0)).alias("missing_day_rate"), "outside_seconds", "gap_gt_30")


def anomalies(summary: DataFrame, n: int = 50) -> DataFrame:
    """The n (1..200) worst issue days of each symbol, compact."""
    order = [F.desc("gap_gt_30"), F.desc("missing_segments"), F.desc("missing_half_seconds"), F.desc("max_gap_s"), F.desc("outside_seconds"), F.asc("trading_day")]
    return _first(issue_days(summary), order, _clamp(n, 200)).select(*DAY, "rank", "missing_segments", "missing_half_seconds", "outside_seconds", "max_gap_s")


def page_status(totals: DataFrame) -> DataFrame:
    """ok where no day, segment or half second is missing, else warn."""
    clean = (F.col("missing_days") == 0) & (F.col("missing_segments") == 0) & (F.col("missing_half_seconds") == 0)
    return totals.select("symbol", "days", F.when(clean, "ok").otherwise("warn").alias("status"))


def infer_missing_days(missing: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Column inference of days without ticks: the manifest has no rows for it, has some, or doesn't know the day."""
    joined = missing.join(manifest_rows, ["symbol", "day"], "left")
    # The inference names.
    name = F.when(F.col("n_rows") == 0, "provider_empty_day").when(F.col("n_rows").isNotNull(), "unknown_partial").otherwise("unknown")
    return joined.select("symbol", "day", name.alias("inference"))


def aligned_schedule(schedule: DataFrame, ticks: DataFrame, calendar: DataFrame | None = None, requested: str | None = None) -> DataFrame:
    """Schedule days from the trading day of the symbol's first depth tick on, or from a later requested day."""
    first = ticks.filter(has_depth()).groupBy("symbol").agg(F.min("datetime_ns").alias("_ns"))
    first = trading_day(first, F.col("_ns"), calendar).select("symbol", F.col("trading_day").alias("_from"))
    start = F.coalesce("_from", F.lit("0001-01-01").cast("date"))
    if requested is not None:
        start = F.greatest(start, F.lit(requested).cast("date"))
    return schedule.join(first, "symbol", "left").filter(F.col("day") >= start).select(*schedule.columns)


def trim_schedule(schedule: DataFrame, symbols: list[str], before: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schedule without the symbols' days before a day, or without all of them; one-row count of the removed)."""
    hit = F.col("symbol").isin(symbols)
    return delete_where(schedule, hit if before is None else hit & (F.col("day") < F.lit(before).cast("date")))


def skip_ledger(schedule: DataFrame, ticks: DataFrame) -> DataFrame:
    """Scheduled days that gave no series rows and why: their contract has no ticks, or none with depth."""
    per_day = ticks.groupBy(F.col("underlying_contract").alias("contract"), F.col("trading_day").alias("day")).agg(F.count("*").alias("n_ticks"), F.count_if(has_depth()).alias("n_depth"))
    joined = schedule.join(per_day, ["contract", "day"], "left")
    reason = F.when(F.col("n_ticks").isNull(), "no_ticks").when(F.col("n_depth") == 0, "no_depth")
    return joined.select("symbol", "day", "contract", "segment_id", reason.alias("reason")).filter("reason is not null")


def skips_by_reason(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("symbol", "reason").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def refreshed_rollup(rollup: DataFrame, ticks: DataFrame, touched: DataFrame, health: DataFrame) -> DataFrame:
    """The rollup with touched days of healthy symbols computed anew; days of other symbols stay as they are."""
    redo = touched.select(*DAY).distinct().join(health.filter("healthy").select("symbol"), "symbol", "left_semi")
    fresh = daily_aggregate(ticks.join(redo, DAY, "left_semi"))
    return rollup.join(redo, DAY, "left_anti").select(*fresh.columns).unionByName(fresh)


def latest_from_rollup(rollup: DataFrame, ticks: DataFrame) -> DataFrame:
    """Last day and ns of each symbol from the rollup, from raw ticks for symbols that it lacks."""
    known = rollup.groupBy("symbol").agg(F.max("trading_day").alias("last_day"), F.max("last_ns").alias("last_ns"))
    raw = ticks.join(known.select("symbol"), "symbol", "left_anti").groupBy("symbol").agg(F.max("trading_day").alias("last_day"), F.max("datetime_ns").alias("last_ns"))
    return known.unionByName(raw)


def target_day_ticks(ticks: DataFrame, targets: DataFrame, calendar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ticks whose own trading day is wanted, per symbol the number kept and dropped); targets: symbol, trading_day."""
    own = trading_day(ticks.drop("trading_day"), F.col("datetime_ns"), calendar)
    marked = own.join(targets.select(*DAY).distinct().withColumn("_wanted", F.lit(True)), DAY, "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(False)))
    counts = marked.groupBy("symbol").agg(F.count_if("_wanted").alias("kept"), F.count_if(~F.col("_wanted")).alias("dropped"))
    return marked.filter("_wanted").drop("_wanted"), counts


def regime_rows(states: DataFrame, method: str, parameters: str, updated_at: str) -> DataFrame:
    """Regime states as rows of their table: how they were found, a hash of the parameters, and when."""
    return states.select(*DAY, "state", "regime", "probabilities", F.lit(method).alias("method"), short_id(F.lit(method), F.lit(parameters)).alias("config_hash"), F.lit(updated_at).alias("updated_at"))


def store_regimes(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Upsert of regime rows; of one symbol, day and configuration the row with the latest updated_at stays."""
    upsert(spark, path, rows, [*DAY, "config_hash"], "updated_at")


def training_days(rollup: DataFrame, today: str, window: int = 60, keep: int = 30) -> DataFrame:
    """The last ``keep`` days with ticks in the ``window`` calendar days up to today, of each symbol."""
    end = F.lit(today).cast("date")
    recent = rollup.filter((F.col("trading_day") >= F.date_sub(end, window)) & (F.col("trading_day") <= end))
    return _first(recent.select(*DAY).distinct(), [F.desc("trading_day")], keep).select(*DAY)
