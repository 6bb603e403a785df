"""Roll schedule, continuous series and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import any_date, row_hash, safe_long, table_hash, whole
from tickweave.operators import days as days_
from tickweave.sources.ticks import NUMERIC, has_depth, with_missing_columns


def change_events(observations: DataFrame, key: str, at: str, value: str, day: str = "trading_day") -> DataFrame:
    """The first observation of a key and each one whose value differs from the one before; found within days and stitched."""
    return days_.changes(observations, [key], day, value, (at,))


def last_event_of_day(events: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(value, at).alias(value))


def daily_schedule(days: DataFrame, events: DataFrame, key: str = "symbol", contract: str = "contract") -> DataFrame:
    """key, day, contract, segment_id: events carried forward over trading days, days before the first event left out.

    Both tables are dimensions (days by varieties), so one window per key holds them.
    """
    by = Window.partitionBy(key).orderBy("day")
    # each key's days from its first event on, without pairing all keys with all days
    first = events.groupBy(key).agg(F.min("day").alias("_from"))
    end = days.agg(F.max("day").alias("_to"))  # one row
    grid = first.join(F.broadcast(end)).filter(F.col("_from") <= F.col("_to")).select(key, F.explode(F.sequence("_from", "_to")).alias("day")).join(days.select("day"), "day", "left_semi")
    filled = grid.unionByName(events.select(key, "day")).distinct().join(events, [key, "day"], "left").withColumn(contract, F.last(contract, True).over(by)).filter(F.col(contract).isNotNull()).join(days.select("day"), "day", "left_semi")
    return with_segments(filled.select(key, "day", contract), key, "day", contract)


def with_segments(rows: DataFrame, key: str, day: str, contract: str) -> DataFrame:
    """Column segment_id: + 1 at each change of contract, from 0."""
    by = Window.partitionBy(key).orderBy(day)
    changed = (F.lag(contract).over(by).isNotNull() & (F.lag(contract).over(by) != F.col(contract))).cast("long")
    return rows.withColumn("_c", changed).withColumn("segment_id", F.sum("_c").over(by)).drop("_c")


def schedule_hash(schedule: DataFrame) -> DataFrame:
    return table_hash(schedule, ["day", "contract", "segment_id"])


def schedule_range(stored: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """symbol, day, contract, segment_id, schedule_hash of stored rows of any column types, typed and sorted; rows without a valid day are left out."""
    rows = stored.select(F.col("symbol").cast("string").alias("symbol"), any_date(F.col("day")).cast("date").alias("day"), F.col("contract").cast("string").alias("contract"), safe_long(F.col("segment_id")).alias("segment_id"), F.col("schedule_hash").cast("string").alias("schedule_hash"))
    rows = rows.filter(F.col("day").isNotNull())
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(symbols))
    if start is not None:
        rows = rows.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("day") <= F.lit(end).cast("date"))
    return rows.orderBy("symbol", "day")


def schedule_state(schedule: DataFrame, key: str = "symbol") -> DataFrame:
    return schedule.groupBy(key).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.count_distinct("contract").alias("contracts"), F.count_distinct("segment_id").alias("segments"))


def stored_schedule_state(stored: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key: first and last day, days and the set of schedule hashes, sorted; blank hashes are none."""
    name = F.trim("schedule_hash")
    return stored.groupBy(key).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.array_sort(F.collect_set(F.when(name != "", name))).alias("hashes"))


def schedule_health(stored: DataFrame, expected: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key the first check that a stored schedule fails, or ok: rows, days, contracts, segments, hashes.

    Both sides have day, contract, segment_id and schedule_hash; rows without
    a day or contract don't count.  A missing segment is -1; the stored hashes
    must be exactly the expected one.
    """
    valid = lambda df: df.filter("day is not null and contract is not null")
    sides = valid(stored).withColumn("_stored", F.lit(1)).unionByName(valid(expected).withColumn("_stored", F.lit(0)), allowMissingColumns=True)
    mine, theirs = F.col("_stored") == 1, F.col("_stored") == 0
    differs = lambda c: ~F.array_sort(F.collect_list(F.when(mine, c))).eqNullSafe(F.array_sort(F.collect_list(F.when(theirs, c))))
    segment = F.coalesce("segment_id", F.lit(-1))
    # a (key, day) has a row on each side, or a few where days repeat
    by_day = sides.groupBy(key, "day").agg(
        F.count_if(mine).alias("_a"), F.count_if(theirs).alias("_b"), differs(F.col("contract")).alias("_contract"), differs(segment).alias("_segment"),
        F.collect_set(F.when(mine & (F.trim("schedule_hash") != ""), F.trim("schedule_hash"))).alias("_have"), F.collect_set(F.when(theirs, F.trim("schedule_hash"))).alias("_want"),
    )
    hashes = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    facts = by_day.groupBy(key).agg(
        F.sum("_b").alias("expected_rows"), F.sum("_a").alias("stored_rows"), F.count_if(F.col("_a") != F.col("_b")).alias("_days"), F.count_if("_contract").alias("_contracts"), F.count_if("_segment").alias("_segments"),
        hashes("_have").alias("hashes"), hashes("_want").alias("_want"),
    )
    # The names of the checks, in their order.
    failed = (
        F.when(F.col("stored_rows") != F.col("expected_rows"), "rows").when(F.col("_days") > 0, "days").when(F.col("_contracts") > 0, "contracts").when(F.col("_segments") > 0, "segments")
        .when(~F.col("hashes").eqNullSafe(F.col("_want")), "hashes").otherwise("ok")
    )
    return facts.select(key, "expected_rows", "stored_rows", "hashes", failed.alias("state"))


def schedule_difference(stored: DataFrame, expected: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key: days only stored, only expected, and with another contract or segment; all 0 means nothing to do."""
    a, b = stored.alias("a"), expected.alias("b")
    both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "day")], "full")
    matched = F.col("a.day").isNotNull() & F.col("b.day").isNotNull()
    return both.groupBy(F.coalesce(f"a.{key}", f"b.{key}").alias(key)).agg(
        F.count_if(F.col("b.day").isNull()).alias("only_stored"), F.count_if(F.col("a.day").isNull()).alias("only_expected"),
        F.count_if(matched & ~F.col("a.contract").eqNullSafe(F.col("b.contract"))).alias("other_contract"), F.count_if(matched & ~F.col("a.segment_id").eqNullSafe(F.col("b.segment_id"))).alias("other_segment"),
    )


def contract_as_of(lookups: DataFrame, schedule: DataFrame, key: str = "symbol") -> DataFrame:
    """Backward as-of join: each (key, day) with the contract of the latest schedule day <= it."""
    marked = schedule.select(key, "day", "contract", F.lit(0).alias("_side")).unionByName(lookups.select(key, "day", F.lit(None).cast("string").alias("contract"), F.lit(1).alias("_side")))
    by = Window.partitionBy(key).orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("contract", F.last("contract", True).over(by)).filter("_side = 1").select(key, "day", "contract")


def first_depth_day(ticks: DataFrame, contract: str = "underlying_contract") -> DataFrame:
    """First day with true depth of each contract."""
    return ticks.groupBy(contract).agg(F.min(F.when(has_depth(), F.col("trading_day"))).alias("first_day"))


def splice(raw: DataFrame, schedule: DataFrame, derived: str = "symbol") -> DataFrame:
    """Continuous series: of each trading day the depth ticks of its scheduled contract, with provenance.

    raw: contract ticks; schedule: symbol, day, contract, segment_id, small, so broadcast by Spark's own size check.
    """
    plan = schedule.select(F.col(derived).alias("_symbol"), F.col("day").alias("trading_day"), F.col("contract").alias("_contract"), F.col("segment_id").alias("_segment"))
    ticks = raw.filter(has_depth())
    joined = ticks.join(plan, (ticks["underlying_contract"] == plan["_contract"]) & (ticks["symbol"] == plan["_symbol"]) & (ticks["trading_day"] == plan["trading_day"]))
    return joined.select(F.col("_symbol").alias("symbol"), ticks["trading_day"], "datetime_ns", "row_hash", "underlying_contract", F.col("_segment").alias("segment_id"), "last_price", "volume")


def stored_ticks(raw: DataFrame, symbol: Column, tag: str = "main_l5", version: str = "v2") -> DataFrame:
    """Row projection of the series store: casts, tags and row identity."""
    out = with_missing_columns(raw)
    return out.select(
        symbol.alias("symbol"), F.timestamp_micros(whole(F.col("datetime_ns"), 1000)).alias("ts"), "datetime_ns", "trading_day", *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        row_hash(F.col("datetime_ns")).alias("row_hash"), F.lit(tag).alias("ticks_kind"), F.lit(version).alias("dataset_version"), "underlying_contract", "segment_id", "schedule_hash",
    )


def days_to_build(schedule: DataFrame, built: DataFrame, key: str = "symbol") -> DataFrame:
    """Scheduled days to build: all of a key whose stored schedule_hash is missing, mixed or another one, else those not present."""
    hashes = built.groupBy(key).agg(F.collect_set("schedule_hash").alias("_h"), F.count_if(F.col("schedule_hash").isNull()).alias("_none"))
    joined = schedule.join(hashes, key, "left")
    rebuild = F.col("_h").isNull() | (F.size("_h") != 1) | (F.col("_none") > 0) | (F.get("_h", F.lit(0)) != F.col("schedule_hash"))
    missing = joined.join(built.select(key, "day").distinct().withColumn("_there", F.lit(True)), [key, "day"], "left")
    return missing.filter(rebuild | F.col("_there").isNull()).select(key, "day", F.when(rebuild, "rebuild").otherwise("update").alias("plan"))


def rows_per_segment_day(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "segment_id", "trading_day").agg(F.count("*").alias("n_rows"))


def missing_days(expected: DataFrame, covered: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Expected days without ticks: provider if the manifest has no rows for the day, else engineering."""
    gone = expected.join(covered, ["symbol", "day"], "left_anti").join(manifest_rows, ["symbol", "day"], "left")
    return gone.select("symbol", "day", "segment_id", F.when(F.col("n_rows") <= 0, "provider").otherwise("engineering").alias("cause"))


def health(missing: DataFrame, hashes: DataFrame, tolerance: int = 0, validation: DataFrame | None = None) -> DataFrame:
    """Per symbol: counts by cause, number of schedule hashes and healthy.

    With validation (symbol, overall_state) an error there, or no state, isn't healthy either.
    """
    counts = missing.groupBy("symbol").agg(F.count_if(F.col("cause") == "provider").alias("provider"), F.count_if(F.col("cause") == "engineering").alias("engineering"))
    joined = hashes.join(counts, "symbol", "left").fillna(0, ["provider", "engineering"])
    healthy = (F.col("engineering") == 0) & (F.col("provider") <= tolerance) & (F.col("n_hashes") == 1)
    if validation is None:
        return joined.withColumn("healthy", healthy)
    rows = joined.join(validation.select("symbol", F.col("overall_state").alias("validation")), "symbol", "left")
    return rows.fillna("unknown", ["validation"]).withColumn("healthy", healthy & F.col("validation").isin("ok", "warn"))


def daily_aggregate(ticks: DataFrame) -> DataFrame:
    """The rollup: rows, first and last ns of each (symbol, day)."""
    return ticks.groupBy("symbol", "trading_day").agg(F.count("*").alias("n_rows"), F.min("datetime_ns").alias("first_ns"), F.max("datetime_ns").alias("last_ns"))


def day_bounds(ticks: DataFrame, depth_only: bool = False) -> DataFrame:
    rows = ticks.filter(has_depth()) if depth_only else ticks
    return rows.groupBy("symbol").agg(F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day"), F.count_distinct("trading_day").alias("n_days"), F.min("datetime_ns").alias("first_ns"), F.max("datetime_ns").alias("last_ns"))


def day_bounds_from_rollup(rollup: DataFrame, ticks: DataFrame) -> DataFrame:
    """Bounds from the rollup, from raw ticks for symbols that it lacks."""
    known = rollup.groupBy("symbol").agg(F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day"), F.count_distinct("trading_day").alias("n_days"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    return known.unionByName(day_bounds(ticks.join(known.select("symbol"), "symbol", "left_anti")))


def latest_ticks(ticks: DataFrame, columns: list[str]) -> DataFrame:
    newest = ticks.groupBy("symbol").agg(F.max(F.struct("datetime_ns", "row_hash", *columns)).alias("r"))
    return newest.select("symbol", "r.datetime_ns", *[f"r.{c}" for c in columns])


def recent_last(rollup: DataFrame, days: list[str]) -> DataFrame:
    """Last day and ns within a set of days."""
    return rollup.filter(F.col("trading_day").isin(days)).groupBy("symbol").agg(F.max("trading_day").alias("last_day"), F.max("last_ns").alias("last_ns"))


def contract_coverage(ticks: DataFrame) -> DataFrame:
    """Tick bounds and depth bounds of each contract in one pass."""
    deep = F.when(has_depth(), F.col("trading_day"))
    return ticks.groupBy("underlying_contract").agg(F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day"), F.min(deep).alias("first_depth_day"), F.max(deep).alias("last_depth_day"), F.max("datetime_ns").alias("last_ns"))


def coverage(wanted: DataFrame, ticks: DataFrame, series: DataFrame | None = None, last_only: bool = False) -> DataFrame:
    """Bounds of ticks and of depth ticks of the wanted contracts (column contract); those with neither are left out.

    series: the stored continuous series, far smaller than the ticks; where it
    has none of the wanted contracts the ticks' own depth counts.  last_only
    gives last days and times alone and, with a series, reads no book columns.
    """
    asked = wanted.select("contract").distinct()
    of = lambda df: df.withColumnRenamed("underlying_contract", "contract").join(asked, "contract", "left_semi")
    stored = None if series is None or of(series).isEmpty() else of(series)

    def bounds(name: str, when: Column | None = None) -> list[Column]:
        day, ns = (F.col(c) if when is None else F.when(when, F.col(c)) for c in ("trading_day", "datetime_ns"))
        last = [F.max(day).alias(f"last_{name}_day"), F.max(ns).alias(f"last_{name}_ns")]
        return last if last_only else [F.min(day).alias(f"first_{name}_day"), F.count_distinct(day).alias(f"{name}_days"), F.min(ns).alias(f"first_{name}_ns"), *last]

    found = of(ticks).groupBy("contract").agg(*bounds("tick"), *([] if stored is not None else bounds("depth", has_depth())))
    return found if stored is None else found.join(stored.groupBy("contract").agg(*bounds("depth")), "contract", "full")


def symbols_by_variety(rollup: DataFrame, ticks: DataFrame, varieties: list[str], exchange: str = "shfe") -> DataFrame:
    """variety, symbols, origin: how many symbols hold exchange.variety, by the rollup, by the ticks where it has none."""
    names = list(dict.fromkeys(v.strip().lower() for v in varieties if v.strip()))

    def counts(df: DataFrame, name: str) -> DataFrame:
        symbol = F.lower("symbol")
        found = df.select("symbol").distinct().agg(*[F.count_if(symbol.contains(f"{exchange}.{v}")).alias(f"_{i}") for i, v in enumerate(names)])
        return found.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variety"), F.col(f"_{i}").alias(name)) for i, v in enumerate(names)])))

    both = counts(rollup, "_rolled").join(counts(ticks, "_raw"), "variety")
    rolled = F.col("_rolled") > 0
    return both.select("variety", F.when(rolled, F.col("_rolled")).otherwise(F.col("_raw")).alias("symbols"), F.when(rolled, "rollup").otherwise("ticks").alias("origin"))
