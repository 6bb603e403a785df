"""Second-level gap validation and its ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import whole
from tickweave.sources.ticks import has_depth

DAY = ["symbol", "trading_day"]
# Gap buckets in seconds.
BUCKETS = {"gap_2_5": (2, 5), "gap_6_15": (6, 15), "gap_16_30": (16, 30), "gap_gt_30": (31, None)}


def per_second_counts(ticks: DataFrame, shallow: bool = False) -> DataFrame:
    """Depth ticks of each second; with shallow also seconds that have none, as 0."""
    second = whole(F.col("datetime_ns"), 1_000_000_000).alias("sec")
    if shallow:
        return ticks.groupBy(*DAY, second).agg(F.count_if(has_depth()).alias("n"))
    return ticks.filter(has_depth()).groupBy(*DAY, second).agg(F.count("*").alias("n"))


def second_stats(seconds: DataFrame, strict_ratio: float = 0.5) -> DataFrame:
    """Seconds with ticks, with one, with two or more, and the cadence of each day."""
    out = seconds.groupBy(*DAY).agg(F.count("*").alias("seconds"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") >= 2).alias("two_plus"))
    return out.withColumn("cadence", F.when(F.try_divide("two_plus", "seconds") >= strict_ratio, "fixed_0p5s").otherwise("event"))


def gap_segments(seconds: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every run of seconds without ticks inside a session interval, before, between and after ticks.

    intervals: symbol, trading_day, session, seq, start_s, end_s.  Empty
    intervals give one run over the whole.  Sentinels just outside the
    interval stand for its ends; one window per (symbol, day, interval).
    """
    keys = [*DAY, "session", "seq", "start_s", "end_s"]
    inside = intervals.join(seconds, DAY).filter(F.col("sec").between(F.col("start_s"), F.col("end_s"))).select(*keys, "sec")
    ends = intervals.select(*keys, F.explode(F.array(F.col("start_s") - 1, F.col("end_s") + 1)).alias("sec"))
    by = Window.partitionBy(*keys).orderBy("sec")
    rows = inside.unionByName(ends).withColumn("next", F.lead("sec").over(by))
    return rows.filter(F.col("next") - F.col("sec") > 1).select(*keys, (F.col("sec") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"), (F.col("next") - F.col("sec") - 1).alias("duration_s"))


def with_threshold(gaps: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    """Column is_gap: the run reaches the session's threshold (floor 0.5 s)."""
    limit = F.lit(max(0.5, default))
    for session, value in thresholds.items():
        limit = F.when(F.col("session") == session, F.lit(max(0.5, value))).otherwise(limit)
    return gaps.withColumn("is_gap", F.col("duration_s") >= limit)


def _bucket_counts(unit: int) -> list[Column]:
    d = F.col("duration_s")
    return [F.count_if(F.col("is_gap") & (d >= low * unit) & (F.lit(True) if high is None else d < (high + 1) * unit)).alias(name) for name, (low, high) in BUCKETS.items()]


def day_summary(seconds: DataFrame, intervals: DataFrame, strict_ratio: float = 0.5, thresholds: dict[str, float] | None = None, default_threshold: float = 5.0, unit: int = 1) -> DataFrame:
    """One row for each (symbol, day) of the intervals: expected, observed and missing seconds, half-second misses, gaps by bucket, lag, cadence.

    unit scales the bucket bounds for sparser series.
    """
    expected = intervals.groupBy(*DAY).agg(F.sum(F.col("end_s") - F.col("start_s") + 1).alias("expected_seconds"), F.sum(F.greatest(F.col("end_s") - F.col("start_s") - 1, F.lit(0))).alias("strict_seconds"), F.max("end_s").alias("last_end"))
    placed = seconds.join(intervals, DAY).withColumn("_in", F.col("sec").between(F.col("start_s"), F.col("end_s"))).withColumn("_edge", (F.col("sec") == F.col("start_s")) | (F.col("sec") == F.col("end_s")))
    once = placed.groupBy(*DAY, "sec", "n").agg(F.bool_or("_in").alias("inside"), F.bool_or("_edge").alias("edge"))
    strict = F.col("inside") & ~F.col("edge")
    observed = once.groupBy(*DAY).agg(
        F.count_if("inside").alias("inside_seconds"), F.count_if(~F.col("inside")).alias("outside_seconds"), F.count_if(strict & (F.col("n") == 1)).alias("one_seconds"), F.count_if(strict & (F.col("n") >= 2)).alias("two_plus_seconds"),
        F.max(F.when(F.col("inside"), F.col("sec"))).alias("last_second"), F.count_if("edge").alias("edge_seconds"),
    )
    edges = intervals.select(*DAY, F.explode(F.array("start_s", "end_s")).alias("sec")).distinct().groupBy(*DAY).agg(F.count("*").alias("all_edges"))
    gaps = with_threshold(gap_segments(seconds, intervals), thresholds or {}, default_threshold)
    by_day = gaps.groupBy(*DAY).agg(F.count_if("is_gap").alias("missing_segments"), F.max("duration_s").alias("max_gap_s"), *_bucket_counts(unit))
    cadence = second_stats(seconds, strict_ratio).select(*DAY, "cadence")
    out = reduce(lambda a, b: a.join(b, DAY, "left"), [expected, observed, edges, by_day, cadence])
    zero = {c: 0 for c in ("inside_seconds", "outside_seconds", "one_seconds", "two_plus_seconds", "edge_seconds", "missing_segments", "max_gap_s", *BUCKETS)}
    out = out.fillna(zero).fillna("event", ["cadence"])
    seen = F.col("one_seconds") + F.col("two_plus_seconds")
    return out.select(
        *DAY, "expected_seconds", "strict_seconds", "inside_seconds", "outside_seconds", "one_seconds", "two_plus_seconds", (F.col("all_edges") - F.col("edge_seconds")).alias("boundary_missing"),
        (F.col("strict_seconds") - seen).alias("missing_seconds"), F.when(F.col("cadence") == "fixed_0p5s", F.col("strict_seconds") - F.col("two_plus_seconds")).otherwise(0).alias("missing_half_seconds"),
        "missing_segments", "max_gap_s", *BUCKETS, "cadence", ((F.col("inside_seconds") == 0) & (F.col("expected_seconds") > 0)).alias("missing_day"), (F.col("last_end") - F.col("last_second")).alias("end_lag_s"),
    )


def observed_segments(seconds: DataFrame, intervals: DataFrame, threshold: float) -> DataFrame:
    """Runs of ticks per session: 1 + gaps between ticks that reach the threshold."""
    by = Window.partitionBy(*DAY, "session", "seq").orderBy("sec")
    inside = intervals.join(seconds, DAY).filter(F.col("sec").between(F.col("start_s"), F.col("end_s"))).withColumn("gap", F.col("sec") - F.lag("sec").over(by) - 1)
    return inside.groupBy(*DAY, "session").agg((F.count_if(F.col("gap") >= threshold) + F.count_distinct("seq")).alias("observed_segments"))


def first_gaps(gaps: DataFrame, per_day: int = 200) -> DataFrame:
    """At most per_day (10 or more) gap rows of each day for reports; totals stay whole."""
    by = Window.partitionBy(*DAY).orderBy("gap_start", "session")
    return gaps.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= max(10, per_day)).drop("_n")


def run_totals(summary: DataFrame) -> DataFrame:
    totals = [c for c in summary.columns if summary.schema[c].dataType.typeName() in ("long", "integer") and c not in ("max_gap_s", "end_lag_s")]
    out = summary.groupBy("symbol").agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in totals], F.max("max_gap_s").alias("max_gap_s"), F.count_if("missing_day").alias("missing_days"), F.max("end_lag_s").alias("max_end_lag_s"), F.sum(F.when(F.col("cadence") == "fixed_0p5s", F.col("strict_seconds")).otherwise(0)).alias("fixed_strict_seconds"))
    # the strict range is the denominator; of half seconds that of days with a fixed cadence, where alone they are missed
    return out.withColumn("missing_ratio", F.coalesce(F.try_divide("missing_seconds", "strict_seconds"), F.lit(0.0))).withColumn("half_ratio", F.coalesce(F.try_divide("missing_half_seconds", "fixed_strict_seconds"), F.lit(0.0))).withColumn("segments_avg", F.try_divide("missing_segments", "days"))


def states(totals: DataFrame, gap_block: int = 0, outside_block: float = 0, half_block: float = 0.05, half_info: float = 0.0, tolerance: int = 0, source_blocking: bool = True, segments_warn: float = 0.0) -> DataFrame:
    """Engineering, source, policy and overall state and one reason code, by fixed priority.

    Columns provider_errors and provider_missing_segments, if there, make the source state warn.
    """
    outside_blocked = F.col("outside_seconds") > outside_block
    half = F.when(F.col("missing_half_seconds") <= 0, "ok").when((F.col("fixed_strict_seconds") <= 0) | (F.col("half_ratio") >= half_block), "error").when(F.col("half_ratio") >= half_info, "info").otherwise("ok")
    gap_blocked = F.col("gap_gt_30") > gap_block
    days_blocked = F.lit(source_blocking) & (F.col("missing_days") > tolerance)
    doubtful = reduce(Column.__or__, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("provider_errors", "provider_missing_segments") if c in totals.columns], F.lit(False))
    rows = totals.withColumn("half_state", half)
    rows = rows.withColumn("engineering_state", F.when(outside_blocked, "error").when(F.col("outside_seconds") > 0, "warn").otherwise("ok"))
    rows = rows.withColumn("policy_state", F.when(gap_blocked | (F.col("half_state") == "error"), "error").when((F.col("half_state") == "info") | (F.lit(segments_warn > 0) & (F.col("segments_avg") > segments_warn)), "warn").otherwise("ok"))
    rows = rows.withColumn("source_state", F.when(days_blocked, "error").when((F.col("missing_days") > 0) | doubtful, "warn").otherwise("ok"))
    three = F.array("engineering_state", "source_state", "policy_state")
    rows = rows.withColumn("overall_state", F.when(F.array_contains(three, "error"), "error").when(F.array_contains(three, "warn"), "warn").otherwise("ok"))
    # The reason codes.
    reason = (
        F.when(outside_blocked, "outside_sessions_block").when(F.col("half_state") == "error", "missing_half_seconds_block").when(gap_blocked, "gap_gt30_block").when(days_blocked, "source_missing_days_block")
        .when(F.col("missing_days") > 0, "source_missing_days_warn").when(F.col("half_state") == "info", "missing_half_seconds_info").when(F.col("engineering_state") == "warn", "outside_sessions_warn").otherwise("quality_ok")
    )
    return rows.withColumn("reason_code", reason)


def issue_days(summary: DataFrame, top: int | None = None) -> DataFrame:
    """Days with any gap, half-second miss, outside second or no tick at all, worst first."""
    bad = summary.filter((F.col("missing_segments") > 0) | (F.col("missing_half_seconds") > 0) | (F.col("outside_seconds") > 0) | F.col("missing_day"))
    bad = bad.orderBy(F.desc("gap_gt_30"), F.desc("missing_segments"), F.desc("missing_half_seconds"), F.desc("max_gap_s"), F.desc("outside_seconds"), *DAY)
    return bad if top is None else bad.limit(top)


def lag_p95(summary: DataFrame, column: str = "end_lag_s") -> DataFrame:
    """Per symbol the value at index int(0.95 * (n - 1)) of the sorted lags, and the largest."""
    by = Window.partitionBy("symbol").orderBy(column)
    rows = summary.filter(F.col(column).isNotNull()).withColumn("_i", F.row_number().over(by)).withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    return rows.groupBy("symbol").agg(F.max(F.when(F.col("_i") == F.floor(0.95 * (F.col("_n") - 1)) + 1, F.col(column))).alias("lag_p95"), F.max(column).alias("lag_max"))


def attribute_gaps(gaps: DataFrame, provider: DataFrame) -> DataFrame:
    """Column provider_has_ticks: the provider has a depth tick between the gap's ends.

    Gap ends and provider seconds of a day meet in one order; a gap holds
    seconds if more have passed at its end than before its start.  The work
    is in proportion to gaps plus seconds.
    """
    seconds = per_second_counts(provider).select(*DAY, "sec").distinct().select(*DAY, "sec", F.lit(1).alias("_kind"))
    key = F.struct("session", "seq", "gap_start").alias("_gap")
    ends = gaps.select(*DAY, key, F.inline(F.array(F.struct(F.col("gap_start").alias("sec"), F.lit(0).alias("_kind")), F.struct(F.col("gap_end").alias("sec"), F.lit(2).alias("_kind")))))
    by = Window.partitionBy(*DAY).orderBy("sec", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    passed = ends.unionByName(seconds, allowMissingColumns=True).withColumn("_passed", F.count(F.when(F.col("_kind") == 1, 1)).over(by)).filter("_kind <> 1")
    hit = passed.groupBy(*DAY, "_gap").agg((F.max("_passed") > F.min("_passed")).alias("provider_has_ticks")).select(*DAY, "_gap.*", "provider_has_ticks")
    return gaps.join(hit, [*DAY, "session", "seq", "gap_start"], "left").fillna(False, ["provider_has_ticks"])


def last_validated(summary: DataFrame, hash_col: str = "schedule_hash") -> DataFrame:
    return summary.groupBy("symbol", hash_col).agg(F.max("trading_day").alias("last_validated_day"))


def resolve_policy(targets: DataFrame, policies: DataFrame, name: str, default: float, low: float, high: float) -> DataFrame:
    """Value of a policy by (variety, session), then variety, then global, then the default; clamped, with its origin."""
    p = policies.filter(F.col("name") == name)
    both = p.filter("variety is not null and session is not null").select("variety", "session", F.col("value").alias("_vs"))
    one = p.filter("variety is not null and session is null").select("variety", F.col("value").alias("_v"))
    every = p.filter("variety is null and session is null").agg(F.max("value").alias("_g"))
    out = targets.join(both, ["variety", "session"], "left").join(one, "variety", "left").join(F.broadcast(every))
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("_vs", "_v", "_g", F.lit(default))))
    source = F.when(F.col("_vs").isNotNull(), "session").when(F.col("_v").isNotNull(), "variety").when(F.col("_g").isNotNull(), "global").otherwise("default")
    return out.select(*targets.columns, value.alias("value"), source.alias("origin"))


def tick_gap_ledger(summary: DataFrame) -> DataFrame:
    """Abnormal and critical gap counts of each day from the summary."""
    return summary.select(*DAY, F.col("strict_seconds").alias("expected_min"), (F.col("strict_seconds") * 2).alias("expected_max"), (F.col("max_gap_s") * 1000).alias("max_interval_ms"), (F.col("gap_2_5") + F.col("gap_6_15") + F.col("gap_16_30")).alias("abnormal_gaps"), F.col("gap_gt_30").alias("critical_gaps"))
