"""Queries of feature selection, rolling correlation, fading metrics and fits."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import evaluation, experiments, features, research
from tickweave.plans.queries import ORD, W, query, r6
from tickweave.sources.ticks import kept, ticks_from_events

CANDIDATES = ["mid_lag_1", "mid_diff_1", "mid_x_spread", "mid_per_spread", "mid_mean_5", "mid_std_5", "spread_lag_1", "spread_diff_1", "spread_mean_5", "spread_std_5"]
MOST = 0.6


def _full(column: str, what: str) -> str:
    frame = f"OVER (PARTITION BY symbol, segment_id ORDER BY datetime_ns, row_hash ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = 5 AND lag(o, 4) OVER {W} >= o - 1 THEN {what}({column}) {frame} END"


GENERATED = f"""{ORD}, b AS (SELECT *, ask_price1 - bid_price1 AS spread FROM d), near AS (SELECT *, CASE WHEN lag(o, 1) OVER {W} >= o - 1 THEN lag(mid, 1) OVER {W} END AS mid_lag_1, CASE WHEN lag(o, 1) OVER {W} >= o - 1 THEN lag(spread, 1) OVER {W} END AS spread_lag_1 FROM b),
gen AS (SELECT symbol, row_hash, mid_lag_1, mid - mid_lag_1 AS mid_diff_1, mid * spread AS mid_x_spread, mid / nullif(spread, 0) AS mid_per_spread, {_full('mid', 'avg')} AS mid_mean_5, {_full('mid', 'stddev_samp')} AS mid_std_5,
spread_lag_1, spread - spread_lag_1 AS spread_diff_1, {_full('spread', 'avg')} AS spread_mean_5, {_full('spread', 'stddev_samp')} AS spread_std_5 FROM near)"""
_PAIRS = ", ".join(f"coalesce(abs(corr({a}, {b})), 0) AS c_{i}_{j}" for (i, a), (j, b) in itertools.combinations(enumerate(CANDIDATES), 2))
# each feature is kept if no kept one before it is too close
_STEPS = "".join(
    f", k{j} AS (SELECT *, {' AND '.join(['true', *[f'(NOT k_{i} OR c_{i}_{j} <= {MOST})' for i in range(j)]])} AS k_{j} FROM {'cc' if j == 0 else f'k{j - 1}'})" for j in range(len(CANDIDATES))
)
_KEPT = " UNION ALL ".join(f"SELECT '{c}' AS feature FROM k{len(CANDIDATES) - 1} WHERE k_{j}" for j, c in enumerate(CANDIDATES))


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    return features.generated(ticks_from_events(spark, sf), ["mid", "spread"], (1,), (5,))


@query(f"WITH {GENERATED} SELECT symbol, row_hash, round(mid_mean_5, 4) AS mid_mean_5, round(mid_std_5, 4) AS mid_std_5, round(spread_mean_5, 4) AS spread_mean_5, round(spread_std_5, 4) AS spread_std_5 FROM gen")
def o7_rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["mid_mean_5", "mid_std_5", "spread_mean_5", "spread_std_5"]
    return _generated(spark, sf).select("symbol", "row_hash", *[F.round(c, 4).alias(c) for c in names])


@query(f"WITH {GENERATED}, cc AS (SELECT {_PAIRS} FROM gen){_STEPS} {_KEPT}")
def o7_uncorrelated_features(spark: SparkSession, sf: str) -> DataFrame:
    found = research.uncorrelated(_generated(spark, sf), CANDIDATES, MOST)
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query(
    """WITH b AS (SELECT symbol, datetime_ns // 3600000000000 AS h, avg(last_price) AS p FROM t GROUP BY ALL), w AS (SELECT x.symbol AS a, y.symbol AS b, lag FROM (SELECT DISTINCT symbol FROM t) x, (SELECT DISTINCT symbol FROM t) y, (VALUES (0), (3)) l(lag) WHERE x.symbol = 'click' AND y.symbol <> 'click'),
j AS (SELECT w.a, w.b, w.lag, x.h, x.p AS x, y.p AS y FROM w JOIN b x ON x.symbol = w.a JOIN b y ON y.symbol = w.b AND y.h = x.h + w.lag), f AS (SELECT a, b, lag, h, count(*) OVER r AS n, corr(x, y) OVER r AS c, var_pop(x) OVER r AS vx, var_pop(y) OVER r AS vy FROM j WINDOW r AS (PARTITION BY a, b, lag ORDER BY h RANGE BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT a, b, lag, h, n, CASE WHEN n > 1 AND vx * n > 1e-6 AND vy * n > 1e-6 THEN round(c, 5) END AS corr FROM f"""
)
def o8_rolling_correlation(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    others = t.select("symbol").distinct().filter("symbol <> 'click'")
    wanted = others.select(F.lit("click").alias("a"), F.col("symbol").alias("b"), F.explode(F.array(F.lit(0), F.lit(3))).alias("lag"))
    out = research.rolling_correlation(t, wanted, 3_600_000_000_000, 24)
    return out.withColumn("corr", F.round("corr", 5))


_SCORED = "pr AS (SELECT symbol, trading_day, datetime_ns, hour(make_timestamp(datetime_ns // 1000)) // 8 AS shift, CASE WHEN ask_price1 - bid_price1 >= 5 THEN 'wide' ELSE 'tight' END AS regime, row_hash % 3 AS l, 0.5 AS p0, (row_hash % 5) / 10.0::DOUBLE AS p1, 0.5 - (row_hash % 5) / 10.0::DOUBLE AS p2 FROM t)"


@query(
    f"""WITH {_SCORED}, dd AS (SELECT DISTINCT symbol, regime, shift, trading_day, (date_diff('day', DATE '1970-01-01', trading_day) + 1) * 86400 AS e FROM pr),
m AS (SELECT d.symbol, d.regime, d.shift, d.trading_day, l, p0, p1, p2, CASE l WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p, pow(2.0, -(e - datetime_ns / 1e9) / 259200.0) AS w FROM dd d JOIN pr ON pr.symbol = d.symbol AND pr.regime = d.regime AND pr.shift = d.shift AND pr.trading_day <= d.trading_day)
SELECT symbol, regime, shift, trading_day, count(*) AS n, round(sum(w * (pow(p0 - (l = 0)::INT, 2) + pow(p1 - (l = 1)::INT, 2) + pow(p2 - (l = 2)::INT, 2))) / sum(w), 6) AS brier, round(sum(-w * ln(greatest(1e-10, p))) / sum(w), 6) AS log_loss, round(sum(w * (p = greatest(p0, p1, p2))::INT) / sum(w), 6) AS accuracy FROM m GROUP BY ALL"""
)
def o6_fading_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Half-life of three days, by symbol, spread regime and third of the day."""
    p1 = (F.col("row_hash") % 5) / F.lit(10.0)
    shift = F.floor(F.hour(F.timestamp_micros(F.expr("datetime_ns div 1000"))) / 8)
    regime = F.when(F.col("ask_price1") - F.col("bid_price1") >= 5, "wide").otherwise("tight")
    rows = ticks_from_events(spark, sf).select("symbol", "trading_day", "datetime_ns", shift.alias("shift"), regime.alias("regime"), (F.col("row_hash") % 3).alias("l"), F.lit(0.5).alias("p0"), p1.alias("p1"), (0.5 - p1).alias("p2"))
    out = research.fading_metrics(rows, ["symbol", "regime", "shift"], "l", ["p0", "p1", "p2"], 3 * 86_400)
    return out.select("symbol", "regime", "shift", "trading_day", "n", *[r6(c).alias(c) for c in ("brier", "log_loss", "accuracy")])


_BUILDS = "bf AS (SELECT DISTINCT symbol, CASE symbol WHEN 'view' THEN 'raw' ELSE 'main_l5' END AS kind, 'v2' AS version, CASE symbol WHEN 'error' THEN '' ELSE 'h1' END AS hash FROM t), bl AS (SELECT DISTINCT symbol, 'main_l5' AS kind, CASE symbol WHEN 'signup' THEN 'v1' ELSE 'v2' END AS version, CASE symbol WHEN 'click' THEN 'h1' ELSE 'h2' END AS hash FROM t)"


@query(f"WITH {_BUILDS} SELECT f.symbol, CASE WHEN f.kind <> l.kind THEN 'ticks_kind_mismatch' WHEN f.version <> l.version THEN 'dataset_version_mismatch' WHEN f.hash = '' OR l.hash = '' THEN 'missing_schedule' WHEN f.hash <> l.hash THEN 'schedule_hash_mismatch' END AS reason FROM bf f JOIN bl l USING (symbol)")
def k1_training_guards(spark: SparkSession, sf: str) -> DataFrame:
    symbols = ticks_from_events(spark, sf).select("symbol").distinct()
    at = lambda symbol, yes, no: F.when(F.col("symbol") == symbol, yes).otherwise(no)
    record = lambda kind, version, schedule: symbols.select("symbol", kind.alias("ticks_kind"), version.alias("dataset_version"), F.lit("fnv").alias("row_hash_algo"), schedule.alias("schedule_hash"))
    return experiments.training_guards(record(at("view", "raw", "main_l5"), F.lit("v2"), at("error", "", "h1")), record(F.lit("main_l5"), at("signup", "v1", "v2"), at("click", "h1", "h2")))


NAMES = ["spread", "imbalance_1", "book_slope"]
OPTIONS = [{"l2": 1e-4}, {"l2": 1e-1}]


def _units(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    data = kept(features.factors_and_labels(t, [*NAMES, "mid"], (10,)))
    # a row falls in up to five splits: written once, dealt to splits by each reader
    return evaluation.walk_forward_by_symbol(kept(evaluation.with_position(data)), min_train=30)


@query()
def k10_benchmark_of_fits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _units(spark, sf)
    return experiments.benchmark(experiments.score_units(rows, NAMES, "label_10", experiments.fit_units(rows, NAMES, "label_10", OPTIONS, min_rows=30), ("test",)))


@query()
def k16_swept_options(spark: SparkSession, sf: str) -> DataFrame:
    rows = _units(spark, sf)
    return experiments.best_options(experiments.score_units(rows, NAMES, "label_10", experiments.fit_units(rows, NAMES, "label_10", OPTIONS, min_rows=30), ("val",)))


@query()
def k17_daily_run(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.daily_run(ticks_from_events(spark, sf), k1_training_guards(spark, sf).withColumn("reason", F.when(F.col("symbol") == "view", F.col("reason"))), NAMES, 10, OPTIONS, min_train=30)
