"""Registered queries of ledger reads, builds and the registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import calendars, scalars
from tickweave.operators import builds, evaluation, extras, features, ledgers, schedule, validation
from tickweave.plans import queries as q
from tickweave.plans.queries import DAYSUM, DEEP, GAPS, ORD, PATH, TOTALS, W, query, r6
from tickweave.sources.ticks import shared_root, ticks_from_events, upsert

TOP = "row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS rank"


def _top(source: str, order: str, n: int, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT *, {TOP.format(order=order)} FROM {source} WHERE {where}) WHERE rank <= {n}"


@query(f"WITH {DAYSUM} SELECT symbol, trading_day, rank::INT AS rank, cadence, missing_segments, max_gap_s FROM ({_top('ds', 'trading_day DESC', 7)})")
def g28_latest_days(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.latest_days(q._summary(spark, sf), 7).select("symbol", "trading_day", "rank", "cadence", "missing_segments", "max_gap_s")


@query(f"WITH {DAYSUM} SELECT symbol, trading_day, rank::INT AS rank, max_gap_s, missing_segments FROM ({_top('ds', 'max_gap_s DESC, missing_segments DESC, trading_day DESC', 5, 'max_gap_s > 0')})")
def g28_top_gap_days(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.top_gap_days(q._summary(spark, sf), 5).select("symbol", "trading_day", "rank", "max_gap_s", "missing_segments")


@query(f"WITH {DAYSUM} SELECT symbol, trading_day, rank::INT AS rank, end_lag_s FROM ({_top('ds', 'end_lag_s DESC, trading_day DESC', 5, 'end_lag_s IS NOT NULL')})")
def g28_top_lag_days(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.top_lag_days(q._summary(spark, sf), 5).select("symbol", "trading_day", "rank", "end_lag_s")


_LISTED = _top("gaps", "gap_start DESC, session", 500, "trading_day >= DATE '2024-01-05' AND trading_day <= DATE '2024-01-25' AND duration_s >= 600")


@query(f"WITH {GAPS} SELECT symbol, trading_day, session, gap_start, duration_s, rank::INT AS rank FROM ({_LISTED})")
def g28_gap_list(spark: SparkSession, sf: str) -> DataFrame:
    out = ledgers.list_gaps(q.g9_gap_segments(spark, sf), "2024-01-05", "2024-01-25", 600)
    return out.select("symbol", "trading_day", "session", "gap_start", "duration_s", "rank")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return validation.states(validation.run_totals(q._summary(spark, sf)), gap_block=10, outside_block=100000, half_block=2.0, half_info=2.0, tolerance=5)


@query(f"""WITH {TOTALS} SELECT symbol, CASE WHEN gap_gt_30 > 10 OR missing_days > 5 OR outside_seconds > 100000 THEN 'error' WHEN outside_seconds > 0 OR missing_days > 0 THEN 'warn' ELSE 'ok' END AS overall_state,
round(missing_days / days, 6) AS missing_day_rate, outside_seconds, gap_gt_30 FROM tt""")
def g29_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.readiness(_states(spark, sf)).select("symbol", "overall_state", r6("missing_day_rate").alias("missing_day_rate"), "outside_seconds", "gap_gt_30")


_ISSUES = _top("ds", "gap_gt_30 DESC, missing_segments DESC, missing_half_seconds DESC, max_gap_s DESC, outside_seconds DESC, trading_day", 4, "missing_segments > 0 OR missing_half_seconds > 0 OR outside_seconds > 0 OR missing_day")


@query(f"WITH {DAYSUM} SELECT symbol, trading_day, rank::INT AS rank, missing_segments, missing_half_seconds, outside_seconds, max_gap_s FROM ({_ISSUES})")
def g30_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.anomalies(q._summary(spark, sf), 4)


@query(f"WITH {TOTALS} SELECT symbol, days, CASE WHEN missing_days = 0 AND missing_segments = 0 AND half = 0 THEN 'ok' ELSE 'warn' END AS status FROM tt")
def g31_page_status(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.page_status(validation.run_totals(q._summary(spark, sf)))


_PLAN = "pl AS (SELECT DISTINCT symbol, trading_day AS day, underlying_contract AS contract, segment_id FROM t)"


def _plan(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol", F.col("trading_day").alias("day"), F.col("underlying_contract").alias("contract"), "segment_id").distinct()


@query(f"WITH {_PLAN} SELECT symbol, day, CASE WHEN day(day) % 3 = 0 THEN 'provider_empty_day' WHEN day(day) % 3 = 1 THEN 'unknown_partial' ELSE 'unknown' END AS inference FROM pl")
def g17_day_inference(spark: SparkSession, sf: str) -> DataFrame:
    days = _plan(ticks_from_events(spark, sf)).select("symbol", "day")
    n = F.dayofmonth("day") % 3
    manifest = days.filter(n < 2).select("symbol", "day", n.alias("n_rows"))
    return ledgers.infer_missing_days(days, manifest)


_LATE = "(symbol <> 'click' OR trading_day >= DATE '2024-01-08')"


@query(f"WITH {_PLAN}, f AS (SELECT symbol, min(trading_day) AS d FROM (SELECT symbol, (make_timestamp(min(datetime_ns) // 1000) + INTERVAL 8 HOUR) AS l, NULL AS x FROM t WHERE {DEEP} AND {_LATE} GROUP BY 1), LATERAL (SELECT CASE WHEN hour(l) >= 18 THEN l::DATE + 1 ELSE l::DATE END AS trading_day) GROUP BY 1) SELECT symbol, day, contract, segment_id FROM pl JOIN f USING (symbol) WHERE day >= greatest(d, DATE '2024-01-04')")
def g25_aligned_schedule(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    late = t.filter((F.col("symbol") != "click") | (F.col("trading_day") >= F.lit("2024-01-08").cast("date")))
    return ledgers.aligned_schedule(_plan(t), late, None, "2024-01-04")


@query(f"WITH {_PLAN}, k AS (SELECT *, symbol IN ('click', 'view') AND day < DATE '2024-01-10' AS gone FROM pl) SELECT symbol, count(*) FILTER (WHERE NOT gone) AS days, min(day) FILTER (WHERE NOT gone) AS first_day, (SELECT count(*) FROM k WHERE gone) AS removed FROM k GROUP BY symbol")
def d10_trimmed_schedule(spark: SparkSession, sf: str) -> DataFrame:
    kept, removed = ledgers.trim_schedule(_plan(ticks_from_events(spark, sf)), ["click", "view"], "2024-01-10")
    return kept.groupBy("symbol").agg(F.count("*").alias("days"), F.min("day").alias("first_day")).join(removed)


@query(f"""WITH k AS (SELECT *, day(trading_day) AS dd FROM t), x AS (SELECT DISTINCT symbol, trading_day AS day, CASE WHEN dd % 7 = 0 THEN 'no_ticks' WHEN dd % 5 = 0 THEN 'no_depth' END AS reason FROM k)
SELECT symbol, reason, count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM x WHERE reason IS NOT NULL GROUP BY ALL""")
def e6_skip_ledger(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf).withColumn("underlying_contract", F.concat("symbol", F.lit("."), "segment_id"))
    day = F.dayofmonth("trading_day")
    shallow = [F.when(day % 5 == 0, 0.0).otherwise(F.col(c)).alias(c) if c[-1] in "2345" and c[:3] in ("bid", "ask") else F.col(c) for c in t.columns]
    return ledgers.skips_by_reason(ledgers.skip_ledger(_plan(t), t.filter(day % 7 != 0).select(*shallow)))


@query("""WITH r AS (SELECT symbol, trading_day, count(*) AS n_rows, min(datetime_ns) AS first_ns, max(datetime_ns) AS last_ns FROM t GROUP BY ALL)
SELECT symbol, trading_day, CASE WHEN symbol <> 'click' AND day(trading_day) <= 10 THEN n_rows ELSE n_rows + 1 END AS n_rows, first_ns, last_ns FROM r""")
def e11_refreshed_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    stale = schedule.daily_aggregate(t).withColumn("n_rows", F.col("n_rows") + 1)
    touched = t.filter(F.dayofmonth("trading_day") <= 10).select("symbol", "trading_day")
    health = t.select("symbol").distinct().withColumn("healthy", F.col("symbol") != "click")
    return ledgers.refreshed_rollup(stale, t, touched, health)


@query("SELECT symbol, max(trading_day) AS last_day, CASE WHEN symbol = 'view' THEN max(datetime_ns) ELSE max(datetime_ns) + 1 END AS last_ns FROM t GROUP BY symbol")
def f5_latest_from_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    rollup = schedule.daily_aggregate(t).filter("symbol <> 'view'").withColumn("last_ns", F.col("last_ns") + 1)
    return ledgers.latest_from_rollup(rollup, t)


@query("""WITH x AS (SELECT symbol, trading_day, make_timestamp(datetime_ns // 1000) + INTERVAL 8 HOUR AS l FROM t), o AS (SELECT symbol, CASE WHEN hour(l) >= 18 THEN l::DATE + 1 ELSE l::DATE END AS d FROM x)
SELECT symbol, count(*) FILTER (WHERE d = DATE '2024-01-12') AS kept, count(*) FILTER (WHERE d <> DATE '2024-01-12') AS dropped FROM o GROUP BY 1""")
def c12_target_day(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    targets = t.select("symbol").distinct().withColumn("trading_day", F.lit("2024-01-12").cast("date"))
    return ledgers.target_day_ticks(t, targets)[1]


@query("WITH d AS (SELECT DISTINCT symbol, trading_day FROM t WHERE trading_day BETWEEN DATE '2024-01-28' - 20 AND DATE '2024-01-28'), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_day DESC) AS n FROM d) SELECT symbol, trading_day FROM n WHERE n <= 10")
def l4_training_days(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.training_days(schedule.daily_aggregate(ticks_from_events(spark, sf)), "2024-01-28", 20, 10)


# builds and registry --------------------------------------------------------
def _with_hash(spark: SparkSession, sf: str, mixed: bool = False) -> DataFrame:
    t = ticks_from_events(spark, sf)
    other = (F.col("symbol") == "view") & (F.col("segment_id") == 2) if mixed else F.lit(False)
    return t.withColumn("schedule_hash", F.when(other, "h2").otherwise("h1"))


def _record_sql(rows: str, kind: str, parameters: str) -> str:
    return f"SELECT symbol, substr(sha256(concat_ws(',', symbol, '{kind}', 'h1', '{parameters}')), 1, 16) AS build_id, count(*) AS n_rows, min(trading_day) AS first_day, max(trading_day) AS last_day FROM {rows} GROUP BY symbol"


@query(_record_sql("(SELECT * FROM t WHERE symbol <> 'view')", "main_l5", "spread|mid"))
def i15_feature_build(spark: SparkSession, sf: str) -> DataFrame:
    return builds.feature_build(_with_hash(spark, sf, True), ["spread", "mid"])[1].select("symbol", "build_id", "n_rows", "first_day", "last_day")


@query(_record_sql("t", "main_l5", "h=10,50;k=1;tick=1.0"))
def j5_label_build(spark: SparkSession, sf: str) -> DataFrame:
    return builds.label_build(_with_hash(spark, sf))[1].select("symbol", "build_id", "n_rows", "first_day", "last_day")


_FILLS = """WITH q AS (SELECT symbol, trading_day, row_hash, coalesce(bid_price1, 0) AS b, coalesce(ask_price1, 0) AS a, greatest(bid_volume1 - 9, 0) AS bv, greatest(ask_volume1 - 9, 0) AS av, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY datetime_ns, row_hash) AS n FROM t),
o AS (SELECT *, side, lv, CASE side WHEN 'bid' THEN b - lv ELSE a + lv END AS price, CASE side WHEN 'bid' THEN bv ELSE av END * (1 + lv) AS queue FROM q, (VALUES ('bid'), ('ask')) s(side), (VALUES (0), (1)) l(lv)),
h AS (SELECT o.symbol, o.row_hash, o.side, o.lv, o.price, o.queue, min(q.n - o.n) AS k FROM o LEFT JOIN q ON q.symbol = o.symbol AND q.trading_day = o.trading_day AND q.n > o.n AND q.n <= o.n + 500 AND CASE o.side WHEN 'bid' THEN q.a <= o.price ELSE q.b >= o.price END GROUP BY ALL)"""


@query(_FILLS + " SELECT symbol, row_hash, side, lv::INT AS price_level, price AS order_price, queue AS queue_position, CASE WHEN k <= 10 THEN k END AS time_to_fill_10, coalesce(k <= 50, false)::INT AS fill_prob_50, coalesce(k <= 100, false)::INT AS fill_prob_100, k AS time_to_fill_500 FROM h")
def j9_fill_build(spark: SparkSession, sf: str) -> DataFrame:
    t = _with_hash(spark, sf).withColumns({c: F.col(c) - 9 for c in ("bid_volume1", "ask_volume1")})  # some volumes below 0
    rows, _ = builds.fill_build(t)
    return rows.select("symbol", "row_hash", "side", "price_level", "order_price", "queue_position", "time_to_fill_10", "fill_prob_50", "fill_prob_100", "time_to_fill_500")


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    names = ticks_from_events(spark, sf).select("symbol", "segment_id").distinct()
    version = (F.col("segment_id") + 1).cast("int")
    return names.select(F.col("symbol").alias("name"), version.alias("version"), F.when(F.col("segment_id") == 0, "2024-01-01").alias("deprecated_at"))


_REG = "rg AS (SELECT DISTINCT symbol AS name, (segment_id + 1)::INT AS version, CASE WHEN segment_id = 0 THEN '2024-01-01' END AS deprecated_at FROM t)"


@query(f"WITH {_REG}, dp AS (SELECT name, version, CASE WHEN name = 'click' AND version = 3 THEN '2024-02-01' ELSE deprecated_at END AS deprecated_at FROM rg) SELECT name, version, deprecated_at IS NULL AS active, version = max(version) FILTER (WHERE deprecated_at IS NULL) OVER (PARTITION BY name) AS newest FROM dp")
def i18_registry_reads(spark: SparkSession, sf: str) -> DataFrame:
    registry = builds.deprecate(_registry(spark, sf), "click", 3, "2024-02-01")
    every = builds.newest_definitions(registry).withColumn("newest", F.lit(True))
    out = builds.definitions(registry, active_only=False).join(every, ["name", "version"], "left")
    return out.select("name", "version", F.col("deprecated_at").isNull().alias("active"), F.coalesce("newest", F.lit(False)).alias("newest"))


@query(f"WITH {_REG} SELECT name, version FROM rg WHERE deprecated_at IS NULL AND version <> 2 UNION ALL SELECT name, 2 FROM (SELECT DISTINCT name FROM rg) UNION ALL SELECT name, 9 FROM (SELECT DISTINCT name FROM rg)")
def i19_synced_registry(spark: SparkSession, sf: str) -> DataFrame:
    stored = _registry(spark, sf)
    names = stored.select("name").distinct()
    local = names.select("name", F.explode(F.array(F.lit(2), F.lit(9))).alias("version"), F.lit(None).cast("string").alias("deprecated_at"))
    return builds.definitions(builds.synced_registry(stored, local)).select("name", "version")


_MODELS = "z AS (SELECT m AS model, row_hash % 3 AS l, CASE m WHEN 'a' THEN row_hash % 3 WHEN 'b' THEN (row_hash * 7 // 5) % 3 ELSE 1 END AS p FROM t, (VALUES ('a'), ('b'), ('c')) v(m))"


@query(f"""WITH {_MODELS}, k AS (SELECT model, c.c, count(*) FILTER (WHERE l = c.c) AS sup, count(*) FILTER (WHERE l = c.c AND p = c.c) AS hit, count(*) FILTER (WHERE p = c.c) AS said FROM z, (VALUES (0), (1), (2)) c(c) GROUP BY ALL),
f AS (SELECT model, sum(hit) / sum(sup) AS accuracy, avg(coalesce(2 * hit / nullif(sup + said, 0), 0)) AS f1 FROM k GROUP BY 1) SELECT model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1_macro, row_number() OVER (ORDER BY f1 DESC, model)::INT AS rank FROM f""")
def k10_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("row_hash")
    rows = ticks_from_events(spark, sf).withColumn("model", F.explode(F.array(*[F.lit(m) for m in "abc"])))
    said = F.when(F.col("model") == "a", i % 3).when(F.col("model") == "b", F.expr("(row_hash * 7 div 5) % 3")).otherwise(1)
    out = builds.compare_models(rows.select("model", (i % 3).alias("label"), said.alias("prediction")), "label")
    return out.select("model", r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"), "rank")


@query(f"""WITH {PATH}, n AS (SELECT symbol, count(*) AS n, max(trading_day) AS d FROM t GROUP BY 1), hit AS (SELECT symbol, avg((row_hash % 3 = (row_hash * 7 // 5) % 3)::INT) AS acc FROM t GROUP BY 1)
SELECT symbol, 'features' AS step, n AS n_rows, 'built' AS state FROM n UNION ALL SELECT symbol, 'labels', n, 'built' FROM n UNION ALL SELECT symbol, 'regime', count(DISTINCT trading_day), CASE WHEN day(max(trading_day)) % 2 = 0 THEN 'quiet' ELSE 'volatile' END FROM t GROUP BY 1
UNION ALL SELECT symbol, 'evaluation', n, CASE WHEN acc > 1 / 3 THEN 'better_than_chance' ELSE 'not_better' END FROM n JOIN hit USING (symbol) UNION ALL SELECT symbol, 'promotion', count(*) FILTER (WHERE traded > 0), CASE WHEN count(*) FILTER (WHERE traded > 0) < 10 THEN 'held: trades' ELSE 'promoted' END FROM eq GROUP BY 1""")
def k17_daily_chain(spark: SparkSession, sf: str) -> DataFrame:
    t = _with_hash(spark, sf)
    regime = t.select("symbol", "trading_day").distinct().withColumn("regime", F.when(F.dayofmonth("trading_day") % 2 == 0, "quiet").otherwise("volatile"))
    scored = q._scored(spark, sf).withColumnRenamed("p", "prediction")
    report = evaluation.strategy_report(q._path(spark, sf))
    return builds.daily_chain(t, regime, scored, report, "l", ["spread"], min_sharpe=-1e9, max_drawdown=1e9, min_trades=10, min_pnl=-1e18)


@query(f"WITH {ORD}, x AS (SELECT symbol, row_hash, mid, ask_price1 - bid_price1 AS spread, CASE WHEN lag(o, 1) OVER {W} >= o - 1 THEN lag(mid, 1) OVER {W} END AS mid_lag_1 FROM d) SELECT symbol, row_hash, mid_lag_1, mid - mid_lag_1 AS mid_diff_1, mid * spread AS mid_x_spread, round(mid / nullif(spread, 0), 6) AS mid_per_spread FROM x")
def o7_generated_features(spark: SparkSession, sf: str) -> DataFrame:
    out = features.generated(ticks_from_events(spark, sf), ["mid", "spread"], (1,))
    return out.select("symbol", "row_hash", "mid_lag_1", "mid_diff_1", "mid_x_spread", r6("mid_per_spread").alias("mid_per_spread"))


# helpers --------------------------------------------------------------------
@query("WITH x AS (SELECT symbol, trading_day, make_timestamp(datetime_ns // 1000) + INTERVAL 8 HOUR AS l FROM t) SELECT symbol, CASE WHEN hour(l) >= 18 THEN l::DATE + 1 ELSE l::DATE END AS trading_day, count(*) AS n FROM x GROUP BY ALL")
def c4_trading_day_without_calendar(spark: SparkSession, sf: str) -> DataFrame:
    out = calendars.trading_day(ticks_from_events(spark, sf).drop("trading_day"), F.col("datetime_ns"), None)
    return out.groupBy("symbol", "trading_day").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT trading_day::VARCHAR AS day, trading_day::VARCHAR AS from_seconds, trading_day::VARCHAR AS from_digits FROM t")
def b19_any_dates(spark: SparkSession, sf: str) -> DataFrame:
    days = ticks_from_events(spark, sf).select("trading_day").distinct()
    seconds = F.unix_timestamp(F.col("trading_day").cast("timestamp")) + 3600
    return days.select(F.col("trading_day").cast("string").alias("day"), scalars.any_date(seconds).alias("from_seconds"), scalars.any_date(F.date_format("trading_day", "yyyyMMdd")).alias("from_digits"))


@query("WITH s AS (SELECT DISTINCT underlying_contract AS c FROM t) SELECT c AS symbol, regexp_replace(c, '[0-9]+$', '') AS prefix, regexp_extract(c, '([0-9]+)$', 1)::BIGINT AS number FROM s")
def b5_sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    prefix, number = scalars.symbol_order(F.col("symbol"))
    return ticks_from_events(spark, sf).select(F.col("underlying_contract").alias("symbol")).distinct().select("symbol", prefix.alias("prefix"), number.alias("number"))


@query("SELECT DISTINCT symbol AS name, substr(sha256('{\"inputs\":[\"bid\",\"ask\"],\"name\":\"' || symbol || '\"}'), 1, 16) AS hash FROM t")
def b16_definition_hashes(spark: SparkSession, sf: str) -> DataFrame:
    names = ticks_from_events(spark, sf).select(F.col("symbol").alias("name")).distinct()
    return names.select("name", scalars.definition_hash(F.struct(F.array(F.lit("bid"), F.lit("ask")).alias("inputs"), F.col("name"))).alias("hash"))


@query(f"WITH {_PLAN}, l AS (SELECT day::VARCHAR || ',' || contract || ',' || segment_id AS x FROM pl WHERE symbol = 'click') SELECT substr(sha256(string_agg(x, chr(10) ORDER BY x)), 1, 16) AS hash FROM l")
def d5_schedule_hash(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule_hash(_plan(ticks_from_events(spark, sf)).filter("symbol = 'click'"))


@query(f"WITH {q.SCORED}, s AS (SELECT symbol, l AS class, count(*) AS support, avg((l = p)::INT) AS recall FROM z GROUP BY ALL), p AS (SELECT symbol, p AS class, avg((l = p)::INT) AS precision FROM z GROUP BY ALL) SELECT symbol, class, support, round(recall, 6) AS recall, round(coalesce(precision, 0), 6) AS precision FROM s LEFT JOIN p USING (symbol, class)")
def k7_class_recall(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.class_recall(q._scored(spark, sf), ["symbol"], "l", "p")
    return out.select("symbol", "class", "support", r6("recall").alias("recall"), r6("precision").alias("precision"))


_PROBS = "pb AS (SELECT symbol, hour(make_timestamp(datetime_ns // 1000)) AS hour, row_hash % 3 AS l, 0.5 AS p0, (row_hash % 5) / 10.0 AS p1, 0.5 - (row_hash % 5) / 10.0 AS p2 FROM t)"


def _probabilities(spark: SparkSession, sf: str) -> DataFrame:
    p1 = (F.col("row_hash") % 5) / F.lit(10.0)
    hour = F.hour(F.timestamp_micros(F.expr("datetime_ns div 1000")))
    return ticks_from_events(spark, sf).select("symbol", hour.alias("hour"), (F.col("row_hash") % 3).alias("l"), F.lit(0.5).alias("p0"), p1.alias("p1"), (0.5 - p1).alias("p2"))


@query(f"WITH {_PROBS} SELECT symbol, hour, count(*) AS n, round(avg(pow(p0 - (l = 0)::INT, 2) + pow(p1 - (l = 1)::INT, 2) + pow(p2 - (l = 2)::INT, 2)), 6) AS brier FROM pb GROUP BY ALL")
def o6_brier_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.brier_score(_probabilities(spark, sf), ["symbol", "hour"], "l", ["p0", "p1", "p2"])
    return out.select("symbol", "hour", "n", r6("brier").alias("brier"))


@query(f"WITH {_PROBS} SELECT symbol, round(avg(-ln(greatest(1e-10, CASE l WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END))), 6) AS log_loss FROM pb GROUP BY 1")
def k7_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probabilities(spark, sf).withColumn("prediction", F.lit(0))
    return evaluation.classification_metrics(rows, ["symbol"], "l", "prediction", ["p0", "p1", "p2"]).select("symbol", r6("log_loss").alias("log_loss"))


@query(f"WITH {q.SCORED}, a AS (SELECT symbol, avg((l = p)::INT) AS acc FROM z GROUP BY 1) SELECT round(avg(acc), 6) AS accuracy_mean, round(stddev_pop(acc), 6) AS accuracy_std FROM a")
def k9_over_splits(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluation.classification_metrics(q._scored(spark, sf), ["symbol"], "l", "p").withColumn("model", F.lit("m"))
    return evaluation.over_splits(metrics, ["model"], ["accuracy"]).select(r6("accuracy_mean").alias("accuracy_mean"), r6("accuracy_std").alias("accuracy_std"))


@query("WITH b AS (SELECT symbol, datetime_ns // 3600000000000 AS h, avg(last_price) AS p FROM t GROUP BY ALL), w(a, b, k) AS (VALUES ('click', 'view', 0), ('click', 'view', 1), ('view', 'click', 2)) SELECT w.a, w.b, k::INT AS lag, count(*) AS n, round(corr(x.p, y.p), 6) AS corr FROM w JOIN b x ON x.symbol = w.a JOIN b y ON y.symbol = w.b AND y.h = x.h + k GROUP BY ALL")
def o8_lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([("click", "view", 0), ("click", "view", 1), ("view", "click", 2)], "a string, b string, lag int")
    return extras.lead_lag(ticks_from_events(spark, sf), wanted, 3_600_000_000_000)


@query("WITH s AS (SELECT DISTINCT symbol, underlying_contract AS c FROM t), n AS (SELECT 'KQ.m@SHFE.' || symbol AS name, true AS alias, symbol AS variety FROM s UNION SELECT c, false, regexp_extract(c, '[.]([A-Za-z]+)', 1) FROM s) SELECT name, alias, 'SHFE' AS exchange, variety FROM n")
def b2_continuous_aliases(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    names = t.select(F.concat(F.lit("KQ.m@SHFE."), "symbol").alias("name")).union(t.select("underlying_contract")).distinct()
    return names.select("name", scalars.is_continuous(F.col("name")).alias("alias"), scalars.exchange_and_variety(F.col("name")).alias("e")).select("name", "alias", "e.exchange", "e.variety")


@query("SELECT DISTINCT trading_day, CASE WHEN day(trading_day) BETWEEN 5 AND 12 THEN 1 ELSE 0 END AS active FROM t WHERE day(trading_day) BETWEEN 5 AND 12")
def c10_events_of_days(spark: SparkSession, sf: str) -> DataFrame:
    days = ticks_from_events(spark, sf).select("trading_day").distinct()
    events = days.select(F.lit("2024-01-05").cast("date").alias("start_day"), F.lit("2024-01-12").cast("date").alias("end_day")).distinct()
    return days.join(calendars.events_for_day(events, "2024-01-07"), F.col("trading_day").between(F.col("start_day"), F.col("end_day"))).select("trading_day", F.lit(1).alias("active"))


@query("SELECT symbol, trading_day, count(*) AS n, count(*) FILTER (WHERE last_price IS NULL) AS no_price, count(DISTINCT segment_id) AS segments FROM t GROUP BY ALL")
def e2_stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    stored = schedule.stored_ticks(_with_hash(spark, sf), F.col("symbol"))
    return stored.groupBy("symbol", "trading_day").agg(F.count("*").alias("n"), F.count_if(F.col("last_price").isNull()).alias("no_price"), F.count_distinct("segment_id").alias("segments"))


# inputs on which the results differ by row ------------------------------------
@query("SELECT DISTINCT 'SHFE.' || v AS symbol, CASE v WHEN 'cu2401' THEN 10 WHEN 'au2402' THEN 0.02 ELSE 1 END::DOUBLE AS tick FROM (SELECT (CASE segment_id WHEN 0 THEN 'cu' WHEN 1 THEN 'au' ELSE 'ag' END) || '240' || (segment_id + 1) AS v FROM t)")
def b3_price_ticks(spark: SparkSession, sf: str) -> DataFrame:
    variety = F.when(F.col("segment_id") == 0, "cu").when(F.col("segment_id") == 1, "au").otherwise("ag")
    names = ticks_from_events(spark, sf).select(F.concat(F.lit("SHFE."), variety, F.lit("240"), (F.col("segment_id") + 1).cast("string")).alias("symbol")).distinct()
    return names.select("symbol", scalars.price_tick(F.col("symbol")).alias("tick"))


@query(f"""WITH {_PLAN}, b AS (SELECT symbol, day, CASE WHEN day(day) % 5 = 0 THEN 'other' ELSE contract END AS contract, CASE WHEN day(day) % 7 = 0 THEN 9 ELSE segment_id END AS segment_id FROM pl WHERE day(day) % 11 <> 0)
SELECT symbol, count(*) FILTER (WHERE day(pl.day) % 11 = 0) AS only_stored, 0::BIGINT AS only_expected, count(*) FILTER (WHERE b.contract = 'other') AS other_contract, count(*) FILTER (WHERE b.segment_id = 9) AS other_segment FROM pl LEFT JOIN b USING (symbol, day) GROUP BY symbol""")
def d7_d11_changed_schedule(spark: SparkSession, sf: str) -> DataFrame:
    stored = _plan(ticks_from_events(spark, sf))
    d = F.dayofmonth("day")
    changed = stored.filter(d % 11 != 0).withColumn("contract", F.when(d % 5 == 0, "other").otherwise(F.col("contract"))).withColumn("segment_id", F.when(d % 7 == 0, 9).otherwise(F.col("segment_id")))
    return schedule.schedule_difference(stored, changed)


@query(f"""WITH {_PLAN}, m AS (SELECT symbol, count(*) FILTER (WHERE day(day) % 9 = 0) AS provider, count(*) FILTER (WHERE symbol = 'click' AND day(day) % 9 = 1) AS engineering FROM pl GROUP BY 1), h AS (SELECT symbol, CASE WHEN symbol = 'view' THEN count(DISTINCT segment_id) ELSE 1 END AS n_hashes FROM pl GROUP BY 1)
SELECT symbol, n_hashes, provider, engineering, engineering = 0 AND provider <= 4 AND n_hashes = 1 AS healthy FROM h JOIN m USING (symbol)""")
def d12_e9_health_of_mixed_hashes(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(ticks_from_events(spark, sf))
    d = F.dayofmonth("day") % 9
    cause = F.when(d == 0, "provider").when((F.col("symbol") == "click") & (d == 1), "engineering")
    missing = plan.select("symbol", "day", cause.alias("cause")).filter("cause is not null")
    hashes = plan.groupBy("symbol").agg(F.count_distinct(F.when(F.col("symbol") == "view", F.col("segment_id")).otherwise(0)).alias("n_hashes"))
    return schedule.health(missing, hashes, 4).select("symbol", "n_hashes", "provider", "engineering", "healthy")


@query(f"""WITH sch AS (SELECT symbol, trading_day AS day, max(underlying_contract) AS contract FROM (SELECT symbol, trading_day + 2 AS trading_day, underlying_contract FROM t) GROUP BY ALL)
SELECT t.symbol, count(*) AS n, min(t.trading_day) AS first_day, count(DISTINCT t.trading_day) AS days FROM t JOIN sch ON sch.symbol = t.symbol AND sch.day = t.trading_day AND sch.contract = t.underlying_contract WHERE {DEEP} GROUP BY 1""")
def e1_splice_of_a_late_schedule(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    late = t.select("symbol", F.date_add("trading_day", 2).alias("day"), "underlying_contract").groupBy("symbol", "day").agg(F.max("underlying_contract").alias("contract"))
    plan = schedule.with_segments(late, "symbol", "day", "contract")
    out = schedule.splice(t.drop("segment_id"), plan)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.min("trading_day").alias("first_day"), F.count_distinct("trading_day").alias("days"))


@query("SELECT symbol, trading_day, max(row_hash) AS row_hash, arg_max(last_price + CASE WHEN day(trading_day) % 2 = 0 THEN 1 ELSE 0 END, row_hash) AS last_price FROM t GROUP BY symbol, trading_day")
def a5_upserted_table(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_root(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    rows = ticks_from_events(spark, sf).select("symbol", "trading_day", "row_hash", "last_price")
    upsert(spark, path, rows, ["symbol", "trading_day"], "row_hash")
    # a correction of the even days: the same versions with a greater price win
    even = rows.filter(F.dayofmonth("trading_day") % 2 == 0).withColumn("last_price", F.col("last_price") + 1)
    upsert(spark, path, even, ["symbol", "trading_day"], "row_hash")
    return spark.read.parquet(path).select("symbol", "trading_day", "row_hash", "last_price")
