"""Queries of stored tables: reads with fallbacks, the day worker's rows, schedule and coverage checks, ledgers, boards and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import scalars
from tickweave.operators import builds, evaluation, extras, features, ledgers, quality, schedule, validation
from tickweave.plans import queries as q
from tickweave.plans.ledgers import _PLAN, _top, _with_hash
from tickweave.plans.ledgers import _plan as plan_of
from tickweave.plans.queries import DAYSUM, DEEP, ORD, TOTALS, W, query, r6
from tickweave.plans.values import TYPES
from tickweave.sources import ticks as T
from tickweave.sources.ticks import shared_root, ticks_from_events
from tickweave.streaming import incremental, online


@query("SELECT * EXCLUDE (segment_id, underlying_contract) FROM t WHERE symbol = 'click' AND trading_day = DATE '2024-01-12'")
def a4_ticks_without_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return T.ticks_for_day(ticks_from_events(spark, sf), "click", "2024-01-12", provenance=False)


@query("SELECT datetime_ns, last_price, 0::BIGINT AS row_hash, true AS unknown FROM t WHERE symbol = 'view' AND trading_day = DATE '2024-01-15'")
def a4_ticks_of_old_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table without row hashes and provenance."""
    old = ticks_from_events(spark, sf).drop("row_hash", "segment_id", "underlying_contract")
    unknown = F.col("segment_id").isNull() & F.col("underlying_contract").isNull() & F.col("schedule_hash").isNull()
    return T.ticks_for_day(old, "view", "2024-01-15").select("datetime_ns", "last_price", "row_hash", unknown.alias("unknown"))


@query("SELECT * EXCLUDE (n, segment_id, underlying_contract) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY datetime_ns DESC, row_hash DESC) AS n FROM t) WHERE n <= 2 ORDER BY symbol, datetime_ns DESC, row_hash DESC LIMIT 200")
def a8_export_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The two newest rows of each day, 200 in all, without provenance."""
    return T.export_rows(ticks_from_events(spark, sf), per_day=2, limit=200, provenance=False, descending=True)


@query(f"SELECT 'run' AS run_id, '2024-02-01' AS created_at, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, min(trading_day) AS start_day, max(trading_day) AS end_day, count(DISTINCT trading_day) AS days, substr(sha256('{TYPES}'), 1, 16) AS schema_hash, 'xxhash64_v1' AS hash_algorithm FROM t")
def a9_manifest_record(spark: SparkSession, sf: str) -> DataFrame:
    found = ledgers.ingest_manifest(ticks_from_events(spark, sf), "run", "2024-02-01")
    return found.select("run_id", "created_at", F.array_join("symbols", ",").alias("symbols"), "start_day", "end_day", F.size("row_counts").cast("long").alias("days"), "schema_hash", "hash_algorithm")


@query("SELECT symbol, row_hash, last_price AS price, true AS added FROM t")
def a15_applied_schema(spark: SparkSession, sf: str) -> DataFrame:
    """A planned rename, and a column that the table lacks."""
    out = T.apply_schema(ticks_from_events(spark, sf), ["symbol", "row_hash", "price", "amount"], {"last_price": "price", "gone": "amount"})
    return out.select("symbol", "row_hash", "price", F.col("amount").isNull().alias("added"))


# the day worker ---------------------------------------------------------------
# Two days of three have windows; of one the second after midnight alone, which no day's ticks need hold.
_FETCHED = f"""wi AS (SELECT trading_day AS day, epoch(trading_day)::BIGINT + a AS start_s, epoch(trading_day)::BIGINT + b AS end_s FROM (SELECT DISTINCT trading_day FROM t), (VALUES (1, 32400, 41400), (1, 48600, 54000), (1, 75600, 86399), (2, 1, 1)) v(k, a, b) WHERE day(trading_day) % 3 = k),
fe AS (SELECT symbol, trading_day, row_hash, {DEEP} AND day(trading_day) <> 21 AS deep, datetime_ns // 1000000000 AS sec, make_timestamp(datetime_ns // 1000) + INTERVAL 8 HOUR AS l FROM t),
da AS (SELECT fe.*, day(trading_day) % 3 <> 0 AS has, CASE WHEN day(trading_day) % 3 <> 0 THEN EXISTS (SELECT 1 FROM wi WHERE day = trading_day AND sec BETWEEN start_s AND end_s) ELSE l::DATE + CASE WHEN hour(l) >= 18 THEN 1 ELSE 0 END = trading_day END AS near FROM fe)"""


def _day_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = ticks_from_events(spark, sf)
    shallow = [F.when(F.dayofmonth("trading_day") == 21, 0.0).otherwise(F.col(c)).alias(c) if c in T.BOOK and not c.endswith("1") else F.col(c) for c in t.columns]
    base, k = F.unix_timestamp(F.col("trading_day").cast("timestamp")), F.dayofmonth("trading_day") % 3
    spans = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), (base + a).alias("start_s"), (base + b).alias("end_s")) for n, a, b in ((1, 32400, 41400), (1, 48600, 54000), (1, 75600, 86399), (2, 1, 1))]), lambda w: w["k"] == k)
    windows = t.select("trading_day").distinct().select(F.col("trading_day").alias("day"), F.inline(spans)).drop("k")
    return ledgers.day_rows(t.select(*shallow), windows)


@query(f"WITH {_FETCHED} SELECT symbol, trading_day, row_hash, true AS amount_missing FROM da WHERE deep AND near")
def c11_e3_day_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _day_rows(spark, sf)[0].select("symbol", "trading_day", "row_hash", F.col("amount").isNull().alias("amount_missing"))


@query(f"WITH {_FETCHED}, co AS (SELECT symbol, trading_day, count(*) AS fetched, count(*) FILTER (WHERE deep) AS depth, count(*) FILTER (WHERE deep AND near) AS stored, bool_or(has) AS has FROM da GROUP BY ALL) SELECT symbol, trading_day, fetched, depth, stored, CASE WHEN stored > 0 THEN NULL WHEN depth = 0 THEN 'no_depth' WHEN has THEN 'outside_sessions' ELSE 'other_day' END AS reason FROM co")
def e3_day_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _day_rows(spark, sf)[1]


# schedule -----------------------------------------------------------------------
_HASHED = f"{_PLAN}, ha AS (SELECT *, CASE WHEN symbol = 'view' AND segment_id = 2 THEN 'h2' WHEN symbol = 'click' AND segment_id = 0 THEN ' ' ELSE 'h1' END AS schedule_hash FROM pl)"


def _hashed_plan(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when((F.col("symbol") == "view") & (F.col("segment_id") == 2), "h2").when((F.col("symbol") == "click") & (F.col("segment_id") == 0), " ").otherwise("h1")
    return plan_of(ticks_from_events(spark, sf)).withColumn("schedule_hash", name)


@query(f"WITH {_HASHED} SELECT symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS days, string_agg(DISTINCT schedule_hash, ',' ORDER BY schedule_hash) FILTER (WHERE trim(schedule_hash) <> '') AS hashes FROM ha GROUP BY symbol")
def d6_stored_schedule_state(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.stored_schedule_state(_hashed_plan(spark, sf)).withColumn("hashes", F.array_join("hashes", ","))


@query(f"""WITH {_HASHED}, st AS (SELECT symbol, CASE WHEN symbol = 'signup' AND day = DATE '2024-01-05' THEN DATE '2024-03-05' ELSE day END AS day, CASE WHEN symbol = 'purchase' AND day = DATE '2024-01-05' THEN 'other' ELSE contract END AS contract, schedule_hash FROM ha WHERE NOT (symbol = 'error' AND day > DATE '2024-01-25')),
ex AS (SELECT symbol, count(*) AS expected_rows FROM pl GROUP BY 1), sr AS (SELECT symbol, count(*) AS stored_rows, string_agg(DISTINCT schedule_hash, ',' ORDER BY schedule_hash) FILTER (WHERE trim(schedule_hash) <> '') AS hashes, count(*) FILTER (WHERE contract = 'other') AS wrong, count(*) FILTER (WHERE day > DATE '2024-02-01') AS moved FROM st GROUP BY 1)
SELECT symbol, expected_rows, stored_rows, hashes, CASE WHEN stored_rows <> expected_rows THEN 'rows' WHEN moved > 0 THEN 'days' WHEN wrong > 0 THEN 'contracts' WHEN hashes <> 'h1' THEN 'hashes' ELSE 'ok' END AS state FROM ex JOIN sr USING (symbol)""")
def d11_schedule_health(spark: SparkSession, sf: str) -> DataFrame:
    """A stored schedule that lacks days of one symbol, has a moved day of another, another contract of a third, two hashes of a fourth."""
    expected = plan_of(ticks_from_events(spark, sf)).withColumn("schedule_hash", F.lit("h1"))
    fifth = F.col("day") == F.lit("2024-01-05").cast("date")
    stored = _hashed_plan(spark, sf).filter(~((F.col("symbol") == "error") & (F.col("day") > F.lit("2024-01-25").cast("date"))))
    stored = stored.withColumn("contract", F.when((F.col("symbol") == "purchase") & fifth, "other").otherwise(F.col("contract"))).withColumn("day", F.when((F.col("symbol") == "signup") & fifth, F.lit("2024-03-05").cast("date")).otherwise(F.col("day")))
    return schedule.schedule_health(stored, expected).withColumn("hashes", F.array_join("hashes", ","))


@query(f"""WITH {TOTALS}, dy AS (SELECT DISTINCT symbol, trading_day AS day FROM t), mi AS (SELECT symbol, count(*) FILTER (WHERE day(day) = 14) AS provider, count(*) FILTER (WHERE day(day) = 21 AND symbol = 'view') AS engineering FROM dy GROUP BY 1)
SELECT symbol, CASE WHEN symbol = 'click' THEN 2 ELSE 1 END::BIGINT AS n_hashes, provider, engineering, va.v AS validation, va.v <> 'error' AND engineering = 0 AND provider <= 1 AND symbol <> 'click' AS healthy
FROM mi JOIN (SELECT symbol, CASE WHEN gap_gt_30 > 100 OR missing_days > 5 THEN 'error' WHEN outside_seconds > 0 OR missing_days > 0 THEN 'warn' ELSE 'ok' END AS v FROM tt) va USING (symbol)""")
def e9_health_with_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The gate with the states of validation: one symbol has two hashes, one an engineering gap."""
    days = plan_of(ticks_from_events(spark, sf))
    hit = (F.dayofmonth("day") == 14) | ((F.dayofmonth("day") == 21) & (F.col("symbol") == "view"))
    gone = schedule.missing_days(days, days.filter(~hit).select("symbol", "day"), days.select("symbol", "day", F.when(F.dayofmonth("day") == 14, 0).otherwise(5).alias("n_rows")))
    hashes = days.groupBy("symbol").agg(F.max(F.when(F.col("symbol") == "click", 2).otherwise(1)).cast("long").alias("n_hashes"))
    states = validation.states(validation.run_totals(q._summary(spark, sf)), gap_block=100, outside_block=10**9, half_block=2.0, half_info=2.0, tolerance=5)
    return schedule.health(gone, hashes, 1, states)


# coverage -------------------------------------------------------------------------
@query(f"""WITH k AS (SELECT underlying_contract AS contract, max(trading_day) AS last_tick_day, max(datetime_ns) AS last_tick_ns FROM t GROUP BY 1), s AS (SELECT underlying_contract AS contract, max(trading_day) AS last_depth_day, max(datetime_ns) AS last_depth_ns FROM t WHERE {DEEP} AND symbol <> 'view' GROUP BY 1)
SELECT contract, last_tick_day::VARCHAR AS last_tick_day, last_tick_ns, last_depth_day::VARCHAR AS last_depth_day, last_depth_ns FROM k LEFT JOIN s USING (contract)""")
def f7_last_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Last days and times of all contracts and of one without ticks, depth from a stored series that lacks one symbol."""
    t = ticks_from_events(spark, sf)
    wanted = t.select(F.col("underlying_contract").alias("contract")).distinct().union(spark.sql("SELECT 'SHFE.none2401'"))
    found = schedule.coverage(wanted, t, t.filter(T.has_depth()).filter("symbol <> 'view'"), last_only=True)
    return found.withColumns({c: F.col(c).cast("string") for c in ("last_tick_day", "last_depth_day")})


@query(f"SELECT underlying_contract AS contract, min(trading_day) AS first_tick_day, count(DISTINCT trading_day) AS tick_days, min(datetime_ns) AS first_tick_ns, max(trading_day) AS last_tick_day, max(datetime_ns) AS last_tick_ns, min(trading_day) FILTER (WHERE {DEEP}) AS first_depth_day, count(DISTINCT trading_day) FILTER (WHERE {DEEP}) AS depth_days, min(datetime_ns) FILTER (WHERE {DEEP}) AS first_depth_ns, max(trading_day) FILTER (WHERE {DEEP}) AS last_depth_day, max(datetime_ns) FILTER (WHERE {DEEP}) AS last_depth_ns FROM t GROUP BY 1")
def f7_coverage_without_series(spark: SparkSession, sf: str) -> DataFrame:
    """All bounds; the series is empty, so that the ticks' own depth counts."""
    t = ticks_from_events(spark, sf)
    return schedule.coverage(t.select(F.col("underlying_contract").alias("contract")), t, t.filter("false"))


@query("SELECT v AS variety, count(DISTINCT symbol) FILTER (WHERE starts_with(symbol, v)) AS symbols, CASE WHEN v = 'vi' OR v = 'zz' THEN 'ticks' ELSE 'rollup' END AS origin FROM t, (VALUES ('cl'), ('er'), ('vi'), ('zz')) x(v) GROUP BY 1")
def f8_symbols_by_variety(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup lacks one variety; another has no symbols at all."""
    t = ticks_from_events(spark, sf).withColumn("symbol", F.concat(F.lit("KQ.m@SHFE."), "symbol"))
    rollup = schedule.daily_aggregate(t.filter("symbol <> 'KQ.m@SHFE.view'"))
    return schedule.symbols_by_variety(rollup, t, ["cl", "er", "VI ", "zz"])


# ledgers, reports, boards -----------------------------------------------------------
def _summary_of_schedules(spark: SparkSession, sf: str) -> DataFrame:
    return q._summary(spark, sf).withColumn("schedule_hash", F.when(F.dayofmonth("trading_day") <= 20, "h1").otherwise("h2"))


@query(f"WITH {DAYSUM} SELECT symbol, trading_day, rank::INT AS rank, max_gap_s, 'h1' AS schedule_hash FROM ({_top('ds', 'max_gap_s DESC, missing_segments DESC, trading_day DESC', 6, 'max_gap_s > 0 AND day(trading_day) <= 20')})")
def g28_gap_days_of_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.top_gap_days(_summary_of_schedules(spark, sf), 6, "h1").select("symbol", "trading_day", "rank", "max_gap_s", "schedule_hash")


@query(f"WITH {DAYSUM} SELECT symbol, trading_day, rank::INT AS rank, strict_seconds AS expected_min, max_gap_s * 1000 AS max_interval_ms, gap_2_5 + gap_6_15 + gap_16_30 AS abnormal_gaps, gap_gt_30 AS critical_gaps FROM ({_top('ds', 'trading_day DESC', 12, 'day(trading_day) % 4 <> 0')})")
def g28_tick_gap_list(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger also holds days of another kind."""
    kind = F.when(F.dayofmonth("trading_day") % 4 == 0, "raw").otherwise("main_l5")
    ledger = validation.tick_gap_ledger(q._summary(spark, sf)).withColumns({"ticks_kind": kind, "dataset_version": F.lit("v2")})
    return ledgers.list_tick_gaps(ledger, n=12).select("symbol", "trading_day", "rank", "expected_min", "max_interval_ms", "abnormal_gaps", "critical_gaps")


@query(f"WITH {DAYSUM} SELECT 'SHFE' AS exchange, substr(symbol, 1, 2) AS variety, symbol, max(trading_day) AS created_at, arg_max(missing_segments, trading_day) AS missing_segments FROM ds GROUP BY symbol")
def g31_latest_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each day, by turns under names in another case; the newest of each symbol is read."""
    odd = F.dayofmonth("trading_day") % 2 == 1
    reports = q._summary(spark, sf).select(
        F.when(odd, "shfe ").otherwise("SHFE").alias("exchange"), F.when(odd, F.upper(F.substring("symbol", 1, 2))).otherwise(F.substring("symbol", 1, 2)).alias("variety"), "symbol", F.col("trading_day").alias("created_at"), F.to_json(F.struct("missing_segments", "max_gap_s")).alias("report"),
    )
    found = ledgers.latest_reports(reports, " shfe")
    return found.select("exchange", "variety", "symbol", "created_at", F.get_json_object("report", "$.missing_segments").cast("long").alias("missing_segments"))


_BOARD = f"""{DAYSUM}, fq AS (SELECT symbol, trading_day, (avg((bid_price1 IS NULL)::INT)) AS nb, max(datetime_ns) AS last_ns FROM t GROUP BY ALL), fl AS (SELECT symbol, max(trading_day) AS field_day, arg_max(nb, trading_day) AS nb, max(last_ns) AS last_ns FROM fq GROUP BY 1),
gl AS (SELECT symbol, max(trading_day) AS gap_day, arg_max(gap_2_5 + gap_6_15 + gap_16_30, trading_day) AS abnormal_gaps, arg_max(gap_gt_30, trading_day) AS critical_gaps FROM ds WHERE symbol <> 'signup' GROUP BY 1),
bo AS (SELECT symbol, symbol = 'error' AS expired, symbol <> 'view' AS complete, (1706745600000000000 - last_ns) / 1e9 AS age_s, field_day, gap_day, nb, coalesce(abnormal_gaps, 0) + coalesce(critical_gaps, 0) AS anomalies, round((1 - nb / 5) * 100, 2) AS score FROM fl LEFT JOIN gl USING (symbol))"""


def _board(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts from the rollup's last ticks; the gap ledger lacks one symbol."""
    t = ticks_from_events(spark, sf)
    age = ((F.lit(1_706_745_600_000_000_000) - F.max("last_ns")) / 1e9).alias("age_s")
    contracts = schedule.daily_aggregate(t).groupBy("symbol").agg(age).select("symbol", (F.col("symbol") == "error").alias("expired"), (F.col("symbol") != "view").alias("complete"), "age_s")
    gaps = validation.tick_gap_ledger(q._summary(spark, sf)).filter("symbol <> 'signup'")
    return quality.quality_board(contracts, quality.field_quality(t), gaps)


@query(f"WITH {_BOARD} SELECT symbol, field_day, gap_day::VARCHAR AS gap_day, anomalies, score, CASE WHEN nb > 0.01 THEN 'error' WHEN anomalies > 0 THEN 'warning' ELSE 'ok' END AS status FROM bo")
def h6_quality_board(spark: SparkSession, sf: str) -> DataFrame:
    return _board(spark, sf).select("symbol", "field_day", F.col("gap_day").cast("string").alias("gap_day"), "anomalies", "score", "status")


@query(f"WITH {_BOARD} SELECT count(*) AS symbols, round(100.0 * count(*) FILTER (WHERE complete) / count(*), 6) AS complete_pct, round(avg(score), 6) AS score_pct, sum(anomalies)::BIGINT AS anomalies, round(max(age_s) FILTER (WHERE NOT expired), 3) AS max_age_s FROM bo")
def h6_quality_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.quality_totals(_board(spark, sf))
    return out.select("symbols", r6("complete_pct").alias("complete_pct"), r6("score_pct").alias("score_pct"), "anomalies", F.round("max_age_s", 3).alias("max_age_s"))


_NULLS = " UNION ALL ".join(f"SELECT 'null_rate:{c}', avg(({c} IS NULL)::INT), avg(({c} IS NULL)::INT) <= 0.01 FROM t" for c in quality.CORE)


@query(f"""WITH r AS (SELECT 'rows' AS "check", count(*)::DOUBLE AS value, count(*) >= 32 AS passed FROM t UNION ALL SELECT 'missing_column:amount', 1.0, false UNION ALL SELECT 'extra_column:note', 1.0, true UNION ALL {_NULLS} UNION ALL SELECT 'null_rate:book', avg((bid_price1 IS NULL)::INT) / 20, avg((bid_price1 IS NULL)::INT) / 20 <= 0.05 FROM t
UNION ALL SELECT 'rows_without_hash', count(*) FILTER (WHERE row_hash % 13 = 0)::DOUBLE, count(*) FILTER (WHERE row_hash % 13 = 0) = 0 FROM t UNION ALL SELECT 'rows_with_another_hash', count(*) FILTER (WHERE row_hash % 13 = 1)::DOUBLE, count(*) FILTER (WHERE row_hash % 13 = 1) = 0 FROM t) SELECT "check", round(value, 6) AS value, passed FROM r""")
def h7_contract_report(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows with a column too few, one too many, missing hashes and changed ones."""
    raw = ticks_from_events(spark, sf)
    rows = T.with_missing_columns(raw).drop("amount").withColumn("note", F.lit("x"))
    full = rows.withColumn("amount", F.lit(None).cast("double")).withColumn("_id", F.col("row_hash"))
    anew = scalars.row_hash(F.col("datetime_ns"))
    hashed = full.withColumn("row_hash", F.when(F.col("_id") % 13 != 0, F.when(F.col("_id") % 13 == 1, anew + 1 - 2 * (anew > 0).cast("long")).otherwise(anew)))
    checks, _ = quality.contract_report(hashed.drop("amount", "_id"))
    return checks.select("check", r6("value").alias("value"), "passed")


# streams ------------------------------------------------------------------------
_FACTORS = f"""{q.ROLLING}, h AS (SELECT symbol, row_hash, ask_price1 - bid_price1 AS spread, mid, CASE WHEN bid_volume1 + ask_volume1 > 0 THEN (ask_price1 * bid_volume1 + bid_price1 * ask_volume1) / (bid_volume1 + ask_volume1) ELSE mid END AS microprice,
CASE WHEN bid_volume1 + ask_volume1 > 0 THEN (bid_volume1 - ask_volume1) / (bid_volume1 + ask_volume1) ELSE 0 END AS imbalance_1, CASE WHEN {q._BV} + {q._AV} > 0 THEN ({q._BV} - ({q._AV})) / ({q._BV} + {q._AV}) ELSE 0 END AS imbalance_total, CASE WHEN {q._BV} + {q._AV} > 0 THEN ({q._PV}) / ({q._BV} + {q._AV}) END AS depth_weighted_price,
CASE WHEN {q._WB} + {q._WA} > 0 THEN ({q._WB} - ({q._WA})) / ({q._WB} + {q._WA}) ELSE 0 END AS book_slope, return_10, volatility_20, volume - {q._lagged('volume', 10)} AS volume_delta_10, open_interest - {q._lagged('open_interest', 10)} AS oi_delta_10 FROM g)"""
_ROUNDED = ["microprice", "imbalance_1", "imbalance_total", "depth_weighted_price", "book_slope", "return_10", "volatility_20"]


@query(f"WITH {_FACTORS} SELECT symbol, row_hash, spread, mid, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}, volume_delta_10, oi_delta_10 FROM h")
def n1_stream_factors(spark: SparkSession, sf: str) -> DataFrame:
    """All registered factors tick by tick."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = T.ticks_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf}/events*.parquet"))
    out = online.run_to_end(incremental.incremental_factors(stream), q._stream_path(spark))
    return out.select("symbol", "row_hash", "spread", "mid", *[r6(c).alias(c) for c in _ROUNDED], "volume_delta_10", "oi_delta_10")


# builds and regimes -----------------------------------------------------------------
@query(f"WITH {ORD}, f AS (SELECT symbol, row_hash, mid, lead(o, 10) OVER {W} <= o + 1 AS there, lead(mid, 10) OVER {W} AS m2 FROM d), k AS (SELECT *, CASE WHEN symbol = 'view' THEN 1 ELSE 2 END AS k FROM f) SELECT symbol, row_hash, CASE WHEN symbol = 'view' THEN 'raw' ELSE 'main_l5' END AS kind, CASE WHEN there THEN CASE WHEN m2 - mid >= k THEN 2 WHEN m2 - mid <= -k THEN 0 ELSE 1 END END AS label_10 FROM k")
def j6_latest_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two builds of the preferred kind, of which the newer counts, and one of another kind, which serves one symbol alone."""
    t = _with_hash(spark, sf)
    parts = [builds.label_build(rows, (10,), k, kind=kind, created_at=at) for rows, k, kind, at in ((t.filter("symbol <> 'view'"), 3, "main_l5", "2024-02-01"), (t.filter("symbol <> 'view'"), 2, "main_l5", "2024-02-02"), (t, 1, "raw", "2024-02-03"))]
    rows, records = (parts[0][i].unionByName(parts[1][i]).unionByName(parts[2][i]) for i in (0, 1))
    found = features.read_latest_build(rows, records, "main_l5").join(records.select("symbol", "build_id", "kind"), ["symbol", "build_id"])
    return found.select("symbol", "row_hash", "kind", "label_10")


@query("SELECT symbol, trading_day, row_hash, CASE WHEN day(trading_day) > 20 THEN '2024-02-02' ELSE '2024-02-01' END AS created_at, count(*) AS n FROM t, (VALUES ('bid'), ('ask')) s(side) GROUP BY ALL")
def j9_merged_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Fills of all days and a later build of some of them: no key twice, the later rows stay."""
    rows, _ = builds.fill_build(_with_hash(spark, sf), (10,), (0,))
    at = lambda df, day: df.withColumn("created_at", F.lit(day))
    merged = builds.merge_fills(at(rows, "2024-02-01"), at(rows.filter(F.dayofmonth("trading_day") > 20), "2024-02-02"))
    return merged.groupBy("symbol", "trading_day", "row_hash", "created_at").agg(F.count("*").alias("n"))


@query("SELECT symbol, trading_day, count(DISTINCT c) AS configurations, max(CASE WHEN c = 2 THEN '2024-02-01' ELSE '2024-02-03' END) AS updated_at, true AS probable FROM (SELECT DISTINCT symbol, trading_day FROM t WHERE trading_day BETWEEN DATE '2024-01-28' - 20 AND DATE '2024-01-28'), (VALUES (2), (3)) v(c) WHERE trading_day > DATE '2024-01-18' GROUP BY 1, 2")
def l4_stored_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Regimes of the ten last days before a date, stored for two configurations, one of them twice."""
    t = ticks_from_events(spark, sf)
    chosen = ledgers.training_days(schedule.daily_aggregate(t), "2024-01-28", 20, 10)
    inputs = T.kept(evaluation.regime_inputs(t).join(chosen, ["symbol", "trading_day"], "left_semi"))
    path = f"{shared_root(spark).rstrip('/')}/regimes-{uuid.uuid4().hex}"
    states = {k: evaluation.regimes(inputs, k) for k in (2, 3)}
    for k, at in ((2, "2024-02-01"), (3, "2024-02-02"), (3, "2024-02-03")):
        ledgers.store_regimes(spark, path, ledgers.regime_rows(states[k], "mixture", f"k={k}", at))
    total = F.aggregate(F.from_json("probabilities", "array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).groupBy("symbol", "trading_day").agg(F.count("*").alias("configurations"), F.max("updated_at").alias("updated_at"), F.bool_and(F.abs(total - 1) < 1e-6).alias("probable"))


@query("""WITH f AS (SELECT symbol, trading_day, last_price - lag(last_price) OVER d AS jump, volume - lag(volume) OVER d AS v, ask_price1 - bid_price1 AS s, bid_price1, datetime_ns, row_hash FROM t WINDOW d AS (PARTITION BY symbol, trading_day ORDER BY datetime_ns, row_hash)),
g AS (SELECT *, stddev_samp(jump) OVER r AS sd, quantile_cont(v, 0.5) OVER r AS med, quantile_cont(s, 0.95) OVER (PARTITION BY symbol, trading_day) AS p95 FROM f WINDOW r AS (PARTITION BY symbol, trading_day ORDER BY datetime_ns, row_hash ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
o AS (SELECT symbol, trading_day, count(*) FILTER (sd > 0 AND abs(jump) > 5 * sd) AS price_jumps, count(*) FILTER (med > 0 AND v > 10 * med) AS volume_spikes, count(*) FILTER (p95 > 0 AND s > 3 * p95) AS wide_spreads, avg((bid_price1 IS NULL)::INT) AS nb FROM g GROUP BY ALL),
l AS (SELECT symbol, arg_max(price_jumps + volume_spikes + wide_spreads, trading_day) AS anomalies, arg_max(nb, trading_day) AS nb FROM o GROUP BY 1) SELECT symbol, anomalies, CASE WHEN nb > 0.01 THEN 'error' WHEN anomalies > 0 THEN 'warning' ELSE 'ok' END AS status FROM l""")
def h6_board_with_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Counted outliers in place of gaps, of which there is no ledger row."""
    t = ticks_from_events(spark, sf)
    none = spark.createDataFrame([], "symbol string, trading_day date, abnormal_gaps long, critical_gaps long, max_interval_ms long")
    board = quality.quality_board(t.select("symbol").distinct(), quality.field_quality(t), none, extras.outliers(t))
    return board.select("symbol", "anomalies", "status")
