"""Queries that compare values of sources, helpers, stored rows and builds, for all symbols."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import calendars, scalars
from tickweave.operators import builds, features, schedule
from tickweave.plans import ledgers
from tickweave.plans.queries import DEEP, ORD, W, _as_stream, query
from tickweave.sources import ticks as T
from tickweave.sources.ticks import shared_root, ticks_from_events
from tickweave.streaming import online

TYPES = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.TICK_SCHEMA).replace(", ", ",")


@query("SELECT 'run2' AS run_id, min(trading_day) AS start_day, max(trading_day) AS end_day, count(DISTINCT symbol) AS n_symbols FROM t WHERE segment_id = 1")
def a10_latest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of three segments, the newest of which lacks the symbol."""
    t = ticks_from_events(spark, sf)
    parts = [T.manifest(t.filter(f"segment_id = {k}" + " and symbol <> 'view'" * (k == 2)), f"run{k + 1}", f"2024-02-0{k + 1}") for k in range(3)]
    found = T.latest_manifest(reduce(DataFrame.unionByName, parts), "view")
    return found.select("run_id", "start_day", "end_day", F.size("symbols").cast("long").alias("n_symbols"))


@query("SELECT DISTINCT trading_day AS day FROM t WHERE day(trading_day) % 3 = 0")
def a11_holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Every third day as a holiday, in a JSON text of another shape for each segment."""
    days = ticks_from_events(spark, sf).filter("day(trading_day) % 3 = 0").groupBy("segment_id").agg(F.to_json(F.collect_set(F.col("trading_day").cast("string"))).alias("l"))
    text = F.when(F.col("segment_id") == 0, F.col("l")).when(F.col("segment_id") == 1, F.concat(F.lit('{"holidays": '), "l", F.lit("}"))).otherwise(F.concat(F.lit('{"2024": '), "l", F.lit("}")))
    return calendars.holidays_from_json(days.select(text.alias("json")))


@query("SELECT symbol, count(*)::VARCHAR AS n, max(row_hash)::VARCHAR AS newest FROM t GROUP BY symbol")
def a14_read_only_sql(spark: SparkSession, sf: str) -> DataFrame:
    view = f"ticks_{uuid.uuid4().hex}"
    ticks_from_events(spark, sf).createOrReplaceTempView(view)
    return T.read_only_sql(spark, f"SELECT symbol, count(*) AS n, max(row_hash) AS newest FROM {view} GROUP BY symbol;")


@query("""WITH have AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM events)), want AS (SELECT unnest(['event_id', 'at', 'event_type', 'price']) AS c)
SELECT 'missing' AS kind, c AS "column" FROM want WHERE c NOT IN (SELECT c FROM have) AND c <> 'at' UNION ALL SELECT 'extra', c FROM have WHERE c NOT IN (SELECT c FROM want) AND c <> 'ts' UNION ALL SELECT 'rename', c || '->at' FROM have WHERE c = 'ts'""", raw=True)
def a15_schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    return T.schema_problems(spark.read.parquet(f"{sf}/events.parquet"), ["event_id", "at", "event_type", "price"], {"ts": "at"})


@query(f"SELECT DISTINCT symbol, substr(sha256('{TYPES}'), 1, 16) AS fingerprint FROM t")
def b13_schema_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_from_events(spark, sf).select("symbol").distinct().withColumn("fingerprint", F.lit(scalars.schema_hash()))


_TEXTS = "CASE row_hash % 7 WHEN 0 THEN ' ' || row_hash || ' ' WHEN 1 THEN row_hash || '.5' WHEN 2 THEN 'nan' WHEN 3 THEN 'x' || row_hash WHEN 4 THEN '' WHEN 5 THEN '-' || row_hash ELSE NULL END"


@query(f"SELECT row_hash, CASE row_hash % 7 WHEN 0 THEN row_hash WHEN 5 THEN -row_hash END AS whole, CASE row_hash % 7 WHEN 0 THEN row_hash WHEN 1 THEN row_hash + 0.5 WHEN 5 THEN -row_hash END::DOUBLE AS number FROM t")
def b14_tolerant_casts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr(_TEXTS)
    return ticks_from_events(spark, sf).select("row_hash", scalars.safe_long(text).alias("whole"), scalars.safe_double(text).alias("number"))


@query("""SELECT row_hash, '["' || symbol || '","' || underlying_contract || '"]' AS text, underlying_contract AS second, 0::BIGINT AS broken FROM t""")
def b20_json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    text = scalars.json_array(F.array("symbol", "underlying_contract"))
    broken = F.size(scalars.array_of_json(F.concat(F.lit("{"), text))).cast("long")
    return ticks_from_events(spark, sf).select("row_hash", text.alias("text"), scalars.array_of_json(text)[1].alias("second"), broken.alias("broken"))


@query("SELECT DISTINCT symbol, trading_day AS day, underlying_contract AS contract, segment_id, 'h1' AS schedule_hash FROM t WHERE symbol <> 'view' AND trading_day BETWEEN DATE '2024-01-03' AND DATE '2024-01-22'")
def d8_schedule_range(spark: SparkSession, sf: str) -> DataFrame:
    """A schedule stored as text."""
    plan = ledgers._plan(ticks_from_events(spark, sf))
    stored = plan.select("symbol", F.date_format("day", "yyyyMMdd").alias("day"), "contract", F.col("segment_id").cast("string").alias("segment_id"), F.lit("h1").alias("schedule_hash"))
    others = [r["symbol"] for r in plan.select("symbol").distinct().filter("symbol <> 'view'").collect()]
    return schedule.schedule_range(stored, others, "2024-01-03", "2024-01-22")


@query("SELECT symbol, substr(sha256(string_agg(x, chr(10) ORDER BY x)), 1, 16) AS hash FROM (SELECT DISTINCT symbol, trading_day::VARCHAR || ',' || underlying_contract || ',' || segment_id AS x FROM t) GROUP BY symbol")
def d5_schedule_hash_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return scalars.table_hash(ledgers._plan(ticks_from_events(spark, sf)), ["day", "contract", "segment_id"], ("symbol",))


@query(f"SELECT symbol, count(*) FILTER (WHERE NOT {DEEP}) AS removed FROM t GROUP BY symbol")
def a7_purge_counts_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return T.delete_where(ticks_from_events(spark, sf), ~T.has_depth(), ("symbol",))[1]


@query("SELECT symbol, substr(sha256(concat_ws(',', 'main_l5', symbol, 'mid|spread')), 1, 16) AS build_id, count(*) AS n_rows, min(trading_day) AS first_day, max(trading_day) AS last_day FROM t GROUP BY 1")
def i16_build_records_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_records("main_l5", "mid|spread", ticks_from_events(spark, sf), "2024-02-01").select("symbol", "build_id", "n_rows", "first_day", "last_day")


_STORED = ["datetime_ns", "trading_day", "last_price", "volume", "open_interest", "bid_price1", "ask_price5", "bid_volume3", "underlying_contract", "segment_id", "schedule_hash", "ticks_kind", "dataset_version"]


@query("SELECT symbol, make_timestamp(datetime_ns // 1000) AS ts, datetime_ns, trading_day, last_price, volume, open_interest, bid_price1, ask_price5, bid_volume3, underlying_contract, segment_id, 'h1' AS schedule_hash, 'main_l5' AS ticks_kind, 'v2' AS dataset_version, true AS amount_missing, true AS hash_known FROM t")
def e2_stored_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the stored projection; its hash is that of the row's time and numbers."""
    stored = schedule.stored_ticks(ledgers._with_hash(spark, sf), F.col("symbol"))
    known = F.col("row_hash") == scalars.row_hash(F.col("datetime_ns"))
    return stored.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *_STORED, F.col("amount").isNull().alias("amount_missing"), known.alias("hash_known"))


@query(f"WITH {ORD} SELECT symbol, trading_day, row_hash, segment_id, underlying_contract, 'h1' AS schedule_hash, substr(sha256(concat_ws(',', symbol, 'main_l5', 'h1', 'spread|mid')), 1, 16) AS build_id, ask_price1 - bid_price1 AS spread, mid FROM d WHERE symbol <> 'view'")
def i15_feature_build_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = builds.feature_build(ledgers._with_hash(spark, sf, True), ["spread", "mid"])[0]
    return rows.select("symbol", "trading_day", "row_hash", "segment_id", "underlying_contract", "schedule_hash", "build_id", "spread", "mid")


@query(f"WITH {ORD}, f AS (SELECT symbol, row_hash, mid, lead(o, 10) OVER {W} <= o + 1 AS there, lead(mid, 10) OVER {W} AS m2 FROM d) SELECT symbol, row_hash, substr(sha256(concat_ws(',', symbol, 'main_l5', 'h1', 'h=10;k=1;tick=1.0')), 1, 16) AS build_id, CASE WHEN there THEN CASE WHEN m2 - mid >= 1 THEN 2 WHEN m2 - mid <= -1 THEN 0 ELSE 1 END END AS label_10 FROM f")
def j5_label_build_values(spark: SparkSession, sf: str) -> DataFrame:
    return builds.label_build(ledgers._with_hash(spark, sf), (10,))[0].select("symbol", "row_hash", "build_id", "label_10")


@query("SELECT name, lookback, n_rows FROM (VALUES ('spread', 0), ('mid', 0), ('microprice', 0), ('imbalance_1', 0), ('imbalance_total', 0), ('depth_weighted_price', 0), ('return_10', 10), ('volatility_20', 20), ('volume_delta_10', 10), ('oi_delta_10', 10), ('book_slope', 0)) v(name, lookback), (SELECT count(*) AS n_rows FROM t)")
def i13_factor_metadata(spark: SparkSession, sf: str) -> DataFrame:
    n = ticks_from_events(spark, sf).agg(F.count("*").alias("n_rows"))
    return features.factor_metadata(spark).select("name", "lookback").join(F.broadcast(n))  # one row


@query("SELECT 'm' || row_hash AS message, min(symbol) AS symbol FROM t WHERE row_hash % 4 <> 1 GROUP BY 1")
def m10_unique_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every message twice; every fourth has a blank id."""
    message = F.when(F.col("row_hash") % 4 == 1, "  ").otherwise(F.concat(F.lit("m"), "row_hash"))
    stream = _as_stream(spark, sf).select("symbol", "ts", message.alias("message"))
    path = f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return online.run_to_end(online.unique_ids(stream.unionByName(stream), "message", "40 days").drop("ts"), path).select("message", "symbol")
