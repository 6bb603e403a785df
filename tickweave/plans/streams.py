"""Queries of the stateful streams; ticks arrive in several runs of one checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.plans.queries import query
from tickweave.sources import provider
from tickweave.sources.ticks import shared_root, ticks_from_events
from tickweave.streaming import state
from tickweave.streaming.late import DayTable

DAY_NS = 86_400_000_000_000
HOUR_S = 3600


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _arriving(rows: DataFrame, arrival: Column, n: int, folder: str) -> Iterator[DataFrame]:
    """Streams over a folder that gets the rows of one arrival after the other; a row's arrival is 0 to n - 1."""
    spark, marked = rows.sparkSession, rows.withColumn("arrival", arrival)
    for k in range(n):
        marked.filter(F.col("arrival") == k).drop("arrival").write.parquet(f"{folder}/in/arrival={k}")
        yield spark.readStream.schema(rows.schema).parquet(f"{folder}/in/arrival=*")


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    """Puts of a value for every tick, but for some that clear a symbol and some that clear all."""
    t, i = ticks_from_events(spark, sf), F.col("row_hash")
    op = F.when(i % 601 == 5, "clear_all").when(i % 97 == 3, "clear").otherwise("put")
    registry = spark.createDataFrame([("f0", 0), ("f1", 3 * 86400)], "feature string, ttl_s int")
    rows = t.select(op.alias("op"), "symbol", F.concat(F.lit("f"), (F.col("volume") % 20).cast("int")).alias("feature"), F.col("last_price").alias("value"), F.expr("datetime_ns div 1000000000").alias("at"), i.alias("seq"))
    return state.with_ttl(rows, registry, 86400)


def _filled_store(spark: SparkSession, sf: str) -> state.FeatureStore:
    """A store that got its updates in three runs, out of order."""
    folder = _folder(spark)
    store = state.FeatureStore(f"{folder}/state", buckets=16)
    for stream in _arriving(_updates(spark, sf), (F.col("seq") % 3).cast("int"), 3, folder):
        store.feed(stream)
    return store


STORE = """u AS (SELECT CASE WHEN row_hash % 601 = 5 THEN 'clear_all' WHEN row_hash % 97 = 3 THEN 'clear' ELSE 'put' END AS op, symbol, 'f' || (row_hash % 20) AS feature, last_price AS value, datetime_ns // 1000000000 AS at_s, row_hash AS seq FROM t),
c AS (SELECT symbol, at_s, seq FROM u WHERE op = 'clear' UNION ALL SELECT s.symbol, at_s, seq FROM u, (SELECT DISTINCT symbol FROM u) s WHERE op = 'clear_all'),
k AS (SELECT symbol, max({'a': at_s, 's': seq}) AS since FROM c GROUP BY symbol),
en AS (SELECT symbol, feature, arg_max(value, {'a': at_s, 's': seq}) AS value, max(at_s) AS at_s FROM u LEFT JOIN k USING (symbol) WHERE op = 'put' AND (since IS NULL OR {'a': at_s, 's': seq} > since) GROUP BY ALL),
st AS (SELECT *, CASE feature WHEN 'f0' THEN 0 WHEN 'f1' THEN 259200 ELSE 86400 END AS ttl_s FROM en)"""
NOW_S = 1_706_572_800


@query(f'WITH {STORE} SELECT symbol, feature, value, at_s AS "at", ttl_s FROM st')
def m7_online_store(spark: SparkSession, sf: str) -> DataFrame:
    return _filled_store(spark, sf).entries(spark).withColumn("ttl_s", F.col("ttl_s").cast("int"))


@query(
    f"WITH {STORE}, w AS (SELECT DISTINCT symbol, 'f' || unnest(range(22)) AS feature FROM t), j AS (SELECT symbol, feature, value, coalesce(ttl_s > 0 AND {NOW_S} - at_s > ttl_s, false) AS is_stale FROM w LEFT JOIN st USING (symbol, feature)) "
    "SELECT symbol, feature, value AS any_value, CASE WHEN NOT is_stale THEN value END AS value, is_stale FROM j"
)
def m7_batch_get(spark: SparkSession, sf: str) -> DataFrame:
    entries = _filled_store(spark, sf).entries(spark)
    wanted = ticks_from_events(spark, sf).select("symbol").distinct().select("symbol", F.explode(F.array(*[F.lit(f"f{i}") for i in range(22)])).alias("feature"))
    every = state.lookup(entries, wanted, NOW_S, include_stale=True).select("symbol", "feature", F.col("value").alias("any_value"))
    return every.join(state.lookup(entries, wanted, NOW_S).drop("at"), ["symbol", "feature"])


@query(
    f"""WITH u AS (SELECT symbol, 'f' || (row_hash % 10) AS feature, datetime_ns // 1000000 AS ms FROM t), g AS (SELECT *, lead(ms) OVER (PARTITION BY symbol, feature ORDER BY ms) AS n FROM u),
ev AS (SELECT symbol, feature, ms + {6 * HOUR_S * 1000} AS at_ms, 'stale' AS event FROM g WHERE n IS NULL OR n - ms > {6 * HOUR_S * 1000} UNION ALL SELECT symbol, feature, n, 'recovered' FROM g WHERE n - ms > {6 * HOUR_S * 1000})
SELECT symbol, feature, at_ms AS "at", event FROM ev WHERE at_ms <= (SELECT max(ms) FROM u) - {48 * HOUR_S * 1000}"""
)
def n3_silent_features(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf)
    rows = t.select("symbol", F.concat(F.lit("f"), (F.col("row_hash") % 10).cast("string")).alias("feature"), F.expr("timestamp_micros(datetime_ns div 1000)").alias("ts"), F.lit(6 * HOUR_S).alias("ttl_s"))
    # up to a day out of order, within the delay of two
    arrival = F.least(F.lit(3), F.expr(f"(unix_micros(ts) div 1000000 - 1704067200 + pmod(hash(ts), 24) * {HOUR_S}) div {8 * 24 * HOUR_S}")).cast("int")
    folder = _folder(spark)
    for stream in _arriving(rows, arrival, 4, folder):
        state.run(state.watch(stream, "48 hours"), f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("symbol", "feature", "at", "event")


@query(
    """WITH s AS (SELECT symbol, datetime_ns, row_hash, CASE WHEN ask_price1 - bid_price1 < 4 THEN -1 WHEN ask_price1 - bid_price1 >= 6 THEN 1 ELSE 0 END AS target FROM t)
SELECT symbol, row_hash, target FROM (SELECT *, lag(target) OVER (PARTITION BY symbol ORDER BY datetime_ns, row_hash) AS p FROM s) WHERE target IS DISTINCT FROM p"""
)
def m6_stream_targets(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks_from_events(spark, sf).select("symbol", "datetime_ns", "row_hash", "bid_price1", "ask_price1")
    steps = [SQLTransformer(statement="SELECT *, ask_price1 - bid_price1 AS spread FROM __THIS__"), Bucketizer(splits=[-float("inf"), 4.0, 6.0, float("inf")], inputCol="spread", outputCol="bucket", handleInvalid="keep")]
    model = Pipeline(stages=steps).fit(t)
    target = F.when(F.col("bucket") == 0, -1).when(F.col("bucket") == 2, 1).otherwise(0)
    folder = _folder(spark)
    arrival = F.least(F.lit(2), F.expr(f"(datetime_ns - 1704067200000000000) div {10 * DAY_NS}")).cast("int")
    for stream in _arriving(t, arrival, 3, folder):
        state.run(state.score_changes(stream, model, target), f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("symbol", "row_hash", F.col("target").cast("int").alias("target"))


def _day_rows(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "trading_day").agg(F.count("*").alias("n"), F.sum("last_price").alias("price_sum"), F.min("datetime_ns").alias("first_ns"), F.max("datetime_ns").alias("last_ns"), F.max_by("last_price", F.struct("datetime_ns", "row_hash")).alias("close"))


def _repaired(spark: SparkSession, sf: str) -> DayTable:
    """Ticks in four arrivals, every 37th five days late, the first of them taken twice."""
    folder = _folder(spark)
    table = DayTable(spark, f"{folder}/days", _day_rows, 86400)
    t = ticks_from_events(spark, sf).select("symbol", "datetime_ns", "row_hash", "trading_day", "last_price")
    late = F.when(F.col("row_hash") % 37 == 0, 5 * DAY_NS).otherwise(0)
    arrival = F.least(F.lit(3), F.floor((F.col("datetime_ns") + late - 1704067200000000000) / (8 * DAY_NS))).cast("int")
    for stream in _arriving(t, arrival, 4, folder):
        state.run(stream, f"{folder}/state", handler=table.take)
    table.take(table.ticks().filter("batch = 0").drop("batch", "is_late"), 0)
    return table


@query(
    """WITH r AS (SELECT symbol, trading_day, count(*) AS n, sum(last_price) AS price_sum, min(datetime_ns) AS first_ns, max(datetime_ns) AS last_ns, arg_max(last_price, {'a': datetime_ns, 'b': row_hash}) AS close FROM t GROUP BY ALL)
SELECT * FROM r WHERE trading_day < CAST(to_timestamp((SELECT max(datetime_ns) FROM t) // 1000000000 - 86400) AT TIME ZONE 'UTC' AS DATE)"""
)
def m13_days_with_late_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf).built().select("symbol", "trading_day", "n", "price_sum", "first_ns", "last_ns", "close")


TICK_FIELDS = "symbol string, trading_day date, datetime_ns long, row_hash long, last_price double"


def _provider(spark: SparkSession, sf: str, folder: str) -> provider.FolderProvider:
    """The ticks as a provider's folder, written by symbol and day."""
    names = [f.split()[0] for f in TICK_FIELDS.split(", ")]
    ticks_from_events(spark, sf).select(*names).write.mode("append").partitionBy("symbol", "trading_day").parquet(f"{folder}/ticks")
    found = provider.FolderProvider(f"{folder}/ticks", TICK_FIELDS)
    provider.register(spark, "ticks", found)
    return found


@query("SELECT symbol, trading_day, datetime_ns, row_hash, last_price FROM t WHERE symbol <> 'view' AND trading_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def n5_provider_ticks(spark: SparkSession, sf: str) -> DataFrame:
    _provider(spark, sf, _folder(spark))
    rows = spark.read.format("ticks").load()
    return rows.filter(F.col("trading_day").between("2024-01-05", "2024-01-20") & (F.col("symbol") != "view"))


@query("SELECT symbol, trading_day, count(*) AS n, sum(row_hash)::BIGINT AS ids FROM t GROUP BY ALL")
def n5_provider_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    _provider(spark, sf, folder)
    state.run(spark.readStream.format("ticks").load(), f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").groupBy("symbol", "trading_day").agg(F.count("*").alias("n"), F.sum("row_hash").alias("ids"))


@query("SELECT symbol, min(trading_day) AS first_day, max(trading_day) AS last_day, (SELECT count(DISTINCT trading_day) FROM t) AS trading_days FROM t GROUP BY symbol")
def n5_provider_contracts(spark: SparkSession, sf: str) -> DataFrame:
    found = _provider(spark, sf, _folder(spark))
    return provider.contracts_of(spark, found).join(F.broadcast(provider.calendar_of(spark, found).agg(F.count("*").alias("trading_days"))))  # one row
