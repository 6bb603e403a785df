"""Canonical five-level ticks: schema, readers, sinks and the adapter from the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = (1, 2, 3, 4, 5)
SCALARS = ["last_price", "average", "highest", "lowest", "volume", "amount", "open_interest"]
BOOK = [f"{side}_{what}{i}" for i in LEVELS for side, what in (("bid", "price"), ("ask", "price"), ("bid", "volume"), ("ask", "volume"))]
NUMERIC = [*SCALARS, *BOOK]
TICK_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("datetime", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in NUMERIC]])
PROVENANCE = ["underlying_contract", "segment_id", "schedule_hash"]
ORDER = ["datetime_ns", "row_hash"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: every float column gets null instead."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """A tick file or folder by its suffix: csv, parquet or pq, json, jsonl or ndjson; any other suffix is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(TICK_SCHEMA)
    if suffix == "csv":
        df = reader.option("header", True).csv(path)
    elif suffix in ("parquet", "pq"):
        df = reader.parquet(path)
    elif suffix in ("json", "jsonl", "ndjson"):
        df = reader.option("multiLine", suffix == "json").json(path)
    else:
        raise ValueError(f"unknown tick file suffix: {suffix}")
    return nan_to_null(df)


def synthetic_ticks(spark: SparkSession, rows: int, symbol: str = "SHFE.cu2501", start_ns: int = 1_735_689_600_000_000_000, step_ns: int = 500_000_000) -> DataFrame:
    """Deterministic ticks, one every step_ns, with prices on a slow wave."""
    i = F.col("id")
    last = F.lit(70000.0) + F.round(25 * F.sin(i * 0.05), 0)
    book = [(last + (s * lv)).alias(f"{n}_price{lv}") for lv in LEVELS for n, s in (("bid", -1), ("ask", 1))]
    book += [(F.lit(float(w * lv)) + i % 7).alias(f"{n}_volume{lv}") for lv in LEVELS for n, w in (("bid", 10), ("ask", 12))]
    scalars = [last.alias("last_price"), last.alias("average"), (last + 1).alias("highest"), (last - 1).alias("lowest"), (i + 1).cast("double").alias("volume"), (F.lit(1e6) + i).alias("amount"), (F.lit(1e5) + i).alias("open_interest")]
    return spark.range(rows).select(F.lit(symbol).alias("symbol"), (F.lit(start_ns) + i * step_ns).alias("datetime"), *scalars, *book).select("symbol", "datetime", *NUMERIC)


def with_missing_columns(df: DataFrame) -> DataFrame:
    """Canonical columns that df lacks are added as null, a missing row_hash as 0."""
    have = set(df.columns)
    out = df.withColumns({c: F.lit(None).cast("double") for c in NUMERIC if c not in have})
    return out.withColumns({c: v for c, v in {"row_hash": F.lit(0).cast("long"), **{p: F.lit(None).cast("string") for p in PROVENANCE}}.items() if c not in have})


def with_identity(df: DataFrame) -> DataFrame:
    """A missing row_hash is added as 0, missing provenance as null."""
    absent = {"row_hash": F.lit(0).cast("long"), "underlying_contract": F.lit(None).cast("string"), "segment_id": F.lit(None).cast("long"), "schedule_hash": F.lit(None).cast("string")}
    return df.withColumns({c: v for c, v in absent.items() if c not in df.columns})


def ticks_for_day(ticks: DataFrame, symbol: str, day: str, columns: list[str] | None = None, limit: int | None = None, descending: bool = False, provenance: bool = True) -> DataFrame:
    """One symbol's ticks of one trading day in order; the limit is clamped to 1..2,000,000.

    Without columns all are returned, those of the provenance only if asked.
    Of equal times the order is by row_hash; where the table has none it is 0
    and such an order is not fixed.
    """
    ticks = with_identity(ticks)
    keys = [F.desc(c) if descending else F.asc(c) for c in ORDER]
    out = ticks.filter((F.col("symbol") == symbol) & (F.col("trading_day") == F.lit(day).cast("date"))).orderBy(*keys)
    out = out if limit is None else out.limit(max(1, min(limit, 2_000_000)))
    if columns:
        return out.select(*columns)
    return out if provenance else out.drop(*PROVENANCE)


def first_days_sample(ticks: DataFrame, symbol: str, start: str, end: str, columns: list[str], max_rows: int) -> DataFrame:
    """The first max_rows ticks of a day range."""
    return ticks.filter((F.col("symbol") == symbol) & F.col("trading_day").between(start, end)).orderBy("trading_day", *ORDER).limit(max_rows).select(*columns)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where the session runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/tickweave-checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, for plans that read it several times."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def latest_by_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest version (then the greatest of the other columns)."""
    rest = [c for c in df.columns if c not in keys and c != version]
    newest = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return newest.select(*[F.col(k) if k in keys else F.col(f"_r.{k}") for k in df.columns])


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str, partition: str = "trading_day") -> None:
    """Merge rows into a partitioned Parquet table: latest row of a key wins, only touched partitions are rewritten.

    Each partition is replaced as a whole, but not all at once: after a failure
    some are new and some old, and running it again mends that.  One writer at
    a time.
    """
    touched = new.select(partition).distinct()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    merged = new
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.parquet(path).join(touched, partition, "left_semi")
        merged = old.unionByName(new, allowMissingColumns=True)
    merged = kept(latest_by_key(merged, keys, version))  # read before the folder it comes from is overwritten
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_where(df: DataFrame, condition: Column, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, count of the removed, in one row or one for each key); a null condition keeps the row."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(~hit), df.groupBy(*by).agg(F.count_if(hit).alias("removed"))


def export_rows(ticks: DataFrame, per_day: int | None = None, limit: int | None = None, provenance: bool = True, descending: bool = False) -> DataFrame:
    """Ordered export with limits per (symbol, day) and in all; descending takes the newest rows of each day and symbol first."""
    out = ticks
    order = [F.desc(c) if descending else F.asc(c) for c in ORDER]
    if per_day is not None:
        by = Window.partitionBy("symbol", "trading_day").orderBy(*order)
        out = out.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= per_day).drop("_n")
    if not provenance:
        out = out.drop(*PROVENANCE)
    out = out.orderBy("symbol", *order)
    return out if limit is None else out.limit(limit)


def has_depth() -> Column:
    """True where any price or volume of levels 2 to 5 is above 0."""
    return reduce(Column.__or__, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in BOOK if not c.endswith("1")])


def schema_problems(df: DataFrame, expected: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Rows (kind, column): missing, extra and planned renames of a table against its contract."""
    have, renames = set(df.columns), renames or {}
    rows = [("rename", f"{a}->{b}") for a, b in renames.items() if a in have and b not in have]
    covered = {b for a, b in renames.items() if a in have}
    rows += [("missing", c) for c in expected if c not in have and c not in covered]
    rows += [("extra", c) for c in df.columns if c not in expected and c not in renames]
    return df.sparkSession.createDataFrame(sorted(rows), "kind string, column string")


def apply_schema(df: DataFrame, expected: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    have = set(df.columns)
    out = df.withColumnsRenamed({a: b for a, b in (renames or {}).items() if a in have and b not in have})
    return out.withColumns({c: F.lit(None).cast("double") for c in expected if c not in out.columns})


def read_only_sql(spark: SparkSession, query: str, limit: int = 100) -> DataFrame:
    """A single query over registered views, 1..500 rows, all cells as text."""
    words = query.strip().rstrip(";")
    if ";" in words or words.split(None, 1)[0].lower() not in ("select", "with"):
        raise ValueError("only one SELECT or WITH statement is allowed")
    df = spark.sql(words).limit(max(1, min(limit, 500)))
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def manifest(ticks: DataFrame, run_id: str, created_at: str) -> DataFrame:
    """One row: symbols, day range and a map of rows by day."""
    days = ticks.groupBy("trading_day").agg(F.count("*").alias("n"), F.collect_set("symbol").alias("s"))
    return days.agg(
        F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("symbols"), F.min("trading_day").alias("start_day"),
        F.max("trading_day").alias("end_day"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("trading_day").cast("string").alias("day"), "n")))).alias("row_counts"),
    )


def latest_manifest(manifests: DataFrame, symbol: str) -> DataFrame:
    """The newest manifest that has the symbol."""
    newest = manifests.filter(F.array_contains("symbols", symbol)).agg(F.max_by(F.struct(*manifests.columns), "created_at").alias("m"))
    return newest.filter("m is not null").select("m.*")


def merged_catalog(older: DataFrame, newer: DataFrame, key: str = "symbol") -> DataFrame:
    """Newer rows over older ones column by column, ordered by prefix and numeric suffix."""
    a, b = older.alias("a"), newer.alias("b")
    columns = [c for c in dict.fromkeys([*older.columns, *newer.columns]) if c != key]
    pick = [F.coalesce(*[F.col(f"{s}.{c}") for s, d in (("b", newer), ("a", older)) if c in d.columns]).alias(c) for c in columns]
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *pick)
    return out.orderBy(F.regexp_replace(key, r"\d+$", ""), F.try_to_number(F.regexp_extract(key, r"(\d+)$", 1), F.lit("999999999999")), key)


def ticks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks."""
    return ticks_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def ticks_of(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as ticks: integer-valued prices, three contracts by day of month, with depthless, null and crossed rows."""
    e = events.select("event_id", "ts", "event_type", "value")
    i, base = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    shallow, crossed = i % 11 == 0, i % 101 == 0
    book = {}
    for lv in LEVELS:
        bid, ask = base - i % 3 - lv, base + i % 4 + lv
        b, a = F.when(crossed, ask).otherwise(bid), F.when(crossed, bid).otherwise(ask)
        bv, av = (i * (2 * lv + 1)) % 97, (i * (2 * lv + 3)) % 89
        if lv > 1:
            b, a, bv, av = (F.when(shallow, 0).otherwise(x) for x in (b, a, bv, av))
        else:
            b = F.when(i % 53 != 0, b)
        book |= {f"bid_price{lv}": b, f"ask_price{lv}": a, f"bid_volume{lv}": bv, f"ask_volume{lv}": av}
    ts = F.col("ts").cast("timestamp")
    segment = F.when(F.dayofmonth(ts) <= 10, 0).when(F.dayofmonth(ts) <= 20, 1).otherwise(2)
    return e.select(
        F.col("event_type").alias("symbol"), (F.unix_micros(ts) * 1000).alias("datetime_ns"), F.to_date(ts).alias("trading_day"), i.alias("row_hash"), base.cast("double").alias("last_price"), i.cast("double").alias("volume"),
        (1000 + i % 500).cast("double").alias("open_interest"), *[x.cast("double").alias(c) for c, x in book.items()], segment.cast("long").alias("segment_id"),
        F.concat(F.lit("SHFE."), F.substring("event_type", 1, 2), F.lit("240"), (segment + 1).cast("string")).alias("underlying_contract"),
    )


#: The same adapter for DuckDB.
TICKS_SQL = (
    "e AS (SELECT event_id AS i, ts, event_type AS symbol, CAST(round(value * 100) AS BIGINT) AS base FROM events), t AS (SELECT symbol, epoch_us(ts) * 1000 AS datetime_ns, CAST(ts AS DATE) AS trading_day, i AS row_hash, "
    "base::DOUBLE AS last_price, i::DOUBLE AS volume, (1000 + i % 500)::DOUBLE AS open_interest, "
    + ", ".join(
        (f"CASE WHEN i % 53 <> 0 THEN {b} END" if lv == 1 else f"CASE WHEN i % 11 = 0 THEN 0 ELSE {b} END") + f"::DOUBLE AS bid_price{lv}, "
        + (a if lv == 1 else f"CASE WHEN i % 11 = 0 THEN 0 ELSE {a} END") + f"::DOUBLE AS ask_price{lv}, "
        + (bv if lv == 1 else f"CASE WHEN i % 11 = 0 THEN 0 ELSE {bv} END") + f"::DOUBLE AS bid_volume{lv}, "
        + (av if lv == 1 else f"CASE WHEN i % 11 = 0 THEN 0 ELSE {av} END") + f"::DOUBLE AS ask_volume{lv}"
        for lv in LEVELS
        for b, a, bv, av in [(f"(CASE WHEN i % 101 = 0 THEN base + i % 4 + {lv} ELSE base - i % 3 - {lv} END)", f"(CASE WHEN i % 101 = 0 THEN base - i % 3 - {lv} ELSE base + i % 4 + {lv} END)", f"((i * {2 * lv + 1}) % 97)", f"((i * {2 * lv + 3}) % 89)")]
    )
    + ", CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END::BIGINT AS segment_id, 'SHFE.' || substr(symbol, 1, 2) || '240' || (CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END) AS underlying_contract FROM e)"
)
