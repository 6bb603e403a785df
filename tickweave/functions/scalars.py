"""Scalar functions on symbols, times, hashes and messy values."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.sources.ticks import NUMERIC, TICK_SCHEMA

# Exchanges, and price ticks by product.
EXCHANGES = ("SHFE", "INE", "DCE", "CZCE", "CFFEX", "GFEX")
PRICE_TICKS = {"cu": 10.0, "au": 0.02, "ag": 1.0}
MARKET_ZONE = "Asia/Shanghai"
HASH_TAG = "xxhash64_v1"


def contract_symbol(raw: Column, exchange: Column | str) -> Column:
    """EX.varYYMM from a raw name with or without exchange prefix; null or blank gives null."""
    exchange = F.lit(exchange) if isinstance(exchange, str) else exchange
    text = F.trim(raw)
    prefix = F.upper(F.split_part(text, F.lit("."), F.lit(1)))
    known = text.contains(".") & prefix.isin(*EXCHANGES)
    body = F.when(known, F.substr(text, F.instr(text, ".") + 1)).otherwise(text)
    return F.when(text != "", F.concat(F.when(known, prefix).otherwise(F.upper(exchange)), F.lit("."), F.lower(body)))


def is_continuous(symbol: Column) -> Column:
    return F.startswith(F.coalesce(symbol, F.lit("")), F.lit("KQ.m@"))


def exchange_and_variety(symbol: Column) -> Column:
    """struct(exchange, variety) of a continuous alias or a contract."""
    body = F.regexp_replace(symbol, r"^KQ\.m@", "")
    return F.struct(F.upper(F.regexp_extract(body, r"^([A-Za-z]+)\.", 1)).alias("exchange"), F.lower(F.regexp_extract(body, r"\.([A-Za-z]+)", 1)).alias("variety"))


def price_tick(symbol: Column) -> Column:
    variety = exchange_and_variety(symbol)["variety"]
    out = F.lit(1.0)
    for name, tick in PRICE_TICKS.items():
        out = F.when(variety == name, F.lit(tick)).otherwise(out)
    return out


def contract_start_month(symbol: Column) -> Column:
    """First day of the month in a four-digit suffix YYMM (70 and above: 19YY); null if there is none."""
    digits = F.regexp_extract(symbol, r"(\d{4})$", 1)
    yy, mm = F.try_to_number(F.nullif(F.substring(digits, 1, 2), F.lit("")), F.lit("99")).cast("int"), F.try_to_number(F.nullif(F.substring(digits, 3, 2), F.lit("")), F.lit("99")).cast("int")
    return F.when(mm.between(1, 12), F.make_date(yy + F.when(yy >= 70, 1900).otherwise(2000), mm, F.lit(1)))


def symbol_order(symbol: Column) -> tuple[Column, Column]:
    return F.regexp_replace(symbol, r"\d+$", ""), F.regexp_extract(symbol, r"(\d+)$", 1).try_cast("long")


def whole(value: Column, unit: int) -> Column:
    """Integral quotient of longs; exact where a double would not be."""
    return F.call_function("div", value, F.lit(unit))


def any_time_to_ns(value: Column) -> Column:
    """Epoch ns from a number of s, ms, us or ns (told by size) or a local text; else null."""
    n = value.try_cast("decimal(30,6)")
    size = F.abs(n)
    scaled = n * F.when(size < 10**11, F.lit(10**9)).when(size < 10**14, F.lit(10**6)).when(size < 10**17, F.lit(10**3)).otherwise(F.lit(1)).cast("decimal(10,0)")
    local = F.to_utc_timestamp(F.try_to_timestamp(value.cast("string")), MARKET_ZONE)
    return F.coalesce(F.when(size > 0, scaled.try_cast("long")), F.when(n.isNull(), F.unix_micros(local) * 1000))


def ns_to_iso(ns: Column) -> Column:
    return F.when(ns > 0, F.date_format(F.timestamp_micros(whole(ns, 1000)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def clock_seconds(text: Column) -> Column:
    """Seconds of H:M or H:M:S; hours may pass 23; anything else is null."""
    parts = F.transform(F.split(text, ":"), lambda p: F.trim(p).try_cast("int"))
    ok = F.size(parts).between(2, 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(ok, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0)))


def short_id(*values: Column) -> Column:
    """16 hex digits of the SHA-256 of the comma-joined values."""
    return F.substring(F.sha2(F.concat_ws(",", *[v.cast("string") for v in values]), 256), 1, 16)


def definition_hash(definition: Column) -> Column:
    return F.substring(F.sha2(F.to_json(definition), 256), 1, 16)


def table_hash(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Hash of a small ordered table's lines, in one row or one for each key."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 16).alias("hash"))


def row_hash(time: Column, columns: list[str] = NUMERIC) -> Column:
    """Row identity by xxhash64 with null as 0; tag HASH_TAG names the algorithm."""
    return F.xxhash64(time, *[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


# Start and multiplier of the stored row hashes.
HASH_START, HASH_PRIME = 1469598103934665603, 1099511628211


def row_hash_bits(time: Column, columns: list[str]) -> Column:
    """Row identity over the bits of the doubles, multiply-and-xor in 64 bits (null as 0), by an Arrow UDF.

    Equals the hashes that stored tick tables hold; row_hash is the faster choice for new ones.
    """

    @F.pandas_udf("long")
    def hashed(frame: pd.DataFrame) -> pd.Series:
        h = np.full(len(frame), HASH_START, np.uint64)
        for name in frame.columns:
            v = frame[name].fillna(0).to_numpy()
            h = (h ^ (v.astype(np.int64) if v.dtype.kind in "iu" else v.astype(np.float64).view(np.int64)).view(np.uint64)) * np.uint64(HASH_PRIME)
        return pd.Series(h.view(np.int64))

    return hashed(F.struct(time.alias("time"), *[F.col(c).cast("double").alias(c) for c in columns]))


def wrapped_sum(x: Column) -> Column:
    """Sum of longs modulo 2^64 as a signed long."""
    two = F.lit(str(2**64)).cast("decimal(20,0)")
    low = F.pmod(F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)"), two)
    return F.when(low >= F.lit(str(2**63)).cast("decimal(20,0)"), low - two).otherwise(low).cast("long")


def checksum(hashes: Column) -> list[Column]:
    """min, max, wrapping sum, wrapping sum of absolute values, xor of row hashes."""
    return [F.min(hashes).alias("hash_min"), F.max(hashes).alias("hash_max"), wrapped_sum(hashes).alias("hash_sum"), wrapped_sum(F.abs(hashes.cast("decimal(20,0)"))).alias("hash_abs_sum"), F.bit_xor(hashes).alias("hash_xor")]


def schema_hash() -> str:
    return hashlib.sha256(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in TICK_SCHEMA).encode()).hexdigest()[:16]


def safe_long(text: Column) -> Column:
    """Whole number of a text, blanks around it allowed; anything else, also a fraction or one beyond 64 bits, is null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("long"))


def safe_double(text: Column) -> Column:
    """Number of a text; NaN and anything else is null."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def json_array(values: Column) -> Column:
    """Array as JSON text; a null array is an empty one, null entries stay."""
    return F.coalesce(F.to_json(values, {"ignoreNullFields": "false"}), F.lit("[]"))


def array_of_json(text: Column, entries: str = "string") -> Column:
    """Array of a JSON text; what is no array, or null, gives an empty one."""
    found = F.when(F.trim(text).startswith("["), F.from_json(text, f"array<{entries}>"))
    return F.coalesce(found, F.array().cast(f"array<{entries}>"))


def null_rate(column: Column, rows: Column | None = None) -> Column:
    return F.coalesce(F.try_divide(F.count_if(column.isNull()), F.count("*") if rows is None else rows), F.lit(0.0))


def any_date(value: Column) -> Column:
    """ISO day of epoch seconds or of yyyy-MM-dd, yyyyMMdd or a timestamp text."""
    text = F.trim(value.cast("string"))
    seconds = text.try_cast("double")
    epoch = F.when(F.length(text) >= 9, F.to_date(F.timestamp_seconds(F.when(seconds.between(0, 4e9), seconds))))
    return F.date_format(F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd")), epoch, F.to_date(F.try_to_timestamp(text))), "yyyy-MM-dd")


def keyed(symbols: list[str] | None = None, start: str | None = None, end: str | None = None, like: str | None = None) -> Column:
    """Filter on symbol list, day range and case-blind pattern, on bare partition columns."""
    out = F.lit(True)
    if symbols is not None:
        out = out & F.col("symbol").isin(symbols)
    if start is not None:
        out = out & (F.col("trading_day") >= F.lit(start).cast("date"))
    if end is not None:
        out = out & (F.col("trading_day") <= F.lit(end).cast("date"))
    return out & F.lower("symbol").like(like.lower()) if like is not None else out
