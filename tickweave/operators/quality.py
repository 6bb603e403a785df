"""Field quality, order-book invariants and the data contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import HASH_TAG, checksum, null_rate, row_hash, schema_hash
from tickweave.operators.schedule import latest_ticks
from tickweave.sources.ticks import BOOK, LEVELS, NUMERIC, TICK_SCHEMA, with_missing_columns

CORE = ["bid_price1", "ask_price1", "last_price", "volume", "open_interest"]


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, [F.coalesce(p, F.lit(False)) for p in parts])


def crossed() -> Column:
    return (F.col("bid_price1") > 0) & (F.col("ask_price1") > 0) & (F.col("bid_price1") > F.col("ask_price1"))


def disordered() -> Column:
    """An adjacent level pair in the wrong order, both prices above 0; a row counts once."""
    pairs = []
    for i in LEVELS[:-1]:
        b, bn, a, an = (F.col(f"{s}_price{k}") for s, k in (("bid", i), ("bid", i + 1), ("ask", i), ("ask", i + 1)))
        pairs += [(b > 0) & (bn > 0) & (b < bn), (a > 0) & (an > 0) & (a > an)]
    return _any(pairs)


def field_quality(ticks: DataFrame) -> DataFrame:
    """Ledger row of each (symbol, day): null rates and invariant violations, in one pass."""
    have = set(ticks.columns)
    volumes, prices = [c for c in [*BOOK, "volume"] if "volume" in c and c in have], [c for c in [*BOOK, "last_price"] if "price" in c and c in have]
    count_cells = lambda cols: reduce(Column.__add__, [F.count_if(F.col(c) < 0) for c in cols])
    rate = lambda x, n: F.try_divide(x, F.greatest(n, F.lit(1)))
    both = F.count_if((F.col("bid_price1") > 0) & (F.col("ask_price1") > 0))
    return ticks.groupBy("symbol", "trading_day").agg(
        F.count("*").alias("n_rows"), *[null_rate(F.col(c)).alias(f"null_{c}") for c in CORE], (reduce(Column.__add__, [null_rate(F.col(c)) for c in BOOK]) / len(BOOK)).alias("null_book"),
        F.count_if(crossed()).alias("crossed"), rate(F.count_if(crossed()), both).alias("crossed_rate"), F.count_if(disordered()).alias("disordered"),
        count_cells(volumes).alias("negative_volumes"), rate(count_cells(volumes), F.count("*") * len(volumes)).alias("negative_volume_rate"), count_cells(prices).alias("negative_prices"),
    )


def quality_summary(ticks: DataFrame, now_ns: int) -> DataFrame:
    """Per symbol: latest day's quality row joined with age; score is 1 - mean core null rate."""
    ledger = field_quality(ticks)
    latest = ledger.groupBy("symbol").agg(F.max_by(F.struct(*ledger.columns[1:]), "trading_day").alias("q"))
    age = latest_ticks(ticks, ["last_price"]).select("symbol", ((F.lit(now_ns) - F.col("datetime_ns")) / 1e9).alias("age_s"))
    score = 1 - reduce(Column.__add__, [F.col(f"q.null_{c}") for c in CORE]) / len(CORE)
    out = latest.join(age, "symbol").select("symbol", F.col("q.trading_day").alias("trading_day"), F.col("q.crossed").alias("crossed"), score.alias("score"), "age_s")
    return out.withColumn("status", F.when(F.col("score") < 0.9, "error").when((F.col("score") < 0.99) | (F.col("crossed") > 0), "warning").otherwise("ok"))


def data_contract(ticks: DataFrame, min_rows: int = 1, max_core_null: float = 0.1, max_book_null: float = 0.2) -> DataFrame:
    """Violations as rows (check, value): columns, row count and null rates."""
    have = set(ticks.columns)
    missing = [c for c in NUMERIC if c not in have]
    core, book = [c for c in CORE if c in have], [c for c in BOOK if c in have]
    facts = ticks.agg(F.count("*").cast("double").alias("rows"), *[null_rate(F.col(c)).alias(f"core_{c}") for c in core], (reduce(Column.__add__, [null_rate(F.col(c)) for c in book]) / max(1, len(book))).alias("book"))
    checks = [F.struct(F.lit(f"missing_column:{c}").alias("check"), F.lit(1.0).alias("value"), F.lit(True).alias("bad")) for c in missing]
    checks += [F.struct(F.lit("min_rows").alias("check"), F.col("rows").alias("value"), (F.col("rows") < min_rows).alias("bad"))]
    checks += [F.struct(F.lit(f"null_rate:{c}").alias("check"), F.col(f"core_{c}").alias("value"), (F.col(f"core_{c}") > max_core_null).alias("bad")) for c in core]
    checks += [F.struct(F.lit("null_rate:book").alias("check"), F.col("book").alias("value"), (F.col("book") > max_book_null).alias("bad"))]
    return facts.select(F.inline(F.array(*checks))).filter("bad").select("check", "value")


# The share of null best prices from which a symbol is an error, and the ledger columns that count.
BEST_NULL_ERROR = 0.01
OUTLIERS, GAPS = ["price_jumps", "volume_spikes", "wide_spreads"], ["abnormal_gaps", "critical_gaps"]


def quality_board(contracts: DataFrame, fields: DataFrame, gaps: DataFrame, outliers: DataFrame | None = None, only_issues: bool = False) -> DataFrame:
    """Contracts with the newest row of each quality ledger: score in percent, anomalies and status.

    contracts: symbol and any other columns; fields, gaps, outliers: ledgers by
    symbol and trading_day, each small.  The score is 1 less the mean core null
    rate, null without a ledger row.  Null best prices over a hundredth are an
    error, a critical gap or any anomaly a warning.
    """
    def newest(ledger: DataFrame, columns: list[str], day: str) -> DataFrame:
        row = ledger.groupBy("symbol").agg(F.max_by(F.struct(F.col("trading_day").alias(day), *columns), "trading_day").alias("_r"))
        return row.select("symbol", "_r.*")

    core = [f"null_{c}" for c in CORE]
    out = contracts.join(newest(fields, [*core, "null_book"], "field_day"), "symbol", "left").join(newest(gaps, [*GAPS, "max_interval_ms"], "gap_day"), "symbol", "left")
    if outliers is None:
        out = out.withColumns({c: F.lit(0).cast("long") for c in OUTLIERS})
    else:
        out = out.join(newest(outliers, OUTLIERS, "outlier_day"), "symbol", "left").drop("outlier_day")
    out = out.fillna(0, [*OUTLIERS, *GAPS])
    known = F.filter(F.array(*core), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    out = out.withColumn("score", F.round((1 - mean) * 100, 2))  # rates lie in 0 to 1
    out = out.withColumn("anomalies", reduce(Column.__add__, [F.col(c) for c in [*OUTLIERS, *GAPS]]))
    bad = _any([F.col(f"null_{c}") > BEST_NULL_ERROR for c in ("bid_price1", "ask_price1")])
    out = out.withColumn("status", F.when(bad, "error").when(F.col("anomalies") > 0, "warning").otherwise("ok"))
    return out.filter("status <> 'ok'") if only_issues else out


def quality_totals(board: DataFrame) -> DataFrame:
    """One row: symbols, percent of complete ones, mean score, anomalies, age of the stalest contract that has not expired.

    The board's contracts have complete, expired and age_s.
    """
    return board.agg(
        F.count("*").alias("symbols"), (F.try_divide(F.count_if("complete"), F.count("*")) * 100).alias("complete_pct"), F.avg("score").alias("score_pct"), F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
        F.max(F.when(~F.col("expired"), F.col("age_s"))).alias("max_age_s"),
    )


def contract_report(ticks: DataFrame, stored_hash: str = "row_hash", min_rows: int = 32, max_core_null: float = 0.01, max_book_null: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(checks: check, value, passed; checksum of the row hashes with schema fingerprint and algorithm tag) in one pass.

    A missing tick column fails and counts as null; an extra one is told and
    passes.  Hashes are right if each row has one and it is that of its values,
    computed anew; a table without the column fails that check.
    """
    have, canonical = set(ticks.columns), [f.name for f in TICK_SCHEMA if f.name != "datetime"]
    known = {*canonical, "datetime_ns", "trading_day", stored_hash, "underlying_contract", "segment_id", "schedule_hash"}
    missing, extra = [c for c in canonical if c not in have], sorted(have - known)
    rows = with_missing_columns(ticks)
    anew = row_hash(F.col("datetime_ns"))
    stored = F.col(stored_hash) if stored_hash in have else F.lit(None).cast("long")
    rows = rows.select("*", anew.alias("_anew"), stored.alias("_stored"))
    facts = rows.agg(
        F.count("*").cast("double").alias("rows"), *[null_rate(F.col(c)).alias(f"_{c}") for c in CORE], (reduce(Column.__add__, [null_rate(F.col(c)) for c in BOOK]) / len(BOOK)).alias("book"),
        F.count_if(F.col("_stored").isNull()).cast("double").alias("unhashed"), F.count_if(F.col("_stored") != F.col("_anew")).cast("double").alias("changed"), *checksum(F.col("_anew")),
    )
    check = lambda name, value, passed: F.struct(F.lit(name).alias("check"), value.alias("value"), passed.alias("passed"))
    checks = [check("rows", F.col("rows"), F.col("rows") >= min_rows)]
    checks += [check(f"missing_column:{c}", F.lit(1.0), F.lit(False)) for c in missing] + [check(f"extra_column:{c}", F.lit(1.0), F.lit(True)) for c in extra]
    checks += [check(f"null_rate:{c}", F.col(f"_{c}"), F.col(f"_{c}") <= max_core_null) for c in CORE]
    checks += [check("null_rate:book", F.col("book"), F.col("book") <= max_book_null), check("rows_without_hash", F.col("unhashed"), F.col("unhashed") == 0), check("rows_with_another_hash", F.col("changed"), F.col("changed") == 0)]
    sums = facts.select(F.lit(schema_hash()).alias("schema_hash"), F.lit(HASH_TAG).alias("hash_algorithm"), F.col("rows").cast("long").alias("n_rows"), "hash_min", "hash_max", "hash_sum", "hash_abs_sum", "hash_xor")
    return facts.select(F.inline(F.array(*checks))), sums
