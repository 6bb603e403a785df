"""Builds of features, labels and fills with their records, the definition registry, and the daily chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import short_id
from tickweave.operators.evaluation import classification_metrics, promotion_gate
from tickweave.operators.features import FACTORS, compute_factors, compute_labels, fill_labels
from tickweave.sources.ticks import latest_by_key

# The fill build's horizons and price levels.
FILL_HORIZONS, FILL_LEVELS = (10, 50, 100, 500), (0, 1)


def _recorded(rows: DataFrame, ticks: DataFrame, kind: str, parameters: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(rows with build_id, one record for each symbol); the id depends on symbol, kind, schedule hash and parameters."""
    hashes = ticks.groupBy("symbol").agg(F.min("schedule_hash").alias("schedule_hash"))
    ids = hashes.withColumn("build_id", short_id(F.col("symbol"), F.lit(kind), F.coalesce("schedule_hash", F.lit("")), F.lit(parameters)))
    built = rows.join(ids.select("symbol", "build_id"), "symbol")
    facts = built.groupBy("symbol", "build_id").agg(F.count("*").alias("n_rows"), F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day"))
    return built, facts.join(ids.select("symbol", "schedule_hash"), "symbol").select("symbol", "build_id", F.lit(kind).alias("kind"), F.lit(parameters).alias("parameters"), "schedule_hash", "n_rows", "first_day", "last_day", F.lit(created_at).alias("created_at"))


def provenance_problems(ticks: DataFrame) -> DataFrame:
    """Symbols that must not be built: rows without a schedule hash, segment or contract, or more than one hash."""
    gaps = F.count_if(F.col("schedule_hash").isNull() | F.col("segment_id").isNull() | F.col("underlying_contract").isNull())
    facts = ticks.groupBy("symbol").agg(gaps.alias("incomplete"), F.count_distinct("schedule_hash").alias("hashes"))
    return facts.filter((F.col("incomplete") > 0) | (F.col("hashes") > 1))


def feature_build(ticks: DataFrame, names: list[str] | None = None, kind: str = "main_l5", created_at: str = "") -> tuple[DataFrame, DataFrame]:
    """(factors with provenance and build_id, records) of the symbols without provenance problems."""
    names = names or list(FACTORS)
    good = ticks.join(provenance_problems(ticks).select("symbol"), "symbol", "left_anti")
    keep = ("symbol", "trading_day", "datetime_ns", "row_hash", "segment_id", "underlying_contract", "schedule_hash")
    return _recorded(compute_factors(good, names, keep), good, kind, "|".join(names), created_at)


def label_build(ticks: DataFrame, horizons: tuple[int, ...] = (10, 50), k: float = 1, tick: float = 1.0, kind: str = "main_l5", created_at: str = "") -> tuple[DataFrame, DataFrame]:
    """(labels with build_id, records); the parameters are horizons, k and tick."""
    parameters = f"h={','.join(map(str, horizons))};k={k};tick={tick}"
    return _recorded(compute_labels(ticks, horizons, k, tick), ticks, kind, parameters, created_at)


def fill_build(ticks: DataFrame, horizons: tuple[int, ...] = FILL_HORIZONS, levels: tuple[int, ...] = FILL_LEVELS, tick: float = 1.0, kind: str = "main_l5", created_at: str = "") -> tuple[DataFrame, DataFrame]:
    """(fill labels with build_id, one row for each tick, side and level; records)."""
    parameters = f"h={','.join(map(str, horizons))};levels={','.join(map(str, levels))};tick={tick}"
    return _recorded(fill_labels(ticks, horizons, levels, tick), ticks, kind, parameters, created_at)


def merge_fills(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new fill rows; of one build, tick, side and level the newest created_at stays."""
    return latest_by_key(stored.unionByName(new, allowMissingColumns=True), ["build_id", "symbol", "trading_day", "datetime_ns", "row_hash", "side", "price_level"], "created_at")


def definition(registry: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """The row of a name and version, or its newest active version."""
    rows = registry.filter(F.col("name") == name)
    if version is not None:
        return rows.filter(F.col("version") == version)
    return rows.filter("deprecated_at is null").orderBy(F.desc("version")).limit(1)


def newest_definitions(registry: DataFrame) -> DataFrame:
    """name and version of the newest active definition of each name."""
    return registry.filter("deprecated_at is null").groupBy("name").agg(F.max("version").alias("version"))


def definitions(registry: DataFrame, active_only: bool = True) -> DataFrame:
    rows = registry.filter("deprecated_at is null") if active_only else registry
    return rows.orderBy("name", "version")


def deprecate(registry: DataFrame, name: str, version: int, at: str) -> DataFrame:
    """The registry with that version deprecated; one that already is keeps its time."""
    hit = (F.col("name") == name) & (F.col("version") == version) & F.col("deprecated_at").isNull()
    return registry.withColumn("deprecated_at", F.when(hit, F.lit(at)).otherwise(F.col("deprecated_at")))


def synced_registry(stored: DataFrame, local: DataFrame) -> DataFrame:
    """Stored rows overlaid by local ones of the same name and version."""
    keys = ["name", "version"]
    return stored.join(local, keys, "left_anti").select(*local.columns).unionByName(local)


def compare_models(scored: DataFrame, label: str, model: str = "model", by: str = "f1_macro") -> DataFrame:
    """Metrics of each model over one scored table (model, label, prediction), ranked; ties by name."""
    metrics = classification_metrics(scored, [model], label)
    # one row for each model: a table of a handful of rows
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.asc(model))))


def daily_chain(ticks: DataFrame, regimes: DataFrame, scored: DataFrame, report: DataFrame, label: str, names: list[str], created_at: str = "", **gate: float) -> DataFrame:
    """One row for each symbol and step of a day's run, with its rows and state: features, labels, regime, evaluation, promotion."""
    _, feature_records = feature_build(ticks, names, created_at=created_at)
    _, label_records = label_build(ticks, created_at=created_at)
    found = lambda df, step: df.select("symbol", F.lit(step).alias("step"), "n_rows", F.lit("built").alias("state"))
    regime = regimes.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max_by("regime", "trading_day").alias("state")).select("symbol", F.lit("regime").alias("step"), "n_rows", "state")
    metrics = classification_metrics(scored, ["symbol"], label).select("symbol", F.lit("evaluation").alias("step"), F.col("n").alias("n_rows"), F.when(F.col("accuracy") > F.lit(1 / 3), "better_than_chance").otherwise("not_better").alias("state"))
    promoted = promotion_gate(report, **gate).select("symbol", F.lit("promotion").alias("step"), F.col("trades").alias("n_rows"), F.when(F.col("passed"), "promoted").otherwise(F.concat(F.lit("held: "), F.array_join("reasons", ","))).alias("state"))
    out = found(feature_records, "features")
    for part in (found(label_records, "labels"), regime, metrics, promoted):
        out = out.unionByName(part)
    return out
