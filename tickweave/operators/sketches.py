"""Quantiles of long histories from mergeable sketches (KLL) kept in the daily rollup.

A day's sketch is a few kilobytes whatever its rows; sketches of days merge to
one of any range.  ``exact_quantiles`` takes the sketch as a bracket only: rows
outside it are counted, those inside, a small share, are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.sources.ticks import kept

#: Size parameter of the sketches.
K = 1024


def rank_error(k: int = K) -> float:
    """Share of the rows by which a quantile's rank may be off, at 99 percent confidence (single-sided)."""
    return 2.296 / k**0.9723


def daily_sketches(rows: DataFrame, keys: list[str], day: str, value: str, k: int = K) -> DataFrame:
    """keys, day, n, total, least, most and sketch of the values that are neither null nor NaN; mergeable by merged()."""
    v = F.col(value).cast("double")
    own = rows.select(*keys, day, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return own.groupBy(*keys, day).agg(F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merged(daily: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The same of each key over all its days."""
    return daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantiles(sketched: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, n, mean, least, most and pNN for each share, to rank_error(); least and most are exact."""
    return sketched.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name(q)) for q in shares])


def name(share: float) -> str:
    return f"p{share * 100:g}".replace(".", "_")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], sketched: DataFrame | None = None, k: int = K) -> DataFrame:
    """keys and pNN for each share: linear between neighbouring ranks, exactly as an exact percentile.

    A sketch (of these rows, from the rollup if given) brackets each quantile
    by four times its rank error; only rows inside a bracket are ordered.  A
    bracket that misses its rank is widened to all of its group's rows.  Null
    and NaN values and null keys count for nothing.
    """
    v = F.col(value).cast("double")
    own = rows.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if sketched is None:
        sketched = own.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))
    off = 4 * rank_error(k)
    edge = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, q))))
    # at the ends of the range nothing bounds the bracket
    low = lambda q: edge(q - off) if q > off else F.lit(float("-inf"))
    high = lambda q: edge(q + off) if q + off < 1 else F.lit(float("inf"))
    brackets = sketched.select(*keys, "n", F.inline(F.array(*[F.struct(F.lit(float(q)).alias("q"), low(q).alias("low"), high(q).alias("high")) for q in shares])))
    # sketches are random: what one run of them found is kept, so that both parts speak of the same
    first = kept(_picked(own, brackets, keys))
    missed = first.filter("not found").select(*keys, "q", "n", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    all_ = first.filter("found").unionByName(_picked(own, missed, keys))
    return all_.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name(q)) for q in shares])


def _picked(own: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, q, n, value, found: the value between two ranks of each bracket, if both are inside."""
    at = (F.col("n") - 1) * F.col("q")
    side = F.when(F.col("_v") < F.col("low"), -1).when(F.col("_v") > F.col("high"), 1).otherwise(0)
    met = own.join(brackets, keys).withColumn("_side", side).withColumn("_v", F.when(F.col("_side") == 0, F.col("_v")))
    counted = met.groupBy(*keys, "q", "n", "_side", "_v").agg(F.count("*").alias("times"))
    ranked = counted.withColumn("to", F.sum("times").over(Window.partitionBy(*keys, "q").orderBy("_side", "_v"))).withColumn("from", F.col("to") - F.col("times"))
    holds = lambda rank: F.max(F.when((F.col("_side") == 0) & (F.col("from") <= rank) & (rank < F.col("to")), F.col("_v")))  # noqa: E731  ranks count from 0
    both = ranked.groupBy(*keys, "q", "n").agg(holds(F.floor(at)).alias("a"), holds(F.ceil(at)).alias("b"))
    part = at - F.floor(at)
    return both.select(*keys, "q", "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + part * (F.col("b") - F.col("a"))).alias("value"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("found"))
