"""Feature selection, rolling cross-symbol correlation and metrics that fade with time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import whole

#: Features whose Gram matrix a task holds: 5 matrices of 8 bytes an entry.
MOST_FEATURES = 1000
DAY_S = 86_400


def correlations(rows: DataFrame, names: list[str]) -> dict[tuple[str, str], float]:
    """Correlation of every pair of features over the rows that have both; left out where it is undefined.

    One pass: each task adds up counts, sums and products of all pairs as
    matrices, and Spark adds those of the tasks entry by entry.  Values are
    centred by the features' means first.  NaN is null.
    """
    if len(names) > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features")
    mean = rows.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in names]).first()
    centre = np.array([mean[c] if mean[c] is not None else 0.0 for c in names])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, len(names), len(names)))
        for batch in batches:
            x = batch.to_numpy(np.float64)
            there = np.isfinite(x)
            x, m = np.where(there, x - centre, 0.0), there.astype(np.float64)
            total += np.stack((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x))
        i, j = np.indices(total.shape[1:])
        some = i.ravel() <= j.ravel()
        # of a pair: count, sums of both, squares of both, products
        yield pd.DataFrame({"i": i.ravel()[some], "j": j.ravel()[some], **{c: v.ravel()[some] for c, v in (("n", total[0]), ("x", total[1]), ("y", total[1].T), ("xx", total[2]), ("yy", total[2].T), ("xy", total[3]))}})

    cells = ["n", "x", "y", "xx", "yy", "xy"]
    parts = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(added, "i int, j int, " + ", ".join(f"{c} double" for c in cells))
    out = {}
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in cells]).collect():
        if r["n"] > 1 and r["i"] < r["j"]:
            vx, vy = r["xx"] - r["x"] ** 2 / r["n"], r["yy"] - r["y"] ** 2 / r["n"]
            if vx > 1e-12 * max(r["xx"], 1e-300) and vy > 1e-12 * max(r["yy"], 1e-300):
                out[names[r["i"]], names[r["j"]]] = float((r["xy"] - r["x"] * r["y"] / r["n"]) / np.sqrt(vx * vy))
    return out


def uncorrelated(rows: DataFrame, names: list[str], most: float = 0.95) -> list[str]:
    """The features, in order, whose absolute correlation with every one kept before is at most ``most``; undefined counts as 0."""
    known, kept = correlations(rows, names), []
    for c in names:
        if all(abs(known.get((k, c), 0.0)) <= most for k in kept):
            kept.append(c)
    return kept


def rolling_correlation(ticks: DataFrame, wanted: DataFrame, bucket_ns: int, buckets: int) -> DataFrame:
    """a, b, lag, h, n, corr of the wanted (a, b, lag): mean prices of a and, ``lag`` buckets later, of b, over the last ``buckets`` buckets up to h.

    A row for each bucket of a in which both have ticks; buckets without count
    for nothing, and corr is null with fewer than two or without variance.
    Co-moments of buckets add up in a frame by time, never over pairs that
    nobody asked for.
    """
    means = ticks.groupBy("symbol", whole(F.col("datetime_ns"), bucket_ns).alias("h")).agg(F.avg("last_price").alias("p"))
    x = wanted.join(means.select(F.col("symbol").alias("a"), "h", F.col("p").alias("x")), "a").withColumn("_then", F.col("h") + F.col("lag"))
    both = x.join(means.select(F.col("symbol").alias("b"), F.col("h").alias("_then"), F.col("p").alias("y")), ["b", "_then"])
    # centred by the pair's own means, so that sums of squares stay small
    centre = both.groupBy("a", "b", "lag").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    both = both.join(centre, ["a", "b", "lag"]).withColumn("x", F.col("x") - F.col("_mx")).withColumn("y", F.col("y") - F.col("_my"))
    by = Window.partitionBy("a", "b", "lag").orderBy("h").rangeBetween(-(buckets - 1), 0)
    n, sx, sy, sxx, syy, sxy = (F.sum(c).over(by) for c in (F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y")))
    out = both.select("a", "b", "lag", "h", n.alias("n"), (sxx - sx * sx / n).alias("_vx"), (syy - sy * sy / n).alias("_vy"), (sxy - sx * sy / n).alias("_c"))
    some = (F.col("n") > 1) & (F.col("_vx") > 1e-9) & (F.col("_vy") > 1e-9)
    return out.select("a", "b", "lag", "h", F.col("n").cast("long").alias("n"), F.when(some, F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("corr"))


def fading_metrics(scored: DataFrame, keys: list[str], label: str, probability: list[str], half_life_s: float, horizon_days: int | None = None) -> DataFrame:
    """keys, trading_day, n, weight, brier, log_loss, accuracy at the end of each day, every row weighing 2^(-age / half_life).

    age runs from the row's datetime_ns to the end of the trading day.  Days
    keep their own weighted sums; a day's metric adds those of earlier days,
    each faded by the days between.  Days beyond horizon_days, by default 64
    half-lives, weigh less than rounding and are left out.  Rows without label
    or with a null probability count for nothing.
    """
    parts = [F.pow(F.col(p) - (F.col(label) == i).cast("double"), 2) for i, p in enumerate(probability)]
    p = F.get(F.array(*probability), F.col(label).cast("int"))
    top = F.greatest(*probability)
    hit = (p == top).cast("double")
    day_number = F.datediff("trading_day", F.lit("1970-01-01"))
    age = (day_number.cast("long") + 1) * DAY_S - F.col("datetime_ns") / 1e9
    rows = scored.filter(F.col(label).isNotNull() & top.isNotNull() & p.isNotNull()).withColumn("_w", F.pow(F.lit(2.0), -age / half_life_s))
    sums = {"weight": F.col("_w"), "brier": F.col("_w") * sum(parts[1:], parts[0]), "log_loss": -F.col("_w") * F.log(F.greatest(F.lit(1e-10), F.least(F.lit(1.0), p))), "accuracy": F.col("_w") * hit}
    daily = rows.groupBy(*keys, "trading_day").agg(F.count("*").alias("n"), *[F.sum(x).alias(c) for c, x in sums.items()]).withColumn("_day", day_number)
    far = horizon_days if horizon_days is not None else int(64 * half_life_s // DAY_S) + 1
    by = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-far, 0)
    held = daily.withColumn("_days", F.collect_list(F.struct("_day", "n", *sums)).over(by))
    fade = lambda c: F.aggregate("_days", F.lit(0.0), lambda a, d: a + d[c] * F.pow(F.lit(2.0), -(F.col("_day") - d["_day"]) * DAY_S / F.lit(float(half_life_s))))
    out = held.select(*keys, "trading_day", F.aggregate("_days", F.lit(0).cast("long"), lambda a, d: a + d["n"]).alias("n"), *[fade(c).alias(c) for c in sums])
    return out.select(*keys, "trading_day", "n", "weight", *[(F.col(c) / F.col("weight")).alias(c) for c in list(sums)[1:]])
