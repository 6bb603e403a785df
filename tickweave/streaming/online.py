"""Structured Streaming forms of the per-tick operators, and the batch forms of store and latency reports."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.scalars import whole
from tickweave.operators import days, sketches
from tickweave.streaming.ordered import InOrder

FEATURES = ["return_10", "volatility_20", "volume_delta_10", "oi_delta_10"]
_FACTOR_OUT = "symbol string, trading_day date, datetime_ns long, row_hash long, segment_id long, return_10 double, volatility_20 double, volume_delta_10 double, oi_delta_10 double"


def without_repeats(stream: DataFrame, delay: str = "10 minutes", keys: tuple[str, ...] = ("symbol", "datetime_ns")) -> DataFrame:
    """One tick for each symbol and time, or other keys; state is dropped behind the watermark on ts.

    With row_hash among the keys different ticks of one time all stay.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def unique_ids(stream: DataFrame, id_col: str, delay: str = "10 minutes") -> DataFrame:
    """Messages without a blank id, each id once within the delay."""
    return stream.filter(F.trim(id_col) != "").withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_col])



RING = 21


def _factor_rows(symbol: str | None, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    segment, ordinal, day, mids, volumes, interest, days = state or (-1, 0, "", *[np.array([])] * 4)
    kept = len(mids)
    name = rows["trading_day"].astype(str).to_numpy()
    ordinals = ordinal + np.cumsum(name != np.append([day], name[:-1]))
    own = rows["segment_id"].to_numpy(np.int64)
    run = np.append(np.zeros(kept, np.int64), np.cumsum(own != np.append([segment], own[:-1])))  # a roll starts a new run: nothing crosses it
    number = lambda old, new: np.append(old, new.astype(np.float64))
    mid = number(mids, ((rows["bid_price1"] + rows["ask_price1"]) / 2).to_numpy())
    volume, oi, at = number(volumes, rows["volume"].to_numpy()), number(interest, rows["open_interest"].to_numpy()), np.append(np.array(days, np.int64), ordinals)
    n = len(mid)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        return np.append(np.full(min(k, n), np.nan), x[: max(0, n - k)])

    near = {k: (back(run.astype(np.float64), k) == run) & (back(at.astype(np.float64), k) >= at - 1) for k in (10, 20)}
    with np.errstate(divide="ignore", invalid="ignore"):
        ten = np.where(near[10], back(mid, 10), np.nan)
        returned = np.where(ten != 0, mid / ten - 1, np.nan)
        before = np.where(back(run.astype(np.float64), 1) == run, back(mid, 1), np.nan)
        step = np.where(before != 0, mid / before - 1, np.nan)
    deviation = np.full(n, np.nan)
    if n >= 20:
        deviation[19:] = np.lib.stride_tricks.sliding_window_view(step, 20).std(axis=1, ddof=1)
    factors = (returned, np.where(near[20], deviation, np.nan), np.where(near[10], volume - back(volume, 10), np.nan), np.where(near[10], oi - back(oi, 10), np.nan))
    out = rows[["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id"]].reset_index(drop=True)
    for f, x in zip(FEATURES, factors, strict=True):
        # NaN is null, as in batch
        out[f] = pd.array(np.where(np.isnan(x[kept:]), None, x[kept:]), dtype="Float64")
    last = np.flatnonzero(run == run[-1])[-RING:]
    return out, (int(own[-1]), int(ordinals[-1]), str(name[-1]), mid[last], volume[last], oi[last], at[last])


def stream_factors(stream: DataFrame) -> InOrder:
    """The rolling factors tick by tick from a ring of 21 ticks for each symbol, for run_to_end; same rules as in batch.

    Ticks of a micro-batch pass in order, computed as arrays an Arrow batch at a
    time; the state is cleared at a roll.
    """
    needed = ["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id", "bid_price1", "ask_price1", "volume", "open_interest"]
    return InOrder(stream.select(*needed), _factor_rows, _FACTOR_OUT)


def online_calibration(stream: DataFrame, features: list[str], horizon: int, threshold: float, rate: float = 0.01, decay: float = 0.999, l2: float = 1e-3, clip: float = 1.0) -> InOrder:
    """Delayed labels feed a softmax regression for each symbol, step by step; for run_to_end.

    Each tick is scored with the weights so far; ``horizon`` ticks later its
    label (0 down, 1 flat, 2 up) is known and one clipped gradient step is
    made, its rate falling by a constant factor.  Weights start at 0.  A mean of
    the last 100 losses over 2 disables the model for good (probabilities are
    then uniform and nothing more is learned).  Steps follow one another, so a
    symbol is one task's work; it holds one Arrow batch of ticks.
    """
    k = len(features) + 1

    def step(symbol: str | None, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        w, n, losses, buffer, off = state or (np.zeros((3, k)), 0, deque(maxlen=100), deque(maxlen=horizon), False)
        given = np.column_stack([np.ones(len(rows)), *[rows[f].fillna(0.0).to_numpy(np.float64) for f in features]])
        mids, hot, labels, scores = rows["mid"].to_numpy(np.float64), np.eye(3), [], np.empty((len(rows), 3))
        for i, (x, mid) in enumerate(zip(given, mids.tolist(), strict=True)):
            label = None
            if len(buffer) == horizon and mid == mid:
                old, before = buffer[0]
                delta = mid - before
                label = 2 if delta >= threshold else 0 if delta <= -threshold else 1
            if label is not None and not off:
                p = _softmax(w @ old)
                losses.append(-math.log(max(p[label], 1e-10)))
                g = (p - hot[label])[:, None] * old + l2 * w
                w = w - rate * decay**n * g * min(1.0, clip / max(math.sqrt(float((g * g).sum())), 1e-12))
                n += 1
            off = off or (len(losses) == 100 and sum(losses) / 100 > 2)
            scores[i] = 1 / 3 if off else _softmax(w @ x)
            labels.append(label)
            if mid == mid:
                buffer.append((x.copy(), mid))
        out = rows[["symbol", "datetime_ns", "row_hash"]].assign(delayed_label=pd.array(labels, dtype="Int64"), p_down=scores[:, 0], p_flat=scores[:, 1], p_up=scores[:, 2])
        return out, (w, n, losses, buffer, off)

    return InOrder(stream, step, "symbol string, datetime_ns long, row_hash long, delayed_label long, p_down double, p_flat double, p_up double")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def target_changes(scored: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows whose target differs from the one before (batch form); a first row without a target is none."""
    rows = scored.withColumn("_day", whole(F.col("datetime_ns"), 86_400_000_000_000))
    return days.changes(rows, [key], "_day", "target", first_null=False).drop("_day")


def run_to_end(stream: DataFrame | InOrder, path: str, handler: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote to path/out; only plain streams take a handler."""
    if isinstance(stream, InOrder):
        if handler:
            raise ValueError("a stream in order writes its own output")
        return stream.run_to_end(path)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = writer.foreachBatch(handler).start() if handler else writer.format("parquet").option("path", f"{path}/out").start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")



def feature_store(updates: DataFrame, now: Column, registry: DataFrame | None = None) -> DataFrame:
    """Latest value of each (symbol, feature) with age and staleness by the feature's ttl_s (60 if unknown)."""
    latest = updates.groupBy("symbol", "feature").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    rows = latest if registry is None else latest.join(registry.select("feature", "ttl_s"), "feature", "left")
    ttl = F.coalesce(F.col("ttl_s") if registry is not None else F.lit(None).cast("int"), F.lit(60))
    return rows.withColumn("age_s", now - F.col("at")).withColumn("is_stale", F.col("age_s") > ttl)


def staleness(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted (symbol, feature) with is_stale and the reason: not_found, ttl_exceeded or null."""
    joined = wanted.join(store.select("symbol", "feature", "age_s", "is_stale"), ["symbol", "feature"], "left")
    reason = F.when(F.col("age_s").isNull(), "not_found").when(F.col("is_stale"), "ttl_exceeded")
    return joined.select("symbol", "feature", "age_s", F.coalesce("is_stale", F.lit(True)).alias("is_stale"), reason.alias("reason"))


def staleness_events(checks: DataFrame) -> DataFrame:
    """Changes in a log of checks (symbol, feature, at, is_stale): event stale or recovered."""
    by = Window.partitionBy("symbol", "feature").orderBy("at")
    rows = checks.withColumn("_was", F.coalesce(F.lag("is_stale").over(by), F.lit(False)))
    return rows.filter(F.col("is_stale") != F.col("_was")).select("symbol", "feature", "at", F.when(F.col("is_stale"), "stale").otherwise("recovered").alias("event"))


def store_statistics(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("entries"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("feature").alias("features"), F.count_if("is_stale").alias("stale"), F.count_if(~F.col("is_stale")).alias("fresh"), F.max("age_s").alias("oldest_s"))


def latency_report(log: DataFrame, budgets: dict[str, float], stage: str = "stage", ms: str = "ms") -> DataFrame:
    """mean, p50, p95, p99, max of each stage and whether p95 passes its budget; percentiles are exact without ordering a stage's whole log."""
    named = log.withColumn("stage", F.col(stage))
    out = named.groupBy("stage").agg(F.count("*").alias("n"), F.avg(ms).alias("mean"), F.max(ms).alias("max"))
    out = out.join(sketches.exact_quantiles(named, ["stage"], ms, [0.5, 0.95, 0.99]), "stage", "left").select("stage", "n", "mean", "p50", "p95", "p99", "max")
    budget = F.lit(None).cast("double")
    for name, value in budgets.items():
        budget = F.when(F.col("stage") == name, F.lit(float(value))).otherwise(budget)
    return out.withColumn("over_budget", F.coalesce(F.col("p95") > budget, F.lit(False)))


def metric_snapshot(samples: DataFrame, last: int = 2048) -> DataFrame:
    """Per metric over its last samples: count, errors, error rate, percentiles."""
    by = Window.partitionBy("metric").orderBy(F.desc("at"), F.desc("id"))
    recent = samples.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= last)
    return recent.groupBy("metric").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.avg(F.col("is_error").cast("double")).alias("error_rate"), *[F.percentile("ms", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])
