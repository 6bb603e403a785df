"""Stateful streams over map state, state TTL and event-time timers.

``FeatureStore`` keeps the latest value of each (symbol, feature) in the state
of a stream; it is read back from the checkpoint.  ``watch`` emits an event
when a feature falls silent, without input.  ``score_changes`` applies a fitted
pipeline to a stream and keeps each symbol's last target.  All three give the
same rows however the input is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_TTL_S = 60
#: State of the store goes this long after its last change, in processing time; beyond any feature's own ttl.
STATE_TTL_MS = 30 * 24 * 3600 * 1000
STORE_OUT = "symbol string, feature string, value double, at long, seq long, ttl_s long, change string"
EVENT_OUT = "symbol string, feature string, at long, event string"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold for streams started inside, given as name=value of the names above."""
    names = {k: globals()[k] for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.set(n, before[k]) if before[k] is not None else spark.conf.unset(n)


def run(stream: DataFrame, checkpoint: str, out: str | None = None, handler: Callable[[DataFrame, int], None] | None = None, mode: str = "append", idle_batches: bool = True) -> None:
    """Run a stream over all that is there, from where its checkpoint ends; results go to the Parquet folder out or to handler.

    Without idle_batches it ends with its last input: state with a TTL in
    processing time would otherwise keep it busy for good.
    """
    with settings(stream.sparkSession, PROVIDER=ROCKS_DB, IDLE_BATCHES=str(idle_batches).lower()):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if handler is None:
            # every batch has a folder of its own, so a batch that runs again replaces itself
            handler = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        writer.foreachBatch(handler).start().awaitTermination()


def with_ttl(updates: DataFrame, registry: DataFrame | None = None, default_s: int = DEFAULT_TTL_S) -> DataFrame:
    """updates with ttl_s: their own if they have one, else the registry's for the feature, else the default."""
    own = F.col("ttl_s") if "ttl_s" in updates.columns else F.lit(None)
    if registry is None:
        return updates.withColumn("ttl_s", F.coalesce(own.cast("long"), F.lit(default_s).cast("long")))
    known = registry.select(F.col("feature").alias("_feature"), F.col("ttl_s").cast("long").alias("_ttl_s")).dropDuplicates(["_feature"])
    rows = updates.join(known, F.col("feature") == F.col("_feature"), "left")
    return rows.withColumn("ttl_s", F.coalesce(own.cast("long"), F.col("_ttl_s"), F.lit(default_s).cast("long"))).drop("_feature", "_ttl_s")


class _Store(StatefulProcessor):
    """Entries of one bucket of symbols, and the last clear of each symbol ('' for all)."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "symbol string, feature string", "value double, at long, seq long, ttl_s long", self.ttl_ms)
        self.clears = handle.getMapState("clears", "symbol string", "at long, seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        clears = batch[batch["op"] != "put"]
        out = []
        for symbol, last in clears.assign(who=clears["symbol"].where(clears["op"] == "clear", "")).groupby("who").last().iterrows():
            known = self.clears.getValue((symbol,))
            if known is None or (last["at"], last["seq"]) > tuple(known):
                self.clears.updateValue((symbol,), (int(last["at"]), int(last["seq"])))
        cleared = {k[0]: tuple(v) for k, v in self.clears.iterator()} if self.clears.exists() else {}
        since = lambda symbol: max(cleared.get(symbol, (-(2**63), 0)), cleared.get("", (-(2**63), 0)))
        if len(clears):
            for (symbol, feature), held in [(tuple(k), tuple(v)) for k, v in self.entries.iterator()]:
                if held[1:3] <= since(symbol):
                    self.entries.removeKey((symbol, feature))
                    out.append((symbol, feature, None, *since(symbol), held[3], "cleared"))
        puts = batch[batch["op"] == "put"].drop_duplicates(["symbol", "feature"], keep="last")
        for r in puts.itertuples(index=False):
            entry = (None if pd.isna(r.value) else float(r.value), int(r.at), int(r.seq), int(r.ttl_s))
            held = self.entries.getValue((r.symbol, r.feature))
            if entry[1:3] > since(r.symbol) and (held is None or entry[1:3] > tuple(held)[1:3]):
                self.entries.updateValue((r.symbol, r.feature), entry)
                out.append((r.symbol, r.feature, *entry, "put"))
        frame = pd.DataFrame(out, columns=["symbol", "feature", "value", "at", "seq", "ttl_s", "change"])
        yield frame.astype({"value": "float64", "at": "int64", "seq": "int64", "ttl_s": "int64"})

    def close(self) -> None:
        pass


class FeatureStore:
    """Latest value of each (symbol, feature), kept by a stream of updates and read from its checkpoint.

    An update has op ('put', 'clear' for a symbol, 'clear_all'), symbol,
    feature, value, at (seconds or any rising number), seq (order among equal
    times) and ttl_s.  Of two puts the later by (at, seq) stays, whichever
    arrives first; a clear removes what is not later than it, also if that
    arrives after the clear.  A put without symbol or feature counts for
    nothing.  Symbols share a fixed number of buckets, so that a clear of all
    can reach every one.
    """

    def __init__(self, checkpoint: str, buckets: int = 64, state_ttl_ms: int = STATE_TTL_MS):
        self.checkpoint, self.buckets, self.state_ttl_ms = checkpoint, buckets, state_ttl_ms

    def changes(self, updates: DataFrame) -> DataFrame:
        """The stream of changes (put, cleared) to the store."""
        valid = (F.col("op") == "clear_all") | (F.col("symbol").isNotNull() & ((F.col("op") == "clear") | ((F.col("op") == "put") & F.col("feature").isNotNull())))
        every = F.sequence(F.lit(0), F.lit(self.buckets - 1))
        own = F.array(F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int"))
        ttl = F.coalesce(F.col("ttl_s"), F.lit(DEFAULT_TTL_S)).cast("long")
        rows = updates.filter(valid).select("op", "symbol", "feature", F.col("value").cast("double").alias("value"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), ttl.alias("ttl_s"), F.explode(F.when(F.col("op") == "clear_all", every).otherwise(own)).alias("bucket"))
        return rows.groupBy("bucket").transformWithStateInPandas(_Store(self.state_ttl_ms), STORE_OUT, "Update", "ProcessingTime")

    def feed(self, updates: DataFrame, handler: Callable[[DataFrame, int], None] | None = None) -> None:
        """Take in all updates that are there; handler sees each batch of changes."""
        run(self.changes(updates), self.checkpoint, handler=handler or (lambda batch, _: batch.write.format("noop").mode("overwrite").save()), mode="update", idle_batches=False)

    def entries(self, spark: SparkSession) -> DataFrame:
        """symbol, feature, value, at, ttl_s of all entries, straight from the state."""
        with settings(spark, PROVIDER=ROCKS_DB):
            state = spark.read.format("statestore").option("path", self.checkpoint).option("stateVarName", "entries").load()
        held = "user_map_value.value" if "user_map_value.value" in _paths(state) else "user_map_value"
        return state.select("user_map_key.symbol", "user_map_key.feature", *[F.col(f"{held}.{c}").alias(c) for c in ("value", "at", "ttl_s")])


def _paths(df: DataFrame) -> set[str]:
    """Names of nested struct fields whose value is a struct itself."""
    return {f"{f.name}.{g.name}" for f in df.schema if hasattr(f.dataType, "fields") for g in f.dataType if hasattr(g.dataType, "fields")}


def lookup(entries: DataFrame, wanted: DataFrame, now: Column | int, include_stale: bool = False) -> DataFrame:
    """wanted (symbol, feature) with value and at from the store: null if missing or, unless asked for, stale.

    An entry is stale if now - at is above its ttl_s; a ttl_s of 0 or less never is.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    rows = wanted.select("symbol", "feature").join(entries, ["symbol", "feature"], "left")
    stale = F.coalesce((F.col("ttl_s") > 0) & (now - F.col("at") > F.col("ttl_s")), F.lit(False))
    seen = F.lit(True) if include_stale else ~stale
    return rows.select("symbol", "feature", F.when(seen, F.col("value")).alias("value"), F.when(seen, F.col("at")).alias("at"), stale.alias("is_stale"))


def merged_runs(runs: list[tuple[int, int]], times: list[int], gap: int) -> list[tuple[int, int]]:
    """Runs (first, last) of times no further apart than gap, from earlier runs and new times."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*runs, *((t, t) for t in times)]):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class _Watch(StatefulProcessor):
    """Runs of updates of one (symbol, feature) that the watermark has not settled, and whether it is stale."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "first array<long>, last array<long>, ttl long, stale boolean, timer long")

    def _settle(self, key, runs: list[tuple[int, int]], ttl: int, stale: bool, timer: int, watermark: int) -> pd.DataFrame:
        out, announced = [], not stale
        while runs:
            if not announced and runs[0][0] <= watermark:
                out.append((runs[0][0], "recovered"))
                announced = True
            if not announced or ttl <= 0 or runs[0][1] + ttl > watermark:
                break
            out.append((runs[0][1] + ttl, "stale"))
            runs, announced = runs[1:], False
        due = -1
        if runs:
            # the next moment at which the watermark decides something
            due = runs[0][0] if not announced else runs[0][1] + ttl if ttl > 0 else -1
        if timer >= 0 and timer != due:
            self.handle.deleteTimer(timer)
        if due >= 0 and due != timer:
            self.handle.registerTimer(due)
        self.state.update(([a for a, _ in runs], [b for _, b in runs], ttl, not announced, due))
        frame = pd.DataFrame(out, columns=["at", "event"]).astype({"at": "int64", "event": "object"})
        frame.insert(0, "feature", key[1])
        frame.insert(0, "symbol", key[0])
        return frame

    def _held(self) -> tuple[list[tuple[int, int]], int, bool, int]:
        if not self.state.exists():
            return [], 0, False, -1
        first, last, ttl, stale, timer = self.state.get()
        return list(zip(map(int, first), map(int, last), strict=True)), int(ttl), bool(stale), int(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        runs, ttl, stale, timer = self._held()
        ttl = int(batch["ttl_ms"].max())  # one for a feature
        yield self._settle(key, merged_runs(runs, batch["ms"].astype("int64").tolist(), ttl), ttl, stale, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, ttl, stale, timer = self._held()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        yield self._settle(key, runs, ttl, stale, -1 if timer == fired else timer, max(fired, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def watch(updates: DataFrame, delay: str) -> DataFrame:
    """Events stale and recovered (symbol, feature, at in ms) of a stream of updates (symbol, feature, ts, ttl_s).

    A feature turns stale ttl_s after its last update, by a timer on event
    time, and recovers with the next one.  An event is given out once the
    watermark, delay behind the newest update, has passed it, so updates that
    arrive out of order within the delay change nothing; later ones are
    dropped.  A ttl_s of 0 or less never gets stale.  Updates without symbol,
    feature or ts, or from before 1970, count for nothing.
    """
    rows = updates.filter("symbol is not null and feature is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.select("symbol", "feature", "ts", F.unix_millis("ts").alias("ms"), (F.coalesce(F.col("ttl_s"), F.lit(DEFAULT_TTL_S)).cast("long") * 1000).alias("ttl_ms"))
    return rows.groupBy("symbol", "feature").transformWithStateInPandas(_Watch(), EVENT_OUT, "Append", "EventTime")


def silent_events(updates: DataFrame, delay_ms: int) -> DataFrame:
    """The same events in batch: gaps between updates above the ttl, as far as the final watermark has passed them."""
    rows = updates.filter("symbol is not null and feature is not null and ts is not null").select("symbol", "feature", F.unix_millis("ts").alias("ms"), (F.coalesce(F.col("ttl_s"), F.lit(DEFAULT_TTL_S)).cast("long") * 1000).alias("ttl"))
    last = rows.agg((F.max("ms") - delay_ms).alias("watermark"))
    following = F.expr("lead(ms) over (partition by symbol, feature order by ms)")
    gaps = rows.withColumn("next", following).filter("ttl > 0 and (next is null or next - ms > ttl)")
    both = F.array(F.struct((F.col("ms") + F.col("ttl")).alias("at"), F.lit("stale").alias("event")), F.struct(F.col("next").alias("at"), F.lit("recovered").alias("event")))
    found = gaps.select("symbol", "feature", F.inline(both)).filter("at is not null")
    return found.join(F.broadcast(last), F.col("at") <= F.col("watermark")).drop("watermark")  # one row


class _Changes(StatefulProcessor):
    """The last target of a symbol and the place of the tick behind it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "target long, known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["datetime_ns", "row_hash"])
        held = self.last.get() if self.last.exists() else None
        targets = batch["target"].astype("Int64")
        before = targets.shift(1)
        changed = ~((targets == before) | (targets.isna() & before.isna())).fillna(False).astype(bool)
        first = targets.iloc[0]
        changed.iloc[0] = held is None or (held[0] if held[1] else pd.NA) is not first and not (held[1] and not pd.isna(first) and held[0] == first)
        last = targets.iloc[-1]
        self.last.update((0 if pd.isna(last) else int(last), not pd.isna(last)))
        yield batch[changed.to_numpy()][["symbol", "datetime_ns", "row_hash", "target"]].astype({"target": "Int64"})

    def close(self) -> None:
        pass


def target_of(up: Column, down: Column, threshold_up: float, threshold_down: float, size: int = 1) -> Column:
    """size if up is above its threshold, else -size if down is above its own, else 0; 0 without a prediction."""
    return F.when(up > threshold_up, size).when(down > threshold_down, -size).otherwise(0).cast("long")


def score_changes(ticks: DataFrame, model: PipelineModel, target: Column) -> DataFrame:
    """Ticks (symbol, datetime_ns, row_hash) at which the target of the model's prediction changes, with the target.

    The fitted pipeline runs on the stream inside the JVM; target is an
    expression over its output columns.  The first tick of a symbol counts as
    a change.  Ticks of a micro-batch are put in order; a tick that arrives a
    batch late is compared with the target then known.
    """
    scored = model.transform(ticks).select("symbol", "datetime_ns", "row_hash", target.cast("long").alias("target")).filter("symbol is not null")
    return scored.groupBy("symbol").transformWithStateInPandas(_Changes(), "symbol string, datetime_ns long, row_hash long, target long", "Append", "None")
