"""Streams whose ticks pass a step in order, a bounded number at a time.

A micro-batch may hold a whole table, as files are never cut.  So Spark sorts it
by symbol and time, on disk where it must, and a task gives each symbol's ticks
to the step an Arrow batch at a time; what the step carries on is the symbol's
state, a row of each micro-batch's output.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[str | None, pd.DataFrame, object], tuple[pd.DataFrame, object]]


@dataclass(frozen=True)
class InOrder:
    """A stream with symbol, datetime_ns and row_hash, and the step its ticks pass in that order.

    step: symbol, some of its next ticks and its state (None at first) give
    rows of ``schema``, which has the symbol, and the next state.  Later
    micro-batches must not be older.  A symbol's ticks of a micro-batch pass
    one task, one Arrow batch of them at a time.
    """

    stream: DataFrame
    step: Step
    schema: str

    def run_to_end(self, path: str) -> DataFrame:
        """Everything that is there, micro-batch by micro-batch, written to path/out and returned; a repeated micro-batch replaces its own output."""
        spark = self.stream.sparkSession
        query = self.stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda batch, n: self._work(batch, n, f"{path}/out")).start()
        query.awaitTermination()
        return self._written(spark, f"{path}/out").filter("_state is null").drop("_state", "batch")

    def _written(self, spark: SparkSession, out: str) -> DataFrame:
        return spark.read.schema(f"{self.schema}, _state binary, batch long").parquet(out)

    def _work(self, batch: DataFrame, number: int, out: str) -> None:
        rows = batch.withColumn("_state", F.lit(None).cast("binary"))
        if number:
            before = self._written(batch.sparkSession, out).filter((F.col("batch") < number) & F.col("_state").isNotNull()).groupBy("symbol").agg(F.max_by("_state", "batch").alias("_state"))
            # no nulls among numbers: pandas would make them floats
            empty = lambda f: F.lit(0 if isinstance(f.dataType, T.NumericType) else None).cast(f.dataType).alias(f.name)
            rows = rows.unionByName(before.select("symbol", "_state", *[empty(f) for f in batch.schema if f.name != "symbol"]))
        ordered = rows.repartition("symbol").sortWithinPartitions("symbol", F.col("_state").isNull(), F.asc_nulls_last("datetime_ns"), F.asc_nulls_last("row_hash"))
        ordered.mapInPandas(self._worker(), f"{self.schema}, _state binary").write.mode("overwrite").parquet(f"{out}/batch={number}")

    def _worker(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        step, columns = self.step, [*T.StructType.fromDDL(self.schema).names, "_state"]

        def closing(symbol: str | None, state: object) -> pd.DataFrame:
            return pd.DataFrame({c: pd.Series([{"symbol": symbol, "_state": pickle.dumps(state)}.get(c)], dtype=object) for c in columns})

        def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            for batch in batches:
                for symbol, part in batch.groupby("symbol", sort=False, dropna=False):
                    symbol = None if pd.isna(symbol) else symbol
                    if now != (symbol,):
                        if now:
                            yield closing(*now, state)
                        now, state = (symbol,), None
                    if part["_state"].iloc[0] is not None:
                        state, part = pickle.loads(part["_state"].iloc[0]), part.iloc[1:]
                    if len(part):
                        out, state = step(symbol, part.drop(columns="_state"), state)
                        yield out.assign(_state=None)[columns]
            if now:
                yield closing(*now, state)

        return worked
