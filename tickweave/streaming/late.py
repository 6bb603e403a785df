"""Late ticks: a side table, a ledger of batches, and days built again when ticks arrive for them.

A stream's batches go through ``DayTable.take``.  A tick behind the watermark
is marked late.  A day is built once the watermark has left it, and again when
late ticks of it arrive.  Every folder belongs to one batch and is overwritten
by it; a batch counts from the moment its ledger row is there.  So a batch that
fails or is replayed changes nothing twice, and readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("symbol", "datetime_ns", "row_hash")
LEDGER = "batch long, max_ns long, watermark_ns long, n_ticks long, n_late long, days array<date>"


class DayTable:
    """Ticks (KEYS, trading_day and more) under root, and what build(ticks of whole days) makes of each day.

    build returns rows with trading_day, each day's from that day's ticks
    alone.  Repeated ticks count once.  delay_s is how far the watermark stays
    behind the newest tick of earlier batches.
    """

    def __init__(self, spark: SparkSession, root: str, build: Callable[[DataFrame], DataFrame], delay_s: int):
        self.spark, self.root, self.build, self.delay_ns = spark, root.rstrip("/"), build, delay_s * 1_000_000_000

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def ledger(self) -> DataFrame:
        """A row for each batch taken: newest tick so far, watermark after it, ticks, late ticks, days built."""
        if not self._exists(f"{self.root}/ledger"):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")

    def ticks(self) -> DataFrame:
        """All ticks of the batches in the ledger, with batch and is_late."""
        return self.spark.read.parquet(f"{self.root}/ticks").join(self.ledger().select("batch"), "batch", "left_semi")

    def late(self) -> DataFrame:
        """The side table: ticks that came behind the watermark."""
        return self.ticks().filter("is_late")

    def built(self) -> DataFrame:
        """The newest rows of every day that was built."""
        newest = self.ledger().select("batch", F.explode("days").alias("trading_day")).groupBy("trading_day").agg(F.max("batch").alias("batch"))
        return self.spark.read.parquet(f"{self.root}/built").join(newest, ["trading_day", "batch"], "left_semi").drop("batch")

    def take(self, batch: DataFrame, number: int) -> None:
        """Handler for foreachBatch: note the batch's ticks, build the days it closes or mends, enter it in the ledger."""
        if self._exists(f"{self.root}/ledger/batch={number}"):
            return
        before = self.ledger().agg(F.max("max_ns"), F.max("watermark_ns")).first()
        known, watermark = (before[0], before[1]) if before[0] is not None else (None, None)
        is_late = F.col("datetime_ns") < watermark if watermark is not None else F.lit(False)
        own = f"{self.root}/ticks/batch={number}"
        batch.withColumn("is_late", is_late).write.mode("overwrite").parquet(own)
        ticks = self.spark.read.parquet(own)
        seen = ticks.agg(F.max("datetime_ns"), F.count("*"), F.count_if("is_late")).first()
        newest = max((x for x in (known, seen[0]) if x is not None), default=None)
        days = []
        if newest is not None:
            passed = newest - self.delay_ns
            closed = lambda ns: F.col("trading_day") < F.to_date(F.timestamp_seconds(F.lit(ns // 1_000_000_000)))
            every = self.spark.read.parquet(f"{self.root}/ticks").join(self.ledger().select("batch").unionByName(self.spark.createDataFrame([(number,)], "batch long")), "batch", "left_semi")
            open_before = ~closed(watermark) if watermark is not None else F.lit(True)
            fresh = every.filter(closed(passed) & open_before).select("trading_day")
            mended = ticks.filter(closed(passed) & F.col("is_late")).select("trading_day")
            days = sorted(r[0] for r in fresh.unionByName(mended).distinct().collect())  # calendar days
            rows = every.filter(F.col("trading_day").isin(days) if days else F.lit(False)).drop("batch", "is_late").dropDuplicates(list(KEYS))
            self.build(rows).write.mode("overwrite").parquet(f"{self.root}/built/batch={number}")
            watermark = passed
        self.spark.createDataFrame([(newest, watermark, seen[1], seen[2], days)], "max_ns long, watermark_ns long, n_ticks long, n_late long, days array<date>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={number}")
