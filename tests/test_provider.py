"""Tick providers as a data source: batch and stream agree, filters read fewer partitions."""

import datetime as dt
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from tickweave.sources import provider
from tickweave.streaming import state

FIELDS = "symbol string, trading_day date, datetime_ns long, price double"
DAY = dt.date(2024, 1, 1)


class Listed(provider.TickProvider):
    """Ticks of a few symbols and days, made on request; notes what was asked for in a folder."""

    schema = FIELDS

    def __init__(self, days, log):
        self.n_days, self.log = days, log

    def keys(self):
        return [(s, DAY + dt.timedelta(days=d)) for d in range(self.n_days) for s in ("a", "b", "c")]

    def ticks(self, symbol, day):
        open(f"{self.log}/{symbol}-{day}", "w").close()
        n = (day - DAY).days + 1
        for part in range(2):
            yield pa.RecordBatch.from_pydict({"symbol": [symbol] * n, "trading_day": [day] * n, "datetime_ns": [part * 100 + i for i in range(n)], "price": [None] * n}, pa.schema([("symbol", pa.string()), ("trading_day", pa.date32()), ("datetime_ns", pa.int64()), ("price", pa.float64())]))


def _asked(log):
    import os

    found = sorted(os.listdir(log))
    for f in found:
        os.remove(f"{log}/{f}")
    return found


def test_filters_reach_the_partitions(spark):
    log = tempfile.mkdtemp(prefix="spark-")
    provider.register(spark, "listed", Listed(5, log))
    rows = spark.read.format("listed").load()
    assert rows.count() == 2 * 3 * 15 and len(_asked(log)) == 15
    some = rows.filter((F.col("symbol") == "b") & (F.col("trading_day") >= "2024-01-03") & (F.col("trading_day") < "2024-01-05") & (F.col("datetime_ns") < 100))
    assert some.count() == 3 + 4 and _asked(log) == ["b-2024-01-03", "b-2024-01-04"]
    assert rows.filter(F.col("symbol").isin("a", "c") & (F.col("trading_day") == "2024-01-02")).count() == 8 and len(_asked(log)) == 2
    assert rows.filter("symbol = 'none'").count() == 0 and rows.filter("symbol is null").count() == 0
    assert rows.filter((F.col("symbol") == "a") | (F.col("datetime_ns") == 0)).count() == 2 * 15 + 10  # not pushed


def test_stream_reads_what_batch_reads_and_goes_on_at_its_offset(spark):
    log, root = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for n_days in (2, 2, 4):
        provider.register(spark, "growing", Listed(n_days, log))
        state.run(spark.readStream.format("growing").load(), f"{root}/state", f"{root}/out")
        got = spark.read.parquet(f"{root}/out").select("symbol", "trading_day", "datetime_ns", "price")
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.format("growing").load().collect()))
    assert spark.read.parquet(f"{root}/out").count() == 2 * 3 * 10


def test_empty_provider_and_dimensions(spark):
    log = tempfile.mkdtemp(prefix="spark-")
    provider.register(spark, "nothing", Listed(0, log))
    assert spark.read.format("nothing").load().count() == 0
    assert provider.contracts_of(spark, Listed(0, log)).isEmpty() and provider.calendar_of(spark, Listed(0, log)).isEmpty()
    assert [tuple(r) for r in provider.contracts_of(spark, Listed(3, log)).collect()] == [(s, DAY, DAY + dt.timedelta(days=2)) for s in "abc"]
    assert provider.calendar_of(spark, Listed(3, log)).count() == 3
