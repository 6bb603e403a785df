"""Tick providers as a Spark data source: a partition for each symbol and day, day offsets for streams.

A provider says which (symbol, day) it has and hands out each one's ticks as
Arrow batches; ``register`` makes it readable by ``spark.read.format`` and
``spark.readStream.format``.  Filters on symbol and trading_day reach the
list of partitions (spark.sql.python.filterPushdown.enabled), so what they
exclude is never asked for.
"""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
Key = tuple[str, dt.date]


class TickProvider(ABC):
    """Historical ticks by symbol and trading day; it is pickled to the tasks."""

    #: DDL of its ticks, with symbol string and trading_day date.
    schema: str

    @abstractmethod
    def keys(self) -> list[Key]:
        """The (symbol, day) that have ticks now; a day that is listed is complete."""

    @abstractmethod
    def ticks(self, symbol: str, day: dt.date) -> Iterator[pa.RecordBatch]:
        """Ticks of one symbol and day, in the order of the schema."""

    def calendar(self) -> list[dt.date]:
        """Trading days, rising."""
        return sorted({day for _, day in self.keys()})

    def contracts(self) -> list[tuple[str, dt.date, dt.date]]:
        """(symbol, first day, last day), by symbol."""
        seen: dict[str, list[dt.date]] = {}
        for symbol, day in self.keys():
            seen.setdefault(symbol, []).append(day)
        return [(s, min(d), max(d)) for s, d in sorted(seen.items())]


class FolderProvider(TickProvider):
    """A Parquet folder partitioned by symbol and trading_day, on a path that all executors can open."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path.removeprefix("file://").removeprefix("file:"), schema
        self.names = [f.name for f in StructType.fromDDL(schema)]

    def _files(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet", partitioning=ds.partitioning(pa.schema([("symbol", pa.string()), ("trading_day", pa.string())]), flavor="hive"))

    def keys(self) -> list[Key]:
        found = set()
        for piece in self._files().get_fragments():
            own = ds.get_partition_keys(piece.partition_expression)
            found.add((own["symbol"], dt.date.fromisoformat(own["trading_day"])))
        return sorted(found, key=lambda k: (k[1], k[0]))

    def ticks(self, symbol: str, day: dt.date) -> Iterator[pa.RecordBatch]:
        mine = (ds.field("symbol") == symbol) & (ds.field("trading_day") == day.isoformat())
        for batch in self._files().to_batches(filter=mine, columns=self.names, use_threads=False):
            if len(batch):
                at = self.names.index("trading_day")
                yield batch.set_column(at, "trading_day", batch.column(at).cast(pa.date32()))


@dataclass
class _Part(InputPartition):
    symbol: str
    day: dt.date


_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, IsNotNull: lambda x, v: True,
}


class _Reader(DataSourceReader):
    def __init__(self, provider: TickProvider):
        self.provider, self.tests = provider, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of symbol and trading_day with values are decided by the list of partitions alone; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            value = getattr(f, "value", None)
            if name in ("symbol", "trading_day") and type(f) in _TESTS and (value is not None or isinstance(f, IsNotNull)):
                self.tests.append((0 if name == "symbol" else 1, type(f), value))
            else:
                yield f

    def partitions(self) -> list[_Part]:
        return [_Part(*key) for key in self.provider.keys() if all(_TESTS[kind](key[at], value) for at, kind, value in self.tests)] or [_Part("", dt.date.min)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.provider.ticks(partition.symbol, partition.day) if partition.symbol else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are days: a batch has the days after its start up to its end."""

    def __init__(self, provider: TickProvider):
        self.provider = provider

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        days = self.provider.calendar()
        return {"day": days[-1].isoformat() if days else ""}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(*key) for key in self.provider.keys() if start["day"] < key[1].isoformat() <= end["day"]]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.provider.ticks(partition.symbol, partition.day)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, name: str, provider: TickProvider) -> None:
    """Make the provider a format of this session; the name may be registered again."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return provider.schema

        def reader(self, schema: StructType) -> _Reader:
            return _Reader(provider)

        def streamReader(self, schema: StructType) -> _StreamReader:
            return _StreamReader(provider)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Source)


def calendar_of(spark: SparkSession, provider: TickProvider) -> DataFrame:
    return spark.createDataFrame([(d,) for d in provider.calendar()], "day date")


def contracts_of(spark: SparkSession, provider: TickProvider) -> DataFrame:
    return spark.createDataFrame(provider.contracts(), "symbol string, first_day date, last_day date")
