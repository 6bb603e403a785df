"""The factor registry's incremental half: every registered factor over a stream, as in batch.

Factors without lookback are their own Columns, so they stay in the JVM.  A
factor with lookback has a step over the trail of its symbol, registered beside
its Column; the trail holds the ticks that a step may look back to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.features import FACTORS
from tickweave.streaming.ordered import InOrder

KEYS = ["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id"]


@dataclass(frozen=True)
class Trail:
    """Ticks of a symbol in order, those kept from earlier batches first.

    columns: inputs, null as NaN; run: rises at each roll; day: number of the
    tick's available day.
    """

    columns: dict[str, np.ndarray]
    run: np.ndarray
    day: np.ndarray

    def _shifted(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values)
        return np.append(np.full(min(k, n), np.nan), values[: max(0, n - k)])

    def near(self, k: int) -> np.ndarray:
        """Where the tick k back is of the same run and at most one available day older."""
        return (self._shifted(self.run.astype(np.float64), k) == self.run) & (self._shifted(self.day.astype(np.float64), k) >= self.day - 1)

    def back(self, values: np.ndarray, k: int) -> np.ndarray:
        """The value k ticks back, NaN where there is none near."""
        return np.where(self.near(k), self._shifted(values, k), np.nan)

    def deviation(self, values: np.ndarray, k: int) -> np.ndarray:
        """Sample deviation of the last k values, NaN unless all are there."""
        out = np.full(len(values), np.nan)
        if len(values) >= k:
            out[k - 1 :] = np.lib.stride_tricks.sliding_window_view(values, k).std(axis=1, ddof=1)
        return out

    @property
    def mid(self) -> np.ndarray:
        return (self.columns["bid_price1"] + self.columns["ask_price1"]) / 2


Step = Callable[[Trail], np.ndarray]
STEPS: dict[str, Step] = {}


def register_step(name: str) -> Callable[[Step], Step]:
    """Decorator: the step of a registered factor; it gives a value for each tick of the trail, NaN as null."""

    def added(step: Step) -> Step:
        STEPS[name] = step
        return step

    return added


def _return(trail: Trail, k: int) -> np.ndarray:
    mid, old = trail.mid, trail.back(trail.mid, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(old != 0, mid / old - 1, np.nan)


@register_step("return_10")
def _return_10(trail: Trail) -> np.ndarray:
    return _return(trail, 10)


@register_step("volatility_20")
def _volatility_20(trail: Trail) -> np.ndarray:
    return np.where(trail.near(20), trail.deviation(_return(trail, 1), 20), np.nan)


@register_step("volume_delta_10")
def _volume_delta_10(trail: Trail) -> np.ndarray:
    volume = trail.columns["volume"]
    return volume - trail.back(volume, 10)


@register_step("oi_delta_10")
def _oi_delta_10(trail: Trail) -> np.ndarray:
    interest = trail.columns["open_interest"]
    return interest - trail.back(interest, 10)


def incremental_factors(stream: DataFrame, names: list[str] | None = None) -> DataFrame | InOrder:
    """KEYS and the factors of each tick of a stream, by the batch rules, for run_to_end; all registered ones without names.

    State is one trail for each symbol: as many ticks as the longest lookback
    and one, cleared at a roll.  Ticks of a micro-batch pass in order, an Arrow
    batch at a time; later ones must not be older.  Other columns of the stream
    are left out.  A factor with lookback and no step is an error.
    """
    names = list(FACTORS) if names is None else names
    rolling = [n for n in names if FACTORS[n].lookback > 0]
    if lacking := [n for n in rolling if n not in STEPS]:
        raise ValueError(f"no step for {', '.join(lacking)}")
    plain = [n for n in names if n not in rolling]
    inputs = list(dict.fromkeys(c for n in rolling for c in FACTORS[n].inputs))
    held = [f"_in_{i}" for i in range(len(inputs))]
    ready = stream.select(*KEYS, *[FACTORS[n].build().cast("double").alias(n) for n in plain], *[F.col(c).cast("double").alias(h) for c, h in zip(inputs, held, strict=True)])
    if not rolling:
        return ready.select(*KEYS, *names)
    ring = max(FACTORS[n].lookback for n in rolling) + 1

    def step(symbol: str | None, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        segment, ordinal, day, old, old_days = state or (-1, 0, "", [np.array([]) for _ in inputs], [])
        kept = len(old_days)
        name = rows["trading_day"].astype(str).to_numpy()
        days = np.append(np.array(old_days, np.int64), ordinal + np.cumsum(name != np.append([day], name[:-1])))
        own = rows["segment_id"].fillna(-1).to_numpy(np.int64)
        run = np.append(np.zeros(kept, np.int64), np.cumsum(own != np.append([segment], own[:-1])))
        values = {c: np.append(past, rows[h].to_numpy(np.float64)) for c, h, past in zip(inputs, held, old, strict=True)}
        trail = Trail(values, run, days)
        out = rows[[*KEYS, *plain]].reset_index(drop=True)
        for n in rolling:
            found = STEPS[n](trail)[kept:]
            out[n] = pd.array(np.where(np.isnan(found), None, found), dtype="Float64")
        last = np.flatnonzero(run == run[-1])[-ring:]
        return out, (int(own[-1]), int(days[-1]), str(name[-1]), [values[c][last] for c in inputs], days[last])

    types = {f.name: f.dataType.simpleString() for f in ready.schema}
    types |= dict.fromkeys(rolling, "double")
    return InOrder(ready, step, ", ".join(f"`{c}` {types[c]}" for c in (*KEYS, *names)))
