"""Whitening of embeddings by a bidiagonal qd solver (operator 11).

Vectors are scaled to integers, so sums and deviations are exact.  Every task
reduces its centred rows to a triangular factor, block after block; the
factors merge FAN at a time in Spark until one is left.  Its d x d entries,
which don't grow with the rows, go to the driver, where ``bidiagonal`` finds
the components.  A second pass over the fit list measures what they whiten.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.bidiagonal import principal
from tickweave.llm.common import cut
from tickweave.llm.vectors import usable

#: Entries are multiplied by this and floored.
SCALE = 256
#: Partial results that one task merges, and rows of a block of the blockwise QR.
FAN, BLOCK_ROWS = 32, 4096
_LONG = 2**63 - 1


@dataclass
class Model:
    """Fit of the vectors of one dimension: n distinct ones with sums, eigenvalues and components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def _span(x: np.ndarray, n: int, sums: list[int]) -> int:
    """Bound of |n * x - sums|."""
    return n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n; the numerators are exact while they fit 64 bits."""
    if _span(x, n, sums) <= _LONG:
        return (x * n - np.array(sums, np.int64)) / n
    return ((x.astype(object) * n - np.array(sums, object)) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over entries of (n * x - sums)^2 of each row; None beyond 64 bits."""
    if _span(x, n, sums) ** 2 * x.shape[1] <= _LONG:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v <= _LONG else None for v in exact]


def by_dimension(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their matrix) for each dimension."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, vectors.take(pa.array(rows)).flatten().to_numpy().reshape(-1, int(d))


def _folded(vectors: DataFrame, add: Callable, merge: Callable) -> dict[int, object]:
    """What all vectors (column x) of each dimension add up to.

    ``add(state or None, matrix)`` takes in a block within a task, and
    ``merge(states)`` joins up to FAN states; a state is of the size of one task's.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for _, x in by_dimension(batch.column(0)):
                for a in range(0, len(x), BLOCK_ROWS):
                    states[x.shape[1]] = add(states.get(x.shape[1]), x[a : a + BLOCK_ROWS])
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"dim": d, "slot": slot, "state": pickle.dumps(s)} for d, s in sorted(states.items())], pa.schema([("dim", pa.int32()), ("slot", pa.int64()), ("state", pa.binary())]))

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        state = merge([pickle.loads(s) for s in part.sort_values("slot")["state"]])
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "slot": part["slot"].iloc[:1] // FAN, "state": [pickle.dumps(state)]})

    parts = cut(vectors.select("x").mapInArrow(partial, "dim int, slot long, state binary"))
    most = parts.agg(F.max("slot")).first()[0] or 0
    while True:
        parts = parts.groupBy("dim", F.floor(F.col("slot") / FAN).alias("to")).applyInPandas(joined, "dim int, slot long, state binary")
        most //= FAN
        if not most:
            return {r["dim"]: pickle.loads(r["state"]) for r in parts.select("dim", "state").collect()}


def _add_sums(state: tuple[int, list[int]] | None, x: np.ndarray) -> tuple[int, list[int]]:
    exact = x.sum(0) if _span(x, len(x), [0]) <= _LONG else x.astype(object).sum(0)
    n, sums = state or (0, [0] * x.shape[1])
    return n + len(x), [a + int(b) for a, b in zip(sums, exact, strict=True)]


def _merge_sums(states: list[tuple[int, list[int]]]) -> tuple[int, list[int]]:
    return sum(n for n, _ in states), [sum(column) for column in zip(*(s for _, s in states), strict=True)]


def _add_moments(state: tuple | None, z: np.ndarray) -> tuple:
    mean = z.mean(0)
    own = (len(z), mean, (z - mean).T @ (z - mean))
    return own if state is None else _merge_moments([state, own])


def _merge_moments(states: list[tuple]) -> tuple:
    """Counts, means and centred products of several parts as those of their union."""
    n = sum(s[0] for s in states)
    mean = sum(s[0] * s[1] for s in states) / n
    return n, mean, sum(s[2] + s[0] * np.outer(s[1] - mean, s[1] - mean) for s in states)


def fit(distinct: DataFrame, k: int) -> dict[int, Model]:
    """Model of each dimension; distinct has every integer vector once, as column x.

    Components are those with an eigenvalue above rounding (d * eps of the
    largest singular value), k at most; equal vectors alone give none.
    """
    sums = _folded(distinct, _add_sums, _merge_sums)

    def add_rows(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        c = centred(x, *sums[x.shape[1]])
        return np.linalg.qr(c if r is None else np.vstack((r, c)), mode="r")

    factors = _folded(distinct, add_rows, lambda rs: np.linalg.qr(np.vstack(rs), mode="r"))
    models = {}
    for d, r in factors.items():
        n, total = sums[d]
        squares, components = principal(r, k)
        models[d] = Model(n, total, squares / n, components, float((r**2).sum()) / n)
    moments = _folded(distinct, lambda s, x: _add_moments(s, whitened(x, models[x.shape[1]])), _merge_moments)
    for d, (n, _, products) in moments.items():
        models[d].identity_error = float(np.abs(products / n - np.eye(len(products))).max(initial=0.0))
    return models


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Integer vectors centred, projected on the components and scaled to unit variance."""
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.values)


def whiten(embeddings: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and its first k components.

    Null and empty vectors and those with null or non-finite entries take no
    part.  Every distinct integer vector counts once in the fit, but each row,
    repeated or without an id, has its own results.  Components are numbered
    from 1 by falling eigenvalue; vectors that span fewer than k dimensions
    have fewer, a single one none.  Vectors of another dimension have a fit of
    their own.  A deviation beyond 64 bits is null.  An empty table gives no
    rows; other columns are ignored.
    """
    entries = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * scale))
    rows = embeddings.filter(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("x"))
    models = fit(cut(rows.select("x").distinct()), k)
    shared = embeddings.sparkSession.sparkContext.broadcast(models)  # k vectors of each dimension

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, x in by_dimension(batch.column(1)):
                model = shared.value[x.shape[1]]
                own = len(model.values)
                if not own:
                    continue
                times = np.repeat(which, own)
                columns = [
                    batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, own + 1, dtype=np.int32), len(which))), pa.array(np.full(len(times), model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(which)), own))), pa.array(whitened(x, model).ravel()),
                    pa.array(np.tile(model.values / model.trace, len(which))), pa.array(np.full(len(times), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
