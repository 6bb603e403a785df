"""Approximate nearest neighbours on shifted space-filling curves (operator 5).

Every vector is projected to a few dimensions by several random rotations, put
on a shifted grid and given its Hilbert key; Spark range-partitions each curve
by key.  WINDOW vectors that follow each other on a curve form a window of
neighbouring keys, which keeps their mean and spread.  A query visits the
windows of all curves that let expect the largest products with it, a share of
them; what it meets there merges and is reranked by exact inner products.

How many windows: rows in visited windows, over all curves, are the share
max(LEAST_SHARE, SHARE * n ^ -DECAY) of the n vectors and at least LEAST_ROWS.
Larger tables have nearer neighbours and need a smaller share for the same
recall; below LEAST_SHARE it doesn't fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tickweave.llm.common import cut
from tickweave.llm.vectors import batches_of_rows, best, usable

CURVES, DIMS, BITS = 4, 12, 3
WINDOW = 16
LEAST_SHARE, SHARE, DECAY, LEAST_ROWS = 0.3, 3.3, 0.21, 1600
#: What a window's best vector lies above its mean, in deviations: the expected largest of 16 normal values.
ABOVE = 1.77
#: Rows on which grid edges are fitted, and windows on which a query's bound is; both drawn by hash.
FIT_ROWS, FIT_WINDOWS = 4096, 8192
BLOCK, QUERIES, LANE = 4096, 512, 8
BLOCK_SCHEMA = "dim int, curve int, n int, ids binary, mat binary, windows binary"
ASKED_SCHEMA = "dim int, q_ids binary, q_mat binary, bounds binary"


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned grid coordinates (dims * bits <= 63)."""
    x = [grid[:, i].astype(np.int64) for i in range(grid.shape[1])]
    zero, m = np.int64(0), len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(m):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, zero, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(inverted, below, zero) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, zero)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | (((x[i] ^ flip) >> level) & 1)
    return key


def _projected(mat: np.ndarray, curve: int, dims: int) -> np.ndarray:
    """Directions of vectors under the rotation of a curve, which depends on curve and dimension alone."""
    d = mat.shape[1]
    basis = np.linalg.qr(np.random.default_rng(1000 + curve).standard_normal((d, min(dims, d))))[0]
    return (mat / np.maximum(np.sqrt((mat**2).sum(1, keepdims=True)), 1e-300)) @ basis


def grid_edges(sample: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """(dims, 2^bits - 1) inner edges of a curve's grid: quantiles of the sample, shifted by up to most of a cell."""
    at = _projected(sample, curve, dims)
    shift = np.random.default_rng(2000 + curve).uniform(0, 0.8, at.shape[1])
    cells = 2**bits
    return np.stack([np.quantile(at[:, i], np.clip((np.arange(1, cells) - shift[i]) / (0.9 * cells), 0, 1)) for i in range(at.shape[1])])


def projected_keys(mat: np.ndarray, curve: int, edges: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of the directions of vectors on one shifted curve."""
    at = _projected(mat, curve, dims)
    return hilbert_keys(np.stack([np.searchsorted(edges[i], at[:, i], side="right") for i in range(at.shape[1])], 1), bits)


def visited_share(n: int, window: int = WINDOW, curves: int = CURVES) -> float:
    """The share of all windows that a query visits in a table of n vectors."""
    return min(1.0, max(LEAST_SHARE, SHARE * n**-DECAY, LEAST_ROWS / n) / curves)


def windows_of(mat: np.ndarray, window: int) -> np.ndarray:
    """(windows, d + 1): mean of each run of ``window`` vectors, and ABOVE deviations of its vectors in a direction."""
    starts = np.arange(0, len(mat), window)
    size = np.diff(np.append(starts, len(mat)))[:, None]
    mat = mat.astype(np.float64)
    mean = np.add.reduceat(mat, starts, axis=0) / size
    spread = np.add.reduceat((mat**2).sum(1, keepdims=True), starts, axis=0) / size - (mean**2).sum(1, keepdims=True)
    return np.hstack((mean, ABOVE * np.sqrt(np.maximum(spread, 0) / mat.shape[1])))


def expected_products(windows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(windows, queries): what a window's best vector lets expect."""
    length = np.sqrt((queries**2).sum(1, keepdims=True))
    return windows @ np.hstack((queries, length)).T


class _Nearest:
    """The k best distinct candidates of each of a block's queries so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.found, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        keep = found != self.ids[query]
        query, found, score = (np.concatenate((a, b[keep])) for a, b in ((self.query, query), (self.found, found), (self.score, score)))
        order = np.lexsort((-score, found, query))  # of an id met twice the higher score stays
        query, found, score = query[order], found[order], score[order]
        first = np.ones(len(query), bool)
        first[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
        query, found, score = query[first], found[first], score[first]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        begin = np.searchsorted(query, np.arange(len(self.ids)))
        near = np.arange(len(query)) - begin[query] < self.k
        self.query, self.found, self.score = query[near], found[near], score[near]
        last = np.searchsorted(self.query, np.arange(len(self.ids)), side="right") - 1
        full = np.bincount(self.query, minlength=len(self.ids)) >= self.k
        self.least[full] = self.score[last[full]]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.query], "vec_id": self.found, "score": self.score})


def search(
    embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    curves: int = CURVES, dims: int = DIMS, window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query, by largest inner product.

    Queries are the rows marked by is_query, candidates all rows with another
    id; the index holds every usable row.  Null, empty and zero vectors and
    those with null or non-finite components take no part; a query meets only
    candidates of its own dimension.  Ties go to the smaller id; identical
    repeated rows count once, of different vectors of one id the better; an
    empty table gives no rows.  Scores are double-precision products of the
    original vectors.
    """
    spark = embeddings.sparkSession
    stored = embeddings.schema[vec_col].dataType
    dtype = "<f4" if isinstance(stored, ArrayType) and isinstance(stored.elementType, FloatType) else "<f8"
    vec = F.col(vec_col).cast("array<double>")
    rows = embeddings.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull() & F.exists(vec, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    edges = {(d, c): grid_edges(np.unique(np.array(v), axis=0), c, dims) for d, v in by_dim.items() for c in range(curves)}

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["vec"].map(len)):
                mat = np.stack(part["vec"].to_list())
                out = pd.DataFrame({"dim": d, "id": part["id"], "vec": [v.astype(dtype).tobytes() for v in mat]})
                for c in range(curves):
                    # a dimension too rare for the fit has edges of its own batch's kind: one cell
                    known = edges.get((d, c), np.full((min(dims, d), 2**BITS - 1), np.inf))
                    yield out.assign(curve=c, key=projected_keys(mat, c, known, dims))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), curves)
    ordered = rows.select("id", "vec").mapInPandas(keyed, "dim int, id long, vec binary, curve int, key long").repartitionByRange(parts, "dim", "curve", "key", "id").sortWithinPartitions("dim", "curve", "key", "id")

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(part: pd.DataFrame) -> dict:
            d = int(part["dim"].iloc[0])
            mat = np.frombuffer(b"".join(part["vec"]), dtype).reshape(-1, d)
            return {"dim": d, "curve": int(part["curve"].iloc[0]), "n": len(part), "ids": part["id"].to_numpy(np.int64).tobytes(), "mat": mat.tobytes(), "windows": windows_of(mat, window).tobytes()}

        rest, last, copies = None, (), {}
        cell = ["dim", "curve", "key"]
        for batch in batches:
            batch = batch.drop_duplicates([*cell, "id", "vec"])
            if not len(batch):
                continue
            # of equal vectors only those with the k + 1 smallest ids can be among the k nearest of any query
            nth = batch.groupby([*cell, "vec"], sort=False).cumcount()
            again = (batch[cell] == pd.Series(last, cell)).all(axis=1) if last else pd.Series(False, batch.index)
            nth = nth + batch["vec"].map(copies).fillna(0).where(again, 0)
            now = tuple(batch[cell].iloc[-1])
            ending = (batch[cell] == pd.Series(now, cell)).all(axis=1)
            copies = (copies if now == last else {}) | (nth[ending] + 1).groupby(batch["vec"][ending]).max().to_dict()
            last, batch = now, batch[nth <= k]
            rest = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            groups = [g for _, g in rest.groupby(["dim", "curve"], sort=True)]
            for i, g in enumerate(groups):
                full = len(g) if i < len(groups) - 1 else len(g) // block * block
                for a in range(0, full, block):
                    yield pd.DataFrame([row(g.iloc[a : min(a + block, full)])])
            rest = groups[-1].iloc[len(groups[-1]) // block * block :] if groups else rest
        if rest is not None and len(rest):
            yield pd.DataFrame([row(rest)])

    blocks = cut(ordered.mapInPandas(blocked, BLOCK_SCHEMA))
    sizes = {r["dim"]: r["n"] for r in blocks.filter("curve = 0").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rate = min(1.0, FIT_WINDOWS / (curves * sum(-(-n // window) for n in sizes.values())))

    def some_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches_of_rows(batches):
            all_ = np.frombuffer(r.windows).reshape(-1, r.dim + 1)
            chosen = all_[np.random.default_rng(int(np.frombuffer(r.ids, np.int64)[0]) & (2**63 - 1)).random(len(all_)) < rate]
            yield pd.DataFrame({"dim": [r.dim], "windows": [chosen.tobytes()]})

    # about FIT_WINDOWS windows: a bounded table in the driver, and a bounded broadcast
    sample: dict[int, list] = {}
    for r in blocks.mapInPandas(some_windows, "dim int, windows binary").collect():
        sample.setdefault(r["dim"], []).append(np.frombuffer(r["windows"]).reshape(-1, r["dim"] + 1))
    shared = spark.sparkContext.broadcast({d: np.concatenate(m) for d, m in sample.items()})

    def bounded(part: pd.DataFrame) -> pd.DataFrame:
        mat = np.stack(part["vec"].to_list())
        drawn_windows = shared.value.get(mat.shape[1], np.zeros((0, mat.shape[1] + 1)))
        leave = len(drawn_windows) - int(np.ceil(visited_share(sizes[mat.shape[1]], window, curves) * len(drawn_windows)))
        bounds = np.partition(expected_products(drawn_windows, mat), leave, axis=0)[leave] if leave > 0 else np.full(len(part), -np.inf)
        return pd.DataFrame([{"dim": mat.shape[1], "q_ids": part["id"].to_numpy(np.int64).tobytes(), "q_mat": mat.astype(dtype).tobytes(), "bounds": bounds.tobytes()}])

    queries = rows.filter("asks").select(F.size("vec").alias("dim"), "id", "vec").dropDuplicates(["id", "vec"])
    slots = -(-queries.count() // QUERIES)
    if not slots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = cut(queries.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots))).groupBy("dim", "slot").applyInPandas(bounded, ASKED_SCHEMA))
    # every lane of about LANE blocks meets all queries; their number grows with the table, not with the partitions
    lanes = max(1, -(-curves * sum(sizes.values()) // (LANE * block)))
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes))).select("dim", "lane", "ids", "mat", "windows")
    asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))

    def reranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, key = None, None
        for r in batches_of_rows(batches):
            if r.q_ids != key:
                if near is not None:
                    yield near.rows()
                key, q = r.q_ids, np.frombuffer(r.q_mat, dtype).reshape(-1, r.dim).astype(np.float64)
                near, bounds = _Nearest(np.frombuffer(r.q_ids, np.int64), k), np.frombuffer(r.bounds)
            ids, c = np.frombuffer(r.ids, np.int64), np.frombuffer(r.mat, dtype).reshape(-1, r.dim).astype(np.float64)
            visits = expected_products(np.frombuffer(r.windows).reshape(-1, r.dim + 1), q) >= bounds - 1e-9 * (1 + np.abs(np.where(np.isfinite(bounds), bounds, 0)))
            which, met = [], []
            for w in np.flatnonzero(visits.any(1)):
                who = np.flatnonzero(visits[w])
                scores = c[w * window : (w + 1) * window] @ q[who].T
                i, j = np.nonzero(scores >= near.least[who] - 1e-9 * (1 + np.abs(np.where(np.isfinite(near.least[who]), near.least[who], 0))))
                met.append(i + w * window)
                which.append(who[j])
            if met:
                which, met = np.concatenate(which), np.concatenate(met)
                for at in range(0, len(met), 200_000):
                    a, b = met[at : at + 200_000], which[at : at + 200_000]
                    near.add(b, ids[a], (c[a] * q[b]).sum(1))  # the same sum wherever the pair is met
        if near is not None:
            yield near.rows()

    pairs = asked.join(dealt, ["dim", "lane"]).select("dim", "q_ids", "q_mat", "bounds", "ids", "mat", "windows")
    found = pairs.mapInPandas(reranked, "query_id long, vec_id long, score double")
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
