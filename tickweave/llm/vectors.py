"""Vector columns, blocks of vectors and merging of per-block best lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SCHEMA = "grp long, ids binary, mat binary, n int, dim int, least double, most double"


def usable(vec: Column) -> Column:
    """True for a non-empty vector without null, NaN or infinite components."""
    x = vec.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & good, F.lit(False))


def length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def to_blocks(rows: DataFrame, dtype: str) -> DataFrame:
    """Rows (grp long, id long, vec array) to one row for each grp: ids and matrix as bytes, longest vector first.

    Identical rows of one id collapse here.  The caller bounds the rows of a
    grp, and gives vectors of another dimension another grp.
    """

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        mat = np.stack([np.asarray(v, dtype=dtype) for v in pdf["vec"]])
        ids = pdf["id"].to_numpy(np.int64)
        norm = np.sqrt((mat.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        ids, mat, norm = ids[order], mat[order], norm[order]
        if len(np.unique(ids)) < len(ids):
            seen: set[tuple[int, bytes]] = set()
            keep = [i for i in range(len(ids)) if (k := (int(ids[i]), mat[i].tobytes())) not in seen and not seen.add(k)]
            ids, mat, norm = ids[keep], mat[keep], norm[keep]
        row = {"grp": int(pdf["grp"].iloc[0]), "ids": ids.tobytes(), "mat": mat.tobytes(), "n": len(ids), "dim": mat.shape[1], "least": float(norm[-1]), "most": float(norm[0])}
        return pd.DataFrame([row])

    return rows.groupBy("grp").applyInPandas(built, BLOCK_SCHEMA)


def unpack(ids: bytes, mat: bytes, dim: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(mat, dtype).reshape(-1, dim)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct candidates of each query: highest score, ties to the smaller id."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def batches_of_rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.itertuples(index=False)
