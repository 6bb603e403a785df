"""Exact inner-product top-k with norm buckets (operator 4).

Vectors become integers, floor(1024 * x).  Candidates are grouped by length
(half powers of two) and, inside a bucket, dealt to blocks of bounded size.
A first pass over the block with the longest vectors gives each query a lower
bound of its k-th score.  For each pair of a candidate and a query block the
bound turns into a local cosine threshold, bound / (|q| * longest in block):
over 1 for every query of a block the pair is skipped, before any matrix
moves; from HIGH_COSINE on, candidates are pruned by the query's strongest
coordinate; below, by length alone.  Products of what remains are computed
exactly, and lists merge by score and smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import cut
from tickweave.llm.vectors import batches_of_rows, best, length, to_blocks, unpack, usable

SCALE = 1024
BLOCK_ROWS = 1024
QUERY_ROWS = 256
HIGH_COSINE = 0.6
FOUND = "query_id long, vec_id long, score long"


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in double precision while every sum stays below 2^53, else in int64."""
    if not len(c) or not len(q):
        return np.zeros((len(c), len(q)), np.int64)
    peak = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1]
    if peak < 2**53:
        return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if peak >= 2**63:
        raise OverflowError("integer inner products pass the range of a long")
    return c @ q.T


def _survivors(c: np.ndarray, c_norm: np.ndarray, q: np.ndarray, q_norm: float, bound: int) -> np.ndarray:
    """Positions of candidates (longest first) whose product with q can reach the bound."""
    if q_norm == 0 or bound <= 0:
        return np.arange(len(c))
    reach = int(np.searchsorted(-c_norm, -(bound / q_norm) * (1 - 1e-12), side="right"))
    if not reach:
        return np.empty(0, np.int64)
    local = bound / (q_norm * c_norm[0])
    if local < HIGH_COSINE:
        return np.arange(reach)
    f = int(np.abs(q).argmax())
    qf = q[f] / q_norm
    cf = c[:reach, f] / np.maximum(c_norm[:reach], 1e-300)
    limit = qf * cf + np.sqrt(max(0.0, 1 - qf * qf)) * np.sqrt(np.maximum(0.0, 1 - cf * cf))
    return np.flatnonzero(limit * q_norm * c_norm[:reach] >= bound * (1 - 1e-9) - 1e-6)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each query.

    is_query: condition on the input that marks queries; candidates are all
    rows with another id.  Vectors that are null, empty or hold null or
    non-finite components take no part; a query only meets candidates of its
    own dimension.  Ties go to the smaller id.  Identical repeated rows count
    once.  Fewer than k candidates: all of them.  An empty table: no rows.
    Products beyond the range of a long raise an error.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = embeddings.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: F.floor(x * SCALE).cast("long")).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    rows = rows.withColumn("dim", F.size("vec")).withColumn("bucket", F.floor(2 * F.log2(F.greatest(length(F.col("vec")), F.lit(0.5)))).cast("int"))
    # Bounded by the dimensions and the few hundred half powers of two that a double's length can have.
    sizes = sorted((r["dim"], -r["bucket"], r["n"], r["q"]) for r in rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect())
    plan, offset, first, queries = {}, 0, {}, {}
    for dim, neg_bucket, n, q in sizes:
        plan[(dim, -neg_bucket)] = (offset, -(-n // block_rows))
        first.setdefault(dim, offset)
        queries[dim] = queries.get(dim, 0) + q
        offset += -(-n // block_rows)
    if not any(queries.values()):
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = F.create_map(*[x for (d, b), (o, n) in plan.items() for x in (F.lit(f"{d}:{b}"), F.struct(F.lit(o).cast("long").alias("o"), F.lit(n).cast("long").alias("n")))])
    place = spread[F.concat_ws(":", "dim", "bucket")]
    blocks = cut(to_blocks(rows.select((place["o"] + F.pmod(F.xxhash64("id"), place["n"])).alias("grp"), "id", "vec"), "<i8"))
    n_query = F.create_map(*[x for d, q in queries.items() for x in (F.lit(d), F.lit(max(1, -(-q // query_rows))).cast("long"))])
    slot = F.col("dim").cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("id", F.lit(7)), n_query[F.col("dim")])
    query_blocks = to_blocks(rows.filter("is_query").select(slot.alias("grp"), "id", "vec"), "<i8").selectExpr("grp q_grp", "ids q_ids", "mat q_mat", "dim")

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches_of_rows(batches):
            ids, c = unpack(r.ids, r.mat, r.dim, "<i8")
            q_ids, q = unpack(r.q_ids, r.q_mat, r.dim, "<i8")
            scores = _products(c, q)
            low = np.full(len(q_ids), np.iinfo(np.int64).min, np.int64)
            q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            for j in range(len(q_ids)):
                own = scores[ids != q_ids[j], j]
                if len(own) >= k:
                    low[j] = np.partition(own, -k)[-k]
            # the length that the longest vector of a block needs before any of these queries can find something there
            reach = np.where(low <= 0, 0.0, (low - 1.0) / np.maximum(q_norm * (1 + 1e-9), 1e-300)).min()
            yield pd.DataFrame([{"q_grp": r.q_grp, "q_ids": r.q_ids, "q_mat": r.q_mat, "dim": r.dim, "low": low.tobytes(), "reach": float(reach)}])

    # One block of at most block_rows vectors for each dimension: a bounded broadcast.
    longest = blocks.filter(F.col("grp").isin(list(first.values()))).select("ids", "mat", "dim")
    # pmod may leave the first block of a bucket empty; the outer join keeps its queries, without a bound
    bounded = query_blocks.join(F.broadcast(longest), "dim", "left").select("q_grp", "q_ids", "q_mat", "dim", F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("mat", F.lit(b"")).alias("mat"))
    bounded = cut(bounded.mapInPandas(bounds, "q_grp long, q_ids binary, q_mat binary, dim int, low binary, reach double"))
    last = {d: max(o + n for (dd, _), (o, n) in plan.items() if dd == d) for d in queries}
    ends = F.create_map(*[x for d in queries for x in (F.lit(d), F.array(F.lit(first[d]).cast("long"), F.lit(last[d] - 1).cast("long")))])[F.col("dim")]
    # pairs of block numbers are pruned before any matrix moves
    asked = bounded.select("q_grp", "reach", F.explode(F.sequence(ends[0], ends[1])).alias("grp"))
    needed = asked.join(blocks.select("grp", "most"), "grp").filter("most >= reach").select("grp", "q_grp")
    pairs = needed.join(bounded.select("q_grp", "q_ids", "q_mat", "low"), "q_grp").join(blocks, "grp")
    pairs = pairs.select("ids", "mat", "dim", "q_ids", "q_mat", "low")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches_of_rows(batches):
            ids, c = unpack(r.ids, r.mat, r.dim, "<i8")
            q_ids, q = unpack(r.q_ids, r.q_mat, r.dim, "<i8")
            low = np.frombuffer(r.low, np.int64)
            c_norm, q_norm = (np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (c, q))
            live = np.flatnonzero(q_norm * c_norm[0] * (1 + 1e-9) + 1 >= low)
            picked = [_survivors(c, c_norm, q[j], q_norm[j], int(low[j])) for j in live]
            wide = [len(p) * 4 > len(c) for p in picked]
            full = _products(c, q[live[wide]]) if any(wide) else None
            out, col = [], 0
            for j, at, is_wide in zip(live, picked, wide, strict=True):
                if is_wide:
                    scores, col = full[at, col], col + 1
                else:
                    scores = _products(c[at], q[j : j + 1])[:, 0]
                keep = (scores >= low[j]) & (ids[at] != q_ids[j])
                at, scores = at[keep], scores[keep]
                sel = _top(ids[at], scores, k)
                out.append((np.full(len(sel), q_ids[j]), ids[at][sel], scores[sel]))
            if out:
                yield pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return best(pairs.mapInPandas(searched, FOUND), k)
