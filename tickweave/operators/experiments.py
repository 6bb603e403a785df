"""Fits of many units side by side, their benchmark and sweep, and a daily run with a state for each symbol.

A unit is a (symbol, split, option).  Multinomial logistic fits take Newton
steps together: every step is one pass over the training rows in which tasks
add up each unit's gradient and Hessian, so no unit's rows meet in one task.
The driver solves systems of the size of the coefficients.  A unit that can't
be fitted has a status and an error; the others go on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators import evaluation, features
from tickweave.sources.ticks import kept

UNIT = ["symbol", "split_id"]
FITS = "symbol string, split_id int, option int, status string, error string, n long, steps int, loss double, model binary"
SCORES = "symbol string, split_id int, option int, role string, trading_day date, datetime_ns long, row_hash long, mid double, label int, prediction int, p_down double, p_flat double, p_up double"
CLASSES = 3


def training_guards(feature_builds: DataFrame, label_builds: DataFrame) -> DataFrame:
    """symbol, reason of every symbol of either table of build records; reason is null if features and labels may be joined.

    Both have symbol, ticks_kind, dataset_version, row_hash_algo and
    schedule_hash.  Continuous symbols (KQ.m@) must come from main_l5 ticks,
    and those need a schedule hash.  An unknown hash algorithm passes.
    """
    fields = ["ticks_kind", "dataset_version", "row_hash_algo", "schedule_hash"]
    a = feature_builds.select("symbol", F.struct(*fields).alias("f"))
    both = a.join(label_builds.select("symbol", F.struct(*fields).alias("l")), "symbol", "full")
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    differ = lambda c: text("f", c) != text("l", c)
    main = text("f", "ticks_kind") == "main_l5"
    # Reasons, in the order in which they are tested.
    reason = (
        F.when(F.col("f").isNull() | F.col("l").isNull(), "missing_build").when(differ("ticks_kind"), "ticks_kind_mismatch").when(differ("dataset_version"), "dataset_version_mismatch")
        .when((text("f", "row_hash_algo") != "") & (text("l", "row_hash_algo") != "") & differ("row_hash_algo"), "row_hash_algo_mismatch").when(F.col("symbol").startswith("KQ.m@") & ~main, "continuous_needs_main_l5")
        .when(main & ((text("f", "schedule_hash") == "") | (text("l", "schedule_hash") == "")), "missing_schedule").when(main & differ("schedule_hash"), "schedule_hash_mismatch")
    )
    return both.select("symbol", reason.alias("reason"))


def _inputs(columns: list[str]) -> list[Column]:
    """Columns _x0, _x1 and so on, missing as 0; plain numbers reach numpy without an object for each row."""
    return [F.when(F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_x{i}") for i, c in enumerate(columns)]


def _units_of(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple[str, int], np.ndarray, np.ndarray]]:
    """Unit, inputs and labels of each unit in a batch; names stay codes, no row becomes an object."""
    names = batch.column("symbol").dictionary_encode()
    split = batch.column("split_id").to_numpy()
    code = names.indices.to_numpy() * np.int64(2**32) + (split + np.int64(2**31))
    x = np.column_stack([batch.column(f"_x{i}").to_numpy() for i in range(n)]) if n else np.empty((len(split), 0))
    y = batch.column("y").to_numpy()
    symbols = names.dictionary.to_pylist()
    for c in np.unique(code):
        here = code == c
        yield (symbols[int(c) >> 32], int(split[here.argmax()])), x[here], y[here]


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A column of ones and the standardised inputs."""
    return np.hstack((np.ones((len(x), 1)), (x - mean) / scale))


def _softmax(x: np.ndarray, w: np.ndarray, present: list[int]) -> np.ndarray:
    """Probabilities of all classes; the first one present is the reference, w has a row for each further one, absent ones get 0."""
    z = np.full((len(x), CLASSES), -np.inf)
    z[:, present[0]] = 0.0
    z[:, present[1:]] = x @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _stages(x: np.ndarray, y: np.ndarray, w: np.ndarray, present: list[int]) -> np.ndarray:
    """Rows, loss, gradient and Hessian of the softmax loss, in one vector."""
    p = _softmax(x, w, present)
    hot = np.eye(CLASSES)[y]
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    q = p[:, present[1:]]
    grad = (q - hot[:, present[1:]]).T @ x
    k, d = q.shape[1], x.shape[1]
    hess = np.zeros((k * d, k * d))
    for i in range(k):
        for j in range(i, k):
            weight = q[:, i] * ((i == j) - q[:, j])
            block = (x * weight[:, None]).T @ x
            hess[i * d : (i + 1) * d, j * d : (j + 1) * d] = hess[j * d : (j + 1) * d, i * d : (i + 1) * d] = block
    return np.concatenate(([len(x), loss], grad.ravel(), hess.ravel()))


def fit_units(rows: DataFrame, columns: list[str], label: str, options: list[dict], min_rows: int = 100, steps: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """A row for each unit and option: status (fitted, skipped, failed), error, n, steps, loss, model.

    rows have symbol, split_id, role and the columns; those of role 'train'
    with a label of 0, 1 or 2 are fitted.  Missing features are 0, all are
    standardised by the unit's own training rows.  An option has l2, the
    weight of half the squared coefficients in the mean loss (not of the
    intercept).  A class that a unit never has gets probability 0.  Too few rows or a single class skip a unit; one that does not
    settle within the steps fails alone.
    """
    spark, d = rows.sparkSession, len(columns) + 1
    train = kept(rows.filter((F.col("role") == "train") & F.col(label).isin(0, 1, 2) & F.col("symbol").isNotNull() & F.col("split_id").isNotNull()).select(F.col("symbol").cast("string").alias("symbol"), F.col("split_id").cast("int").alias("split_id"), *_inputs(columns), F.col(label).cast("int").alias("y")))
    each = [F.struct(F.avg(f"_x{i}").alias("m"), F.stddev_pop(f"_x{i}").alias("s")) for i in range(len(columns))]
    counted = rows.select("symbol", F.col("split_id").cast("int").alias("split_id")).distinct().join(train.groupBy(*UNIT).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("y")).alias("classes"), F.array(*each).alias("scale")), UNIT, "left")
    scale, out, weights, last, n_of = {}, {}, {}, {}, {}
    for r in counted.collect():  # a row for each unit
        unit = (r["symbol"], r["split_id"])
        n_of[unit] = r["n"] or 0
        why = f"rows: {n_of[unit]} of {min_rows}" if n_of[unit] < min_rows else "one class" if len(r["classes"]) < 2 else None
        if not why:
            scale[unit] = (np.array([c["m"] for c in r["scale"]]), np.array([c["s"] if c["s"] > 0 else 1.0 for c in r["scale"]]), list(r["classes"]))
        for o in range(len(options)):
            if why:
                out[*unit, o] = ("skipped", why, 0, None)
            else:
                weights[*unit, o] = np.zeros((len(r["classes"]) - 1, d))
                last[*unit, o] = (np.inf, weights[*unit, o], 0)
    active = set(weights)
    for step in range(1, steps + 1):
        if not active:
            break
        shared = spark.sparkContext.broadcast(({k: weights[k] for k in active}, scale))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, scales = shared.value
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for unit, x, y in _units_of(batch, len(columns)):
                    mine = [o for o in range(len(options)) if (*unit, o) in now]
                    if mine:
                        m, s, present = scales[unit]
                        design = _design(x, m, s)
                        for o in mine:
                            found = _stages(design, y, now[*unit, o], present)
                            total[*unit, o] = total[*unit, o] + found if (*unit, o) in total else found
            if total:
                rows = [(*k, v.tobytes()) for k, v in total.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [*UNIT, "option", "part"])

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            whole = np.sum([np.frombuffer(p) for p in parts["part"]], axis=0)
            return parts.iloc[:1].assign(part=[whole.tobytes()])

        fields = "symbol string, split_id int, option int, part binary"
        sums = train.mapInArrow(summed, fields).groupBy(*UNIT, "option").applyInPandas(added, fields)
        for r in sums.collect():  # the size of the coefficients, squared, for each unit
            key = (r["symbol"], r["split_id"], r["option"])
            v, w, l2 = np.frombuffer(r["part"]), weights[key], float(options[key[2]].get("l2", 0.0))
            n, flat = v[0], w.ravel()
            penalty = np.tile(np.append(0.0, np.ones(len(columns))), len(w))
            loss = v[1] / n + l2 / 2 * float((penalty * flat**2).sum())
            before, good, halved = last[key]
            if not loss <= before + 1e-12 * (1 + abs(before)) and halved < 30:
                weights[key], last[key] = (w + good) / 2, (before, good, halved + 1)  # the step went too far
                continue
            grad = v[2 : 2 + len(flat)] / n + l2 * penalty * flat
            hess = v[2 + len(flat) :].reshape(len(flat), -1) / n + np.diag(l2 * penalty)
            try:
                move = np.linalg.solve(hess, grad)
            except np.linalg.LinAlgError as e:
                out[key] = ("failed", str(e), step, None)
                active.discard(key)
                continue
            if np.abs(move).max() <= tolerance * (1 + np.abs(flat).max()):
                out[key] = ("fitted", None, step, (loss, w))
                active.discard(key)
            else:
                weights[key], last[key] = w - move.reshape(w.shape), (loss, w, 0)
    for key in active:
        out[key] = ("failed", f"not settled in {steps} steps", steps, None)
    found = []
    for key in sorted(out, key=str):
        status, error, used, fit = out[key]
        model = pickle.dumps((fit[1], *scale[key[:2]])) if fit else None
        found.append((*key, status, error, n_of[key[:2]], used, float(fit[0]) if fit else None, model))
    return spark.createDataFrame(found, FITS)


def score_units(rows: DataFrame, columns: list[str], label: str, fits: DataFrame, roles: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Rows of the roles with each option's probabilities and class; rows of units that were not fitted are left out."""
    models = {(r["symbol"], r["split_id"], r["option"]): pickle.loads(r["model"]) for r in fits.filter("model is not null").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(models)
    keep = ["symbol", "split_id", "role", "trading_day", "datetime_ns", "row_hash", "mid"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_options = 1 + max((k[2] for k in shared.value), default=-1)
        for batch in batches:
            for unit, part in batch.groupby(UNIT, sort=False):
                for o in range(n_options):
                    if (*unit, o) in shared.value:
                        w, m, s, present = shared.value[*unit, o]
                        x = part[[f"_x{i}" for i in range(len(m))]].to_numpy(np.float64)
                        p = _softmax(_design(x, m, s), w, present)
                        out = part[[*keep, "label"]].assign(option=o, prediction=p.argmax(1), p_down=p[:, 0], p_flat=p[:, 1], p_up=p[:, 2])
                        yield out.astype({"label": "Int64"})

    some = rows.filter(F.col("role").isin(*roles)).select(*keep, F.col(label).cast("int").alias("label"), *_inputs(columns))
    some = some.withColumn("split_id", F.col("split_id").cast("int")).withColumn("mid", F.col("mid").cast("double"))
    return some.mapInPandas(scored, SCORES)


def benchmark(scored: DataFrame, role: str = "test") -> DataFrame:
    """n, accuracy, F1 and log loss of each symbol and option over its splits: mean and population deviation."""
    own = scored.filter(F.col("role") == role)
    metrics = evaluation.classification_metrics(own, [*UNIT, "option"], probability=["p_down", "p_flat", "p_up"])
    return evaluation.over_splits(metrics, ["symbol", "option"], ["accuracy", "f1_macro", "log_loss"])


def best_options(scored: DataFrame) -> DataFrame:
    """symbol, option, accuracy of the option with the highest accuracy on rows of role 'val'; ties to the first option."""
    own = scored.filter((F.col("role") == "val") & F.col("label").isNotNull())
    accuracy = own.groupBy("symbol", "option").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    best = accuracy.groupBy("symbol").agg(F.max(F.struct("accuracy", (-F.col("option")).alias("_o"))).alias("b"))
    return best.select("symbol", (-F.col("b._o")).alias("option"), F.col("b.accuracy").alias("accuracy"))


def daily_run(ticks: DataFrame, guards: DataFrame, names: list[str], horizon: int, options: list[dict], threshold: float = 0.5, n_splits: int = 3, min_train: int = 100, **gate: float) -> DataFrame:
    """symbol, step, state, detail of a day's run: guard, features, labels, fit, evaluation and promotion of every symbol.

    Symbols that a guard holds back, or whose fit fails, end there; all others
    go on.  The newest split's best option by validation accuracy is judged on
    its test rows, and its positions pass the promotion gate or are held.
    """
    allowed = ticks.join(guards.filter("reason is null").select("symbol"), "symbol", "left_semi")
    label = f"label_{horizon}"
    data = kept(features.factors_and_labels(allowed, list(dict.fromkeys([*names, "mid"])), (horizon,)))
    placed = evaluation.walk_forward_by_symbol(kept(evaluation.with_position(data)), n_splits=n_splits, min_train=min_train)
    placed = placed.withColumn("split_id", F.col("split_id").cast("int"))
    fits = fit_units(placed, names, label, options, min_train)
    # of every symbol only the newest split with a fit is judged, so only its rows are scored
    last = fits.filter("model is not null").groupBy("symbol").agg(F.max("split_id").alias("split_id"))
    newest = kept(score_units(placed.join(F.broadcast(last), UNIT, "left_semi"), names, label, fits))
    best = best_options(newest)
    test = newest.filter("role = 'test'").join(best.select("symbol", "option"), ["symbol", "option"], "left_semi")
    metrics = evaluation.classification_metrics(test, ["symbol"])
    path = evaluation.mark_to_mid(test.withColumn("position", evaluation.position_of(F.col("p_down"), F.col("p_up"), threshold)).select("symbol", "trading_day", "datetime_ns", "row_hash", "position", "mid"))
    gated = evaluation.promotion_gate(evaluation.strategy_report(path), **gate)
    text = lambda c: F.col(c).cast("string")
    step = lambda df, name, state, detail: df.select("symbol", F.lit(name).alias("step"), state.alias("state"), detail.alias("detail"))
    counts = lambda df, name: step(df.groupBy("symbol").agg(F.count("*").alias("n")), name, F.lit("built"), text("n"))
    known = ticks.select("symbol").distinct()
    tried = fits.groupBy("symbol").agg(F.count_if(F.col("status") == "fitted").alias("good"), F.count("*").alias("all"), F.min("error").alias("error"))
    tried = known.join(guards.filter("reason is null").select("symbol"), "symbol").join(tried, "symbol", "left")
    parts = [
        step(known.join(guards, "symbol", "left"), "guard", F.when(F.col("reason").isNull(), "passed").otherwise("held"), F.col("reason")),
        counts(data, "features"), counts(data, "labels"),  # each tick has a row of either
        step(tried, "fit", F.when(F.coalesce("good", F.lit(0)) == 0, "failed").when(F.col("good") < F.col("all"), "partly").otherwise("fitted"), F.when(F.col("all").isNull(), "no split of enough rows").otherwise(F.col("error"))),
        step(metrics, "evaluation", F.when(F.col("accuracy") > 1 / CLASSES, "better_than_chance").otherwise("not_better"), F.round("accuracy", 6).cast("string")),
        step(gated, "promotion", F.when(F.col("passed"), "promoted").otherwise("held"), F.array_join("reasons", ",")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
