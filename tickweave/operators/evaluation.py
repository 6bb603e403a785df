"""Dataset preparation, splits, training, metrics, strategy tables, regimes and drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.operators import days
from tickweave.sources.ticks import kept

KEYS = ["symbol", "datetime_ns", "row_hash"]
ESTIMATORS = {
    "logistic": lambda **o: LogisticRegression(family="multinomial", **o),
    "forest": lambda **o: RandomForestClassifier(**o),
    "gbt": lambda **o: OneVsRest(classifier=GBTClassifier(**o)),
}


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the row key: times alone would multiply ties."""
    extra = [c for c in labels.columns if c.startswith("label_")]
    return features.join(labels.select(*KEYS, *extra), KEYS)


def walk_forward(spark: SparkSession, n: int, n_splits: int = 5, train: float = 0.6, val: float = 0.2, min_train: int = 10_000) -> DataFrame:
    """split_id, role, start, stop of expanding splits by row position."""
    step, rows = n // (n_splits + 2), []
    for i in range(n_splits):
        end = min(n, (i + 3) * step)
        a, v = int(end * train), int(end * val)
        if a >= min_train and end > a + v:
            rows += [(i, "train", 0, a), (i, "val", a, a + v), (i, "test", a + v, end)]
    return spark.createDataFrame(rows, "split_id int, role string, start long, stop long")


def with_position(rows: DataFrame) -> DataFrame:
    """Column pos from 0 per symbol in time order: numbers within each day behind the rows of earlier days."""
    before = Window.partitionBy("symbol").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("symbol", "trading_day").agg(F.count("*").alias("_n"))
    days = days.select("symbol", "trading_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("symbol", "trading_day").orderBy("datetime_ns", "row_hash"))
    return rows.withColumn("_nth", nth).join(days, ["symbol", "trading_day"]).withColumn("pos", F.col("_base") + F.col("_nth") - 1).select(*rows.columns, "pos")


def apply_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """A row for each split and role that a position falls in; the split table is tiny, hence broadcast."""
    return rows.join(F.broadcast(splits), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))).drop("start", "stop")


def walk_forward_by_symbol(rows: DataFrame, n_splits: int = 5, train: float = 0.6, val: float = 0.2, min_train: int = 10_000) -> DataFrame:
    """rows with pos, a row for each split and role it falls in; bounds follow from the symbol's own row count."""
    sizes = rows.groupBy("symbol").agg(F.floor(F.count("*") / (n_splits + 2)).alias("_step"))
    ends = sizes.select("symbol", F.posexplode(F.transform(F.sequence(F.lit(3), F.lit(n_splits + 2)), lambda k: k * F.col("_step"))).alias("split_id", "_end"))
    bounds = ends.select("symbol", "split_id", "_end", F.floor(F.col("_end") * train).alias("_a"), F.floor(F.col("_end") * val).alias("_v"))
    bounds = bounds.filter((F.col("_a") >= min_train) & (F.col("_end") > F.col("_a") + F.col("_v")))
    role = F.when(F.col("pos") < F.col("_a"), "train").when(F.col("pos") < F.col("_a") + F.col("_v"), "val").otherwise("test")
    # a few rows for each symbol; a shuffle by symbol would gather the rows in as many tasks
    return rows.join(F.broadcast(bounds), "symbol").filter(F.col("pos") < F.col("_end")).withColumn("role", role).drop("_end", "_a", "_v")


def sequences(rows: DataFrame, columns: list[str], length: int, label: str) -> DataFrame:
    """The ``length`` rows before each labelled row, all of one segment, missing as 0; days take their first ones from those before."""
    needed = dict.fromkeys(["symbol", "trading_day", "datetime_ns", "row_hash", "segment_id", label, *columns])
    rows = days.with_preceding(rows.select(*needed), length, ["symbol"], "trading_day")
    by = Window.partitionBy("symbol", "trading_day").orderBy("datetime_ns", "row_hash")
    frame, whole = by.rowsBetween(-length, -1), by.rowsBetween(-length, 0)
    cell = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    out = rows.select("symbol", "datetime_ns", "row_hash", label, "own", F.collect_list(cell).over(frame).alias("sequence"), (F.min("segment_id").over(whole) == F.max("segment_id").over(whole)).alias("_one"), F.row_number().over(by).alias("_n"))
    return out.filter(F.col("own") & F.col("_one") & (F.col("_n") > length) & F.col(label).isNotNull()).drop("_one", "_n", "own")


def fit_model(rows: DataFrame, columns: list[str], label: str, kind: str = "logistic", **options: object):
    """Standardised features into a named estimator; rows with missing values are left out."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    estimator = ESTIMATORS[kind](**options).setLabelCol(label).setFeaturesCol("features")
    # every fit passes over its rows many times
    kept = rows.select(*columns, label).filter(F.col(label).isNotNull()).persist()
    try:
        return Pipeline(stages=[*stages, estimator]).fit(kept)
    finally:
        kept.unpersist()


def sweep(rows: DataFrame, columns: list[str], label: str, options: list[dict]) -> tuple[dict, float]:
    """Best options by accuracy on the last 15 of 85 percent, split by time."""
    n = rows.groupBy("symbol").agg(F.count("*").alias("_n"))
    placed = with_position(rows).join(n, "symbol").withColumn("_at", F.col("pos") / F.col("_n")).persist()
    scores = []
    try:
        for o in options:
            model = fit_model(placed.filter("_at < 0.7"), columns, label, **o)
            out = model.transform(placed.filter("_at >= 0.7 and _at < 0.85"))
            scores.append((out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).head()[0] or 0.0, o))
    finally:
        placed.unpersist()
    best = max(scores, key=lambda s: s[0])
    return best[1], best[0]


def classification_metrics(scored: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction", probability: list[str] | None = None) -> DataFrame:
    """n, accuracy, macro and weighted F1 of each group, from confusion counts; log loss if class probabilities are given."""
    rows = scored.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    loss = -F.log(F.greatest(F.lit(1e-10), F.least(F.lit(1.0), F.get(F.array(*probability), F.col(label).cast("int"))))) if probability else F.lit(None).cast("double")
    cells = rows.groupBy(*keys, F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), F.count(loss).alias("losses"))
    # each cell counts for its label's class and for its prediction's
    sides = cells.select(*keys, "l", "p", "n", "loss", "losses", F.posexplode(F.array("l", "p")).alias("side", "c"))
    own, hit = F.col("side") == 0, F.col("l") == F.col("p")
    per = sides.groupBy(*keys, "c").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(own & hit, F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("said"),
        F.sum(F.when(own, F.col("loss"))).alias("loss"), F.sum(F.when(own, F.col("losses"))).alias("losses"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("said")), F.lit(0.0))
    out = per.withColumn("f1", f1).groupBy(*keys).agg(F.sum("support").alias("n"), F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"), F.try_divide(F.sum("loss"), F.sum("losses")).alias("log_loss"))
    return out if probability else out.drop("log_loss")


def class_recall(scored: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support, recall and precision of every class that occurs as a label."""
    rows = scored.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    said = rows.groupBy(*keys, F.col(prediction).alias("class")).agg(F.count("*").alias("_said"))
    true = rows.groupBy(*keys, F.col(label).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(label) == F.col(prediction)).alias("_hits"))
    out = true.join(said, [*keys, "class"], "left")
    return out.select(*keys, "class", "support", (F.col("_hits") / F.col("support")).alias("recall"), F.coalesce(F.try_divide("_hits", "_said"), F.lit(0.0)).alias("precision"))


def brier_score(scored: DataFrame, keys: list[str], label: str, probability: list[str]) -> DataFrame:
    """Mean squared distance of the class probabilities from the label's class; keys may be a symbol, a regime or an hour."""
    parts = [F.pow(F.col(p) - (F.col(label) == i).cast("double"), 2) for i, p in enumerate(probability)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return scored.filter(F.col(label).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(total).alias("brier"))


def calibration_error(scored: DataFrame, keys: list[str], confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error over equal bins (low, high] of the top probability."""
    binned = scored.select(*keys, F.greatest(F.lit(1), F.ceil(confidence * bins)).alias("bin"), confidence.alias("c"), correct.cast("double").alias("ok")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("ok").alias("ok"))
    gap = F.abs(F.col("c") - F.col("ok"))
    return binned.groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def over_splits(metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def position_of(p_down: Column, p_up: Column, threshold: float, size: int = 1) -> Column:
    return F.when(p_up > threshold, size).when(p_down > threshold, -size).otherwise(0)


def _prefixed(rows: DataFrame, key: str, day_value: Column, column: str, fold: Callable[[str], Column]) -> DataFrame:
    """rows with ``column``: fold of the values of all earlier days of the key, from one row for each day."""
    before = Window.partitionBy(key).orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(key, "trading_day").agg(day_value.alias("_v"))
    return rows.join(days.select(key, "trading_day", fold("_v").over(before).alias(column)), [key, "trading_day"])


def mark_to_mid(rows: DataFrame, key: str = "symbol", cost: float = 0.0) -> DataFrame:
    """pnl, equity and traded quantity of a position path (key, trading_day, datetime_ns, row_hash, position, mid); cost is a share of traded value.

    Days are worked on apart: each is lent the last row of the day before, and
    sums of earlier days come from one row for each day.
    """
    columns = rows.columns
    last = Window.partitionBy(key, "trading_day").orderBy(F.desc("datetime_ns"), F.desc("row_hash"))
    near = Window.partitionBy(key).orderBy("trading_day")
    days = rows.select(key, "trading_day").distinct().withColumn("_next", F.lead("trading_day").over(near))
    lent = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").join(days, [key, "trading_day"]).filter("_next is not null")
    both = rows.withColumn("_own", F.lit(True)).unionByName(lent.withColumn("trading_day", F.col("_next")).select(*columns, F.lit(False).alias("_own")))
    by = Window.partitionBy(key, "trading_day").orderBy("datetime_ns", "row_hash")
    was, mid_was = F.coalesce(F.lag("position").over(by), F.lit(0)), F.lag("mid").over(by)
    out = both.withColumn("traded", F.abs(F.col("position") - was)).withColumn("pnl", F.coalesce(was * (F.col("mid") - mid_was), F.lit(0.0)) - F.lit(cost) * F.col("traded") * F.col("mid"))
    # both the day sums and the rows read it
    out = _prefixed(kept(out.filter("_own")), key, F.sum("pnl"), "_base", F.sum)
    within = F.sum("pnl").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("equity", F.coalesce("_base", F.lit(0.0)) + within).select(*columns, "traded", "pnl", "equity")


def strategy_report(path: DataFrame, key: str = "symbol", base: float = 1e6) -> DataFrame:
    """Trades, PnL, largest drawdown, annualised daily Sharpe, profit factor and win rate of each path from mark_to_mid."""
    by = Window.partitionBy(key, "trading_day").orderBy("datetime_ns", "row_hash").rowsBetween(Window.unboundedPreceding, 0)
    path = kept(path)
    worth = _prefixed(path.withColumn("_w", F.lit(base) + F.col("equity")), key, F.max("_w"), "_before", F.max)
    worth = worth.withColumn("_peak", F.greatest("_before", F.max("_w").over(by)))
    totals = worth.groupBy(key).agg(
        F.count_if(F.col("traded") > 0).alias("trades"), F.sum("pnl").alias("pnl"), F.min(F.try_divide("_w", "_peak") - 1).alias("max_drawdown"),
        F.try_divide(F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))).alias("profit_factor"), F.try_divide(F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") != 0)).alias("win_rate"),
    )
    daily = path.groupBy(key, "trading_day").agg((F.sum("pnl") / base).alias("r")).groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    sharpe = daily.select(key, F.when((F.col("n") < 2) | (F.coalesce("s", F.lit(0.0)) == 0), 0.0).otherwise(F.try_divide("m", "s") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return totals.join(sharpe, key)


def promotion_gate(report: DataFrame, min_sharpe: float = 0.5, max_drawdown: float = 0.2, min_trades: int = 10, min_pnl: float = 0.0) -> DataFrame:
    """Columns passed and reasons."""
    reasons = F.array_compact(F.array(F.when(F.col("sharpe") < min_sharpe, "sharpe"), F.when(-F.col("max_drawdown") > max_drawdown, "drawdown"), F.when(F.col("trades") < min_trades, "trades"), F.when(F.col("pnl") < min_pnl, "pnl")))
    return report.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def regime_inputs(ticks: DataFrame) -> DataFrame:
    """Log return, its 20-tick deviation, log volume change and relative spread; missing as 0."""
    ticks = days.with_preceding(ticks.select("symbol", "segment_id", "trading_day", "datetime_ns", "row_hash", "bid_price1", "ask_price1", "last_price", "volume"), 20, ["symbol", "segment_id"], "trading_day")
    by = Window.partitionBy("symbol", "segment_id", "trading_day").orderBy("datetime_ns", "row_hash")
    mid = F.coalesce((F.col("bid_price1") + F.col("ask_price1")) / 2, F.col("last_price"))
    rows = ticks.withColumn("_m", mid).withColumn("_was", F.lag("_m").over(by))
    rows = rows.withColumn("log_return", F.when((F.col("_m") > 0) & (F.col("_was") > 0), F.log(F.try_divide("_m", "_was"))))
    rows = rows.withColumn("volatility", F.stddev_samp("log_return").over(by.rowsBetween(-19, 0))).withColumn("volume_change", F.log1p(F.greatest(F.col("volume") - F.lag("volume").over(by), F.lit(0.0)))).withColumn("rel_spread", F.try_divide(F.col("ask_price1") - F.col("bid_price1"), F.col("_m")))
    return rows.filter("own").select("symbol", "trading_day", "datetime_ns", "row_hash", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("log_return", "volatility", "volume_change", "rel_spread")])


def regimes(inputs: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """State and probabilities of each symbol-day's last tick by a Gaussian mixture; states ordered by mean volatility.

    A mixture, not a hidden Markov model: states don't depend on the one before.
    """
    columns = ["log_return", "volatility", "volume_change", "rel_spread"]
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), GaussianMixture(k=k, seed=seed, maxIter=20)]).fit(inputs)
    out = model.transform(inputs)
    order = out.groupBy("prediction").agg(F.avg("volatility").alias("v")).withColumn("state", F.row_number().over(Window.orderBy("v", "prediction")) - 1)
    names = ["quiet", "trending", "volatile"] if k == 3 else [f"regime_{i}" for i in range(k)]
    rows = out.join(F.broadcast(order.select("prediction", "state")), "prediction").withColumn("p", vector_to_array("probability"))
    last = rows.groupBy("symbol", "trading_day").agg(F.max_by(F.struct("state", "p"), F.struct("datetime_ns", "row_hash")).alias("r"))
    return last.select("symbol", "trading_day", "r.state", F.get(F.array(*[F.lit(n) for n in names]), F.col("r.state")).alias("regime"), F.to_json("r.p").alias("probabilities"))


def psi(base: DataFrame, other: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability, KL divergence and KS distance of one column between two tables, over the base's quantile bins."""
    edges = base.approxQuantile(column, [i / bins for i in range(1, bins)], 0.001)
    bucket = sum([(F.col(column) > e).cast("int") for e in edges], F.lit(0))
    count = lambda df, n: df.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bin")).agg(F.count("*").alias(n))
    both = count(base, "a").join(count(other, "b"), "bin", "full").fillna(0)
    tot = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.greatest(F.try_divide("a", "ta"), F.lit(1e-6)), F.greatest(F.try_divide("b", "tb"), F.lit(1e-6))
    by = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
    rows = both.join(F.broadcast(tot)).select("bin", p.alias("p"), q.alias("q")).withColumn("d", F.abs(F.sum("p").over(by) - F.sum("q").over(by)))
    return rows.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"), F.sum(F.col("q") * F.log(F.col("q") / F.col("p"))).alias("kl"), F.max("d").alias("ks"))
