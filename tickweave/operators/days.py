"""Work over a symbol's whole history by days: changes, runs, as-of values and preceding rows.

Ticks meet only within (key, day).  What crosses a day's edge, its first, last
or trailing rows, is a few rows for each day; the table of days, not that of
ticks, is ordered by key.  ``day`` names a column that rises with time (the
trading day); a key's days without ticks don't part it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("datetime_ns", "row_hash")


def _within(keys: list[str], day: str, order: tuple[str, ...]):
    return Window.partitionBy(*keys, day).orderBy(*order)


def _over_days(keys: list[str], day: str):
    return Window.partitionBy(*keys).orderBy(day)


def changes(rows: DataFrame, keys: list[str], day: str, value: str, order: tuple[str, ...] = ORDER, first_null: bool = True) -> DataFrame:
    """The first row of each key and those whose value differs from the row before; null equals null.

    Without first_null a first row without a value isn't one of them.
    """
    by = _within(keys, day, order)
    marked = rows.withColumn("_before", F.lag(value).over(by)).withColumn("_first", F.row_number().over(by) == 1).withColumn("_last", F.lead(F.lit(1)).over(by).isNull())
    within = ~F.col("_first") & ~F.col(value).eqNullSafe(F.col("_before"))
    # with each day's last row among them, a first row's predecessor is the day before's last
    over = Window.partitionBy(*keys).orderBy(day, *order)
    some = marked.filter(F.col("_first") | F.col("_last") | within).withColumn("_carried", F.lag(value).over(over)).withColumn("_any", F.row_number().over(over) > 1)
    start = ~F.col("_any") if first_null else F.lit(False)
    return some.filter(within | (F.col("_first") & (start | ~F.col(value).eqNullSafe(F.col("_carried"))))).select(*rows.columns)


def runs(rows: DataFrame, condition: Column, least: int, keys: list[str], day: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """keys, n, first_ns, last_ns of the runs of at least ``least`` consecutive rows that meet the condition (null: they don't)."""
    by = _within(keys, day, order)
    marked = rows.select(*keys, day, *order, F.coalesce(condition, F.lit(False)).alias("_met"))
    marked = marked.withColumn("_group", F.sum(F.when(F.col("_met"), 0).otherwise(1)).over(by)).withColumn("_at", F.row_number().over(by))
    found = marked.filter("_met").groupBy(*keys, day, "_group").agg(F.count("*").alias("n"), F.min(order[0]).alias("first_ns"), F.max(order[0]).alias("last_ns"), F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    over = _over_days(keys, day)
    sizes = rows.groupBy(*keys, day).agg(F.count("*").alias("_rows")).withColumn("_day", F.row_number().over(over))
    placed = found.join(sizes, [*keys, day]).withColumn("_head", F.col("_from") == 1).withColumn("_tail", F.col("_to") == F.col("_rows"))
    inner = placed.filter(~F.col("_head") & ~F.col("_tail")).select(*keys, "n", "first_ns", "last_ns")
    # at most two runs of a day touch its edges; one goes on if the next day begins with the other
    edges = Window.partitionBy(*keys).orderBy("_day", "_from")
    joins = F.col("_head") & F.lag("_tail").over(edges) & (F.lag("_day").over(edges) == F.col("_day") - 1)
    outer = placed.filter(F.col("_head") | F.col("_tail")).withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(edges))
    stitched = outer.groupBy(*keys, "_island").agg(F.sum("n").alias("n"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")).drop("_island")
    return inner.unionByName(stitched).filter(F.col("n") >= least)


def as_of(asked: DataFrame, rows: DataFrame, values: list[str], keys: list[str], day: str, order: tuple[str, ...] = ORDER, by_place: bool = False) -> DataFrame:
    """asked with each value's last one of rows that is not null, at or before its time (the first column of order).

    asked and rows have keys, day and the columns of order; day must follow
    from the time alone.  Nothing before: null.  by_place: at or before its
    place in the whole order, so of rows of its own time only those up to it.
    """
    at, *ties = order
    side = rows.select(*keys, day, *order, *values, F.lit(0).alias("_side"))
    kept = [c for c in asked.columns if c not in (*keys, day, *order)]
    left = asked.select(*keys, day, *order, F.struct(*[F.col(c) for c in (kept or [day])]).alias("_asked"), F.lit(1).alias("_side"))
    both = left.unionByName(side, allowMissingColumns=True)
    by = Window.partitionBy(*keys, day).orderBy(*((*order, "_side") if by_place else (at, "_side", *ties))).rowsBetween(Window.unboundedPreceding, 0)
    over = _over_days(keys, day)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    last = both.groupBy(*keys, day).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(at, *ties))).alias(v) for v in values])
    carried = last.select(*keys, day, *[F.last(v, True).over(before).alias(f"_carried_{v}") for v in values])
    near = both.select("*", *[F.last(v, True).over(by).alias(f"_near_{v}") for v in values]).filter("_side = 1").join(carried, [*keys, day])
    return near.select(*keys, day, *order, *[F.col(f"_asked.{c}").alias(c) for c in kept], *[F.coalesce(f"_near_{v}", f"_carried_{v}").alias(v) for v in values])


def with_preceding(rows: DataFrame, n: int, keys: list[str], day: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """rows (own), and to each day of a key the n rows before its first one, from however many days (not own).

    The n last rows of each day wait in the table of days; n of its rows at most make a day's.
    """
    by = Window.partitionBy(*keys, day).orderBy(*[F.desc(c) for c in order])
    rest = [c for c in rows.columns if c not in keys]
    tails = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).groupBy(*keys, day).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*rest).alias("_row"))), False).alias("_tail"))
    over = _over_days(keys, day).rowsBetween(-n, -1)  # each day has a row at least
    lent = tails.select(*keys, F.col(day).alias("_to"), F.slice(F.flatten(F.reverse(F.collect_list("_tail").over(over))), 1, n).alias("_rows"))
    lent = lent.select(*keys, "_to", F.explode(F.transform("_rows", lambda r: r["_row"])).alias("_row"))
    lent = lent.select(*keys, *[(F.col("_to") if c == day else F.col(f"_row.{c}")).alias(c) for c in rest])
    return rows.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
