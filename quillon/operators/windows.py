"""Ranks with ties, running totals, tiers, slots, duplicates, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition_rank(columns: Sequence[str], by: Sequence[str] = ()) -> Column:
    """1, 2, 2, 4 over columns that all fall."""
    return F.rank().over(Window.partitionBy(*by).orderBy(*[F.desc_nulls_last(c) for c in columns]))


def top_with_ties(df: DataFrame, metric: str, n: int, falling: bool = True) -> DataFrame:
    """The first n and all that tie with the last of them, in order; rows without a value come last either way.

    Only rows from the n-th value on are ranked, so not all rows meet in one task.
    """
    order = F.desc_nulls_last(metric) if falling else F.asc_nulls_last(metric)
    first = df.orderBy(order).limit(n)
    edge = first.agg(F.count("*").alias("got_"), (F.min if falling else F.max)(metric).alias("edge_"), F.count_if(F.col(metric).isNull()).alias("nulls_"))  # one row
    inside = (F.col(metric) >= F.col("edge_")) if falling else (F.col(metric) <= F.col("edge_"))
    kept = df.crossJoin(edge).filter(F.coalesce(inside, F.lit(False)) | (F.col("nulls_") > 0)).drop("got_", "edge_", "nulls_")
    return kept.withColumn("place", F.rank().over(Window.orderBy(order))).filter(F.col("place") <= n).orderBy("place")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def running_total(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(value).over(w))


def dense_timeline(df: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """Cumulative by group over every day there is, carried forward."""
    days, groups = df.select(day).distinct(), df.select(by).distinct()
    grid = groups.crossJoin(days)  # the dense grid is the result itself
    return running_total(grid.join(df, [by, day], "left").withColumn(value, F.coalesce(value, F.lit(0))), [by], day, value)


def pareto_tiers(df: DataFrame, by: Sequence[str], key: str, points: str) -> DataFrame:
    """Core while the points before a row are under 60 % of all, then Secondary under 90 %, then Tail; integers only."""
    w = Window.partitionBy(*by).orderBy(F.desc(points), key).rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum(points).over(w), F.lit(0)), F.sum(points).over(Window.partitionBy(*by))
    out = df.withColumn("before", before).withColumn("all", total)
    tier = F.when(F.col("before") * 100 < 60 * F.col("all"), "Core").when(F.col("before") * 100 < 90 * F.col("all"), "Secondary").otherwise("Tail")
    return out.withColumn("tier_name", tier).drop("all")


def average_rank(column: str, by: Sequence[str] = ()) -> Column:
    ranks = F.rank().over(Window.partitionBy(*by).orderBy(column))
    return ranks + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2


def fill_slots(df: DataFrame, by: Sequence[str], slot: str, order: Sequence[Column], only: Column | None = None) -> DataFrame:
    """Stated slots stay; rows without one take the free numbers of their group in order. Rows that are not ``only`` stay as they are and take no slot.

    The k-th free number is k and one for each taken number below it; of the taken ones in order, the j-th, t, is below if t - j < k.
    One pass: the rows of a group are put in order by k and by t - j + 1, and none is computed twice.
    """
    kind, own = dict(df.dtypes)[slot], F.col(slot)
    sort = F.when(F.lit(True) if only is None else only, F.when(own.isNull(), 0).when(own >= 1, 1))  # open, taken, or beside the numbers
    w = Window.partitionBy(*by, "sort_").orderBy(slot, *order)
    taken = (F.col("sort_") == 1) & ~F.lag(slot).over(w).eqNullSafe(own)
    placed = df.withColumn("sort_", F.coalesce(sort, F.lit(2))).withColumn("taken_", taken.cast("int"))
    at = F.when(F.col("sort_") == 0, F.row_number().over(w)).otherwise(own - F.sum("taken_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1)
    before = F.sum("taken_").over(Window.partitionBy(*by).orderBy("at_", F.desc("taken_")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = placed.withColumn("at_", at.cast("long")).withColumn("free_", F.col("at_") + before)
    return filled.withColumn(slot, F.when(F.col("sort_") == 0, F.col("free_").cast(kind)).otherwise(own)).select(*df.columns)


def mark_duplicates(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """``duplicate_of``: the lowest row id with the same keys (nulls are equal), null for that row itself.

    Lowest ids are aggregated before they are shuffled and joined back, so that a hot key can be split.
    """
    own = [F.col(k).alias(f"key_{i}_") for i, k in enumerate(keys)]
    first = df.groupBy(*own).agg(F.min(row_id).alias("first_"), F.count("*").alias("n_")).filter("n_ > 1").drop("n_")
    on = [F.col(k).eqNullSafe(F.col(f"key_{i}_")) for i, k in enumerate(keys)]
    out = df.join(first, on, "left")
    return out.select(*df.columns, F.when(F.col(row_id) > F.col("first_"), F.col("first_")).alias("duplicate_of"))


def failures_since_success(df: DataFrame, by: str, order: str, failed: Column, passed: Column) -> DataFrame:
    """Consecutive failures after the last success of each group."""
    last = F.max(F.when(passed, F.col(order))).over(Window.partitionBy(by))
    marked = df.withColumn("after_", F.coalesce(F.col(order) > last, F.lit(True)) & failed)
    return marked.groupBy(by).agg(F.count_if("after_").alias("failures"))


def capped_per_group(df: DataFrame, by: str, order: Sequence[Column], each: int, n: int) -> DataFrame:
    """At most ``each`` of a group, then the first ``n`` of all: a report's list."""
    return first_per_group(df, [by], order, each).drop("place").orderBy(*order).limit(n)
