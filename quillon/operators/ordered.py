"""Order over all rows without one task for all: running sums, ranks and exact quantiles from counts of distinct values.

Values are counted first, then cut into ranges by key, and the counts of ranges and of what stands before a row in its range are
added. The ranges are written before they are numbered, so that whatever is computed again sees the same ones; only one sum a
range comes together in one task.
"""

from __future__ import annotations

import atexit
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back; it goes when the program ends."""
    from quillon.sources.store import Store

    store = Store(df.sparkSession)
    df.write.parquet(store.path("rows"))
    atexit.register(_removed, store)
    return df.sparkSession.read.schema(df.schema).parquet(store.path("rows"))


def _removed(store) -> None:
    try:
        store.remove("")
    except Exception:  # the session has ended
        return


def running(df: DataFrame, value: Column, chunk: str = "chunk_", at: str = "at_") -> DataFrame:
    """A column ``sum_`` with the sum of ``value`` over the rows before; rows are in order of chunk and place in it, and written."""
    marked = df.withColumn("value_", value)
    before = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(chunk).agg(F.sum("value_").alias("in_")).select(chunk, F.coalesce(F.sum("in_").over(before), F.lit(0)).alias("skip_"))
    own = F.coalesce(F.sum("value_").over(Window.partitionBy(chunk).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("own_", own).join(sums, chunk).withColumn("sum_", F.col("own_") + F.col("skip_")).drop("value_", "own_", "skip_")


def marked(df: DataFrame) -> DataFrame:
    """The table, written with its task (``chunk_``) and the place in it (``at_``)."""
    mark = F.monotonically_increasing_id()
    return written(df.withColumn("chunk_", F.shiftright(mark, 33)).withColumn("at_", mark))


def counted(df: DataFrame, order: Sequence[Column], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each value of ``columns`` in its group: ``n_`` and ``before_``, the rows of the group before it in this order."""
    counts = df.groupBy(*by, *columns).agg(F.count("*").alias("n_"))
    keys = [*[F.col(b).asc_nulls_first() for b in by], *order]
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = running(marked(counts.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys)), F.col("n_")).drop("chunk_", "at_")
    if not by:
        return rows.withColumnRenamed("sum_", "before_")
    first = rows.groupBy(*[F.col(b).alias(f"of_{i}_") for i, b in enumerate(by)]).agg(F.min("sum_").alias("start_"))
    on = [F.col(b).eqNullSafe(F.col(f"of_{i}_")) for i, b in enumerate(by)]
    return rows.join(first, on).withColumn("before_", F.col("sum_") - F.col("start_")).drop("sum_", "start_", *[f"of_{i}_" for i in range(len(by))])


def _joined(df: DataFrame, found: DataFrame, columns: Sequence[str], name: str, value: Column) -> DataFrame:
    keys = found.select(*[F.col(c).alias(f"of_{i}_") for i, c in enumerate(columns)], value.alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"of_{i}_")) for i, c in enumerate(columns)]
    return df.join(keys, on).select(*df.columns, name)


def competition_ranks(df: DataFrame, columns: Sequence[str], name: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """Rank 1, 2, 2, 4 over columns that all fall (nulls last), of every row."""
    found = counted(df, [F.desc_nulls_last(c) for c in columns], by, columns)
    return _joined(df, found, [*by, *columns], name, F.col("before_") + 1)


def average_ranks(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank from the least up, the mean of their places for equal values."""
    found = counted(df, [F.asc_nulls_first(column)], by, [column])
    return _joined(df, found, [*by, column], name, F.col("before_") + (F.col("n_") + 1) / 2)


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles, linearly interpolated, of a number column: ``<by>, n, q`` (an array); one row if there are no groups."""
    value = F.col(column).cast("double")
    rows = df.filter(F.col(column).isNotNull()).select(*by, value.alias("of_value"))
    found = counted(rows, [F.asc("of_value")], by, ["of_value"])
    sizes = found.groupBy(*[F.col(b).alias(f"of_{i}_") for i, b in enumerate(by)]).agg(F.sum("n_").alias("all_"))
    on = [F.col(b).eqNullSafe(F.col(f"of_{i}_")) for i, b in enumerate(by)]
    sized = found.join(sizes, on) if by else found.crossJoin(sizes)  # one row
    parts = []
    for p in shares:
        place = F.lit(float(p)) * (F.col("all_") - 1)
        at = lambda i: F.max(F.when((F.col("before_") <= i) & (i < F.col("before_") + F.col("n_")), F.col("of_value")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        parts.append(low + (high - low) * share)
    return sized.groupBy(*by).agg(F.max("all_").alias("n"), F.array(*parts).alias("q"))
