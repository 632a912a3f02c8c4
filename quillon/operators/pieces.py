"""How many pieces a table is cut into, so that the share of one task does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files for one piece.
PIECE = 8_000_000
#: Spark's estimate for what it knows nothing of is far beyond this.
UNKNOWN = 1 << 60


def pieces(df: DataFrame, times: int = 1) -> int:
    """``times`` for each ``PIECE`` bytes of the files the table is read from, but no fewer than there are shuffle partitions. Nothing is read for it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-times * sum(x for x in sizes if x < UNKNOWN) // PIECE))
