"""Deterministic sharding: a Feistel permutation with cycle walking over global row numbers.

Row ``r`` of ``n`` moves to place ``p = permute(r)``; its shard is ``p mod shards`` and its slot ``p div shards``. Both can
be computed from the row number alone, and shard sizes differ by one at most (law ``rows``).

Rows that agree in id, size, checksum and hash of the text are interchangeable: each gets its own number.

Defined results: a null text has no bytes (its crc is 0); a null id is a value like any other; equal rows get
different numbers; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf

ROUNDS = 8
ROWS_A_BUCKET = 100_000
LEAST_BUCKETS = 4096


def radices(n: int) -> tuple[int, int]:
    """Two factors whose product is the least domain of this kind that holds 0 to n-1."""
    high = max(1, isqrt(max(0, n - 1)) + 1)
    return high, max(1, -(-n // high))


def feistel(place: str, n: int, key: int) -> str:
    """SQL for one pass of the permutation of [0, a*b) over the SQL expression ``place``."""
    a, b = radices(n)
    start = f"named_struct('l', {place} div {b}L, 'r', {place} % {b}L)"
    swap = (
        f"named_struct('l', if(k % 2 = 0, pmod(s.l + pmod(xxhash64(s.r, k, {key}L), {a}L), {a}L), s.l), "
        f"'r', if(k % 2 = 1, pmod(s.r + pmod(xxhash64(s.l, k, {key}L), {b}L), {b}L), s.r))"
    )
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, k) -> {swap}, s -> s.l * {b}L + s.r)"


def longest_walk(spark: SparkSession, n: int, key: int) -> int:
    """How often the permutation must be applied until every place is below n; only the 2*sqrt(n) places beyond n matter."""
    a, b = radices(n)
    beyond = spark.range(n, a * b).select(F.col("id").alias("p"))
    passes = 1
    while True:
        beyond = beyond.select(F.expr(feistel("p", n, key)).alias("p")).filter(F.col("p") >= n)
        if beyond.isEmpty():
            return passes + 1
        passes += 1


def permute(row_number: str, n: int, key: int, passes: int) -> Column:
    """The place of a row: cycle walking until it is below n, in at most ``passes`` passes."""
    once = feistel("p", n, key)
    return F.expr(f"aggregate(sequence(1, {passes}), {row_number}, (p, i) -> if(i = 1 or p >= {n}L, {once}, p))")


def number_rows(rows: DataFrame, keys: list[str], shelf: Shelf) -> tuple[DataFrame, int]:
    """``rows`` with a dense global number from 0 (``row_``), in the order of a hash bucket and then of ``keys``; also how many.

    Equal rows are one row with their count until they are numbered: the count is dealt over runs of ``ROWS_A_BUCKET`` at most
    and each run is numbered by arithmetic, so no number depends on how the input is partitioned. Buckets follow the number of
    rows; only one sum a bucket comes together in one place.
    """
    counted = shelf.put(rows.groupBy(*keys).agg(F.count("*").alias("times_")), "counted")
    n = counted.agg(F.sum("times_")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-n // ROWS_A_BUCKET))
    bucketed = counted.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("bucket_").agg(F.sum("times_").alias("in_")).select(
        F.col("bucket_").alias("of_"), F.coalesce(F.sum("in_").over(before), F.lit(0)).alias("offset_")
    )
    within = Window.partitionBy("bucket_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = bucketed.withColumn("first_", F.coalesce(F.sum("times_").over(within), F.lit(0))).join(offsets, F.col("bucket_") == F.col("of_"))
    first = shelf.put(first.select(*keys, "times_", (F.col("first_") + F.col("offset_")).alias("first_")), "first")
    shelf.drop("counted")
    once = first.filter("times_ = 1").select(*keys, F.col("first_").alias("row_"))
    often = first.filter("times_ > 1").withColumn("run_", F.explode(F.expr(f"sequence(0L, (times_ - 1) div {ROWS_A_BUCKET})")))
    often = often.repartition(*keys, "run_").withColumn(
        "row_", F.explode(F.expr(f"sequence(first_ + run_ * {ROWS_A_BUCKET}, first_ + least(times_, (run_ + 1) * {ROWS_A_BUCKET}) - 1)"))
    )
    return once.unionByName(often.select(*keys, "row_")), n


def shard(docs: DataFrame, shards: int = 40, key: int = 20_231, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number``."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "shard")
    text = F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash_"),
    )
    numbered, n = number_rows(narrow, ["doc_id", "hash_", "size", "text_crc32"], shelf)
    if n == 0:
        placed = numbered.withColumn("place_", F.col("row_").cast("long"))
    else:
        placed = numbered.withColumn("place_", permute("row_", n, key, longest_walk(spark, n, key)))
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place_") % shards).cast("int").alias("shard"),
        F.expr(f"place_ div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("row_").cast("long").alias("row_number"),
    )
