"""Shared plumbing: written intermediate tables, memory of Python workers, connected components, and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart in one step.
TEXT_AT_ONCE = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``; one of our own only where a local session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Shelf:
    """Intermediate tables written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back; the plan behind it is cut, and what it shuffled is removed once the table is there."""
        before = self.spark.conf.get(CLEANED, "false")
        self.spark.conf.set(CLEANED, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANED, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _clear(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session has ended
            return


def portions(batch: pa.RecordBatch, *places: int) -> Iterator[pa.RecordBatch]:
    """All rows in slices of ``TEXT_AT_ONCE`` bytes at most in the text columns at these places, or of one row."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in places)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Give the memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for ``mapInArrow``, but a worker, which later stages use again, doesn't keep what a task has freed."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return freed


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def packed_row(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``row``, so that none can clash with the named keys beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def unused(name: str, docs: DataFrame) -> str:
    """The name, with low lines added until no column has it (Spark's names don't tell upper from lower case)."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """Connected components of an undirected graph (``src``, ``dst``: long) as rows (``node``, ``root``).

    Each round hooks every node to its least neighbour, follows parents to their roots by doubling, and contracts the
    edges. A contracted tree has two nodes or more, so the rounds are logarithmic in the number of nodes. All state is
    in written tables; the driver sees only counts. The root is the least node of the component.
    """
    edges = shelf.put(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct(),
        "edges-0",
    )
    total, step = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parents = shelf.put(
            both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
            .select("node", F.least("node", "near").alias("root")),
            f"parents-{step}-0",
        )
        jump = 0
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            moved = shelf.put(
                parents.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")),
                f"parents-{step}-{jump + 1}",
            )
            shelf.drop(f"parents-{step}-{jump}")
            jump += 1
            parents = moved.select("node", "root")
            if moved.filter("moved").isEmpty():
                break
        ends = parents.select(F.col("node").alias("src"), F.col("root").alias("a"))
        more = parents.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        left = shelf.put(
            edges.join(ends, "src").join(more, "dst").filter("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
            f"edges-{step + 1}",
        )
        if total is None:
            merged = parents
        else:
            merged = total.join(parents.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select(
                "node", F.coalesce("higher", "root").alias("root")
            )
        total = shelf.put(merged, f"total-{step}")
        edges, step = left, step + 1
    if total is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return total
