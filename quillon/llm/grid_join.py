"""Cosine near-duplicates of embeddings by an epsilon grid order join.

Equal vectors of a label become one class. Unit vectors are turned to their principal axes; on the leading ones they get
grid cells of side epsilon (the distance that the cosine threshold allows) and are sorted by cell, in lexicographic order, and
cut into sequence intervals with a bounding box on all leading axes. The join of a label's sequence with itself is recursive:
a pair of intervals whose boxes are provably further apart than epsilon is skipped, any other is replaced by the pairs of
their parts. Above the intervals of ``INTERVAL`` vectors the recursion goes over boxes alone (``pairs_of_intervals``: a tree
of intervals of intervals, one join a level); the vectors themselves go once to each pair of tiles of ``2**TILE`` intervals,
where the recursion goes on down to ``LEAF`` vectors, which are compared by cosine in double precision. Links leave as counts
for each vector and a spanning forest.

Defined results: a vector that is null, empty, zero or holds nulls or non-finite numbers, or whose label is null, links with
nothing and is its own component; vectors of different lengths never link; a null id links as any other but never names a
component unless all its ids are null; repeated rows are separate vectors; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, components
from .simhash import forest

AXES = 8
#: Vectors in an interval (a power of two), bits of the intervals in a tile, bits of the intervals that one above has.
INTERVAL, TILE, FAN = 4096, 2, 5
#: Block numbers: the partition's from this bit on.
OWN = 24
LEAF = 64
SLACK = 1e-6
#: Longer vectors are seen through as many random axes when the principal ones are sought.
SEEN = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _seen(dim: int) -> np.ndarray:
    """Orthonormal axes (columns) among which the principal ones are sought: all, or ``SEEN`` random ones."""
    if dim <= SEEN:
        return np.eye(dim)
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, SEEN)))[0]


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of outer products, by dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            u = unit(np.array(part["embedding"].tolist(), dtype=np.float64)) @ _seen(int(dim))
            total[dim] = total.get(dim, 0) + u.T @ u
    for dim, matrix in total.items():
        for i, row in enumerate(matrix):
            yield pd.DataFrame({"dim": [dim] * len(row), "i": [i] * len(row), "j": range(len(row)), "v": row})


def principal_axes(classes: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """By dimension d, a d x axes matrix of orthonormal columns; from all vectors. At most SEEN squared numbers a dimension come to the driver."""
    sums = classes.select("dim", "embedding").mapInPandas(_moments, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    found = {}
    for dim, part in sums.toPandas().groupby("dim"):
        own = _seen(int(dim))
        matrix = np.zeros((own.shape[1], own.shape[1]))
        matrix[part["i"], part["j"]] = part["v"]
        found[int(dim)] = np.ascontiguousarray(own @ np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1][:, :axes])
    return found


def pairs_of_intervals(boxes: DataFrame, eps: float, shelf: Shelf) -> DataFrame:
    """Pairs ``block <= block_b`` of one label and dimension whose boxes are within eps; rows ``label, dim, block, low, high``.

    Intervals above are numbered by their parts' numbers without the last bits. Only pairs that are near go down a level.
    """
    last = boxes.agg(F.max(F.expr(f"block & {(1 << OWN) - 1}")), F.max(F.expr(f"block >> {OWN}"))).first()
    if last[0] is None:
        return boxes.select("block", F.col("block").alias("block_b"))
    shifts = [*range(0, max(1, int(last[0]).bit_length()), FAN), *range(OWN, OWN + int(last[1]).bit_length() + FAN, FAN)]
    axis = lambda f, c: F.array(*[f(F.get(c, F.lit(k))) for k in range(AXES)])
    levels = [
        boxes.groupBy("label", "dim", F.shiftright("block", s).alias("at")).agg(axis(F.min, "low").alias("low"), axis(F.max, "high").alias("high"), F.min(F.shiftright("block", up)).alias("above"))
        for s, up in zip(shifts, [*shifts[1:], 63], strict=True)
    ]
    gap = "aggregate(zip_with(zip_with(low, high_b, (x, y) -> greatest(0D, x - y)), zip_with(low_b, high, (x, y) -> greatest(0D, x - y)), (p, q) -> coalesce(p * p + q * q, 0D)), 0D, (s, x) -> s + x)"
    near = levels[-1].select("label", "dim", "at", F.col("at").alias("at_b"))
    near = near.join(near.select("label", "dim", F.col("at").alias("other")), ["label", "dim"]).filter("at <= other").select("label", "dim", "at", F.col("other").alias("at_b"))
    for parts in reversed(levels[:-1]):
        left = parts.select("label", "dim", F.col("above").alias("at"), F.col("at").alias("part"), "low", "high")
        right = parts.select("label", "dim", F.col("above").alias("at_b"), F.col("at").alias("part_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
        near = near.join(left, ["label", "dim", "at"]).join(right, ["label", "dim", "at_b"]).filter(f"part <= part_b and {gap} <= {eps * eps}")
        near = near.select("label", "dim", F.col("part").alias("at"), F.col("part_b").alias("at_b"))
    return shelf.put(near.select(F.col("at").alias("block"), F.col("at_b").alias("block_b")), "near")


def join_intervals(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, near: float, eps: float, same: bool):
    """Index pairs (i in a, j in b) of unit vectors with cosine at least ``near``; pa, pb: places on the leading axes."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue
        gap = np.maximum(0, np.maximum(pa[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa[i:j].max(0)))
        if float(gap @ gap) > eps * eps:
            continue
        if max(j - i, m - k) > LEAF:
            if j - i >= m - k:
                half = (i + j) // 2
                todo += [(i, half, k, m), (half, j, k, m)]
            else:
                half = (k + m) // 2
                todo += [(i, j, k, half), (i, j, half, m)]
            continue
        x, y = np.nonzero(a[i:j] @ b[k:m].T >= near)
        x, y = x + i, y + k
        if same:
            x, y = x[x < y], y[x < y]
        yield x, y


def link_vectors(table: DataFrame, near: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    spark = table.sparkSession
    shelf = Shelf(spark, "grid")
    eps = sqrt(max(0.0, 2 - 2 * near)) + SLACK
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    # single precision stays so on its way
    number = np.float32 if dict(table.dtypes)[vector_col] == "array<float>" else np.float64
    rows = shelf.put(
        table.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("embedding"), F.col(f"`{label_col}`").alias("label"))
        .withColumn("fine", F.col("label").isNotNull() & F.coalesce(
            F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"), F.lit(False)))
        .withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(7), F.col("embedding"), F.lit(11))),
        "rows",
    )
    key = ["label", "k1", "k2"]
    classes = shelf.put(
        rows.filter("fine").groupBy(*key).agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")),
        "classes",
    )
    axes = principal_axes(classes, AXES)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"], batch["at"] = None, None
            for dim, part in batch.groupby("dim"):
                at = unit(np.array(part["embedding"].tolist(), dtype=np.float64)) @ axes[int(dim)]
                batch.loc[part.index, "at"] = pd.Series(list(at), index=part.index)
                batch.loc[part.index, "cell"] = pd.Series(list(np.floor(at / eps).astype(np.int32)), index=part.index)
            yield batch

    fields = classes.schema.simpleString()[7:-1]
    placed = classes.mapInPandas(place, f"{fields},cell:array<int>,at:array<double>")
    pieces = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + classes.count() // INTERVAL)
    order = ["label", "dim", "cell", "k1", "k2"]
    label_type = dict(classes.dtypes)["label"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held = (TaskContext.get().partitionId() << OWN) - 1, []

        def interval(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal block
            at = np.array(part["at"].tolist())
            block += 1
            return pd.DataFrame({
                "label": [part["label"].iloc[0]], "dim": [part["dim"].iloc[0]], "block": [block], "low": [at.min(0)], "high": [at.max(0)],
                "vectors": [np.array(part["embedding"].tolist(), dtype=number).tobytes()], "copies": [part["copies"].to_numpy(np.int64)],
                "k1": [part["k1"].to_numpy(np.int64)], "k2": [part["k2"].to_numpy(np.int64)], "least": [part["least"].tolist()],
            })

        def cuts(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held
            whole = pd.concat(held, ignore_index=True)
            change = (whole["label"] != whole["label"].shift()) | (whole["dim"] != whole["dim"].shift())
            starts = [*np.flatnonzero(change), len(whole)]
            held = []
            for s, e in zip(starts, starts[1:], strict=False):
                for k in range(s, e, INTERVAL):
                    if not last and e == len(whole) and k + INTERVAL > e:
                        held = [whole.iloc[k:e]]
                    else:
                        yield interval(whole.iloc[k : min(e, k + INTERVAL)])

        for batch in batches:
            if len(batch):
                held.append(batch)
                if sum(map(len, held)) >= 2 * INTERVAL:
                    yield from cuts(False)
        if held:
            yield from cuts(True)

    id_type = dict(classes.dtypes)["least"]
    blocks = shelf.put(
        placed.repartitionByRange(pieces, *order).sortWithinPartitions(*order).mapInPandas(
            cut,
            f"label {label_type}, dim int, block long, low array<double>, high array<double>, vectors binary, "
            f"copies array<long>, k1 array<long>, k2 array<long>, least array<{id_type}>",
        ),
        "blocks",
    )
    pairs = pairs_of_intervals(blocks.select("label", "dim", "block", "low", "high"), eps, shelf)
    # what a pair of tiles compares: each of its intervals once, with the later ones that it is near to
    tiles = F.struct(F.shiftright("block", TILE).alias("a"), F.shiftright("block_b", TILE).alias("b")).alias("tiles")
    members = pairs.select(tiles, "block", "block_b").unionByName(pairs.select(tiles, F.col("block_b").alias("block"), F.lit(None).cast("long").alias("block_b")))
    members = members.groupBy("tiles", "block").agg(F.collect_set("block_b").alias("partners"))
    work = members.join(blocks.select("block", "dim", "vectors", "copies"), "block")

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        ids, dims, first = part["block"].to_pylist(), part["dim"].to_pylist(), [0]
        units, places = [], []
        for dim, data in zip(dims, part["vectors"], strict=True):
            units.append(unit(np.frombuffer(data.as_buffer(), dtype=number).reshape(-1, dim).astype(np.float64)))
            places.append(units[-1] @ axes[dim])
            first.append(first[-1] + len(units[-1]))
        at = dict(zip(ids, range(len(ids)), strict=True))
        weight = np.concatenate([np.asarray(c.values) for c in part["copies"]]).astype(np.int64)
        everything = np.arange(first[-1])
        count, label = np.zeros(first[-1], dtype=np.int64), everything
        for i, partners in enumerate(part["partners"].to_pylist()):
            for j in sorted(at[p] for p in partners):
                for x, y in join_intervals(units[i], units[j], places[i], places[j], near, eps, i == j):
                    x, y = x + first[i], y + first[j]
                    np.add.at(count, x, weight[y])
                    np.add.at(count, y, weight[x])
                    if len(x) and (label[x] != label[y]).any():
                        label = forest(np.r_[x, everything], np.r_[y, label], first[-1])
        cid = np.concatenate([b * INTERVAL + np.arange(n) for b, n in zip(ids, np.diff(first), strict=True)])
        hit = np.flatnonzero(count)
        return pa.table([cid[hit], cid[label[hit]], count[hit]], names=["src", "dst", "n"])

    found = shelf.put(work.groupBy("tiles").applyInArrow(compare, "src long, dst long, n long"), "found")
    counts = found.groupBy(F.col("src").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.select("src", "dst"), shelf).select(F.col("node").alias("cid"), "root")
    members = blocks.select("label", F.col("block"), F.posexplode(F.arrays_zip("k1", "k2", "copies", "least"))).select(
        "label", (F.col("block") * INTERVAL + F.col("pos")).alias("cid"), "col.*"
    )
    known = shelf.put(
        members.join(counts, "cid", "left").join(roots, "cid", "left").select(
            *key, "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")
        ),
        "known",
    )
    # joined by an expression, so that both sides are shuffled and a large component can be split at run time
    names = known.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("of"), "component_id")
    named = shelf.put(known.withColumn("of", F.bitwise_not("root")).join(names, "of").select(*key, "n_links", "component_id"), "named")
    on = [rows[k] == named[k] for k in key] + [rows["fine"]]
    return rows.join(named, on, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
