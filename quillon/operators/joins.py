"""Joins of the analytics: star, comparison of two sides, grids, lookups, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import matching_key


def star(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, part: DataFrame) -> DataFrame:
    """Facts by dimension names: ``entity, unit, event, category, tier, day``. Which sides are sent to all tasks is left to sizes."""
    return (
        lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
        .join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("n_name").alias("entity"), F.col("p_brand").alias("unit"), F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("category"),
            F.col("l_returnflag").alias("tier"), F.to_date("l_shipdate").alias("day"),
        )
    )


def fact_view(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]], optional: Sequence[tuple[DataFrame, str, str]] = (), current: Column | None = None) -> DataFrame:
    """A fact table with its dimensions (table, key there, key here), inner; optional ones keep facts without a match; current rows only."""
    out = fact if current is None else fact.filter(current)
    for tables, how in ((dimensions, "inner"), (optional, "left")):
        for table, theirs, ours in tables:
            out = out.join(table, F.col(theirs) == F.col(ours), how)
    return out


def compare_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both sides' values by key with zero for an absent one, and their difference; only keys that differ."""
    left, right = a.select(*keys, F.col(value).alias("ours")), b.select(*keys, F.col(value).alias("theirs"))
    both = left.join(right, list(keys), "full_outer").na.fill(0, ["ours", "theirs"])
    return both.withColumn("delta", F.col("ours") - F.col("theirs")).filter(F.col("delta") != 0)


def dense_counts(df: DataFrame, keys: Sequence[str], domains: dict[str, Sequence[str]]) -> DataFrame:
    """Counts over the whole grid of entities and stated categories, zero cells included."""
    first = keys[0]
    grid = df.select(first).distinct()
    for k, values in domains.items():
        grid = grid.withColumn(k, F.explode(F.array(*map(F.lit, values))))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.join(counts, list(keys), "left").na.fill(0, ["n"])


def missing_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of the grid that have no row: the grid is the domain of the result."""
    return df.select(a).distinct().crossJoin(df.select(b).distinct()).join(df.select(a, b).distinct(), [a, b], "left_anti")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group; pre-aggregated, so a hot group is no problem."""
    rest = [c for c in df.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*by).agg(newest.alias("m")).select(*by, *[F.col(f"m.{c}").alias(c) for c in rest])


def differing_claims(df: DataFrame, key: Sequence[str], value: str, row_id: str) -> DataFrame:
    """Each distinct value of a key against the value first seen, where they differ: no pairs within a key."""
    values = df.groupBy(*key, value).agg(F.min(row_id).alias("seen"))
    w = Window.partitionBy(*key).orderBy("seen")
    first = values.withColumn("first_value", F.first(value).over(w)).withColumn("first_seen", F.first("seen").over(w))
    return first.filter(F.col(value) != F.col("first_value"))


def conflict_pairs(df: DataFrame, key: Sequence[str], value: str, row_id: str) -> DataFrame:
    """Pairs a < b of a key with different values; a self join on the key with an inequality."""
    a, b = df.select(*key, F.col(row_id).alias("a"), F.col(value).alias("value_a")), df.select(*key, F.col(row_id).alias("b"), F.col(value).alias("value_b"))
    return a.join(b, list(key)).filter("a < b and value_a <> value_b")


def resolve_alias(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Lookup by matching key; a miss is a row with a reason. ``aliases``: ``alias, target``."""
    keyed = aliases.select(matching_key(F.col("alias")).alias("key_"), "target").dropDuplicates(["key_"])
    out = df.withColumn("key_", matching_key(F.col(column))).join(keyed, "key_", "left").drop("key_")
    return out.withColumn("reason", F.when(F.col("target").isNull(), F.concat(F.lit("UNKNOWN_"), F.upper(F.lit(column)))))


def longest_suffix(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """The rule whose domain is the longest suffix of a host: equi-join over the host's own suffixes."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = df.select(host).distinct().withColumn("suffix", F.explode(suffixes))
    best = hosts.join(rules.select(F.col("domain").alias("suffix"), "rule"), "suffix").groupBy(host).agg(F.max_by("rule", F.length("suffix")).alias("rule"))
    return df.join(best, host, "left")


def parent_policy(df: DataFrame, host: str, policies: DataFrame) -> DataFrame:
    """The policy of a host or of the nearest domain above it; a bare top-level domain has none."""
    return longest_suffix(df, host, policies.filter(F.col("domain").contains(".")))


def single_cell(df: DataFrame, test: Column, column: str) -> DataFrame:
    """One row with the value of the only row that fits; any other number of rows stops the query when it runs."""
    found = df.filter(test).agg(F.any_value(column).alias("value"), F.count("*").alias("rows_"))
    return found.select(F.when(F.col("rows_") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("rows that fit: "), F.col("rows_").cast("string")))).alias("value"))


def alias_clashes(aliases: DataFrame, key: Column, target: str) -> DataFrame:
    """Keys that stand for more than one target: ``alias, targets``."""
    return aliases.groupBy(key.alias("alias")).agg(F.count_distinct(target).alias("targets")).filter("targets > 1")
