"""Row and column filters with stated null behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import NUMBER, without_marker


class EmptyResult(ValueError):
    """A filter left no row."""


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with one of the values; rows without a value go."""
    return df.filter(F.col(column).isin(*values))


def drop_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows without these values; rows without a value stay."""
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def keep_between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range, either end open; rows without a value go."""
    if low is not None and high is not None and low > high:
        raise ValueError("the low end is above the high end")
    test = F.col(column).isNotNull()
    if low is not None:
        test = test & (F.col(column) >= F.lit(low))
    if high is not None:
        test = test & (F.col(column) <= F.lit(high))
    return df.filter(test)


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyResult("the filter leaves no row")
    return df


def column_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How values of each column compare, from one pass: ``column_name, kind`` (date, number, or text; a leading zero makes it text)."""
    parts = []
    for c in columns:
        text = F.btrim(F.col(c).cast("string"))
        day = F.bool_and(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull())
        number = F.bool_and(text.rlike(NUMBER) & ~text.rlike(r"^[+-]?0[0-9]"))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.when(day, "date").when(number, "number").otherwise("text").alias("kind")))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def column_kind(df: DataFrame, column: str) -> str:
    """The same for one column."""
    return column_kinds(df, [column]).first()["kind"]


def renamed(df: DataFrame, names: dict[str, str], values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Only these columns under their new names; ``values``: by new name, what each value is called. A value that is not listed is an error."""
    require_columns(df, list(names))
    out = []
    for old, new in names.items():
        c = F.col(old)
        if table := (values or {}).get(new):
            known = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)
            unknown = F.raise_error(F.concat(F.lit(f"{old} has no name for "), c.cast("string"))).cast("string")
            c = F.when(c.isNull(), None).when(known.isNotNull(), known).otherwise(unknown)
        out.append(c.alias(new))
    return df.select(*out)


def drop_missing(df: DataFrame, columns: Sequence[str], markers: Sequence[str] = ()) -> DataFrame:
    test = None
    for c in columns:
        one = without_marker(F.col(c), markers).isNotNull()
        test = one if test is None else test & one
    return df.filter(test)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    if len(df.columns) == 1:
        raise ValueError("the last column can't go")
    return df.drop(column)


def drop_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] == 0])


def masked(value: Column, test: Column) -> Column:
    """The value where the test holds, else null."""
    return F.when(test, value)


def require_numeric(df: DataFrame, column: str) -> None:
    if not dict(df.dtypes)[column].startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")):
        raise TypeError(f"{column} is not numeric; text is never coerced")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if absent := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such column: {', '.join(absent)}")


def scoped(df: DataFrame, column: str, scope) -> DataFrame:
    """Only the rows of one scope; a missing scope is refused rather than read as all."""
    if scope is None:
        raise ValueError("a scope is required")
    require_columns(df, [column])
    return df.filter(F.col(column) == F.lit(scope))


def leads(df: DataFrame, url: str, wanted: Column, found: Column, least: float = 0.5) -> DataFrame:
    """Leads with ``relevance, mismatches`` and the ``reason`` to drop them, if any: about another place or year, off the topic, or a URL seen before.

    Of equal URLs (without fragment and closing slash) the least as written stays.
    """
    from quillon.functions import scalars as S

    named = sorted({word for names in S.PLACES.values() for word in names.replace("|", " ").split()})
    topic = F.filter(S.terms(wanted), lambda w: ~w.rlike(r"^(19[5-9]|20[0-9])[0-9]$") & ~w.isin(named))
    rows = df.withColumn("key_", S.normal_url(F.col(url))).withColumn("mismatches", S.mismatches(wanted, found)).withColumn("relevance", F.coalesce(S.overlap(topic, S.terms(found)), F.lit(1.0)))
    first = rows.groupBy("key_").agg(F.min(url).alias("first_"))
    rows = rows.join(first, "key_").drop("key_")
    reason = F.when(F.size("mismatches") > 0, "MISMATCH").when(F.col("relevance") < least, "OFF_TOPIC").when(F.col(url) != F.col("first_"), "REPEATED_URL")
    return rows.withColumn("reason", reason).drop("first_")


def provenance(df: DataFrame, table: str, row_id: str, url: Column, retrieved: Column, digest: Column) -> DataFrame:
    """Where each row is from: ``source_url, retrieved_at, content_sha256, source_table, source_row``, after its own columns."""
    return df.select("*", url.alias("source_url"), retrieved.alias("retrieved_at"), digest.alias("content_sha256"), F.lit(table).alias("source_table"), F.col(row_id).alias("source_row"))
