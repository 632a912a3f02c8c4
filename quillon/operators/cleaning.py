"""Cleaning: typed steps on a copy, strict parsing with rejects, and a fixed-order plan whose rows add up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import parsed_date, parsed_number, squeezed
from quillon.operators.ordered import quantiles
from quillon.operators.windows import mark_duplicates


class StepRefused(ValueError):
    """A strict step met a value that does not fit."""


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: squeezed(F.col(c)) for c in columns})


def remove_duplicates(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The row with the lowest id of each key stays."""
    return mark_duplicates(df, keys, row_id).filter(F.col("duplicate_of").isNull()).drop("duplicate_of")


def fill_value(df: DataFrame, column: str, method: str, constant=None):
    """What missing values become: median, mean, the most frequent (the least of ties), or a constant."""
    if method == "constant":
        return constant
    c = F.col(column)
    if method == "mode":
        counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).count().orderBy(F.desc("count"), F.asc("v")).first()
        return counts["v"] if counts else None
    if method == "median":
        found = quantiles(df, column, (0.5,)).first()
        return found["q"][0] if found and found["n"] else None
    return df.agg({"mean": F.avg}[method](c)).first()[0]


def fill_missing(df: DataFrame, column: str, method: str, constant=None) -> DataFrame:
    value = fill_value(df, column, method, constant)
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).cast(df.schema[column].dataType)))


def text_to_number(df: DataFrame, column: str, thousands: str = "", decimal: str = ".") -> DataFrame:
    """Any value that does not fit stops the step."""
    parsed = parsed_number(F.col(column), thousands, decimal)
    bad = df.filter(parsed["reason"].isNotNull()).limit(1).collect()
    if bad:
        raise StepRefused(f"{column}: not a number under the stated separators")
    return df.withColumn(column, parsed["value"])


def text_to_date(df: DataFrame, column: str, fmt: str) -> DataFrame:
    parsed = parsed_date(F.col(column), fmt)
    if df.filter(squeezed(F.col(column)).isNotNull() & parsed.isNull()).limit(1).collect():
        raise StepRefused(f"{column}: a value does not fit {fmt}")
    return df.withColumn(column, parsed)


def apply_steps(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps in order; undoing the last is applying all but it."""
    return reduce(lambda d, step: step(d), steps, df)


@dataclass(frozen=True)
class CleanPlan:
    """In this order: trim, empty columns, numbers, dates, duplicates. Nothing is published if more than ``max_reject_share`` is rejected."""

    trim: tuple[str, ...] = ()
    drop_empty: tuple[str, ...] = ()
    numbers: dict[str, tuple[str, str]] = field(default_factory=dict)
    dates: dict[str, str] = field(default_factory=dict)
    duplicates: tuple[str, ...] = ()
    row_id: str = "row_id"
    max_reject_share: float = 1.0


class TooManyRejects(ValueError):
    """More rows were rejected than the plan allows; a format is probably wrong."""


def clean(df: DataFrame, plan: CleanPlan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned rows, rejects (``row_id, operation, column, original_value, reason``; the first failing column) and duplicates.

    Every row is in one of the three. One pass beforehand finds empty columns, the share of rejects, and number columns whose
    values are all integers, which become integers.
    """
    both = [c for c in plan.numbers if c in plan.dates]
    if both:
        raise ValueError(f"a column can be parsed once: {', '.join(both)}")
    out = trim_text(df, plan.trim)
    parsed: list[Column] = []
    checks: list[Column] = []
    values: dict[str, Column] = {}

    def failed(test: Column, operation: str, c: str, reason: Column) -> Column:
        return F.when(test, F.struct(F.lit(operation).alias("operation"), F.lit(c).alias("column"), F.col(c).alias("original_value"), reason.alias("reason")))

    for k, (c, (thousands, decimal)) in enumerate(plan.numbers.items()):
        parsed.append(parsed_number(F.col(c), thousands, decimal).alias(f"n{k}"))
        p = F.col(f"parsed_.n{k}")
        checks.append(failed(p["reason"].isNotNull(), "parse_number", c, p["reason"]))
        values[c] = p["value"]
    for k, (c, fmt) in enumerate(plan.dates.items()):
        parsed.append(parsed_date(F.col(c), fmt).alias(f"d{k}"))
        d = F.col(f"parsed_.d{k}")
        checks.append(failed(F.col(c).isNotNull() & d.isNull(), "parse_date", c, F.lit("NOT_A_DATE")))
        values[c] = d
    if parsed:  # one row each: no filter is moved below a generator, so each value is trimmed and parsed once
        out = out.select("*", F.explode(F.array(F.struct(*parsed))).alias("parsed_"))
    out = out.withColumn("reject_", F.coalesce(*checks) if checks else F.lit(None).cast("struct<operation:string,column:string,original_value:string,reason:string>"))
    fine = F.col("reject_").isNull()
    integral = [F.bool_and(F.when(fine & F.col(f"parsed_.n{k}.value").isNotNull(), F.col(f"parsed_.n{k}.is_integer"))).alias(f"i{k}") for k in range(len(plan.numbers))]
    empty = [(F.count(c) == 0).alias(f"e{k}") for k, c in enumerate(plan.drop_empty)]
    if integral or empty or plan.max_reject_share < 1:
        found = out.agg(F.count("*").alias("rows"), F.count_if(~fine).alias("rejected"), *integral, *empty).first()
        if found["rejected"] > plan.max_reject_share * found["rows"]:
            raise TooManyRejects(f"{found['rejected']} of {found['rows']} rows were rejected")
        for k, c in enumerate(plan.numbers):
            if found[f"i{k}"]:
                values[c] = F.btrim(_without(F.col(c), plan.numbers[c][0])).cast("bigint")
        out = out.drop(*[c for k, c in enumerate(plan.drop_empty) if found[f"e{k}"]])
    rejects = out.filter(~fine).select(plan.row_id, "reject_.*")
    good = out.filter(fine).withColumns({c: v for c, v in values.items() if c in out.columns}).drop("reject_", "parsed_")
    if not plan.duplicates:
        return good, rejects, good.limit(0).select(plan.row_id, F.col(plan.row_id).alias("duplicate_of"))
    marked = mark_duplicates(good, plan.duplicates, plan.row_id)
    return marked.filter(F.col("duplicate_of").isNull()).drop("duplicate_of"), rejects, marked.filter(F.col("duplicate_of").isNotNull()).select(plan.row_id, "duplicate_of")


def _without(col: Column, mark: str) -> Column:
    return F.replace(col, F.lit(mark)) if mark else col


def fitting_formats(df: DataFrame, column: str, formats: Sequence[str]) -> DataFrame:
    """Which stated formats every date-like value fits: ``format, fits``; one pass."""
    text = squeezed(F.col(column))
    parts = [F.struct(F.lit(f).alias("format"), F.bool_and(parsed_date(text, f).isNotNull()).alias("fits")) for f in formats]
    return df.filter(text.isNotNull()).agg(F.array(*parts).alias("all")).select(F.inline("all"))


def suggest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Steps that text columns ask for: ``column, step``; from one pass over all rows."""
    parts = []
    for c in columns:
        text = squeezed(F.col(c))
        wanted = {
            "trim": F.bool_or(F.col(c) != text), "fill_missing": F.bool_or(text.isNull()),
            "to_number": F.bool_and(F.when(text.isNotNull(), parsed_number(text)["reason"].isNull())),
        }
        parts += [F.struct(F.lit(c).alias("column"), F.lit(step).alias("step"), w.alias("wanted")) for step, w in wanted.items()]
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all")).filter("wanted").select("column", "step")
