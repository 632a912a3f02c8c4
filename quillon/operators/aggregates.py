"""Group aggregation, profiles, value counts, trends and the entity-by-unit metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import divided, period_label, period_start, value_class, value_hint
from quillon.operators.pieces import pieces

NO_VALUE, REST = "(null)", "(other)"
FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "distinct")
TIERS = ("A", "N", "R")
WEIGHTS = (3, 2, 1)


def parse_metric(text: str) -> tuple[str, str]:
    """``column:function``, split at the last colon; ``rows`` alone counts rows."""
    if text == "rows":
        return "", "rows"
    column, _, function = text.rpartition(":")
    if not column or function not in FUNCTIONS:
        raise ValueError(f"a metric is column:function with one of {', '.join(FUNCTIONS)}")
    return column, function


def metric(column: str, function: str, kind: str = "") -> Column:
    """One aggregate. Sums of integers raise on overflow; a mean of integers is an exact sum over the count."""
    c = F.col(column)
    if function == "mean" and kind in ("int", "bigint"):
        return F.sum(c.cast("decimal(38,0)")).cast("double") / F.count(c)
    return {
        "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "distinct": F.count_distinct,
    }[function](c)


def group_aggregate(df: DataFrame, by: Sequence[str], metrics: Sequence[str], sort_by: str | None = None) -> DataFrame:
    """One to three keys, metrics ``column:function``, a ``rows`` column; a null key is kept as a label; total order."""
    if not 1 <= len(by) <= 3 or len(metrics) > 20:
        raise ValueError("one to three keys and at most twenty metrics")
    kinds = dict(df.dtypes)
    found = []
    for m in metrics:
        column, function = parse_metric(m)
        if function in ("sum", "mean", "median") and kinds[column] == "string":
            raise TypeError(f"{column} is text; it is never coerced")
        found.append(metric(column, function, kinds[column]).alias(f"{column}_{function}"))
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), *found)
    order = [F.col(k).asc_nulls_last() for k in by]
    out = out.orderBy(*([F.col(sort_by).desc_nulls_last()] if sort_by else []), *order)
    return out.select(*[F.coalesce(F.col(k).cast("string"), F.lit(NO_VALUE)).alias(k) for k in by], *[c for c in out.columns if c not in by])


def value_counts(df: DataFrame, column: str, top: int = 50, normalize: bool = False) -> DataFrame:
    """The most frequent values in order, the others as one last row; ``normalize``: with their share of all rows.

    Only the first ``top`` counts come together in one task; the rest is what all rows have beyond them.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    first = counts.orderBy(F.desc("rows"), F.col("value").asc_nulls_last()).limit(top)
    named = first.select(F.coalesce(F.col("value").cast("string"), F.lit(NO_VALUE)).alias("value"), "rows", F.row_number().over(Window.orderBy(F.desc("rows"), F.col("value").asc_nulls_last())).alias("place"))
    every = counts.agg(F.sum("rows").alias("all"), F.count("*").alias("values"))
    listed = named.agg(F.sum("rows").alias("listed"))
    rest = every.crossJoin(listed).filter(F.col("values") > top).select(F.lit(REST).alias("value"), (F.col("all") - F.col("listed")).alias("rows"), F.lit(top + 1).alias("place"))  # one row each
    out = named.unionByName(rest)
    if normalize:
        out = out.crossJoin(every.select("all")).withColumn("share", F.col("rows") / F.col("all")).drop("all")  # one row
    return out.orderBy("place")


#: The columns of a description, in order.
DESCRIBED = ("column", "type", "count", "nulls", "distinct", "min", "max", "mean", "median", "std", "p25", "p75", "min_length", "max_length", "mean_length")


def kind_of(spark_type: str) -> str:
    """The kind of a Spark type: integer, decimal, text, boolean, date, datetime or other."""
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return "decimal"
    return {"string": "text", "timestamp": "datetime", "timestamp_ntz": "datetime"}.get(spark_type, spark_type if spark_type in ("boolean", "date") else "other")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """15 columns about each column, in the table's order, from one pass; what does not apply is null. Exact quartiles, interpolated."""
    kinds = {c: kind_of(t) for c, t in df.dtypes}
    if columns is not None and (absent := [c for c in columns if c not in kinds]):
        raise KeyError(f"no column {', '.join(absent)}")
    parts = []
    for place, c in enumerate(x for x in df.columns if columns is None or x in columns):
        v, kind = F.col(f"`{c}`"), kinds[c]
        number = lambda x, kind=kind: (x if kind in ("integer", "decimal") else F.lit(None)).cast("double")
        length = lambda x, kind=kind: x if kind == "text" else F.lit(None)
        parts.append(F.struct(
            F.lit(place).alias("place"), F.lit(c).alias("column"), F.when(F.count(v) == 0, "empty").otherwise(kind).alias("type"), F.count(v).alias("count"), F.count_if(v.isNull()).alias("nulls"), F.count_distinct(v).alias("distinct"),
            F.min(v).cast("string").alias("min"), F.max(v).cast("string").alias("max"), number(metric(c, "mean", dict(df.dtypes)[c]) if kind in ("integer", "decimal") else F.lit(None)).alias("mean"),
            number(F.percentile(number(v), F.lit(0.5))).alias("median"), number(F.stddev_samp(number(v))).alias("std"), number(F.percentile(number(v), F.lit(0.25))).alias("p25"), number(F.percentile(number(v), F.lit(0.75))).alias("p75"),
            length(F.min(F.length(length(v)))).cast("int").alias("min_length"), length(F.max(F.length(length(v)))).cast("int").alias("max_length"), length(F.avg(F.length(length(v)))).cast("double").alias("mean_length"),
        ))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all")).orderBy("place").select(*DESCRIBED)


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"))


CLASSES = ("boolean", "integer", "decimal", "date", "datetime", "text", "empty")


def profile(df: DataFrame, columns: Sequence[str], row_id: str | None = None, examples: int = 5) -> DataFrame:
    """What text columns hold, from one pass over all rows: nothing is sampled.

    ``column``, counts of each class of values, ``type`` of the column, ``rows``, ``nulls`` and their ``null_share`` (6 places),
    ``distinct``, ``least`` and ``most`` as text, ``hints``; with ``row_id`` the first ``examples`` distinct values with their rows.
    """
    parts = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        k = value_class(text)
        here = F.when(k != "empty", text)
        parts.append(F.struct(
            F.lit(c).alias("column"), *[F.count_if(k == name).alias(f"n_{name}") for name in CLASSES], F.count("*").alias("rows"), F.count_if(k == "empty").alias("nulls"),
            F.count_distinct(here).alias("distinct"), F.min(here).alias("least"), F.max(here).alias("most"), F.array_sort(F.collect_set(value_hint(text))).alias("hints"),
        ))
    out = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    present = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, k) for k in CLASSES[:-1]]))
    only = lambda *names: F.size(F.array_except("present", F.array(*map(F.lit, names)))) == 0
    kind = F.when(F.size("present") == 0, "empty").when(F.size("present") == 1, F.get("present", F.lit(0))).when(only("integer", "decimal"), "decimal").when(only("date", "datetime"), "datetime").otherwise("mixed")
    out = out.withColumn("present", present).withColumn("type", kind).withColumn("null_share", F.round(F.try_divide("nulls", "rows"), 6)).drop("present")
    if row_id is None:
        return out
    each = df.select(F.col(row_id).alias("row"), F.inline(F.array(*[F.struct(F.lit(c).alias("of"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    first = each.filter(value_class(F.col("value")) != "empty").groupBy("of", "value").agg(F.min("row").alias("row"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("row", "value"))).filter(F.col("place") <= examples)
    shown = first.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("examples"))
    return out.join(shown, F.col("column") == F.col("of"), "left").drop("of")


def column_type(counts: dict[str, int]) -> str:
    """The type of a column from the counts of its values' types."""
    present = {k for k, v in counts.items() if v and k != "empty"}
    if not present:
        return "empty"
    if len(present) == 1:
        return present.pop()
    if present == {"integer", "decimal"}:
        return "decimal"
    return "datetime" if present == {"date", "datetime"} else "mixed"


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each distinct row."""
    return df.groupBy(*columns).count().agg((F.sum("count") - F.count("*")).alias("duplicates"))


MOST_PERIODS = 100_000


def time_trend(df: DataFrame, date_column: str, metric_column: str = "", function: str = "rows", freq: str = "month", start=None, end=None) -> DataFrame:
    """``period, rows, value`` in order over a dense calendar, from ``start`` to ``end`` where these are given, else from the first to the last day.

    An empty period has no rows and no value. More than ``MOST_PERIODS`` periods are an error.
    """
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("the start is after the end")
    day, one = F.to_date(date_column), {"day": "1 day", "month": "1 month", "quarter": "3 month", "year": "1 year"}[freq]
    inside = df.filter(F.col(date_column).isNotNull())
    if start is not None:
        inside = inside.filter(day >= F.to_date(F.lit(str(start))))
    if end is not None:
        inside = inside.filter(day <= F.to_date(F.lit(str(end))))
    value = F.lit(None).cast("double") if function == "rows" else metric(metric_column, function, dict(df.dtypes)[metric_column])
    grouped = inside.groupBy(period_start(F.col(date_column), freq).alias("day")).agg(F.count("*").alias("rows"), value.alias("value"))
    bound = lambda x, seen: F.coalesce(period_start(F.to_date(F.lit(str(x))), freq), seen) if x is not None else seen
    span = grouped.agg(bound(start, F.min("day")).alias("a"), bound(end, F.max("day")).alias("b")).filter("a is not null and b is not null and a <= b")
    days = F.sequence("a", "b", F.expr(f"interval {one}"))
    checked = F.when(F.size(days) <= MOST_PERIODS, days).otherwise(F.raise_error(F.lit("too many periods; take a coarser one")).cast("array<date>"))
    dense = span.select(F.explode(checked).alias("day"))
    out = dense.join(grouped, "day", "left").orderBy("day")
    return out.select(period_label(F.col("day"), freq).alias("period"), F.coalesce("rows", F.lit(0)).alias("rows"), "value")


# ---- entity by unit ----


def tier_counts(facts: DataFrame, keys: Sequence[str], tiers: Sequence[str] = TIERS, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Counts of each tier, their total and weighted points."""
    counts = [F.count_if(F.col("tier") == t).alias(f"n{k + 1}") for k, t in enumerate(tiers)]
    out = facts.groupBy(*keys).agg(*counts)
    names = [f"n{k + 1}" for k in range(len(tiers))]
    return out.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0]))).withColumn(
        "points", sum((F.col(n) * w for n, w in zip(names[1:], weights[1:], strict=True)), F.col(names[0]) * weights[0])
    )


def entity_summary(facts: DataFrame) -> DataFrame:
    """Counts, three competition ranks and the share of the first tier."""
    t = tier_counts(facts, ["entity"])
    rank = lambda *c: F.rank().over(Window.orderBy(*[F.desc(x) for x in c]))
    return t.select(
        "*", divided(F.col("n1"), F.col("total")).alias("first_share"), rank("n1", "n2", "n3").alias("podium_rank"), rank("total").alias("total_rank"), rank("points").alias("points_rank")
    )


def entity_unit(facts: DataFrame) -> DataFrame:
    """Shares of the entity and of the unit."""
    t = tier_counts(facts, ["entity", "unit"])
    e, u = Window.partitionBy("entity"), Window.partitionBy("unit")
    return t.select(
        "*", divided(F.col("total"), F.sum("total").over(e)).alias("entity_share"), divided(F.col("total"), F.sum("total").over(u)).alias("market_share"),
        divided(F.col("n1"), F.sum("n1").over(u)).alias("first_market_share"), divided(F.col("n1"), F.col("total")).alias("first_ratio"),
    )


FEW, HIDDEN_UNDER = 3, 2
CONCENTRATED, MODERATE = 0.25, 0.10
SPECIALISED, FIRST_HEAVY = 1.5, 0.5


def _per_event(facts: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    """Tier counts by unit, event and entity, and ``opens``: 1 for one row of each event, so that its sum counts events.

    There are about as many cells as facts, so the facts are dealt into pieces first and counted where they are.
    """
    cells = facts.repartition(pieces(facts), "unit", "event").groupBy("unit", "event", "entity").agg(F.count("*").alias("n"), *[F.count_if(F.col("tier") == t).alias(f"n{k + 1}") for k, t in enumerate(TIERS)], *more)
    return cells.withColumn("opens", (F.row_number().over(Window.partitionBy("unit", "event").orderBy("entity")) == 1).cast("int"))


def distinct_events(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct events of each group, counted in pieces like the cells of ``_per_event``."""
    return facts.repartition(pieces(facts), *keys, "event").groupBy(*keys).agg(F.count_distinct("event").alias("events"))


def _summed(df: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    names = [f"n{k + 1}" for k in range(len(TIERS))]
    out = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*names, "opens", *also)])
    out = out.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return out.withColumn("points", sum((F.col(n) * w for n, w in zip(names, WEIGHTS, strict=True)), F.lit(0)))


def unit_summary(facts: DataFrame, categories: Sequence[str] = (), focus: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Tiers, entities, leader, concentration and events of each unit, results by category and the share of ``focus``, from one pass.

    ``done``: as ``completion`` gives it; its columns are joined on.
    """
    by_category = [F.count_if(F.col("category") == c).alias(f"c{k + 1}") for k, c in enumerate(categories)]
    cells = _summed(_per_event(facts, by_category), ["unit", "entity"], [f"c{k + 1}" for k in range(len(categories))])
    shared = cells.withColumn("share", divided(F.col("total"), F.sum("total").over(Window.partitionBy("unit"))))
    sums = ["n1", "n2", "n3", "total", "points", *[f"c{k + 1}" for k in range(len(categories))]]
    out = shared.groupBy("unit").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("*").alias("entities"), F.min_by("entity", F.struct(-F.col("total"), F.col("entity"))).alias("leader"),
        F.max("share").alias("leader_share"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum("opens").alias("events"),
    )
    if focus is not None:
        out = out.withColumn("focus_share", divided(F.col(f"c{list(categories).index(focus) + 1}"), F.col("total")))
    return out if done is None else out.join(done.withColumnRenamed("events", "events_total"), "unit", "left")


def concentration(facts: DataFrame) -> DataFrame:
    """How an entity's total spreads over units: HHI, effective units, top shares, entropy, coverage, label, small samples."""
    cells = tier_counts(facts, ["entity", "unit"])
    e = Window.partitionBy("entity")
    ranked = cells.withColumn("share", F.col("total") / F.sum("total").over(e)).withColumn("place", F.row_number().over(e.orderBy(F.desc("total"), "unit")))
    out = ranked.groupBy("entity").agg(
        F.sum("total").alias("total"), F.count("*").alias("units"), F.count_if(F.col("n1") >= 1).alias("units_with_first"),
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top1"), F.sum(F.when(F.col("place") <= 3, F.col("share"))).alias("top3"),
        F.sum(-F.col("share") * F.ln("share")).alias("entropy"), F.collect_set("unit").alias("own"),
    )
    every = out.select(F.explode("own").alias("unit")).distinct().agg(F.count("*").alias("all_units"))
    out = out.drop("own").crossJoin(every)  # one row
    label = F.when(F.col("hhi") > CONCENTRATED, "concentrated").when(F.col("hhi") >= MODERATE, "moderate").when(F.col("hhi").isNotNull(), "diversified").otherwise("")
    out = out.withColumn("effective", divided(F.lit(1.0), F.col("hhi"))).withColumn("coverage", F.col("units") / F.col("all_units")).withColumn("label", label)
    return out.withColumn("small_sample", F.col("total") < FEW).drop("all_units")


def specialisation(facts: DataFrame, least: int = HIDDEN_UNDER) -> DataFrame:
    """Revealed advantage: the unit's share of the entity over its share of all; hidden under ``least`` results."""
    t = tier_counts(facts, ["entity", "unit"])
    own = divided(F.col("total"), F.sum("total").over(Window.partitionBy("entity")))
    # units are few: their sums are summed again, so that all rows never come together
    units = t.groupBy("unit").agg(F.sum("total").alias("of_unit"))
    units = units.select(F.col("unit").alias("unit_"), divided(F.col("of_unit"), F.sum("of_unit").over(Window.partitionBy())).alias("unit_share"))
    out = t.withColumn("share_of_entity", own).join(units, F.col("unit") == F.col("unit_")).drop("unit_")
    return out.select(
        "entity", "unit", "n1", "total", "share_of_entity", "unit_share",
        F.when(F.col("total") >= least, divided(F.col("share_of_entity"), F.col("unit_share"))).alias("rca"), (F.col("total") < FEW).alias("small_sample"),
    )


def conversion(facts: DataFrame, done: DataFrame | None = None, sweep: int = 2) -> DataFrame:
    """Results and first places for each completed event of the unit, and events in which an entity has ``sweep`` results or more.

    Completed events are those that ``done`` (as ``completion`` gives it) counts, else those with results.
    """
    cells = _summed(_per_event(facts).withColumn("sweeps", (F.col("n") >= sweep).cast("int")), ["entity", "unit"], ["sweeps"])
    if done is None:
        out = cells.withColumn("completed", F.sum("opens").over(Window.partitionBy("unit")))
    else:
        out = cells.join(done.select("unit", "completed", F.col("events").alias("events_total"), F.col("share").alias("completed_share"), "partial"), "unit", "left")
    out = out.withColumn("event_conversion", divided(F.col("total"), F.col("completed"))).withColumn("first_conversion", divided(F.col("n1"), F.col("completed")))
    return out.drop("n2", "n3", "points", "opens")


def category_summary(facts: DataFrame, categories: Sequence[str], first: str, second: str) -> DataFrame:
    """Results and points of each category side by side; the share of ``first`` in all and in the two; its share of the two's points.

    The last is the gap, shown only where the two together have ``FEW`` results or more; one half is parity.
    """
    weight = F.coalesce(*[F.when(F.col("tier") == t, w) for t, w in zip(TIERS, WEIGHTS, strict=True)], F.lit(0))
    parts = []
    for k, c in enumerate(categories):
        here = F.col("category") == c
        parts += [F.count_if(here).alias(f"c{k + 1}"), F.coalesce(F.sum(F.when(here, weight)), F.lit(0)).alias(f"p{k + 1}")]
    out = facts.groupBy("entity").agg(*parts)
    a, b = (list(categories).index(c) + 1 for c in (first, second))
    out = out.withColumn("total", sum((F.col(f"c{k + 1}") for k in range(len(categories))), F.lit(0)))
    both = F.col(f"c{a}") + F.col(f"c{b}")
    gap = F.when(both >= FEW, divided(F.col(f"p{a}"), F.col(f"p{a}") + F.col(f"p{b}")))
    return out.withColumn("share", divided(F.col(f"c{a}"), F.col("total"))).withColumn("share_of_two", divided(F.col(f"c{a}"), both)).withColumn("gap", gap)


def strength_tiers(facts: DataFrame) -> DataFrame:
    """Pareto tiers of each entity's units with tags, and a row for each unit in which others have results and it has none.

    Core while the points before are under 60 % of the entity's, Secondary under 90 %, then Tail. The grid of entities and units
    is the result itself.
    """
    cells = _summed(_per_event(facts), ["entity", "unit"])
    units = cells.groupBy("unit").agg(F.sum("opens").alias("unit_events"))
    rca = specialisation(facts).select("entity", "unit", "rca")
    e = Window.partitionBy("entity")
    before = F.coalesce(F.sum("points").over(e.orderBy(F.desc("points"), "unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cells.withColumn("before", before).withColumn("all", F.sum("points").over(e)).join(rca, ["entity", "unit"], "left")
    enough = F.col("total") >= FEW
    tier = F.when((F.col("all") > 0) & (F.col("before") * 100 < 60 * F.col("all")), "Core").when((F.col("all") > 0) & (F.col("before") * 100 < 90 * F.col("all")), "Secondary").otherwise("Tail")
    held = held.select(
        "entity", "unit", "n1", "n2", "n3", "total", "points", divided(F.col("points"), F.col("all")).alias("points_share"), divided(F.col("before") + F.col("points"), F.col("all")).alias("cumulative_share"),
        tier.alias("tier_name"), F.coalesce(enough & (F.col("rca") >= SPECIALISED), F.lit(False)).alias("specialised"), (enough & (F.col("n1") / F.col("total") >= FIRST_HEAVY)).alias("first_heavy"),
    )
    grid = held.select("entity").distinct().crossJoin(units)
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n1", "n2", "n3", "total", "points", "points_share")} | {c: F.coalesce(c, F.lit(False)) for c in ("specialised", "first_heavy")}
    return grid.join(held, ["entity", "unit"], "left").withColumns(none).withColumn("tier_name", F.coalesce("tier_name", F.lit("No results")))


def completion(events: DataFrame, unit: str, status: str, done: Sequence[str]) -> DataFrame:
    out = events.groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("events"), F.count_if(F.col(status).isin(*done)).alias("completed"))
    return out.withColumn("share", divided(F.col("completed"), F.col("events"))).withColumn("partial", F.col("completed") < F.col("events"))


def overall_concentration(facts: DataFrame) -> DataFrame:
    """One row: entities, results, HHI of results and of first places (0 to 10000), shares of the first 1, 3, 5 and 10 in percent; one place."""
    t = tier_counts(facts, ["entity"])
    sums = t.agg(F.count("*").alias("entities"), F.sum("total").alias("t"), F.sum("n1").alias("f"), F.sum(F.col("total") * F.col("total")).alias("tt"), F.sum(F.col("n1") * F.col("n1")).alias("ff"))
    first = t.orderBy(F.desc("total"), "entity").limit(10).select("total", F.row_number().over(Window.orderBy(F.desc("total"), "entity")).alias("place"))
    tops = first.agg(*[F.sum(F.when(F.col("place") <= k, F.col("total"))).alias(f"top{k}") for k in (1, 3, 5, 10)])
    hhi = [F.round(10000 * divided(F.col(a), F.col(b) * F.col(b)), 1).alias(name) for a, b, name in (("tt", "t", "hhi"), ("ff", "f", "hhi_first"))]
    return sums.crossJoin(tops).select("entities", F.col("t").alias("total"), *hhi, *[F.round(100 * divided(F.col(f"top{k}"), F.col("t")), 1).alias(f"top{k}") for k in (1, 3, 5, 10)])  # one row each


def standings(facts: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Each entity's tiers and categories, its percent of all results and first places (two places), of its own results by category
    and of first places among them (one place), points, and its position: by tiers, not shared."""
    t = tier_counts(facts, ["entity"])
    c = facts.groupBy(F.col("entity").alias("of")).agg(*[F.count_if(F.col("category") == x).alias(f"c{k + 1}") for k, x in enumerate(categories)])
    sums = t.agg(F.sum("n1").alias("all_n1"), F.sum("total").alias("all_total"))
    out = t.join(c, F.col("entity") == F.col("of")).crossJoin(sums)  # one row
    percent = lambda a, b, places, name: F.round(divided(100 * F.col(a), F.col(b)), places).alias(name)
    own = [f"c{k + 1}" for k in range(len(categories))]
    place = F.row_number().over(Window.orderBy(F.desc("n1"), F.desc("n2"), F.desc("n3"), "entity"))
    return out.select(
        place.alias("position"), "entity", "n1", "n2", "n3", "total", *own, percent("total", "all_total", 2, "share"), percent("n1", "all_n1", 2, "first_share"),
        *[percent(x, "total", 1, f"{x}_share") for x in own], percent("n1", "total", 1, "first_rate"), "points",
    )


def violations(facts: DataFrame, categories: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """``rule, broken``: how many rows of the metric tables break each invariant; all zero if all is well.

    Totals of every table are the facts; tiers and points add up; shares of an entity sum to one; categories sum to all;
    HHI is between one over the units and one.
    """
    ours = facts.filter(F.col("tier").isin(*TIERS))
    everything = ours.agg(F.count("*").alias("facts"))
    entity, cells, cats = tier_counts(ours, ["entity"]), entity_unit(ours), tier_counts(ours, ["entity", "unit", "category"])
    apart = lambda a, b: F.abs(a - b) > tolerance
    count = lambda df, rule, test: df.agg(F.lit(rule).alias("rule"), F.count_if(F.coalesce(test, F.lit(True))).alias("broken"))
    found = [count(t.agg(F.sum("total").alias("total")).crossJoin(everything), f"{name} totals", F.col("total") != F.col("facts")) for name, t in (("entity", entity), ("cell", cells), ("category", cats))]  # one row each
    for name, t in (("entity", entity), ("cell", cells)):
        found.append(count(t, f"{name} tiers", F.col("n1") + F.col("n2") + F.col("n3") != F.col("total")))
        found.append(count(t, f"{name} points", sum((F.col(f"n{k + 1}") * w for k, w in enumerate(WEIGHTS)), F.lit(0)) != F.col("points")))
    found.append(count(cells.groupBy("entity").agg(F.sum("entity_share").alias("s")), "shares", apart(F.col("s"), F.lit(1.0))))
    listed = cats.filter(F.col("category").isin(*categories)).groupBy("entity", "unit").agg(F.sum("total").alias("by_category"))
    found.append(count(cells.join(listed, ["entity", "unit"], "left"), "categories", F.col("by_category") != F.col("total")))
    hhi = concentration(ours)
    found.append(count(hhi, "hhi", (F.col("hhi") < 1 / F.col("units") - tolerance) | (F.col("hhi") > 1 + tolerance)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def checked(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``name, found, expected, passed``: aggregates of a table against what is expected, from one pass."""
    parts = [F.struct(F.lit(k).alias("name"), a.cast("double").alias("found"), b.cast("double").alias("expected")) for k, (a, b) in checks.items()]
    rows = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    return rows.withColumn("passed", F.coalesce(F.abs(F.col("found") - F.col("expected")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("expected")), F.lit(False)))


def over_ceiling(df: DataFrame, by: str, counted: str, ceiling: int) -> DataFrame:
    """Distinct values of each group, and whether they are more than there can be."""
    return df.groupBy(by).agg(F.count_distinct(counted).alias("found")).withColumn("is_over", F.col("found") > ceiling)


def missing_figures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: rows, missing cells and their share; one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing")) for c in columns]
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all")).withColumn("share", F.try_divide("missing", "rows"))
