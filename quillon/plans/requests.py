"""Requests as validated data: a closed set of operations, a small grammar for text, starter analyses, replay."""

from __future__ import annotations

import hashlib
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import canonical_json, number_tokens
from quillon.operators import aggregates, filters, stats, windows
from quillon.operators.cleaning import CleanPlan
from quillon.operators.versioned import reuse


@dataclass(frozen=True)
class Request:
    """One operation with its arguments."""

    op: str
    by: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    column: str = ""
    columns: tuple[str, ...] = ()
    n: int = 10
    freq: str = "month"


class NotUnderstood(ValueError):
    """The text names no operation or no such column."""


def run(df: DataFrame, request: Request) -> DataFrame:
    """The table of a request; the operations are a closed list."""
    filters.require_columns(df, [*request.by, *request.columns, *([request.column] if request.column else [])])
    if request.op == "group":
        return aggregates.group_aggregate(df, request.by, request.metrics)
    if request.op == "top":
        column, function = aggregates.parse_metric(request.metrics[0])
        grouped = df.groupBy(*request.by).agg(aggregates.metric(column, function).alias("value"))
        return windows.top_with_ties(grouped, "value", request.n)
    if request.op == "counts":
        return aggregates.value_counts(df, request.column, request.n)
    if request.op == "describe":
        return aggregates.describe(df, request.columns)
    if request.op == "trend":
        column, function = aggregates.parse_metric(request.metrics[0])
        return aggregates.time_trend(df, request.column, column, function, request.freq)
    if request.op == "correlation":
        return stats.correlation_matrix(df, request.columns)
    raise NotUnderstood(f"no operation {request.op}")


VERBS = {"sum": "sum", "total": "sum", "average": "mean", "mean": "mean", "median": "median", "count": "count", "minimum": "min", "maximum": "max"}


def parse(text: str, columns: list[str]) -> Request:
    """``sum price by region``, ``top 5 region by price``, ``count values of region``, ``sum price over day by month``."""
    words = {c.lower().replace("_", " "): c for c in columns} | {c.lower(): c for c in columns}

    def column(name: str) -> str:
        if name.strip().lower() not in words:
            raise NotUnderstood(f"no column {name.strip()}")
        return words[name.strip().lower()]

    plain = re.sub(r"\s+", " ", text.strip().lower().rstrip(".?!"))
    if m := re.fullmatch(r"top (\d+) (.+?) by (.+)", plain):
        return Request("top", by=(column(m[2]),), metrics=(f"{column(m[3])}:sum",), n=int(m[1]))
    if m := re.fullmatch(r"count values of (.+)", plain):
        return Request("counts", column=column(m[1]), n=50)
    if m := re.fullmatch(rf"({'|'.join(VERBS)}) (.+?) over (.+?) by (day|month|quarter|year)", plain):
        return Request("trend", column=column(m[3]), metrics=(f"{column(m[2])}:{VERBS[m[1]]}",), freq=m[4])
    if m := re.fullmatch(rf"({'|'.join(VERBS)}) (.+?) by (.+)", plain):
        return Request("group", by=tuple(column(c) for c in re.split(r" and |, ?", m[3])), metrics=(f"{column(m[2])}:{VERBS[m[1]]}",))
    if m := re.fullmatch(r"(?:correlation|correlate) (.+)", plain):
        return Request("correlation", columns=tuple(column(c) for c in re.split(r" and |, ?", m[1])))
    raise NotUnderstood("the request is not one of the forms")


def starters(df: DataFrame, most: int = 8) -> list[Request]:
    """Analyses to begin with, from the types of the columns."""
    kinds = dict(df.dtypes)
    numbers = [c for c, k in kinds.items() if k in ("double", "float", "int", "bigint") and not c.endswith(("key", "_id"))]
    texts = [c for c, k in kinds.items() if k == "string"]
    days = [c for c, k in kinds.items() if k.startswith(("date", "timestamp"))]
    plan = [Request("describe", columns=tuple(numbers))] if numbers else []
    plan += [Request("counts", column=c) for c in texts[:2]]
    plan += [Request("group", by=(t,), metrics=(f"{n}:sum",)) for t in texts[:2] for n in numbers[:1]]
    plan += [Request("trend", column=d, metrics=(f"{n}:sum",)) for d in days[:1] for n in numbers[:1]]
    if len(numbers) > 1:
        plan.append(Request("correlation", columns=tuple(numbers)))
    return plan[:most]


CHARTS = ("bar", "line", "pie", "scatter", "table")


@dataclass(frozen=True)
class Planned:
    """What a text asks for: ``kind`` is request, chart, clarification or refusal."""

    kind: str
    request: Request | None = None
    chart: str = ""
    question: str = ""
    choices: tuple[str, ...] = ()


def plan(text: str, df: DataFrame, current: Request | None = None) -> Planned:
    """A request, another chart of the current one, a question back where a column is not clear, or a refusal."""
    plain = re.sub(r"\s+", " ", text.strip().lower().rstrip(".?!"))
    if m := re.fullmatch(rf"(?:make (?:it|this) |show (?:it|this) |change (?:it|this) )?(?:as |to |into )?(?:an? )?({'|'.join(CHARTS)})(?: chart)?", plain):
        if current is None:
            return Planned("clarification", question="There is no result to show yet. What shall be shown?")
        return Planned("chart", current, m[1])
    if re.search(r"\b(delete|drop|update|insert|truncate|alter|grant)\b", plain):
        return Planned("refusal", question="Tables are only read.")
    try:
        return Planned("request", parse(text, df.columns))
    except NotUnderstood as why:
        wanted = str(why).removeprefix("no column ")
        near = tuple(c for c in df.columns if wanted and (wanted in c.lower().replace("_", " ") or set(wanted.split()) & set(c.lower().split("_"))))
        if str(why).startswith("no column") and near:
            return Planned("clarification", question=f"Which column is {wanted}?", choices=near)
        return Planned("refusal", question=str(why))


def parse_filter(text: str, df: DataFrame):
    """``only region is south``, ``exclude region south``, ``price between 1 and 5``, ``only 2024``, ``only south``, ``exclude north``: a function on the frame.

    A bare year is one of the only date column; a bare value belongs to the only text column that has it, in any case of letters.
    """
    plain = re.sub(r"\s+", " ", text.strip())
    days = [c for c, k in df.dtypes if k.startswith(("date", "timestamp"))]
    if m := re.fullmatch(r"(?i)only (\w+) is (.+)", plain):
        return lambda d: filters.keep_values(d, m[1], [m[2]])
    if m := re.fullmatch(r"(?i)(\w+) between (\S+) and (\S+)", plain):
        number = filters.column_kind(df, m[1]) == "number"
        low, high = (float(m[2]), float(m[3])) if number else (m[2], m[3])
        return lambda d: filters.keep_between(d, m[1], low, high)
    if m := re.fullmatch(r"(?i)(only|exclude) ((?:19|20)\d\d)", plain):
        if len(days) != 1:
            raise NotUnderstood("a year needs one date column")
        inside = F.year(days[0]) == int(m[2])
        return lambda d: d.filter(inside if m[1].lower() == "only" else ~F.coalesce(inside, F.lit(False)))
    if (m := re.fullmatch(r"(?i)exclude (\w+) (.+)", plain)) and m[1] in df.columns:
        return lambda d: filters.drop_values(d, m[1], [m[2]])
    if m := re.fullmatch(r"(?i)(only|exclude) (.+)", plain):
        texts = [c for c, k in df.dtypes if k == "string"]
        hit = [F.max(F.when(F.lower(c) == m[2].lower(), F.col(c))).alias(f"v{i}") for i, c in enumerate(texts)]
        found = df.agg(*hit).first() if hit else []
        named = [(c, found[i]) for i, c in enumerate(texts) if found[i] is not None]
        if len(named) != 1:
            raise NotUnderstood(f"{m[2]} is a value of {len(named)} columns")
        return lambda d: (filters.keep_values if m[1].lower() == "only" else filters.drop_values)(d, named[0][0], [named[0][1]])
    raise NotUnderstood("the filter is not one of the forms")


def digest(df: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows, made without gathering them."""
    from quillon.operators.versioned import fingerprint

    found = fingerprint(df.withColumn("all_", F.lit(1)), ["all_"], df.columns).first()
    return hashlib.sha256((found["fingerprint"] if found else "empty").encode()).hexdigest()


def replay(df: DataFrame, history: list[tuple[Request, str]]) -> bool:
    """Whether the same requests give the same tables again."""
    return all(digest(run(df, request)) == expected for request, expected in history)


def key(request: Request) -> str:
    return hashlib.sha256(canonical_json(asdict(request)).encode()).hexdigest()


def findings(described: DataFrame) -> list[str]:
    """Sentences from a describe table."""
    out = []
    for r in described.collect():  # a row for each column
        if r["count"] and r["nulls"]:
            out.append(f"{r['column']} has no value in {r['nulls']} of {r['nulls'] + r['count']} rows")
        if r["distinct"] == 1:
            out.append(f"{r['column']} is constant")
    return out


def parse_model(text: str, columns: list[str]) -> dict[str, str]:
    """``Predict X``, ``Predict X over time using D`` or ``Find groups``."""
    known = {c.lower(): c for c in columns}
    plain = re.sub(r"\s+", " ", text.strip().rstrip(".?!"))
    if plain.lower() == "find groups":
        return {"task": "cluster"}
    m = re.fullmatch(r"(?i)predict (.+?)(?: over time using (.+))?", plain)
    if not m:
        raise NotUnderstood("the request is not one of the forms")
    named = [x.lower() for x in (m[1], m[2]) if x]
    if absent := [x for x in named if x not in known]:
        raise NotUnderstood(f"no column {', '.join(absent)}")
    return {"task": "predict", "target": known[named[0]], "split": "time" if m[2] else "hash", "day": known[named[1]] if m[2] else ""}


def parse_cleaning(text: str, columns: list[str], row_id: str) -> CleanPlan:
    """``trim a, b; number c; number d , .; date e yyyy-MM-dd; duplicates a, b``: the shorthand of a cleaning plan."""

    def listed(part: str) -> tuple[str, ...]:
        names = tuple(x.strip() for x in part.split(","))
        if absent := [x for x in names if x not in columns]:
            raise NotUnderstood(f"no column {', '.join(absent)}")
        return names

    trim, numbers, dates, duplicates = (), {}, {}, ()
    for step in filter(None, map(str.strip, text.split(";"))):
        verb, _, rest = step.partition(" ")
        if verb == "trim":
            trim += listed(rest)
        elif verb == "duplicates":
            duplicates = listed(rest)
        elif verb == "number":
            name, *marks = rest.split()
            thousands, decimal = marks if len(marks) == 2 else ("", ".")
            numbers[listed(name)[0]] = thousands, decimal
        elif verb == "date":
            name, _, form = rest.partition(" ")
            dates[listed(name)[0]] = form or "yyyy-MM-dd"
        else:
            raise NotUnderstood(f"no step {verb}")
    return CleanPlan(trim=trim, numbers=numbers, dates=dates, duplicates=duplicates, row_id=row_id)


def cards(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Cards to show first: rows, then sum and mean of each number, in one pass."""
    parts = [F.struct(F.lit("rows").alias("card"), F.count("*").cast("double").alias("value"))]
    for c in numbers:
        parts += [F.struct(F.lit(f"{c} total").alias("card"), F.sum(c).cast("double").alias("value")), F.struct(F.lit(f"{c} average").alias("card"), F.avg(c).alias("value"))]
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def cleaning_agrees(before: DataFrame, kept: DataFrame, rejects: DataFrame, duplicates: DataFrame, row_id: str) -> DataFrame:
    """An independent check of a cleaning: every row is in one of the three outcomes, once, and none came from elsewhere."""
    parts = [d.select(F.col(row_id).alias("id_"), F.lit(k).alias("outcome_")) for k, d in enumerate((kept, rejects, duplicates))]
    placed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id_").agg(F.count("*").alias("times_"))
    both = before.select(F.col(row_id).alias("id_"), F.lit(1).alias("was_")).join(placed, "id_", "full_outer")
    return both.agg(F.count("*").alias("rows"), F.count_if(~((F.col("was_") == 1) & (F.col("times_") == 1)).eqNullSafe(True)).alias("astray"))


def number_lock(sentence: Column, figures: Column) -> Column:
    """The numbers of a sentence that are none of its figures (array of text); an empty array passes."""
    return F.array_except(number_tokens(sentence), figures)


def figures_from_claims(claims: DataFrame, slot: list[str], value: str, project: str) -> DataFrame:
    """A figure for each slot on which all its claims agree, within one project; else none, and the gap is named."""
    found = claims.groupBy(*slot).agg(F.min(value).alias("low_"), F.max(value).alias("high_"), F.min(project).alias("first_"), F.max(project).alias("last_"), F.count("*").alias("claims"))
    gap = F.when(F.col("low_").isNull(), "missing").when(F.col("first_") != F.col("last_"), "projects").when(F.col("low_") != F.col("high_"), "conflict")
    return found.select(*slot, F.when(gap.isNull(), F.col("low_")).alias("figure"), gap.alias("gap"), "claims")


def research(topics: DataFrame, topic: str, share: Column, age_days: Column, complete: Column, most_days: int = 365) -> DataFrame:
    """The work list of a question: what is reused, refreshed, extended or collected for each topic."""
    return topics.withColumn("decision", reuse(share, age_days, complete, most_days)).groupBy(topic, "decision").agg(F.count("*").alias("n"))
