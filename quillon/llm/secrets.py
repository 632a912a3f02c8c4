"""Secret scans with corpus-wide ownership frequency, in DataFrame and SQL functions only.

Each text is searched for assignments, access keys and long hex runs (the base), and for further candidates: long tokens of
mixed letters and digits outside these. Every candidate is hashed, and its hash is counted by distinct repositories and
owners over the whole corpus. A hash with few owners and few repositories is a live-looking credential of theirs; one with
more than ``max_owners`` or ``max_repos`` (a repository counts once for each owner) is a widely copied example. Further candidates become spans if they look live. The base spans stay in any case.

Hot values: counting is pre-aggregated by (hash, repository, owner), then by hash; the verdict is joined back on an
expression of the hash so that both sides are shuffled and an oversized partition can be split at run time.

Which columns name an owner and a repository is the caller's to say (``owner_cols``, ``repo_cols``): without better ones, a
``source`` owns, and its texts of one ``lang`` are a repository of it. A column that the table lacks counts as null throughout.

Defined results: a null text counts as an empty one; null owners or repositories count as one more value each; a null id is
kept as it is; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, packed_row, text_or_empty
from .spans import matches, outside, quoted, replaced

#: The base patterns and the least lengths of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "token")
#: Further candidates: runs of 20 and more with letters and digits, that are no path or slug: between slashes, dashes and low lines, one part
#: of 16 and more has both.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"

LIVE = r"(?<![A-Za-z0-9+=])(?=[A-Za-z+=]*+[0-9])(?=[0-9+=]*+[A-Za-z])[A-Za-z0-9+=]{16,}"


def _kind(found: Column, order: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("hash")))


def candidates(text: str) -> tuple[Column, Column]:
    """Two arrays of structs ``start, kind, end, hash``: the base spans, and all further candidates outside them."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    base = F.array_sort(F.concat(_kind(assign, 0), _kind(matches(text, ACCESS), 1), _kind(matches(text, HEX), 2)))
    return base, _kind(F.filter(matches(text, TOKEN), lambda m: m["value"].rlike(LIVE)), 3)


def scan(docs: DataFrame, max_owners: int = 1, max_repos: int | None = 2, repo_cols: tuple[str, ...] = ("source", "lang"), owner_cols: tuple[str, ...] = ("source",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: ``doc_id, hash_, base, added`` (arrays of spans), ``n_live, n_copied`` (candidates by verdict), ``spread``
    (hash, owners and repositories of each candidate). ``max_repos`` None: owners alone decide."""
    shelf = Shelf(docs.sparkSession, "secrets")
    base, more = candidates("text")
    of = lambda c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")
    found = shelf.put(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"),
            F.to_json(F.array(*map(of, repo_cols))).alias("repo"), F.to_json(F.array(*map(of, owner_cols))).alias("owner"),
        )
        .select("doc_id", F.xxhash64("text").alias("hash_"), "repo", "owner", base.alias("base"), more.alias("more"))
        .withColumn("more", F.expr(outside("more", "base"))),
        "found",
    )
    each = found.filter("size(base) + size(more) > 0").select(
        "doc_id", "hash_", "repo", "owner", F.explode(F.array_distinct(F.expr("transform(concat(base, more), m -> m.hash)"))).alias("hash")
    )
    owned = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("docs"))
    by_repo = owned.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    verdict = by_repo.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).select(
        F.reverse("hash").alias("key"), "owners", "repos",
        ((F.col("owners") <= max_owners) & (F.lit(True) if max_repos is None else F.col("repos") <= max_repos)).alias("live"),
    )
    judged = each.withColumn("key", F.reverse("hash")).join(verdict, "key").groupBy("doc_id", "hash_").agg(
        F.collect_set(F.when(F.col("live"), F.col("hash"))).alias("live"), F.collect_set(F.when(~F.col("live"), F.col("hash"))).alias("copied"),
        F.collect_set(F.struct("hash", "owners", "repos")).alias("spread"),
    )
    judged = judged.select(F.col("doc_id").alias("id_"), F.col("hash_").alias("of_"), "live", "copied", F.array_sort("spread").alias("spread"))
    joined = found.join(judged, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("hash_") == F.col("of_")), "left")
    none = F.expr("cast(array() as array<string>)")
    joined = joined.withColumn("live", F.coalesce("live", none)).withColumn("copied", F.coalesce("copied", none))
    joined = joined.withColumn("spread", F.coalesce("spread", F.expr("cast(array() as array<struct<hash: string, owners: bigint, repos: bigint>>)")))
    return joined.select(
        "doc_id", "hash_", "base",
        F.expr("filter(more, m -> array_contains(live, m.hash))").alias("added"),
        F.expr("size(filter(concat(base, more), m -> array_contains(live, m.hash)))").cast("long").alias("n_live"),
        F.expr("size(filter(concat(base, more), m -> array_contains(copied, m.hash)))").cast("long").alias("n_copied"), "spread",
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", names[m["kind"]], m["start"].cast("string"), m["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """All rows and columns, every span of the scan replaced in the text by ``mark``; overlapping spans are one."""
    spans = scan(docs, id_col=id_col, text_col=text_col, **how)
    spans = spans.filter("size(base) + size(added) > 0").select(
        F.col("doc_id").alias("id_b"), F.col("hash_").alias("of_b"), F.array_sort(F.expr("transform(concat(base, added), m -> named_struct('start', m.start, 'end', m.end))")).alias("spans")
    ).dropDuplicates(["id_b", "of_b"])
    rows = packed_row(docs, id_a=F.col(f"`{id_col}`"), of_a=F.xxhash64(text_or_empty(text_col)))
    clean = F.expr(f"if(spans is null, row.`{text_col}`, {replaced(f'row.`{text_col}`', 'spans', quoted(mark))})")
    out = rows.join(spans, F.col("id_a").eqNullSafe(F.col("id_b")) & (F.col("of_a") == F.col("of_b")), "left")
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
