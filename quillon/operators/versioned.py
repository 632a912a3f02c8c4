"""Versioned state from ordered claims: validity intervals, raw versions, conflicts, snapshots, change feeds, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.pieces import pieces


def validity(claims: DataFrame, slot: Sequence[str], order: Sequence[str], value: str, at: str, detail: str | None = None, day: str | None = None) -> DataFrame:
    """Versions of each slot: ``valid_from, valid_to, is_current, action`` (created, reallocated or corrected) with value, detail and day.

    A claim that repeats value and detail makes no version, unless it states another day than the one in force. A day that comes
    after a version without one is filled in there. A new value reallocates; a new detail or day corrects.
    """
    w = Window.partitionBy(*slot).orderBy(*order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w))
    if detail is not None:
        same = same & F.col(detail).eqNullSafe(F.lag(detail).over(w))
    rows = claims.withColumn("n_", F.row_number().over(w)).withColumn("value_moved_", ~F.col(value).eqNullSafe(F.lag(value).over(w)))
    rows = rows.withColumn("opens_", (F.col("n_") == 1) | ~same).withColumn("stay_", F.sum(F.col("opens_").cast("int")).over(w))
    if day is not None:
        s = Window.partitionBy(*slot, "stay_").orderBy(*order)
        known = F.last(day, ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1))
        later = F.first(day, ignorenulls=True).over(s.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        rows = rows.withColumn("redated_", F.coalesce(F.col(day) != known, F.lit(False))).withColumn(day, F.when(F.col("opens_"), later).otherwise(F.col(day)))
    else:
        rows = rows.withColumn("redated_", F.lit(False))
    until = F.lead(at).over(w)
    return rows.filter("opens_ or redated_").select(
        *slot, value, *[c for c in (detail, day) if c], F.col(at).alias("valid_from"), until.alias("valid_to"), until.isNull().alias("is_current"),
        F.when(F.col("n_") == 1, "created").when(F.col("opens_") & F.col("value_moved_"), "reallocated").otherwise("corrected").alias("action"),
    )


def raw_versions(fetches: DataFrame, doc: str, order: Sequence[str], digest: str) -> DataFrame:
    """Each fetch as new_version, unchanged (as the one before) or reverted (as an earlier one), with its version number."""
    w = Window.partitionBy(doc).orderBy(*order)
    numbered = fetches.withColumn("n_", F.row_number().over(w)).withColumn("before_", F.lag(digest).over(w))
    first = numbered.withColumn("first_", F.min("n_").over(Window.partitionBy(doc, digest)))
    outcome = F.when(F.col(digest) == F.col("before_"), "unchanged").when(F.col("n_") == F.col("first_"), "new_version").otherwise("reverted")
    new = F.sum(F.when(F.col("n_") == F.col("first_"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("outcome", outcome).withColumn("versions", new).drop("n_", "before_", "first_")


def decide(official: Column, disagrees: Column, accepted: Column, open_: Column, others: Column, official_disagrees: Column, official_fresh: Column) -> Column:
    """Struct ``applies, rule, status, refetch``: what becomes of a claim that meets the latest claims of other sources.

    official: the claim is the official source's; disagrees: another source says otherwise; accepted: the slot has a value;
    open_: a conflict is open there; others: other sources have claims; official_disagrees, official_fresh: the official source
    says otherwise, and was seen after all others and lately.
    """
    def answer(applies: bool, rule: str | None = None, status: str | None = None, refetch: bool = False) -> Column:
        return F.struct(F.lit(applies).alias("applies"), F.lit(rule).cast("string").alias("rule"), F.lit(status).cast("string").alias("status"), F.lit(refetch).alias("refetch"))

    return (
        F.when(~disagrees & open_ & others, answer(True, "AGREEMENT", "resolved")).when(~disagrees | ~accepted, answer(True))
        .when(official & open_, answer(True, "OFFICIAL_STILL_DISAGREES", "needs_review")).when(official, answer(True, "OFFICIAL_FRESH", "auto_resolved"))
        .when(official_disagrees & official_fresh, answer(False, "OFFICIAL_FRESH", "auto_resolved")).when(official_disagrees, answer(False, "OFFICIAL_STALE", "needs_review", True))
        .otherwise(answer(False, "NON_OFFICIAL", "needs_review"))
    )


def settled(log: DataFrame, slot: Sequence[str], source: str, at: str, value: str, official: str, fresh_days: int) -> DataFrame:
    """The log of observations with ``decide``'s answer for each, in order of time within its slot (ties by source)."""
    import pandas as pd

    fields = log.schema.simpleString()[7:-1]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([at, source], kind="stable")
        latest: dict = {}
        accepted, is_open, out = False, False, []
        for s, when, v in zip(part[source], part[at], part[value], strict=True):
            others = {k: c for k, c in latest.items() if k != s}
            against = [k for k, c in others.items() if c[1] != v]
            fresh = official in against and others[official][0] > when and when - others[official][0] <= pd.Timedelta(days=fresh_days)
            if not against:
                answer = (True, "AGREEMENT", "resolved", False) if is_open and others else (True, None, None, False)
            elif not accepted:
                answer = (True, None, None, False)
            elif s == official:
                answer = (True, "OFFICIAL_STILL_DISAGREES", "needs_review", False) if is_open else (True, "OFFICIAL_FRESH", "auto_resolved", False)
            elif official in against:
                answer = (False, "OFFICIAL_FRESH", "auto_resolved", False) if fresh else (False, "OFFICIAL_STALE", "needs_review", True)
            else:
                answer = (False, "NON_OFFICIAL", "needs_review", False)
            latest[s] = (when, v)
            accepted = accepted or answer[0]
            is_open = answer[2] == "needs_review" if answer[2] else is_open
            out.append(answer)
        return part.assign(**dict(zip(("applies", "rule", "status", "refetch"), map(list, zip(*out, strict=True)), strict=True)))

    return log.groupBy(*slot).applyInPandas(run, f"{fields},applies:boolean,rule:string,status:string,refetch:boolean")


def fingerprint(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A digest of each group's set of rows. Row digests are summed as numbers first, so no group is gathered."""
    row = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return df.groupBy(*by).agg(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts], F.count("*").cast("string")), 256).alias("fingerprint"))


def changed_snapshots(prints: DataFrame, order: str) -> DataFrame:
    """Snapshots whose fingerprint differs from the one before."""
    return prints.withColumn("before_", F.lag("fingerprint").over(Window.orderBy(order))).filter(~F.col("fingerprint").eqNullSafe(F.col("before_"))).drop("before_")


def taken_snapshots(prints: DataFrame, scope: Sequence[str], at: str, zone: str = "UTC") -> DataFrame:
    """Which snapshots are kept, with ``kind``: change where the fingerprint of the scope moved, daily for the first of a local day (both may hold)."""
    w = Window.partitionBy(*scope).orderBy(at)
    day = F.to_date(F.from_utc_timestamp(F.col(at).cast("timestamp"), zone))
    rows = prints.withColumn("day", day).withColumn("moved_", ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))).withColumn("first_", F.row_number().over(Window.partitionBy(*scope, "day").orderBy(at)) == 1)
    kinds = F.array_compact(F.array(F.when(F.col("moved_"), "change"), F.when(F.col("first_"), "daily")))
    return rows.withColumn("kind", F.explode(kinds)).drop("moved_", "first_")


def change_feed(before: DataFrame, after: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Gains, losses, and keys that came or went: one row for each changed count."""
    a = before.select(key, *[F.col(c).alias(f"{c}_a") for c in counts], F.lit(True).alias("in_a"))
    b = after.select(key, *[F.col(c).alias(f"{c}_b") for c in counts], F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    parts = [F.struct(F.lit(c).alias("measure"), F.coalesce(f"{c}_a", F.lit(0)).cast("long").alias("was"), F.coalesce(f"{c}_b", F.lit(0)).cast("long").alias("now")) for c in counts]
    kind = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "gone")
    rows = both.select(key, kind.alias("kind_"), F.inline(F.array(*parts))).filter("was <> now")
    return rows.select(key, "measure", "was", "now", F.coalesce("kind_", F.when(F.col("now") > F.col("was"), "gained").otherwise("lost")).alias("kind"))


def quarantine(open_rows: DataFrame, failing: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New rows to put in quarantine, and rows of it that no longer fail."""
    return failing.join(open_rows, list(keys), "left_anti"), open_rows.join(failing, list(keys), "left_anti")


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes over state, by key."""
    rest = [c for c in state.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"{c}_new") for c in rest], F.lit(True).alias("hit_"))
    joined = state.join(new, list(keys), "full_outer")
    return joined.select(*keys, *[F.when(F.col("hit_"), F.col(f"{c}_new")).otherwise(F.col(c)).alias(c) for c in rest])


def upsert_named(state: DataFrame, changes: DataFrame, key: str, name: str) -> DataFrame:
    """Changes over state; a name that would stand for two keys is refused, and nothing is written."""
    after = upsert(state, changes, [key])
    twice = after.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} would stand for {twice[0][1]} keys")
    return after


def source_state(kind: Column, retrieved: Column, until: Column, pruned: Column, now: Column, most_days: int = 30) -> Column:
    """pruned, upload, expired, stale or current, in this order: bytes that are gone come before a day that has passed, that before age."""
    return (
        F.when(pruned.isNotNull(), "pruned").when(kind == "upload", "upload").when(until <= now, "expired")
        .when(now - F.make_dt_interval(F.lit(most_days)) > retrieved, "stale").otherwise("current")
    )


def freshness(success: Column, last_status: Column, now: Column, most_minutes: int) -> Column:
    """never_succeeded, failing (the last finished attempt), stale or fresh."""
    old = now - F.make_dt_interval(mins=F.lit(most_minutes)) > success
    return F.when(success.isNull(), "never_succeeded").when(last_status == "failed", "failing").when(old, "stale").otherwise("fresh")


def retained(df: DataFrame, until: str, now) -> tuple[DataFrame, DataFrame]:
    """Rows still kept, and tombstones of the rest."""
    over = F.coalesce(F.col(until) < F.lit(now), F.lit(False))
    return df.filter(~over), df.filter(over)


def pruned(df: DataFrame, until: str, content: str, now) -> tuple[DataFrame, DataFrame]:
    """Rows still kept, and tombstones of the rest: their rows without the content."""
    kept, over = retained(df, until, now)
    return kept, over.withColumn(content, F.lit(None).cast(dict(df.dtypes)[content]))


def alerts(now: DataFrame, sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What to notify: alerts not sent yet, and sent ones that ended."""
    new = now.select(*keys).join(sent, list(keys), "left_anti").withColumn("notice", F.lit("new"))
    return new.unionByName(sent.select(*keys).join(now, list(keys), "left_anti").withColumn("notice", F.lit("resolved")))


def resolve(conflicts: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The status of each conflict after the decisions, and whether it still disputes its slot: only open ones change, and a note and a name are needed."""
    good = decisions.filter(F.col("note").isNotNull() & (F.btrim("note") != "") & F.col("resolved_by").isNotNull())
    last = good.groupBy(key).agg(F.max_by("status", "at").alias("decided"))
    return conflicts.join(last, key, "left").withColumn("status", F.when(F.col("status") == "open", F.coalesce("decided", F.lit("open"))).otherwise(F.col("status"))).withColumn("is_disputed", F.col("status") == "open").drop("decided")


def rehashed(df: DataFrame, content: str, recorded: str) -> DataFrame:
    """Stored contents against the digest recorded for them: ``status`` ok, changed or missing."""
    status = F.when(F.col(content).isNull(), "missing").when(F.sha2(F.col(content).cast("binary"), 256) == F.col(recorded), "ok").otherwise("changed")
    return df.withColumn("status", status)


def scanned(df: DataFrame, content: str, recorded: str, until: str, now) -> DataFrame:
    """Stored contents on the day ``now``: ``status`` expired where they are past their day, else as ``rehashed`` finds them."""
    found = rehashed(df, content, recorded)
    return found.withColumn("status", F.when(F.col(until) < F.to_date(F.lit(str(now))), "expired").otherwise(F.col("status")))


def rank_changes(before: DataFrame, after: DataFrame, key: str, *measures: str) -> DataFrame:
    """Keys of both whose competition rank by the measures moved: ``was, now``. One row a key: the tables are summaries."""
    place = F.rank().over(Window.orderBy(*[F.desc(m) for m in measures]))
    both = before.select(key, place.alias("was")).join(after.select(key, place.alias("now")), key)
    return both.filter("was <> now")


def snapshot_changes(before: DataFrame, after: DataFrame, entity: str, unit: str, more: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """``change, entity, unit, <more>, detail``: gains and losses by key, an entity's first results in a unit, and moves in rank."""
    keys = [entity, unit, *more]
    a = before.select(*keys, *[F.col(c).alias(f"{c}_a") for c in counts])
    b = after.select(*keys, *[F.col(c).alias(f"{c}_b") for c in counts])
    delta = {c: F.coalesce(f"{c}_b", F.lit(0)) - F.coalesce(f"{c}_a", F.lit(0)) for c in counts}
    both = a.join(b, keys, "full_outer").select(*keys, *[d.alias(c) for c, d in delta.items()])
    feed = None
    for sign, change in ((1, "gained"), (-1, "lost")):
        parts = [F.when(F.col(c) * sign > 0, F.format_string(f"{c} %+d", F.col(c).cast("long"))) for c in counts]
        rows = both.select(F.lit(change).alias("change"), *keys, F.array_join(F.array_compact(F.array(*parts)), ", ").alias("detail")).filter("detail <> ''")
        feed = rows if feed is None else feed.unionByName(rows)
    none = [F.lit(None).cast(dict(after.dtypes)[c]).alias(c) for c in more]
    had = before.filter(sum((F.col(c) for c in counts), F.lit(0)) > 0).select(entity, unit).distinct()
    new = after.filter(sum((F.col(c) for c in counts), F.lit(0)) > 0).select(entity, unit).distinct().join(had, [entity, unit], "left_anti")
    feed = feed.unionByName(new.select(F.lit("new_unit").alias("change"), entity, unit, *none, F.lit("first results in this unit").alias("detail")))
    total = lambda d: d.groupBy(entity).agg(*[F.sum(c).alias(c) for c in counts])
    moved = rank_changes(total(before), total(after), entity, *counts)
    detail = F.format_string("rank %d -> %d", "was", "now")
    return feed.unionByName(moved.select(F.lit("rank_change").alias("change"), entity, F.lit(None).cast(dict(after.dtypes)[unit]).alias(unit), *none, detail.alias("detail")))


def verified(document: Column, pointer: Column, claimed: Column) -> Column:
    """A claim about the value at a JSON pointer of one name: verified, differs or not_found. Numbers compare as numbers, texts exactly."""
    found = F.call_function("get_json_object", document, F.concat(F.lit("$['"), F.substring(pointer, F.lit(2), F.length(pointer)), F.lit("']")))
    equal = F.coalesce(found.try_cast("decimal(38,10)") == claimed.try_cast("decimal(38,10)"), found == claimed)
    return F.when(found.isNull(), "not_found").when(equal, "verified").otherwise("differs")


def close_stuck(runs: DataFrame, is_open: Column, started: str, now: str, most_days: int) -> DataFrame:
    """Runs still open after so many days are failed, with a reason; all rows stay."""
    stuck = is_open & (F.datediff(now, started) > most_days)
    return runs.withColumn("outcome", F.when(stuck, "failed").when(is_open, "running").otherwise("done")).withColumn("reason", F.when(stuck, "STUCK"))


def outcome(status: Column, changed: Column, quarantined: Column) -> Column:
    """What a run came to, from what it recorded: running, failed, succeeded_with_quarantine, unchanged or succeeded."""
    return (
        F.when(status == "running", "running").when(~status.eqNullSafe(F.lit("success")), "failed")
        .when(F.coalesce(quarantined, F.lit(0)) > 0, "succeeded_with_quarantine").when(changed == 0, "unchanged").otherwise("succeeded")
    )


def run_summary(runs: DataFrame, quarantine_: DataFrame, run: str, reason: str, resolved: Column) -> DataFrame:
    """Each run with its ``outcome``, its unresolved quarantined rows, and these by reason as ``reasons`` (a map)."""
    open_ = quarantine_.filter(~resolved).groupBy(run, reason).agg(F.count("*").alias("n"))
    by_run = open_.groupBy(F.col(run).alias("run_")).agg(F.sum("n").alias("open_rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("reasons"))
    out = runs.join(by_run, F.col(run) == F.col("run_"), "left").drop("run_").withColumn("open_rows", F.coalesce("open_rows", F.lit(0)))
    return out.withColumn("outcome", outcome(F.col("status"), F.col("changed"), F.col("open_rows")))


def reuse(share: Column, age_days: Column, complete: Column, most_days: int = 365, least: float = 0.5) -> Column:
    """What to do with a stored table: reuse, refresh, extend or collect anew."""
    return F.when(share < least, "collect").when(~complete, "extend").when(age_days > most_days, "refresh").otherwise("reuse")


def validated(df: DataFrame, event: str, tier: str, slot: str, entity: str, kind: str, tie: str, row: str, tiers: Sequence[str], team: str, double: Column | None = None) -> DataFrame:
    """Each row with its final ``slot`` and the first ``reason`` against it, by these rules in order:

    DUPLICATE (all of event, tier, slot and entity as in an earlier row); KIND_CONFLICT (not the kind of the event's first row);
    SLOT_CONFLICT (a stated slot that an earlier row has; rows without one take the free slots in order); TOO_MANY (beyond slot 1,
    unless it is slot 2 and both are ties, or ``double`` allows two in the last tier); TEAM_TWICE (an entity's second row in an
    event of kind ``team``, by tier and slot). The rows of an event are in one of the ``pieces`` from the first rule to the last.
    """
    from quillon.operators.windows import fill_slots

    first = Window.partitionBy(event, tier, slot, entity).orderBy(row)
    out = df.repartition(pieces(df, 3), event).withColumn("reason", F.when(F.row_number().over(first) > 1, "DUPLICATE"))
    fine = F.col("reason").isNull()
    kinds = Window.partitionBy(event, fine).orderBy(row)
    out = out.withColumn("reason", F.coalesce("reason", F.when(~F.col(kind).eqNullSafe(F.first(kind).over(kinds)), "KIND_CONFLICT")))
    slots = Window.partitionBy(event, tier, slot, fine).orderBy(row)
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col(slot).isNotNull() & (F.row_number().over(slots) > 1), "SLOT_CONFLICT")))
    out = fill_slots(out, [event, tier], slot, [F.col(row).asc()], fine)
    head = F.max(F.when(F.col(slot) == 1, F.col(tie))).over(Window.partitionBy(event, tier, fine))
    second = (F.col(slot) == 2) & (F.coalesce(F.col(tie) & head, F.lit(False)) | ((F.col(tier) == tiers[-1]) & (F.lit(False) if double is None else double)))
    out = out.withColumn("reason", F.coalesce("reason", F.when((F.col(slot) != 1) & ~second, "TOO_MANY")))
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col(tier))
    again = F.row_number().over(Window.partitionBy(event, entity, fine).orderBy(place, slot)) > 1
    return out.withColumn("reason", F.coalesce("reason", F.when((F.col(kind) == team) & again, "TEAM_TWICE")))
