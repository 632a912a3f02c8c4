"""More registered queries: stored contents, guards, orderings, parsing, predictors, suggestions and decisions; next to each its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import aggregates as A
from quillon.operators import cleaning as C
from quillon.operators import filters as P
from quillon.operators import joins as J
from quillon.operators import stats as M
from quillon.operators import versioned as V
from quillon.operators import windows as W
from quillon.plans import requests
from quillon.plans.catalogue import BY_CELL, BY_ENTITY, FACTS, NULLED, event_facts, facts, nulled, query
from quillon.sources import readers as R

# ---- sources ----


@query("src05", 'SELECT s_suppkey, s_name AS "name", s_name AS "name__2", s_acctbal AS "column_4" FROM supplier')
def _(t):
    return t("supplier").select("s_suppkey", "s_name", "s_name", "s_acctbal").toDF(*R.headers([" s_suppkey ", "name", "name", ""], rename=True))


@query("src06", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR text IS NULL THEN length(text) END AS n, CASE doc_id % 3 WHEN 1 THEN 'NOT_UTF8' WHEN 2 THEN 'NUL' END AS reason, CAST(CASE doc_id % 3 WHEN 1 THEN strlen(text) + 3 WHEN 2 THEN length(text) END AS BIGINT) AS \"offset\" FROM documents WHERE text IS NOT NULL")
def _(t):
    kinds = F.when(F.col("doc_id") % 3 == 0, F.lit(b"")).when(F.col("doc_id") % 3 == 1, F.lit("\ufffd".encode() + b"\xff")).otherwise(F.lit(b"\x00"))
    found = S.decoded(F.concat(F.col("text").cast("binary"), kinds))
    return t("documents").filter("text is not null").select("doc_id", F.length(found["text"]).cast("long").alias("n"), found["reason"].alias("reason"), found["offset"].cast("long").alias("offset"))


@query("src14", "SELECT n_nationkey + 1 AS row_id, CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, NULL::VARCHAR AS note FROM nation")
def _(t):
    from quillon.sources import writers as O
    from quillon.sources.store import Store

    nation = t("nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    store = Store(nation.sparkSession)
    store.put("manual.csv", O.csv_bytes(nation))
    return R.read_columns(nation.sparkSession, store.path("manual.csv"), ["k", "name"], ["region", "note"])


@query("src19", "SELECT left(p_name, 6) AS alias, count(DISTINCT p_brand) AS targets FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def _(t):
    return J.alias_clashes(t("part"), F.left("p_name", F.lit(6)), "p_brand")


@query("src25", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def _(t):
    stored = t("documents").select("doc_id", "text", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), 256).alias("recorded"))
    return V.rehashed(stored, "text", "recorded").select("doc_id", "status")


@query("src26", "SELECT page_id, CASE WHEN DATE '2025-01-01' + CAST(page_id % 400 AS INTEGER) + 90 < DATE '2025-12-31' THEN 'expired' WHEN page_id % 11 = 0 THEN 'changed' ELSE 'ok' END AS status FROM pages")
def _(t):
    html = F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit("+"))).otherwise(F.col("html"))
    fetched = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    stored = t("pages").select("page_id", "html", F.sha2(html, 256).alias("recorded"), F.date_add(fetched, 90).alias("retain_until"))
    return V.scanned(stored, "html", "recorded", "retain_until", "2025-12-31").select("page_id", "status")


@query("src30", "SELECT event_id, 'k' AS name, CAST(props ->> '$.k' AS INTEGER) AS value FROM events")
def _(t):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string, int>")).alias("name", "value"))


# ---- guards and filters ----


@query("flt05", "SELECT p_partkey FROM part WHERE p_size > 40")
def _(t):
    return P.not_empty(t("part").filter("p_size > 40").select("p_partkey"))


@query("flt07", "SELECT 'between' AS form, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000 UNION ALL SELECT 'year', count(*) FROM orders WHERE year(o_orderdate) = 1995 UNION ALL SELECT 'no year', count(*) FROM orders WHERE year(o_orderdate) <> 1995 UNION ALL SELECT 'value', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'no value', count(*) FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT 'is', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'not', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    orders, out = t("orders"), None
    asked = {"between": "o_totalprice between 50000 and 90000", "year": "only 1995", "no year": "exclude 1995", "value": "only 1-urgent", "no value": "exclude 5-low", "is": "only o_orderstatus is F", "not": "exclude o_orderstatus F"}
    for form, text in asked.items():
        one = requests.parse_filter(text, orders)(orders).agg(F.lit(form).alias("form"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("flt20", "SELECT doc_id FROM documents WHERE lang = 'en'")
def _(t):
    return P.scoped(t("documents"), "lang", "en").select("doc_id")


@query("flt21", "SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
def _(t):
    P.require_numeric(t("part"), "p_size")
    return t("part").agg(F.sum("p_size").alias("total"))


@query("flt22", "SELECT p_partkey, p_brand FROM part")
def _(t):
    P.require_columns(t("part"), ["p_partkey", "p_brand"])
    return t("part").select("p_partkey", "p_brand")


@query("jn23", "SELECT n_name AS value FROM nation WHERE n_nationkey = 7")
def _(t):
    return J.single_cell(t("nation"), F.col("n_nationkey") == 7, "n_name")


@query("jsn02", "SELECT c_mktsegment AS value FROM customer WHERE c_custkey = 42")
def _(t):
    return J.single_cell(t("customer"), F.col("c_custkey") == 42, "c_mktsegment")


# ---- aggregates, ranks and orders ----


@query("agg07", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def _(t):
    column, function = A.parse_metric("size: in cm:sum")
    return t("part").withColumnRenamed("p_size", column).groupBy("p_brand").agg(A.metric(column, function).alias("total"))


@query("agg23", f"WITH {FACTS} SELECT entity, unit, count(DISTINCT event) AS events FROM facts GROUP BY 1, 2")
def _(t):
    return A.distinct_events(event_facts(t), ["entity", "unit"])


@query("agg41", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS found, count(DISTINCT o_custkey) > 100 AS is_over FROM orders GROUP BY 1")
def _(t):
    return A.over_ceiling(t("orders"), "o_orderpriority", "o_custkey", 100)


@query("agg44", f"WITH o AS {NULLED} SELECT 'priority' AS \"column\", count(*) AS rows, count(*) - count(priority) AS missing, round((count(*) - count(priority)) / count(*), 6) AS share FROM o UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate), round((count(*) - count(o_orderdate)) / count(*), 6) FROM o")
def _(t):
    return A.missing_figures(nulled(t), ["priority", "o_orderdate"]).withColumn("share", F.round("share", 6))


@query("win02", f"{BY_ENTITY} SELECT entity, rank() OVER (ORDER BY n1 DESC, n2 DESC, n3 DESC) AS podium, rank() OVER (ORDER BY total DESC) AS by_total, rank() OVER (ORDER BY points DESC) AS by_points FROM t")
def _(t):
    ranks = {"podium": ["n1", "n2", "n3"], "by_total": ["total"], "by_points": ["points"]}
    return A.tier_counts(facts(t), ["entity"]).select("entity", *[W.competition_rank(c).alias(n) for n, c in ranks.items()])


def placed(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("srt01", f"SELECT priority, n, row_number() OVER (ORDER BY priority NULLS LAST) AS place FROM (SELECT priority, count(*) AS n FROM {NULLED} GROUP BY 1)")
def _(t):
    return placed(nulled(t).groupBy("priority").agg(F.count("*").alias("n")), F.asc_nulls_last("priority"))


@query("srt03", f"{BY_ENTITY} SELECT entity, points, row_number() OVER (ORDER BY n1 DESC, n3, entity) AS place FROM t")
def _(t):
    return placed(A.tier_counts(facts(t), ["entity"]), F.desc("n1"), F.asc("n3"), F.asc("entity")).select("entity", "points", "place")


@query("srt05", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
def _(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(12)


@query("srt06", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50")
def _(t):
    return t("orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(50)


@query("srt08", "SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey) AS place FROM (SELECT p_partkey, p_size * 2 + CASE WHEN p_brand LIKE '%1' THEN 10 ELSE 0 END AS score FROM part) QUALIFY place <= 20")
def _(t):
    score = F.col("p_size") * 2 + F.when(F.col("p_brand").endswith("1"), 10).otherwise(0)
    best = t("part").select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)
    return placed(best, F.desc("score"), F.asc("p_partkey"))


# ---- text, numbers, dates, JSON, digests ----


@query("set05", "SELECT o_orderkey, len(list_intersect(['urgent', 'high', '1'], regexp_extract_all(lower(o_orderpriority), '[a-z0-9]+'))) / 3 AS share FROM orders")
def _(t):
    wanted = F.array(*map(F.lit, ("urgent", "high", "1")))
    return t("orders").select("o_orderkey", S.overlap(wanted, S.terms(F.col("o_orderpriority"))).alias("share"))


@query("str02", "SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[-_/.,;:| ]+', ' ', 'g')) AS key FROM orders")
def _(t):
    return t("orders").select("o_orderkey", S.plain_key(F.col("o_orderpriority")).alias("key"))


@query("str04", "SELECT o_orderkey, [CAST(year(o_orderdate) AS VARCHAR)] AS years, CASE o_orderkey % 3 WHEN 0 THEN ['united kingdom', 'france'] WHEN 1 THEN ['united states'] ELSE [] END AS places, CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['PLACE'] ELSE ['YEAR'] END AS mismatches FROM orders WHERE year(o_orderdate) BETWEEN 1950 AND 2099")
def _(t):
    place = F.when(F.col("o_orderkey") % 3 == 0, "the U.K. and a French port").when(F.col("o_orderkey") % 3 == 1, "American").otherwise("nowhere, thus")
    note = F.concat(F.lit("placed in "), F.date_format("o_orderdate", "yyyy"), F.lit(", item 20199, "), place)
    year = F.when(F.col("o_orderkey") % 3 == 2, "1951").otherwise(F.date_format("o_orderdate", "yyyy"))
    asked = F.concat(F.lit("imports of Scotland in "), year)
    none = F.array().cast("array<string>")
    return t("orders").select("o_orderkey", S.years(note).alias("years"), F.coalesce(S.places(note), none).alias("places"), F.coalesce(S.mismatches(asked, note), none).alias("mismatches"))


@query("str12", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '%HIGH' THEN 'fast' WHEN o_orderpriority LIKE '%LOW' THEN 'slow' WHEN o_orderpriority LIKE '%MEDIUM' THEN 'open' END AS kind FROM orders")
def _(t):
    aliases = {"urgent": "fast", "high": "fast", "low": "slow", "medium": "open"}
    return t("orders").select("o_orderkey", S.token_kind(F.col("o_orderpriority"), aliases, "open").alias("kind"))


@query("str13", "SELECT n_nationkey, n_name || ' lies in region ' || CAST(n_regionkey AS VARCHAR) || '.' AS sentence FROM nation")
def _(t):
    return t("nation").select("n_nationkey", S.rendered("{name} lies in region {region}.", {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("sentence"))


@query("num02", "SELECT c_custkey, c_acctbal AS value FROM customer")
def _(t):
    return t("customer").select("c_custkey", S.exact_number(F.format_string("%.2f", "c_acctbal")).cast("double").alias("value"))


@query("num04", "SELECT p_partkey, format('{:,.2f}', p_retailprice) || ' EUR' AS price FROM part")
def _(t):
    return t("part").select("p_partkey", S.figure(F.col("p_retailprice"), 2, "EUR").alias("price"))


@query("num06", f"{BY_CELL}, s AS (SELECT entity, total / sum(total) OVER (PARTITION BY entity) AS share, points FROM t) SELECT entity, CAST(sum(points) AS BIGINT) AS points, round(100 * max(share), 2) AS top_percent, round(sum(share * share), 6) AS hhi, round(sum(-share * ln(share)), 6) AS entropy FROM s GROUP BY 1")
def _(t):
    cells = A.tier_counts(facts(t), ["entity", "unit"]).withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy("entity")))
    share = F.col("share")
    return cells.groupBy("entity").agg(
        F.sum("points").alias("points"), F.round(100 * F.max(share), 2).alias("top_percent"), F.round(F.sum(share * share), 6).alias("hhi"), F.round(F.sum(-share * F.ln(share)), 6).alias("entropy")
    )


@query("num07", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS value FROM lineitem")
def _(t):
    odd = F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("NaN")
    return t("lineitem").select("l_orderkey", "l_linenumber", S.exact_number(odd).cast("double").alias("value"))


@query("dat03", "SELECT o_custkey, CASE WHEN d <= 62 THEN 'day' WHEN d <= 1100 THEN 'month' WHEN d <= 3650 THEN 'quarter' ELSE 'year' END AS freq FROM (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS d FROM orders GROUP BY 1)")
def _(t):
    return t("orders").groupBy("o_custkey").agg(S.frequency_of(F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))).alias("freq"))


@query("dat04", " UNION ALL ".join(f"SELECT '{f}' AS format, bool_and(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '{f}') IS NOT NULL) AS fits FROM orders" for f in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d")))
def _(t):
    return C.fitting_formats(t("orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")), "day", ["%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d"])


@query("dat06", "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events")
def _(t):
    return t("events").select("event_id", S.local_date(F.col("ts"), "+09:00").alias("day"))


@query("jsn03", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("jsn04", "SELECT n_nationkey, '{\"key\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"' || n_name || '\"}' AS json FROM nation")
def _(t):
    return t("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json"))


@query("hsh02")
def _(t):
    return t("customer").select("c_custkey", S.lock_key(F.col("c_mktsegment"), F.col("c_name")).alias("lock"))


# ---- predictors ----


@query("stt07", "SELECT 'p_partkey' AS \"column\", 'id_like' AS reason UNION ALL SELECT 'same', 'constant' UNION ALL SELECT 'nothing', 'empty'")
def _(t):
    wide = t("part").select("p_partkey", "p_size", F.lit(1).alias("same"), F.lit(None).cast("int").alias("nothing"))
    return M.exclusions(wide, wide.columns)


@query("stt08", "SELECT 'p_retailprice' AS \"column\", count(DISTINCT p_retailprice) AS \"values\", CASE WHEN count(DISTINCT p_retailprice) > 10 THEN 'regression' ELSE 'classification' END AS problem FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), 'classification' FROM part")
def _(t):
    return M.problem_of(t("part"), ["p_retailprice", "p_brand"])


# ---- cleaning ----


@query("cln07", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice >= 50000")
def _(t):
    steps = [lambda d: P.drop_values(d, "o_orderpriority", ["5-LOW"]), lambda d: P.keep_between(d, "o_totalprice", 50000), lambda d: d.filter("false")]
    return C.apply_steps(t("orders"), steps[:-1]).select("o_orderkey", "o_orderpriority")  # the last step undone


@query("cln08", "SELECT 'number' AS \"column\", 'to_number' AS step UNION ALL SELECT 'blanks', 'trim' UNION ALL SELECT 'holes', 'fill_missing'")
def _(t):
    raw = t("nation").select(
        F.col("n_nationkey").cast("string").alias("number"), F.concat(F.lit(" "), "n_name").alias("blanks"), F.when(F.col("n_nationkey") > 3, F.col("n_name")).alias("holes")
    )
    return C.suggest(raw, raw.columns)


# ---- versioned state and decisions ----


@query("sta06", """WITH b AS (SELECT l_orderkey AS event, l_returnflag AS tier, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 END AS slot, l_partkey % 5 AS entity, CASE WHEN l_orderkey % 2 = 0 OR l_linenumber > 5 THEN 'Team' ELSE 'Single' END AS kind, l_quantity > 25 AS tie, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS "row" FROM lineitem),
 d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event, tier, slot, entity ORDER BY "row") > 1 THEN 'DUPLICATE' END AS r1 FROM b),
 k AS (SELECT *, coalesce(r1, CASE WHEN kind <> first_value(kind) OVER (PARTITION BY event, r1 IS NULL ORDER BY "row") THEN 'KIND_CONFLICT' END) AS r2 FROM d),
 s AS (SELECT *, coalesce(r2, CASE WHEN slot IS NOT NULL AND row_number() OVER (PARTITION BY event, tier, slot, r2 IS NULL ORDER BY "row") > 1 THEN 'SLOT_CONFLICT' END) AS r3 FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY event, tier, slot IS NULL, r3 IS NULL ORDER BY "row") AS turn, list(slot) FILTER (slot IS NOT NULL AND r3 IS NULL) OVER (PARTITION BY event, tier) AS taken FROM s),
 f AS (SELECT * REPLACE (CASE WHEN slot IS NULL AND r3 IS NULL THEN list_filter(range(1, 30), lambda x: NOT list_contains(coalesce(taken, []), x))[turn] ELSE slot END AS slot) FROM o),
 m AS (SELECT *, coalesce(r3, CASE WHEN slot <> 1 AND NOT (slot = 2 AND coalesce(tie AND max(CASE WHEN slot = 1 THEN CAST(tie AS INTEGER) END) OVER (PARTITION BY event, tier, r3 IS NULL) = 1, false)) THEN 'TOO_MANY' END) AS r4 FROM f)
 SELECT event, tier, CAST(slot AS BIGINT) AS slot, entity, "row", coalesce(r4, CASE WHEN kind = 'Team' AND row_number() OVER (PARTITION BY event, entity, r4 IS NULL ORDER BY list_position(['A', 'N', 'R'], tier), slot) > 1 THEN 'TEAM_TWICE' END) AS reason FROM m""")
def _(t):
    slot = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3).cast("long")
    kind = F.when((F.col("l_orderkey") % 2 == 0) | (F.col("l_linenumber") > 5), "Team").otherwise("Single")
    rows = t("lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("tier"), slot.alias("slot"), (F.col("l_partkey") % 5).alias("entity"), kind.alias("kind"), (F.col("l_quantity") > 25).alias("tie"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("row"))
    return V.validated(rows, "event", "tier", "slot", "entity", "kind", "tie", "row", A.TIERS, "Team").drop("kind", "tie")


SNAPSHOTS = """c AS (SELECT n_name AS entity, c_mktsegment AS unit, c_nationkey % 2 AS part, count(*) FILTER (c_acctbal < 5000) AS low_a, count(*) FILTER (c_acctbal >= 5000) AS high_a FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0 OR c_acctbal > 9000 GROUP BY ALL),
 d AS (SELECT n_name AS entity, c_mktsegment AS unit, c_nationkey % 2 AS part, count(*) FILTER (c_acctbal < 5000) AS low_b, count(*) FILTER (c_acctbal >= 5000) AS high_b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0 GROUP BY ALL)"""


@query("sta09", f"""WITH {SNAPSHOTS}, j AS (SELECT entity, unit, part, coalesce(low_b, 0) - coalesce(low_a, 0) AS low, coalesce(high_b, 0) - coalesce(high_a, 0) AS high FROM c FULL JOIN d USING (entity, unit, part)),
 g AS (SELECT 'gained' AS change, entity, unit, part, concat_ws(', ', CASE WHEN low > 0 THEN 'low +' || low END, CASE WHEN high > 0 THEN 'high +' || high END) AS detail FROM j UNION ALL SELECT 'lost', entity, unit, part, concat_ws(', ', CASE WHEN low < 0 THEN 'low ' || low END, CASE WHEN high < 0 THEN 'high ' || high END) FROM j),
 ra AS (SELECT entity, rank() OVER (ORDER BY sum(low_a) DESC, sum(high_a) DESC) AS r FROM c GROUP BY 1), rb AS (SELECT entity, rank() OVER (ORDER BY sum(low_b) DESC, sum(high_b) DESC) AS r FROM d GROUP BY 1)
 SELECT * FROM g WHERE detail <> '' UNION ALL SELECT 'new_unit', entity, unit, NULL, 'first results in this unit' FROM (SELECT entity, unit FROM d WHERE low_b + high_b > 0 EXCEPT SELECT entity, unit FROM c WHERE low_a + high_a > 0)
 UNION ALL SELECT 'rank_change', entity, NULL, NULL, 'rank ' || ra.r || ' -> ' || rb.r FROM ra JOIN rb USING (entity) WHERE ra.r <> rb.r""")
def _(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = [F.count_if(F.col("c_acctbal") < 5000).alias("low"), F.count_if(F.col("c_acctbal") >= 5000).alias("high")]
    taken = lambda d: d.groupBy(F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("unit"), (F.col("c_nationkey") % 2).alias("part")).agg(*counts)
    return V.snapshot_changes(taken(c.filter("c_custkey % 3 <> 0 or c_acctbal > 9000")), taken(c.filter("c_custkey % 4 <> 0")), "entity", "unit", ["part"], ["low", "high"])


@query("sta10", "WITH m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN date_diff('day', o_orderdate::DATE, now::DATE) > 400 THEN 'failed' ELSE 'running' END AS outcome, CASE WHEN o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, now::DATE) > 400 THEN 'STUCK' END AS reason FROM orders, m")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    runs = o.crossJoin(o.agg(F.max("o_orderdate").alias("now")))  # one row
    return V.close_stuck(runs, F.col("o_orderstatus") == "O", "o_orderdate", "now", 400).select("o_orderkey", "outcome", "reason")


@query("sta16", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status FROM orders")
def _(t):
    o = t("orders")
    conflicts = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    note = F.when(F.col("o_totalprice") > 100000, "seen")  # without a note a decision has no effect
    decisions = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("rejected").alias("status"), note.alias("note"), F.lit("ann").alias("resolved_by"), F.col("o_orderdate").alias("at"))
    return V.resolve(conflicts, decisions, "o_orderkey").select("o_orderkey", "status")


@query("sta17", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'collect' WHEN p_brand LIKE '%3' THEN 'extend' WHEN p_size > 36 THEN 'refresh' ELSE 'reuse' END AS decision FROM part")
def _(t):
    return t("part").select("p_partkey", V.reuse(F.col("p_size") / 20, F.col("p_size") * 10, ~F.col("p_brand").endswith("3"), 360).alias("decision"))


# ---- planner ----


@query("pln05", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total, true AS agrees FROM part GROUP BY 1")
def _(t):
    part = t("part")
    first = requests.run(part, requests.Request("group", by=("p_brand",), metrics=("p_size:sum",))).select("p_brand", F.col("p_size_sum").alias("total"))
    again = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.sum(F.col("n") * F.col("p_size")).alias("again"))
    return first.join(again, "p_brand", "full_outer").select("p_brand", "total", (F.abs(F.col("total") - F.col("again")) <= 1e-9 * F.abs("again")).alias("agrees"))
