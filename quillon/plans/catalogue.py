"""Registered queries: each applies a library operator to whole tables; next to it the same in SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import aggregates as A
from quillon.operators import cleaning as C
from quillon.operators import filters as P
from quillon.operators import joins as J
from quillon.operators import ordered as O
from quillon.operators import stats as M
from quillon.operators import versioned as V
from quillon.operators import windows as W
from quillon.operators.pieces import pieces
from quillon.sources import readers as R

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FACTS = """facts AS (SELECT n_name AS entity, p_brand AS unit, o_orderkey AS event, o_orderpriority AS category, l_returnflag AS tier, CAST(l_shipdate AS DATE) AS day
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
TIERS = "count(*) FILTER (tier = 'A') AS n1, count(*) FILTER (tier = 'N') AS n2, count(*) FILTER (tier = 'R') AS n3, count(*) FILTER (tier IN ('A','N','R')) AS total, 3 * count(*) FILTER (tier = 'A') + 2 * count(*) FILTER (tier = 'N') + count(*) FILTER (tier = 'R') AS points"
BY_ENTITY = f"WITH {FACTS}, t AS (SELECT entity, {TIERS} FROM facts GROUP BY entity)"
BY_CELL = f"WITH {FACTS}, t AS (SELECT entity, unit, {TIERS} FROM facts GROUP BY entity, unit)"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(name: str, sql: str | None = None):
    if name in _QUERIES:
        raise KeyError(f"{name} is registered twice")

    def keep(f: Callable) -> Callable:
        _QUERIES[name] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            _SQL[name] = sql
        return f

    return keep


def stream_query(name: str, table: str, sql: str):
    """A query on a table read as a stream; its result is written to a store and read back."""

    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            from quillon.sources.store import Store
            from quillon.streaming.state import written

            path = f"{d}/{table}.parquet"
            # a stream's path is a folder or a pattern, and a table may be one file
            return written(f(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")), Store(spark), name)

        if name in _QUERIES:
            raise KeyError(f"{name} is registered twice")
        _QUERIES[name], _SQL[name] = run, sql
        return f

    return keep


def facts(t) -> DataFrame:
    return J.star(t("lineitem"), t("orders"), t("customer"), t("nation"), t("part"))


def event_facts(t) -> DataFrame:
    """The same for what is counted by event: an order and its lines are in one of the ``pieces``."""
    lines, orders = t("lineitem"), t("orders")
    n = pieces(lines.unionByName(orders, allowMissingColumns=True))
    return J.star(lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey"), t("customer"), t("nation"), t("part"))


def done(t) -> DataFrame:
    """Orders with parts of each brand, and how many are completed; the lines of an order are in one of the ``pieces``."""
    lines = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    events = lines.select("p_brand", "l_orderkey").repartition(pieces(lines), "l_orderkey").distinct().join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.completion(events, "p_brand", "o_orderstatus", ["F"])


def r(c: str, n: int = 6) -> Column:
    return F.round(c, n).alias(c)


# ---- sources and sinks ----


@query("src01", "SELECT k AS kind, (SELECT count(*) FROM nation) AS n, 4 AS columns, true AS same_digest FROM (VALUES ('csv'), ('json'), ('xlsx')) AS v(k)")
def _(t):
    import hashlib
    import json

    from quillon.sources import writers
    from quillon.sources.store import Store

    nation = t("nation").orderBy("n_nationkey")  # 25 rows
    spark = nation.sparkSession
    files = {"csv": writers.csv_bytes(nation), "json": json.dumps([r.asDict() for r in nation.collect()]).encode(), "xlsx": writers.xlsx_bytes(nation)}
    store, out = Store(spark), []
    for kind, data in files.items():
        store.put(f"nation.{kind}", data)
        opened = R.open_table(spark, store.path(f"nation.{kind}"))
        out.append((kind, opened.table.count(), len(opened.table.columns), opened.sha256 == hashlib.sha256(data).hexdigest()))
    return spark.createDataFrame(out, "kind string, n long, columns int, same_digest boolean")


#: Records of a CSV with quotes, line ends in cells, blank lines and ragged rows, made of the nations.
TRICKY = "SELECT n_nationkey + 1 + n_nationkey // 5 + 1 + (n_nationkey + 6) // 7 AS row_id, CAST(n_nationkey AS VARCHAR) AS k, n_name || ', \"the ' || n_nationkey || '\"' || chr(10) || 'next' AS name, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS region, NULL::VARCHAR AS reason FROM nation UNION ALL SELECT n_nationkey + 2 + n_nationkey // 5 + 1 + (n_nationkey + 6) // 7, NULL, NULL, NULL, 'RAGGED_ROW' FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT -1, CAST(count(*) AS VARCHAR), NULL, NULL, 'BLANK' FROM nation WHERE n_nationkey % 5 = 0"


@query("src02", TRICKY)
def _(t):
    from quillon.sources.store import Store

    spark, lines = t("nation").sparkSession, ["k,name,region"]
    for r in t("nation").orderBy("n_nationkey").collect():  # 25 rows
        k = r["n_nationkey"]
        lines += [""] * (k % 5 == 0) + [f'{k},"{r["n_name"]}, ""the {k}""\nnext",{r["n_regionkey"] if k % 3 else ""}'] + [f"{k},short"] * (k % 7 == 0)
    store = Store(spark)
    store.put("tricky.csv", ("\n".join(lines) + "\n").encode())
    found = R.read_csv(spark, store.path("tricky.csv"), ragged="reject")
    none = [F.lit(None).cast("string").alias(c) for c in ("k", "name", "region")]
    blank = spark.createDataFrame([(-1, str(found.blank_lines), None, None, "BLANK")], "row_id long, k string, name string, region string, reason string")
    return found.table.withColumn("reason", F.lit(None).cast("string")).unionByName(found.rejects.select("row_id", *none, "reason")).unionByName(blank)


@query("src08", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS row_id FROM supplier")
def _(t):
    return R.number_rows(t("supplier").select("s_suppkey").orderBy("s_suppkey"))


@query("src09", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey LIMIT 1000")
def _(t):
    return R.uniform_sample(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 7)


@query("src11", "SELECT CAST(page_id AS BIGINT) AS page, CAST(0 AS INTEGER) AS table_index, CAST(CASE WHEN page_id % 4 = 3 THEN 1 ELSE 2 END AS INTEGER) AS n_rows, CASE page_id % 4 WHEN 1 THEN 'NO_HEADER' WHEN 2 THEN 'MERGED' WHEN 3 THEN 'NO_ROWS' END AS reason, CASE WHEN page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) END AS first_cell FROM pages WHERE html IS NOT NULL AND html NOT LIKE '%<table%'")
def _(t):
    # pages have no tables of their own: each gets one, of four kinds
    head = F.concat(F.lit("<table><tr><"), F.when(F.col("page_id") % 4 == 1, "td").otherwise("th"), F.lit(">id</td><th"), F.when(F.col("page_id") % 4 == 2, " colspan=2").otherwise(""), F.lit(">url</th></tr>"))
    body = F.when(F.col("page_id") % 4 == 3, "").otherwise(F.concat(F.lit("<tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>x</td></tr>")))
    pages = t("pages").filter("html is not null and html not like '%<table%'").withColumn("html", F.concat(head, body, F.lit("</table>"), "html"))
    first = F.when(F.col("reason").isNull(), F.get(F.get("cells", F.lit(1)), F.lit(0)))
    return R.html_tables(pages, "page_id", "html").select("page", "table_index", "n_rows", "reason", first.alias("first_cell"))


@query("src16", "SELECT event_id, user_id, list_position(list_sort((SELECT list(DISTINCT event_type) FROM events)), event_type) AS code, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def _(t):
    kinds = sorted(r[0] for r in t("events").select("event_type").distinct().limit(100).collect())  # a handful
    rows = t("events").select("event_id", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))
    return R.coded(rows, "event_type", {kind: i for i, kind in enumerate(kinds, 1)}, "code", ["event_id"]).select("event_id", "user_id", "code", "k")


@query("src17", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) > 1 AS is_tie, max(CAST(l_linestatus = 'O' AS INTEGER)) OVER (PARTITION BY l_orderkey) = 1 AS is_open FROM lineitem")
def _(t):
    per_tier, per_event = Window.partitionBy("l_orderkey", "l_returnflag"), Window.partitionBy("l_orderkey")
    tie = F.count("*").over(per_tier) > 1
    return t("lineitem").select("l_orderkey", "l_linenumber", tie.alias("is_tie"), (F.max((F.col("l_linestatus") == "O").cast("int")).over(per_event) == 1).alias("is_open"))


@query("src18", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def _(t):
    return t("lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src20", "SELECT r_regionkey, lower(trim(r_name)) AS alias, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(t):
    return t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", S.plain_key(F.col("r_name")).alias("alias"), "n_name")


@query("snk01", "SELECT 'nation.csv' AS name, sha256('n_nationkey,n_name,n_regionkey' || chr(10) || (SELECT string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || chr(10), '' ORDER BY n_nationkey) FROM nation)) AS digest UNION ALL SELECT 'cells.csv', sha256('k,formula,price,day' || chr(10) || (SELECT string_agg(n_nationkey || ',\"''=1+' || n_nationkey || ',x\",' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(-n_nationkey - 1 AS VARCHAR) || '.5' ELSE '' END || ',2024-02-29' || chr(10), '' ORDER BY n_nationkey) FROM nation))")
def _(t):
    import hashlib

    from quillon.sources import writers

    nation = t("nation").orderBy("n_nationkey")
    cells = nation.select(
        F.col("n_nationkey").alias("k"), F.concat(F.lit("=1+"), F.col("n_nationkey").cast("string"), F.lit(",x")).alias("formula"),
        F.when(F.col("n_nationkey") % 2 == 0, -F.col("n_nationkey") - 1.5).alias("price"), F.lit("2024-02-29").cast("date").alias("day"),
    )
    found = [(name, hashlib.sha256(writers.csv_bytes(df)).hexdigest()) for name, df in (("nation.csv", nation), ("cells.csv", cells))]
    return nation.sparkSession.createDataFrame(found, "name string, digest string")


@query("snk13", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS payload FROM nation GROUP BY n_regionkey")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("payload"))


@query("snk14", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def _(t):
    one = lambda n: t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("orders").unionByName(one("lineitem")).unionByName(one("customer"))


# ---- filters ----


@query("flt01", "SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' OR trim(o_orderpriority) = '' THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def _(t):
    return t("orders").select("o_orderkey", S.without_marker(F.col("o_orderpriority"), ["4-NOT SPECIFIED"]).alias("priority"))


NULLED = "(SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, o_totalprice, o_orderdate FROM orders)"


def nulled(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"), "o_totalprice", "o_orderdate")


@query("flt02", f"SELECT o_orderkey, priority FROM {NULLED} WHERE priority IN ('1-URGENT', '5-LOW')")
def _(t):
    return P.keep_values(nulled(t), "priority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "priority")


@query("flt03", f"SELECT o_orderkey, priority FROM {NULLED} WHERE priority IS NULL OR priority NOT IN ('1-URGENT', '5-LOW')")
def _(t):
    return P.drop_values(nulled(t), "priority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "priority")


@query("flt04", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def _(t):
    return P.keep_between(t("lineitem"), "l_quantity", 10, 12).select("l_orderkey", "l_linenumber")


@query("flt06", "SELECT 'c_phone' AS column_name, 'text' AS kind UNION ALL SELECT 'c_acctbal', 'number' UNION ALL SELECT 'o_orderdate', 'date' UNION ALL SELECT 'c_code', 'text'")
def _(t):
    customer = t("customer").select(F.format_string("+%d-phone", F.col("c_custkey")).alias("c_phone"), "c_acctbal", F.format_string("%07d", F.col("c_custkey")).alias("c_code"))
    found = P.column_kinds(customer, ["c_phone", "c_acctbal", "c_code"])
    return found.unionByName(P.column_kinds(t("orders").select(F.to_date("o_orderdate").alias("o_orderdate")), ["o_orderdate"]))


@query("flt08", f"SELECT o_orderkey FROM {NULLED} WHERE priority IS NOT NULL AND o_orderdate IS NOT NULL")
def _(t):
    return P.drop_missing(nulled(t), ["priority", "o_orderdate"]).select("o_orderkey")


@query("flt09", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t):
    return P.drop_column(t("supplier"), "s_acctbal")


@query("flt10", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return P.drop_empty_columns(t("supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("nothing")), ["nothing", "s_name"])


@query("flt11", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def _(t):
    return t("orders").filter("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey")


@query("flt12", f"WITH {FACTS} SELECT entity, {TIERS} FROM facts WHERE category = '1-URGENT' GROUP BY entity")
def _(t):
    return A.tier_counts(facts(t).filter("category = '1-URGENT'"), ["entity"])


@query("flt13", "SELECT p_partkey, CASE WHEN p_size >= 25 THEN p_retailprice END AS shown_price FROM part")
def _(t):
    return t("part").select("p_partkey", P.masked(F.col("p_retailprice"), F.col("p_size") >= 25).alias("shown_price"))


@query("flt14", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 5")


@query("flt15", "SELECT l_linestatus, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity < 10) AS small FROM lineitem GROUP BY l_linestatus")
def _(t):
    return t("lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_quantity") < 10).alias("small"))


@query("flt16", "SELECT o_orderkey AS event, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS status FROM orders")
def _(t):
    return P.renamed(t("orders"), {"o_orderkey": "event", "o_orderstatus": "status"}, {"status": {"F": "done", "O": "open", "P": "part"}})


@query("flt17", "SELECT CASE WHEN l_returnflag = 'N' THEN 'R' ELSE l_returnflag END AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").select("l_returnflag").replace({"N": "R"}).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("flt18", "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'MISMATCH' WHEN page_id % 4 = 2 THEN 'OFF_TOPIC' WHEN page_id % 4 = 3 AND again THEN 'REPEATED_URL' WHEN page_id % 4 = 0 AND again THEN 'REPEATED_URL' END AS reason, CASE WHEN page_id % 4 = 2 THEN 0.0 ELSE 1.0 END AS relevance FROM (SELECT page_id, false AS again FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id + 1000000000, true FROM pages WHERE url IS NOT NULL AND page_id % 8 = 3) WHERE true")
def _(t):
    pages = t("pages").filter("url is not null").select("page_id", F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")).alias("url"))
    again = pages.filter("page_id % 8 = 3").select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat("url", F.lit("/#top")).alias("url"))
    rows = pages.unionByName(again)
    k = F.col("page_id") % 4
    found = F.when(k == 1, "wool exports of France, 1999").when(k == 2, "a list of nothing in Scotland").otherwise("exports of wool, British, 1999 and 2001")
    return P.leads(rows, "url", F.lit("wool exports 1999 UK").alias("w"), found).select("page_id", "reason", "relevance")


@query("flt19", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return o.crossJoin(o.agg(F.max("o_orderdate").alias("now"))).filter("o_orderstatus = 'O' and o_orderdate < now - interval 60 days").select("o_orderkey")  # one row


@query("flt23", "SELECT s_suppkey, 'https://example.org/supplier/' || s_suppkey AS source_url, DATE '2024-01-01' AS retrieved_at, sha256(s_name) AS content_sha256, 'supplier' AS source_table, s_suppkey AS source_row FROM supplier")
def _(t):
    url = F.concat(F.lit("https://example.org/supplier/"), F.col("s_suppkey").cast("string"))
    return P.provenance(t("supplier"), "supplier", "s_suppkey", url, F.lit("2024-01-01").cast("date"), F.sha2("s_name", 256)).select("s_suppkey", "source_url", "retrieved_at", "content_sha256", "source_table", "source_row")


# ---- joins ----


@query("jn01", "SELECT l_orderkey, l_linenumber, n_name AS entity, p_brand AS unit, o_orderpriority AS category, l_returnflag AS tier, s_name AS entrant FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey WHERE l_linestatus = 'F'")
def _(t):
    dims = [(t("orders"), "o_orderkey", "l_orderkey"), (t("customer"), "c_custkey", "o_custkey"), (t("nation"), "n_nationkey", "c_nationkey"), (t("part"), "p_partkey", "l_partkey")]
    view = J.fact_view(t("lineitem"), dims, [(t("supplier").filter("s_acctbal > 0"), "s_suppkey", "l_suppkey")], F.col("l_linestatus") == "F")
    return view.select("l_orderkey", "l_linenumber", F.col("n_name").alias("entity"), F.col("p_brand").alias("unit"), F.col("o_orderpriority").alias("category"), F.col("l_returnflag").alias("tier"), F.col("s_name").alias("entrant"))


@query("jn02", "SELECT l_partkey, count(*) AS lines, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


@query("jn03", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn04", "SELECT ps.s_nationkey AS nation, ps.n AS suppliers, coalesce(c.n, 0) AS rich FROM (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) ps LEFT JOIN (SELECT s_nationkey, count(*) n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) c USING (s_nationkey)")
def _(t):
    every = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    rich = t("supplier").filter("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count("*").alias("rich"))
    return every.join(rich, "s_nationkey", "left").na.fill(0, ["rich"]).withColumnRenamed("s_nationkey", "nation")


@query("jn05", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    return t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name")


@query("jn06", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@query("jn07", "SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS ours, coalesce(y, 0) AS theirs, coalesce(x, 0) - coalesce(y, 0) AS delta FROM (SELECT s_nationkey k, count(*) x FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey k, count(*) y FROM customer GROUP BY 1) b ON a.k = b.k WHERE coalesce(x, 0) <> coalesce(y, 0)")
def _(t):
    a = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return J.compare_counts(a, b, ["k"], "n")


YEARS = "(SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders WHERE year(o_orderdate) {} GROUP BY 1)"


@query("jn08", f"SELECT coalesce(a.k, b.k) AS k, m.measure, m.was, m.now, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN m.now > m.was THEN 'gained' ELSE 'lost' END AS kind FROM {YEARS.format('<= 1994')} a FULL JOIN {YEARS.format('> 1994')} b ON a.k = b.k, LATERAL (SELECT 'n' AS measure, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS now UNION ALL SELECT 'f', coalesce(a.f, 0), coalesce(b.f, 0)) m WHERE m.was <> m.now")
def _(t):
    o = t("orders").withColumn("y", F.year("o_orderdate"))
    side = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return V.change_feed(side(o.filter("y <= 1994")), side(o.filter("y > 1994")), "k", ["n", "f"])


@query("jn09", f"WITH {FACTS}, g AS (SELECT entity, tier, category FROM (SELECT DISTINCT entity FROM facts), (SELECT unnest(['A','N','R']) AS tier), (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS category)) SELECT entity, tier, category, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT entity, tier, category, count(*) AS n FROM facts GROUP BY ALL) USING (entity, tier, category)")
def _(t):
    return J.dense_counts(facts(t).select("entity", "tier", "category"), ["entity", "tier", "category"], {"tier": A.TIERS, "category": PRIORITIES})


@query("jn10", "SELECT n, s FROM (SELECT DISTINCT c_nationkey AS n FROM customer), (SELECT DISTINCT c_mktsegment AS s FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9500")
def _(t):
    c = t("customer")
    have = c.filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).distinct()
    return c.select(F.col("c_nationkey").alias("n")).distinct().crossJoin(c.select(F.col("c_mktsegment").alias("s")).distinct()).join(have, ["n", "s"], "left_anti")


@query("jn11", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t("customer").join(t("orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("jn12", "SELECT c_custkey, coalesce(s, 'unverified') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    last = J.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])
    return t("customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("unverified")).alias("status"))


@query("jn13", "SELECT user_id, event_type, arg_max(value, struct_pack(ts := ts, e := event_id)) AS value FROM events WHERE event_type <> 'click' GROUP BY 1, 2")
def _(t):
    e = t("events").filter("event_type <> 'click'").select("user_id", "event_type", "ts", "event_id", "value")
    return J.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("jn14", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber AND a.l_returnflag <> b.l_returnflag")
def _(t):
    return J.conflict_pairs(t("lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber").select("l_orderkey", "a", "b")


@query("jn15", "WITH v AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2), f AS (SELECT *, arg_min(l_returnflag, struct_pack(s := seen, f := l_returnflag)) OVER (PARTITION BY l_orderkey) AS first_value FROM v) SELECT l_orderkey, l_returnflag, seen, first_value FROM f WHERE l_returnflag <> first_value")
def _(t):
    v = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("seen"))
    f = v.withColumn("first_value", F.first("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("seen", "l_returnflag")))
    return f.filter("l_returnflag <> first_value").select("l_orderkey", "l_returnflag", "seen", "first_value")


@query("jn16", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(t):
    o = t("orders")
    return o.join(o.agg(F.max("o_orderdate").alias("o_orderdate")), "o_orderdate", "left_semi").select("o_orderkey", "o_totalprice")


@query("jn17", "SELECT c_custkey, n_nationkey AS target, CASE WHEN n_nationkey IS NULL THEN 'UNKNOWN_NAME' END AS reason FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def _(t):
    names = t("nation").select("n_nationkey", F.upper(F.concat(F.lit(" "), F.regexp_replace("n_name", " ", "-"))).alias("name"))
    rows = t("customer").join(names, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "name")
    aliases = t("nation").filter("n_nationkey < 20").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("target"))
    return J.resolve_alias(rows, "name", aliases).select("c_custkey", "target", "reason")


@query("jn18", "SELECT s_suppkey, c_custkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9000 AND c_acctbal > 9000 AND r_name LIKE 'A%'")
def _(t):
    s, c = t("supplier").filter("s_acctbal > 9000"), t("customer").filter("c_acctbal > 9000")
    n = t("nation").join(t("region").filter("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey")).select("s_suppkey", "c_custkey", "n_name")


HOST = "regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1)"


@query("jn19", f"SELECT page_id, CASE WHEN {HOST} LIKE '%example.com' THEN 'known' WHEN {HOST} LIKE '%.com' THEN 'com' WHEN {HOST} LIKE '%.org' THEN 'org' END AS rule FROM pages")
def _(t):
    spark = t("pages").sparkSession
    rules = spark.createDataFrame([("example.com", "known"), ("com", "com"), ("org", "org")], "domain string, rule string")
    return J.longest_suffix(t("pages").select("page_id", S.host(F.col("url")).alias("host")), "host", rules).select("page_id", "rule")


@query("jn20", f"SELECT page_id, CASE WHEN {HOST} LIKE 'blog.%' AND {HOST} LIKE '%.example.net' THEN 'net' WHEN {HOST} LIKE '%.example.net' OR {HOST} = 'example.net' THEN 'net' WHEN {HOST} LIKE '%.example.org' OR {HOST} = 'example.org' THEN 'org' END AS policy FROM pages")
def _(t):
    policies = t("pages").sparkSession.createDataFrame([("example.org", "org"), ("example.net", "net"), ("org", "never"), ("net", "never"), ("com", "never")], "domain string, rule string")
    hosts = t("pages").select("page_id", S.host(F.col("url")).alias("host"))
    return J.parent_policy(hosts, "host", policies).select("page_id", F.col("rule").alias("policy"))


@query("jn21", "SELECT count(*) AS compared, count(*) FILTER (coalesce(x, 0) <> coalesce(y, 0)) AS differing FROM (SELECT s_nationkey k, count(*) x FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey k, count(*) // 15 y FROM customer GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("x"))
    b = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.expr("count(*) div 15").alias("y"))
    return a.join(b, "k", "full_outer").na.fill(0).agg(F.count("*").alias("compared"), F.count_if(F.col("x") != F.col("y")).alias("differing"))


@query("jn22", "SELECT o_orderstatus AS status, c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def _(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


# ---- aggregations ----


@query("agg01", "SELECT coalesce(priority, '(null)') AS priority, count(*) AS rows, round(sum(o_totalprice), 2) AS o_totalprice_sum, count(DISTINCT o_orderdate) AS o_orderdate_distinct FROM " + NULLED + " GROUP BY 1")
def _(t):
    return A.group_aggregate(nulled(t), ["priority"], ["o_totalprice:sum", "o_orderdate:distinct"]).select("priority", "rows", r("o_totalprice_sum", 2), "o_orderdate_distinct")


@query("agg02", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum FROM lineitem GROUP BY 1")
def _(t):
    return A.group_aggregate(t("lineitem"), ["l_returnflag"], ["l_linenumber:sum"]).drop("rows")


@query("agg03", "SELECT p_brand, round(sum(p_size) / count(p_size), 9) AS p_size_mean FROM part GROUP BY 1")
def _(t):
    return A.group_aggregate(t("part"), ["p_brand"], ["p_size:mean"]).select("p_brand", r("p_size_mean", 9))


@query("agg04", "SELECT p_brand, round(median(p_retailprice), 4) AS p_retailprice_median FROM part GROUP BY 1")
def _(t):
    return A.group_aggregate(t("part"), ["p_brand"], ["p_retailprice:median"]).select("p_brand", r("p_retailprice_median", 4))


@query("agg05", "SELECT p_brand, min(p_name) AS p_name_min, max(p_size) AS p_size_max FROM part GROUP BY 1")
def _(t):
    return A.group_aggregate(t("part"), ["p_brand"], ["p_name:min", "p_size:max"]).drop("rows")


@query("agg06", "SELECT o_custkey, count(priority) AS priority_count, count(DISTINCT priority) AS priority_distinct FROM (SELECT o_custkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders) GROUP BY 1")
def _(t):
    o = t("orders").select("o_custkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))
    return A.group_aggregate(o, ["o_custkey"], ["priority:count", "priority:distinct"]).select(F.col("o_custkey").cast("long"), "priority_count", "priority_distinct")


@query("agg08", "WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, v NULLS LAST) AS p, sum(n) OVER () AS a FROM c) SELECT CASE WHEN p > 10 THEN '(other)' ELSE v END AS value, CAST(least(p, 11) AS INTEGER) AS place, CAST(sum(n) AS BIGINT) AS rows, round(sum(n) / max(a), 6) AS share FROM k GROUP BY 1, 2")
def _(t):
    return A.value_counts(t("part"), "p_type", 10, normalize=True).select("value", "place", "rows", r("share"))


@query("agg09", "SELECT 'p_partkey' AS \"column\", 'integer' AS type, count(p_partkey) AS count, count(*) - count(p_partkey) AS nulls, count(DISTINCT p_partkey) AS \"distinct\", CAST(min(p_partkey) AS VARCHAR) AS min, CAST(max(p_partkey) AS VARCHAR) AS max, round(avg(p_partkey), 4) AS mean, round(median(p_partkey), 4) AS median, round(stddev_samp(p_partkey), 4) AS std, round(quantile_cont(p_partkey, 0.25), 4) AS p25, round(quantile_cont(p_partkey, 0.75), 4) AS p75, NULL::INTEGER AS min_length, NULL::INTEGER AS max_length, NULL::DOUBLE AS mean_length FROM part UNION ALL SELECT 'p_name' AS \"column\", 'text' AS type, count(p_name) AS count, count(*) - count(p_name) AS nulls, count(DISTINCT p_name) AS \"distinct\", CAST(min(p_name) AS VARCHAR) AS min, CAST(max(p_name) AS VARCHAR) AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS p25, NULL::DOUBLE AS p75, min(len(p_name))::INTEGER AS min_length, max(len(p_name))::INTEGER AS max_length, round(avg(len(p_name)), 4) AS mean_length FROM part UNION ALL SELECT 'p_size' AS \"column\", 'integer' AS type, count(p_size) AS count, count(*) - count(p_size) AS nulls, count(DISTINCT p_size) AS \"distinct\", CAST(min(p_size) AS VARCHAR) AS min, CAST(max(p_size) AS VARCHAR) AS max, round(avg(p_size), 4) AS mean, round(median(p_size), 4) AS median, round(stddev_samp(p_size), 4) AS std, round(quantile_cont(p_size, 0.25), 4) AS p25, round(quantile_cont(p_size, 0.75), 4) AS p75, NULL::INTEGER AS min_length, NULL::INTEGER AS max_length, NULL::DOUBLE AS mean_length FROM part UNION ALL SELECT 'p_retailprice' AS \"column\", 'decimal' AS type, count(p_retailprice) AS count, count(*) - count(p_retailprice) AS nulls, count(DISTINCT p_retailprice) AS \"distinct\", CAST(min(p_retailprice) AS VARCHAR) AS min, CAST(max(p_retailprice) AS VARCHAR) AS max, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, round(stddev_samp(p_retailprice), 4) AS std, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.75), 4) AS p75, NULL::INTEGER AS min_length, NULL::INTEGER AS max_length, NULL::DOUBLE AS mean_length FROM part")
def _(t):
    return A.describe(t("part"), ["p_retailprice", "p_size", "p_name", "p_partkey"]).withColumns({c: F.round(c, 4) for c in ("mean", "median", "std", "p25", "p75", "mean_length")})


@query("agg10", "WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n, sum(o_totalprice) AS v FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1991-10-15' AND DATE '1995-03-10' GROUP BY 1), c AS (SELECT unnest(generate_series(DATE '1991-10-01', DATE '1995-03-01', INTERVAL 1 MONTH))::DATE AS d) SELECT strftime(c.d, '%Y-%m') AS period, coalesce(n, 0) AS rows, round(v, 2) AS value FROM c LEFT JOIN g USING (d)")
def _(t):
    return A.time_trend(t("orders"), "o_orderdate", "o_totalprice", "sum", start="1991-10-15", end="1995-03-10").select("period", "rows", r("value", 2))


@query("agg11", f"{BY_CELL} SELECT * FROM t")
def _(t):
    return A.tier_counts(facts(t), ["entity", "unit"])


@query("agg12", f"{BY_ENTITY} SELECT *, round(n1 / total, 6) AS first_share, rank() OVER (ORDER BY n1 DESC, n2 DESC, n3 DESC) AS podium_rank, rank() OVER (ORDER BY total DESC) AS total_rank, rank() OVER (ORDER BY points DESC) AS points_rank FROM t")
def _(t):
    return A.entity_summary(facts(t)).withColumn("first_share", F.round("first_share", 6))


@query("agg13", f"{BY_CELL} SELECT *, round(total / sum(total) OVER (PARTITION BY entity), 6) AS entity_share, round(total / sum(total) OVER (PARTITION BY unit), 6) AS market_share, round(n1 / sum(n1) OVER (PARTITION BY unit), 6) AS first_market_share, round(n1 / total, 6) AS first_ratio FROM t")
def _(t):
    return A.entity_unit(facts(t)).withColumns({c: F.round(c, 6) for c in ("entity_share", "market_share", "first_market_share", "first_ratio")})


@query("agg14", f"WITH {FACTS} SELECT entity, unit, category, {TIERS} FROM facts GROUP BY entity, unit, category")
def _(t):
    return A.tier_counts(facts(t), ["entity", "unit", "category"])


@query("agg15", f"{BY_CELL}, s AS (SELECT *, total / sum(total) OVER (PARTITION BY unit) AS share FROM t), o AS (SELECT p_brand AS unit, count(*) AS events_total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM (SELECT DISTINCT p_brand, o_orderkey, o_orderstatus FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1) SELECT unit, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, CAST(sum(n3) AS BIGINT) AS n3, CAST(sum(total) AS BIGINT) AS total, CAST(sum(points) AS BIGINT) AS points, any_value(c1) AS c1, any_value(c2) AS c2, any_value(c3) AS c3, any_value(c4) AS c4, any_value(c5) AS c5, count(*) AS entities, arg_min(entity, struct_pack(a := -total, b := entity)) AS leader, round(max(share), 6) AS leader_share, round(sum(share * share), 6) AS hhi, any_value(events) AS events, round(any_value(c2) / sum(total), 6) AS focus_share, any_value(events_total) AS events_total, any_value(completed) AS completed, round(any_value(completed) / any_value(events_total), 6) AS share, any_value(completed) < any_value(events_total) AS partial FROM s JOIN (SELECT unit, count(*) FILTER (category = '1-URGENT') AS c1, count(*) FILTER (category = '2-HIGH') AS c2, count(*) FILTER (category = '3-MEDIUM') AS c3, count(*) FILTER (category = '4-NOT SPECIFIED') AS c4, count(*) FILTER (category = '5-LOW') AS c5, count(DISTINCT event) AS events FROM facts GROUP BY 1) USING (unit) JOIN o USING (unit) GROUP BY unit")
def _(t):
    out = A.unit_summary(event_facts(t), PRIORITIES, "2-HIGH", done(t))
    return out.withColumns({c: F.round(c, 6) for c in ("leader_share", "hhi", "focus_share", "share")})


@query("agg16", "SELECT o_orderpriority AS unit, count(*) AS events, count(*) FILTER (o_orderstatus = 'F') AS completed, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS share, count(*) FILTER (o_orderstatus = 'F') < count(*) AS partial FROM orders GROUP BY 1")
def _(t):
    return A.completion(t("orders"), "o_orderpriority", "o_orderstatus", ["F"]).withColumn("share", F.round("share", 6))


@query("agg17", f"WITH {FACTS}, c AS (SELECT entity, count(*) FILTER (category = '1-URGENT') AS c1, 3 * count(*) FILTER (category = '1-URGENT' AND tier = 'A') + 2 * count(*) FILTER (category = '1-URGENT' AND tier = 'N') + count(*) FILTER (category = '1-URGENT' AND tier = 'R') AS p1, count(*) FILTER (category = '2-HIGH') AS c2, 3 * count(*) FILTER (category = '2-HIGH' AND tier = 'A') + 2 * count(*) FILTER (category = '2-HIGH' AND tier = 'N') + count(*) FILTER (category = '2-HIGH' AND tier = 'R') AS p2, count(*) FILTER (category = '3-MEDIUM') AS c3, 3 * count(*) FILTER (category = '3-MEDIUM' AND tier = 'A') + 2 * count(*) FILTER (category = '3-MEDIUM' AND tier = 'N') + count(*) FILTER (category = '3-MEDIUM' AND tier = 'R') AS p3, count(*) FILTER (category = '4-NOT SPECIFIED') AS c4, 3 * count(*) FILTER (category = '4-NOT SPECIFIED' AND tier = 'A') + 2 * count(*) FILTER (category = '4-NOT SPECIFIED' AND tier = 'N') + count(*) FILTER (category = '4-NOT SPECIFIED' AND tier = 'R') AS p4, count(*) FILTER (category = '5-LOW') AS c5, 3 * count(*) FILTER (category = '5-LOW' AND tier = 'A') + 2 * count(*) FILTER (category = '5-LOW' AND tier = 'N') + count(*) FILTER (category = '5-LOW' AND tier = 'R') AS p5, count(*) AS total FROM facts GROUP BY 1) SELECT *, round(c2 / total, 6) AS share, round(c2 / (c1 + c2), 6) AS share_of_two, CASE WHEN c1 + c2 >= 3 THEN round(p2 / (p1 + p2), 6) END AS gap FROM c")
def _(t):
    return A.category_summary(facts(t), PRIORITIES, "2-HIGH", "1-URGENT").withColumns({c: F.round(c, 6) for c in ("share", "share_of_two", "gap")})


@query("agg18", f"{BY_CELL}, s AS (SELECT *, total / sum(total) OVER (PARTITION BY entity) AS share, row_number() OVER (PARTITION BY entity ORDER BY total DESC, unit) AS p FROM t), c AS (SELECT entity, CAST(sum(total) AS BIGINT) AS total, count(*) FILTER (n1 >= 1) AS units_with_first, sum(share * share) AS hhi, max(share) AS top1, sum(share) FILTER (p <= 3) AS top3, sum(-share * ln(share)) AS entropy, count(*) AS units FROM s GROUP BY 1) SELECT entity, total, units_with_first, round(hhi, 6) AS hhi, round(top1, 6) AS top1, round(top3, 6) AS top3, round(entropy, 6) AS entropy, units, round(1 / hhi, 6) AS effective, round(units / (SELECT count(DISTINCT unit) FROM facts), 6) AS coverage, CASE WHEN hhi > 0.25 THEN 'concentrated' WHEN hhi >= 0.10 THEN 'moderate' ELSE 'diversified' END AS label, total < 3 AS small_sample FROM c")
def _(t):
    return A.concentration(facts(t)).withColumns({c: F.round(c, 6) for c in ("hhi", "top1", "top3", "entropy", "effective", "coverage")})


@query("agg19", f"{BY_CELL} SELECT entity, unit, n1, total, round(total / sum(total) OVER (PARTITION BY entity), 6) AS share_of_entity, round(sum(total) OVER (PARTITION BY unit) / sum(total) OVER (), 6) AS unit_share, CASE WHEN total >= 2 THEN round((total / sum(total) OVER (PARTITION BY entity)) / (sum(total) OVER (PARTITION BY unit) / sum(total) OVER ()), 6) END AS rca, total < 3 AS small_sample FROM t")
def _(t):
    return A.specialisation(facts(t)).withColumns({c: F.round(c, 6) for c in ("share_of_entity", "unit_share", "rca")})


@query("agg20", f"WITH {FACTS}, e AS (SELECT entity, unit, event, count(*) AS n, count(*) FILTER (tier = 'A') AS n1 FROM facts GROUP BY ALL), c AS (SELECT unit, count(DISTINCT event) AS completed FROM facts GROUP BY 1) SELECT entity, unit, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n >= 2) AS sweeps, any_value(completed) AS completed, round(sum(n) / any_value(completed), 6) AS event_conversion, round(sum(n1) / any_value(completed), 6) AS first_conversion FROM e JOIN c USING (unit) GROUP BY 1, 2")
def _(t):
    return A.conversion(event_facts(t)).withColumns({c: F.round(c, 6) for c in ("event_conversion", "first_conversion")})


@query("agg20_completed", f"WITH {FACTS}, o AS (SELECT p_brand AS unit, count(*) AS events_total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM (SELECT DISTINCT p_brand, o_orderkey, o_orderstatus FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1), e AS (SELECT entity, unit, count(*) AS total, count(*) FILTER (tier = 'A') AS n1 FROM facts GROUP BY ALL) SELECT entity, unit, n1, total, completed, events_total, round(completed / events_total, 6) AS completed_share, completed < events_total AS partial, round(total / completed, 6) AS event_conversion, round(n1 / completed, 6) AS first_conversion FROM e JOIN o USING (unit)")
def _(t):
    out = A.conversion(event_facts(t), done(t)).withColumns({c: F.round(c, 6) for c in ("completed_share", "event_conversion", "first_conversion")})
    return out.drop("sweeps")


@query("agg21", f"{BY_CELL}, s AS (SELECT unit, total / sum(total) OVER (PARTITION BY unit) AS share FROM t) SELECT unit, round(10000 * sum(share * share), 3) AS hhi, round(max(share), 6) AS leader_share FROM s GROUP BY 1")
def _(t):
    return A.unit_summary(event_facts(t)).select("unit", F.round(F.col("hhi") * 10000, 3).alias("hhi"), F.round("leader_share", 6).alias("leader_share"))


@query("agg22", f"{BY_CELL} SELECT entity, arg_min(unit, struct_pack(a := -total, b := unit)) AS best, round(max(total) / sum(total), 6) AS dependence FROM t GROUP BY 1")
def _(t):
    cells = A.tier_counts(facts(t), ["entity", "unit"])
    return cells.groupBy("entity").agg(F.min_by("unit", F.struct(-F.col("total"), F.col("unit"))).alias("best"), F.round(F.max("total") / F.sum("total"), 6).alias("dependence"))


@query("agg24", f"{BY_CELL} SELECT entity, unit, round(100 * total / sum(total) OVER (PARTITION BY entity), 2) AS percent FROM t")
def _(t):
    cells = A.tier_counts(facts(t), ["entity", "unit"])
    return cells.select("entity", "unit", F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy("entity")), 2).alias("percent"))


@query("agg25", "SELECT o_orderpriority AS name, 'F' AS status, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'O', count(*) FILTER (o_orderstatus = 'O') FROM orders GROUP BY 1")
def _(t):
    wide = t("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FO"])
    return wide.unpivot("name", ["F", "O"], "status", "n")


@query("agg26", f"{BY_ENTITY}, c AS (SELECT entity, count(*) FILTER (category = '1-URGENT') AS c1, count(*) FILTER (category = '2-HIGH') AS c2, count(*) FILTER (category = '3-MEDIUM') AS c3, count(*) FILTER (category = '4-NOT SPECIFIED') AS c4, count(*) FILTER (category = '5-LOW') AS c5 FROM facts GROUP BY 1) SELECT row_number() OVER (ORDER BY n1 DESC, n2 DESC, n3 DESC, entity) AS position, entity, n1, n2, n3, total, c1, c2, c3, round(100 * total / sum(total) OVER (), 2) AS share, round(100 * n1 / sum(n1) OVER (), 2) AS first_share, round(100 * c1 / total, 1) AS c1_share, round(100 * c2 / total, 1) AS c2_share, round(100 * c3 / total, 1) AS c3_share, round(100 * n1 / total, 1) AS first_rate, points FROM t JOIN c USING (entity)")
def _(t):
    return A.standings(facts(t), PRIORITIES[:3])


@query("agg27", f"{BY_ENTITY}, s AS (SELECT total, total / sum(total) OVER () AS share, n1 / sum(n1) OVER () AS f, row_number() OVER (ORDER BY total DESC, entity) AS p FROM t) SELECT count(*) AS entities, CAST(sum(total) AS BIGINT) AS total, round(10000 * sum(share * share), 1) AS hhi, round(10000 * sum(f * f), 1) AS hhi_first, round(100 * sum(share) FILTER (p <= 1), 1) AS top1, round(100 * sum(share) FILTER (p <= 3), 1) AS top3, round(100 * sum(share) FILTER (p <= 5), 1) AS top5, round(100 * sum(share) FILTER (p <= 10), 1) AS top10 FROM s")
def _(t):
    return A.overall_concentration(facts(t))


@query("agg28", f"WITH {FACTS}, t AS (SELECT category, entity, count(*) AS n FROM facts GROUP BY 1, 2) SELECT category, entity, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, entity) AS place FROM t QUALIFY place <= 5")
def _(t):
    counts = facts(t).groupBy("category", "entity").agg(F.count("*").alias("n"))
    return W.first_per_group(counts, ["category"], [F.desc("n"), F.asc("entity")], 5)


@query("agg29", f"WITH {FACTS} SELECT unit, count(*) FILTER (category = '1-URGENT') AS urgent, count(*) AS total, round(100 * count(*) FILTER (category = '1-URGENT') / count(*), 2) AS percent FROM facts GROUP BY 1")
def _(t):
    g = facts(t).groupBy("unit").agg(F.count_if(F.col("category") == "1-URGENT").alias("urgent"), F.count("*").alias("total"))
    return g.withColumn("percent", F.round(100 * F.col("urgent") / F.col("total"), 2))


@query("agg30", f"WITH {FACTS} SELECT day, entity, {TIERS} FROM facts GROUP BY 1, 2")
def _(t):
    return A.tier_counts(facts(t), ["day", "entity"])


@query("agg31", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses, bool_and(o_totalprice > 10000) AS all_large, bool_or(o_orderstatus = 'P') AS any_part FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(
        F.count_distinct("o_orderstatus").alias("statuses"), F.bool_and(F.col("o_totalprice") > 10000).alias("all_large"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_part")
    )


@query("agg32", "SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(t):
    return A.duplicate_rows(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg33", "SELECT 'p_brand' AS \"column\", 'text' AS type, count(*) AS rows, count(*) - count(p_brand) AS nulls, round((count(*) - count(p_brand)) / count(*), 6) AS null_share, count(DISTINCT p_brand) AS \"distinct\", min(CAST(p_brand AS VARCHAR)) AS least, max(CAST(p_brand AS VARCHAR)) AS most, (SELECT string_agg(p || '=' || v, ',' ORDER BY p) FROM (SELECT min(p_partkey) AS p, CAST(p_brand AS VARCHAR) AS v FROM part GROUP BY 2 ORDER BY 1 LIMIT 5)) AS examples FROM part UNION ALL SELECT 'p_size' AS \"column\", 'integer' AS type, count(*) AS rows, count(*) - count(p_size) AS nulls, round((count(*) - count(p_size)) / count(*), 6) AS null_share, count(DISTINCT p_size) AS \"distinct\", min(CAST(p_size AS VARCHAR)) AS least, max(CAST(p_size AS VARCHAR)) AS most, (SELECT string_agg(p || '=' || v, ',' ORDER BY p) FROM (SELECT min(p_partkey) AS p, CAST(p_size AS VARCHAR) AS v FROM part GROUP BY 2 ORDER BY 1 LIMIT 5)) AS examples FROM part")
def _(t):
    found = A.profile(t("part"), ["p_brand", "p_size"], row_id="p_partkey")
    shown = F.array_join(F.transform("examples", lambda e: F.concat_ws("=", e["row"].cast("string"), e["value"])), ",")
    return found.select("column", "type", "rows", "nulls", "null_share", "distinct", "least", "most", shown.alias("examples"))


#: Values of every class, dealt over the customers.
CLASSED = ('1', '-0', '007', '1.', '.5', '007.5', '1.50', '2e5', '1,5', 'true', '2024-02-29', '2023-02-29', '2024-01-05T10:20', '2024-01-05 25:00', 'n/a', '99999999999999999999')


@query("agg34", "SELECT 'v' AS \"column\", count(*) FILTER (k IN (9)) AS n_boolean, count(*) FILTER (k IN (0,1)) AS n_integer, count(*) FILTER (k IN (6,7)) AS n_decimal, count(*) FILTER (k IN (10)) AS n_date, count(*) FILTER (k IN (12)) AS n_datetime, count(*) FILTER (k IN (2,3,4,5,8,11,13,14,15)) AS n_text, 'mixed' AS type, 'DECIMAL_COMMA,LEADING_ZERO,NO_SUCH_DAY,NULL_WORD,TOO_LARGE' AS hints FROM (SELECT c_custkey % 16 AS k FROM customer)")
def _(t):
    value = F.element_at(F.array(*map(F.lit, CLASSED)), (F.col("c_custkey") % 16 + 1).cast("int"))
    found = A.profile(t("customer").select(value.alias("v")), ["v"])
    return found.select("column", *[f"n_{k}" for k in A.CLASSES[:-1]], "type", F.array_join("hints", ",").alias("hints"))


@query("agg35", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def _(t):
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


#: Figures of the orders and what they must be.
ACCEPTED = {
        "rows": ("count(*)", "count(*)"),
        "distinct_keys": ("count(DISTINCT o_orderkey)", "count(*)"),
        "null_keys": ("count(*) - count(o_orderkey)", "0"),
        "null_customers": ("count(*) - count(o_custkey)", "0"),
        "statuses": ("count(DISTINCT o_orderstatus)", "3"),
        "priorities": ("count(DISTINCT o_orderpriority)", "5"),
        "parts_of_statuses": ("count_if(o_orderstatus = 'F') + count_if(o_orderstatus = 'O') + count_if(o_orderstatus = 'P')", "count(*)"),
        "negative_prices": ("count_if(o_totalprice < 0)", "0"),
        "null_prices": ("count(*) - count(o_totalprice)", "0"),
        "null_dates": ("count(*) - count(o_orderdate)", "0"),
        "urgent": ("count_if(o_orderpriority = '1-URGENT')", "count(*) - count_if(o_orderpriority <> '1-URGENT')"),
        "finished": ("count_if(o_orderstatus = 'F')", "count_if(o_orderstatus IN ('F'))"),
        "before_1990": ("count_if(year(o_orderdate) < 1990)", "0"),
        "after_2000": ("count_if(year(o_orderdate) > 2000)", "0"),
        "mean_price": ("avg(o_totalprice)", "sum(o_totalprice) / count(*)"),
        "wrong_on_purpose": ("count(*)", "count(*) + 1"),
}


@query("agg36", "SELECT name, round(CAST(found AS DOUBLE), 4) AS found, round(CAST(expected AS DOUBLE), 4) AS expected, abs(found - expected) <= 1e-9 * greatest(1, abs(expected)) AS passed FROM (SELECT 'rows' AS name, count(*) AS found, count(*) AS expected FROM orders UNION ALL SELECT 'distinct_keys' AS name, count(DISTINCT o_orderkey) AS found, count(*) AS expected FROM orders UNION ALL SELECT 'null_keys' AS name, count(*) - count(o_orderkey) AS found, 0 AS expected FROM orders UNION ALL SELECT 'null_customers' AS name, count(*) - count(o_custkey) AS found, 0 AS expected FROM orders UNION ALL SELECT 'statuses' AS name, count(DISTINCT o_orderstatus) AS found, 3 AS expected FROM orders UNION ALL SELECT 'priorities' AS name, count(DISTINCT o_orderpriority) AS found, 5 AS expected FROM orders UNION ALL SELECT 'parts_of_statuses' AS name, count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderstatus = 'P') AS found, count(*) AS expected FROM orders UNION ALL SELECT 'negative_prices' AS name, count(*) FILTER (o_totalprice < 0) AS found, 0 AS expected FROM orders UNION ALL SELECT 'null_prices' AS name, count(*) - count(o_totalprice) AS found, 0 AS expected FROM orders UNION ALL SELECT 'null_dates' AS name, count(*) - count(o_orderdate) AS found, 0 AS expected FROM orders UNION ALL SELECT 'urgent' AS name, count(*) FILTER (o_orderpriority = '1-URGENT') AS found, count(*) - count(*) FILTER (o_orderpriority <> '1-URGENT') AS expected FROM orders UNION ALL SELECT 'finished' AS name, count(*) FILTER (o_orderstatus = 'F') AS found, count(*) FILTER (o_orderstatus IN ('F')) AS expected FROM orders UNION ALL SELECT 'before_1990' AS name, count(*) FILTER (year(o_orderdate) < 1990) AS found, 0 AS expected FROM orders UNION ALL SELECT 'after_2000' AS name, count(*) FILTER (year(o_orderdate) > 2000) AS found, 0 AS expected FROM orders UNION ALL SELECT 'mean_price' AS name, avg(o_totalprice) AS found, sum(o_totalprice) / count(*) AS expected FROM orders UNION ALL SELECT 'wrong_on_purpose' AS name, count(*) AS found, count(*) + 1 AS expected FROM orders)")
def _(t):
    checks = {name: (F.expr(found), F.expr(expected)) for name, (found, expected) in ACCEPTED.items()}
    return A.checked(t("orders"), checks).withColumns({c: F.round(c, 4) for c in ("found", "expected")})


@query("agg37", "SELECT 'priority' AS name, count(priority) AS filled, count(*) AS rows FROM " + NULLED)
def _(t):
    return nulled(t).agg(F.count("priority").alias("filled"), F.count("*").alias("rows")).select(F.lit("priority").alias("name"), "filled", "rows")


@query("agg38", "WITH q AS (SELECT l_orderkey AS k, l_returnflag AS r, count(*) AS n FROM lineitem WHERE l_quantity > 48 AND l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT k, sum(n) AS o, string_agg(r || '=' || n, ',' ORDER BY r) AS reasons FROM q GROUP BY 1) SELECT o_orderkey AS run, CAST(coalesce(o, 0) AS BIGINT) AS open_rows, reasons, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'running' WHEN o_orderstatus = 'P' THEN 'failed' WHEN coalesce(o, 0) > 0 THEN 'succeeded_with_quarantine' WHEN o_custkey % 3 = 0 THEN 'unchanged' ELSE 'succeeded' END AS outcome FROM orders LEFT JOIN b ON k = o_orderkey")
def _(t):
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "running").when(F.col("o_orderstatus") == "P", "aborted").otherwise("success")
    runs = t("orders").select(F.col("o_orderkey").alias("run"), status.alias("status"), (F.col("o_custkey") % 3).alias("changed"))
    rows = t("lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("why"), (F.col("l_linestatus") != "O").alias("done"))
    found = V.run_summary(runs, rows, "run", "why", F.col("done"))
    shown = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("run", "open_rows", shown.alias("reasons"), "outcome")


@query("agg39", "SELECT DISTINCT source FROM documents")
def _(t):
    return t("documents").select("source").distinct()


@query("agg40", "SELECT count(*) AS rows, count(*) - count(priority) AS missing FROM " + NULLED)
def _(t):
    return nulled(t).agg(F.count("*").alias("rows"), F.count_if(F.col("priority").isNull()).alias("missing"))


@query("agg42", f"WITH {FACTS}, e AS (SELECT entity, event, count(*) AS n FROM facts GROUP BY 1, 2) SELECT entity, count(*) AS sweeps FROM e WHERE n >= 3 GROUP BY 1 ORDER BY sweeps DESC, entity LIMIT 10")
def _(t):
    e = facts(t).groupBy("entity", "event").agg(F.count("*").alias("n")).filter("n >= 3")
    return e.groupBy("entity").agg(F.count("*").alias("sweeps")).orderBy(F.desc("sweeps"), "entity").limit(10)


@query("agg43", "SELECT CASE WHEN count(*) = 0 THEN 'not_run' WHEN bool_and(x = y) THEN 'match' ELSE 'mismatch' END AS status FROM (SELECT s_nationkey k, count(*) x FROM supplier GROUP BY 1) JOIN (SELECT s_nationkey k, count(s_name) y FROM supplier GROUP BY 1) USING (k)")
def _(t):
    g = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("x"), F.count("s_name").alias("y"))
    return g.agg(F.when(F.count("*") == 0, "not_run").when(F.bool_and(F.col("x") == F.col("y")), "match").otherwise("mismatch").alias("status"))


# ---- windows ----


@query("win01", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey DESC) AS place FROM supplier")
def _(t):
    return O.competition_ranks(t("supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"]).drop("s_nationkey")


@query("win03", "SELECT p_brand, n, place FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)) WHERE place <= 5")
def _(t):
    return W.top_with_ties(t("part").groupBy("p_brand").agg(F.count("*").alias("n")), "n", 5)


@query("win04", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 6).alias("share"))


@query("win05", f"WITH {FACTS}, d AS (SELECT tier, day, count(*) AS n FROM facts GROUP BY 1, 2) SELECT tier, day, n, CAST(sum(n) OVER (PARTITION BY tier ORDER BY day) AS BIGINT) AS running FROM d")
def _(t):
    return W.running_total(facts(t).groupBy("tier", "day").agg(F.count("*").alias("n")), ["tier"], "day", "n")


@query("win06", "WITH m AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate)::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2), grid AS (SELECT g, day FROM (SELECT DISTINCT g FROM m), (SELECT DISTINCT day FROM m)) SELECT g, day, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g ORDER BY day) AS BIGINT) AS running FROM grid LEFT JOIN m USING (g, day)")
def _(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("g"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).agg(F.count("*").alias("n"))
    return W.dense_timeline(m, "g", "day", "n")


@query("win07", f"{BY_CELL}, b AS (SELECT *, coalesce(CAST(sum(points) OVER (PARTITION BY entity ORDER BY points DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before, sum(points) OVER (PARTITION BY entity) AS a, (total / sum(total) OVER (PARTITION BY entity)) / (sum(total) OVER (PARTITION BY unit) / sum(total) OVER ()) AS rca FROM t), u AS (SELECT unit, count(DISTINCT event) AS unit_events FROM facts GROUP BY 1) SELECT entity, unit, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(total, 0) AS total, coalesce(points, 0) AS points, round(coalesce(points / a, 0), 6) AS points_share, round((before + points) / a, 6) AS cumulative_share, CASE WHEN total IS NULL THEN 'No results' WHEN before * 100 < 60 * a THEN 'Core' WHEN before * 100 < 90 * a THEN 'Secondary' ELSE 'Tail' END AS tier_name, coalesce(total >= 3 AND rca >= 1.5, false) AS specialised, coalesce(total >= 3 AND n1 / total >= 0.5, false) AS first_heavy, unit_events FROM (SELECT DISTINCT entity FROM facts) CROSS JOIN u LEFT JOIN b USING (entity, unit)")
def _(t):
    return A.strength_tiers(event_facts(t)).withColumns({c: F.round(c, 6) for c in ("points_share", "cumulative_share")})


@query("win08", "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 2")
def _(t):
    return W.first_per_group(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 2)


@query("win09", "WITH m AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) SELECT y, p, n, rank() OVER (PARTITION BY y ORDER BY n DESC) AS place FROM m")
def _(t):
    m = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return m.withColumn("place", W.competition_rank(["n"], ["y"]))


@query("win10", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r FROM part")
def _(t):
    return O.average_ranks(t("part").select("p_partkey", "p_size"), "p_size", "r").drop("p_size")


@query("win11", "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3), z AS (SELECT k, i, p, row_number() OVER (PARTITION BY k ORDER BY i, p) AS slot FROM l) SELECT k, i, p, CAST(slot AS BIGINT) AS slot FROM z")
def _(t):
    lines = t("lineitem")
    rows = lines.repartition(pieces(lines, 2), "l_orderkey").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p")).agg(F.min("l_quantity").alias("q"))
    rows = rows.select("k", "i", "p", F.row_number().over(Window.partitionBy("k").orderBy("i", "p")).cast("long").alias("n"))
    rows = rows.withColumn("slot", F.when(F.col("n") % 2 == 1, F.col("n"))).drop("n")
    return W.fill_slots(rows, ["k"], "slot", [F.asc("i"), F.asc("p")])


@query("win12", "SELECT o_orderkey, CASE WHEN o_orderkey > m THEN m END AS duplicate_of FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) AS m FROM orders)")
def _(t):
    return W.mark_duplicates(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey").select("o_orderkey", "duplicate_of")


@query("win13", "WITH l AS (SELECT *, max(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS s FROM events) SELECT user_id, count(*) FILTER (event_type = 'click' AND (s IS NULL OR event_id > s)) AS failures FROM l GROUP BY 1")
def _(t):
    return W.failures_since_success(t("events"), "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase")


@query("win14", "SELECT user_id, max(ts) AS last_run, max(ts) FILTER (event_type = 'purchase') AS last_success FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.max("ts").alias("last_run"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_success"))


@query("win15", f"SELECT page_id, host FROM (SELECT page_id, {HOST} AS host, row_number() OVER (PARTITION BY {HOST} ORDER BY length(html) DESC, page_id) AS k, length(html) AS s FROM pages) WHERE k <= 2 ORDER BY s DESC, page_id LIMIT 20")
def _(t):
    p = t("pages").select("page_id", S.host(F.col("url")).alias("host"), F.length("html").alias("s"))
    return W.capped_per_group(p, "host", [F.desc("s"), F.asc("page_id")], 2, 20).select("page_id", "host")


# ---- sorts and sets ----


@query("srt04", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("srt02", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS v, row_number() OVER (ORDER BY round(sum(c_acctbal), 2) DESC NULLS LAST, c_mktsegment) AS place FROM customer GROUP BY 1")
def _(t):
    g = t("customer").groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "c_mktsegment")))


@query("srt07", "SELECT l_returnflag, count(*) AS n, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM lineitem GROUP BY 1")
def _(t):
    place = F.array_position(F.array(F.lit("R"), F.lit("A"), F.lit("N")), F.col("l_returnflag")).cast("int")
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("place", place)


@query("set01", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def _(t):
    return t("supplier").select(F.col("s_nationkey").alias("k")).union(t("customer").select("c_nationkey")).distinct()


@query("set02", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t("nation").select(F.col("n_nationkey").alias("k")).subtract(t("supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("set03", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def _(t):
    return t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).intersect(t("customer").filter("c_acctbal < 0").select("c_nationkey"))


@query("set04", "SELECT c_custkey AS k, c_name AS name, NULL AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra")), allowMissingColumns=True)


# ---- scalars ----


@query("str01", "SELECT item_id, nullif(trim(text), '') AS text FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", S.squeezed(F.col("text")).alias("text"))


@query("str03", "SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: x NOT IN ('a','an','and','by','for','in','is','of','on','or','the','to','with')))) AS words FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_sort(S.terms(F.col("p_type"))).alias("words"))


@query("str05", "SELECT conv_id, turn, len(regexp_extract_all(text || ' Twenty-one, ½ and 3.5', '[0-9]+(?:[.,][0-9]+)*')) + 3 + len(regexp_extract_all(lower(text), '\\\\b(one|two|three|first|second|half)\\\\b')) AS n FROM conversations WHERE NOT regexp_matches(lower(text), '\\\\b(zero|four|five|six|seven|eight|nine|ten|third|double|million|hundred|thousand|dozen|twice)')")
def _(t):
    rows = t("conversations").filter(r"not lower(text) rlike '\\b(zero|four|five|six|seven|eight|nine|ten|third|double|million|hundred|thousand|dozen|twice)'")
    return rows.select("conv_id", "turn", F.size(S.number_tokens(F.concat("text", F.lit(" Twenty-one, ½ and 3.5")))).cast("long").alias("n"))


@query("str06", "SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 9) || '…' ELSE p_name END AS name FROM part")
def _(t):
    return t("part").select("p_partkey", S.shown(F.col("p_name"), 10).alias("name"))


@query("str07", "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM part")
def _(t):
    return t("part").select("p_partkey", S.file_name(F.col("p_type")).alias("name"))


@query("str08", "SELECT c_custkey, lower(regexp_replace(trim(c_name), '\\s+', ' ', 'g')) AS name FROM customer")
def _(t):
    return t("customer").select("c_custkey", S.loose_value(F.col("c_name")).alias("name"))


@query("str09", "SELECT min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS mean_length FROM documents")
def _(t):
    return A.text_lengths(t("documents"), "text").select(F.col("min_length").cast("long"), F.col("max_length").cast("long"), r("mean_length"))


@query("str10", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) || '-' || split_part(o_orderpriority, '-', 2) AS code FROM orders")
def _(t):
    return t("orders").select("o_orderkey", S.code_prefix(F.col("o_orderpriority")).alias("code"))


@query("str11", f"SELECT page_id, {HOST} AS host, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'BAD_SCHEME' WHEN 2 THEN 'CREDENTIALS' ELSE 'BAD_PORT' END AS reason, CASE WHEN page_id % 4 = 0 THEN regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) END AS checked_host, page_id % 4 <> 1 AS related FROM pages WHERE url IS NOT NULL")
def _(t):
    name, path = F.regexp_extract("url", "^[A-Za-z]+://([^/:?#]+)", 1), F.regexp_replace("url", "^[A-Za-z]+://[^/?#]+", "")
    k = F.col("page_id") % 4
    url = F.concat(F.when(k == 1, "http://").otherwise("HTTPS://"), F.when(k == 2, "me:pass@").otherwise(""), name, F.when(k == 3, ":8443").otherwise(""), path, F.lit("#part"))
    found, plain = S.checked_url(url), S.host(F.col("url"))
    other = F.when(k == 1, F.concat(F.lit("not"), plain)).when(k == 2, F.concat(F.lit("www."), plain)).otherwise(F.concat(F.lit("a."), plain))
    return t("pages").filter("url is not null").select("page_id", plain.alias("host"), found["reason"].alias("reason"), found["host"].alias("checked_host"), S.related_host(plain, other).alias("related"))


@query("num01", "SELECT c_custkey, c_custkey % 4 = 0 OR c_custkey % 4 = 1 AS ok, CASE c_custkey % 4 WHEN 0 THEN 1234567.5 WHEN 1 THEN c_custkey END AS value, CASE c_custkey % 4 WHEN 2 THEN 'WRONG_SEPARATORS' WHEN 3 THEN 'NOT_A_NUMBER' END AS reason, coalesce(c_custkey % 4 = 1, false) AS is_integer FROM customer")
def _(t):
    k = F.col("c_custkey") % 4
    p = S.parsed_number(F.when(k == 0, "1.234.567,5").when(k == 1, F.col("c_custkey").cast("string")).when(k == 2, "12.34,5").otherwise("1e5"), ".", ",")
    return t("customer").select("c_custkey", p["reason"].isNull().alias("ok"), p["value"].alias("value"), p["reason"].alias("reason"), p["is_integer"].alias("is_integer"))


@query("num03", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS q FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(S.divided(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("q"))


@query("num05", "SELECT p_partkey, CASE WHEN p_size = 1 THEN '1' ELSE CAST(p_size AS VARCHAR) END AS t FROM part")
def _(t):
    return t("part").select("p_partkey", S.float15(F.col("p_size")).alias("t"))


@query("dat01", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(t):
    return t("orders").select("o_orderkey", S.parsed_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "%d/%m/%Y").alias("day"))


@query("dat02", "SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(S.period_label(F.col("o_orderdate"), "quarter").alias("period")).agg(F.count("*").alias("n"))


@query("dat05", "SELECT count(*) FILTER (ts = date_trunc('day', ts)) AS midnight, count(*) AS n FROM events")
def _(t):
    return t("events").agg(F.count_if(S.is_midnight(F.col("ts"))).alias("midnight"), F.count("*").alias("n"))


@query("dat07", "WITH m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'pruned' WHEN o_orderkey % 7 = 0 THEN 'upload' WHEN o_orderkey % 3 <> 0 AND o_orderdate + INTERVAL 400 DAY <= now THEN 'expired' WHEN now - o_orderdate > INTERVAL 30 DAY THEN 'stale' ELSE 'current' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN 'never_succeeded' WHEN o_orderstatus = 'P' THEN 'failing' WHEN now - o_orderdate > INTERVAL 600 DAY THEN 'stale' ELSE 'fresh' END AS freshness FROM orders, m")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    k, at, now = F.col("o_orderkey"), F.col("o_orderdate"), F.col("now")
    until, pruned = F.when(k % 3 != 0, at + F.expr("interval 400 days")), F.when(k % 11 == 0, at)
    state = V.source_state(F.when(k % 7 == 0, "upload").otherwise("web"), at, until, pruned, now)
    fresh = V.freshness(F.when(k % 5 != 0, at), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success"), now, 600 * 24 * 60)
    return o.crossJoin(o.agg(F.max("o_orderdate").alias("now"))).select("o_orderkey", state.alias("state"), fresh.alias("freshness"))  # one row


@query("jsn01", "SELECT event_id, props ->> '$.k' AS k FROM events")
def _(t):
    return t("events").select("event_id", S.json_at(F.col("props"), "/k").alias("k"))


@query("hsh01", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# ---- statistics ----


@query("stt01", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, round(median(p_retailprice), 4) AS p50 FROM part GROUP BY 1")
def _(t):
    found = O.quantiles(t("part"), "p_retailprice", (0.9, 0.5), ["p_brand"])
    return found.select("p_brand", F.round(F.col("q")[0], 4).alias("p90"), F.round(F.col("q")[1], 4).alias("p50"))


@query("stt02", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS std FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy("p_brand").agg(F.round(F.stddev_samp("p_retailprice"), 4).alias("std"))


@query("stt03", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(M.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("stt04", "WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM k")
def _(t):
    return M.spearman(t("part"), "p_size", "p_retailprice").select(r("rho"), "n")


@query("stt05", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def _(t):
    return M.correlation_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("x", "y", r("r"), "n")


@query("stt06", "WITH q AS (SELECT count(p_retailprice) AS n, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part) SELECT n, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high FROM q")
def _(t):
    return M.fences(t("part"), "p_retailprice").select("n", r("low", 4), r("high", 4))


@query("stt12", "WITH m AS (SELECT (l_quantity > 25) AS y, (l_extendedprice > 30000) AS p, l_extendedprice AS s FROM lineitem), c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM m), s AS (SELECT *, tp / (tp + fp) AS p1, tn / (tn + fn) AS p0, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0 FROM c), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM m), a AS (SELECT (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM k), e AS (SELECT l_quantity - l_extendedprice / 1500 AS e, l_quantity AS y FROM lineitem) SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((p1 + p0) / 2, 6) AS \"precision\", round((r1 + r0) / 2, 6) AS recall, round((2 * p1 * r1 / (p1 + r1) + 2 * p0 * r0 / (p0 + r0)) / 2, 6) AS f1, round((SELECT auc FROM a), 6) AS auc, round((SELECT sqrt(avg(e * e)) FROM e), 6) AS rmse, round((SELECT avg(abs(e)) FROM e), 6) AS mae, round((SELECT 1 - avg(e * e) / var_pop(y) FROM e), 6) AS r2 FROM s")
def _(t):
    lines = t("lineitem").select((F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_extendedprice") > 30000).cast("int").alias("p"), F.col("l_extendedprice").alias("s"), "l_quantity", (F.col("l_extendedprice") / 1500).alias("guess"))
    scores = M.classification_scores(lines, "y", "p").crossJoin(M.auc(lines, "y", "s")).crossJoin(M.regression_scores(lines, "l_quantity", "guess"))  # one row each
    return scores.select(*[r(c) for c in scores.columns])


# ---- cleaning ----


@query("cln01", "SELECT o_orderkey AS row_id, o_totalprice AS price, o_custkey AS buyer, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    raw = t("orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.format_string(" %d ", F.col("o_custkey").cast("long")).alias("buyer"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.lit(" ").alias("nothing"),
    )
    plan = C.CleanPlan(trim=("price", "buyer", "day", "nothing"), drop_empty=("nothing",), numbers={"price": ("", "."), "buyer": ("", ".")}, dates={"day": "%d/%m/%Y"}, max_reject_share=0.5)
    return C.clean(raw, plan)[0]


@query("cln02", "SELECT o_orderkey AS row_id, 'parse_number' AS operation, 'price' AS \"column\", 'n/a' AS original_value, 'NOT_A_NUMBER' AS reason FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    raw = t("orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return C.clean(raw, C.CleanPlan(numbers={"price": ("", ".")}))[1]


@query("cln03", "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY 2, 3")
def _(t):
    return C.remove_duplicates(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("cln04", "WITH o AS " + NULLED + ", m AS (SELECT priority AS v FROM o WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1), p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders) SELECT o_orderkey, coalesce(priority, (SELECT v FROM m)) AS priority, round(coalesce(price, (SELECT median(price) FROM p)), 4) AS by_median, round(coalesce(price, (SELECT avg(price) FROM p)), 4) AS by_mean, coalesce(price, -1) AS by_constant FROM o JOIN p USING (o_orderkey)")
def _(t):
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    rows = nulled(t).select("o_orderkey", "priority", *[price.alias(f"by_{m}") for m in ("median", "mean", "constant")])
    out = C.fill_missing(rows, "priority", "mode")
    for method in ("median", "mean", "constant"):
        out = C.fill_missing(out, f"by_{method}", method, -1.0)
    return out.withColumns({c: F.round(c, 4) for c in ("by_median", "by_mean")})


@query("cln05", "SELECT c_custkey, c_acctbal AS v FROM customer")
def _(t):
    return C.text_to_number(t("customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("v")), "v")


@query("cln06", "WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part) SELECT p_partkey, NOT p_retailprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) AS is_outlier, p_retailprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) AS kept FROM part, q")
def _(t):
    flagged = M.flag_outliers(t("part"), "p_retailprice", 0.5).select("p_partkey", "is_outlier")
    kept = M.remove_outliers(t("part"), "p_retailprice", 0.5).select("p_partkey", F.lit(True).alias("kept"))
    return flagged.join(kept, "p_partkey", "left").na.fill(False, ["kept"])


# ---- versioned state ----


@query("sta01", "WITH c AS (SELECT user_id, event_type, event_id % 3 = 0 AS detail, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS day, ts, event_id FROM events), l AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS b, lag(detail) OVER w AS bd FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CASE WHEN n = 1 OR event_type IS DISTINCT FROM b OR detail IS DISTINCT FROM bd THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stay FROM l), d AS (SELECT *, row_number() OVER w = 1 AS opens, last_value(day IGNORE NULLS) OVER (PARTITION BY user_id, stay ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, first_value(day IGNORE NULLS) OVER (PARTITION BY user_id, stay ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ever FROM i WINDOW w AS (PARTITION BY user_id, stay ORDER BY ts, event_id)), v AS (SELECT * FROM d WHERE opens OR day <> known) SELECT user_id, event_type, detail, CASE WHEN opens THEN ever ELSE day END AS day, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current, CASE WHEN n = 1 THEN 'created' WHEN opens AND event_type IS DISTINCT FROM b THEN 'reallocated' ELSE 'corrected' END AS action FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    day = F.when(F.col("event_id") % 4 != 0, F.to_date("ts"))
    claims = t("events").select("user_id", "event_type", (F.col("event_id") % 3 == 0).alias("detail"), day.alias("day"), "ts", "event_id")
    return V.validity(claims, ["user_id"], ["ts", "event_id"], "event_type", "ts", "detail", "day")


@query("sta02", "WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT *, min(n) OVER (PARTITION BY user_id, event_type) AS m FROM n) SELECT event_id, CASE WHEN event_type = b THEN 'unchanged' WHEN n = m THEN 'new_version' ELSE 'reverted' END AS outcome, CAST(sum(CASE WHEN n = m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS versions FROM f")
def _(t):
    return V.raw_versions(t("events"), "user_id", ["event_id"], "event_type").select("event_id", "outcome", F.col("versions").cast("long"))


@query("sta03", "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(c_name, s_name) AS name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def _(t):
    state = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return V.upsert_named(state, t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k", "name")


@query("sta04", "SELECT l_orderkey, l_linenumber, CASE WHEN NOT dis AND op AND oth THEN true WHEN NOT dis OR NOT acc THEN true WHEN off THEN true ELSE false END AS applies, CASE WHEN NOT dis AND op AND oth THEN 'AGREEMENT' WHEN NOT dis OR NOT acc THEN NULL WHEN off AND op THEN 'OFFICIAL_STILL_DISAGREES' WHEN off THEN 'OFFICIAL_FRESH' WHEN od AND fr THEN 'OFFICIAL_FRESH' WHEN od THEN 'OFFICIAL_STALE' ELSE 'NON_OFFICIAL' END AS rule, CASE WHEN NOT dis AND op AND oth THEN 'resolved' WHEN NOT dis OR NOT acc THEN NULL WHEN off AND op THEN 'needs_review' WHEN off OR (od AND fr) THEN 'auto_resolved' ELSE 'needs_review' END AS status, coalesce(dis AND acc AND NOT off AND od AND NOT fr, false) AS refetch FROM (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS off, l_quantity > 10 AS dis, l_discount > 0.01 AS acc, l_linestatus = 'O' AS op, l_tax > 0.01 AS oth, l_quantity > 25 AS od, l_discount > 0.05 AS fr FROM lineitem)")
def _(t):
    c = F.col
    answer = V.decide(c("l_returnflag") == "A", c("l_quantity") > 10, c("l_discount") > 0.01, c("l_linestatus") == "O", c("l_tax") > 0.01, c("l_quantity") > 25, c("l_discount") > 0.05)
    return t("lineitem").select("l_orderkey", "l_linenumber", answer.alias("a")).select("l_orderkey", "l_linenumber", "a.*")


@query("sta05", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'closed' WHEN o_orderpriority = '1-URGENT' THEN 'accepted' ELSE 'open' END AS status, o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AS is_disputed FROM orders")
def _(t):
    conflicts = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    decisions = t("orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("accepted").alias("status"), F.lit("seen").alias("note"), F.lit("ann").alias("resolved_by"), F.col("o_orderdate").alias("at"))
    return V.resolve(conflicts, decisions, "o_orderkey").select("o_orderkey", "status", "is_disputed")


@query("sta07", "SELECT o_orderkey, 'new' AS part FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 150000 UNION ALL SELECT o_orderkey, 'resolved' FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice < 20000")
def _(t):
    o = t("orders")
    failing = o.filter("o_orderstatus = 'P'").select("o_orderkey")
    held = o.filter("(o_orderstatus = 'P' and o_totalprice < 150000) or (o_orderstatus <> 'P' and o_totalprice < 20000)").select("o_orderkey")
    new, resolved = V.quarantine(held, failing, ["o_orderkey"])
    return new.withColumn("part", F.lit("new")).unionByName(resolved.withColumn("part", F.lit("resolved")))


@query("sta08", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS taken, count(*) % 3 AS n FROM events GROUP BY 1, 2), p AS (SELECT *, CAST(taken + INTERVAL 5 HOUR AS DATE) AS day FROM h), m AS (SELECT *, n IS DISTINCT FROM lag(n) OVER (PARTITION BY event_type ORDER BY taken) AS moved, row_number() OVER (PARTITION BY event_type, day ORDER BY taken) = 1 AS f FROM p) SELECT event_type, taken, day, 'change' AS kind FROM m WHERE moved UNION ALL SELECT event_type, taken, day, 'daily' FROM m WHERE f")
def _(t):
    hours = t("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("taken")).agg((F.count("*") % 3).alias("n"))
    prints = hours.select("event_type", F.col("taken").cast("timestamp_ntz").alias("taken"), F.sha2(F.col("n").cast("string"), 256).alias("fingerprint"))
    return V.taken_snapshots(prints, ["event_type"], "taken", "+05:00").select("event_type", "taken", "day", "kind")


@query("sta11", "SELECT c_custkey, 'new' AS notice FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'resolved' FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'")
def _(t):
    c = t("customer")
    return V.alerts(c.filter("c_acctbal < 0").select("c_custkey"), c.filter("c_mktsegment = 'BUILDING'").select("c_custkey"), ["c_custkey"])


@query("sta13", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE < DATE '1995-06-01' THEN 'pruned' WHEN o_orderkey % 9 = 0 THEN 'changed' ELSE 'ok' END AS status, o_orderdate::DATE < DATE '1995-06-01' AS tombstone FROM orders")
def _(t):
    text = F.col("o_orderkey").cast("string")
    stored = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("until"), text.alias("content"), F.sha2(F.when(F.col("o_orderkey") % 9 == 0, F.concat(text, F.lit("x"))).otherwise(text), 256).alias("digest"))
    kept, gone = V.pruned(stored, "until", "content", datetime.date(1995, 6, 1))
    checked = V.rehashed(kept, "content", "digest").select("o_orderkey", "status", F.lit(False).alias("tombstone"))
    return checked.unionByName(gone.select("o_orderkey", F.lit("pruned").alias("status"), F.lit(True).alias("tombstone")))


@query("sta14", "SELECT user_id, event_type AS status, n FROM (SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


@query("sta15", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'not_found' WHEN 1 THEN 'verified' ELSE 'differs' END AS status FROM events WHERE props ->> '$.k' IS NOT NULL")
def _(t):
    k = S.json_at(F.col("props"), "/k").try_cast("int")
    pointer = F.when(F.col("event_id") % 3 == 0, "/absent").otherwise("/k")
    claimed = F.when(F.col("event_id") % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise((k + 1).cast("string"))
    return t("events").filter(k.isNotNull()).select("event_id", V.verified(F.col("props"), pointer, claimed).alias("status"))


# ---- planner ----


@query("pln01", "SELECT 'request' AS kind, p_brand, count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS p_size_sum, NULL AS said FROM part GROUP BY p_brand UNION ALL SELECT * FROM (VALUES ('chart', NULL, NULL, NULL, 'line'), ('clarification', NULL, NULL, NULL, 'p_brand'), ('refusal', NULL, NULL, NULL, 'Tables are only read.')) AS v")
def _(t):
    from quillon.plans import requests

    part = t("part")
    first = requests.plan("Sum p size by p brand", part)
    table = requests.run(part, first.request).select(F.lit(first.kind).alias("kind"), "p_brand", "rows", "p_size_sum", F.lit(None).cast("string").alias("said"))
    others = [requests.plan("Make it a line chart", part, first.request), requests.plan("sum p size by brand", part), requests.plan("drop everything", part)]
    said = [(p.kind, p.chart or ",".join(p.choices) or p.question) for p in others]
    answers = part.sparkSession.createDataFrame(said, "kind string, said string")
    return table.unionByName(answers.select("kind", F.lit(None).cast("string").alias("p_brand"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("p_size_sum"), "said"))


@query("pln07", f"{BY_CELL}, e AS (SELECT entity, count(DISTINCT unit) AS units FROM facts WHERE tier IN ('A','N','R') GROUP BY 1) SELECT unnest(['entity totals','cell totals','category totals','entity tiers','entity points','cell tiers','cell points','shares','categories','hhi']) AS rule, unnest([0, 0, 0, 0, 0, 0, 0, 0, (SELECT count(DISTINCT entity || '|' || unit) FROM facts WHERE category = '5-LOW'), 0]) AS broken FROM (SELECT count(*) FROM t)")
def _(t):
    return A.violations(facts(t), PRIORITIES[:4])  # one category is left out on purpose


def queries() -> dict[str, Query]:
    from quillon.plans import catalogue_rules, catalogue_stores  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
