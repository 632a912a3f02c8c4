"""Registered queries of stores, formats, models and requests; each next to the same in SQL where SQL can say it."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import cleaning as C
from quillon.operators import stats as M
from quillon.operators import versioned as V
from quillon.plans import requests
from quillon.plans.catalogue import PRIORITIES, query, stream_query
from quillon.sources import readers as R
from quillon.sources import writers as O
from quillon.sources.store import Store
from quillon.streaming import state as T

NATIONS = "SELECT CAST(n_nationkey + 1 AS BIGINT) AS row_id, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"
REGION_CSV = "'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey)"


def rows(df: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(values, schema)


# ---- sources ----


@query("src03", NATIONS)
def _(t):
    nation = t("nation").orderBy("n_nationkey")
    store = Store(nation.sparkSession)
    store.put("nation.xlsx", O.xlsx_bytes(nation))
    return R.read_xlsx(nation.sparkSession, store.path("nation.xlsx"))


@query("src04", NATIONS)
def _(t):
    nation = t("nation").orderBy("n_nationkey")
    store = Store(nation.sparkSession)
    store.put("nation.json", json.dumps([r.asDict() for r in nation.collect()]).encode())  # 25 rows
    return R.read_json(nation.sparkSession, store.path("nation.json"))


@query("src07", "SELECT * FROM (VALUES ('plain', true), ('nested', false), ('macro', false), ('bomb', false), ('many', false)) AS v(archive, allowed)")
def _(t):
    def packed(files: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, data in files.items():
                archive.writestr(name, data)
        return out.getvalue()

    def allowed(data: bytes) -> bool:
        try:
            R.check_archive(data, members=10)
        except R.Refused:
            return False
        return True

    made = {"plain": {"a.xml": b"<a/>"}, "nested": {"b.zip": b"PK"}, "macro": {"xl/vbaProject.bin": b"x"}, "bomb": {"c.xml": bytes(10**6)}, "many": {f"{k}.xml": b"" for k in range(11)}}
    return rows(t("region"), [(k, allowed(packed(v))) for k, v in made.items()], "archive string, allowed boolean")


@query("src10", "SELECT CASE WHEN count(*) <= 10000 THEN 'whole' ELSE 'sample' END AS mode, CASE WHEN count(*) <= 10000 THEN count(*) ELSE 1000 END AS n FROM orders")
def _(t):
    found, mode = R.open_within(t("orders").select("o_orderkey"), "o_orderkey", 10_000, 50_000_000_000, 1000)
    return found.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))


def region_pages(t) -> DataFrame:
    """A page for each region: one table, two for odd ones."""
    line = F.format_string("<tr><td>%d</td><td>%s</td></tr>", "n_nationkey", "n_name")
    body = F.concat(F.lit("<table><tr><th>id</th><th>name</th></tr>"), F.array_join(F.sort_array(F.collect_list(line)), ""), F.lit("</table>"))
    return t("nation").groupBy("n_regionkey").agg(body.alias("html")).withColumn("html", F.when(F.col("n_regionkey") % 2 == 0, F.col("html")).otherwise(F.repeat("html", 2)))


@query("src12", "SELECT n_regionkey AS page, CASE WHEN n_regionkey % 2 = 0 THEN CAST(0 AS INTEGER) END AS table_index, CASE WHEN n_regionkey % 2 = 0 THEN CAST(count(*) + 1 AS INTEGER) END AS n_rows, CASE WHEN n_regionkey % 2 = 1 THEN 'AMBIGUOUS' END AS reason FROM nation GROUP BY 1")
def _(t):
    return R.chosen_table(R.html_tables(region_pages(t), "n_regionkey", "html"))


@query("src13", "SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN CAST(count(*) AS INTEGER) END AS n FROM nation GROUP BY 1")
def _(t):
    members = t("nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    two = F.when(F.col("n_regionkey") % 2 == 1, F.array(F.lit(1)))
    found = members.select("n_regionkey", R.unwrapped(F.to_json(F.struct(F.lit("[x]").alias("title"), "nations", two.alias("more")))).alias("list"))
    return found.select("n_regionkey", F.json_array_length("list").alias("n"))


@query("src15", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    docs = t("documents").select("doc_id", "text")
    return R.decode_payloads(R.encode_payloads(docs, "text"), "text").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("src21", f"SELECT sha256({REGION_CSV}) AS digest, CAST(length({REGION_CSV}) AS BIGINT) AS n FROM region")
def _(t):
    region = t("region").orderBy("r_regionkey")
    store = Store(region.sparkSession)
    store.put("region.csv", O.csv_bytes(region))
    data = store.read("region.csv")
    return rows(region, [(bytearray(data), len(data))], "data binary, n long").select(F.sha2("data", 256).alias("digest"), "n")


@query("src28", "SELECT sha256(r_name) AS digest, CAST(length(r_name) AS BIGINT) AS length, 'ok' AS status FROM region")
def _(t):
    region = t("region")
    store = Store(region.sparkSession)
    for r in region.collect():  # five rows
        store.put_raw(r["r_name"].encode())
    found = region.sparkSession.read.format("binaryFile").load(store.path("raw")).withColumn("digest", F.substring_index("path", "/", -1))
    return V.rehashed(found, "content", "digest").select("digest", "length", "status")


@query("src29", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(t):
    nation = t("nation").orderBy("n_nationkey")
    store = Store(nation.sparkSession)
    store.put("registry.csv", O.csv_bytes(nation))
    rules = {"key": F.col("n_nationkey").rlike("^[0-9]+$"), "name": F.length("n_name") > 0, "region": F.col("n_regionkey").isin("0", "1", "2", "3", "4")}
    return R.read_registry(nation.sparkSession, store.path("registry.csv"), nation.columns, rules, "n_nationkey")


# ---- sinks ----


@query("snk02", "SELECT true AS reproducible, CAST(0 AS INTEGER) AS hidden_sheets, CAST(0 AS INTEGER) AS merged_ranges, count(*) AS n FROM nation")
def _(t):
    nation = t("nation").orderBy("n_nationkey")
    first, again = O.xlsx_bytes(nation), O.xlsx_bytes(nation)
    notes = R.workbook_notes(R.check_archive(first))
    store = Store(nation.sparkSession)
    store.put("nation.xlsx", first)
    back = R.read_xlsx(nation.sparkSession, store.path("nation.xlsx"))
    return back.agg(F.lit(first == again).alias("reproducible"), F.lit(notes["hidden_sheets"]).alias("hidden_sheets"), F.lit(notes["merged_ranges"]).alias("merged_ranges"), F.count("*").alias("n"))


@query("snk03", "SELECT 'orders' AS name, count(*) AS n, true AS verified FROM orders UNION ALL SELECT 'part', count(*), true FROM part")
def _(t):
    store = Store(t("orders").sparkSession)
    store.publish_tables("outputs", {"orders": t("orders"), "part": t("part")})
    said, fine = store.manifest("outputs"), store.verified("outputs")
    return rows(t("orders"), [(n, said[n]["rows"], fine[n]) for n in said], "name string, n long, verified boolean")


@query("snk04", "SELECT * FROM (VALUES ('first', 'new'), ('same again', 'there'), ('other contents', 'refused'), ('left over', '0')) AS v(step, outcome)")
def _(t):
    region = t("region").orderBy("r_regionkey")
    store, data = Store(region.sparkSession), O.csv_bytes(region)
    outcome = lambda files: "new" if store.publish("report", files) else "there"
    steps = [("first", outcome({"region.csv": data})), ("same again", outcome({"region.csv": data}))]
    try:
        steps.append(("other contents", outcome({"region.csv": data + b"\n"})))
    except R.Refused:
        steps.append(("other contents", "refused"))
    return rows(region, [*steps, ("left over", str(store.sweep()))], "step string, outcome string")


@query("snk05", f"SELECT k, sha256({REGION_CSV}) AS digest, k = 1 AS is_new FROM region, (VALUES (1), (2)) AS v(k) GROUP BY k")
def _(t):
    region = t("region").orderBy("r_regionkey")
    store, data = Store(region.sparkSession), O.csv_bytes(region)
    return rows(region, [(k, *store.put_raw(data)) for k in (1, 2)], "k int, digest string, is_new boolean")


@query("snk06", "WITH n AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER w AS n, lag(o_orderstatus) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), f AS (SELECT *, min(n) OVER (PARTITION BY o_custkey, o_orderstatus) AS m FROM n) SELECT o_orderkey, CASE WHEN o_orderstatus = b THEN 'unchanged' WHEN n = m THEN 'new_version' ELSE 'reverted' END AS outcome FROM f")
def _(t):
    return V.raw_versions(t("orders"), "o_custkey", ["o_orderkey"], "o_orderstatus").select("o_orderkey", "outcome")


@query("snk07", "SELECT 'by_brand' AS name, p_brand AS k, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'by_type', p_type, count(*) FROM part GROUP BY 2")
def _(t):
    part = t("part")
    tables = {n: part.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")) for n, c in (("by_brand", "p_brand"), ("by_type", "p_type"))}
    store = Store(part.sparkSession)
    store.publish_tables("analysis", tables, "csv")
    back = [store.table(f"analysis/{n}", "csv", df).select(F.lit(n).alias("name"), "k", "n") for n, df in tables.items()]
    return back[0].unionByName(back[1])


ORDER_OF = " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(reversed(PRIORITIES)))


@query("snk08", f"SELECT row_number() OVER (ORDER BY CASE o_orderpriority {ORDER_OF} END) AS row_id, o_orderpriority, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 2")
def _(t):
    place = F.array_position(F.array(*map(F.lit, reversed(PRIORITIES))), F.col("o_orderpriority"))
    counts = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(place, "o_orderpriority")
    store = Store(counts.sparkSession)
    store.publish("bundle", {"priorities.csv": O.csv_bytes(counts)})
    if not all(store.verified("bundle").values()):
        raise R.Refused("the bundle is not what was written")
    return R.open_table(counts.sparkSession, store.path("bundle/priorities.csv")).table


@query("snk09", "SELECT c_mktsegment AS namespace, count(*) AS n FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' GROUP BY 1")
def _(t):
    held = t("customer").withColumn("namespace", F.col("c_mktsegment")).withColumn("expires", F.when(F.col("namespace") == "AUTOMOBILE", F.date_add(F.lit("2020-01-01").cast("date"), 30)).otherwise(F.lit("2030-01-01").cast("date")))
    store = Store(held.sparkSession)
    O.write_table(held, store.path("held"), ("expires", "namespace"))
    for name in store.names("held"):  # a folder for each day of expiry
        if name.startswith("expires=") and name < "expires=2025-01-01":
            store.remove(f"held/{name}")
    return store.table("held").groupBy("namespace").agg(F.count("*").alias("n"))


@query("snk10", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey % 2 = 0")
def _(t):
    region = t("region").withColumn("verified", F.col("r_regionkey") % 2 == 0)
    store = Store(region.sparkSession)
    store.publish_tables("workspace", {"items": region.filter("verified").drop("verified")}, "json")
    return store.table("workspace/items", "json", t("region"))


# ---- models ----


@query("stt09", "WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) SELECT p_partkey, CASE WHEN p_brand IN (FROM top) THEN p_brand ELSE 'other' END AS p_brand, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 4) AS size_scaled FROM part")
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    part = M.capped_values(t("part"), "p_brand")
    ready = Pipeline(stages=M.preprocess(["p_size"], ["p_brand"])).fit(part).transform(part)
    return ready.select("p_partkey", "p_brand", F.round(vector_to_array("scaled")[0], 4).alias("size_scaled"))


@query("stt10")
def _(t):
    scores = M.compare_models(t("part"), "p_partkey", "p_retailprice", ["p_partkey", "p_size"], ["p_brand"])
    return rows(t("part"), [(k, v["rmse"]) for k, v in scores.items()], "model string, rmse double")


@query("stt11", "WITH d AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS x FROM orders), c AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q FROM d) SELECT o_orderkey, CAST(q[1] <= x AS INTEGER) + CAST(q[2] <= x AS INTEGER) + CAST(q[3] <= x AS INTEGER) + CAST(q[4] <= x AS INTEGER) AS fold FROM d, c")
def _(t):
    return M.time_folds(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "fold")


@query("stt11_scores")
def _(t):
    orders = t("orders").withColumn("size", F.length("o_orderpriority")).withColumn("o_orderkey", F.col("o_orderkey").cast("double"))
    return rows(orders, sorted(M.forward_scores(orders, "o_orderdate", "o_totalprice", ["o_orderkey", "size"]).items()), "fold int, rmse double")


@query("stt13")
def _(t):
    from pyspark.ml import Pipeline

    part = t("part").withColumn("number", F.col("p_partkey"))
    model = Pipeline(stages=[*M.preprocess(["number", "p_size"], []), M.estimators("regression", "p_retailprice")["linear"]]).fit(part)
    again = [M.permutation_importance(model, part, "p_retailprice", ["number", "p_size"], "p_partkey", seed) for seed in range(5)]
    return rows(part, [(c, sum(x[c] for x in again) / len(again)) for c in again[0]], "column string, importance double")


@query("stt14")
def _(t):
    k, grouped = M.cluster(t("part"), ["p_size", "p_retailprice"])
    return grouped.groupBy(F.col("prediction").alias("group")).agg(F.lit(k).alias("groups"), F.count("*").alias("n"), F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))


@query("stt15", "SELECT * FROM (VALUES ('Find groups', 'cluster', NULL, NULL), ('Predict o_totalprice', 'predict', 'o_totalprice', 'hash'), ('predict O_ORDERSTATUS over time using o_orderdate.', 'predict', 'o_orderstatus', 'time')) AS v(text, task, target, split)")
def _(t):
    orders = t("orders")
    texts = ("Find groups", "Predict o_totalprice", "predict O_ORDERSTATUS over time using o_orderdate.")
    parsed = [(x, requests.parse_model(x, orders.columns)) for x in texts]
    return rows(orders, [(x, p["task"], p.get("target"), p.get("split")) for x, p in parsed], "text string, task string, target string, split string")


# ---- cleaning and requests ----


@query("cln09", "SELECT min(p_partkey) AS p_partkey, trim(p_name) AS p_name, p_brand FROM part GROUP BY 2, 3")
def _(t):
    part = t("part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    plan = requests.parse_cleaning("trim p_name; number p_size; duplicates p_name, p_brand", part.columns, "p_partkey")
    return C.clean(part, plan)[0].select("p_partkey", "p_name", "p_brand")


@query("pln02", "SELECT * FROM (VALUES (1, 'describe', ''), (2, 'counts', 'p_name'), (3, 'counts', 'p_brand'), (4, 'group', 'p_name'), (5, 'group', 'p_brand'), (6, 'correlation', '')) AS v(place, op, \"column\")")
def _(t):
    plan = requests.starters(t("part"))
    return rows(t("part"), [(k, p.op, p.column or "".join(p.by)) for k, p in enumerate(plan, 1)], "place int, op string, column string")


@query("pln03", "SELECT unnest(['rows', 'p_size total', 'p_size average', 'p_retailprice total', 'p_retailprice average']) AS card, unnest([round(count(*), 2), round(sum(p_size), 2), round(avg(p_size), 2), round(sum(p_retailprice), 2), round(avg(p_retailprice), 2)]) AS value FROM part")
def _(t):
    return requests.cards(t("part"), ["p_size", "p_retailprice"]).withColumn("value", F.round("value", 2))


@query("pln04", "SELECT p_brand, p_brand || ' holds ' || count(*) || ' of ' || (SELECT count(*) FROM part) || ' parts' AS sentence FROM part GROUP BY 1")
def _(t):
    part = t("part")
    counts = part.groupBy("p_brand").agg(F.count("*").alias("n")).crossJoin(part.agg(F.count("*").alias("all")))  # one row
    return counts.select("p_brand", S.rendered("{brand} holds {n} of {all} parts", {"brand": F.col("p_brand"), "n": F.col("n"), "all": F.col("all")}).alias("sentence"))


@query("pln06", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS astray FROM part")
def _(t):
    part = t("part").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, "n/k").otherwise(F.col("p_size").cast("string")))
    plan = C.CleanPlan(trim=("p_name",), numbers={"p_size": ("", ".")}, duplicates=("p_name", "p_brand"), row_id="p_partkey")
    return requests.cleaning_agrees(part, *C.clean(part, plan), "p_partkey")


@query("pln08", "SELECT * FROM (VALUES ('same', true), ('other rows', false)) AS v(history, equal)")
def _(t):
    part = t("part")
    asked = [requests.parse(x, part.columns) for x in ("sum p size by p brand", "count values of p type")]
    history = [(q, requests.digest(requests.run(part, q))) for q in asked]
    fewer = part.filter("p_partkey > 3")
    return rows(part, [("same", requests.replay(part, history)), ("other rows", requests.replay(fewer, history))], "history string, equal boolean")


@query("pln09", "SELECT p_partkey, p_partkey % 4 <> 0 OR p_size = p_size + 1 AS passes FROM part")
def _(t):
    part = t("part")
    stated = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    sentence = F.concat(F.lit("It is of size "), stated.cast("string"))
    return part.select("p_partkey", (F.size(requests.number_lock(sentence, F.array(F.col("p_size").cast("string")))) == 0).alias("passes"))


@query("pln10", "SELECT p_name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS figure, CASE WHEN count(DISTINCT p_brand) > 1 THEN 'conflict' END AS gap, count(*) AS claims FROM part GROUP BY 1")
def _(t):
    return requests.figures_from_claims(t("part").withColumn("project", F.lit("one")), ["p_name"], "p_brand", "project")


@query("pln11", "SELECT p_brand, decision, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_size < 10 THEN 'collect' WHEN p_brand LIKE '%3' THEN 'extend' WHEN p_size > 36 THEN 'refresh' ELSE 'reuse' END AS decision FROM part) GROUP BY 1, 2")
def _(t):
    return requests.research(t("part"), "p_brand", F.col("p_size") / 20, F.col("p_size") * 10, ~F.col("p_brand").endswith("3"), 360)


# ---- streams ----


@stream_query("stream01", "events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def _(events):
    counts = T.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


@stream_query("stream02", "events", "WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true) AS INTEGER) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS rows FROM s GROUP BY user_id, k")
def _(events):
    found = T.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@stream_query("stream03", "events", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last FROM events GROUP BY 1")
def _(events):
    latest = T.latest_claims(events.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "event_type")
    return latest.select("user_id", "event_type", F.col("at.event_id").alias("last"))
