"""Every registered query of the library against its SQL on the smallest tables, and unit tests of the rules."""

import csv
import datetime
import math
import os
import random
import zlib
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.functions import scalars as S
from quillon.operators import aggregates as A
from quillon.operators import cleaning as C
from quillon.operators import filters as P
from quillon.operators import ordered as O
from quillon.operators import stats as M
from quillon.operators import versioned as V
from quillon.operators import windows as W
from quillon.plans import catalogue, requests
from quillon.sources import readers, writers
from quillon.sources.store import Store


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_headers():
    assert readers.headers([" a ", "a", None], rename=True) == ["a", "a__2", "column_3"]
    with pytest.raises(readers.Refused):
        readers.headers(["a", "a"])


def test_json_rules():
    assert readers.parse_json_table('[{"a": 1}, {"b": "x"}]')[0] == ["a", "b"]
    for bad in ('[{"a": 1, "a": 2}]', '[{"a": [1]}]', '[{"a": NaN}]', '{"a": 1}', '[{"a": 99999999999999999999}]'):
        with pytest.raises(readers.Refused):
            readers.parse_json_table(bad)


def test_csv_ragged_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\na,b\n1,x\n\n2\n3,y,z\n4,\n")
    found = readers.read_csv(spark, str(tmp_path / "t.csv"), ragged="reject")
    assert [tuple(r) for r in found.table.orderBy("row_id").collect()] == [(1, "1", "x"), (5, "4", None)]
    assert [tuple(r) for r in found.rejects.orderBy("row_id").collect()] == [(3, "2", "RAGGED_ROW"), (4, "3,y,z", "RAGGED_ROW")] and (found.blank_lines, found.ragged_rows) == (1, 2)
    with pytest.raises(readers.Refused):
        readers.read_csv(spark, str(tmp_path / "t.csv"))


def test_csv_in_splits_keeps_quoted_line_ends(spark, tmp_path):
    rows = [(k, f'say "{k}"\nand, on\nline {k}' if k % 3 else f"plain {k}") for k in range(3000)]
    with open(tmp_path / "t.csv", "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerows([("k", "v"), *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = readers.read_csv(spark, str(tmp_path / "t.csv")).table
        assert [tuple(r) for r in found.orderBy("row_id").collect()] == [(i, str(k), v) for i, (k, v) in enumerate(rows, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("data", [b"", b'a,b\n1,"x\n', b"a;b\n1;2\n", b"a,a\n1,2\n", b"a,b\n1,\xff\n", b"a,b\n1,x\x00\n"])
def test_csv_refused(spark, tmp_path, data):
    (tmp_path / "t.csv").write_bytes(data)
    with pytest.raises(readers.Refused):
        readers.read_csv(spark, str(tmp_path / "t.csv"))


def test_columns_of_a_manual_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    path = str(tmp_path / "t.csv")
    assert [tuple(r) for r in readers.read_columns(spark, path, ["a"], ["b", "c"]).collect()] == [(1, "1", "x", None)]
    for required, optional in ((["a", "d"], ["b"]), (["a"], [])):
        with pytest.raises(readers.Refused):
            readers.read_columns(spark, path, required, optional)


def test_open_table(spark, tmp_path):
    for name in ("t.txt", "t"):
        with pytest.raises(readers.Refused):
            readers.open_table(spark, str(tmp_path / name))
    (tmp_path / "t.csv").write_text("a\n" + "1\n" * 100)
    with pytest.raises(readers.Refused):
        readers.open_table(spark, str(tmp_path / "t.csv"), most=100)
    with pytest.raises(Exception, match="unknown code"):
        readers.coded(spark.createDataFrame([(1, "x")], "i int, k string"), "k", {"y": 1}, "n", ["i"]).collect()
    with pytest.raises(readers.Refused):
        readers.coded(spark.createDataFrame([(1, "y"), (1, "y")], "i int, k string"), "k", {"y": 1}, "n", ["i"])


def test_rows_are_numbered_in_order(spark):
    df = spark.range(10_000, numPartitions=7).select((F.col("id") * 3).alias("v"))
    assert [tuple(r) for r in readers.number_rows(df).orderBy("row_id").collect()] == [(3 * k, k + 1) for k in range(10_000)]


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "=a"), (2, None)], "n int, t string")
    data = writers.xlsx_bytes(df)
    assert data == writers.xlsx_bytes(df)
    (tmp_path / "t.xlsx").write_bytes(data)
    back = readers.open_table(spark, str(tmp_path / "t.xlsx")).table
    assert [tuple(r) for r in back.orderBy("row_id").collect()] == [(1, "1", "'=a"), (2, "2", None)]


def test_publish_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.publish("a", {"x.csv": b"1"}) and not store.publish("a", {"x.csv": b"1"})
    assert store.verified("a") == {"x.csv": True}
    with pytest.raises(readers.Refused):
        store.publish("a", {"x.csv": b"2"})
    assert store.names() == ["a"]


def test_html_tables():
    page = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    for broken in ("<tr><td colspan=2>x</td></tr>", "<tr><td>a</td></tr>", "<tr><th>a</th><th>a</th></tr><tr><td>1</td><td>2</td></tr>", "<tr><th></th></tr>", "<tr><th>a</th></tr>", "<tr><th>a</th></tr><tr><td>1</td><td>2</td></tr>", ""):
        page += f"<table>{broken}</table>"
    reasons = [None, "MERGED", "NO_HEADER", "REPEATED_HEADER", "EMPTY_HEADER", "NO_ROWS", "RAGGED", "EMPTY"]
    assert [x["reason"] for x in readers.tables_in(page)] == reasons
    assert [x["reason"] for x in readers.tables_in("<table><tr><th>a</th></tr><tr><td><table></table></td></tr></table>")] == ["NESTED", "EMPTY"]


def test_parsed_number_reasons(spark):
    df = spark.createDataFrame([("1,234.5",), ("1.5",), ("abc",), ("1.234,5",), (None,), ("1e999",), ("NaN",), ("1d",)], "t string")
    p = S.parsed_number(df["t"], ",", ".")
    found = [tuple(r) for r in df.select(p["value"], p["reason"]).collect()]
    assert found[0] == (1234.5, None) and found[1] == (1.5, None) and found[3][1] == "WRONG_SEPARATORS" and found[4] == (None, None)
    assert {found[k][1] for k in (2, 5, 6, 7)} == {"NOT_A_NUMBER"}


def test_filters_refuse(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        P.keep_between(df, "a", 3, 1)
    with pytest.raises(P.EmptyResult):
        P.not_empty(df.filter("a > 1"))
    with pytest.raises(ValueError):
        P.drop_column(df, "a")
    with pytest.raises(TypeError):
        A.group_aggregate(spark.createDataFrame([("x", "y")], "k string, v string"), ["k"], ["v:sum"])


#: entity, unit, event, category, tier.
RESULTS = [
    ("oak", "pots", 1, "w", "A"), ("elm", "pots", 1, "w", "N"), ("fir", "pots", 1, "w", "R"), ("oak", "pots", 2, "m", "A"), ("oak", "pots", 2, "m", "N"),
    ("oak", "rugs", 3, "w", "R"), ("elm", "rugs", 3, "w", "A"), ("elm", "hats", 4, "x", "A"), ("oak", "pots", 5, "m", "R"), ("oak", "pots", 5, "m", "R"),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(RESULTS, "entity string, unit string, event int, category string, tier string")


def test_metric_frame(results):
    got = {r["entity"]: r for r in A.entity_summary(results).collect()}
    assert {k: (r["n1"], r["n2"], r["n3"], r["total"], r["points"]) for k, r in got.items()} == {"oak": (2, 1, 3, 6, 11), "elm": (2, 1, 0, 3, 8), "fir": (0, 0, 1, 1, 1)}
    assert [got[k]["podium_rank"] for k in ("oak", "elm", "fir")] == [1, 2, 3]


def test_concentration_labels(spark, results):
    got = {r["entity"]: r for r in A.concentration(results).collect()}
    assert got["oak"]["hhi"] == pytest.approx((5 / 6) ** 2 + (1 / 6) ** 2) and got["oak"]["label"] == "concentrated" and got["oak"]["coverage"] == pytest.approx(2 / 3)
    assert got["fir"]["small_sample"] and not got["elm"]["small_sample"] and got["elm"]["units_with_first"] == 2
    even = lambda n: spark.createDataFrame([("e", f"u{k}", k, "w", "A") for k in range(n)], results.schema)
    assert [A.concentration(even(n)).first()["label"] for n in (4, 8, 10, 11)] == ["moderate", "moderate", "moderate", "diversified"]


def test_category_gap(results):
    got = {r["entity"]: r for r in A.category_summary(results, ["m", "w", "x"], "w", "m").collect()}
    oak, elm, fir = (got[k] for k in ("oak", "elm", "fir"))
    assert (oak["c1"], oak["c2"], oak["p1"], oak["p2"]) == (4, 2, 7, 4) and oak["share"] == pytest.approx(2 / 6) and oak["share_of_two"] == pytest.approx(2 / 6) and oak["gap"] == pytest.approx(4 / 11)
    assert elm["gap"] is None and elm["share"] == pytest.approx(2 / 3) and elm["share_of_two"] == 1 and fir["gap"] is None


def test_conversion_by_completed_events(spark, results):
    got = {(r["entity"], r["unit"]): r for r in A.conversion(results).collect()}
    pots = got["oak", "pots"]
    assert (pots["completed"], pots["sweeps"], pots["total"]) == (3, 2, 5) and pots["event_conversion"] == pytest.approx(5 / 3) and got["fir", "pots"]["event_conversion"] == pytest.approx(1 / 3)
    events = spark.createDataFrame([("pots", "F"), ("pots", "F"), ("pots", "O"), ("pots", "F"), ("pots", "F"), ("rugs", "O")], "unit string, status string")
    done = {(r["entity"], r["unit"]): r for r in A.conversion(results, A.completion(events, "unit", "status", ["F"])).collect()}
    assert done["oak", "pots"]["event_conversion"] == pytest.approx(5 / 4) and done["oak", "rugs"]["event_conversion"] is None and done["elm", "hats"]["completed"] is None


def test_unit_summary_counts_events_once(results):
    got = {r["unit"]: r for r in A.unit_summary(results, ["m", "w", "x"], "w").collect()}
    pots = got["pots"]
    assert (pots["events"], pots["entities"], pots["leader"], pots["total"], pots["c1"], pots["c2"]) == (3, 3, "oak", 7, 4, 3) and pots["focus_share"] == pytest.approx(3 / 7)
    assert pots["hhi"] == pytest.approx((25 + 1 + 1) / 49) and got["rugs"]["leader"] == "elm"


def test_strength_tiers_have_empty_rows(results):
    got = {(r["entity"], r["unit"]): r for r in A.strength_tiers(results).collect()}
    assert len(got) == 9 and got["fir", "hats"]["tier_name"] == "No results" and got["fir", "hats"]["unit_events"] == 1 and got["fir", "hats"]["cumulative_share"] is None
    assert got["oak", "pots"]["tier_name"] == "Core" and got["oak", "rugs"]["tier_name"] == "Tail" and not got["elm", "hats"]["first_heavy"]
    assert got["oak", "pots"]["cumulative_share"] == pytest.approx(10 / 11)


def test_trend_reaches_to_its_bounds(spark):
    df = spark.createDataFrame([("2024-02-10", 2), ("2024-04-01", 3), ("2024-04-30", 4), ("2024-09-01", 9), (None, 1)], "d string, v int").withColumn("d", F.to_date("d"))
    got = [tuple(r) for r in A.time_trend(df, "d", "v", "sum", start="2024-01-15", end="2024-06-30").collect()]
    assert got == [("2024-01", 0, None), ("2024-02", 1, 2), ("2024-03", 0, None), ("2024-04", 2, 7), ("2024-05", 0, None), ("2024-06", 0, None)]
    assert [r["period"] for r in A.time_trend(df, "d", freq="quarter").collect()] == ["2024-Q1", "2024-Q2", "2024-Q3"]
    assert A.time_trend(df.limit(0), "d", "v", "sum", start="2024-01-01").count() == 0
    with pytest.raises(ValueError):
        A.time_trend(df, "d", start="2024-02-01", end="2024-01-01")


def test_value_classes(spark):
    want = {
        "1": "integer", "+7": "integer", "007": "text", "1.": "text", ".5": "text", "007.5": "text", "0.5": "decimal", "1e5": "decimal", "9223372036854775808": "text", "TRUE": "boolean", " ": "empty", "2024-02-29": "date",
        "2023-02-29": "text", "2024-02-29T10:20": "datetime", "2024-02-29 10:20:30.5+02:00": "datetime", "2024-02-29 10:20.5": "text", "2024-02-29 24:00": "text", "1,5": "text", "01/02/2024": "text",
    }
    df = spark.createDataFrame([(v,) for v in want], "v string")
    assert dict(df.select("v", S.value_class(F.col("v"))).collect()) == want
    hints = dict(df.select("v", S.value_hint(F.col("v"))).collect())
    assert {v: h for v, h in hints.items() if h} == {"007": "LEADING_ZERO", "9223372036854775808": "TOO_LARGE", "2023-02-29": "NO_SUCH_DAY", "1,5": "DECIMAL_COMMA", "01/02/2024": "AMBIGUOUS_DATE"}


def test_matching_keys(spark):
    want = {"Timor‑Leste": "timor‑leste", "a.b": "ab", "Men's  4/x": "mens 4 x", "ﬁne_Straße": "fine strasse", "Ｗide – dash 🏅": "wide dash", None: None}
    want["Timor‑Leste"] = "timor leste"
    rows = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r[0]: r[1] for r in rows.select("v", S.matching_key(F.col("v"))).collect()} == want
    plain = ["4-NOT SPECIFIED", "a.b,c;d", "x_y\\z/w", "It's  (so) #1!"]
    rows = spark.createDataFrame([(k,) for k in plain], "v string")
    assert all(r[0] == S.key_of(r[1]) for r in rows.select(S.plain_key(F.col("v")), "v").collect())


def test_description_has_15_columns(spark):
    df = spark.createDataFrame([(1, "ab", 1.5), (4, None, 2.5), (None, "abcd", None)], "i int, t string, d double")
    got = {r["column"]: r.asDict() for r in A.describe(df).collect()}
    assert list(got) == ["i", "t", "d"] and list(got["i"]) == list(A.DESCRIBED) and len(A.DESCRIBED) == 15
    assert (got["i"]["type"], got["i"]["count"], got["i"]["nulls"], got["i"]["mean"], got["i"]["median"], got["i"]["p25"], got["i"]["min_length"]) == ("integer", 2, 1, 2.5, 2.5, 1.75, None)
    assert (got["t"]["min"], got["t"]["max"], got["t"]["min_length"], got["t"]["max_length"], got["t"]["mean_length"], got["t"]["mean"]) == ("ab", "abcd", 2, 4, 3.0, None)


def test_log_of_observations_is_settled(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    log = [("s", "web", at(0), "x"), ("s", "web2", at(1), "y"), ("s", "main", at(2), "x"), ("s", "web2", at(3), "y"), ("s", "main", at(4), "x"), ("s", "web", at(5), "y"), ("s", "web2", at(200), "y"), ("s", "main", at(201), "y")]
    got = V.settled(spark.createDataFrame(log, "slot string, source string, at timestamp, value string"), ["slot"], "source", "at", "value", "main", 2).orderBy("at").collect()
    assert [(r["applies"], r["rule"], r["status"], r["refetch"]) for r in got] == [
        (True, None, None, False), (False, "NON_OFFICIAL", "needs_review", False), (True, "OFFICIAL_STILL_DISAGREES", "needs_review", False), (False, "OFFICIAL_STALE", "needs_review", True),
        (True, "OFFICIAL_STILL_DISAGREES", "needs_review", False), (False, "OFFICIAL_STALE", "needs_review", True), (False, "OFFICIAL_STALE", "needs_review", True), (True, "AGREEMENT", "resolved", False),
    ]


def test_versions_by_sequence(spark):
    """Against the same rules applied one claim after another."""
    rnd = random.Random(3)
    claims = [(i, rnd.choice("ab"), rnd.choice("xy"), rnd.choice("AAB"), rnd.choice([None, "d1", "d2"])) for i in range(400)]
    want, now = [], {}
    for i, slot, value, detail, day in claims:
        v = now.get(slot)
        if v and (v["value"], v["detail"]) == (value, detail) and not (day and v["day"] and day != v["day"]):
            v["day"] = v["day"] or day
            continue
        action = "created" if v is None else "reallocated" if v["value"] != value else "corrected"
        if v:
            v["to"] = i
        now[slot] = {"slot": slot, "value": value, "detail": detail, "day": day, "from": i, "to": None, "action": action}
        want.append(now[slot])
    df = spark.createDataFrame(claims, "i int, slot string, value string, detail string, day string")
    got = V.validity(df, ["slot"], ["i"], "value", "i", "detail", "day").collect()
    key = lambda x: (x[0], x[4])
    assert sorted(((r["slot"], r["value"], r["detail"], r["day"], r["valid_from"], r["valid_to"], r["action"]) for r in got), key=key) == sorted(((w["slot"], w["value"], w["detail"], w["day"], w["from"], w["to"], w["action"]) for w in want), key=key)


def test_name_for_two_keys_is_refused(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    with pytest.raises(ValueError):
        V.upsert_named(state, spark.createDataFrame([(3, "a")], "k int, name string"), "k", "name")
    assert V.upsert_named(state, spark.createDataFrame([(2, "c")], "k int, name string"), "k", "name").count() == 2


def test_bytes_are_text_or_refused(spark):
    rows = [(b"plain",), (b"\xef\xbb\xbfmark",), ("a\ufffdb".encode() + b"\xffz",), (b"a\x00b",), (None,), ("é".encode() + b"\xc3",)]
    df = spark.createDataFrame(rows, "b binary")
    got = [tuple(r[0]) for r in df.select(S.decoded(F.col("b"))).collect()]
    assert got == [("plain", None, None), ("mark", None, None), (None, "NOT_UTF8", 5), (None, "NUL", 1), (None, None, None), (None, "NOT_UTF8", 2)]
    assert spark.createDataFrame([(b"\xe9",)], "b binary").select(S.decoded(F.col("b"), "ISO-8859-1")["text"]).first()[0] == "é"


def test_too_many_rejects(spark):
    df = spark.createDataFrame([(1, "1", None), (2, "x", " ")], "row_id int, n string, e string")
    with pytest.raises(C.TooManyRejects):
        C.clean(df, C.CleanPlan(numbers={"n": ("", ".")}, max_reject_share=0.4))
    good, rejects, _ = C.clean(df, C.CleanPlan(trim=("e",), drop_empty=("e",), numbers={"n": ("", ".")}, max_reject_share=0.5))
    assert good.dtypes == [("row_id", "int"), ("n", "bigint")] and good.count() == rejects.count() == 1


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert M.correlation_matrix(df, ["a", "b"]).first()["r"] is None


def test_slots_keep_stated_ones(spark):
    df = spark.createDataFrame([("e", 1, 2), ("e", 2, None), ("e", 3, None)], "k string, i int, slot int")
    assert {r["i"]: r["slot"] for r in W.fill_slots(df, ["k"], "slot", [df["i"].asc()]).collect()} == {1: 2, 2: 1, 3: 3}


def test_strict_step_stops(spark):
    with pytest.raises(C.StepRefused):
        C.text_to_number(spark.createDataFrame([("1",), ("x",)], "t string"), "t")


def test_clean_conserves_rows(spark):
    df = spark.createDataFrame([(1, "5", "01/02/2020"), (2, "x", "01/02/2020"), (3, "5", "01/02/2020"), (4, "6", "99/02/2020")], "row_id long, n string, d string")
    good, rejects, twice = C.clean(df, C.CleanPlan(numbers={"n": ("", ".")}, dates={"d": "%d/%m/%Y"}, duplicates=("n", "d")))
    assert (good.count(), rejects.count(), twice.count()) == (1, 2, 1)


def test_requests(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    asked = requests.parse("top 3 p_brand by p_size", part.columns)
    table = requests.run(part, asked)
    assert requests.replay(part, [(asked, requests.digest(table))])
    with pytest.raises(requests.NotUnderstood):
        requests.parse("drop everything", part.columns)
    assert requests.starters(part)


def test_lock_keys_equal_the_library(spark):
    rows = spark.createDataFrame([("a", "b"), ("é", ""), ("x:y", "z")], "a string, b string")
    assert [r[0] for r in rows.select(S.lock_key(F.col("a"), F.col("b"))).collect()] == [zlib.crc32(f"{a}:{b}".encode()) for a, b in (("a", "b"), ("é", ""), ("x:y", "z"))]


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(5)
    rows = [(k, float(x := rnd.uniform(0, 10)), rnd.uniform(0, 10), 3 * x + rnd.gauss(0, 0.1)) for k in range(400)]
    return spark.createDataFrame(rows, "k long, x double, noise double, y double")


def test_every_estimator_beats_the_guess(points):
    scores = M.compare_models(points, "k", "y", ["x", "noise"])
    assert set(scores) == {"baseline", "linear", "tree", "forest", "boosting"} and all(s["rmse"] < scores["baseline"]["rmse"] / 3 for k, s in scores.items() if k != "baseline")
    with pytest.raises(ValueError):
        M.compare_models(points.limit(19), "k", "y", ["x"])


def test_noise_has_no_importance(points):
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[*M.preprocess(["x", "noise"], []), M.estimators("regression", "y")["linear"]]).fit(points)
    found = M.permutation_importance(model, points, "y", ["x", "noise"], "k")
    assert found["x"] > 5 and abs(found["noise"]) < 0.1


def test_groups_are_found(spark):
    rnd = random.Random(6)
    rows = [(k, cx + rnd.gauss(0, 0.1), cy + rnd.gauss(0, 0.1), c) for k in range(300) for c, (cx, cy) in [(k % 3, [(0, 0), (9, 0), (0, 9)][k % 3])]]
    k, grouped = M.cluster(spark.createDataFrame(rows, "k long, x double, y double, c int"), ["x", "y"])
    assert k == 3 and grouped.select("c", "prediction").distinct().count() == 3


def test_folds_follow_time(points):
    day = points.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int")))
    counts = {r["fold"]: (r["n"], r["a"], r["b"]) for r in M.time_folds(day, "day").groupBy("fold").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).collect()}
    assert len(counts) == 5 and all(counts[i][2] < counts[i + 1][1] for i in range(4)) and all(79 <= c[0] <= 81 for c in counts.values())
    assert set(M.forward_scores(day, "day", "y", ["x"])) == {1, 2, 3, 4} and max(M.forward_scores(day, "day", "y", ["x"]).values()) < 0.3


def test_quantiles_and_ranks_in_groups(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.choice([None, 1.0, 2.0, 2.5, 7.0, rnd.random()])) for _ in range(500)] + [("d", None), ("e", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in O.quantiles(df, "v", (0.0, 0.3, 0.5, 1.0), ["g"]).collect()}
    assert set(got) == set("abce")
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], (0, 0.3, 0.5, 1)).tolist())
    places = O.competition_ranks(df, ["v"], by=["g"]).collect()
    assert len(places) == len(rows) and all(r["place"] == 1 + sum(k == r["g"] and v is not None and (r["v"] is None or v > r["v"]) for k, v in rows) for r in places)


def test_models_compare(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    scores = M.compare_models(part, "p_partkey", "p_retailprice", ["p_size"], ["p_brand"], names=("linear",))
    assert scores["linear"]["rmse"] > 0
