"""A task's share does not grow with the table: what is counted by event is dealt into pieces by the size of the files."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.operators import pieces as K
from quillon.operators import stats as M
from quillon.operators import windows as W
from quillon.sources import readers as R


def dealt(df) -> set[int]:
    """Numbers of partitions that the plan's shuffles by key have."""
    return {int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


@pytest.mark.parametrize("name", ["agg15", "agg20", "agg20_completed", "agg21", "agg23", "win07", "win11", "sta06"])
def test_pieces_grow_with_the_files(spark, sf, monkeypatch, name):
    whole = __spark_entry__.queries()[name](spark, sf)
    monkeypatch.setattr(K, "PIECE", 10_000)
    cut = __spark_entry__.queries()[name](spark, sf)
    assert dealt(cut) and min(dealt(cut)) > 8
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize("name", ["win11", "sta06"])
def test_events_are_dealt_once(spark, sf, name):
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_unknown_sizes_have_no_pieces(spark):
    assert K.pieces(spark.createDataFrame([(1,)], "k int")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_slots_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), i, rnd.choice([None, None, -1, 0, 1, 2, 2, 3, 7, 9]), rnd.random() < 0.8) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i int, slot int, fine boolean")
    want = {}
    for key in "abc":
        mine = [r for r in rows if r[0] == key]
        taken = {r[2] for r in mine if r[3] and r[2] is not None}
        free = (n for n in range(1, 999) if n not in taken)
        want |= {r[1]: r[2] if r[2] is not None or not r[3] else next(free) for r in mine}
    assert {r["i"]: r["slot"] for r in W.fill_slots(df, ["k"], "slot", [F.asc("i")], F.col("fine")).collect()} == want


def test_models_are_fitted_in_pieces(spark, sf, monkeypatch):
    parts, own = [], M.regression_scores

    def seen(df, *names):
        parts.append(df.rdd.getNumPartitions())
        return own(df, *names)

    monkeypatch.setattr(M, "regression_scores", seen)
    monkeypatch.setattr(K, "PIECE", 10_000)
    M.compare_models(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", "p_retailprice", ["p_size"], names=("linear",))
    assert min(parts) > 1


def test_importance_sends_no_table_to_all_tasks(spark, monkeypatch):
    from pyspark.ml import Pipeline

    points, plans, own = spark.range(200).selectExpr("id AS k", "double(id % 17) AS x", "double(id % 17 * 3 + id % 2) AS y"), [], M.regression_scores

    def seen(df, *names):
        out = own(df, *names)
        out.collect()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    model = Pipeline(stages=[*M.preprocess(["x"], []), M.estimators("regression", "y")["linear"]]).fit(points)
    monkeypatch.setattr(M, "regression_scores", seen)
    assert M.permutation_importance(model, points, "y", ["x"], "k")["x"] > 1
    assert "SortMergeJoin" in plans[-1] and not any("BroadcastHashJoin" in p for p in plans)


def test_payloads_by_portions(spark):
    texts = [None, "", "h\u00e9 \U0001f642", "long " * 300_000, "x"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    packed = R.encode_payloads(df, "text")
    assert {r["k"]: r["text"] for r in R.decode_payloads(packed, "text").collect()} == dict(enumerate(texts))
    many = pa.array([f"{k} " * 20_000 for k in range(100)])
    tracemalloc.start()
    try:
        R._by_portions(many, str.upper)
        assert tracemalloc.get_traced_memory()[1] < 6 * R.PORTION
    finally:
        tracemalloc.stop()
