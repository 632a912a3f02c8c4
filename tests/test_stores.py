"""Unit tests of stores, open rules, folds and request shorthands."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import stats as M
from quillon.plans import requests
from quillon.sources import readers, writers
from quillon.sources.store import Store


def test_reads_are_bounded(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put("x", b"12345")
    assert store.read("x", 5) == b"12345"
    for name, most in (("x", 4), ("none", 9), ("", 9)):
        with pytest.raises(readers.Refused):
            store.read(name, most)


def test_raw_copy_must_be_what_its_name_says(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    digest, new = store.put_raw(b"abc")
    assert new and store.put_raw(b"abc") == (digest, False)
    store.remove(f"raw/{digest}")
    store.put(f"raw/{digest}", b"other")
    with pytest.raises(readers.Refused):
        store.put_raw(b"abc")


def test_changed_table_is_found(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert store.publish_tables("t", {"one": df}) and store.verified("t") == {"one": True}
    df.limit(1).write.mode("overwrite").parquet(store.path("t/one"))
    assert store.verified("t") == {"one": False}


def test_digest_tells_cells_apart(spark):
    a = spark.createDataFrame([("a|b", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert requests.digest(a) != requests.digest(b)


def test_hidden_sheets_are_passed_over(spark):
    data = writers.xlsx_bytes(spark.createDataFrame([(1,)], "a int"))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, old.read(name).replace(b'<sheet name="data"', b'<sheet name="data" state="hidden"'))
    with pytest.raises(readers.Refused):
        readers.visible_sheets(readers.check_archive(out.getvalue()))


def test_envelopes(spark):
    texts = [('{"a": 1, "b": [1, 2]}',), ('{"a": "[1]"}',), ('{"a": [], "b": []}',), ("[1]",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(readers.unwrapped(F.col("t"))).collect()] == ["[1,2]", None, None, None, None]


def test_registry_rules(spark, tmp_path):
    (tmp_path / "r.csv").write_text("k,v\n1,a\n1,b\n")
    path = str(tmp_path / "r.csv")
    for rules, columns in (({}, ["k", "v"]), ({}, ["k"]), ({"v": F.col("v") == "a"}, ["k", "v"])):
        with pytest.raises(readers.Refused):
            readers.read_registry(spark, path, columns, rules or {"k": F.col("k") == "1"}, "k")
    assert readers.read_registry(spark, path, ["k", "v"], {"k": F.col("k") == "1"}, "v").count() == 2


def test_open_within(spark):
    df = spark.range(100)
    assert readers.open_within(df, "id", 100, 1000, 10)[1] == "whole"
    assert readers.open_within(df, "id", 99, 1000, 10)[0].count() == 10
    with pytest.raises(readers.Refused):
        readers.open_within(df, "id", 9, 99, 10)


def test_folds(spark):
    assert {r["fold"] for r in M.hash_folds(spark.range(100), "id", 5).collect()} == set(range(5))
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    assert sorted(r["c"] for r in M.capped_values(df, "c", 1).collect()) == ["other", "x", "x", "x"]


def test_shorthands_refuse():
    for text in ("melt a", "trim z", "number z"):
        with pytest.raises(requests.NotUnderstood):
            requests.parse_cleaning(text, ["a"], "id")
    for text in ("Predict z", "Guess a"):
        with pytest.raises(requests.NotUnderstood):
            requests.parse_model(text, ["a"])
