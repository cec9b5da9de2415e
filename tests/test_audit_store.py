"""Result tables of an audit change together or not at all."""

import pytest
from pyspark.sql import functions as F

from corpuscope.sources import audit_store as store

PAGES, CHECKS = "audit_id string, page_id long, title string", "audit_id string, check_id string, points double"


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "audit_id string")


def tables(spark, pages, checks):
    return {"pages": (make(spark, pages, PAGES), ["page_id"]), "checks": (make(spark, checks, CHECKS), ["check_id"])}


def rows(spark, path, name, number=None):
    found = store.results(spark, path, name, number)
    return [] if found is None else sorted(tuple(r) for r in found.collect())


@pytest.fixture
def path(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    store.publish(spark, where, tables(spark, [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "y"), ("z", 1, "not listed")], [("a", "c1", 1.0), ("b", "c1", 0.0)]), ids(spark, "a", "b"), folders=2)
    return where


def test_replace_empty_and_keep(spark, path):
    assert rows(spark, path, "pages") == [("a", 1, "x"), ("b", 1, "y")]
    store.publish(spark, path, tables(spark, [("a", 2, "new")], []), ids(spark, "a"), folders=2)
    assert rows(spark, path, "pages") == [("a", 2, "new"), ("b", 1, "y")]
    assert rows(spark, path, "checks") == [("b", "c1", 0.0)]
    assert rows(spark, path, "pages", 1) == [("a", 1, "x"), ("b", 1, "y")]  # a reader of the manifest before
    store.publish(spark, path, tables(spark, [], []), ids(spark, "a", "b", "never seen"), folders=2)
    assert rows(spark, path, "pages") == rows(spark, path, "checks") == []


def test_a_run_that_dies_leaves_the_old_audit_whole(spark, path):
    broken = make(spark, [("a", "c9", 9.0)], CHECKS).withColumn("points", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):  # pages are written by then
        store.publish(spark, path, {"pages": (make(spark, [("a", 7, "half")], PAGES), ["page_id"]), "checks": (broken, ["check_id"])}, ids(spark, "a"), folders=2)
    assert rows(spark, path, "pages") == [("a", 1, "x"), ("b", 1, "y")] and rows(spark, path, "checks") == [("a", "c1", 1.0), ("b", "c1", 0.0)]
    assert store.clean(spark, path) == []  # young folders may belong to a run
    gone = store.clean(spark, path, hours=-1)
    assert gone and all(g.startswith(("pages/version=2-", "checks/version=2-")) for g in gone)
    assert rows(spark, path, "pages") == [("a", 1, "x"), ("b", 1, "y")]


def test_the_later_of_two_runs_is_refused(spark, path, monkeypatch):
    seen = store.manifest(spark, path)
    store.publish(spark, path, tables(spark, [("b", 5, "first")], []), ids(spark, "b"), folders=2)
    after = rows(spark, path, "pages"), rows(spark, path, "checks")
    real = store.manifest
    monkeypatch.setattr(store, "manifest", lambda *a: seen)
    with pytest.raises(store.Conflict):
        store.publish(spark, path, tables(spark, [("a", 6, "second")], []), ids(spark, "a"), folders=2)
    monkeypatch.setattr(store, "manifest", real)
    assert (rows(spark, path, "pages"), rows(spark, path, "checks")) == after


def test_a_new_column_and_versions_that_go(spark, path):
    more = make(spark, [("a", 1, "x", "HOME")], f"{PAGES}, role string")
    store.publish(spark, path, {"pages": (more, ["page_id"])}, ids(spark, "a"), folders=2)
    assert rows(spark, path, "pages") == [("a", 1, "x", "HOME"), ("b", 1, "y", None)]
    store.publish(spark, path, {"pages": (more, ["page_id"])}, ids(spark, "a", "b"), folders=2)
    assert store.clean(spark, path, keep=1, hours=-1)
    assert rows(spark, path, "pages") == [("a", 1, "x", "HOME")] and rows(spark, path, "checks") == [("a", "c1", 1.0), ("b", "c1", 0.0)]
