"""Deliveries that come late, twice, out of order and around a crash take effect once."""

import random
from datetime import datetime, timedelta

import pytest

from corpuscope.operators import events as ev
from corpuscope.streaming import exactly_once as once

SCHEMA = "event_id string, delivery_id long, type string, session_ref string, payment_status string, created_at timestamp"
PAID = "checkout.session.completed"


def deliveries():
    r, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(f"e{r.randrange(120)}", i, r.choice([PAID, PAID, "invoice.paid"]), f"s{r.randrange(40)}", r.choice(["paid", "unpaid"]), start + timedelta(hours=i)) for i in range(300)]
    rows += [(e, 1000 + i, t, s, p, at + timedelta(days=30)) for i, (e, _, t, s, p, at) in enumerate(rows[::7])]  # copies a month late
    r.shuffle(rows)
    return rows


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return once.first_of_each(stream)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_late_copies_and_restarts(spark, tmp_path):
    source, folder, rows = str(tmp_path / "in"), str(tmp_path / "run"), deliveries()
    for cut in range(0, len(rows), 90):  # each turn is a new start of the query
        add(spark, source, rows[cut:cut + 45])
        add(spark, source, rows[cut + 45:cut + 90])
        table = once.run_to_end(state(spark, source), folder, "event_id")
        batch = spark.createDataFrame(rows[:cut + 90], SCHEMA)
        assert sorted_rows(once.duplicates(table)) == sorted_rows(ev.event_dedupe(batch))
        grants = ev.credit_grants(once.firsts(table))
        assert sorted_rows(grants) == sorted_rows(ev.credit_grants(batch))
        assert grants.count() == grants.select("session_ref").distinct().count()
    again = once.run_to_end(state(spark, source), folder, "event_id")  # nothing came since
    assert sorted_rows(once.duplicates(again)) == sorted_rows(ev.event_dedupe(batch))


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    source, folder, rows = str(tmp_path / "in"), str(tmp_path / "run"), deliveries()
    add(spark, source, rows[:200])
    once.run_to_end(state(spark, source), folder, "event_id")
    add(spark, source, rows[200:])
    plain = once.merge_by_key

    def failing(path, key):
        sink = plain(path, key)

        def write_then_fail(batch, epoch):
            sink(batch, epoch)
            raise RuntimeError("lost")

        return write_then_fail

    monkeypatch.setattr(once, "merge_by_key", failing)
    with pytest.raises(Exception, match="lost"):
        once.run_to_end(state(spark, source), folder, "event_id")
    monkeypatch.setattr(once, "merge_by_key", plain)
    table = once.run_to_end(state(spark, source), folder, "event_id")
    batch = spark.createDataFrame(rows, SCHEMA)
    assert sorted_rows(once.duplicates(table)) == sorted_rows(ev.event_dedupe(batch))
    assert sorted_rows(ev.credit_grants(once.firsts(table))) == sorted_rows(ev.credit_grants(batch))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path, sink = str(tmp_path / "table"), once.merge_by_key(str(tmp_path / "table"), "k", buckets=3)
    one, two = spark.createDataFrame([(k, "a") for k in range(9)], "k long, v string"), spark.createDataFrame([(2, "b"), (40, "b")], "k long, v string")
    sink(one, 0)
    sink(two, 1)
    want = {**{k: "a" for k in range(9)}, 2: "b", 40: "b"}
    for epoch, batch in ((1, two), (0, one), (1, two)):
        sink(batch, epoch)
    assert {r.k: r.v for r in once.written(spark, path, None).collect()} == want


def test_empty_source(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [])
    assert once.run_to_end(state(spark, str(tmp_path / "in")), str(tmp_path / "run"), "event_id").count() == 0
