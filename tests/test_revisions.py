"""Decisions and states on a stream equal the batch after every micro-batch, whatever the order of rows."""

import random
from datetime import datetime, timedelta

from corpuscope.operators import events as ev
from corpuscope.streaming import exactly_once, revisions as rv

SCHEMA = "event_id long, user_id long, ts timestamp"
LIMIT, WINDOW = 3, 7200


def attempts():
    r = random.Random(11)
    rows = [(i, None if i % 17 == 0 else r.choice([1, 1, 1, 2, 3]), datetime(2024, 1, 1) + timedelta(minutes=11 * (i // 2))) for i in range(240)]  # ties too
    r.shuffle(rows)
    return rows


def source(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def log_of(spark, path, stream):
    return rv.logged(spark, path, rv.decisions_schema(stream, "user_id", "ts", "event_id"))


def test_limits_in_any_order_with_restarts(spark, tmp_path):
    rows, path = attempts(), str(tmp_path / "decisions")
    sink = rv.limited(path, "user_id", "ts", "event_id", LIMIT, WINDOW)
    for cut in range(0, len(rows), 80):  # each turn is a new start of the query, with copies of known attempts
        stream = source(spark, str(tmp_path / "in"), rows[max(0, cut - 7):cut + 80])
        rv.run_to_end(stream, sink, str(tmp_path / "run"))
        got = rv.current(log_of(spark, path, stream), "event_id")
        want = ev.rate_limit(spark.createDataFrame(rows[:cut + 80], SCHEMA), LIMIT, WINDOW)
        assert sorted_rows(got.select(want.columns)) == sorted_rows(want)


def test_a_late_attempt_takes_back_later_decisions(spark, tmp_path):
    path, start = str(tmp_path / "log"), datetime(2024, 1, 1)
    sink = rv.limited(path, "user_id", "ts", "event_id", 2, 3600)
    at = [start + timedelta(minutes=m) for m in (0, 10, 20, 30, 90, 400)]
    frame = lambda *ids: spark.createDataFrame([(i, 1, at[i]) for i in ids], SCHEMA)
    sink(frame(1, 3, 4, 5), 0)
    sink(frame(0), 1)
    log = log_of(spark, path, frame())
    second = {r.event_id: r.allowed for r in log.where("epoch = 1").collect()}
    assert second == {0: True, 1: True, 3: False, 4: True}  # 1, 4: other figures; 3 is taken back; 5 is as it was
    before = sorted_rows(log)
    sink(frame(0), 1)  # the epoch runs again
    sink(frame(0, 5), 2)  # copies
    assert sorted_rows(log_of(spark, path, frame())) == before


def test_no_attempts(spark, tmp_path):
    path = str(tmp_path / "log")
    sink = rv.limited(path, "user_id", "ts", "event_id", 2, 3600)
    sink(spark.createDataFrame([(1, 1, None)], SCHEMA), 0)
    assert log_of(spark, path, spark.createDataFrame([], SCHEMA)).count() == 0


def test_subscriptions_in_any_order(spark, tmp_path):
    r, folder = random.Random(9), str(tmp_path / "run")
    schema = "event_id string, delivery_id long, type string, subscription_ref string, plan string, status string, period int, created_at timestamp"
    rows = [(f"e{i - (i % 5 == 1)}", i, r.choice(ev.SUBSCRIPTION_TYPES), f"sub_{(i - (i % 5 == 1)) % 4}", r.choice(["STARTER", "GROWTH"]),
             r.choice(["active", "odd"]), r.randrange(9), datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(150)]
    r.shuffle(rows)
    sink = rv.folded_again(folder, "subscription_ref", "delivery_id", ev.subscription_state)
    for cut in range(0, len(rows), 50):
        rv.run_to_end(source(spark, str(tmp_path / "in"), rows[cut:cut + 50], schema), sink, folder)
        want = ev.subscription_state(spark.createDataFrame(rows[:cut + 50], schema))
        got = exactly_once.written(spark, f"{folder}/table", None)
        assert sorted_rows(got.select(want.columns)) == sorted_rows(want)
    before = sorted_rows(got)
    sink(spark.createDataFrame(rows[100:], schema), 2)  # the last epoch runs again
    assert sorted_rows(exactly_once.written(spark, f"{folder}/table", None).select(got.columns)) == before
