"""A stream that has been drained gives what the batch gives."""

import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from corpuscope.operators import events as ev
from corpuscope.plans import business_queries, stream_queries
from corpuscope.sources import io
from corpuscope.streaming import pipelines as st


def _run(df, mode, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _files(spark, tmp_path, rows, schema, parts=4):
    folder = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    df = spark.read.parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(n=400):
    rnd = random.Random(5)
    return [(i, rnd.randrange(6), datetime(2024, 1, 1) + timedelta(minutes=9 * i), rnd.choice(["view", "click"])) for i in range(n)]


SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def test_daily_counts(spark, tmp_path):
    batch, stream = _files(spark, tmp_path, _rows(), SCHEMA)
    got = _run(st.daily_counts(stream), "complete", "daily", spark)
    assert sorted(got.collect()) == sorted(ev.daily_event_window(batch).collect())


def test_rate_limit(spark, tmp_path):
    batch, stream = _files(spark, tmp_path, _rows(), SCHEMA)
    got = _run(st.rate_limited(stream, "user_id", "ts", "event_id", 3, 7200), "append", "limited", spark)
    want = ev.rate_limit(batch.select("event_id", "user_id", "ts"), 3, 7200)
    assert sorted((r.tie, r.allowed, r.remaining) for r in got.collect()) == sorted((r.event_id, r.allowed, r.remaining) for r in want.collect())


def test_dedupe_and_subscriptions(spark, tmp_path):
    rnd = random.Random(9)
    kinds = ev.SUBSCRIPTION_TYPES
    rows = [(f"e{i - (i % 5 == 1)}", i, rnd.choice(kinds), f"sub_{rnd.randrange(5)}", rnd.choice(["STARTER", "GROWTH"]), rnd.choice(["active", "odd"]), rnd.randrange(9),
             datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(300)]
    schema = "event_id string, delivery_id long, type string, subscription_ref string, plan string, status string, period int, created_at timestamp"
    batch, stream = _files(spark, tmp_path, rows, schema)
    once = _run(st.first_deliveries(stream), "append", "once", spark)
    assert once.count() == ev.event_dedupe(batch).count()
    firsts = ev.first_deliveries(batch)
    folder = str(tmp_path / "firsts")
    firsts.coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(firsts.schema).parquet(folder)
    out = str(tmp_path / "subs")
    q = (st.subscription_rows(source).writeStream.outputMode("update").foreachBatch(st.write_changes(out))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = st.latest(spark, out, "subscription_ref", "usage_resets")
    cols = ["subscription_ref", "plan", "status", "period", "usage_resets"]
    assert sorted(got.select(*cols).collect()) == sorted(ev.subscription_state(batch).select(*cols).collect())


def test_many_files_in_any_order(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=61 * i), rnd.randrange(6), rnd.choice(["view", "click"]), 1.0, "{}") for i in range(780)]
    names = [f"ev{i:03d}" for i in range(130)]  # more than two micro-batches of 64
    rnd.shuffle(names)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k, name in enumerate(names):
        columns = zip(*rows[6 * k:6 * k + 6])
        table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64(), pa.string()))],
                         names=io.EVENT_SCHEMA.names)
        pq.write_table(table, folder / f"{name}.parquet")
        os.utime(folder / f"{name}.parquet", (1_700_000_000 + int(name[2:]), 1_700_000_000 + int(name[2:])))
    for stream, batch in (("e7_stream_rate_limit", "e7_rate_limit"), ("e11_stream_daily_counts", "e11_daily_event_window")):
        got = stream_queries.QUERIES[stream](spark, str(tmp_path))
        want = business_queries.QUERIES[batch](spark, str(tmp_path)).select(got.columns)
        got, want = sorted(got.collect()), sorted(want.collect())
        assert got == want, (stream, len(got), len(want), len(set(got) & set(want)))
