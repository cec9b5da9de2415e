"""Whole texts, demonstration rows, replaced results, and plans that read their input once."""

import re

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import ledger, metrics
from corpuscope.operators.checks.site_facts import _page_facts
from corpuscope.operators.joins import lookup
from corpuscope.operators.signals import page_signals
from corpuscope.sources import io


def test_a_long_page_is_read_to_its_end(spark):
    filler = "".join(f"<p>Paragraph number {i} speaks of gutters and attic vents at some length, plainly.</p>" for i in range(30))
    mails = " ".join(f"m{i}@mail.example.com" for i in range(11))
    html = f"<html><head><title>t</title></head><body>{filler}<p>{mails} and according to the survey, we are licensed. {'x ' * 3000}</p></body></html>"
    row = page_signals(spark.createDataFrame([(1, "https://a.example.com/", html)], "page_id long, url string, html string")).first()
    assert len(row.emails) == 11 and row.paragraph_count == 31 and "according to" in row.main_text and len(row.main_text) > 6000
    assert "substring(" not in " ".join(v for k, v in _page_facts().items() if k in ("sources", "credentials", "proof", "definitions"))


def test_demo_rows_move_each_figure_by_their_own_sum(spark):
    rows = [(i, i % 4, "SUCCEEDED", "SUBSCRIPTION", 100 + i, 5, "2001-07-30 10:00:00", i % 3 == 0) for i in range(12)]
    payments = spark.createDataFrame(rows, "payment_id long, user_id long, status string, kind string, amount_cents long, refunded_cents long, at string, is_demo boolean").withColumns(
        {"paid_at": F.to_timestamp("at"), "created_at": F.to_timestamp("at")})
    as_of = "2001-08-02 00:00:00"
    every, real = (metrics.revenue_split(payments, as_of, flag).first() for flag in (True, False))
    assert every.gross_cents - real.gross_cents == sum(r[4] for r in rows if r[7]) and every.refunded_cents - real.refunded_cents == 20
    with pytest.raises(Exception, match="is_demo"):
        bare = payments.drop("is_demo")
        metrics.revenue_split(spark.createDataFrame(bare.collect(), bare.schema), as_of).first()


def test_results_of_an_audit_are_replaced_and_emptied(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    make = lambda rows: spark.createDataFrame(rows, "audit_id string, page_id long, title string")
    audits = lambda *ids: spark.createDataFrame([(i,) for i in ids], "audit_id string")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("audit_id", "page_id", "title").collect())
    io.write_results(make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "z")]), path, ["page_id"], audits("a", "b"))
    io.write_results(make([("a", 3, "new")]), path, ["page_id"], audits("a"))
    assert read() == [("a", 3, "new"), ("b", 1, "z")]
    io.write_results(make([]), path, ["page_id"], audits("a"))
    assert read() == [("b", 1, "z")]


def test_the_credit_log_is_not_read_at_every_level(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    spark.range(200).selectExpr("id AS request_id", "id % 5 AS user_id", "timestamp_seconds(id * 700) AS created_at",
                                "element_at(array('grant', 'reserve', 'revoke', 'renew'), CAST(id % 4 + 1 AS INT)) AS action", "1 AS amount").write.parquet(path)
    for df in (ledger.credit_replay(spark.read.parquet(path), 2),):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan", final)) <= 3, final.count("FileScan")


def test_copies_of_a_looked_up_table_count_before_it_is_broadcast(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/dim"
    spark.range(100_000).selectExpr("id AS k", "id % 7 AS v").write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4m")  # the table is below it, its copies are not
        rows, dim = spark.range(300).selectExpr("id", "IF(id < 100, 5L, id * 999) AS k"), spark.read.parquet(path)
        out = lookup(rows, dim, ["k"], "id")
        out.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
        assert sorted(tuple(r) for r in out.collect()) == sorted(((5, i, 5) if i < 100 else (i * 999, i, i * 999 % 7 if i * 999 < 100_000 else None)) for i in range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
