"""The pipeline stage by stage against plain re-statements."""

import corpus_pipeline
from pyspark.sql import functions as F

from corpuscope.sources.io import materialize
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None)], docs.schema))  # repeated and empty rows
    columns, outputs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(materialize(stage(spark, outputs[-1], SF)))
    assert [o.columns for o in outputs[:-1]] == [columns] * 5
    good, unique, cut, clean, mixed = (o.collect() for o in outputs[1:])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 0 for r in good) <= 2 and {d for d, q in labels.items() if q} - {r.doc_id for r in good} == set()

    groups = brute.similar_groups([r.text for r in good])
    least = {}
    for k, (n, g) in groups.items():
        least[g] = min(least.get(g, 10 ** 9), good[k].doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(least.values())

    by_id = {r.doc_id: r for r in cut}
    rows = [(r.doc_id, r.text) for r in unique]
    for (i, text), flags in zip(rows, brute.repeats(rows)):
        kept = bytes(x for x, f in zip(text.encode(), flags) if not f).decode("utf-8", "ignore")
        assert by_id[i].text == kept and by_id[i].n_chars == len(kept)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in cut if not brute.contamination(r.text, items)[1])
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in clean) and sum(r.taken for r in mixed) > 0


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0


def test_one_of_near_copies_without_distinct_ids(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    say = lambda c, n: " ".join(f"{c}{i}" for i in range(60)) + f" {n}"
    rows = [(None, say("a", "x")), (None, say("a", "y")), (None, say("a", "y")), (7, say("b", "x")), (None, say("b", "y")), (5, say("c", "x")), (5, say("d", "x")),
            (4, say("d", "y")), (None, ""), (None, None), (9, " "), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept) == [(0, ""), (0, ""), (0, "a"), (4, "d"), (5, "c"), (7, "b"), (9, " "), (9, " ")]


def test_few_contaminated_documents_are_sent_and_not_all_others_dealt(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus_pipeline.drop_contaminated(spark, docs, SF).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
