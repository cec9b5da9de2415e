"""Mixing sources to target weights with DataFrame operations only."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import prefix_sums, space_words, stored


def source_targets(totals: DataFrame, weights: list[float], share: float, epochs: int) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources in code-point order, null last, take the weights in turn.  All targets together are
    ``share`` of all sizes, no target exceeds ``epochs`` times its source, and what a full source
    cannot take goes to the others by weight.  With the sources in order of size by weight, each
    prefix of full ones leaves a level for the rest; the highest level is the one that holds.
    """
    ranked = prefix_sums(totals.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(epochs)).alias("cap"))
    ordered = prefix_sums(weighed, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], ["cap", "w"])
    all_w, all_size = weighed.agg(F.sum("w"), F.sum("source_size")).first()  # two numbers
    if all_w is None:
        return weighed.select("source", "source_size", F.col("cap").alias("target"))
    level = (F.lit(all_size * float(share)) - F.col("before_cap")) / (F.lit(all_w) - F.col("before_w"))
    highest = ordered.agg(F.max(level)).first()[0]
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.lit(highest) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2,
                seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that a mix takes of every document.

    Documents get hash-random keys and are range-sorted by source and key; distributed prefix sums
    of their sizes say how many words of the source come before each.  A source's budget (the whole
    part of its target) is met exactly: whole epochs of all its documents, then documents in key
    order up to the cut, the last one in part.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own and comes
    last; null ids are keyed alike and ordered last; repeated rows are separate documents (at the
    cut, either may be the one taken).  An empty table gives no rows; other columns are not read.
    Result: id, size, source_size, target, taken, source.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.size(space_words(F.coalesce(F.col(text_col), F.lit("")))).cast("long")
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), size.alias("size")))  # ranges are sampled first: words are counted once
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last()]
    sized = prefix_sums(sized, order, ["size"])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("source_start"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, epochs)
    cuts = targets.join(totals.select(F.col("source").alias("s"), "source_start"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("s"), "source_size", "target", "source_start", F.floor("target").alias("budget"),
    ).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
    rest = F.col("budget") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before_size") - F.col("source_start"))))
    return sized.join(cuts, sized.source.eqNullSafe(cuts.s)).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), F.col("source").alias(source_col))
