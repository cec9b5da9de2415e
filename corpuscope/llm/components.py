"""Connected components of a table of links, and groups cut into blocks of pairs."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.sources.io import reliable_checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node of the component.

    Each round every node takes the smallest label around it and then the label of its label, so
    chains shorten by halves.  Only links and labels move; rounds are cut by checkpoints."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = reliable_checkpoint(both)
    labels = reliable_checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        up = lower.select(F.col("node").alias("at"), F.col("low").alias("up"))
        moved = reliable_checkpoint(lower.join(up, F.col("low") == F.col("at"), "left").select(
            "node", F.least("low", F.coalesce("up", "low")).alias("label"),
            (F.least("low", F.coalesce("up", "low")) != F.col("label")).alias("changed")))
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels


def block_pairs(rows: DataFrame, keys: list[str], member: str, size: int) -> DataFrame:
    """Add ``block_a`` and ``block_b`` so that any two members of a group meet in one small group at least.

    A group of up to ``size`` members stays one block; a larger one is cut into blocks by a hash of
    the member, and each row goes to every pair of blocks that holds its own."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_{k}")) if same is None else same & (F.col(k) == F.col(f"_{k}"))
    blocks = F.coalesce("_blocks", F.lit(1))
    cut = rows.join(large, same, "left").withColumn("_own", F.pmod(F.xxhash64(member), blocks).cast("int"))
    return cut.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        *rows.columns, F.least("_own", "_other").alias("block_a"), F.greatest("_own", "_other").alias("block_b"), F.col("_own").alias("block"))
