"""A corpus from raw documents to a mix: each stage takes what the one before it kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.llm.common import stored, table
from corpuscope.llm.decontaminate import bounded, find_contamination
from corpuscope.llm.jaccard_join import print_of, similar_rows
from corpuscope.llm.mixing import mix_sources
from corpuscope.llm.quality import score_quality
from corpuscope.llm.suffix_dedup import dedup_substrings
from corpuscope.sources.io import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return score_quality(docs).where("keep").select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays, that with the smallest id (null ids count as larger than
    all others) and among rows of equal id the smallest hash of the text; documents without words all stay."""
    similar = similar_rows(docs)
    rows = similar.where("group is not null").groupBy("group", "doc_id", "print_of_text").agg(F.count("*").alias("rows"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print_of_text", "rows")).alias("r")).select(
        F.col("r.doc_id").alias("_id"), F.col("r.print_of_text").alias("_print"), (F.col("r.rows") > 1).alias("_repeated"))
    wordless = similar.where("group is null").select("doc_id", "print_of_text", F.lit(False)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (print_of("text") == F.col("_print"))
    kept = docs.join(first.union(wordless), same)
    return kept.where("not _repeated").select(docs.columns).union(
        kept.where("_repeated").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the texts."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = dedup_substrings(docs, carry=others)
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(fresh.get(c, F.col(f"row_{c}")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = stored(find_contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("print_of_text").alias("_print")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_print"))
    return docs.join(bounded(found), same, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]
#: The first stage's classifier can't be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
