"""Token counts through a cache that is keyed by content and tokenizer digests."""

import functools
import hashlib
import json
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

#: Pieces whose counts a task remembers, at most.
REMEMBERED = 200_000
#: Texts encoded at once.
TOGETHER = 2_000
#: A space between two visible characters: byte-level pre-tokenizers always begin a piece there.
BREAK = re.compile(r"(?<=\S) (?=\S)")
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def splits_at_spaces(spec: dict) -> bool:
    """Whether no token can span a space between two visible characters.

    True of the byte-level pre-tokenizer with its own expression and nothing before it, when no
    added token takes the white space beside it or holds any itself."""
    pre = spec.get("pre_tokenizer") or {}
    own = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    return bool(own) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)


@functools.lru_cache(maxsize=1)
def counter(path_suffix: str, model: bytes):
    """A function from a list of texts to their token counts, for a .json or .model file's bytes.

    A Python worker keeps it, with the pieces it remembers, from task to task."""
    if path_suffix == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_str(model.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts):
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not splits_at_spaces(json.loads(model)):
        return whole
    known: dict[str, int] = {}

    def by_pieces(texts):
        """Each text cut before single spaces; the tokenizer encodes each distinct piece once."""
        out = []
        for text in texts:
            first, *others = BREAK.split(text)
            pieces = Counter(others)
            new = [p for p in pieces if p not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(pieces)
            if new:
                known.update(zip(new, whole([" " + p for p in new])))
            out.append(whole([first])[0] + sum(known[p] * n for p, n in pieces.items()))
        return out

    return by_pieces


def read_cache(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, encoded only where the cache at ``cache_path`` has no count.

    The cache is a table of (tokenizer file's digest, content digest, count).  Contents (null: empty)
    are taken as they are, since tokenizers tell apart whatever a normal form would merge.  Equal
    texts meet before the shuffle and are encoded once; new counts are appended, so a run that is
    broken off and repeated goes on from what it had, and a count that was appended twice is read once.
    Begin, end and other added tokens, truncation and padding are off; special strings inside texts
    are treated as the library treats them by default.

    Repeated rows are counted alike, an empty table gives no rows and appends none, other columns are
    not read.  Result: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:
        model = file.read()
    version = hashlib.sha256(model).hexdigest()
    sent = spark.sparkContext.broadcast((tokenizer_path.rpartition(".")[2], model))  # one file of a tokenizer

    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    mine = F.col("version") == version
    misses = given.select("digest", "text").dropDuplicates(["digest"]).join(
        read_cache(spark, cache_path).where(mine).select("digest"), "digest", "left_anti")

    def encode(batches):
        count = counter(*sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                counts = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(counts), pa.string()), part.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())],
                    ["version", "digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(mine).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return given.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
