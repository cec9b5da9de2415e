"""Counts of hashed keys over a whole corpus, asked and answered in compact blocks.

Texts are dealt into parts by a hash.  A part sends its distinct keys, with counts, as one block to
each bucket of the key space; a bucket adds up and sends each part the totals of just the keys that
it asked for, in the same order.  Parts and buckets are as many as the session's shuffle partitions,
so their size is set as for any other shuffle.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.llm.arrays import U64, packed, packed_sorted, unpacked, unpacked_sorted

#: Bits of a key that choose its bucket.
DEALT_BITS = 40


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal_texts(docs: DataFrame, id_col: str, text_col: str, *more, fold: int = 1) -> DataFrame:
    """(part, doc_id, text, more) with null texts empty; ``fold`` parts for each shuffle partition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("long"), text), F.lit(fold * parts_of(docs.sparkSession))).cast("int")
    return docs.select(part.alias("part"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *more)


def buckets_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return ((keys >> U64(bits - DEALT_BITS)) * U64(buckets)) >> U64(DEALT_BITS)


def count_keys(dealt: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], bits: int,
               answer: Callable[[np.ndarray], np.ndarray], totals: bool = False) -> DataFrame:
    """Answers (part, bucket, blob) on the keys of each part.

    ``keys_of`` gives a part's distinct keys of ``bits`` bits in order, and how often each occurs;
    ``answer`` turns the totals over all parts into what is sent back.  With ``totals`` each bucket
    also sends (number of keys with a count, sum of counts) to part -1."""
    buckets = parts_of(dealt.sparkSession)

    def send(table: pa.Table) -> pa.Table:
        keys, counts = keys_of(table)
        part = table.column("part")[0].as_py()
        cuts = np.searchsorted(buckets_of(keys, bits, buckets), np.arange(buckets + 1).astype(U64))
        rows = [(part, b, packed_sorted(keys[x:y]), packed(counts[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return table_of(rows, SENT)

    def add(table: pa.Table) -> pa.Table:
        blocks = [unpacked_sorted(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
        found, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(found))
        answers = answer(sums)[inverse]
        ends = np.cumsum([len(b) for b in blocks])
        bucket = table.column("bucket")[0].as_py()
        rows = [(p, bucket, packed(answers[e - len(b):e])) for p, b, e in zip(table.column("part").to_pylist(), blocks, ends)]
        if totals:
            rows.append((-1, bucket, packed(np.array([(sums > 0).sum(), sums.sum()]).astype(U64))))
        return table_of(rows, ANSWER)

    sent = dealt.groupBy("part").applyInArrow(send, "part int, bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "part int, bucket int, blob binary")


SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def answers_of(table: pa.Table) -> np.ndarray:
    """A part's answers in the order of its keys."""
    order = np.argsort(np.array(table.column("bucket").to_pylist(), dtype=np.int64), kind="stable")
    blobs = table.column("blob").to_pylist()
    return np.concatenate([unpacked(blobs[i]) for i in order]) if blobs else np.zeros(0, U64)
