"""Scores of texts under a context-tree-weighting model that is trained on the corpus itself."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.arrays import SEGMENT, U64, buffer_of, distinct, packed, packed_sorted, unpacked, unpacked_sorted, words_of
from corpuscope.llm.context_trees import SHALLOW, Lookup, Shallow, Tree, added, bucket_of, parents, segments, weigh
from corpuscope.llm.dealing import buckets_of, deal_texts, parts_of, table_of
from corpuscope.sources.io import materialize

GRAM, WORD = 0, 1
#: Key of the token that ends every text.
END = U64(0x5851F42D4C957F2D)
BLOCKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOCK_SCHEMA = "kind int, bucket int, part int, keys binary, counts binary"
TOP = pa.schema([("nearest", pa.int32()), *((c, pa.binary()) for c in ("ids", "zeros", "ones", "weighted"))])
NODES = pa.schema([("depth", pa.int32()), *((c, pa.binary()) for c in ("ids", "zeros", "ones", "weighted", "share"))])
TOLD = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def gram_counts(data, offsets, train, depth):
    """Distinct grams of the texts and their counts in the training texts."""
    held = []
    for lo, hi, grams, ends in segments(data, offsets, depth, SEGMENT):
        chosen = np.repeat(train[lo:hi], np.diff(ends))
        seen, times = np.unique(grams[chosen], return_counts=True)
        others = distinct(grams[~chosen])
        hold(held, *added([seen, others], [times.astype(U64), np.zeros(len(others), U64)]))
    return added([k for k, _ in held], [n for _, n in held])


def hold(held: list, keys: np.ndarray, counts: np.ndarray) -> None:
    """Add a block to those held, each more than twice as long as the next: memory follows the
    distinct keys and not the text, and a key is sorted a logarithmic number of times."""
    while held and len(held[-1][0]) <= 2 * len(keys):
        more, n = held.pop()
        keys, counts = added([more, keys], [n, counts])
    held.append((keys, counts))


def word_counts(hashes, places, train):
    """The same of words; the end of a text counts as one."""
    chosen = np.repeat(train, np.diff(places))
    seen, times = np.unique(hashes[chosen], return_counts=True)
    others = distinct(hashes[~chosen])
    return added([seen, others, np.array([END])], [times.astype(U64), np.zeros(len(others), U64), np.array([train.sum()]).astype(U64)])


def gram_order(grams, depth, buckets):
    """Bucket of each gram, and the order by bucket and then by gram."""
    bucket = bucket_of(grams, depth, buckets)
    return bucket, np.argsort(bucket, kind="stable")


def blocks_of(grams, gram_n, words, word_n, part, depth, buckets):
    """One block for each kind and bucket."""
    bucket, order = gram_order(grams, depth, buckets)
    places = np.arange(buckets + 1).astype(U64)
    rows = []
    for kind, keys, counts, cuts in (
        (GRAM, grams[order], gram_n[order], np.searchsorted(bucket[order], places)),
        (WORD, words, word_n, np.searchsorted(buckets_of(words, 64, buckets), places)),
    ):
        rows += [(kind, b, part, packed_sorted(keys[x:y]), packed(counts[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
    return rows


def merged(table: pa.Table):
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    return added([unpacked_sorted(x) for x in keys], [unpacked(x) for x in counts])


def score_texts(docs: DataFrame, folds: int = 7, held_fold: int = 2, depth: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text under a model of the training texts.

    A text is in training unless crc32 of its id as text, modulo ``folds``, is ``held_fold``.  The model
    predicts each byte and the end of the text, bit by bit, from up to ``depth`` bytes before it:
    Krichevsky-Trofimov estimates of all context lengths, mixed by context-tree weighting.

    1. Tasks count grams (a byte and its context) of their training texts and send distinct ones to
       buckets by the nearest three bytes, so that every longer context is whole in one bucket.
    2. The buckets' trees end in contexts of three bytes; the levels above (bounded by the 65,793
       contexts of up to two bytes) are put together and sent to all tasks.
    3. Parts of the corpus ask the buckets for their own distinct grams and add up the answers.

    Words and their counts for the base score travel the same way.  Null texts are empty and have only
    an end; null ids are in training like an id of empty text; repeated rows are texts of their own;
    an empty table gives no rows; without any training text all counts are 0 and every bit has
    probability 1/2; other columns are not read.  Result: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte (code length, the end counted as a byte).
    """
    spark = docs.sparkSession
    buckets = parts_of(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))
    dealt = deal_texts(docs, id_col, text_col, (fold == held_fold).alias("held_out"))

    def read(table):
        data, offsets = buffer_of(table.column("text"))
        return data, offsets, ~np.array(table.column("held_out").to_pylist(), dtype=bool)

    def count(batches):
        grams, words = ([], []), ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets, train = read(pa.Table.from_batches([batch]))
            hashes, places = words_of(data, offsets)
            for held, found in ((grams, gram_counts(data, offsets, train, depth)), (words, word_counts(hashes, places, train))):
                keep = found[1] > 0
                keys, counts = added([*held[0], found[0][keep]], [*held[1], found[1][keep]])
                held[0][:], held[1][:] = [keys], [counts]
        if grams[0]:
            yield from table_of(blocks_of(grams[0][0], grams[1][0], words[0][0], words[1][0], -1, depth, buckets), BLOCKS).to_batches()

    counted = materialize(dealt.select("text", "held_out").mapInArrow(count, BLOCK_SCHEMA))

    def top(table: pa.Table) -> pa.Table:
        grams, counts = merged(table)
        ids, zeros, ones, weighted = Tree(grams, counts, depth).top
        up = (ids >> U64(16) << U64(8)) | (ids & U64(255))  # contexts of two bytes
        found, inverse = np.unique(up, return_inverse=True)
        sums = [np.bincount(inverse, weights=w, minlength=len(found)) for w in (zeros, ones, weighted)]
        nearest = (found >> U64(16)).astype(np.int64)
        cuts = np.searchsorted(nearest, np.arange(257))
        return table_of([(b, found[x:y].tobytes(), *(s[x:y].tobytes() for s in sums)) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x], TOP)

    def join_top(table: pa.Table) -> pa.Table:
        """Levels two and one of all contexts that end in one byte."""
        columns = {name: np.concatenate([np.frombuffer(x, U64 if name == "ids" else np.float64) for x in table.column(name).to_pylist()])
                   for name in ("ids", "zeros", "ones", "weighted")}
        found, inverse = np.unique(columns["ids"], return_inverse=True)
        zeros, ones, below = (np.bincount(inverse, weights=columns[c], minlength=len(found)) for c in ("zeros", "ones", "weighted"))
        weighted, share = weigh(zeros, ones, below)
        second = (found, zeros, ones, weighted, share)
        return table_of([(d, *(x.tobytes() for x in level)) for d, level in ((2, second), (1, parents(*second[:4])))], NODES)

    tops = counted.where(F.col("kind") == GRAM).groupBy("bucket").applyInArrow(top, "nearest int, ids binary, zeros binary, ones binary, weighted binary")
    nodes = tops.groupBy("nearest").applyInArrow(join_top, "depth int, ids binary, zeros binary, ones binary, weighted binary, share binary").collect()
    model = spark.sparkContext.broadcast(shallow_of(nodes))  # contexts of up to two bytes

    def total(table: pa.Table) -> pa.Table:
        _, counts = merged(table)
        return pa.table({"distinct": pa.array([int((counts > 0).sum())], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64())})

    words_total = counted.where(F.col("kind") == WORD).groupBy("bucket").applyInArrow(total, "distinct long, n long").agg(F.sum("distinct"), F.sum("n")).first()
    vocabulary, train_tokens = (x or 0 for x in words_total)

    def ask(table: pa.Table) -> pa.Table:
        data, offsets, train = read(table)
        none = np.zeros(len(train), dtype=bool)
        grams, zero = gram_counts(data, offsets, none, depth)
        words, word_zero = word_counts(*words_of(data, offsets), none)
        return table_of(blocks_of(grams, zero, words, word_zero, table.column("part")[0].as_py(), depth, buckets), BLOCKS)

    def reply(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        asked = table.filter(pc.greater_equal(table.column("part"), 0))
        if not asked.num_rows:
            return table_of([], TOLD)
        keys, counts = merged(table)
        if kind == GRAM:
            values = Tree(keys, counts, depth).log10_probabilities(model.value, keys >> U64(8 * (depth + 1 - SHALLOW)))
            blob = lambda at: values[at].astype(np.float32).tobytes()
        else:
            blob = lambda at: packed(counts[at])
        return table_of([(p, kind, bucket, blob(np.searchsorted(keys, unpacked_sorted(own))))
                         for p, own in zip(asked.column("part").to_pylist(), asked.column("keys").to_pylist())], TOLD)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets, train = read(table)
        none = np.zeros(len(train), dtype=bool)
        told = told.sort_by("bucket")
        blobs = lambda kind: told.filter(pc.equal(told.column("kind"), kind)).column("blob").to_pylist()
        grams, _ = gram_counts(data, offsets, none, depth)
        _, order = gram_order(grams, depth, buckets)
        known = Lookup(grams[order], np.concatenate([np.frombuffer(x, np.float32) for x in blobs(GRAM)]).astype(np.float64))
        score = np.concatenate([np.add.reduceat(known(g), ends[:-1]) for _, _, g, ends in segments(data, offsets, depth, SEGMENT)])
        hashes, places = words_of(data, offsets)
        words, _ = word_counts(hashes, places, none)
        counts = np.concatenate([unpacked(x) for x in blobs(WORD)])
        of_end = float(counts[np.searchsorted(words, END)])
        own = Lookup(words, counts.astype(np.float64))(hashes)
        scale = np.log10(train_tokens + vocabulary + 1.0)
        sums = np.concatenate([[0.0], np.cumsum(np.log10(own + 1) - scale)])
        hits = np.concatenate([[0], np.cumsum(own > 0)])
        n = len(train)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"),
            "n_tokens": pa.array(np.diff(places) + 1, pa.int64()), "n_known": pa.array(np.diff(hits[places]) + (of_end > 0), pa.int64()),
            "train_tokens": pa.array(np.full(n, train_tokens), pa.int64()),
            "base_score": pa.array(np.diff(sums[places]) + np.log10(of_end + 1) - scale, pa.float64()), "score": pa.array(score, pa.float64()),
            "bits_per_byte": pa.array(-score * np.log2(10) / (np.diff(offsets) + 1), pa.float64())})

    asked = dealt.groupBy("part").applyInArrow(ask, BLOCK_SCHEMA)
    told = asked.unionByName(counted).groupBy("kind", "bucket").applyInArrow(reply, "part int, kind int, bucket int, blob binary")
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    ).withColumnRenamed("doc_id", id_col)


def shallow_of(rows) -> Shallow:
    """The three upper levels from the rows of levels two and one; the root's nodes are made here."""
    levels = {}
    for depth in (2, 1):
        own = [r for r in rows if r["depth"] == depth]
        columns = [np.concatenate([np.frombuffer(r[c], U64 if c == "ids" else np.float64) for r in own]) if own else np.zeros(0, U64 if c == "ids" else float)
                   for c in ("ids", "zeros", "ones", "weighted", "share")]
        order = np.argsort(columns[0])
        levels[depth] = [c[order] for c in columns]
    levels[0] = parents(*levels[1][:4])
    return Shallow({d: (ids, zeros + ones, ones, share) for d, (ids, zeros, ones, _, share) in levels.items()})
