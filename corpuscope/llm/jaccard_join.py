"""Join of documents whose sets of word n-grams overlap, by size-banded tiles and bitmap signatures."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.arrays import MIX, MIX2, U64, buffer_of, mixed, shingle_sets, words_of
from corpuscope.llm.common import stored
from corpuscope.llm.components import block_pairs, components
from corpuscope.llm.dealing import answers_of, count_keys, deal_texts, parts_of, table_of

KEY_BITS = 40
#: Bits of a signature; a bit is on when an odd number of shingles fall on it.
SIGNATURE_BITS = 1024
#: Parts for each shuffle partition: sets take several times the memory of their texts.
FOLD = 2
#: Largest block of a tile, and rounds that link sets by trees before all pairs that are still open.
BLOCK, FORESTS = 1024, 2

PROFILE = pa.schema([
    ("doc_id", pa.int64()), ("print_of_text", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("shingles", pa.binary()), ("signature", pa.binary()),
    ("prefix", pa.list_(pa.int64()))])

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    sums = [int(mixed(shingles, by).sum(dtype=U64)) for by in (MIX, MIX2)]
    return b"".join(int(s).to_bytes(8, "little") for s in sums) + len(shingles).to_bytes(6, "little")


def signature(shingles: np.ndarray) -> bytes:
    odd = np.bincount((shingles % U64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def prefix_length(n, percent: int):
    """How many of the first shingles, in any order that all sets share, two linked sets meet in."""
    return n + (-percent * n // 100) + 1


def linked(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def could_link(n_a, n_b, differing, percent: int):
    """Whether sizes and differing signature bits leave room for a link: each bit needs a shingle that
    only one set has, so the overlap is at most half of what remains."""
    most = np.minimum((n_a + n_b - differing) // 2, np.minimum(n_a, n_b))
    return linked(most, n_a, n_b, percent)


def common(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted arrays of distinct shingles."""
    return len(np.intersect1d(np.frombuffer(a, U64), np.frombuffer(b, U64), assume_unique=True))


def key_of(shingles: np.ndarray) -> np.ndarray:
    return mixed(shingles, MIX2) >> U64(64 - KEY_BITS)


def in_place(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each key its value, from the values of the distinct keys in order."""
    order = np.argsort(keys)
    keys = keys[order]
    number = np.zeros(len(keys), np.int32)
    np.cumsum(keys[1:] != keys[:-1], out=number[1:])
    out = np.empty(len(keys), values.dtype)
    out[order] = values[number]
    return out


def distinct_sets(table: pa.Table, size: int):
    """Sets of a part's texts: their ids by row, and each distinct one."""
    ids, sets = [], {}
    for shingles in shingle_sets(*words_of(*buffer_of(table.column("text"))), size):
        own = set_id(shingles)
        ids.append(own)
        sets.setdefault(own, shingles)
    return ids, sets


def print_of(text_col: str):
    """Tells rows of equal id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def profiles(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: print_of_text (xxhash64), n_shingles and set_id, and for one document of each set in a part
    that may have partners also the sorted shingles, the signature and the prefix.

    The prefix comes from one order for all sets: rarer shingles (by the number of sets that hold
    them, in powers of two) first, then by hash.  A shingle that no other set has can't be the one
    that two sets meet in, so it is left out, and a set without others has no partner."""
    dealt = deal_texts(docs, id_col, text_col, print_of(text_col).alias("print_of_text"), fold=FOLD)

    def keys_of(table: pa.Table):
        _, sets = distinct_sets(table, size)
        keys = key_of(np.concatenate(list(sets.values()) or [np.zeros(0, U64)]))
        found, counts = np.unique(keys, return_counts=True)
        return found, counts.astype(U64)

    classes = count_keys(dealt, keys_of, KEY_BITS, lambda sums: np.ceil(np.log2(np.maximum(sums, 1))).astype(U64))

    def describe(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sets = distinct_sets(table, size)
        ranks = in_place(key_of(np.concatenate(list(sets.values()) or [np.zeros(0, U64)])), answers_of(answers).astype(np.uint8))
        cuts = np.cumsum([len(s) for s in sets.values()])
        rarity, rows, told = dict(zip(sets, np.split(ranks, cuts[:-1]))), [], set()
        for doc_id, text_print, own in zip(table.column("doc_id").to_pylist(), table.column("print_of_text").to_pylist(), ids):
            shingles = sets[own]
            row = (doc_id, text_print, len(shingles), own if len(shingles) else None, None, None, None)
            if len(shingles) and own not in told:
                told.add(own)
                rank = rarity[own]
                first = np.lexsort((shingles, rank))[:prefix_length(len(shingles), percent)]
                if len(meet := shingles[first][rank[first] > 0]):
                    row = (*row[:4], shingles.tobytes(), signature(shingles), meet.view(np.int64))
            rows.append(row)
        return table_of(rows, PROFILE)

    return dealt.groupBy("part").cogroup(classes.groupBy("part")).applyInArrow(
        describe, "doc_id long, print_of_text long, n_shingles long, set_id binary, shingles binary, signature binary, prefix array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b), each once, whose sets are linked, as a table.

    Signatures bound the overlap from above; only what they leave open fetches the sorted arrays."""
    def check(batches):
        for batch in batches:
            keep = [linked(common(x, y), len(x) // 8, len(y) // 8, percent)
                    for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def bound(batches):
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b")]
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = could_link(n_a, n_b, np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda columns, x: sets.select(F.col("set").alias(x), *(F.col(c).alias(f"{n}_{x}") for c, n in columns.items()))
    light, heavy = {"n_shingles": "n", "signature": "sig"}, {"shingles": "shingles"}
    left_open = stored(pairs.join(side(light, "a"), "a").join(side(light, "b"), "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).mapInArrow(bound, "a long, b long"))
    return stored(left_open.join(side(heavy, "a"), "a").join(side(heavy, "b"), "b").mapInArrow(check, "a long, b long"))


def with_labels(rows: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """The rows and the label of the set in column ``by``; a set without links is its own."""
    named = labels.select(F.col("node").alias(by), F.col("label").alias("_label"))
    return rows.join(named, by, "left").select(*rows.columns, F.coalesce("_label", by).alias("label"))


def open_pairs(named: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of sets in one tile and tree that have different labels and whose signatures leave room for a link.

    With ``forest`` a task takes each pair for a link at once and leaves out those that it then joins
    already, the nearest first: a group of near copies gives about one pair for each member."""
    tile_of, parts = ["shingle", "band", "tree"], parts_of(sets.sparkSession)
    bits = sets.select("set", "n_shingles", "signature")
    apart = named.groupBy(*tile_of).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(*tile_of)
    rows = stored(named.join(apart, tile_of))  # a plan of its own: what follows names it twice
    cut = block_pairs(rows, tile_of, "set", BLOCK).join(bits, "set")
    tile = F.xxhash64(*tile_of, "block_a", "block_b")
    members = cut.select(F.pmod(tile, F.lit(parts)).alias("task"), tile.alias("tile"), F.col("block_a").alias("low"),
                         F.col("block_b").alias("high"), "block", "set", "label", "n_shingles", "signature")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        names, n = table.column("set").to_pylist(), table.column("n_shingles").to_numpy()
        bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(names), -1).view(U64)
        tile, block, low, high = (table.column(c).to_numpy() for c in ("tile", "block", "low", "high"))
        _, group = np.unique(table.column("label").to_numpy(), return_inverse=True)
        root, pairs = np.arange(group.max() + 1), set()
        for i, end in enumerate(np.searchsorted(tile, tile, "right")):
            rest = np.arange(i + 1, end)
            rest = rest[(root[group[rest]] != root[group[i]]) & ((low[i] == high[i]) | (block[rest] != block[i]))]
            if not len(rest):
                continue
            differing = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = could_link(n[rest], n[i], differing, percent)
            for j in rest[near][np.argsort(differing[near], kind="stable")]:
                if root[group[i]] != root[group[j]]:
                    pairs.add(tuple(sorted((names[i], names[j]))))
                    if forest:
                        root[root == root[group[j]]] = root[group[i]]
        return table_of(sorted(pairs), PAIRS)

    return members.repartition(parts, "task").groupBy("task").applyInArrow(compare, "a long, b long").distinct()  # few bytes, much work: not to be coalesced


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the sets that have links; the label is the smallest set of all that links join.

    Tiles hold the sets of one size band, and of the next smaller, that have a shingle in their
    prefixes.  Groups of near copies would give all their pairs, so each tile is first linked through
    one member, then through trees of near pairs; what is still apart is compared in full.  A pair that trees left
    out is open only where they took a pair for a link that is none, so only sets of labels that such pairs join go on."""
    width = float(np.log(100 / percent)) if percent < 100 else 1.0
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width)).cast("int")
    tiles = sets.select("set", F.explode(F.array(band, band + 1)).alias("band"), "prefix").select(
        "set", "band", F.explode("prefix").alias("shingle"))
    crowded = tiles.groupBy("shingle", "band").agg(F.count("*").alias("n")).where("n > 1").select("shingle", "band")
    tiles = stored(tiles.join(crowded, ["shingle", "band"]))
    center = tiles.groupBy("shingle", "band").agg(F.min_by("set", F.xxhash64("set")).alias("a"))
    pairs = tiles.join(center, ["shingle", "band"]).where("a <> set").select(
        F.least("a", "set").alias("a"), F.greatest("a", "set").alias("b")).distinct()
    labels = components(verified(pairs, sets, percent))
    named = with_labels(tiles, labels, "set").withColumn("tree", F.lit(0).cast("long"))
    for forest in (*[True] * FORESTS, False):
        near = stored(open_pairs(stored(named), sets, percent, forest))
        new = verified(near, sets, percent)
        if not new.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(new))
        if not forest:
            break
        refuted = stored(with_labels(with_labels(near, labels, "a").withColumnRenamed("label", "x"), labels, "b").where("x <> label").select(
            F.col("x").alias("a"), F.col("label").alias("b")).distinct())
        if refuted.isEmpty():
            break
        trees = components(refuted).select(F.col("node").alias("label"), F.col("label").alias("tree"))
        members = labels.select(F.col("node").alias("set"), "label").union(trees.select(F.col("label").alias("set"), "label")).distinct()
        named = tiles.join(members.join(trees, "label"), "set")
    return labels


def similar_rows(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, print_of_text, n_shingles and group (null without words)."""
    described = stored(profiles(docs, size, percent, id_col, text_col))
    sets = described.where("prefix is not null").select("set_id", "n_shingles", "shingles", "signature", "prefix").dropDuplicates(["set_id"])
    sets = stored(sets.withColumn("set", F.monotonically_increasing_id()))  # numbers are cheaper to join and to compare than ids
    name = lambda number, as_name: sets.select(F.col("set").alias(number), F.col("set_id").alias(as_name))
    labels = linked_sets(sets, percent).join(name("node", "set_id"), "node").join(name("label", "first_id"), "label").select("set_id", "first_id")
    return described.select("doc_id", "print_of_text", "n_shingles", "set_id").join(labels, "set_id", "left").select(
        "doc_id", "print_of_text", "n_shingles", F.coalesce("first_id", "set_id").alias("group"))


def join_similar(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of ``size``-word shingles link, directly or by others.

    Words are runs of visible characters with A-Z lowered; a text of fewer words is one shingle.  Two
    sets link when their intersection is at least ``percent`` per cent of their union, exactly.

    Null texts and texts without words have no shingles and link with nothing.  Equal sets are one
    member of a tile, so copies cost nothing there.  Null ids never name a group unless it has no
    other; repeated rows are in one group; an empty table gives no rows; other columns are not read.
    Result: id, n_shingles, component_id (smallest id of the group).
    """
    grouped = similar_rows(docs, size, percent, id_col, text_col)
    first = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    return grouped.join(first, "group", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
