"""Prefix trie of conversations, built as burst tries: oversized containers burst by their next turn, the rest are sorted and swept."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import SPACE_WORD, stored
from corpuscope.llm.dealing import table_of

#: Bytes of a turn's id, and turns that a container holds before it bursts.
ID, CONTAINER_TURNS = 16, 20_000
#: Conversations in a group that share a beginning, and turns of it that one of them takes at most.
GROUP, LONGEST_HEAD = 20, 3
#: Rows that a task sends at a time.
BATCH = 4096

CHUNK = pa.schema([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
NODE = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("container", pa.string())])
NODE_DDL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, container string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, key, seq, words): each conversation with the beginning that its group shares, as ids of turns.

    Texts stay where they are; a turn moves as the digest of its role and text with its number of words.  One
    shuffle by group serves both the gathering of conversations and the join with the group's first one."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    conv = F.col(id_col).cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % GROUP).alias("base"), conv.alias("conv_id"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.regexp_count(text, F.lit(f"({SPACE_WORD})")).cast("int").alias("words"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns"))
    heads = own.where("conv_id = base").select(F.col("base").alias("of"), F.slice("turns", 1, LONGEST_HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).cast("int")
    begun = F.coalesce("head", F.slice("turns", 1, 0))
    whole = own.join(heads, F.col("base") == F.col("of"), "left").select(
        "conv_id", F.concat(F.slice(begun, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    seq = F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), ""))
    return whole.select("conv_id", F.md5(seq).alias("key"), seq.alias("seq"), F.transform("turns", lambda x: x["words"]).alias("words"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows as comma-joined runs of ids."""
    for batch in batches:
        keys, ids, rows, x = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), [], 0
        for y in range(1, len(keys) + 1):
            if y == len(keys) or keys[y] != keys[x]:
                rows.append((keys[x], ids[x], y - x, ",".join(map(str, ids[x:y]))))
                x = y
        yield from table_of(rows, CHUNK).to_batches()


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of key and first id as one digest for each key; only the run at hand is held."""
    key = digest = None
    least = count = 0
    for batch in batches:
        rows = []
        for k, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if digest:
                    rows.append((key, least, count, digest.hexdigest()))
                key, least, count, digest = k, first, n, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
                count += n
        yield from table_of(rows, ENDS).to_batches()
    if digest:
        yield from table_of([(key, least, count, digest.hexdigest())], ENDS).to_batches()


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(seq, words, conv_id, n, ends): each distinct conversation once, with the number of its copies, the smallest id and the digest of all ids.

    Ids are ordered by ranges of key and id, so that even a key of a third of all rows is packed by many
    tasks; what then meets in one place for a key is its packed runs, read as a stream."""
    runs = conversations.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        pack, "key string, first long, n long, ids string")
    ends = runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest_ends, "key string, conv_id long, n long, ends string")
    once = conversations.groupBy("key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"))
    return once.join(ends, "key").select("seq", "words", "conv_id", "n", "ends")


def burst(entries: DataFrame, container_turns: int):
    """(containers that burst, their entries under new heads, entries that stay) or None if all stay.

    A container under ``head`` holds sequences that agree in their first ``depth`` turns.  One that is too large,
    and not a single sequence, gives way to its common beginning and a container for each turn that comes next."""
    past = F.size("words") - F.col("depth")
    sizes = entries.groupBy("head").agg(
        F.count("*").alias("entries"), F.sum(past + 1).alias("turns"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("seq").alias("low"), F.max("seq").alias("high"),
        F.min_by("words", "seq").alias("words"), F.min_by("ends", "seq").alias("ends"), F.first("depth").alias("depth"),
        F.first("parent_conv_id").alias("parent_conv_id"), F.first("parent").alias("parent"))
    shorter = F.least(F.length("low"), F.length("high"))
    differ = F.filter(F.sequence(F.lit(0), (shorter / ID).cast("int") - 1), lambda i: F.col("low").substr(i * ID + 1, F.lit(ID)) != F.col("high").substr(i * ID + 1, F.lit(ID)))
    common = F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_min(differ), (shorter / ID).cast("int")))
    large = stored(sizes.where((F.col("turns") > container_turns) & (F.col("entries") > 1)).withColumn("common", common).select(
        "head", "parent", "depth", "common", "n_convs", "conv_id", "parent_conv_id", "words",
        F.when(F.length("low") == F.col("common") * ID, F.col("ends")).alias("ends")))
    if large.isEmpty():
        return None
    named = large.select(F.col("head").alias("of"), "common", F.col("conv_id").alias("least"))
    met = stored(entries.join(named, F.col("head") == F.col("of"), "left"))
    stay = met.where("of is null").select(entries.columns)
    under = met.where((F.col("of").isNotNull()) & (F.size("words") > F.col("common"))).select(
        F.md5(F.col("seq").substr(F.lit(1), (F.col("common") + 1) * ID)).alias("head"), (F.col("common") + 1).alias("depth"),
        F.col("of").alias("parent"), F.col("least").alias("parent_conv_id"), "seq", "words", "conv_id", "n", "ends")
    return large, under.select(entries.columns), stay


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each container, from its entries in order."""
    held, nodes = [], []
    for batch in batches:
        for row in batch.select(["head", "depth", "parent", "parent_conv_id", "seq", "words", "conv_id", "n", "ends"]).to_pylist():
            if held and row["head"] != held[0]["head"]:
                nodes += nodes_of(held)
                held = []
            held.append(row)
        if len(nodes) >= BATCH:
            yield from table_of(nodes, NODE).to_batches()
            nodes = []
    yield from table_of(nodes + (nodes_of(held) if held else []), NODE).to_batches()


def nodes_of(entries: list[dict]) -> list[tuple]:
    """Sweep of one container: a stack of the nodes that the entry at hand goes through; what it leaves is closed."""
    top, before, path, made = entries[0]["depth"], None, [], []

    def close(depth: int) -> None:
        while len(path) > depth:
            node = path.pop()
            node["leaves"] = node["leaves"] or 1
            node["saved"] += (node["n"] - 1) * node["words"]
            if path:
                up = path[-1]
                up["n"] += node["n"]
                up["least"] = min(up["least"], node["least"])
                up["children"] += 1
                up["leaves"] += node["leaves"]
                up["saved"] += node["saved"]

    for e in entries:
        seq, same = e["seq"], top - 1
        if before is not None:
            same = top
            while seq[same * ID:(same + 1) * ID] == before[same * ID:(same + 1) * ID] != b"":
                same += 1
        close(same + 1 - top)
        for depth in range(same + 1, len(e["words"]) + 1):
            node = {"depth": depth, "up": path[-1] if path else None, "n": 0, "least": e["conv_id"], "children": 0, "leaves": 0, "saved": 0,
                    "words": e["words"][depth - 1] if depth else 0, "ends": NO_ENDS}
            path.append(node)
            made.append(node)
        path[-1]["n"] += e["n"]
        path[-1]["least"] = min(path[-1]["least"], e["conv_id"])
        path[-1]["ends"] = e["ends"]
        before = seq
    close(0)
    return [(x["least"], x["depth"], x["up"]["least"] if x["up"] else entries[0]["parent_conv_id"], x["n"], x["children"], x["leaves"], x["saved"], x["ends"],
             None if x["up"] else entries[0]["parent"]) for x in made]


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the common beginnings of containers that burst; all but the last have one child."""
    for batch in batches:
        for r in batch.to_pylist():
            rows, saved = [], r["saved"]
            for depth in range(r["common"], r["depth"] - 1, -1):
                saved += (r["n_convs"] - 1) * (r["words"][depth - 1] if depth else 0)
                last, first = depth == r["common"], depth == r["depth"]
                rows.append((r["conv_id"], depth, r["parent_conv_id"] if first else r["conv_id"], r["n_convs"], r["children"] if last else 1, r["leaves"], saved,
                             (r["ends"] or NO_ENDS) if last else NO_ENDS, r["parent"] if first else None))
                if len(rows) == BATCH:
                    yield from table_of(rows, NODE).to_batches()
                    rows = []
            yield from table_of(rows, NODE).to_batches()


def prefix_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt with the beginning that its group of ``GROUP`` ids shares.

    1. Conversations become sequences of turn ids; copies become one sequence with a count.
    2. All sequences are one container under the root.  Containers of more than ``container_turns`` turns burst, round
       by round, into one for each next turn; a shared beginning of any length bursts at once.
    3. What remains is dealt to shards by its head, sorted and swept: a task holds one container at a time.
    4. Sums of burst containers are taken from the last round up.

    Null roles and texts are empty; a null turn comes first, and turns of one number are ordered by their digests;
    repeated rows are turns of their own; rows without a conversation id are of none; an empty table has no nodes, not
    even a root; other columns are not read.  Turns are told apart by 128-bit digests.  A single conversation is held
    whole as 16 bytes and a count for each turn, never as text: that is the largest thing one task must hold.
    Result: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    sequences = distinct_sequences(stored(rebuilt(conversations, id_col, turn_col, role_col, text_col)))
    none = lambda kind: F.lit(None).cast(kind)
    open_entries = stored(sequences.select(F.lit("").alias("head"), F.lit(0).alias("depth"), none("string").alias("parent"), none("long").alias("parent_conv_id"), "*"))
    columns, settled, rounds = open_entries.columns, [], []
    while True:
        split = burst(open_entries, container_turns)
        if split is None:
            settled.append(open_entries)
            break
        large, open_entries, stay = split
        rounds.append(large)
        settled.append(stay)
    final = settled[0]
    for more in settled[1:]:
        final = final.unionByName(more)
    swept = stored(final.select(columns).repartition("head").sortWithinPartitions("head", "seq").mapInArrow(sweep, NODE_DDL))
    nodes = [swept]
    for large in reversed(rounds):
        below = swept.where("container is not null")
        if len(nodes) > 1:
            below = below.unionByName(nodes[-1].where("container is not null"))
        sums = below.groupBy(F.col("container").alias("of")).agg(
            F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes.append(stored(large.join(sums, F.col("head") == F.col("of")).drop("of").mapInArrow(chain, NODE_DDL)))
    result = nodes[0]
    for more in nodes[1:]:
        result = result.unionByName(more)
    return result.drop("container")
