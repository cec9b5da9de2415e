"""Near-duplicate vectors by spherical-cap filters of structured random product codes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.components import block_pairs, components
from corpuscope.llm.dealing import parts_of, table_of
from corpuscope.sources.io import materialize, reliable_checkpoint

#: Largest block of a filter's vectors that one comparison takes.
BLOCK = 2048
#: By how much a vector with too few filters lowers its bound at a time.
STEP = 0.02
FILED = pa.schema([("node", pa.string()), ("label", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("filters", pa.list_(pa.int32()))])
LINKS = pa.schema([("node", pa.string()), ("n", pa.int64()), ("a", pa.string()), ("b", pa.string())])


class ProductCode:
    """Filter directions that are sums of one direction from each of ``blocks`` random codes.

    A random rotation comes first, then each block of coordinates has ``directions`` directions of its
    own on a smaller sphere.  A direction of the whole is one choice for each block, so there are
    ``directions`` ** ``blocks`` of them, and those near a vector are listed without looking at all."""

    def __init__(self, dims: int, blocks: int, directions: int, seed: int):
        random = np.random.default_rng([seed, dims])
        self.rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0]
        self.edges = np.linspace(0, dims, blocks + 1).astype(int)
        self.codes, self.directions = [], directions ** blocks
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            code = random.standard_normal((directions, b - a))
            self.codes.append(code / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-300) * np.sqrt((b - a) / dims))

    def exceeding(self, vectors: np.ndarray, least: float, fewest: int) -> list[np.ndarray]:
        """For each unit vector the numbers of all directions whose product with it is ``least`` or more.

        A vector that finds fewer than ``fewest`` lowers its own bound until it has them.  Blocks are added one at a time; a beginning is dropped when even the best rest can't reach."""
        turned = vectors @ self.rotation
        products = [turned[:, a:b] @ code.T for a, b, code in zip(self.edges[:-1], self.edges[1:], self.codes)]
        best_rest = np.cumsum([p.max(axis=1) for p in products[::-1]], axis=0)[::-1]
        out = []
        for i in range(len(vectors)):
            bound = min(least, best_rest[0][i])
            while True:
                numbers, sums = np.zeros(1, np.int64), np.zeros(1)
                for j, p in enumerate(products):
                    rest = best_rest[j + 1][i] if j + 1 < len(products) else 0.0
                    total = sums[:, None] + p[i]
                    x, y = np.nonzero(total + rest >= bound)
                    numbers, sums = numbers[x] * p.shape[1] + y, total[x, y]
                if len(numbers) >= min(fewest, self.directions):
                    break
                bound -= STEP
            out.append(np.sort(numbers).astype(np.int32))
        return out


def units(full: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by the largest number first, lest squares overflow."""
    full = full.astype(np.float64)
    full /= np.abs(full).max(axis=1, keepdims=True)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def file_vectors(classes: DataFrame, code: dict, least: float, fewest: int, kind: str) -> DataFrame:
    """Vectors, as bytes of the given kind of number, with all the filters that they exceed."""
    def file(batches):
        made: dict[int, ProductCode] = {}
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            rows = list(zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("copies").to_pylist()))
            for dims in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == dims]
                full = np.array([vectors[i] for i in at], dtype=kind)
                if dims not in made:
                    made[dims] = ProductCode(dims, min(code["blocks"], dims), code["directions"], code["seed"])
                lists = made[dims].exceeding(units(full), least, fewest)
                yield table_of([(*rows[i], v.tobytes(), f) for i, v, f in zip(at, full, lists)], FILED).to_batches()[0]

    return classes.mapInArrow(file, "node string, label long, copies long, vector binary, filters array<int>")


def compare(least: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        """Links found in each block pair of each filter; a link counts in the smallest filter of both."""
        table = table.sort_by("tile")
        nodes, copies = table.column("node").to_pylist(), table.column("copies").to_numpy()
        tile, number, block, low, high = (table.column(c).to_numpy() for c in ("tile", "filter", "block", "low", "high"))
        vectors, lists = table.column("vector").to_pylist(), table.column("filters").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1), len(nodes)]
        rows = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            sizes = np.array([len(v) for v in vectors[x:y]])
            for width in np.unique(sizes) if y - x > 1 else ():
                at = x + np.flatnonzero(sizes == width)
                full = units(np.frombuffer(b"".join(vectors[i] for i in at), kind).reshape(len(at), -1))
                counted, joined = np.zeros(len(at), np.int64), np.arange(len(at))
                for s in range(0, len(at), 512):
                    p, q = np.nonzero(full[s:s + 512] @ full[s:].T >= least)
                    p, q = p + s, q + s
                    keep = (p < q) & ((low[at[p]] == high[at[p]]) | (block[at[p]] != block[at[q]]))
                    for i, j in zip(p[keep], q[keep]):
                        if first_common(lists[at[i]], lists[at[j]]) == number[at[i]]:
                            counted[i] += copies[at[j]]
                            counted[j] += copies[at[i]]
                            rows += unite(joined, nodes, at, i, j)
                rows += [(nodes[at[i]], int(n), None, None) for i, n in enumerate(counted) if n]
        return table_of(rows, LINKS)

    return run


def first_common(a: list, b: list) -> int:
    i = j = 0
    while a[i] != b[j]:
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
    return a[i]


def unite(joined: np.ndarray, nodes, at, i: int, j: int) -> list[tuple]:
    """The link of two vectors that no earlier link of this block has joined."""
    def root(v):
        while joined[v] != v:
            joined[v] = joined[joined[v]]
            v = joined[v]
        return v

    a, b = root(i), root(j)
    if a == b:
        return []
    joined[max(a, b)] = min(a, b)
    return [(None, 0, min(nodes[at[i]], nodes[at[j]]), max(nodes[at[i]], nodes[at[j]]))]


def near_duplicates(vectors: DataFrame, least: float = 0.93, blocks: int = 2, directions: int = 96, cap: float = 0.34, fewest: int = 24, seed: int = 7,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal label whose cosine is ``least`` or more, and their groups.

    A vector is filed under every direction of the product code whose product with it reaches ``cap``
    (or a lower bound of its own, if that gives fewer than ``fewest``); vectors meet in common filters, and every pair that meets is compared in double precision, so no
    link below ``least`` is made.  A pair that shares no filter is missed: more ``directions`` or a lower
    ``cap`` raise the share that is found.  Equal vectors of a label are one node with its number of
    copies.  Filters of many vectors are cut into blocks that meet pair by pair, without a limit.

    Null labels, and vectors that are null, empty or zero or hold nulls or numbers that aren't finite
    link with nothing; vectors of different length don't either.  Null ids are carried; repeated rows
    are copies of one another; an empty table gives no rows; other columns are not read.
    Result: id, n_links, component_id, kept.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("embedding"))
    kind = "f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "f8"  # as exact as given
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    node = F.when(usable, F.md5(F.concat_ws(":", F.col("label").cast("string"), F.col("embedding").cast("string"))))
    given = given.select("vec_id", node.alias("node"), "label", "embedding")
    classes = given.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    filed = materialize(file_vectors(classes.select("node", "label", "copies", "embedding"),
                                     {"blocks": blocks, "directions": directions, "seed": seed}, cap, fewest, kind))
    entries = block_pairs(filed.select("node", "label", F.explode("filters").alias("filter")), ["label", "filter"], "node", BLOCK)
    tile = F.xxhash64("label", "filter", "block_a", "block_b")
    crowded = entries.groupBy(tile.alias("tile")).agg(F.count("*").alias("n")).where("n > 1").select("tile")
    met = entries.withColumn("tile", tile).join(crowded, "tile").select(
        F.pmod("tile", F.lit(parts_of(vectors.sparkSession))).alias("task"), "tile", "filter", F.col("block_a").alias("low"),
        F.col("block_b").alias("high"), "block", "node").join(filed.drop("label"), "node")
    found = materialize(met.groupBy("task").applyInArrow(compare(least, kind), "node string, n long, a string, b string"))
    labels = components(found.where("a is not null").select("a", "b").distinct())
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("others"))
    known = classes.select("node", "copies", "first").join(counts, "node", "left").join(labels, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("group"), "first")
    groups = known.groupBy("group").agg(F.min("first").alias("component_id"))
    told = known.join(groups, "group").select("node", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return given.select("vec_id", "node").join(told, "node", "left").select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
