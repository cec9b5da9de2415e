"""Exact k-means in integers: bounds for each vector, and Shallot search where they don't decide."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import stored
from corpuscope.sources.io import drop_stored

#: Components beyond this are set to it, so that a squared distance fits into 64 bits.
MOST = 1 << 27
#: Distances come from square roots; bounds decide only beyond this relative difference, integers below it.
SLACK = 1e-9
STATE = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int32())), ("nearest", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()),
                   ("lower", pa.float64()), ("distance", pa.int64()), ("cluster", pa.int32()), ("members", pa.int64()), ("sums", pa.list_(pa.int64()))])
STATE_DDL = ("vec_id long, vector array<int>, nearest int, second int, upper double, lower double, distance long, cluster int, members long, sums array<long>")


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids with what a round needs of them: their distances, and the others of each in order."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places, k = places, len(places)
        apart = np.sqrt(np.array([squared(places, p) for p in places]).astype(float)).reshape(k, k)
        others = np.where(np.eye(k, dtype=bool), -1.0, apart)  # each is first in its own row
        self.order = np.argsort(others, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(1, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(squared(places, before).astype(float))
        self.moved = moved
        if k > 1:  # the farthest move among the other centroids
            first, runner = np.argsort(moved)[::-1][:2]
            self.others_moved = np.where(np.arange(k) == first, moved[runner], moved[first])
        else:
            self.others_moved = np.zeros(1)

    def assign(self, x: np.ndarray, nearest, second, upper, lower):
        """New (nearest, second, upper, lower) of vectors, given those of the centroids before they moved.

        Upper bounds the distance to the nearest centroid, lower that to every other.  Where they and half
        the way to the next centroid leave the nearest in doubt, its distance is taken anew, and then the rest
        of the vectors are searched."""
        upper = upper + self.moved[nearest]
        lower = np.maximum(lower - self.others_moved[nearest], 0.0)
        safe = np.maximum(lower, self.half[nearest])
        doubt = np.flatnonzero(~(upper * (1 + SLACK) < safe * (1 - SLACK)))
        upper[doubt] = np.sqrt(squared(x[doubt], self.places[nearest[doubt]]).astype(float))
        doubt = doubt[~(upper[doubt] * (1 + SLACK) < safe[doubt] * (1 - SLACK))]
        if len(doubt) and len(self.places) > 1:
            nearest[doubt], second[doubt], d1, d2 = self.search(x[doubt], nearest[doubt], second[doubt])
            upper[doubt], lower[doubt] = np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))
        elif len(self.places) == 1:
            lower[:] = np.inf
        return nearest, second, upper, lower

    def search(self, x, nearest, second):
        """The two nearest centroids of each vector and their squared distances; of equal ones the smaller number is nearer.

        The scan begins at the nearer of the two that the vector remembers and follows that centroid's
        neighbours in order.  Whatever is as near as the second best lies within the distance to that
        centroid plus the second best; this ball shrinks as better ones are found, and the scan ends at its edge."""
        d1, d2 = squared(x, self.places[nearest]), squared(x, self.places[second])
        swap = (d2 < d1) | ((d2 == d1) & (second < nearest))
        a, b = np.where(swap, second, nearest), np.where(swap, nearest, second)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, first = a.copy(), b.copy()
        for c in np.unique(start):
            at = np.flatnonzero(start == c)
            reach = np.sqrt(d1[at].astype(float))
            for j, gap in zip(self.order[c][1:], self.apart[c][1:]):
                inside = gap * (1 - SLACK) <= (reach + np.sqrt(d2[at].astype(float))) * (1 + SLACK)
                at, reach = at[inside], reach[inside]
                if not len(at):
                    break
                new = at[first[at] != j]  # the other remembered one is known
                d = squared(x[new], self.places[j])
                closer = (d < d1[new]) | ((d == d1[new]) & (j < a[new]))
                up, mid = new[closer], new[~closer & ((d < d2[new]) | ((d == d2[new]) & (j < b[new])))]
                b[up], d2[up] = a[up], d1[up]
                a[up], d1[up] = j, d[closer]
                b[mid], d2[mid] = j, squared(x[mid], self.places[j])
        return a, b, d1, d2


def step(centroids: np.ndarray, before: np.ndarray | None, last: bool):
    """One round over batches of state rows; then one row for each cluster with the number and sum of this task's members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (k, dims) = Centroids(centroids, before), centroids.shape
        members, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            batch = batch.filter(pc.is_null(batch.column("cluster")))
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
            state = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("nearest", "second", "upper", "lower")]
            nearest, second, upper, lower = at.assign(x, *state)
            np.add.at(members, nearest, 1)
            np.add.at(sums, nearest, x)
            distance = pa.array(squared(x, centroids[nearest])) if last else pa.nulls(len(x), pa.int64())
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            vector = pa.nulls(len(x), pa.list_(pa.int32())) if last else batch.column("vector")
            yield pa.record_batch([batch.column("vec_id"), vector, *(pa.array(c, f.type) for c, f in zip((nearest, second, upper, lower), list(STATE)[2:6])),
                                   distance, *none], schema=STATE)
        used = np.flatnonzero(members)
        rows = [(None, None, None, None, None, None, None, int(c), int(members[c]), sums[c].tolist()) for c in used]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [()] * len(STATE), STATE)], schema=STATE)

    return run


def totals(state: DataFrame) -> list:
    """Number and sum of the vectors of each non-empty cluster; rows and numbers are bounded by clusters and components."""
    parts = state.where("cluster is not null")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part").alias("total"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"]).alias("sums"))
    return parts.groupBy("cluster").agg(F.sum("members").alias("members")).join(sums, "cluster").collect()


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Nearest of ``clusters`` centroids for every vector after ``rounds`` rounds of k-means in exact integers.

    Components become floor(scale * x).  The first centroids are the vectors with the smallest hashes of
    seed and id.  Each vector keeps its nearest and second-nearest centroid and two bounds from round to round;
    most vectors keep their centroid by the bounds alone, and the others are searched as ``Centroids.search``
    says.  A round reads and writes the vectors where they lie, without a shuffle; tasks send one row for each
    cluster, and the centroids (``clusters`` times ``dims`` numbers) are all that the driver holds.

    Only vectors of ``dims`` components, none of them null or not finite, are kept.  Components beyond ``MOST``
    count as that.  Null ids hash as empty and come back null; repeated rows are vectors of their own, and among
    equal hashes the smaller vector is the earlier centroid; with fewer vectors than ``clusters`` each is a centroid;
    an empty table gives no rows; an inertia that no long holds is null; other columns are not read.
    Result: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & finite).select("vec_id", whole.alias("vector"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("vector", rank.alias("rank")).orderBy("rank", "vector").limit(clusters).collect()  # bounded by the clusters
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dims)
    none = lambda kind: F.lit(None).cast(kind)
    state = kept.select("vec_id", "vector", F.lit(0).alias("nearest"), F.lit(min(1, max(len(first) - 1, 0))).alias("second"), F.lit(float("inf")).alias("upper"),
                        F.lit(0.0).alias("lower"), none("long").alias("distance"), none("int").alias("cluster"), none("long").alias("members"), none("array<long>").alias("sums"))
    before = None
    for n in range(rounds + 1 if first else 0):
        old, state = state, stored(state.mapInArrow(step(centroids, before, n == rounds), STATE_DDL))
        if n:
            drop_stored(old)
        if n < rounds:
            before, centroids = centroids, centroids.copy()
            for r in totals(state):
                centroids[r["cluster"]] = np.array(r["sums"], np.int64) // r["members"]
    rows = state.where("cluster is null").select("vec_id", F.col("nearest").alias("cluster"), "distance")
    inertia = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    overall = inertia.agg(F.try_sum("cluster_inertia"), F.count_if(F.col("cluster_inertia").isNull())).first()  # two numbers
    names = digests_of(vectors, centroids).join(inertia.withColumnRenamed("cluster", "number"), "number")
    total = F.lit(overall[0] if not overall[1] else None).cast("long")
    return rows.join(F.broadcast(names), F.col("cluster") == F.col("number")).select(  # one row for each cluster
        F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def digests_of(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    rows = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    return vectors.sparkSession.createDataFrame(rows, "number int, places string").select("number", F.sha2("places", 256).alias("centroid_sha256"))
