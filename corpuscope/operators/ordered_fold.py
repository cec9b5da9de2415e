"""Exact sequential folds per key, run in parallel.

Some rules depend on every earlier decision (a limiter that does not count refusals).  The rows
are range-partitioned by (key, time), so a hot key is spread over many tasks, and each task folds
its rows as a stream with a small state per key.  Only the key that crosses a partition boundary
needs the state of the partition before.  Those states - one for each partition - are
passed on until none changes; then every decision equals that of one sequential pass.
"""

import pickle
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from corpuscope.sources.io import reliable_checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sliding_step(state, at, limit, window_us):
    """Sliding-window limiter: state = times of the accepted attempts still in the window; below zero is no limit."""
    if limit < 0:
        return state, (True, None, 0)
    live = tuple(t for t in state if t >= at - window_us)
    if len(live) >= limit:
        wait = -(-(live[0] + window_us - at) // 1_000_000)
        return live, (False, 0, max(1, wait))
    return (*live, at), (True, limit - len(live) - 1, 0)


def limit_step(limit: int, window_us: int):
    """The limiter with one rule for all keys."""

    def step(state, at):
        return sliding_step(state, at, limit, window_us)

    return step


def _fold(frames, step, carry, on_rows, on_end, given=()):
    key, state, pid, first = None, (), None, True
    first_key = None
    for frame in frames:
        results = []
        for k, at, p, *rule in zip(frame["_k"], frame["_at"], frame["_pid"], *(frame[c] for c in given)):
            if first:
                first, pid, key, first_key = False, p, k, k
                held = carry.get(p)
                state = held[1] if held and held[0] == k else ()
            elif k != key:
                key, state = k, ()
            state, out = step(state, at, *rule)
            results.append(out)
        yield from on_rows(frame, results)
    if not first:
        yield from on_end(pid, first_key, key, state)


def ordered_fold(rows: DataFrame, key: str, at: str, tie: str, step, partitions: int | None = None, given: tuple[str, ...] = (),
                 results: str = "allowed boolean, remaining bigint, retry_after bigint", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Fold ``step`` over each key's rows in time order.

    ``step(state, micros, *given) -> (state, values of the columns results)``; ``given`` names columns whose
    numbers are never null.  A state may be any value that pickles; the first is ``()``.
    ``keep`` names the columns of ``rows`` that the result holds (all, if left out)."""
    placed = rows.withColumn("_k", F.col(key).cast("string")).withColumn(
        "_at", F.unix_micros(F.col(at).cast("timestamp"))
    )
    # Without a number the session's shuffle settings (and AQE's target size) decide.
    order = ["_k", at, tie]  # not by _at, which a change of clocks can set back
    ranged = placed.repartitionByRange(partitions, *order) if partitions else placed.repartitionByRange(*order)
    cut = reliable_checkpoint(ranged.sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))

    def ends(carry, only):
        def run(frames):
            def last(pid, first_key, key, state):
                yield pd.DataFrame({"pid": [pid], "first_key": [first_key], "key": [key], "state": [pickle.dumps(state)]})

            return _fold(frames, step, carry, lambda f, r: iter(()), last, given)

        rows_ = cut.select("_k", "_at", "_pid", *given)
        if only is not None:
            rows_ = rows_.where(F.col("_pid").isin(only))
        summary = rows_.mapInPandas(
            run, "pid int, first_key string, key string, state binary"
        )
        # One row per partition, whatever the size of the data.
        return {r.pid: (r.first_key, r.key, pickle.loads(r.state)) for r in summary.collect()}

    carry: dict[int, tuple[str, tuple]] = {}
    done, changed = {}, None
    while changed is None or changed:
        done.update(ends(carry, changed))
        pids = sorted(done)
        handed = {b: done[a][1:] for a, b in zip(pids, pids[1:]) if done[a][1] == done[b][0]}
        # Only partitions that are now handed another state are folded again.
        changed = [p for p in handed if handed[p] != carry.get(p)]
        carry = handed

    names = [column.split()[0] for column in results.split(", ")]

    def emit(frames):
        def attach(frame, values):
            out = frame[kept].copy()
            for i, name in enumerate(names):
                out[name] = [v[i] for v in values]
            yield out

        return _fold(frames, step, carry, attach, lambda *a: iter(()), given)

    kept = rows.columns if keep is None else list(keep)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema.fields)
    return cut.select(*dict.fromkeys([*kept, *given, "_k", "_at", "_pid"])).mapInPandas(emit, f"{columns}, {results}")
