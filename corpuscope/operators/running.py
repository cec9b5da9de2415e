"""Running values per key that survive a hot key.

A plain window would sort everything a key owns in one task.  Here the key's rows are cut into
time buckets: a window runs inside each bucket, one row per key and bucket is carried over the
buckets, and the two are combined.  Each task then sees one bucket of one key.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

_WITHIN = {
    "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True),
}


def _total(kind: str, value: Column, order: list[str]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return _WITHIN[kind](value)


def _combine(kind: str, before: Column, within: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(within, F.lit(0))
    if kind == "last":
        return F.coalesce(within, before)
    return (F.least if kind == "min" else F.greatest)(before, within)  # both skip nulls


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple],
    bucket: Column,
) -> DataFrame:
    """Add running ``sum``/``min``/``max``/``last`` columns: name -> (kind, value[, "before"]).

    A value runs up to and including each row; with "before" the row itself is left out.
    ``order`` must be unique per key and agree with ``bucket``."""
    cut = rows.withColumn("_bucket", bucket)
    kinds = {name: v[0] for name, v in values.items()}
    # One shuffle deals the rows for both uses below: Spark runs it once, and the plan above it too.
    cut = cut.withColumns({f"_v_{name}": v[1] for name, v in values.items()}).repartition(*keys, "_bucket")
    by_row = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inside = {n: by_row.rowsBetween(Window.unboundedPreceding, -1 if "before" in v[2:] else Window.currentRow)
              for n, v in values.items()}
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_bucket").agg(
        *[_total(kind, F.col(f"_v_{n}"), order).alias(f"_t_{n}") for n, kind in kinds.items()]
    )
    offsets = totals.select(
        *keys, "_bucket", *[_WITHIN[k](F.col(f"_t_{n}")).over(earlier).alias(f"_o_{n}") for n, k in kinds.items()]
    )
    local = cut.select("*", *[_WITHIN[k](F.col(f"_v_{n}")).over(inside[n]).alias(f"_w_{n}") for n, k in kinds.items()])
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *rows.columns,
        *[_combine(k, F.col(f"_o_{n}"), F.col(f"_w_{n}")).alias(n) for n, k in kinds.items()],
    )


def hour(column: str) -> Column:
    return F.date_trunc("hour", column)


def trailing_count(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Rows of the same key in the last ``seconds`` up to each row.

    Every row is also shown to the following time bucket, so a bucket holds all that its own rows
    look back on, and a hot key is counted bucket by bucket."""
    span = seconds * 1_000_000
    stamped = rows.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    own = F.floor(F.col("_us") / span)
    shown = stamped.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", own + F.col("_shift"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-span, 0)
    return shown.withColumn("attempts", F.count("*").over(w)).where("_shift = 0").select(*rows.columns, "attempts")
