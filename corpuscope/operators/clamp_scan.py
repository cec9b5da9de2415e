"""Running values that stop at bounds, per key, computed as a tree of blocks.

A row maps a value x to ``least(hi, greatest(lo, x + add))``.  Two such steps in a row are again one
such step, so rows combine like the numbers of a sum: blocks of rows become one step each, blocks of
blocks the next level, until a key is a single block.  On the way down each block learns the value it
starts from.  No task holds more of a key than one block, however many rows the key has.
"""

from pyspark.sql import DataFrame, functions as F

BLOCK = 64
#: Stands for "no bound"; real values stay far below.
UNBOUNDED = 1 << 60
_STEP = ("_add", "_lo", "_hi")


def _applied(value: str, step: str) -> str:
    return f"least({step}._hi, greatest({step}._lo, {value} + {step}._add))"


def _blocks(rows: DataFrame, keys: list[str], at: str, block: int) -> DataFrame:
    """One row per key and block: its steps in order, and the one step they amount to."""
    held = F.struct(F.col(at), *[F.col(c) for c in rows.columns if c != at and c not in keys])
    cut = rows.withColumn("_block", F.expr(f"CAST(({at} - 1) DIV {block} AS BIGINT) + 1")).groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(held)).alias("_steps"))
    whole = F.expr(
        f"aggregate(_steps, named_struct('_add', 0L, '_lo', {-UNBOUNDED}L, '_hi', {UNBOUNDED}L), (acc, s) -> named_struct("
        f"'_add', acc._add + s._add, '_lo', {_applied('acc._lo', 's')}, '_hi', {_applied('acc._hi', 's')}))")
    return cut.withColumn("_whole", whole).select(*keys, F.col("_block").alias(at), "_steps", *[F.col(f"_whole.{c}") for c in _STEP])


def clamp_scan(rows: DataFrame, keys: list[str], at: str, add: str, lo: str, hi: str, name: str, start: int = 0, block: int = BLOCK) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_after``: the bounded running value around each row.

    ``at`` numbers a key's rows 1, 2, ... without gaps; ``add``, ``lo`` and ``hi`` are SQL expressions
    of whole numbers.  A reset is ``lo = hi``.  ``rows`` is read once per use, so pass a stored table.
    Keys must not be null; no rows give no rows."""
    steps = rows.withColumns({c: F.expr(f"CAST({e} AS BIGINT)") for c, e in zip(_STEP, (add, lo, hi))})
    levels = [_blocks(steps, keys, at, block)]
    size = -(-(rows.agg(F.max(at)).first()[0] or 0) // block)
    while size > 1:
        levels.append(_blocks(levels[-1].select(*keys, at, *_STEP), keys, at, block))
        size = -(-size // block)
    told = levels[-1].withColumn("_start", F.lit(start).cast("bigint"))
    for lower in levels[-2::-1]:
        starts = _walked(told).select(*keys, F.col(f"_row.{at}").alias(at), F.col("_from").alias("_start"))
        told = lower.join(starts, [*keys, at])
    walked = _walked(told)
    return walked.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns],
        F.col("_from").alias(f"{name}_before"), F.expr(_applied("_from", "_row")).alias(f"{name}_after"))


def _walked(blocks: DataFrame) -> DataFrame:
    """Each step of each block with the value before it."""
    values = F.expr(
        "aggregate(_steps, named_struct('v', _start, 'seen', CAST(array() AS ARRAY<BIGINT>)), (acc, s) -> named_struct("
        f"'v', {_applied('acc.v', 's')}, 'seen', concat(acc.seen, array(acc.v))), acc -> acc.seen)")
    pairs = F.explode(F.arrays_zip(F.col("_steps").alias("_row"), values.alias("_from")))
    return blocks.withColumn("_pair", pairs).select("*", F.col("_pair._row").alias("_row"), F.col("_pair._from").alias("_from"))
