"""Join helpers."""

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], spread_on: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with a table that holds one row per key.

    A key may own a third of all rows, so each row also carries a salt and the table is repeated
    once per salt: a hot key is shared by SALTS tasks.  When Spark finds the repeated table below its
    broadcast threshold it broadcasts it instead, and nothing is shuffled.  The salts are joined to the
    table, not exploded in it: Spark's size of an exploded table leaves out the copies, so that it
    would broadcast a table SALTS times its threshold through the driver.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(SALTS)))
    salts = dim.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({n}L)" for n in range(SALTS)) + " AS s(_salt)")
    right = dim.crossJoin(F.broadcast(salts))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
