"""All result tables of an audit, replaced together.

A table lies in folders ``<table>/version=<v>/_bucket=<b>``, and a manifest says which version of each bucket
counts.  Publishing writes new versions of the buckets that it touches and then one manifest, which takes its number by a rename:
until then readers see the audits as they were, all tables of them, and a run that dies leaves only folders that no manifest names.
"""

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.sources.io import materialize

FOLDERS = 64


class Conflict(Exception):
    """Another run published since this one began; nothing was changed."""


def _files(spark: SparkSession, path: str):
    """The store's file system and a function that names paths in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, path)
    folder = at(f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[str, dict[int, str]]]:
    """Number and {table: {bucket: version}} of a manifest, the newest unless named; 0 and nothing where none is.

    It has as many entries as tables and buckets at most, whatever the size of the results."""
    numbers = _numbers(spark, path)
    if number is None:
        number = numbers[-1] if numbers else 0
    if number == 0:
        return 0, {}
    row = spark.read.text(f"{path}/manifests/{number:012}.json").first()
    return number, {t: {int(b): v for b, v in buckets.items()} for t, buckets in json.loads(row[0]).items()}


def _commit(spark: SparkSession, path: str, number: int, tables: dict) -> None:
    """Write a manifest under a name of its own and rename it; a number that exists is not replaced."""
    files, at = _files(spark, path)
    draft, final = at(f"{path}/manifests/.{uuid.uuid4().hex}"), at(f"{path}/manifests/{number:012}.json")
    out = files.create(draft)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(final), plain)
    except Exception as failed:
        files.delete(draft, False)
        if files.exists(final):
            raise Conflict(f"{path}: {number} was published meanwhile") from failed
        raise


def publish(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, list[str]]], audits: DataFrame,
            partition: str = "audit_id", folders: int = FOLDERS) -> int:
    """Make ``tables`` (rows and their keys within an audit) the results of the listed ``audits`` (one column); the manifest's number.

    Rows of other audits stay.  Rows of audits that are not listed are left out, and of rows with equal keys one stays.  An
    audit without rows in a table loses those it had there; a table that is not named stays as it is.  Two runs that publish at once
    are told apart by the number: the later one raises ``Conflict`` and can run again.  The rename decides on HDFS and
    other stores where it does not replace a file."""
    number, counted = manifest(spark, path)
    version, bucket = f"{number + 1}-{uuid.uuid4().hex}", F.pmod(F.xxhash64(partition), F.lit(folders)).cast("int")
    listed = materialize(audits.select(F.col(audits.columns[0]).alias(partition)).distinct().withColumn("_bucket", bucket))
    touched = {r[0] for r in listed.select("_bucket").distinct().collect()}  # ``folders`` at most
    after = {t: dict(buckets) for t, buckets in counted.items()}
    for name, (df, keys) in tables.items():
        rows = df.dropDuplicates([partition, *keys]).join(listed, partition, "left_semi").withColumn("_bucket", bucket)
        before = after.get(name, {})
        if (old := _read(spark, path, name, {b: v for b, v in before.items() if b in touched})) is not None:
            stay = old.join(listed, partition, "left_anti").withColumn("_bucket", bucket)
            rows = rows.unionByName(stay, allowMissingColumns=True)
        folder = f"{path}/{name}/version={version}"
        rows.repartitionByRange("_bucket", partition, *keys).write.partitionBy("_bucket").parquet(folder)
        files, at = _files(spark, path)
        made = {int(n.partition("=")[2]): version for s in files.listStatus(at(folder)) if (n := s.getPath().getName()).startswith("_bucket=")}
        after[name] = {b: v for b, v in before.items() if b not in touched} | made
    _commit(spark, path, number + 1, after)
    return number + 1


def _read(spark: SparkSession, path: str, name: str, buckets: dict[int, str]) -> DataFrame | None:
    if not buckets:
        return None
    folders = [f"{path}/{name}/version={v}/_bucket={b}" for b, v in sorted(buckets.items())]
    return spark.read.option("mergeSchema", len(set(buckets.values())) > 1).parquet(*folders)


def results(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame | None:
    """A table as the newest manifest has it, or an earlier one; None where it has no rows.

    To read several tables of the same moment, name the same number for all."""
    return _read(spark, path, name, manifest(spark, path, number)[1].get(name, {}))


def clean(spark: SparkSession, path: str, keep: int = 2, hours: float = 24) -> list[str]:
    """Delete versions that none of the last ``keep`` manifests names, and older manifests; the folders that went.

    Folders younger than ``hours`` stay, because a run that still writes may be about to name them."""
    numbers, (files, at) = _numbers(spark, path), _files(spark, path)
    named = {(t, v) for n in numbers[-keep:] for t, buckets in manifest(spark, path, n)[1].items() for v in buckets.values()}
    for n in numbers[:-keep]:
        files.delete(at(f"{path}/manifests/{n:012}.json"), False)
    gone = []
    for table in files.listStatus(at(path)):
        name = table.getPath().getName()
        for folder in files.listStatus(table.getPath()) if name != "manifests" else ():
            version = folder.getPath().getName().removeprefix("version=")
            if (name, version) not in named and folder.getModificationTime() <= (time.time() - hours * 3600) * 1000:
                files.delete(folder.getPath(), True)
                gone.append(f"{name}/version={version}")
    return gone
