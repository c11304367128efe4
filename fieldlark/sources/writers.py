"""Writing tables, reports and exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.operators.twin import upsert


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrites a table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def frozen(df: DataFrame, path: str, force: bool = False) -> None:
    """Writes an output that must not be replaced by accident."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def upsert_table(new: DataFrame, path: str, keys: Sequence[str], version: str, buckets: int = 64) -> int:
    """Merges rows into a table of key buckets; returns the number of the table's new version.

    A version is a small manifest that names a folder for each bucket. Only buckets that the batch touches are read,
    merged and written, the others keep their folders, so bytes written follow the batch and not the table. The manifest
    appears under its number at once or not at all, and two writers cannot both take a number: the later one fails and may
    try again. Folders are never changed, so who reads an older version keeps it. ``buckets`` holds for a new table only.
    """
    spark = new.sparkSession
    held = _manifest(spark, path)
    n, files = (held["buckets"], dict(held["files"])) if held else (buckets, {})
    place = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    batch = new.withColumn(_BUCKET, place)
    touched = sorted(r[0] for r in batch.select(_BUCKET).distinct().collect())  # numbers below ``buckets``
    number = (held["version"] if held else 0) + 1
    if not touched and held:
        return held["version"]
    old = [files[str(b)] for b in touched if str(b) in files]
    before = spark.read.schema(new.schema).parquet(*old) if old else new.limit(0)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    merged = upsert(before, new, keys, version).withColumn(_BUCKET, place)
    merged.repartition(max(1, min(n, len(touched))), _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
    files |= {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}
    _publish(spark, path, {"version": number, "buckets": n, "files": files, "schema": new.schema.json()})
    return number


def current_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last version of a table written by :func:`upsert_table`, or an older one."""
    held = _manifest(spark, path, version)
    if held is None:
        raise FileNotFoundError(f"{path} has no such version")
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    return spark.read.schema(schema).parquet(*held["files"].values()) if held["files"] else spark.createDataFrame([], schema)


_BUCKET = "bucket__"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version."""
    folder, fs = _fs(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    number = version if version is not None else max(numbers, default=None)
    if number not in numbers:
        return None
    return json.loads(spark.read.text(f"{path}/manifests/{number:012d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Writes under a name of its own, then renames to the number; fails if that is taken."""
    jvm = spark._jvm
    made, fs = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{manifest['version']:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(made).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(fs.makeQualified(made), fs.makeQualified(target), none)


def flat_pairs(pairs: Column) -> Column:
    """An array of (name, value) structs as ``a:1;b:2``."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["name"].cast("string"), p["value"].cast("string"))), ";")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with quotes doubled, arrays joined."""
    flat = [F.array_join(F.transform(F.col(n), lambda x: x.cast("string")), ", ").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def sheet_rows(df: DataFrame, columns: Sequence[str], default: str = "") -> DataFrame:
    """All columns as text in a fixed order, with a default for what is missing."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if c not in kinds:
            return F.lit(default).alias(c)
        v = F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.coalesce(v, F.lit(default)).alias(c)

    return df.select(*[one(c) for c in columns])


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines behind those that are there."""
    df.write.mode("append").json(path)


def report(df: DataFrame, path: str) -> None:
    """One JSON file of a small report."""
    df.coalesce(1).write.mode("overwrite").json(path)


def evidence_json(columns: dict[str, Column], places: int = 3) -> Column:
    """JSON of rounded numbers; NaN is null."""
    clean = [F.when(~F.isnan(c.cast("double")), F.round(c.cast("double"), places)).alias(k) for k, c in columns.items()]
    return F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})
