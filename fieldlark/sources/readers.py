"""Reading tables and files. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file with all columns as text; an empty field is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


def checked_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A CSV file with a byte order mark or not; fails on an empty file, repeated or missing columns."""
    head = spark.read.text(path).limit(1).collect()
    names = [n.strip() for n in next(csv.reader([head[0][0].lstrip("﻿")]), [])] if head else []
    if not names or names == [""]:
        raise ValueError(f"{path} is empty")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns come twice: {', '.join(twice)}")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, equal: Mapping[str, object] | None = None) -> DataFrame:
    """A Parquet table with a column list and equality filters, both of which reach the scan."""
    df = spark.read.parquet(path)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A database table, read in ranges of a key (S3)."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON files that hold one value over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


FEATURES = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def geojson_rings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, edge, x1, y1, x2, y2) of the outer rings of a feature collection."""
    ring = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = ring.select(F.col("f.properties")[name].alias("name"), F.col("f.geometry.coordinates")[0].alias("r"))
    each = ring.select("name", F.posexplode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("p"), F.slice("r", 2, F.size("r") - 1).alias("q"))).alias("edge", "e"))
    return each.select("name", "edge", *[F.col(f"e.{c}")[i].alias(f"{a}{n}") for n, c in ((1, "p"), (2, "q")) for i, a in enumerate("xy")])


def zones_of_points(points: DataFrame, rings: DataFrame, key: str) -> DataFrame:
    """(key, name) of the zones whose ring a point is in, by crossings (J15). Rings are few and are broadcast below Spark's limit."""
    hit = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (
        F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    )
    box = rings.groupBy("name").agg(F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi"))
    edges = rings.join(box, "name")
    crossing = points.join(edges, F.col("y").between(F.col("lo"), F.col("hi")) & hit)
    return crossing.groupBy(key, "name").agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, "name")


def planted_counts(spark: SparkSession, path: str, block: str, count: str) -> DataFrame:
    """(block, planted) from feature properties that are finite and positive."""
    f = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features.properties").alias("p"))
    n = F.col("p")[count].try_cast("double")
    return f.select(F.col("p")[block].alias("block"), n.alias("planted")).where(n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def acceptable_images(files: DataFrame, most_bytes: int = 10_000_000, most_pixels: int = 50_000_000, most_ratio: float = 20.0) -> DataFrame:
    """Image files (path, length, width, height) that are neither too large nor too narrow."""
    sides = (F.greatest("width", "height") / F.nullif(F.least("width", "height"), F.lit(0))) <= most_ratio
    kind = F.lower("path").rlike(r"\.(jpe?g|png|webp)$")
    return files.where(kind & (F.col("length") <= most_bytes) & (F.col("width").cast("long") * F.col("height") <= most_pixels) & sides)
