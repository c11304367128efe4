"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import secrets
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.operators.lineage import cut, shared_dir

__all__ = ["ascii_lower", "cut", "delete", "fresh", "grouped", "groups", "plain_names", "secret_key", "shared_dir", "table", "text_batches", "tiles", "with_columns", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secret_key(spark: SparkSession) -> str:
    """The key in ``spark.fieldlark.surrogate.key``. Where it is unset one is drawn at random and kept in the session.

    So nothing is ever replaced under a key that others know; surrogates of one session agree with each other, and
    those of several only where the key is set.
    """
    name = "spark.fieldlark.surrogate.key"
    if not spark.conf.get(name, None):
        warnings.warn(f"{name} is unset: a key for this session is drawn, surrogates will differ from those of other sessions", stacklevel=2)
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def plain_names(docs: DataFrame, leave: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without the columns ``leave``, its columns named c0, c1, ... so that no name of an operator's own can clash, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in leave)}
    return docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items()]), names


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Like :func:`cut` but columnar and compressed: for wide rows that are read back column by column."""
    spark, path = df.sparkSession, path or fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Complete groups of a stream of frames that is sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().copy()
        if held:
            new[0] = bool((frame[keys].iloc[0] != held[-1][keys].iloc[-1]).any())
        starts = [int(i) for i in new.nonzero()[0]]
        edges = [0, *[s for s in starts if s], len(frame)]
        for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if held and (n or new[0]):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Grouped map for very many small groups: one Arrow stream for a partition, not one for a group.

    ``keys`` must not hold nulls. Each group must fit in a task; callers split larger ones.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        rows = 0
        for group in groups(frames, keys):
            made = fn(group)
            if len(made):
                out.append(made)
                rows += len(made)
            if rows >= 20_000:
                yield pd.concat(out, ignore_index=True)
                out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def tiles(df: DataFrame, member: Column, blocks: Column) -> DataFrame:
    """Splits large groups into pairs of blocks, so that each two members of a group meet in a tile.

    Adds ``block``, ``tile_a`` and ``tile_b``; a member of a group of one block is not copied.
    """
    df = df.withColumn("_blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return df.withColumns({"tile_a": F.least("block", "_other"), "tile_b": F.greatest("block", "_other")}).drop("_other", "_blocks")


def text_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with about ``limit`` bytes of ``column`` each.

    Arrow batches keep ids and other columns as they are; pandas would make a column of
    longs that holds a null a column of doubles, which are not exact over 2**53.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = [0, *[int(i) + 1 for i in (size[1:] != size[:-1]).nonzero()[0]], batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """``batch`` with columns replaced in their places, others added behind, and some left out."""
    kept = {n: new.get(n, batch.column(n)) for n in batch.schema.names if n not in drop}
    return pa.RecordBatch.from_pydict(kept | new)
