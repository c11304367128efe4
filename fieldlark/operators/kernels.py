"""Kernel maps: features whose inner product is close to a kernel, so that linear learners follow its curves (M3)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and rows of a cell of the grid, and queries of it whose maps are held at a time.
_QUERIES, _ROWS, _HELD = 4_096, 4_096, 512


def directions(inputs: int, size: int, gamma: float, seed: int) -> np.ndarray:
    """``size`` rows of ``inputs`` normal numbers of variance 2 * gamma and a shift in 0 .. 2 pi."""
    rng = np.random.RandomState(seed)
    return np.concatenate([rng.normal(0, np.sqrt(2 * gamma), (size, inputs)), rng.uniform(0, 2 * np.pi, (size, 1))], axis=1)


def fourier(values: Column, inputs: int, size: int, gamma: float, seed: int) -> Column:
    """sqrt(2 / size) * cos(w x + b) for each direction, of an array of ``inputs`` numbers."""
    w = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in directions(inputs, size, gamma, seed)])
    angle = lambda row: F.aggregate(F.zip_with(F.slice(row, 1, inputs), values, lambda a, b: a * b), F.element_at(row, -1), lambda s, x: s + x)
    return F.transform(w, lambda row: float(np.sqrt(2 / size)) * F.cos(angle(row)))


def mapped(values: Column, inputs: int, size: int, gamma: float, seed: int) -> Column:
    """:func:`fourier` by products of matrices, batch by batch, for maps of many features: equal but for last bits."""
    w = directions(inputs, size, gamma, seed)

    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        there = rows.is_valid().to_numpy(zero_copy_only=False)
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)
        z = np.sqrt(2 / size) * np.cos(x @ w[:, :-1].T + w[:, -1])
        ends = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * np.int32(size)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there, False)), z.ravel())

    return run(values)


def deviations(queries: DataFrame, rows: DataFrame, inputs: int, size: int, gamma: float, seed: int) -> DataFrame:
    """(id, n, most, s, c) of each query's id: its pairs with all rows, and of those with a kernel the largest error of the map, the errors' sum and their number.

    Both are (id, x). A vector that is null, shorter than ``inputs`` or not finite in one of them has no kernel with any.
    Queries and rows are dealt into the cells of a grid with their few inputs, not with their maps: a cell makes the maps
    of some of its own at a time and compares them by a product of matrices, so no pair is a row and neither the driver
    nor a task holds more than a block.
    """
    w = directions(inputs, size, gamma, seed)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_queries, n_rows = queries.count(), rows.count()
    across, down = max(1, -(-n_queries // _QUERIES)), max(1, -(-n_rows // _ROWS), min(parts, n_rows // 256))
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def dealt(df: DataFrame, kind: int, own: str, blocks: int, other: str, others: int) -> DataFrame:
        x = F.slice("x", 1, inputs)
        df = df.select("id", F.when((F.size("x") >= inputs) & F.forall(x, usable), F.transform(x, lambda v: v.cast("double"))).alias("x"), F.lit(kind).alias("kind"))
        return df.withColumn(own, F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    grid = dealt(queries, 0, "qb", across, "ib", down).unionByName(dealt(rows, 1, "ib", down, "qb", across))

    def points(x: pa.Array) -> np.ndarray:
        return x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)

    def maps(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / size) * np.cos(x @ w[:, :-1].T + w[:, -1])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ids, q = None, [], None, None
        n, most, total, c = 0, None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if ids is None:
                return
            there = ids.column("x").is_valid().to_numpy(zero_copy_only=False)
            largest, s = np.zeros((2, len(there)))
            largest[there], s[there] = most, total
            yield pa.RecordBatch.from_pydict({"id": ids.column("id"), "n": np.full(len(there), n), "most": pa.array(largest, mask=~there | (c == 0)), "s": s, "c": np.where(there, c, 0)})

        for batch in batches:
            names = np.stack([batch.column(k).to_numpy() for k in ("qb", "ib", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cell != (now := tuple(names[a, :2])):
                    yield from done()
                    cell, held, ids = now, [], None
                if names[a, 2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ids is None:
                    ids = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    q = points(ids.column("x"))
                    n, most, total, c = 0, np.zeros(len(q)), np.zeros(len(q)), 0
                x = points(part.column("x"))
                n, c = n + part.num_rows, c + len(x)
                for i in range(0, len(x), _ROWS):
                    own = x[i : i + _ROWS]
                    z = maps(own)
                    for j in range(0, len(q), _HELD):
                        some = q[j : j + _HELD]
                        square = sum((some[:, k, None] - own[None, :, k]) ** 2 for k in range(inputs))
                        off = np.abs(np.exp(-gamma * square) - maps(some) @ z.T)
                        most[j : j + _HELD] = np.maximum(most[j : j + _HELD], off.max(axis=1))
                        total[j : j + _HELD] += off.sum(axis=1)
        yield from done()

    cells = grid.repartition(max(parts, min(across * down, 8 * parts)), "qb", "ib").sortWithinPartitions("qb", "ib", "kind")
    kind = queries.schema["id"].dataType.simpleString()
    found = cells.mapInArrow(compared, f"id {kind}, n long, most double, s double, c long")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("s").alias("s"), F.sum("c").alias("c"))


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the RBF kernel exp(-gamma |x - y|^2) (Rahimi and Recht 2007).

    The inner product of two maps is the kernel with a deviation of at most 1 / sqrt(size / 2). Without ``gamma`` it is 1 /
    number of inputs, which suits scaled inputs. Nothing is fitted.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0 for 1 / inputs", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, size: int = 256, gamma: float = 0.0, seed: int = 0):
        super().__init__()
        self._setDefault(size=256, gamma=0.0, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.getInputCol()
        known = dataset.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
        first = None if known else dataset.select(F.size(vector_to_array(column)).alias("n")).first()
        inputs = int(known or (first["n"] if first else 1))
        gamma = self.getOrDefault("gamma") or 1 / inputs
        z = mapped(vector_to_array(column), inputs, self.getOrDefault("size"), gamma, self.getOrDefault("seed"))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(z))
