"""Permutation tests whose runs are bits: each point carries one bit for each run, so no point is copied once a run.

A run deals a stratum's flags anew. Points of a stratum are numbered once; where a number goes in a run is computed
on the spot by the swap-or-not shuffle (Hoang, Morris and Rogaway 2012), which is a permutation of 0 .. n - 1 for any
n. A point is flagged in a run if its number goes to one of the first places, as many as the stratum has flags. So
flags of all runs come from a point's row alone, and tests are joins of edges with bit vectors and sums of their bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators import tiles
from fieldlark.operators.evaluate import running_sums
from fieldlark.operators.lineage import cut

_P = 2_147_483_647
ROUNDS = 24


def places(number: np.ndarray, size: np.ndarray, runs: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Where each number below its size goes in each run: a row for each number. Works on integers that SQL has too."""
    x = np.repeat(np.asarray(number, np.int64)[:, None], runs, axis=1)
    n, run = np.asarray(size, np.int64)[:, None], np.arange(runs, dtype=np.int64)[None, :]
    for k in range(rounds):
        u = (run * rounds + k + 1 + seed * 1_000_003) * 48_271 % _P
        u = (u * u + 12_345) % _P
        other = (u % n + n - x) % n
        v = (np.maximum(x, other) * 40_692 + u) % _P
        v = (v * v + 67_891) % _P
        v = v * 69_621 % _P
        x = np.where((v >> 13) & 1 == 1, other, x)
    return x


def numbered_in_strata(points: DataFrame, strata: Sequence[str], key: str = "id") -> DataFrame:
    """Adds ``_i`` from 0 in the order of ``key`` and the stratum's ``_n``, by sums over ranges; no task holds a stratum."""
    df = points.withColumns({"_at": F.struct(*strata, key), "_one": F.lit(1)})
    run = running_sums(df, "_at", ["_one"]).drop("next")
    own = run.groupBy(*strata).agg(F.min("run__one").alias("_first"), F.count("*").alias("_n"))
    return run.join(own, list(strata)).withColumn("_i", F.col("run__one") - F.col("_first")).drop("_at", "_one", "_first", "run__one")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def flag_bits(points: DataFrame, flag: str, strata: Sequence[str], runs: int, seed: int = 0) -> DataFrame:
    """(id, bits): bit r of ``bits`` is the flag in run r, bit ``runs`` the flag as it is (X5). Strata must not be null."""
    df = numbered_in_strata(points.select("id", *strata, F.coalesce(F.col(flag), F.lit(False)).alias("_flag")), strata)
    flags = df.groupBy(*strata).agg(F.count_if("_flag").alias("_k"))
    # Small rows that cost much: dealt out by number and not by size.
    df = df.join(flags, list(strata)).select("id", "_i", "_n", "_k", "_flag").repartition(_tasks(points))

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                i, n, k, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_n", "_k", "_flag"))
                on = np.concatenate([places(i, n, runs, seed) < k[:, None], own.astype(bool)[:, None]], axis=1)
                packed = np.packbits(on, axis=1, bitorder="little")
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "bits": pa.array([r.tobytes() for r in packed], pa.binary())})

    return df.mapInArrow(bits, f"id {points.schema['id'].dataType.simpleString()}, bits binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _bits(width: int):
    """Makes a matrix of ones and zeros of packed bits."""
    return lambda rows: np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), width), axis=1, bitorder="little").astype(np.float32)


def _placed(points: DataFrame, carried: DataFrame, column: str) -> DataFrame:
    return points.select("id", "lat", "lon").join(carried.select("id", F.col(column).alias("data")), "id")


def _counts(rows: DataFrame, a: str, b: str | None, runs: int) -> DataFrame:
    """(run, count): rows in which the bit of each run is set in ``a`` and in ``b``; a task gives one row a run."""
    width = (runs + 8) // 8

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * 8, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                on = _matrix(part.column(a), width)
                on = on & _matrix(part.column(b), width) if b else on
                total += np.unpackbits(on, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"run": np.arange(runs + 1), "count": total[: runs + 1]})

    return rows.select(a, *([b] if b else [])).mapInArrow(add, "run long, count long").groupBy("run").agg(F.sum("count").alias("count"))


def _tested(counts: DataFrame, runs: int, name: str, value: F.Column) -> DataFrame:
    """The observed value, that of the last run number, and the share of runs that reach it, with one more on either side."""
    values = counts.withColumn("_v", value)
    one = values.agg(F.max(F.when(F.col("run") == runs, F.col("_v"))).alias(name))
    both = values.where(F.col("run") < runs).crossJoin(F.broadcast(one))
    return both.groupBy(name).agg(((F.count_if(F.col("_v") >= F.col(name)) + 1) / F.lit(runs + 1)).alias("p"))


def join_count_test(points: DataFrame, edges: DataFrame | float, flag: str, strata: Sequence[str], runs: int = 999, seed: int = 0) -> DataFrame:
    """(join_count, p): neighbouring pairs that are both flagged, against flags dealt anew in each stratum.

    ``edges`` (a, b) are in both directions, or a distance in metres, for which pairs are not made; see :mod:`tiles`.
    """
    bits = cut(flag_bits(points, flag, strata, runs, seed))
    if not isinstance(edges, DataFrame):
        width = (runs + 8) // 8
        found = tiles.pair_sums(_placed(points, bits, "bits"), edges, _bits(width), width * 8).where(F.col("run") <= runs)
        return _tested(found, runs, "join_count", F.col("s"))
    both = edges.select("a", "b").where("a < b").join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return _tested(_counts(both, "bits_a", "bits_b", runs), runs, "join_count", F.col("count").cast("double"))


_MOVED = np.dtype([("place", "<u4"), ("run", "<u2"), ("z", "<f8")])


def moved_values(points: DataFrame, value: str, runs: int, seed: int = 0, block: int = 256, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, z): for each point the values that the runs put there, as doubles, and behind them its own.

    Values are taken from their mean. A task sends what its points give to a block of places as one packed row, and a
    block, which is all that is held, unpacks them into a matrix of places and runs.
    """
    df = numbered_in_strata(points.where(F.col(value).isNotNull()).select("id", F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v")), ["_all"])
    df = df.crossJoin(F.broadcast(df.agg(F.avg("_v").alias("_m")))).select("_i", "_n", (F.col("_v") - F.col("_m")).alias("_z")).repartition(_tasks(points))
    width = runs + 1

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                i, n, z = (whole.slice(a, 256).column(c).to_numpy() for c in ("_i", "_n", "_z"))
                at = np.concatenate([places(i, n, runs, seed), i[:, None]], axis=1).ravel()
                rows = np.empty(len(at), _MOVED)
                rows["place"], rows["run"], rows["z"] = at % block, np.tile(np.arange(width), len(i)), np.repeat(z, width)
                order = np.argsort(at // block, kind="stable")
                blocks, first = np.unique((at // block)[order], return_index=True)
                parts = np.split(rows[order], first[1:])
                yield pa.RecordBatch.from_pydict({"block": blocks, "data": pa.array([x.tobytes() for x in parts], pa.binary())})

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def out() -> pa.RecordBatch:
            own = np.flatnonzero(~np.isnan(held[:, runs]))
            return pa.RecordBatch.from_pydict({"place": now * block + own, "z": pa.array([held[k].tobytes() for k in own], pa.binary())})

        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if b != now:
                    if now is not None:
                        yield out()
                    now, held = b, np.full((block, width), np.nan)
                rows = np.frombuffer(data, _MOVED)
                held[rows["place"], rows["run"]] = rows["z"]
        if now is not None:
            yield out()

    moved = df.mapInArrow(sent, "block long, data binary").repartition("block").sortWithinPartitions("block").mapInArrow(unpacked, "place long, z binary")
    ids = numbered_in_strata(points.where(F.col(value).isNotNull()).select("id", *keep, F.lit(0).alias("_all")), ["_all"])
    return ids.select("id", *keep, F.col("_i").alias("place")).join(moved, "place").select("id", *keep, "z")


def morans_i_test(points: DataFrame, edges: DataFrame | float, value: str, runs: int = 999, seed: int = 0) -> DataFrame:
    """(morans_i, p): Moran's I with weights one, against values dealt anew over all points.

    ``edges`` (a, b) are in both directions, or a distance in metres, for which pairs are not made; points without a value
    are left out.
    """
    width = runs + 1
    spread = points.agg(F.var_pop(value).alias("_v"))
    if not isinstance(edges, DataFrame):
        z = moved_values(points, value, runs, seed, keep=["lat", "lon"]).withColumnRenamed("z", "data")
        sums = tiles.pair_sums(z, edges, lambda rows: np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), width), width)
        return _tested_morans(sums, spread, runs)
    z = cut(moved_values(points, value, runs, seed))
    both = edges.select("a", "b").where("a < b").join(z.toDF("a", "za"), "a").join(z.toDF("b", "zb"), "b")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                a, b = (np.frombuffer(b"".join(batch.slice(k, 1024).column(c).to_pylist()), np.float64).reshape(-1, width) for c in ("za", "zb"))
                total, n = total + (a * b).sum(axis=0), n + len(a)
        yield pa.RecordBatch.from_pydict({"run": np.arange(width), "s": total, "n": np.full(width, n)})

    sums = both.select("za", "zb").mapInArrow(add, "run long, s double, n long").groupBy("run").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return _tested_morans(sums, spread, runs)


def _tested_morans(sums: DataFrame, spread: DataFrame, runs: int) -> DataFrame:
    # Equal arrangements must tie whatever the order of their sums.
    return _tested(sums.crossJoin(F.broadcast(spread)), runs, "morans_i", F.round(F.col("s") / F.nullif(F.col("n") * F.col("_v"), F.lit(0.0)), 12))


def clustered_share_test(points: DataFrame, edges: DataFrame | float, flag: str, strata: Sequence[str], least: int, runs: int = 999, seed: int = 0) -> DataFrame:
    """(observed, p): share of flagged points in density clusters, against flags dealt anew in each stratum.

    ``edges`` (a, b) are the pairs within the distance, in both directions, or the distance in metres, for which pairs are
    not made. Flagged neighbours of a point are counted
    for all runs at once, which gives its core bits; a point is in a cluster if it is flagged and is core or next to one.
    """
    width = (runs + 8) // 8
    bits = cut(flag_bits(points, flag, strata, runs, seed))
    kind = points.schema["id"].dataType.simpleString()

    def gathered(batches: Iterable[pa.RecordBatch], step, finish) -> Iterator[pa.RecordBatch]:
        """Folds the rows of each ``a``, which come together, into one; a point's neighbours are never held."""
        at, held, own = None, None, None
        for batch in batches:
            keys = batch.column("a").to_pylist()
            mine, other = _matrix(batch.column("own"), width), [x if x is not None else bytes(width) for x in batch.column("other").to_pylist()]
            edges_ = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            ids, out = [], []
            for i, j in zip(edges_, edges_[1:], strict=False):
                if i == j:
                    continue
                if keys[i] != at:
                    if at is not None:
                        ids.append(at)
                        out.append(finish(own, held))
                    at, own, held = keys[i], mine[i], None
                held = step(held, np.frombuffer(b"".join(other[i:j]), np.uint8).reshape(j - i, width))
            if ids:
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, batch.schema.field("a").type), "bits": pa.array(out, pa.binary())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"id": pa.array([at], batch.schema.field("a").type), "bits": pa.array([finish(own, held)], pa.binary())})

    def core(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(held, rows):
            n = sum(np.unpackbits(rows[k : k + 1024], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(rows), 1024))
            return n if held is None else held + n

        return gathered(batches, add, lambda own, n: (np.packbits(n + 1 >= least, bitorder="little") & own).tobytes())

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def any_(held, rows):
            n = np.bitwise_or.reduce(rows, axis=0)
            return n if held is None else held | n

        return gathered(batches, any_, lambda own, n: (n & own).tobytes())

    def around(other: DataFrame) -> DataFrame:
        """A row for each point and neighbour, and one for the point alone, those of a point together."""
        alone = F.lit(None).cast(kind)
        ends = edges.select("a", "b").unionAll(points.select(F.col("id").alias("a"), alone.alias("b")))
        rows = ends.join(bits.toDF("a", "own"), "a").join(other.toDF("b", "other"), "b", "left")
        return rows.select("a", "own", "other").repartition("a").sortWithinPartitions("a")

    if not isinstance(edges, DataFrame):
        decode = _bits(width)
        packed = lambda on: [r.tobytes() for r in np.packbits(on, axis=1, bitorder="little")]
        is_core = lambda own, n: packed((n + 1 >= least) & (decode(own) > 0))
        cores = cut(tiles.neighbour_counts(_placed(points, bits, "bits"), edges, decode, width * 8, is_core))
        # A core point is in its cluster itself; a point carries its core bits and behind them its own.
        both = cores.join(bits, "id").select("id", F.concat("data", "bits").alias("data"))
        core_part, own_part = lambda rows: decode([r[:width] for r in rows]), lambda rows: decode([r[width:] for r in rows])
        is_in = lambda rows, n: packed((core_part(rows) > 0) | ((n > 0) & (own_part(rows) > 0)))
        inside_ = tiles.neighbour_counts(_placed(points, both, "data"), edges, core_part, width * 8, is_in)
        counts = _counts(inside_.select(F.col("data").alias("bits")), "bits", None, runs)
        flagged = points.agg(F.count_if(flag).alias("_k"))
        return _tested(counts.crossJoin(F.broadcast(flagged)), runs, "observed", F.col("count") / F.nullif("_k", F.lit(0)))

    schema = f"id {kind}, bits binary"
    cores = cut(around(bits).mapInArrow(core, schema))
    near = around(cores).mapInArrow(inside, schema)
    # A core point is in its cluster itself.
    joined = near.toDF("id", "near").join(cores.toDF("id", "core"), "id")

    def either(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = _matrix(b.column("near"), width) | _matrix(b.column("core"), width)
                yield pa.RecordBatch.from_pydict({"bits": pa.array([r.tobytes() for r in rows], pa.binary())})

    counts = _counts(joined.select("near", "core").mapInArrow(either, "bits binary"), "bits", None, runs)
    flagged = points.agg(F.count_if(flag).alias("_k"))
    return _tested(counts.crossJoin(F.broadcast(flagged)), runs, "observed", F.col("count") / F.nullif("_k", F.lit(0)))
