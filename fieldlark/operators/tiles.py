"""Work on pairs of near points by tiles of the plane, whose points meet as blocks and never as rows.

A tile's own points are held with what they carry; points of the tile and of a rim around it stream past them in blocks.
A block and the held points give a matrix of ones and zeros, which is near or not, and its products with what is carried
are sums over neighbours. So a point is sent to its tile and to the tiles whose rim it is in, a few copies in all, and
pairs are neither written nor shuffled, though as many are compared as points are close.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.geo import EARTH_M, METRES_PER_DEGREE

#: A tile's side as a multiple of the distance, points of a block, held points that meet it at a time.
_SIDE, _BLOCK, _HELD = 2.0, 512, 2048


def near(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray, metres: float) -> np.ndarray:
    """Which points of the first are within the distance of which of the second, all in radians."""
    h = np.sin((to_lat[None, :] - lat[:, None]) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(to_lat)[None, :] * np.sin((to_lon[None, :] - lon[:, None]) / 2) ** 2
    limit = math.sin(metres / (2 * EARTH_M)) ** 2
    out = h <= limit
    # As the distance is compared elsewhere where rounding could decide.
    close = np.abs(h - limit) <= 1e-9 * limit
    if close.any():
        out[close] = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h[close]))) <= metres
    return out


def _tiled(points: DataFrame, metres: float, half: bool) -> DataFrame:
    """A row (ty, tx, own, id, lat, lon, data) for each tile that holds the point or has it in its rim; own rows of a tile come first.

    With ``half`` the rim is that of the tiles behind in the order of (ty, tx), so that two tiles meet once.
    """
    bad = (F.abs(F.col("lat")) > 60) | (F.abs(F.col("lon")) > 179)
    lat = F.when(bad, F.raise_error(F.lit("tiles are laid out for latitudes up to 60 and longitudes up to 179 degrees")).cast("double")).otherwise(F.col("lat"))
    # Over the distance at every latitude up to 60 degrees, where a degree of longitude is half as long.
    rim = 1.01 / _SIDE
    y, x = lat * METRES_PER_DEGREE / (_SIDE * metres), F.col("lon") * METRES_PER_DEGREE / (2 * _SIDE * metres)
    p = points.where("lat is not null and lon is not null").withColumns({"_y": y, "_x": x})
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if not half or (dy, dx) <= (0, 0)]
    inside = lambda c, d: F.lit(True) if d == 0 else (F.col(c) - F.floor(c) < rim if d < 0 else F.col(c) - F.floor(c) > 1 - rim)
    to = F.array_compact(F.array(*[F.when(inside("_y", dy) & inside("_x", dx), F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))) for dy, dx in steps]))
    rows = p.withColumn("_s", F.explode(to)).withColumns({"ty": F.floor("_y") + F.col("_s.dy"), "tx": F.floor("_x") + F.col("_s.dx"), "own": (F.col("_s.dy") == 0) & (F.col("_s.dx") == 0)})
    rows = rows.select("ty", "tx", "own", "id", F.radians("lat").alias("lat"), F.radians("lon").alias("lon"), "data")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "ty", "tx").sortWithinPartitions("ty", "tx", F.desc("own"), "lat")


class _Tile:
    """The own points of a tile, in the order of their latitudes."""

    def __init__(self, ids: pa.Array, lat: np.ndarray, lon: np.ndarray, data: list[bytes]):
        self.ids, self.lat, self.lon, self.data = ids, lat, lon, data
        self.codes = np.array(ids.to_pylist())


def _met(batches: Iterable[pa.RecordBatch], metres: float, open_: Callable, meet: Callable, close: Callable) -> Iterator[pa.RecordBatch]:
    """Gathers each tile's own points, calls ``open_`` with them, ``meet`` with blocks of points (own ones too) and ``close``."""
    now, own, tile = None, [], None

    def start() -> None:
        nonlocal tile
        ids = pa.concat_arrays([b.column("id") for b in own])
        lat, lon = (np.concatenate([b.column(c).to_numpy() for b in own]) for c in ("lat", "lon"))
        tile = _Tile(ids, lat, lon, [d for b in own for d in b.column("data").to_pylist()])
        open_(tile)
        for b in own:
            blocks(b, True)

    def blocks(b: pa.RecordBatch, mine: bool) -> None:
        for k in range(0, b.num_rows, _BLOCK):
            part = b.slice(k, _BLOCK)
            lat, lon = part.column("lat").to_numpy(), part.column("lon").to_numpy()
            reach = 1.01 * metres / EARTH_M
            a, z = np.searchsorted(tile.lat, lat.min() - reach), np.searchsorted(tile.lat, lat.max() + reach, "right")
            data, codes = part.column("data").to_pylist(), np.array(part.column("id").to_pylist())
            for i in range(a, z, _HELD):
                j = min(i + _HELD, z)
                on = near(tile.lat[i:j], tile.lon[i:j], lat, lon, metres)
                # A point is not its own neighbour; pairs inside a tile come twice, as its points meet all of it.
                on &= tile.codes[i:j, None] != codes[None, :]
                if on.any():
                    meet(tile, i, j, on, data, mine)

    def end() -> Iterator[pa.RecordBatch]:
        nonlocal tile
        if own and tile is None:
            start()
        if tile is not None:
            yield from close(tile)
        tile = None
        own.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column("ty").to_numpy(), batch.column("tx").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False).astype(np.int64)])
        first = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(first, first[1:], strict=False):
            at = (int(keys[0, i]), int(keys[1, i]))
            if at != now:
                yield from end()
                now = at
            part = batch.slice(i, j - i)
            if keys[2, i]:
                own.append(part)
            elif own:
                if tile is None:
                    start()
                blocks(part, False)
    yield from end()


def pair_sums(points: DataFrame, metres: float, decode: Callable[[list[bytes]], np.ndarray], width: int) -> DataFrame:
    """(run, s, n): sums of the products of what two near points carry, over unordered pairs, for each of ``width`` runs, and the number of pairs.

    ``points`` is (id, lat, lon, data), ``decode`` makes a matrix of points and runs of some of ``data``.
    """

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs, held = np.zeros(width), 0.0, None

        def open_(tile: _Tile) -> None:
            nonlocal held
            held = tile.data

        def meet(tile: _Tile, i: int, j: int, on: np.ndarray, data: list[bytes], mine: bool) -> None:
            nonlocal total, pairs
            share = 0.5 if mine else 1.0  # inside a tile each pair is met from both ends
            other = decode(data)
            # The product of a one-zero matrix in the kind of what is carried: single precision holds counts up to a block's size.
            total = total + share * (decode(held[i:j]) * (on.astype(other.dtype) @ other)).sum(axis=0, dtype=np.float64)
            pairs += share * on.sum()

        for _ in _met(batches, metres, open_, meet, lambda tile: iter(())):
            pass
        yield pa.RecordBatch.from_pydict({"run": np.arange(width), "s": total, "n": np.full(width, pairs)})

    found = _tiled(points, metres, True).mapInArrow(sums, "run long, s double, n double")
    return found.groupBy("run").agg(F.sum("s").alias("s"), F.sum("n").cast("long").alias("n"))


def neighbour_counts(points: DataFrame, metres: float, decode: Callable[[list[bytes]], np.ndarray], width: int, finish: Callable[[list[bytes], np.ndarray], list[bytes]]) -> DataFrame:
    """(id, data): what ``finish`` makes of what points carry and of the sums of what their neighbours carry, for each of ``width`` runs."""
    kind = points.schema["id"].dataType.simpleString()

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def open_(tile: _Tile) -> None:
            nonlocal held
            held = np.zeros((len(tile.lat), width), np.float32)

        def meet(tile: _Tile, i: int, j: int, on: np.ndarray, data: list[bytes], mine: bool) -> None:
            held[i:j] += on.astype(np.float32) @ decode(data).astype(np.float32)

        def close(tile: _Tile) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"id": tile.ids, "data": pa.array(finish(tile.data, held), pa.binary())})

        yield from _met(batches, metres, open_, meet, close)

    return _tiled(points, metres, False).mapInArrow(counts, f"id {kind}, data binary")
