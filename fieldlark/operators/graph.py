"""Graphs of skeleton pixels: neighbours, components, lengths, paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.geo import once
from fieldlark.operators.components import connected_components


def pixel_edges(pixels: DataFrame, image: str = "image") -> DataFrame:
    """Pairs of pixels (image, x, y) that touch at a side or corner, in one direction (G1)."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    moved = pixels.select(image, F.col("x").alias("xa"), F.col("y").alias("ya"), offsets.alias("o"))
    moved = moved.select(image, "xa", "ya", (F.col("xa") + F.col("o.dx")).alias("xb"), (F.col("ya") + F.col("o.dy")).alias("yb"))
    there = pixels.select(image, F.col("x").alias("xb"), F.col("y").alias("yb"))
    return moved.join(there, [image, "xb", "yb"]).select(image, "xa", "ya", "xb", "yb", F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)).alias("length"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable by edges (a, b)."""
    found = connected_components(edges, "a", "b")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def large_components(labels: DataFrame, least: int) -> DataFrame:
    """Members of components of at least so many nodes."""
    big = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(big, "component")


def polyline_length(points: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Length of each line of points in order, never from one line to the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return points.withColumn("_s", step).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"))


def _neighbours(edges: pd.DataFrame) -> dict:
    out: dict = {}
    for xa, ya, xb, yb, d in zip(edges.xa, edges.ya, edges.xb, edges.yb, edges.length, strict=True):
        out.setdefault((xa, ya), {})[xb, yb] = d
        out.setdefault((xb, yb), {})[xa, ya] = d
    return out


def _pruned(near: dict, least: float, rounds: int) -> None:
    """Takes away side branches shorter than ``least``."""
    for _ in range(rounds):
        spurs = []
        for tip in [p for p, n in near.items() if len(n) == 1]:
            path, length = [tip], 0.0
            while len(near[path[-1]]) <= 2:
                after = [q for q in near[path[-1]] if q not in path[-2:]]
                if not after:
                    break
                length += near[path[-1]][after[0]]
                path.append(after[0])
            if len(near[path[-1]]) > 2 and length < least:
                spurs.append(path[:-1])
        if not spurs:
            return
        for p in (p for s in spurs for p in s if p in near):
            for q in near.pop(p):
                near.get(q, {}).pop(p, None)


def _farthest(near: dict, start) -> tuple:
    best, done, heap = (0.0, start), {}, [(0.0, start, None)]
    while heap:
        d, p, parent = heapq.heappop(heap)
        if p in done:
            continue
        done[p] = parent
        best = max(best, (d, p))
        for q, w in near[p].items():
            if q not in done:
                heapq.heappush(heap, (d + w, q, p))
    path, p = [], best[1]
    while p is not None:
        path.append(p)
        p = done[p]
    return best[0], best[1], path[::-1]


def main_stems(edges: DataFrame, image: str = "image", spur: float = 5.0, rounds: int = 12) -> DataFrame:
    """(image, step, x, y, length): after pruning, the longest shortest path of an image's greatest component by two sweeps.

    A skeleton is one photo's thin line; an image is a group.
    """

    def stem(g: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(g)
        _pruned(near, spur, rounds)
        best, left = (0.0, None, []), set(near)
        while left:
            seed = min(left)
            a = _farthest(near, seed)
            best = max(best, _farthest(near, a[1]), key=lambda r: r[0])
            stack = [seed]
            while stack:
                p = stack.pop()
                if p in left:
                    left.discard(p)
                    stack += near[p]
        return pd.DataFrame({image: g[image].iloc[0], "step": range(len(best[2])), "x": [p[0] for p in best[2]], "y": [p[1] for p in best[2]], "length": best[0]})

    kind = edges.schema[image].dataType.simpleString()
    return edges.groupBy(image).applyInPandas(stem, f"{image} {kind}, step int, x int, y int, length double")


def bridged(ends: DataFrame, candidates: DataFrame, group: str = "image") -> DataFrame:
    """Greedy bridges between end points of different components: nearest first, each end once.

    ``candidates`` is (group, a, b, distance) within the largest gap; ``ends`` (group, id, component).
    """
    comp = ends.select(group, F.col("id"), "component")
    c = candidates.join(comp.toDF(group, "a", "ca"), [group, "a"]).join(comp.toDF(group, "b", "cb"), [group, "b"]).where("ca != cb and a < b")

    def pick(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidates come group by group in order of distance; held are the ends and components of one group."""
        now, used, parent = None, set(), {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for f in frames:
            rows = []
            for g, p, q, d, ca, cb in f[[group, "a", "b", "distance", "ca", "cb"]].itertuples(index=False):
                if g != now:
                    now, used, parent = g, set(), {}
                if p in used or q in used or root(ca) == root(cb):
                    continue
                used |= {p, q}
                parent[root(ca)] = root(cb)
                rows.append((g, p, q, d))
            yield pd.DataFrame(rows, columns=[group, "a", "b", "distance"])

    ordered = c.repartition(group).sortWithinPartitions(group, "distance", "a", "b")
    return ordered.mapInPandas(pick, candidates.select(group, "a", "b", "distance").schema)


def observed_and_estimated(segments: DataFrame, key: str, scale: float) -> DataFrame:
    """(key, observed_cm, estimated_cm) of measured and filled segments, lengths in pixels."""
    of = lambda flag: F.sum(F.when(F.col("estimated") == flag, F.col("length")).otherwise(0.0)) * scale
    return segments.groupBy(key).agg(of(False).alias("observed_cm"), of(True).alias("estimated_cm"))


def _mean(values: Column) -> Column:
    """Mean of an array without its nulls."""
    return once(F.array_compact(values), lambda v: F.aggregate(v, F.lit(0.0), lambda s, d: s + d) / F.nullif(F.size(v), F.lit(0)))


def _one_way(a: Column, b: Column) -> Column:
    """Mean over the steps of ``a``, arrays of (s, x, y), of the distance from a step's points to the nearest of ``b``."""
    to = lambda p: F.array_min(F.transform(b, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))
    nearest = lambda s: F.array_min(F.transform(F.filter(a, lambda p: p["s"].eqNullSafe(s)), to))
    return _mean(F.transform(F.array_distinct(F.transform(a, lambda p: p["s"])), nearest))


def _gathered(routes: DataFrame, key: str, route: str) -> DataFrame:
    """(key, _p, _r): the points (r, s, x, y) of a key, which is the unit of the result, and its routes in order; nothing where there is one only."""
    rows = routes.where(F.col(key).isNotNull() & F.col(route).isNotNull())
    point = F.struct(F.col(route).alias("r"), F.col("step").alias("s"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    own = rows.groupBy(key).agg(F.collect_list(point).alias("_p"))
    return own.withColumn("_r", F.array_sort(F.array_distinct(F.transform("_p", lambda p: p["r"])))).where(F.size("_r") > 1)


def _both_ways(r: Column, q: Column) -> Column:
    of = lambda k: F.filter("_p", lambda p: p["r"] == k)
    return once(F.struct(of(r).alias("a"), of(q).alias("b")), lambda t: _mean(F.array(_one_way(t["a"], t["b"]), _one_way(t["b"], t["a"]))))


def route_disagreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, disagreement): mean distance to the nearest point of the other route, both ways (E40). Points meet inside a key."""
    routes = a.select(key, F.lit(0).alias("_route"), "step", "x", "y").unionByName(b.select(key, F.lit(1).alias("_route"), "step", "x", "y"))
    return _gathered(routes, key, "_route").select(key, _both_ways(F.lit(0), F.lit(1)).alias("disagreement"))


def routes_disagreement(routes: DataFrame, key: str, route: str) -> DataFrame:
    """(key, disagreement): the greatest disagreement of any two routes of a key (E40); nothing where there is one only.

    ``routes`` is (key, route, step, x, y); a key has a few routes, such as three tracings of one stem.
    """
    pairs = F.flatten(F.transform("_r", lambda r: F.transform(F.filter("_r", lambda q: q > r), lambda q: _both_ways(r, q))))
    return _gathered(routes, key, route).select(key, F.array_max(pairs).alias("disagreement"))
