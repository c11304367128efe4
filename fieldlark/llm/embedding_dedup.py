"""Near-duplicate vectors by randomised-rotation binary codes.

After Gao and Long, "RaBitQ" (SIGMOD 2024). A vector is normalised and rotated at
random; the signs are its code, and the inner product of code and vector is the
stored correction factor. Code times rotated vector over that factor estimates the
cosine without bias, with an error bound that is known. Only pairs whose upper
bound reaches the threshold are recomputed in double precision.

Candidates are pairs that agree on all signs of at least one of several bands,
taken from further rotations. The number of signs in a band grows with the
logarithm of the rows, and the number of bands with it, so that a pair at the
threshold is missed with a probability of at most ``miss``. Equal vectors are one
class beforehand. A pair is counted in the first band on which it agrees, so links
are counted in tasks and no list of pairs leaves them. Large buckets are dealt out
as pairs of blocks.

Edge cases. Null vectors, null labels, zero vectors and null or non-finite
components link with nothing, and neither do vectors of different lengths. vec_id
is the key; repeated rows are repeated in the result, and count as one vector.
A row without vec_id gets no component, no link and is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import cut, grouped, tiles, written
from fieldlark.operators.components import connected_components


@dataclass(frozen=True)
class RotationCodes:
    """``epsilon`` scales the confidence bound; 5 standard deviations of the estimate's error."""

    threshold: float = 0.98
    seed: int = 11
    epsilon: float = 5.0
    miss: float = 1e-4
    bucket_rows: int = 1_024

    def bands(self, rows: int) -> tuple[int, int]:
        """Bits in a band and number of bands for so many rows."""
        bits = max(16, math.ceil(math.log2(max(rows, 1))))
        p = (1 - math.acos(self.threshold) / math.pi) ** bits
        return bits, math.ceil(math.log(self.miss) / math.log(1 - p))


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, seed) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng((seed, dim)).normal(size=(dim, dim)))
        _ROTATIONS[dim, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, seed]


def _unit(values) -> tuple[np.ndarray, np.ndarray]:
    """Rows of float64 unit vectors; a row that is not usable is zero."""
    x = np.stack([np.asarray(v, np.float64) for v in values])
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return np.where(ok[:, None], x / np.where(ok, norm, 1)[:, None], 0), ok


def codes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, codes of entries +-1/sqrt(dim), and the factors <code, vector>."""
    y = x @ rotation(x.shape[1], seed)
    c = np.where(y >= 0, 1.0, -1.0) / math.sqrt(x.shape[1])
    return y, c, (c * y).sum(axis=1)


def estimates(y: np.ndarray, c: np.ndarray, factor: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of coded rows with all rows, and the half width of each row's confidence interval."""
    bound = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * epsilon / math.sqrt(max(1, c.shape[1] - 1))
    return (c @ y.T) / factor[:, None], bound[:, None]


def encode(vectors: DataFrame, p: RotationCodes, rows: int) -> DataFrame:
    """vec_id, label, k1, k2 (digest of the vector), dim, vector (its float64 unit vector), factor, bands."""
    bits, n = p.bands(rows)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby(f.embedding.map(len)):
                x, ok = _unit(g.embedding)
                g, x, raw = g[ok], x[ok], [np.asarray(v, np.float64).tobytes() for v, k in zip(g.embedding, ok, strict=True) if k]
                signs = [x @ rotation(dim, p.seed + 1 + i) >= 0 for i in range(math.ceil(n * bits / dim))]
                signs = np.concatenate(signs, axis=1)[:, : n * bits].reshape(len(x), n, bits) if len(x) else np.zeros((0, n, bits), bool)
                keys = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                digest = [np.frombuffer(hashlib.blake2b(r, digest_size=16).digest(), np.int64) for r in raw]
                yield pd.DataFrame(
                    {
                        "vec_id": g.vec_id.to_numpy(), "label": g.label.to_numpy(), "dim": dim, "k1": [d[0] for d in digest], "k2": [d[1] for d in digest],
                        "vector": [v.tobytes() for v in x], "factor": codes(x, p.seed)[2], "bands": list(keys),
                    }
                )

    usable = vectors.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    usable = usable.where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return usable.mapInPandas(run, "vec_id long, label long, dim int, k1 long, k2 long, vector binary, factor double, bands array<long>")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges between 0..n-1."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    while (root != root[root]).any():
        root = root[root]
    return root


def _links(classes: DataFrame, p: RotationCodes) -> DataFrame:
    """(rep, links, root): in a tile, the vectors linked to rep and the least member of its component there."""
    members = classes.select("rep", F.posexplode("bands").alias("band", "code"), "label", "dim")
    members = members.select("rep", "band", F.xxhash64("label", "dim", "band", "code").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    found = members.join(sizes, "key").join(classes.select("rep", "label", "dim", "weight", "vector", "factor", "bands"), "rep")
    found = tiles(found, F.col("rep"), F.ceil(F.col("size") / p.bucket_rows))

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep", kind="stable")
        x = np.frombuffer(b"".join(f.vector), np.float64).reshape(len(f), -1)
        y, c, _ = codes(x, p.seed)
        bands = np.stack(f.bands.to_numpy())
        band, label, dim = int(f.band.iloc[0]), f.label.to_numpy(), f.dim.to_numpy()
        block, weight, rep = f.block.to_numpy(), f.weight.to_numpy(), f.rep.to_numpy()
        apart = f.tile_a.iloc[0] != f.tile_b.iloc[0]
        est, bound = estimates(y, c, f.factor.to_numpy(), p.epsilon)
        open_ = np.triu(est + bound >= p.threshold, 1)
        if apart:
            open_ &= block[:, None] != block[None, :]
        i, j = open_.nonzero()
        # The same pair in an earlier band was seen there; xxhash64 may also join unlike keys.
        new = (label[i] == label[j]) & (dim[i] == dim[j]) & (bands[i, band] == bands[j, band])
        i, j = i[new], j[new]
        for k in range(band):
            new = bands[i, k] != bands[j, k]
            i, j = i[new], j[new]
        keep = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 50_000]], x[j[s : s + 50_000]]) >= p.threshold for s in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
        n = np.bincount(i, weight[j], len(f)) + np.bincount(j, weight[i], len(f))
        hit = n > 0
        return pd.DataFrame({"rep": rep[hit], "links": n[hit].astype(np.int64), "root": rep[_roots(len(f), i, j)][hit]})

    return grouped(found, ["key", "tile_a", "tile_b"], tile, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, p: RotationCodes | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    p = p or RotationCodes()
    vectors = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).cast("long").alias("label"))
    coded = written(encode(vectors, p, vectors.count()))
    once = coded.groupBy("label", "dim", "k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight"), *[F.any_value(c).alias(c) for c in ("vector", "factor", "bands")]
    )
    classes = written(once)
    links = cut(_links(classes, p))
    parts = connected_components(links, "rep", "root").withColumnRenamed("id", "rep")
    named = classes.select("label", "dim", "k1", "k2", "rep", "weight").join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(parts, "rep", "left")
    named = named.select(
        "label", "dim", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    usable = coded.select("vec_id", "label", "dim", "k1", "k2").join(named, ["label", "dim", "k1", "k2"])
    found = usable.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(found, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
