"""MinHash near-duplicate detection.

Many universal hash minima with banding, signature verification, confirmation
on full shingle sets, and components by alternating large-star and small-star.

1.  One pass over the texts makes, for each document, the size and digest of its
    shingle set, a signature (one byte of each minimum) and the band keys. Equal
    sets are one class, so a group of exact copies is one row from here on.
2.  Classes that share a band key form a bucket. Buckets of one member go, and of
    buckets with equal members one stays. Inside a bucket, signatures are compared
    and a spanning forest of the pairs that may be similar is emitted, never all
    pairs. Large buckets are dealt out as pairs of blocks.
3.  The components of those forests hold every pair that can be linked. Their
    texts are brought together once, again as pairs of blocks where a component is
    large, and compared on full sets. Components of the confirmed links result.

Edge cases. A null or empty text, or one without words, has the empty set and is
linked with nothing. doc_id is the key; a row that is repeated is repeated in the
result. A row without doc_id gets no component and is kept. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import cut, grouped, text_batches, tiles, written
from fieldlark.operators.components import connected_components

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_CACHE = 400_000


@dataclass(frozen=True)
class MinHash:
    """``threshold`` is a percentage of the union; ``bands`` of ``rows`` minima each.

    With 24 bands of 5 minima, a pair at similarity 0.85 shares no band with
    probability 8e-7, and at 0.8 with 8e-5. ``slack`` is how far below the threshold
    a signature's estimate may fall before a pair is given up: over four standard
    deviations.
    """

    words: int = 5
    threshold: int = 80
    bands: int = 24
    rows: int = 5
    seed: int = 7
    slack: float = 0.15
    bucket_rows: int = 2_000
    tile_shingles: int = 1_500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, cache: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; bytes.split cuts at the six ASCII white spaces."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    span = min(k, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        out = _mix(out * _STEP + h[i : len(h) - span + 1 + i])
    return np.unique(out)


def _universal(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """High halves of the least a x + b mod 2^64, a universal family with odd a."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048, None] * a
        x += b
        np.minimum(least, x.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, p: MinHash, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (digest of the set), sig (a byte of each minimum), bands (their keys)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(p)
        cache = _Words()
        for batch in text_batches(batches, "text", 8_000_000):
            rows = []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, p.words, cache)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                m = minima(s, a, b)
                k1, k2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                keys = np.arange(p.bands, dtype=np.uint64)
                for column in m.reshape(p.bands, p.rows).T:
                    keys = _mix(keys * _STEP + column)
                rows.append((len(s), k1, k2, (m & 255).astype(np.uint8).tobytes(), keys.view(np.int64)))
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"
    )


def forest(linked, n: int) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1: ``linked(i, others)`` says which of the others i is linked to.

    A node is compared only with nodes that no tree holds yet, so a dense group costs little over its size.
    """
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(i, left)
            new, left = left[hit], left[~hit]
            out += [(i, int(j)) for j in new]
            queue += [int(j) for j in new]
    return out


def _candidates(classes: DataFrame, p: MinHash) -> DataFrame:
    """Spanning edges (a, b) of pairs of classes that share a band and may be similar by signature."""
    n = p.bands * p.rows
    # A byte agrees by chance once in 256.
    least = n * ((j := max(0.0, p.threshold / 100 - p.slack)) + (1 - j) / 256)
    members = classes.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(F.lit(2**40 - 1))).alias("y")
    )
    chosen = buckets.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    sigs = classes.select("rep", "sig")
    found = cut(members.join(chosen.select("key", "size"), "key"))
    pairs = found.where("size = 2").groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    pairs = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")

    def agree(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s, t = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(-1, n) for c in ("sig_a", "sig_b"))
                yield f.loc[(s == t).sum(axis=1) >= least, ["a", "b"]]

    def bucket(f: pd.DataFrame) -> pd.DataFrame:
        rep = f.rep.to_numpy()
        order = np.argsort(rep, kind="stable")
        s, rep, block = np.frombuffer(b"".join(f.sig), np.uint8).reshape(-1, n)[order], rep[order], f.block.to_numpy()[order]
        apart = f.tile_a.iloc[0] != f.tile_b.iloc[0]
        got = forest(lambda i, o: ((s[o] == s[i]).sum(axis=1) >= least) & (~apart | (block[o] != block[i])), len(f))
        return pd.DataFrame({"a": rep[[i for i, _ in got]], "b": rep[[j for _, j in got]]}, dtype=np.int64)

    large = found.where("size > 2").join(sigs, "rep")
    large = tiles(large, F.col("rep"), F.ceil(F.col("size") / p.bucket_rows))
    large = grouped(large, ["key", "tile_a", "tile_b"], bucket, "a long, b long")
    return pairs.select("a", "sig_a", "b", "sig_b").mapInPandas(agree, "a long, b long").unionAll(large).distinct()


class _Postings:
    """Counts the shingles that one set shares with each of the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def shared(self, i: int) -> np.ndarray:
        a, b = (np.searchsorted(self.flat, self.sets[i], side) for side in ("left", "right"))
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))


def _confirmed(docs: DataFrame, loose: DataFrame, classes: DataFrame, p: MinHash) -> DataFrame:
    """Spanning edges of the pairs in a loose component whose full sets are similar enough."""
    members = loose.withColumnRenamed("id", "rep").join(classes.select("rep", "n_shingles"), "rep")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / p.tile_shingles).alias("blocks"))
    members = tiles(members.join(blocks, "component"), F.col("rep"), F.col("blocks"))
    members = members.select("rep", "component", "block", "tile_a", "tile_b").hint("shuffle_hash")
    texts = docs.join(members, docs.doc_id == members.rep).drop("doc_id")

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep", kind="stable")
        cache = _Words()
        post = _Postings([shingle_set(t, p.words, cache) for t in f.text])
        rep, block = f.rep.to_numpy(), f.block.to_numpy()
        apart = f.tile_a.iloc[0] != f.tile_b.iloc[0]

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            both = post.shared(i)[others]
            ok = 100 * both >= p.threshold * (post.size[others] + post.size[i] - both)
            return ok & (~apart | (block[others] != block[i]))

        got = forest(linked, len(f))
        return pd.DataFrame({"a": rep[[i for i, _ in got]], "b": rep[[j for _, j in got]]}, dtype=np.int64)

    return grouped(texts, ["component", "tile_a", "tile_b"], tile, "a long, b long")


def near_duplicates(docs: DataFrame, p: MinHash | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    p = p or MinHash()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(signatures(docs, p))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n_shingles", "sig", "bands")])
    )
    loose = connected_components(_candidates(classes, p), "a", "b")
    exact = connected_components(_confirmed(docs, loose, classes, p), "a", "b")
    named = classes.select("k1", "k2", "rep").join(exact.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
