"""Substring deduplication by hashing lines or paragraphs, and runs of words inside them.

A text is cut into units, lines or paragraphs. A unit's digest is that of its words with
A-Z in lower case and one space between them; digests are grouped over the corpus, the
occurrence of the lowest rank (doc_id, then row, then place) stays, and the others are
removed. The spans that were removed are returned in characters of the original text.
A unit of fewer than ``least`` words is common by chance and is left alone, unless ``often`` is set: then units
of ``short`` words or more that have over that share of as many occurrences as there are texts are boilerplate, and all
but their first go as well. Whether that is wanted depends on the corpus, as it changes every text that has such a line.

A passage that stands inside longer lines has no unit of its own, so runs of ``run`` words
are digested as well, wherever they begin: those whose hash is the least of ``window`` runs
in succession. The choice depends on the words alone and falls alike in every text. Of each
passage of run + window - 1 words or more that was seen before, all words go but at most
window - 1 at either end; each word that goes is part of a unit or of ``run`` words that
stand in the same order elsewhere. Where two equal runs of a text overlap, the first stays
whole. ``run = 0`` leaves runs out.

The rows are written once with a number, and so are the digests, with their places; what
is to be cut from a text comes to it by that number, so no text is digested twice. Digests
have 96 bits (of 10**13 about one pair in 10**3 corpora is alike by chance). They
are shuffled once, for a window over the occurrences of each. One that may have more than
``support`` of all occurrences is hot: a counting sketch names all of these and at most
1 / support, so the first occurrence of each is found with map-side combining and broadcast,
and no occurrence of a line that is in every text is shuffled.

Words are what ASCII white space separates. Edge cases. Null and empty texts have no units
and stay as they are. Rows that share a doc_id follow each other in an order of their own,
and null doc_ids rank last, so of repeated rows one stays. Other columns pass through,
whatever their names; of ``n_units``, ``n_removed`` and ``removed`` the result has its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.llm.common import plain_names, text_batches, with_columns, written

_LAST = 2**63 - 1
#: What a byte is compared as: A-Z in lower case, white space as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BREAKS = {"line": 1, "paragraph": 2}
#: An odd number and its inverse modulo 2**64: powers of rolling hashes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPAN = T.StructType().add("start", "long").add("end", "long")


@dataclass(frozen=True)
class Units:
    unit: str = "line"
    least: int = 15
    run: int = 25
    window: int = 16
    support: float = 0.001
    short: int = 4
    often: float = 0.0


def _powers(base: int, n: int, held: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in held or len(held[base]) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        held[base] = np.cumprod(steps, dtype=np.uint64)
    return held[base][:n]


def _rolling(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch first..end of ``values``, wherever it lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    return (sums[end] - sums[first]) * _powers(_INVERSE, len(values))[first]


class Words:
    """The words of several texts, which lie behind each other with a line feed between them."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw.translate(_FOLD), np.uint8)
        space = data == 32
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        before = np.concatenate(([True], space[:-1]))
        self.start, self.end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        #: Words of each text, and line feeds before each word.
        self.bound = np.searchsorted(self.start, np.concatenate(([0], ends)))
        self.feeds = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) == 10)))[self.start]
        self.data = data
        # The same words with one space between them.
        keep = ~space | ~before
        self.text = data[keep].tobytes()
        place = np.cumsum(keep) - 1
        self.at, self.to = place[self.start].tolist(), place[self.end].tolist()
        # Characters before a byte, from the beginning of its text.
        self.chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.first = np.concatenate(([0], ends[:-1]))
        self.last = ends - 1

    def digest(self, i: int, j: int, seed: int) -> bytes:
        return xxhash.xxh3_128_digest(self.text[self.at[i] : self.to[j - 1]], seed)

    def units(self, k: int, breaks: int) -> list[tuple[int, int]]:
        """(first word, word behind the last) of the units of text ``k``."""
        a, b = int(self.bound[k]), int(self.bound[k + 1])
        cuts = (np.flatnonzero(np.diff(self.feeds[a:b]) >= breaks) + a + 1).tolist()
        return list(zip([a, *cuts], [*cuts, b], strict=True)) if b > a else []

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        h = _rolling(self.data.astype(np.uint64), self.start, self.end)
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))

    def runs(self, k: int, hashes: np.ndarray, o: Units) -> list[tuple[int, int]]:
        """(first word, word behind the last) of the chosen runs of text ``k``."""
        a, n = int(self.bound[k]), int(self.bound[k + 1] - self.bound[k]) - o.run + 1
        if n < 1:
            return []
        order = _rolling(hashes[a : a + n + o.run - 1], np.arange(n), np.arange(n) + o.run)
        window = min(o.window, n)
        least = np.lib.stride_tricks.sliding_window_view(order, window).argmin(axis=1) + np.arange(n - window + 1)
        places = least[np.concatenate(([True], least[1:] != least[:-1]))] + a
        return [(i, i + o.run) for i in places.tolist()]


def digests_of(texts: list[str | None], o: Units) -> tuple[list[int], list[tuple[int, int, int, bytes]]]:
    """The number of units of each text, and (text, start, end, digest) of units and runs, in characters.

    The last bit of the digest of a unit of fewer than ``least`` words is set, that of all others is not.
    """
    w = Words([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])
    hashes = w.hashes() if o.run else None
    counts, owner, spans = [], [], []
    for k in range(len(texts)):
        units = w.units(k, _BREAKS[o.unit])
        counts.append(len(units))
        own = [(i, j, 1) for i, j in units if j - i >= (min(o.short, o.least) if o.often else o.least)]
        own += [(i, j, 0) for i, j in w.runs(k, hashes, o)] if o.run else []
        owner += [k] * len(own)
        spans += own
    if not spans:
        return counts, []
    k, (i, j, _) = np.array(owner), np.array(spans, np.int64).T
    # A span ends where the next word of its text begins, or at the text's end.
    ends = np.where(j < w.bound[k + 1], np.append(w.start, 0)[j], w.last[k])
    zero = w.chars[w.first[k]]
    start, end = (w.chars[w.start[i]] - zero).tolist(), (w.chars[ends] - zero).tolist()
    raw = [w.digest(*x) for x in spans]
    if o.often:
        few = [a and b - i < o.least for (i, b, a) in spans]
        raw = [d[:11] + bytes([d[11] | 128 if f else d[11] & 127]) + d[12:] for d, f in zip(raw, few, strict=True)]
    return counts, list(zip(owner, start, end, raw, strict=True))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, o: Units | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated units cut from ``text``, and n_units, n_removed, removed (start, end in the original)."""
    o = o or Units()
    docs, named = plain_names(docs, ("n_units", "n_removed", "removed"))
    doc_id, text = named[doc_id], named[text]
    rank = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("_rank")
    docs = written(docs.select("*", rank, F.monotonically_increasing_id().alias("_row")))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "text", 4_000_000):
            counts, found = digests_of(b.column("text").to_pylist(), o)
            # A span is start * 2**32 + end; the text's own row, without a digest, carries the number of its units, inverted.
            at, span, raw = zip(*[(k, ~n, bytes(16)) for k, n in enumerate(counts)], *[(k, a << 32 | b, d) for k, a, b, d in found], strict=True)
            at, hashes = pa.array(at, pa.int32()), np.frombuffer(b"".join(raw), np.int64)
            columns = [b.column("_rank").take(at), b.column("_row").take(at), pa.array(span, pa.int64()), pa.array(hashes[::2]), pa.array(hashes.view(np.int32)[2::4])]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "row", "span", "h1", "h2"])

    texts = docs.select("_rank", "_row", F.col(text).cast("string").alias("text")).where("text is not null")
    found = written(texts.mapInArrow(digests, "rank long, row long, span long, h1 long, h2 int"))
    units = found.where("span >= 0")
    # At most 1 / o.support numbers come to the driver.
    hot = units.stat.freqItems(["h1"], o.support).first()[0] or []
    place = F.struct("rank", "row", "span")
    order = Window.partitionBy("h1", "h2").orderBy("rank", "row", "span")
    cold = units.where(~F.col("h1").isin(hot)).withColumn("first", F.first(place).over(order))
    warm = units.where(F.col("h1").isin(hot))
    warm = warm.join(F.broadcast(warm.groupBy("h1", "h2").agg(F.min(place).alias("first"))), ["h1", "h2"])
    again = cold.unionByName(warm).where("row != first.row or span != first.span")
    if o.often:
        # Short units have a negative h2; of these only the common ones count.
        most = F.broadcast(texts.agg((F.count("*") * o.often).alias("most")))
        common = units.where("h2 < 0").groupBy("h1", "h2").agg(F.count("*").alias("n")).crossJoin(most).where("n > most").select("h1", "h2")
        again = again.where("h2 >= 0").unionByName(again.where("h2 < 0").join(common, ["h1", "h2"], "left_semi"))
    # Of two equal runs that overlap the first stays whole.
    start, end = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))
    later: Column = F.when(F.col("row") == F.col("first.row"), F.greatest(start("span"), end("first.span"))).otherwise(start("span"))
    gone = again.where(later < end("span")).select("row", (F.shiftleft(later, 32) + end("span")).alias("span"))
    each = gone.unionAll(found.where("span < 0").select("row", "span"))
    each = each.groupBy("row").agg(F.collect_list("span").alias("_spans")).withColumnRenamed("row", "_row").hint("shuffle_hash")
    joined = docs.drop("_rank").join(each, "_row", "left").drop("_row")
    new = T.StructType().add("n_units", "long").add("n_removed", "long").add("removed", T.ArrayType(_SPAN))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, text, 4_000_000):
            texts, counts, gone = b.column(text).to_pylist(), [], []
            for k, found in enumerate(b.column("_spans").to_pylist()):
                found = found or []
                spans = _merged([(s >> 32, s & 0xFFFFFFFF) for s in found if s >= 0])
                if spans:
                    t = texts[k]
                    texts[k] = "".join(t[i:j] for (_, i), (j, _) in zip([(0, 0), *spans], [*spans, (len(t), 0)], strict=True))
                counts.append(sum(~s for s in found if s < 0))
                gone.append([{"start": i, "end": j} for i, j in spans])
            columns = {text: pa.array(texts, b.schema.field(text).type), "n_units": pa.array(counts, pa.int64()), "n_removed": pc.cast(pc.list_value_length(pa.array(gone, span)), pa.int64()), "removed": pa.array(gone, span)}
            yield with_columns(b, columns, drop=("_spans",))

    out = joined.mapInArrow(cut, T.StructType([*joined.drop("_spans").schema.fields, *new.fields]))
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], *new.fieldNames())
