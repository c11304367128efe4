"""Benchmark decontamination by q-gram lemma filtering.

A text that holds an item of m bytes with at most k edits shares m - q + 1 - qk
q-grams with it, all within k neighbouring diagonals (Jokinen and Ukkonen 1991;
Rasmussen, Stoye and Myers 2006). Shared q-grams are counted in overlapping bands
of diagonals; a region is kept where a band reaches that bound, and is verified by
an alignment inside the band. Nothing within the edit budget is lost: q is the largest
number up to 8 for which the bound is at least one, so it is smaller for short items.

Both sides are compared as UTF-8 with A-Z lower-cased and runs of ASCII bytes
other than letters and digits as one space. A q-gram is one 64-bit integer, so no
hash of it can collide. An item of fewer than ``least`` compared bytes is looked for
as whole words, with a space before and behind it.

The items go to the tasks in blocks of at most ``block_bytes``, one pass over the
texts for each block. One block at a time is on the driver and in a plan; where there
are several, what a pass found or left is written before the next.

Shared q-grams are counted some hundred thousand at a time. Where a text and an item both repeat
themselves, their hits would be the product of their lengths; there a band is kept by the places in
its reach that have any q-gram of the item, which loses nothing either.

Edge cases. Null or empty texts and items match nothing. Repeated items are reported
for each id; repeated rows for each row. An empty benchmark finds nothing.
:func:`without_leaks` drops no row for an item of fewer than ``least`` bytes, as a word
or two are too short to accuse a text; :func:`leaks` reports them.
"""

from __future__ import annotations

import copy
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import delete, fresh, text_batches, written

_Q, _SLOTS = 8, 21
_Q_MASKS = [np.uint64(2 ** (8 * q) - 1) for q in range(_Q + 1)]
#: Hits that are held at a time; hits of one item beyond which it is taken for repetitive: in all, and a place of the texts.
_HITS, _MANY, _DENSE = 500_000, 4_000_000, 48
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FOUND = "doc_id long, item_id long, start long, length long, edits long"


@dataclass(frozen=True)
class Leaks:
    """``rate`` is the edit budget as a share of an item's bytes; a small one keeps q and so the filter sharp."""

    rate: float = 0.1
    least: int = 24
    block_bytes: int = 8_000_000


def _grams(data: bytes) -> np.ndarray:
    """The 8 bytes from each place as one integer, with zeros behind the end."""
    data += bytes(_Q)
    out = np.empty(len(data) - _Q, np.uint64)
    for i in range(_Q):
        n = len(out[i::_Q])
        out[i::_Q] = np.frombuffer(data, "<u8", n, i)
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def folded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Compared bytes with a space at either end, and the place of each in ``raw``; empty if nothing is compared."""
    b = np.frombuffer(raw.translate(_FOLD), np.uint8)
    word = np.flatnonzero(b != 32)
    if not len(word):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    keep = b != 32
    keep[1:] |= b[:-1] != 32
    at = np.flatnonzero(keep)
    at = at[np.searchsorted(at, word[0]) : np.searchsorted(at, word[-1]) + 1]
    space = np.full(1, 32, np.uint8)
    return np.concatenate([space, b[at], space]), np.concatenate([[max(0, at[0] - 1)], at, [min(len(b) - 1, at[-1] + 1)]])


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for n places each, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Postings:
    """Where the q-grams of the items of one q stand."""

    def __init__(self, index: Index, q: int):
        self.mask = _Q_MASKS[q]
        own = np.flatnonzero(index.q == q)
        n = index.size[own] - q + 1
        place = _runs(np.zeros(len(own), np.int64), n)
        item = np.repeat(own, n)
        flat = index.grams[index.first[item] + place] & self.mask
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.at, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.filled = np.zeros(1 << _SLOTS, bool)
        self.filled[_slot(self.keys)] = True

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the texts of q-grams that items have, and the number of each one's q-gram."""
        grams = grams & self.mask
        at = np.flatnonzero(self.filled[_slot(grams)])
        near = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        ok = self.keys[near] == grams[at]
        return at[ok], near[ok]

    def hits(self, at: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, item, place in the item) of each shared q-gram."""
        post = _runs(self.at[near], self.count[near])
        return np.repeat(at, self.count[near]), self.item[post], self.place[post]

    def repetitive(self, near: np.ndarray, most: int, items: int) -> np.ndarray:
        """Whether an item would have more than ``most`` hits."""
        times = np.repeat(np.bincount(near, minlength=len(self.keys)), self.count)
        return np.bincount(self.item, times, items) > most

    def without(self, items: np.ndarray) -> _Postings:
        """The same without the items of a mask."""
        kept, out = ~items[self.item], copy.copy(self)
        out.item, out.place = self.item[kept], self.place[kept]
        out.count = np.add.reduceat(kept.astype(np.int64), self.at)
        out.at = np.cumsum(out.count) - out.count
        return out


class Index:
    """The items' q-grams, their bands and bounds. Items lie one behind the other, whatever their lengths."""

    def __init__(self, items: list[tuple[int, str]], o: Leaks, least: int = 0):
        """Leaves out items of fewer than ``least`` compared bytes."""
        self.ids, kept, budget = [], [], []
        for name, text in items:
            b = folded(text.encode("utf-8", "surrogatepass"))[0]
            m = len(b) - 2
            if m > 0 and m >= least:
                self.ids.append(name)
                kept.append(b if m < o.least else b[1:-1])
                budget.append(math.floor(o.rate * m))
        self.flat = np.concatenate([*kept, np.zeros(_Q, np.uint8)])
        self.size, self.budget = np.array([len(b) for b in kept], np.int64), np.array(budget, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.q = np.minimum(_Q, self.size // (self.budget + 1))
        self.bound = self.size - self.q + 1 - self.q * self.budget
        self.width = np.maximum(16, self.budget + 1)
        self.span = self.width + self.budget
        self.grams = _grams(self.flat.tobytes())
        self.postings = [_Postings(self, q) for q in np.unique(self.q).tolist()]
        # Texts lie this far apart in the numbering of diagonals, so no band reaches two of them.
        self.margin = int(self.size.max(initial=0) + 3 * self.width.max(initial=0))

    def _regions(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, first diagonal in the text) of the bands that reach their item's bound."""
        grams, out = _grams(data.tobytes()), []
        far = self.margin * np.arange(len(starts), dtype=np.int64)
        for p in self.postings:
            at, near = p.found(grams)
            if int(p.count[near].sum()) > _MANY:
                dense = p.repetitive(near, max(_MANY, _DENSE * len(at)), len(self.ids))
                if dense.any():
                    out += [self._dense(i, grams & p.mask, starts, far) for i in np.flatnonzero(dense).tolist()]
                    p = p.without(dense)
            out += self._counted(p, at, near, starts, far)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _counted(self, p: _Postings, at: np.ndarray, near: np.ndarray, starts: np.ndarray, far: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bands with enough shared q-grams, by some hundred thousand hits at a time; counts of bands that later places can reach are carried on."""
        out, key, count = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = np.cumsum(p.count[near]) // _HITS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            place, item, own = p.hits(at[a:b], near[a:b])
            row = np.searchsorted(starts, place, "right") - 1
            diagonal, width = place + far[row] - own, self.width[item]
            band = diagonal // width
            both = diagonal - band * width < self.budget[item]
            new = np.concatenate([item * (1 << 40) + band, (item * (1 << 40) + band - 1)[both]]) + (1 << 20)
            key, one = np.unique(np.concatenate([key, new]), return_inverse=True)
            count = np.bincount(one, np.concatenate([count, np.ones(len(new), np.int64)]), len(key)).astype(np.int64)
            item, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 20)
            reach = at[b] + far[np.searchsorted(starts, at[b], "right") - 1] if b < len(at) else np.iinfo(np.int64).max
            done = band * self.width[item] + self.span[item] + self.size[item] < reach
            full = done & (count >= self.bound[item])
            out.append(self._placed(item[full], band[full], starts, far))
            key, count = key[~done], count[~done]
        return out

    def _placed(self, item: np.ndarray, band: np.ndarray, starts: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, first diagonal in the text) of bands; a band lies nearest to the text that its hits are in."""
        first = band * self.width[item]
        row = np.clip(np.searchsorted(starts + far, first + self.size[item] + self.span[item], "right") - 1, 0, len(starts) - 1)
        return item, row, first - far[row] - starts[row]

    def _dense(self, i: int, grams: np.ndarray, starts: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands of an item that repeats itself, against texts that repeat it too: hits would be the product of both.

        A band is kept where the places in its reach with any q-gram of the item reach the bound. That holds
        wherever the shared q-grams do, costs one pass, and leaves the rest to the alignment.
        """
        own = self.grams[self.first[i] : self.first[i] + self.size[i] - self.q[i] + 1] & _Q_MASKS[self.q[i]]
        at = np.flatnonzero(np.isin(grams, own))
        row = np.searchsorted(starts, at, "right") - 1
        x, w, reach = at + far[row], int(self.width[i]), int(self.span[i] + self.size[i])
        bands = np.unique(np.concatenate([np.unique(x // w) - k for k in range(reach // w + 2)]))
        n = np.searchsorted(x, bands * w + reach) - np.searchsorted(x, bands * w)
        bands = bands[n >= self.bound[i]]
        return self._placed(np.full(len(bands), i), bands, starts, far)

    def _aligned(self, windows: np.ndarray, at: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits, start and end in its window of the best alignment in each region; ``at`` is where each window begins.

        An edit weighs ``edit``, and a column's number rides along, so ties go to the first start.
        Items come in descending length.
        """
        size, span, first = self.size[items], int(self.span[items].max()), self.first[items]
        kind = np.int32 if (2 * size[0] + span) * (span + 1) < 2**31 else np.int64
        edit = kind(span + 1)
        columns = np.arange(span, dtype=kind)
        step, value, best = columns * edit, np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        d, at = np.tile(columns, (len(items), 1)), at[:, None] + np.arange(span)
        for r in range(size[0]):
            live = int(np.searchsorted(-size, -r, "left"))
            d, at = d[:live], at[:live]
            new = d + (windows[at + r] != self.flat[first[:live] + r][:, None]) * edit
            np.minimum(new[:, :-1], d[:, 1:] + edit, out=new[:, :-1])
            d = np.minimum.accumulate(new - step, axis=1) + step
            done = int(np.searchsorted(-size, -(r + 1), "left"))
            if done < live:
                best[done:live] = d[done:].argmin(axis=1)
                value[done:live] = d[np.arange(done, live), best[done:live]]
        return value // edit, value % edit, size + best

    def _verified(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of regions within their item's budget."""
        items, rows, bases = self._regions(data, starts)
        order = np.argsort(-self.size[items], kind="stable")
        items, rows, bases = items[order], rows[order], bases[order]
        # As many regions at a time as keep windows and table within a few megabytes.
        cost = np.cumsum(self.size[items] + 9 * self.span[items]) // 4_000_000
        cuts = [0, *[int(i) + 1 for i in np.flatnonzero(cost[1:] != cost[:-1])], len(items)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            i, row, base = items[a:b], rows[a:b], bases[a:b]
            n = self.size[i] + int(self.span[i].max())
            places, owner = _runs(base, n), np.repeat(row, n)
            inside = (places >= 0) & (places < sizes[owner])
            windows = np.where(inside, data[np.where(inside, places + starts[owner], 0)], 0)
            edits, begin, end = self._aligned(windows, np.cumsum(n) - n, i)
            begin, end = np.maximum(begin + base, 0), np.minimum(end + base, sizes[row])
            ok = (edits <= self.budget[i]) & (begin < end)
            yield from zip(*(x[ok].tolist() for x in (row, i, edits, begin, end)), strict=True)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, length, edits) of each region, in characters of the text."""
        if not self.ids:
            return []
        raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        parts = [folded(r) for r in raws]
        sizes = np.array([len(b) for b, _ in parts], np.int64)
        data = np.concatenate([x for b, _ in parts for x in (b, np.zeros(_Q, np.uint8))] or [np.zeros(_Q, np.uint8)])
        starts = np.cumsum(sizes + _Q) - sizes - _Q
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for row, i, e, s, t in self._verified(data, starts, sizes):
            found.setdefault((row, i), []).append((e, s, t))
        out = []
        for (row, i), regions in sorted(found.items()):
            place, raw = parts[row][1], raws[row]
            ends: list[tuple[int, int]] = []
            for e, s, t in sorted(regions):
                # Of regions that overlap the one of fewest edits stays; those that stay are in order of place.
                k = bisect_left(ends, (s, t))
                if (k == 0 or ends[k - 1][1] <= s) and (k == len(ends) or t <= ends[k][0]):
                    ends.insert(k, (s, t))
                    a, b = place[s], place[t - 1] + 1
                    head = len(raw[:a].decode("utf-8", "ignore"))
                    out.append((row, self.ids[i], head, len(raw[a:b].decode("utf-8", "ignore")), e))
        return out


def _blocks(benchmark: DataFrame, o: Leaks, item_id: str, text: str) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of a bounded size the items make, and the blocks, each read when it is wanted."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / o.block_bytes))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([tuple(r) for r in items.where(key == b).orderBy("item_id", "text").collect()] for b in range(n))


def leaks(docs: DataFrame, benchmark: DataFrame, o: Leaks | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, length, edits: a row for each region of a text that holds an item within its edit budget."""
    o = o or Leaks()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    n, blocks = _blocks(benchmark, o, item_id, item_text)
    out = None
    for block in blocks:

        def run(batches: Iterable[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            index = Index(block, o)
            for b in text_batches(batches, "text", 1_000_000):
                got = index.find(b.column("text").to_pylist())
                row, *rest = zip(*got, strict=True) if got else ((),) * 5
                names = ["doc_id", "item_id", "start", "length", "edits"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], names=names)

        part = rows.mapInArrow(run, _FOUND)
        part = written(part) if n > 1 else part
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, o: Leaks | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item of ``least`` bytes or more; no shuffle."""
    o = o or Leaks()
    n, blocks = _blocks(benchmark, o, item_id, item_text)
    held = None
    for k, block in enumerate(blocks):

        def run(batches: Iterable[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            index = Index(block, o, o.least)
            for b in text_batches(batches, text, 1_000_000):
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, *_ in index.find(b.column(text).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if k < n - 1:
            path = fresh(docs.sparkSession)
            docs = written(docs, path)
            if held:
                delete(docs.sparkSession, held)
            held = path
    return docs
