"""Divergence of sources: how far the word shares of each two sources of a language lie apart.

1.  Each task counts terms and their documents for each (lang, source); Spark adds them up.
    A language keeps the terms that stand in enough of its documents.
2.  A language's terms are dealt by hash into vocabulary chunks of about ``chunk`` terms, and
    its sources into blocks of about ``block`` groups. A group's counts in a chunk are packed
    into one row.
3.  The rows go to the tasks of a two-dimensional grid: block against block, a run of
    successive chunks each. A task unpacks one chunk of its two blocks at a time and adds to
    its submatrix of pairs; Spark sums the submatrices of the runs. Work and memory of a task
    depend on ``block``, ``chunk`` and ``run`` only, so neither a language with most
    of the rows nor one with very many sources or terms lands in one task.
4.  The most telling terms of a source are its terms that are likelier than in its language,
    by the same measure.

All arithmetic is on integers. A quotient of 10**9 is taken in two steps, exact for up to 9e13 occurrences.

Edge cases. Null text, lang and source are empty strings. A group without terms is there: with
the other sources of its language, and no term rows. A language without kept terms has the value 0 for
each pair. One without a second source has no pair rows. Rows that repeat count again; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import text_batches, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_HELD = 300_000


@dataclass(frozen=True)
class Audit:
    """``docs``: the least documents of a term in its language; ``terms``: telling terms a group. The others shape tasks, not results."""

    docs: int = 10
    terms: int = 10
    chunk: int = 512
    block: int = 32
    run: int = 32
    spread: int = 64


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, term, c, d)``: occurrences and documents of each term; a row with term null for each group that occurs."""
    terms = re.compile(TERM)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def full() -> pa.RecordBatch:
            rows = [(*g, t, c[t], d[t]) for g, (c, d) in held.items() for t in (None, *c)]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["lang", "source", "term", "c", "d"])

        for batch in text_batches(batches, "text", 1 << 24):
            for *group, body in zip(*(batch.column(n).to_pylist() for n in ("lang", "source", "text")), strict=True):
                c, d = held.setdefault(tuple(group), (Counter(), Counter()))
                found, before = terms.findall(body.encode().lower().decode()), len(c)
                c.update(found)
                d.update(set(found))
                size += len(c) - before
                if size > _HELD:
                    yield full()
                    held, size = {}, 0
        if held:
            yield full()

    read = docs.select(*(F.coalesce(F.col(x), F.lit("")).alias(n) for x, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    return read.mapInArrow(counted, "lang string, source string, term string, c long, d long").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def share(count: str, of: str, terms: str) -> Column:
    """1 + floor(10**9 * (count + 2) / (of + 2 * terms)), in two steps so that nothing overflows."""
    below = f"({of} + 2 * {terms})"
    return F.expr(f"1 + ((({count} + 2) * 10000) div {below}) * 100000 + (((({count} + 2) * 10000) % {below}) * 100000) div {below}")


def _shares(count: np.ndarray, of: np.ndarray, terms: int) -> np.ndarray:
    below = (of + 2 * terms)[:, None]
    high, rest = np.divmod((count + 2) * 10_000, below)
    return 1 + high * 100_000 + rest * 100_000 // below


def _dealt(df: DataFrame, item: str, parts: Column, part: str, place: str) -> DataFrame:
    """Adds the part of ``item`` in its language, by hash, and its place there: windows are as small as parts are."""
    df = df.withColumn(part, F.pmod(F.xxhash64(item), F.greatest(F.lit(1), F.ceil(parts))).cast("int"))
    return df.withColumn(place, (F.row_number().over(Window.partitionBy("lang", part).orderBy(item)) - 1).cast("int"))


def _tile_sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of f for the pairs of each tile; rows come sorted by tile, run and chunk, and one chunk is held at a time."""
    tile, sums, names, rows = None, None, ((), ()), []

    def add() -> None:
        nonlocal sums, names
        a, b = [r for r in rows if r.own == r.tile_a], [r for r in rows if r.own == r.tile_b]
        if sums is None:
            sums, names = np.zeros((len(a), len(b)), np.int64), ([r.source for r in a], [r.source for r in b])
        if width := rows[0].width:
            p, q = (_shares(_unpacked(x, width), np.array([r.total for r in x], np.int64), rows[0].terms) for x in (a, b))
            for i in range(len(a)):
                j = i + 1 if rows[0].tile_a == rows[0].tile_b else 0
                apart = p[i] - q[j:]
                sums[i, j:] += (apart * apart // (p[i] + q[j:])).sum(axis=1)

    def out() -> pd.DataFrame:
        # Text as objects: pandas may hold a column of text in chunks, which a struct cannot take.
        i, j = np.triu_indices(len(names[0]), 1) if tile[1] == tile[2] else (x.ravel() for x in np.indices(sums.shape))
        texts = {"lang": [tile[0]] * len(i), "a": [names[0][k] for k in i], "b": [names[1][k] for k in j]}
        return pd.DataFrame({n: pd.Series(x, dtype=object) for n, x in texts.items()} | {"value": sums[i, j]})

    for frame in batches:
        for row in frame.itertuples(index=False):
            if rows and (row.lang, row.tile_a, row.tile_b, row.run, row.chunk) != (rows[0].lang, rows[0].tile_a, rows[0].tile_b, rows[0].run, rows[0].chunk):
                add()
                rows = []
            if tile != (now := (row.lang, row.tile_a, row.tile_b, row.run)):
                if tile is not None:
                    yield out()
                tile, sums = now, None
            rows.append(row)
    if rows:
        add()
        yield out()


def _unpacked(rows: list, width: int) -> np.ndarray:
    counts = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        if r.places is not None:
            counts[i, np.asarray(r.places, np.int64)] = r.counts
    return counts


def pair_sums(groups: DataFrame, chunks: DataFrame, packed: DataFrame, rule: Audit) -> DataFrame:
    """``(lang, a, b, value)`` once for each two sources of a language.

    ``groups (lang, source, total, terms, parts)``, ``chunks (lang, chunk, width)``, ``packed (lang, source, chunk, places, counts)``.
    """
    sizes = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rule.block)).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.join(chunks, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    tiled = each.select("lang", "source", "total", "terms", "chunk", "width", "places", "counts", "own", F.floor(F.col("chunk") / rule.run).cast("int").alias("run"), other)
    tiled = tiled.withColumns({"tile_a": F.least("own", "_other"), "tile_b": F.greatest("own", "_other")}).drop("_other")
    keys = ["lang", "tile_a", "tile_b", "run"]
    placed = tiled.repartition(*keys).sortWithinPartitions(*keys, "chunk", "own", "source")
    return placed.mapInPandas(_tile_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.cast("int").alias("rank"))


def audit(docs: DataFrame, rule: Audit = Audit(), lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` with each other source of the language, ``term`` the most telling terms."""
    counts = written(term_counts(docs, lang, source, text))
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("d").alias("lang_d")).where(F.col("lang_d") >= rule.docs)
    vocabulary = written(vocabulary.drop("lang_d"))
    langs = counts.select("lang").distinct().join(vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_c").alias("lang_total")), "lang", "left")
    langs = langs.na.fill(0, ["terms", "lang_total"]).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("terms") / rule.chunk)).cast("int"))
    # A language's terms meet its sums in several tasks.
    spread = F.explode(F.sequence(F.lit(0), F.lit(rule.spread - 1)))
    sized = vocabulary.withColumn("_spread", F.pmod(F.xxhash64("term"), F.lit(rule.spread)).cast("int")).join(langs.withColumn("_spread", spread), ["lang", "_spread"])
    numbered = _dealt(sized.drop("_spread"), "term", F.col("parts"), "chunk", "place").drop("parts")
    chunks = numbered.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    kept = written(counts.join(numbered, ["lang", "term"]).select("lang", "source", "term", "c", "lang_c", "terms", "lang_total", "chunk", "place"))
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(langs.select("lang", "terms", "parts"), "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    listed = F.array_sort(F.collect_list(F.struct("place", "c")))
    packed = kept.groupBy("lang", "source", "chunk").agg(listed.alias("l")).select("lang", "source", "chunk", F.col("l.place").alias("places"), F.col("l.c").alias("counts"))
    pairs = pair_sums(groups, chunks, packed, rule)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value").select("lang", "p.*", "value")
    telling = kept.join(totals, ["lang", "source"]).withColumns({"p": share("c", "total", "terms"), "q": share("lang_c", "lang_total", "terms")})
    telling = telling.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return _ranked(both, "pair").unionByName(_ranked(telling, "term").where(F.col("rank") <= rule.terms))
