"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a window of ``block`` words that starts every ``block // 2`` words, so
each passage of half a block is inside one. Tokens are ordered by their frequency
over all blocks, rarest first. A template of t tokens that must share a of them
with a block is indexed under its first t - a + 1 tokens (prefix filter); a block
is tested against a template only if one of those is among its own, if it has at
least a tokens (length filter), and if after that token both have enough left
(positional filter). Then the overlap is counted. No block that meets the
threshold is lost.

Tokens that no template has cannot count towards an overlap, so blocks are sets of
template tokens. The index has as many rows as the templates have words, whatever
the size of the corpus, and is broadcast; only hits are shuffled.

The base phrases are templates that must be contained in full; each block found is
then checked for places where the words stand in a row.

Edge cases. A null text has no words. Each row of the input gives a row, repeated or
not. A text of any length is cut into blocks of the same size. Null ids pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import text_batches

# Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Sentences of public license notices, and the labels that they give.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PLACE = 1 << 20


@dataclass(frozen=True)
class Scan:
    """``threshold`` is the share of a notice's distinct words that a block must hold; ``block`` grows to twice the longest template."""

    threshold: float = 0.9
    block: int = 64
    notices: tuple = tuple(NOTICES)

    @property
    def half(self) -> int:
        longest = max(len(words_of(t)) for t in [*BASE, *[n for _, n in self.notices]])
        return max(self.block // 2, longest)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def notices_from(templates: DataFrame, label: str = "label", text: str = "text", least: int = 8, longest: int = 64) -> tuple[tuple[str, str], ...]:
    """Notices for :class:`Scan` from a table of license texts: each sentence of ``least`` words or more gives its text's label.

    Sentences end with a full stop, semicolon or colon before white space, or with an empty line; longer ones are cut into
    stretches of ``longest`` words. The table is read on the driver, as templates are: it has a row for each license and
    not for each document. Rows with null label or text are left out, sentences that come twice are kept once a label.
    """
    parts = F.explode(F.split(F.col(text), r"(?<=[.;:])\s+|\n\s*\n"))
    rows = templates.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), parts.alias("s")).distinct().collect()
    found = set()
    for r in rows:
        words = [w.decode("utf-8", "surrogatepass") for w in words_of(r["s"])]
        for k in range(0, len(words), longest):
            if len(words[k : k + longest]) >= least:
                found.add((r["label"], " ".join(words[k : k + longest])))
    return tuple(sorted(found))


def _templates(o: Scan) -> list[dict]:
    out = [{"label": v, "base": True, "words": [w.decode() for w in words_of(k)], "share": 1.0} for k, v in BASE.items()]
    out += [{"label": v, "base": False, "words": [w.decode() for w in words_of(k)], "share": o.threshold} for v, k in o.notices]
    return out


def _blocks(code: dict[bytes, int], words: list[bytes], half: int) -> dict[int, list[int]]:
    """For each block, place * _PLACE + token of its template tokens, in order."""
    out: dict[int, list[int]] = {}
    get = code.get
    for at, token in enumerate(map(get, words)):
        if token is not None:
            b = at // half
            out.setdefault(b, []).append(at * _PLACE + token)
            if b:
                out.setdefault(b - 1, []).append(at * _PLACE + token)
    return out


def _frequencies(docs: DataFrame, vocabulary: list[str], o: Scan) -> dict[str, int]:
    """Blocks that hold each template token: as many rows as the templates have distinct words."""

    half = o.half

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, n = {w.encode(): i for i, w in enumerate(vocabulary)}, Counter()
        for f in frames:
            for t in f.text:
                for tokens in _blocks(code, words_of(t), half).values():
                    n.update({x % _PLACE for x in tokens})
        yield pd.DataFrame({"token": list(n), "n": list(n.values())}, dtype="int64")

    rows = docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    found = {vocabulary[r["token"]]: r["n"] for r in rows}
    return {w: found.get(w, 0) for w in vocabulary}


def scan(docs: DataFrame, o: Scan | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, hits: the (label, base, containment, places) of each template found in each block."""
    o = o or Scan()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    templates = _templates(o)
    n = _frequencies(docs, sorted({w for t in templates for w in t["words"]}), o)
    order = {w: i for i, w in enumerate(sorted(n, key=lambda w: (n[w], w)))}
    index = []
    for k, t in enumerate(templates):
        tokens = sorted({order[w] for w in t["words"]})
        need = math.ceil(t["share"] * len(tokens))
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            index.append((token, i, k, tokens, need, t["label"], t["base"], [order[w] for w in t["words"]]))
    spark = docs.sparkSession
    index = spark.createDataFrame(index, "token int, i int, template int, tokens array<int>, need int, label string, base boolean, phrase array<int>")
    half = o.half

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {w.encode(): i for w, i in order.items()}
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        for f in text_batches(batches, "text", 4_000_000):
            rows = []
            for row, t in enumerate(f.column("text").to_pylist()):
                words = words_of(t)
                found = _blocks(code, words, half)
                for b in sorted({0, *found}):
                    places = found.get(b, [])
                    rows.append((row, len(words), b, sorted({x % _PLACE for x in places}), places))
            at, *made = zip(*rows, strict=True)
            made = [pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([f.column("row").take(pa.array(at)), f.column("doc_id").take(pa.array(at)), *made], names=["row", "doc_id", "n_words", "block", "own", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, f"row long, doc_id {kind}, n_words long, block long, own array<int>, places array<long>"
    )
    each = blocks.select("*", F.posexplode_outer("own").alias("j", "token")).join(F.broadcast(index), "token", "left")
    left = F.least(F.size("tokens") - F.col("i"), F.size("own") - F.col("j"))
    candidate = (F.size("own") >= F.col("need")) & (left >= F.col("need"))
    first = (F.col("block") == 0) & (F.coalesce(F.col("j"), F.lit(0)) == 0)
    each = each.withColumn("template", F.when(candidate, F.col("template"))).where(first | F.col("template").isNotNull())
    shared = F.size(F.array_intersect("own", "tokens"))
    head = F.element_at("phrase", 1)
    in_row = lambda p: F.forall(
        F.transform("phrase", lambda w, k: p - head + k * _PLACE + w), lambda x: F.array_contains("places", x)
    )
    starts = F.filter("places", lambda p: (F.pmod(p, F.lit(_PLACE)) == head) & (F.floor(p / _PLACE) < (F.col("block") + 1) * half) & in_row(p))
    hit = F.struct(
        "template", "block", "label", "base", (shared / F.size("tokens")).alias("containment"),
        F.when(F.col("base"), F.transform(starts, lambda p: F.floor(p / _PLACE))).alias("places"),
    )
    each = each.withColumn("hit", F.when(F.col("template").isNotNull() & (shared >= F.col("need")), hit))
    each = each.withColumn("hit", F.when(~F.col("hit.base") | (F.size("hit.places") > 0), F.col("hit")))
    return each.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits")).drop("row")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("hits", lambda h: h["base"])
    places = F.flatten(F.transform(base, lambda h: h["places"]))
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return scanned.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"),
    )
