"""Spelling variants: a symmetric-delete join finds words one edit apart, and each word is led to its usual form.

1.  Each task counts the words of its documents; Spark adds the counts up.
2.  Every word emits a key of itself and one of each of its distinct single deletions.
    Words that share a key are candidates. A key is a hash of the remaining code points that
    is made from sums over the word, so a word of L code points costs L small rows and never
    L shortened copies. Deletions inside a run of equal code points are the same; the row
    carries the run's first and last position.
3.  Two words of one length differ by a replaced code point if they share a deletion whose
    positions meet; a word and a longer one differ by an inserted code point if the one is a
    deletion of the other. So each near pair comes from one key and once. Texts are then
    compared, which makes the result independent of the hash.
4.  A word's near words are aggregated to their number and the one of largest count. Its
    form is that one if its count leads clearly. Forms of forms are joined until none changes;
    as the count grows tenfold at each step, a few rounds suffice.

A key's group is bounded by the alphabet and the word's length: at most 90 code points in
L + 1 places. Nothing else is grouped.

Edge cases. A null or empty text has no words. A null doc_id is the empty string in
the hash of the slip. Rows that repeat count again. An empty table gives an empty result. Of
equal counts the smallest word in code-point order is the form. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import cut, text_batches, written

#: Two primes under 2**31 with a base each: together a key of 62 bits.
_FIELDS = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))
_HELD = 300_000


@dataclass(frozen=True)
class Spelling:
    """``length`` and ``count``: the least of a word. ``lead``: how many times a word's count its form's must be.

    ``slip``: a run whose crc32 with its document's id this divides loses a code point; 0 for none.
    """

    length: int = 7
    count: int = 2
    lead: int = 10
    slip: int = 31


def word_counts(docs: DataFrame, rule: Spelling, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: the runs of letters of whole texts, A-Z in lower case, each with its slip."""
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{rule.length},}}")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in text_batches(batches, "text", 1 << 24):
            for key, body in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = crc32(f"{key}:".encode())
                for run, k in Counter(runs.findall(body)).items():
                    word = run.encode().lower()  # of bytes: A-Z only
                    h = crc32(word, start)
                    if rule.slip and h % rule.slip == 0:
                        if len(run) == rule.length:
                            continue
                        at, whole = h % len(run), word.decode()
                        word = (whole[:at] + whole[at + 1 :]).encode()
                    held[word] += k
                if len(held) > _HELD:
                    yield _frame(held)
                    held.clear()
        if held:
            yield _frame(held)

    read = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null")
    return read.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.count)


def _frame(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(held.values(), pa.int64())})


def _powers(base: int, prime: int, most: int) -> np.ndarray:
    """``base ** i % prime`` for i up to ``most``, doubled until long enough."""
    out = np.ones(1, np.int64)
    while len(out) <= most:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """``(row, size, lo, hi, key)`` of each word (lo and hi -1) and of its distinct single deletions."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - first[row]
    whole, short = np.zeros(len(words), np.int64), np.zeros(len(points), np.int64)
    for prime, base in _FIELDS:
        sums = np.concatenate([[0], np.cumsum((points + 1) * _powers(base, prime, int(size.max()))[place] % prime)])
        total = (sums[first + size] - sums[first]) % prime
        before = (sums[:-1] - sums[first[row]]) % prime
        after = (sums[first + size][row] - sums[1:]) % prime * pow(base, -1, prime) % prime
        whole = (whole << 31) | total
        short = (short << 31) | ((before + after) % prime)
    new = np.concatenate([[True], (points[1:] != points[:-1]) | (row[1:] != row[:-1])])
    at = new.nonzero()[0]
    lo, hi = place[at], place[np.concatenate([at[1:] - 1, [len(points) - 1]])]
    none = np.full(len(words), -1)
    return tuple(np.concatenate(x) for x in ((np.arange(len(words)), row[at]), (size, size[row[at]]), (none, lo), (none, hi), (whole, short[at])))


def _shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that Spark must not broadcast: files of words are compressed and keys come from a map, so Spark sizes either far too low."""
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)`` once for each two ids of ``words (id, word)`` that are one insertion, deletion or replacement apart."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "word", 1 << 20):
            row, size, lo, hi, key = deletion_keys(batch.column("word").to_pylist())
            ids = batch.column("id").to_numpy()[row]
            yield pa.RecordBatch.from_pydict({"key": key, "id": ids, "size": size.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    keys = words.select("id", "word").where("length(word) > 0").mapInArrow(keyed, "key long, id long, size int, lo int, hi int")
    replaced = "a.lo >= 0 and b.lo >= 0 and a.size = b.size and a.id < b.id and greatest(a.lo, b.lo) <= least(a.hi, b.hi)"
    inserted = "a.lo < 0 and b.lo >= 0 and b.size = a.size + 1"
    found = keys.alias("a").join(_shuffled(keys.alias("b")), F.expr(f"a.key = b.key and (({replaced}) or ({inserted}))"))
    found = found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.expr("greatest(a.lo, b.lo)").alias("at"), F.expr("a.lo < 0").alias("longer"))
    own = lambda x: _shuffled(words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}")))
    named = found.join(own("a"), "a").join(own("b"), "b")
    rest = F.expr("substring(word_b, at + 2)")
    same = F.when(F.col("longer"), F.expr("substring(word_a, at + 1)") == rest).otherwise(F.expr("substring(word_a, at + 2)") == rest)
    return named.where((F.expr("substring(word_a, 1, at)") == F.expr("substring(word_b, 1, at)")) & same).select("a", "b")


def leading_forms(words: DataFrame, pairs: DataFrame, lead: int) -> DataFrame:
    """``(id, n_near, form_id, form, form_n)`` of the words that have near ones; no form where none leads."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p")).select("p.*")
    other = words.select(F.col("id").alias("other"), (-F.col("n")).alias("less"), F.col("word"))
    best = both.join(_shuffled(other), "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "word", "other")).alias("best"))
    leads = -F.col("best.less") >= lead * F.col("n")
    kept = best.join(_shuffled(words.select("id", "n")), "id")
    return kept.select("id", "n_near", F.when(leads, F.col("best.other")).alias("form_id"), F.when(leads, F.col("best.word")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))


def followed(links: DataFrame) -> DataFrame:
    """``(id, root)``: ``links (id, root)`` joined with themselves until no root has a link of its own; there must be no cycle."""
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        links = cut(links.join(_shuffled(ahead), "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("id", "root")
        links = links.select("id", "root")


def variants(docs: DataFrame, rule: Spelling = Spelling(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``docs``."""
    words = written(word_counts(docs, rule, doc_id, text).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    forms = written(leading_forms(words, near_pairs(words), rule.lead))
    roots = followed(forms.where("form_id is not null").select("id", F.col("form_id").alias("root")))
    named = roots.join(_shuffled(words.select(F.col("id").alias("root"), F.col("word").alias("_root"))), "root").select("id", "_root")
    out = words.join(_shuffled(forms), "id", "left").join(_shuffled(named), "id", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
