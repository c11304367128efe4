"""Column functions on questions, passages and vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\p{Punct}‍]+|[\p{Punct}‍]+$"
# Greetings and thanks that are no question.
SMALL_TALK = {"greeting": ("hello", "hi", "good morning", "good evening"), "thanks": ("thank you", "thanks"), "bye": ("bye", "goodbye")}


def words(text: Column) -> Column:
    """Words with the punctuation at their ends removed (F1)."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def _neighbours(first: str, second: str | None) -> Callable[[Column], Column]:
    return lambda e: (e["w"] == first) & (e["next"].isNotNull() if second is None else F.coalesce(e["next"] == second, F.lit(False)))


def question_class(
    text: Column, pairs: Sequence[tuple[str, str | None, str]], stems: Mapping[str, Sequence[str]], exact: Mapping[str, Sequence[str]] | None = None, skip: Sequence[str] = (), other: str = "other"
) -> Column:
    """The class of a question (F2).

    First of the first pair of neighbouring words that the text has (a second word of None is any word); else the
    first class, in the order of ``stems``, one of whose stems begins a word or whose exact words occur, unless a
    word of ``skip`` follows, which makes it indefinite; else ``other``.
    """
    own = words(F.lower(text))
    each = F.transform(own, lambda w, i: F.struct(w.alias("w"), F.get(own, i + 1).alias("next")))

    def of_class(name: str) -> Column:
        def fits(e: Column) -> Column:
            hit = e["w"].isin(*(exact or {}).get(name, []))
            for s in stems[name]:
                hit = hit | F.startswith(e["w"], F.lit(s))
            return hit & ~F.coalesce(e["next"].isin(*skip), F.lit(False))

        return F.exists(each, fits)

    out = F.lit(other)
    for name in reversed(stems):
        out = F.when(of_class(name), name).otherwise(out)
    for a, b, name in reversed(pairs):
        out = F.when(F.exists(each, _neighbours(a, b)), name).otherwise(out)
    return out


def has_word(text: Column, ambiguous: Sequence[str]) -> Column:
    """Whether one of the words stands in the text by itself."""
    return F.coalesce(F.arrays_overlap(words(text), F.array(*map(F.lit, ambiguous))), F.lit(False))


def has_digit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\d"), F.lit(False))


def in_script(text: Column, first: str = "0D80", last: str = "0DFF") -> Column:
    """Whether a character of a range of code points occurs."""
    return F.coalesce(text.rlike(rf"[\x{{{first}}}-\x{{{last}}}]"), F.lit(False))


def small_talk(text: Column, phrases: dict[str, Sequence[str]] | None = None, most: int = 5) -> Column:
    """The kind of a short text that begins with a phrase, its punctuation ?!., taken out, else null."""
    t = F.trim(F.regexp_replace(F.translate(F.lower(text), "?!.,", ""), r"\s+", " "))
    out = F.lit(None).cast("string")
    for kind, own in reversed((phrases or SMALL_TALK).items()):
        hit = F.lit(False)
        for p in own:
            hit = hit | F.startswith(t, F.lit(p))
        out = F.when(hit & (F.size(F.split(t, " ")) <= most), kind).otherwise(out)
    return out


def without_greeting(text: Column, phrases: Sequence[str]) -> Column:
    """Cuts the longest phrase at the beginning, if something is left."""
    alternatives = "|".join(sorted(phrases, key=len, reverse=True))
    rest = F.trim(F.regexp_replace(text, rf"(?i)^\s*(?:{alternatives})\b[\s,.!]*", ""))
    return F.when(rest != "", rest).otherwise(text)


def without_sentences(text: Column, markers: Sequence[str], fallback: str) -> Column:
    """Drops sentences that hold a marker; a fixed text if none is left."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~F.lower(s).rlike("|".join(markers)))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(fallback)


def section_references(text: Column, levels: int = 2) -> Column:
    """Section numbers named in a text, such as 3.1 (F8)."""
    return F.regexp_extract_all(text, F.lit(rf"\b\d+(?:\.\d+){{1,{levels}}}\b"), F.lit(0))


def bullets(text: Column) -> Column:
    """Lines of a bulleted text, without bullets and empty lines."""
    return F.array_join(F.filter(F.transform(F.split(text, "•"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def dehyphenated(text: Column) -> Column:
    """Lines that end in a hyphen are joined with the next; the hyphen stays, as in a range or a compound."""
    return F.regexp_replace(text, r"(?<=[A-Za-z0-9])-\n(?=[A-Za-z0-9])", "-")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length (V1)."""
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def softmax(values: Column) -> Column:
    """Exponentials that add up to one."""
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def windows(text: Column, size: int = 250, overlap: int = 50) -> Column:
    """(start, words) of overlapping word windows; the last one ends at the text's end (V4)."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size(own) - overlap) / step)).cast("int")
    starts = F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * step).cast("int")))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(own, s + 1, size).alias("words")))
