"""Main text of web pages by consensus of each host's pages on where it stands.

1.  Each page is read once into blocks of text, each with the path of its container: the
    tags and classes from the root, digits of classes generalised. Menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles, hidden parts and reader comments are left out
    by tag, role, or a word of class or id.
2.  A page's containers are scored by the prose below them, which is their characters outside
    links. The page's own choice is the deepest container with most of its prose, or the article around it.
3.  Spark adds up each host's votes on paths, each weighted by the root of its prose, so that
    long articles say where short ones stand. Paths with a share of the votes win.
4.  Each page is extracted again: the blocks below the best winning path that has text there,
    else below its own choice. So text beside a short article, which its page alone cannot
    tell from it, goes where the host's other pages show the article's place.

White space in a block becomes one space; blocks are joined by one space in page order. Every
block of the chosen containers stays. Inside an article, a header keeps its headings only. A form
that holds most of a page's text is a page inside a form and stays. An h1 right above the chosen container stays.

Edge cases. A null or empty page, or one with nothing but what is left out, gives the empty
string. A page with a null url, or a url without a host, follows its own choice. Open elements, raw text and
comments end with the page; paths have 64 containers at most, and what is
nested in over 512 elements counts as text of the 512th. Rows that repeat vote
again and stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt
from zlib import crc32

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import text_batches, written

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in _RAW}
#: Containers make paths; other blocks only part texts.
_CONTAINERS = frozenset("html body main article section div td th tr table tbody thead tfoot ul ol li dl dd dt blockquote center form fieldset details figure hgroup header footer nav aside dialog".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre address hr figcaption summary caption legend option optgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEFT_OUT = frozenset("head nav footer aside dialog menu button select label legend template noscript svg canvas audio video object map".split())
_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of classes and ids that mark what is not the article; a name with a word of the second list speaks of a state and not of a part.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer topbar toolbar cookie cookies consent gdpr notice "
    "popup popover modal lightbox overlay newsletter subscribe subscription signup login paywall search share sharing social related recommended comments comment commentlist disqus respond reply replies pagination pager "
    "copyright disclaimer alert alerts notification notifications announcement aside widget widgets rail skip hidden".split()
)
#: Classes of articles also name their subjects, so there only a first word speaks of the part.
_NO_ARTICLE = frozenset("ad ads advert promo sponsored comment comments reply related recommended teaser".split())
_STATES = frozenset("with without has no not is open enabled disabled".split())
_HEADS = frozenset("header masthead".split())
#: What an opening tag ends, and what stops the search for it.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_DEPTH, _STEP, _OPEN = 64, 32, 512
_OUT, _HEAD, _FORM = 1, 2, 4


@dataclass(frozen=True)
class Consensus:
    """``most``: per cent of a page's prose that its container holds; ``share``: per cent of a host's votes that a winning path has."""

    most: int = 80
    share: int = 10


def _step(name: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").split()})
    step = ".".join([name, *(c.replace("/", "-") for c in classes)])
    return step if len(step) <= _STEP else f"{name[:16]}.{crc32(step.encode('utf-8', 'replace')):08x}"


def _marked(name: str, attrs: dict[str, str]) -> int:
    """What an element's tag, role, classes and id say of what is below it."""
    if name in _LEFT_OUT or attrs.get("role", "").lower() in _ROLES:
        return _OUT
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))):
        return _OUT
    out = _HEAD if name == "header" or attrs.get("role") == "banner" else _FORM if name == "form" else 0
    if attrs and name not in ("html", "body", "main"):
        for label in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(label)]
            if name == "article":
                out |= _OUT if words and words[0] in _NO_ARTICLE else 0
                continue
            words = set(words)
            if not words & _STATES:
                out |= _OUT if words & _MARKS else _HEAD if words & _HEADS else 0
    return out


class _Page:
    """Blocks of one page: ``(path, text, prose, marks, heading)`` in order."""

    def __init__(self) -> None:
        self.paths: dict[str, int] = {}
        self.blocks: list[tuple[int, str, int, int, bool]] = []
        self.stack: list[tuple[str, str, int, int]] = [("", "", 0, 0)]  # name, path, marks, containers above
        self.beyond: Counter[str] = Counter()  # open elements that the stack has no room for
        self.parts: list[str] = []
        self.linked, self.link = 0, 0  # characters of the block inside links; depth of the stack at which a link is open

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                name, path, marks, _ = self.stack[-1]
                self.blocks.append((self.paths.setdefault(path, len(self.paths)), text, max(0, len(text) - 2 * self.linked), marks, name in _HEADINGS))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if not self.stack[-1][2] & _OUT:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link:
                self.linked += len(raw.strip())

    def pop(self, depth: int) -> None:
        del self.stack[depth:]
        if self.link > depth:
            self.link = 0

    def open(self, name: str, raw: str) -> None:
        attrs = {}
        if raw and "=" in raw or raw.strip(" /\n\t"):
            for k, a, b, c in _ATTR.findall(raw):
                attrs.setdefault(k.lower(), html.unescape(a or b or c))
        if name == "a":
            self.link = len(self.stack) if "href" in attrs else 0
            if not attrs.keys() & {"class", "id", "hidden"}:
                return
        block = name in _CONTAINERS or name in _LEAVES or "-" in name
        marks = _marked(name, attrs)
        if block:
            self.flush()
            for depth in range(len(self.stack) - 1, 0, -1):  # a block ends an open paragraph or heading
                if self.stack[depth][0] in _CONTAINERS:
                    break
                if self.stack[depth][0] in _LEAVES:
                    self.pop(depth)
                    break
            if name in _ENDS:
                same, stop = _ENDS[name]
                last = 0
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.stack[depth][0] in stop:
                        break
                    if self.stack[depth][0] in same:
                        last = depth
                if last:
                    self.pop(last)
        elif not marks:
            if name == "br":
                self.parts.append(" ")
            return
        if name in _VOID:
            return
        _, path, above, depth = self.stack[-1]
        if name in _CONTAINERS or "-" in name:
            if depth < _DEPTH:
                path, depth = f"{path}/{_step(name, attrs)}", depth + 1
        if len(self.stack) > _OPEN:
            self.beyond[name] += 1
            return
        if marks & _HEAD and not self._article():
            marks |= _OUT
        if not block and marks & _OUT:
            self.parts.append(" ")  # what is left out parts the words beside it
        self.stack.append((name, path, above | marks, depth))

    def _article(self) -> bool:
        return any(e[0] == "article" for e in self.stack)

    def close(self, name: str) -> None:
        if name == "a":
            self.link = 0
        block = name in _CONTAINERS or name in _LEAVES or "-" in name
        if block:
            self.flush()
        elif name == "br":
            self.parts.append(" ")
        if self.beyond[name]:
            self.beyond[name] -= 1
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == name:
                self.pop(depth)
                return
            if not block and self.stack[depth][0] in _CONTAINERS:
                return  # an inline end does not reach beyond its block
            if name in _LEAVES and self.stack[depth][0] in _CONTAINERS:
                return


def read_page(source: str) -> tuple[list[str], list[int], list[str], list[int], list[bool]]:
    """A page's container paths, and for each block its path's number, text, prose and whether it is a heading."""
    page, at, size = _Page(), 0, len(source)
    while at < size:
        tag = _TAG.search(source, at)
        if tag is None:
            page.text(source[at:])
            break
        if tag.start() > at:
            page.text(source[at : tag.start()])
        at = tag.end()
        if name := tag["name"]:
            name = name.lower()
            if name in _RAW:
                end = _RAW_END[name].search(source, at)
                at = end.start() if end else size
            elif name == "plaintext":
                at = size
            else:
                page.open(name, tag["attrs"])
        elif end := tag["end"]:
            if (end := end.lower()) not in _RAW:
                page.close(end)
    page.flush()
    forms = [sum(len(b[1]) for b in page.blocks if bool(b[3] & _FORM) is x) for x in (False, True)]
    kept = [b for b in page.blocks if not b[3] & _OUT and (not b[3] & _HEAD or b[4]) and (not b[3] & _FORM or forms[1] > forms[0])]
    return list(page.paths), [b[0] for b in kept], [b[1] for b in kept], [b[2] for b in kept], [b[4] for b in kept]


def own_choice(paths: list[str], at: list[int], prose: list[int], most: int) -> tuple[str | None, int]:
    """The deepest container with ``most`` per cent of the prose, or the article around it; and the page's prose."""
    total = sum(prose)
    if not total:
        return None, 0
    held: dict[str, int] = {}
    for i, n in zip(at, prose, strict=True):
        held[paths[i]] = held.get(paths[i], 0) + n
    below: dict[str, int] = {}
    for path, n in held.items():
        for end in [i for i, c in enumerate(path) if c == "/"][1:] + [len(path)]:
            below[path[:end]] = below.get(path[:end], 0) + n
    best = max((p for p, n in below.items() if 100 * n >= most * total), key=lambda p: (p.count("/"), below[p], p), default="")
    steps = best.split("/")
    around = [k for k, s in enumerate(steps) if s == "article" or s.startswith("article.")]
    return ("/".join(steps[: around[-1] + 1]) if around else best), total


def blocks(pages: DataFrame, rule: Consensus, page_id: str, url: str, source: str) -> DataFrame:
    """``(page_id, url, host, own, weight, page)``, one row a page; ``page`` holds its blocks, compressed, as they are written and shuffled."""
    kinds = {"own": pa.string(), "weight": pa.int64(), "page": pa.binary()}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor()
        for batch in text_batches(batches, "html", 1 << 23):
            rows = []
            for body in batch.column("html").to_pylist():
                paths, at, texts, prose, headings = read_page(body or "")
                own, total = own_choice(paths, at, prose, rule.most)
                page = packer.compress(json.dumps([paths, at, texts, headings], ensure_ascii=False).encode("utf-8", "replace")) if texts else None
                rows.append((own, isqrt(total), page))
            new = {n: pa.array(x, t) for x, (n, t) in zip(zip(*rows, strict=True), kinds.items(), strict=True)}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("page_id", "url", "host")} | new)

    host = F.regexp_extract(F.lower(F.trim(F.col(url))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.nullif(host, F.lit("")).alias("host"), F.col(source).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"page_id {kind}, url string, host string, own string, weight long, page binary")


def winning_paths(read: DataFrame, rule: Consensus) -> DataFrame:
    """``(host, winners)``: paths with a share of the host's votes, best first; at most 100 / ``share`` of them."""
    votes = read.where("host is not null and own is not null").groupBy("host", "own").agg(F.sum("weight").alias("votes"))
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    won = votes.join(totals, "host").where(F.col("votes") * 100 >= F.col("all_votes") * rule.share)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), F.col("own").alias("path"))))
    return won.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("winners"))


def chosen(paths: list[str], at: list[int], tried: Iterable[str | None]) -> str | None:
    """The first of the paths tried that has blocks below it."""
    held = [paths[i] for i in set(at)]
    return next((c for c in tried if c is not None and any(p == c or p.startswith(f"{c}/") for p in held)), None)


def text_below(path: str, paths: list[str], at: list[int], texts: list[str], headings: list[bool]) -> str:
    """All blocks below a path in page order, with the heading right above it."""
    above = path.rpartition("/")[0]
    if re.split("[/.]", above.rpartition("/")[2])[0] in ("", "html", "body"):
        above = None
    below = [p == path or p.startswith(f"{path}/") for p in paths]
    return " ".join(t for i, t, h in zip(at, texts, headings, strict=True) if below[i] or (h and paths[i] == above))


def extract(pages: DataFrame, rule: Consensus = Consensus(), page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, path)`` for each row of ``pages``."""
    read = written(blocks(pages, rule, page_id, url, source))
    found = read.join(winning_paths(read, rule), "host", "left").select("page_id", "url", "own", "winners", "page")

    def taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in text_batches(batches, "page", 1 << 21):
            texts, picked = [], []
            for own, winners, page in zip(*(batch.column(n).to_pylist() for n in ("own", "winners", "page")), strict=True):
                blocks = json.loads(reader.decompress(page)) if page else [[], []]
                path = chosen(blocks[0], blocks[1], [*(winners or ()), own])
                picked.append(path)
                texts.append(text_below(path, *blocks) if path is not None else "")
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()), "path": pa.array(picked, pa.string())}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("page_id", "url")} | new)

    kind = found.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(taken, f"page_id {kind}, url string, text string, n_chars long, path string")
