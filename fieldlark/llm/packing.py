"""Cost-balanced packing of documents into sequences of bounded length.

A document's ids, with a closing id, are cut at multiples of the sequence length.
Whole stretches are sequences by themselves. The remainders of ``bucket_docs``
documents are packed together: in descending length, each goes to the sequence of
the lowest estimated attention cost (linear plus quadratic in the piece's length)
that has room for it. One for which no sequence has room is cut at the end of the
emptiest one and goes on with its rest.

A bucket opens as many whole sequences as its ids fill, and for the last ids
sequences of distinct powers of two that add up to them. All are filled to the end,
so no bucket pads anything, however small it is. Buckets are runs of rows of one
partition, so nothing is shuffled, no key can be hot, and a task that is lost is
done again by itself: a sequence's number holds that of its partition.

Edge cases. A null text counts as empty and gives its closing id alone. Repeated
rows are packed as often as they come; a null doc_id stays null. Remainders of one
length keep the order of the rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import text_batches

# White space of the tokenizer's pattern: the characters with Unicode's property White_Space.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD, _EDGE = f"[{_SPACE}] [{_SPACE}]", f"^$|^[{_SPACE}]|[{_SPACE}]$"
_LOADED: dict[str, "Encoder"] = {}
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Packing:
    """``linear`` and ``quadratic`` weigh a piece's length and its square; ``end_id`` closes each document."""

    length: int = 1024
    linear: float = 1.0
    quadratic: float = 1 / 1024
    end_id: int = 0
    bucket_docs: int = 4_096
    tokenizer: str = field(default_factory=default_tokenizer)


class Encoder:
    """Ids of a byte-level BPE tokenizer, word by word.

    A space before a character that is not white space always starts a new word of
    the tokenizer, so texts can be cut there and each distinct stretch of a batch is
    encoded once: all of them joined, as only the first token of a stretch begins with
    a space. Texts with a space inside longer white space, or with a special token in
    them, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)

    def _ranks(self, path: str):
        """The same vocabulary as ranks, where it is at hand; it is faster on short stretches."""
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if not path.endswith("byte_bpe_50k.json") or not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.opens = np.zeros(max(table.values()) + 1, bool)
        self.opens[[i for b, i in table.items() if b.startswith(b" ")]] = True
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _stretches(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each word, and how many each has."""
        alone = pc.match_substring_regex(words, _EDGE)
        joined = words.filter(pc.invert(alone))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), pa.scalar(" ", pa.large_string()))[0].as_py()
        flat = self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype("<u4") if len(joined) else np.zeros(0, "<u4")
        start = np.flatnonzero(self.opens[flat])
        few = [self.fast.encode_ordinary(" " + w) for w in words.filter(alone).to_pylist()]
        size, alone = np.zeros(len(words), np.int64), alone.to_numpy(zero_copy_only=False)
        size[~alone], size[alone] = np.diff(np.append(start, len(flat))), [len(x) for x in few]
        out = np.empty(int(size.sum()), "<u4")
        own = np.repeat(alone, size)
        out[~own], out[own] = flat, [i for x in few for i in x]
        return out, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.fast is None:
            found = self._whole(texts.to_pylist())
            return np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        cut = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
        ends = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        ids, size = self._stretches(words.dictionary)
        at = words.indices.to_numpy().astype(np.int64)
        # What begins a text stands there without a space, and an odd text is whole: these come behind the words.
        whole = iter(self._whole(texts.filter(odd).to_pylist()))
        begins = words.dictionary.take(words.indices.take(pa.array(ends[:-1]))).to_pylist()
        heads = [next(whole) if o else self.fast.encode_ordinary(w) for o, w in zip(odd.to_pylist(), begins, strict=True)]
        at[ends[:-1]] = len(size) + np.arange(len(texts))
        size = np.concatenate([size, np.array([len(h) for h in heads], np.int64)])
        ids = np.concatenate([ids, np.array([i for h in heads for i in h], "<u4")])
        n, first = size[at], (np.cumsum(size) - size)[at]
        flat = ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return flat, np.add.reduceat(n, ends[:-1])


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def rooms(ids: int, length: int) -> list[int]:
    """Sizes of sequences that so many ids fill to the end: whole ones, then distinct powers of two."""
    whole, rest = divmod(ids, length)
    return [length] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: np.ndarray, o: Packing) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) for items that are in descending order and shorter than a sequence."""
    size = np.array(rooms(int(lengths.sum()), o.length), np.int64)
    cost, room, out = np.zeros(len(size)), size.copy(), []
    for item, left in enumerate(lengths.tolist()):
        start = 0
        while left:
            fits = room >= left
            at = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[at]))
            out.append((item, start, n, at, int(size[at] - room[at])))
            cost[at] += o.linear * n + o.quadratic * n * n
            room[at] -= n
            start, left = start + n, left - n
    return out


class _Packer:
    """Pieces of one partition: whole stretches at once, remainders bucket by bucket."""

    def __init__(self, o: Packing, partition: int):
        self.o, self.encoder, self.next = o, encoder(o.tokenizer), partition << 33
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def _pieces(self, doc_id: pa.Array, flat: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray, tokens: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows whose ids stand at ``at`` in ``flat``; at most 8,192 in a batch."""
        for k in range(0, len(at), 8_192):
            n = length[k : k + 8_192]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = flat[np.repeat(at[k : k + 8_192] - ends[:-1], n) + np.arange(ends[-1])]
            body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
            columns = [doc_id.slice(k, 8_192), *[pa.array(x[k : k + 8_192], pa.int64()) for x in (start, length)], body]
            columns += [pa.array(x[k : k + 8_192], pa.int64()) for x in (tokens, sequence, offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def add(self, doc_id: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        o = self.o
        flat, tokens = self.encoder.encode(texts)
        flat, tokens = np.insert(flat, np.cumsum(tokens), o.end_id), tokens + 1
        first, whole = np.cumsum(tokens) - tokens, tokens // o.length
        row = np.repeat(np.arange(len(tokens)), whole)
        start = o.length * (np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole))
        yield from self._pieces(
            doc_id.take(pa.array(row)), flat, first[row] + start, start, np.full(len(row), o.length), tokens[row], self.next + np.arange(len(row)), np.zeros(len(row), np.int64)
        )
        self.next += len(row)
        rest = np.flatnonzero(tokens % o.length)
        for k in range(0, len(rest), n := o.bucket_docs):
            some = rest[k : k + n]
            size = tokens[some] % o.length
            ends = np.cumsum(size)
            ids = flat[np.repeat((first + tokens)[some] - ends, size) + np.arange(int(size.sum()))]
            self.held.append((doc_id.take(pa.array(some)), tokens[some], size, ids))
            self.rows += len(some)
            if self.rows >= n:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        """Packs the remainders that are held: under twice ``bucket_docs``."""
        if not self.rows:
            return
        doc_id = pa.concat_arrays([d for d, *_ in self.held])
        tokens, size, flat = (np.concatenate(x) for x in list(zip(*self.held, strict=True))[1:])
        self.held, self.rows = [], 0
        first, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
        item, at, n, sequence, offset = np.array(assign(size[order], self.o), np.int64).T
        item = order[item]
        yield from self._pieces(doc_id.take(pa.array(item)), flat, first[item] + at, tokens[item] - size[item] + at, n, tokens[item], self.next + sequence, offset)
        self.next += int(sequence.max()) + 1


def pack(docs: DataFrame, o: Packing | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row for each piece; ids are little-endian unsigned 32-bit integers."""
    o = o or Packing()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(o, TaskContext.get().partitionId())
        for b in text_batches(batches, "text", 16_000_000):
            yield from packer.add(b.column("doc_id"), b.column("text"))
        yield from packer.close()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _PIECE)
