"""Finding evaluation texts in a training corpus with FM-indexes.

Each task indexes its documents shard by shard: the words are numbered, their suffixes sorted, and the last column (the
Burrows-Wheeler transform) is kept in a wavelet matrix. All windows of ``window`` words of the evaluation items are then
searched backwards at once: a step narrows every window's row range by one word with two rank queries. Rows that remain are
walked to the nearest sampled suffix to learn where they stand, and neighbouring hits are merged into spans.

Words that no item has can stand in no match. They become one separator, and only stretches of at least ``window`` item words
are indexed; this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.words import words

WINDOW = 15
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 23
PATTERNS = 1 << 18
SAMPLE = 16
_END, _GAP, _FIRST = 0, 1, 2


def suffix_order(t: np.ndarray, n_symbols: int) -> np.ndarray:
    """Positions of the suffixes of ``t`` in order; ``t`` ends with a symbol that stands nowhere else. Prefix doubling, in
    which only suffixes that still tie are sorted again."""
    n = len(t)
    bits = max(1, int(n_symbols).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((t.astype(np.int64), np.zeros(h, np.int64)))
    for j in range(h):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = ~first
    tied[:-1] |= ~first[1:]
    active = sa[tied]
    while len(active):
        after = np.where(active + h < n, rank[np.minimum(active + h, n - 1)], -1)
        both = rank[active] * (n + 1) + after + 1
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        group = rank[active]
        k = np.arange(len(active))
        starts = np.concatenate(([True], group[1:] != group[:-1]))
        slot = group + k - np.maximum.accumulate(np.where(starts, k, 0))
        sa[slot] = active
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[active] = slot[np.maximum.accumulate(np.where(new, k, 0))]
        still = ~new
        still[:-1] |= ~new[1:]
        active = active[still]
        h *= 2
    return sa


class FMIndex:
    """Backward search over a sequence of symbols below ``n_symbols``, of which the last, 0, stands only there."""

    def __init__(self, t: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        sa = suffix_order(t, n_symbols)
        self.n = len(t)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=n_symbols)))).astype(np.int64)
        last = t[sa - 1].astype(np.int32)
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.n_zeros, column = [], [], last
        for level in range(self.levels - 1, -1, -1):
            bit = (column >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(bit == 0))).astype(np.int32))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        self.last = last
        kept = sa % sample == 0
        self.kept = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.positions = sa[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the last column above ``row``."""
        start = np.zeros(len(symbol), np.int64)
        row = row.astype(np.int64)
        for k, (zeros, n_zeros) in enumerate(zip(self.zeros, self.n_zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            zs, zr = zeros[start], zeros[row]
            start = np.where(one, n_zeros + start - zs, zs)
            row = np.where(one, n_zeros + row - zr, zr)
        return row - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pattern that occurs: its number and its range of rows."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, j].astype(np.int64)
            lo, hi = self.below[symbol] + self.rank(symbol, lo), self.below[symbol] + self.rank(symbol, hi)
            found = lo < hi
            which, lo, hi = which[found], lo[found], hi[found]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``: each walks back to the nearest sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.kept[at + 1] > self.kept[at]
            out[todo[here]] = self.positions[self.kept[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            symbol = self.last[at].astype(np.int64)
            at = self.below[symbol] + self.rank(symbol, at)
            steps += 1
        return out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return _GAP


@dataclass
class Block:
    """Evaluation items of at most ``BLOCK_WORDS`` words (or one item): their words by number, one item after the other."""

    numbers: dict[str, int]
    items: list
    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, list[str]]]) -> Block:
        numbers: dict[str, int] = {}
        ids = [np.array([numbers.setdefault(w, _FIRST + len(numbers)) for w in own], np.int32) for _, own in items]
        return cls(numbers, [item for item, _ in items], np.concatenate(ids), np.cumsum([0] + [len(x) for x in ids]))

    def patterns(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All windows of the items and the number of the item of each, some at a time."""
        every = np.lib.stride_tricks.sliding_window_view(self.words, window)
        for at in range(0, len(every), PATTERNS):
            begin = np.arange(at, min(at + PATTERNS, len(every)))
            owner = np.searchsorted(self.starts, begin, "right") - 1
            inside = begin + window <= self.starts[owner + 1]
            if inside.any():
                yield every[begin[inside]], owner[inside]


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    held, size = [], 0
    for item, text in items.toLocalIterator():
        own = words(text)
        if len(own) < window or item is None:
            continue
        if held and size + len(own) > block_words:
            yield Block.of(held)
            held, size = [], 0
        held.append((item, own))
        size += len(own)
    if held:
        yield Block.of(held)


def _stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches of at least ``window`` words that items have."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= _FIRST).astype(np.int8), [0]))))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= window]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans (document, item, first word, end) of which those of one document and item that overlap or touch are one."""
    doc, item, begin, end = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))].T
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    # Ends so far within a document and item: shifted by their number, so that one running maximum serves all.
    group = np.cumsum(other)
    reach = np.maximum.accumulate(end + group * (end.max() + 1)) - group * (end.max() + 1)
    heads = np.flatnonzero(other | np.concatenate(([True], begin[1:] > reach[:-1])))
    tails = np.concatenate((heads[1:], [len(doc)])) - 1
    return np.stack((doc[heads], item[heads], begin[heads], reach[tails]), axis=1)


def _search_shard(parts: list[np.ndarray], where: list[tuple[int, int]], block: Block, window: int) -> np.ndarray:
    """Spans (document's number, item's number, first word, end) in one shard of stretches."""
    gap = np.array([_GAP], np.int32)
    text = np.concatenate([x for p in parts for x in (p, gap)] + [np.array([_END], np.int32)])
    starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    index = FMIndex(text, _FIRST + len(block.numbers))
    docs, first = np.array(where, np.int64).T
    found = [np.empty((0, 4), np.int64)]
    for patterns, owner in block.patterns(window):
        which, lo, hi = index.search(patterns)
        n = hi - lo
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        position = index.locate(rows)
        part = np.searchsorted(starts, position, "right") - 1
        begin = first[part] + position - starts[part]
        found.append(np.stack((docs[part], owner[np.repeat(which, n)], begin, begin + window), axis=1))
    return np.concatenate(found)


def _scan(batches: Iterator[pa.RecordBatch], block: Block, window: int, shard_words: int, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Spans of the documents of a task. Those of a document that goes on in the next shard wait for it."""
    number = _Numbers(block.numbers).__getitem__
    ids: dict[int, object] = {}
    parts, where, size, last = [], [], 0, -1
    waiting = np.empty((0, 4), np.int64)

    def flush(going_on: int) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, parts, where, size
        spans = np.concatenate((waiting, _search_shard(parts, where, block, window))) if parts else waiting
        parts, where, size, waiting = [], [], 0, spans[:0]
        if len(spans):
            spans = _merged(spans)
            waiting, spans = spans[spans[:, 0] == going_on], spans[spans[:, 0] != going_on]
            cols = [[ids[d] for d in spans[:, 0].tolist()], [block.items[i] for i in spans[:, 1].tolist()], spans[:, 2], spans[:, 3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        for d in [d for d in ids if d != going_on]:
            del ids[d]

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
            last += 1
            own = np.fromiter(map(number, words(text)), np.int32)
            for a, b in _stretches(own, window):
                ids[last] = doc
                while a < b:  # a stretch longer than a shard goes on in the next, with the words that a match can span
                    end = min(b, a + shard_words)
                    parts.append(own[a:end])
                    where.append((last, a))
                    size += end - a
                    a = b if end == b else end - window + 1
                    if size >= shard_words:
                        yield from flush(last)
    yield from flush(-1)


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where documents hold ``window`` or more consecutive words of an item: (``doc_id``, ``item_id``, first_word, end_word).

    A span is a longest run of matching windows in the document, counted in words from 0. All documents and items are
    compared. Items are the stated query set: they are taken in blocks of ``block_words`` words, each broadcast, so any
    number of items works with bounded memory; one scan of the documents serves a whole block. Null, empty and blank texts and items of fewer than ``window`` words match
    nothing; repeated documents and items each give their rows; rows with a null item id are left out; other columns are
    ignored; an empty table on either side gives none. A document longer than a shard is searched in overlapping parts, whose spans are
    merged again.
    """
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, first_word long, end_word long"
    names = [doc_id, item_id, "first_word", "end_word"]
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema[doc_id].dataType), to_arrow_type(items.schema[item_id].dataType), pa.int64(), pa.int64()]
    rows = docs.select(doc_id, text).where(F.col(text).isNotNull())
    found = None
    for block in _blocks(items.select(item_id, text), window, block_words):
        shared = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda it, b=shared: _scan(it, b.value, window, shard_words, names, types), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """Each document with each item it holds, once, as (``doc_id``, ``item_id``); see ``leaked_spans``."""
    return leaked_spans(docs, items, doc_id, item_id, **options).select(doc_id, item_id).distinct()
