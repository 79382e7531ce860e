"""Encoding of a text column with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text into words before the merges (byte_bpe_50k).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHORT_WORD = 192
CACHED_WORDS = 200_000
_NONE = 1 << 60


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by a contiguous array of ranks.

    ``cut`` holds the part boundaries and ``near[i]`` the rank of joining part i to the next. The least rank is found by
    a scan, its inner boundary deleted and the ranks on both sides refreshed, until no two parts join.
    """
    cut = list(range(len(word) + 1))
    get = ranks.get
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near and (least := min(near)) != _NONE:
        i = near.index(least)
        del cut[i + 1]
        del near[i]
        if i < len(near):
            near[i] = get(word[cut[i] : cut[i + 2]], _NONE)
        if i:
            near[i - 1] = get(word[cut[i - 1] : cut[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for words of any length: the scan becomes a heap, the array a linked list (n log n)."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], _NONE)) != _NONE]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end], _NONE)) != _NONE:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Ids by word; words that are met again are not merged again. Bounded: a full table starts anew."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= SHORT_WORD else merge_long(raw, self.ranks)
        if len(raw) <= SHORT_WORD:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line holds a token in base64 and its rank, which is its id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_LOADED: dict[int, tuple[_Words, object]] = {}


def _encoder(raw: bytes) -> tuple[_Words, object]:
    """One encoder per Python worker and vocabulary; it outlives the task."""
    if (key := hash(raw)) not in _LOADED:
        _LOADED[key] = (_Words(read_ranks(raw)), regex.compile(WORDS))
    return _LOADED[key]


def encode(text: str, raw: bytes) -> list[int]:
    """Ids of one text."""
    words, pattern = _encoder(raw)
    return list(chain.from_iterable(map(words.__getitem__, pattern.findall(text))))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``df`` as (``id_col``, ids array<int>): the whole text's ids, without special tokens.

    Null and empty texts both give the empty list. Nothing is cleaned first; strings of special tokens are ordinary text.
    Rows with equal ids or texts each give a row, other columns are ignored, an empty table gives none. Texts may be of any
    length: words over ``SHORT_WORD`` bytes take a merge of n log n steps with the same result. The vocabulary file
    (under 1 MB, of fixed size) is read by the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pattern = _encoder(shared.value)
        get, find = words.__getitem__, pattern.findall
        for batch in batches:
            step, at = 500, 0
            while at < batch.num_rows:
                part = batch.slice(at, step)
                at += step
                ids = [np.fromiter(chain.from_iterable(map(get, find(t))), np.int32) if t else np.empty(0, np.int32) for t in part.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")
