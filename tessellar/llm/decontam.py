"""Benchmark decontamination: q-gram filtering in diagonal bands, then banded alignment.

Texts are compared as words: lower-cased characters, other runs as one space. A stretch of a
document within k edits of a benchmark item of m characters shares at least m - Q + 1 - kQ of the
item's q-grams with it (the q-gram lemma), on diagonals that lie within k + 1 of each other. Shared
q-grams are therefore counted in bands of 2(k + 1) diagonals that overlap by half; a band that
reaches the bound is verified by aligning the whole item inside the band, ends free in the document.
k is EDITS of the item's length, less where the bound would not be positive; items shorter than Q
must occur as they are.

Benchmarks of up to BLOCK characters are broadcast at once; larger ones go block by block, each
against all documents: one block's index is on the driver at a time, and its findings are written before
the next is made. Documents are scanned whole and independently: no shuffle.
Null or empty texts and items match nothing; repeated rows are reported as often as they occur; other
columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import discard, stored

Q = 8
EDITS = 0.1
BLOCK = 16_000_000
_BITS = 20
_MULT = 0x9E3779B97F4A7C15
_UNIT = 1 << 32  # one edit, in alignment values that also carry where the alignment starts

_WORD = np.ones(128, bool)
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = False


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words, one space between and after them; the position of each in text)."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer; positions must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (c >= 128) | _WORD[np.minimum(c, 127)]
    word &= (c != 160) & ((c < 0x2000) | (c > 0x206F))  # spaces and punctuation of the general block
    keep = np.flatnonzero(word | np.concatenate([[False], word[:-1]]))
    return np.where(word[keep], c[keep], 32).astype(np.uint32), keep


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q characters."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h, n = c.astype(np.uint64) + np.uint64(1), 1
    while n < Q:
        h = h[:-n] * np.uint64(pow(_MULT, n, 1 << 64)) + h[n:]
        n *= 2
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def align(item: np.ndarray, doc: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of all of item on diagonals low .. low + width - 1 of doc; None above most edits.

    Places outside doc hold a character that matches nothing: using one costs what leaving out the item's character costs.
    """
    padded = np.full(len(item) + width, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(doc), low + len(padded))
    if a < b:
        padded[a - low : b - low] = doc[a:b]
    row = np.arange(width, dtype=np.int64)  # free start: no edits, and where the alignment starts
    step = row * _UNIT
    for i, c in enumerate(item):
        new = row + (padded[i : i + width] != c) * _UNIT
        np.minimum(new[:-1], row[1:] + _UNIT, out=new[:-1])
        new -= step
        np.minimum.accumulate(new, out=new)
        new += step
        row = new
        if i & 7 == 7 and row.min() >= (most + 1) * _UNIT:
            return None
    k = int(row.argmin())
    edits = int(row[k] // _UNIT)
    if edits > most:
        return None
    return edits, max(0, low + int(row[k] % _UNIT)), min(len(doc), low + len(item) + k)


class Index:
    """Benchmark items, looked up by q-gram."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.ids, self.texts, self.budget, self.least = [], [], [], []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            c = normalised(text or "")[0]
            if len(c) and c[-1] == 32:
                c = c[:-1]
            if not len(c):
                continue
            k = max(0, min(int(edits * len(c)), (len(c) - Q) // Q))
            h = grams(c)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.texts.append(c)
            self.budget.append(k)
            self.least.append(max(1, len(c) - Q + 1 - k * Q))
        self.short = [(i, np.concatenate([[32], c, [32]]).astype("<u4").tobytes()) for i, c in enumerate(self.texts) if len(c) < Q]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate([*owner, np.zeros(0, int)])[order], np.concatenate([*place, np.zeros(0, int)])[order]
        self.known, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.known >> np.uint64(64 - _BITS)] = True
        self.k1 = np.array(self.budget, np.int64) + 1
        self.need = np.array(self.least, np.int64)
        self.longest = max(map(len, self.texts), default=1)

    def bands(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) of each band that reaches its item's bound; band b covers diagonals b(k+1) to (b+2)(k+1) - 1."""
        h = grams(doc)
        at = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)]) if len(h) else h.astype(int)
        if not len(at) or not len(self.known):
            return []
        i = np.searchsorted(self.known, h[at])
        i[i == len(self.known)] = 0
        hit = self.known[i] == h[at]
        at, i = at[hit], i[hit]
        n = self.times[i]
        if not n.sum():
            return []
        each = np.repeat(self.first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.owner[each]
        able = (np.bincount(item, minlength=len(self.ids)) >= self.need)[item]  # items with enough hits in the whole text
        if not able.any():
            return []
        item, each = item[able], each[able]
        band = (np.repeat(at, n)[able] - self.place[each]) // self.k1[item]
        span = len(doc) + 2 * self.longest + 4
        key = item * (2 * span) + band + span
        key = np.concatenate([key, key - 1])
        key_sorted = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key_sorted[1:] != key_sorted[:-1]]))
        if not (np.diff(np.append(first, len(key))) >= self.need[key_sorted[first] // (2 * span)]).any():
            return []
        own, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        full = count >= self.need[own // (2 * span)]
        # A gram of the item counts once in a band, however often the document repeats it there.
        pick = full[inverse]
        pair = np.unique(inverse[pick] * self.longest + np.concatenate([self.place[each]] * 2)[pick])
        band_of, count = np.unique(pair // self.longest, return_counts=True)
        own = own[band_of]
        own = own[count >= self.need[own // (2 * span)]]
        return [(int(x // (2 * span)), int(x % (2 * span)) - span) for x in own]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's position in ids, edits, start, end) of each item found: its best place, in code points of text."""
        doc, where = normalised(text)
        best: dict[int, tuple[int, int, int]] = {}
        for i, band in self.bands(doc):
            low, item, k = band * (self.budget[i] + 1), self.texts[i], self.budget[i]
            found = align(item, doc, low, 2 * (k + 1), k)
            if found and (i not in best or found < best[i]):
                best[i] = found
        if self.short:
            padded = np.concatenate([[32], doc, [32]]).astype("<u4").tobytes()
        for i, pattern in self.short:
            p = padded.find(pattern)
            while p >= 0 and p % 4:
                p = padded.find(pattern, p + 1)
            if p >= 0:
                best[i] = (0, p // 4, p // 4 + len(self.texts[i]))
        return [(i, e, int(where[s]), int(where[t - 1]) + 1) for i, (e, s, t) in sorted(best.items()) if t > s]


def blocks(bench: DataFrame, block: int) -> list[DataFrame]:
    """The items in blocks of at most about so many characters."""
    b = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    chars = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block)
    return [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def shared_index(items: DataFrame, edits: float) -> Broadcast:
    """The index of one block, which bounds what the driver collects."""
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return items.sparkSession.sparkContext.broadcast(Index(rows, edits))


SCHEMA = "doc_id long, item_id long, edits int, start_at int, end_at int"


def matches(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """A row for each document and item found in it: edits of the best place, and where that is (code points, end exclusive)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def found(items: DataFrame) -> tuple[DataFrame, Broadcast]:
        shared = shared_index(items, edits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = [(d, index.ids[i], e, s, t) for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x for i, e, s, t in index.search(x)]
                cols = list(zip(*hits, strict=True)) if hits else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start_at", "end_at"])

        return rows.mapInArrow(run, SCHEMA), shared

    every = blocks(bench, block)
    if not every:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    if len(every) == 1:
        return found(every[0])[0]
    out = []
    for items in every:
        hits, shared = found(items)
        out.append(stored(hits, "matches"))
        shared.destroy()
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """docs without the rows in which an item is found."""
    at = docs.columns.index(text)
    every, last = blocks(bench, block), None
    for items in every:
        shared = shared_index(items, edits)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not (x and index.search(x)) for x in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if len(every) > 1:
            docs = stored(docs, "cleaned")
            shared.destroy()
            if last is not None:
                discard(last)
            last = docs
    return docs
