"""Stupid-backoff scores from corpus counts, computed as block joins.

Counts: every n-gram of ORDER words or fewer over the whole corpus, words as in words.py. A document
is scored by the others: its own occurrences are taken off every count. With c these counts, N the
other documents' words and a = BACKOFF, the word w after u v scores
    c(u v w) / c(u v)      if c(u v w) > 0,
    a   c(v w) / c(v)      else if c(v w) > 0,
    a^2 (c(w) + 1) / (N + 1)  else,
shorter contexts at the start of a document. A document's score is the mean of the logarithms.

Relations: the documents' n-grams (document, n-gram, occurrences), the count table (n-gram, occurrences in the
corpus) partitioned by the n-gram's hash, their join on the n-gram, and the sum by document. They are kept as
blocks, since as rows (at least 11 bytes each after compression, 2.7 for each word) they would take 8 times the
text's compressed size: documents are dealt into batches of about BATCH words, each written as its distinct words
and the order in which they stand; a block holds the different n-grams of one batch that fall into one hash
partition, as sorted hashes, with their occurrences in the batch. Occurrences are thus combined before anything is
shuffled. The task of a partition sums them to that part of the count table and joins it to the blocks; each n-gram
gets its occurrences in other batches, and batches sum up by document.

An n-gram is known by all 64 bits of its hash at every size: a lookup meets another n-gram's hash with a probability
of (different n-grams in the corpus) / 2**64, that is 6e-10 for 30 GB of text. Null and empty texts have no words:
n_words 0 and a null score. Repeated rows are separate documents. A document of more than BATCH words is a batch by
itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import bucketed
from tessellar.llm.words import mix, word_hash_groups

ORDER = 3
BACKOFF = 0.4
BATCH = 1_600_000
#: Words of the corpus for each partition of the count table.
PARTITION = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(words: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The hash of the order words that end at each word which has so many predecessors in its document (at: its place there)."""
    end = np.flatnonzero(at >= order - 1)
    out = mix(words[end] + np.uint64(1))
    for k in range(1, order):
        out = mix(out * _STEP + words[end - k] + np.uint64(k))
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, bytes of equal weight together, in the fewest bytes each; the first byte says how many."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(x) or x.max() < 1 << (8 * s))
    planes = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _numbers(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b[1:])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(b[0], -1).T).view(f"<u{b[0]}").ravel()


def pack(h: np.ndarray) -> bytes:
    """Hashes (mostly rising) as differences modulo 2**64."""
    return _squeeze(np.diff(h, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(_numbers(b).astype(np.uint64), dtype=np.uint64)


class Batch:
    """Words of some documents."""

    def __init__(self, row: dict):
        self.words = unpack(row["vocabulary"])[_numbers(row["tokens"])]
        self.sizes = _numbers(row["sizes"]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.at = np.arange(len(self.words), dtype=np.int64) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids: list = []
    hashes: list = []
    sizes: list = []

    def out() -> pa.RecordBatch:
        nonlocal made
        vocabulary, tokens, times = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        order = np.lexsort((vocabulary, -np.log2(np.maximum(times, 1)).astype(int)))  # frequent words first, sorted where about as frequent
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        row = ((part << 32) + made, ids, _squeeze(np.array(sizes, np.int64)), pack(vocabulary[order]), _squeeze(number[tokens]), len(tokens))
        made += 1
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["batch", "ids", "sizes", "vocabulary", "tokens", "n"])

    held = 0
    for b in batches:
        doc_ids = b.column(0).to_pylist()
        for first, h, n in word_hash_groups(b.column(1).to_pylist()):
            edge = np.cumsum(n)
            for i, size in enumerate(n.tolist()):
                if ids and held + size > BATCH:
                    yield out()
                    ids, hashes, sizes, held = [], [], [], 0
                ids.append(doc_ids[first + i])
                hashes.append(h[edge[i] - size : edge[i]])
                sizes.append(size)
                held += size
    if ids:
        yield out()


def _blocks(partitions: int):
    """For each batch its blocks: the different n-grams of one order in one hash partition, and their occurrences in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                batch = Batch(row)
                for order in range(1, ORDER + 1):
                    known, times = np.unique(ngram_hashes(batch.words, batch.at, order), return_counts=True)
                    part = (known >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)
                    cut = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 40)))
                    ends = [*cut[1:].tolist(), len(known)][: len(cut)]
                    out = [[int(part[s]), row["batch"], order, pack(known[s:e]), _squeeze(times[s:e])] for s, e in zip(cut.tolist(), ends, strict=True)]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    cols = list(zip(*out, strict=True)) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "batch", "gram", "hashes", "times"])

    return run


def _joined(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """One partition of the count table, joined to the blocks that fall into it: each n-gram's occurrences in other batches."""
    hashes = [unpack(x) for x in t.column("hashes").to_pylist()]
    times = np.concatenate([_numbers(x) for x in t.column("times").to_pylist()], dtype=np.int64, casting="unsafe")
    ends = np.cumsum([len(h) for h in hashes])
    every = np.concatenate(hashes)
    del hashes
    order = np.argsort(every, kind="stable")
    new = np.flatnonzero(np.diff(every[order], prepend=~every[order[0]]))
    counts = np.add.reduceat(times[order], new)  # of each different n-gram
    others = np.empty(len(every), np.int64)
    others[order] = np.repeat(counts, np.diff(np.append(new, len(every))))
    others -= times
    out = [_squeeze(x) for x in np.split(others, ends[:-1])]
    return pa.table({"batch": t.column("batch"), "part": t.column("part"), "gram": t.column("gram"), "others": pa.array(out, pa.binary())})


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, score (mean log of stupid-backoff scores; null without words) for each row of df."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    batches_ = rows.mapInArrow(_tokenised, "batch long, ids array<long>, sizes binary, vocabulary binary, tokens binary, n long")
    table = bucketed(batches_, "lm_batches", "batch", rows.rdd.getNumPartitions())  # buckets grow in number, not in size
    total = table.agg(F.sum("n")).first()[0] or 0
    partitions = max(32, -(-total // PARTITION))
    blocks = table.select("batch", "sizes", "vocabulary", "tokens").mapInArrow(_blocks(partitions), "part long, batch long, gram int, hashes binary, times binary")
    found = blocks.groupBy("part", "gram").applyInArrow(_joined, "batch long, part long, gram int, others binary")
    found = found.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("gram", "part", "others"))).alias("found"))  # of one batch

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                batch = Batch(row)
                log = _word_scores(batch, row["found"] or [], total)
                sums = np.bincount(batch.doc, weights=log, minlength=len(batch.sizes))
                mean = sums / np.maximum(batch.sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(batch.sizes, pa.int64()), pa.array(mean, mask=batch.sizes == 0)], names=["doc_id", "n_words", "score"]
                )

    joined = table.drop("n").join(found, "batch", "left")
    return joined.mapInArrow(sum_up, "doc_id long, n_words long, score double")


def _word_scores(batch: Batch, found: list[dict], total: int) -> np.ndarray:
    """The logarithm of each word's score, its own document's occurrences taken off."""
    others = []
    for order in range(1, ORDER + 1):
        elsewhere = np.concatenate([np.zeros(0, np.uint8), *(_numbers(a["others"]) for a in found if a["gram"] == order)]).astype(np.int64)
        has = np.flatnonzero(batch.at >= order - 1)
        known, inverse, times = np.unique(ngram_hashes(batch.words, batch.at, order), return_inverse=True, return_counts=True)
        # Occurrences in the word's own document: of pairs (document, n-gram).
        _, pair, own = np.unique(batch.doc[has] * np.int64(max(len(known), 1)) + inverse, return_inverse=True, return_counts=True)
        count = np.zeros(len(batch.words), np.int64)
        count[has] = (elsewhere + times)[inverse] - own[pair]
        others.append(count)
    uni, bi, tri = others
    previous = lambda x: np.concatenate([[0], x[:-1]]) if len(x) else x
    words = total - np.repeat(batch.sizes, batch.sizes)
    score = BACKOFF**2 * (uni + 1) / (words + 1)
    score = np.where((batch.at >= 1) & (bi > 0), BACKOFF * bi / np.maximum(previous(uni), 1), score)
    # Words with one predecessor only start from the bigram, those with none from the unigram: no penalty for what isn't there.
    score = np.where(batch.at == 1, score / BACKOFF, np.where(batch.at == 0, score / BACKOFF**2, score))
    score = np.where((batch.at >= 2) & (tri > 0), tri / np.maximum(previous(bi), 1), score)
    return np.log(score)


def report(df: DataFrame) -> DataFrame:
    return score(df).select("doc_id", "n_words", F.round("score", 6).alias("score"))
