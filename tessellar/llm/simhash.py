"""SimHash fingerprints linked through a hierarchical index in Gray order.

Fingerprints: each of 64 bits is the majority of that bit over the hashes of a document's word
shingles. Equal fingerprints collapse to one node before anything is compared.

Index: nodes are sorted by their rank in the binary-reflected Gray code, where neighbours share most
bits. Every group of FAN neighbours becomes a tree node that keeps the bits its members agree on, less
those its parent already has. A search adds up a fingerprint's differences on the way down and leaves a
group once they exceed RADIUS. The sorted nodes are cut into shards; a tree of the same kind over the
shards' agreed bits sends each fingerprint only to shards that can hold a neighbour. Within a shard,
neighbours in Gray order are linked first, and groups that lie wholly in the fingerprint's own component
are left out.

Links become stars inside each task and components over all tasks (graph.components), so a group of
many near copies never yields all its pairs.

Null and empty texts have the fingerprint zero. Null ids take part; the smallest id of a component
ignores them (null where there is no other).

dedupe keeps one document of each group of near copies: links of fingerprints propose, and pairs by
min-hashes too, which fingerprints at this radius cannot reach; whole shingle sets decide (jaccard.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm import jaccard
from tessellar.llm.common import hot_join, stored
from tessellar.llm.graph import components, local_components
from tessellar.llm.words import shingle_hashes

FAN = 4
RADIUS = 2
SHARD = 50_000
LEAST_SHARDS = 16
QUERIES = 2048
#: A component's least id goes to so many places, to which the component's members are dealt.
SALT = 16


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits that are 1 in over half of them; zero of none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 200):  # bytes hold the sum of up to 255 bits
        ones += np.unpackbits(h[k : k + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(rows: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, f) of rows(doc_id, text), f as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            seen = {t: fingerprint(t, width, seed) for t in dict.fromkeys(texts)}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([seen[t] for t in texts], np.uint64).view(np.int64))], names=["doc_id", "f"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, f long")


def gray_rank(key: np.ndarray) -> np.ndarray:
    out = key.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def gray_rank_column(key: Column) -> Column:
    """The same as a column, shifted to signed order."""
    for s in (1, 2, 4, 8, 16, 32):
        key = key.bitwiseXOR(F.shiftrightunsigned(key, s))
    return key.bitwiseXOR(F.lit(-(1 << 63)))


class Tree:
    """Leaves (what their keys have in common: all, any) in Gray order under nodes of FAN neighbours. Labels: of single keys."""

    def __init__(self, both: np.ndarray, any_: np.ndarray, labels: np.ndarray | None = None):
        low = high = np.full(len(both), -2) if labels is None else labels
        self.pattern, self.mask, self.low, self.high = [both], [~(both ^ any_)], [low], [high]
        while len(both) > FAN:
            cut = np.arange(0, len(both), FAN)
            both, any_ = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.pattern.append(both)
            self.mask.append(~(both ^ any_))
            self.low.append(low)
            self.high.append(high)
        for k in range(len(self.mask) - 1):  # what the parent has is not looked at again
            self.mask[k] = self.mask[k] & ~np.repeat(self.mask[k + 1], FAN)[: len(self.mask[k])]

    def search(self, keys: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) positions at most RADIUS bits apart, without groups that are wholly of the query's own label."""
        top = len(self.pattern) - 1
        n = len(self.pattern[top])
        q, node = np.repeat(np.arange(len(keys)), n), np.tile(np.arange(n), len(keys))
        apart = np.zeros(len(q), np.int16)
        for level in range(top, -1, -1):
            if level < top:
                q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < len(self.pattern[level])
                q, node, apart = q[inside], node[inside], apart[inside]
            apart = apart + np.bitwise_count((keys[q] ^ self.pattern[level][node]) & self.mask[level][node])
            keep = apart <= RADIUS
            if labels is not None:
                keep &= ~((self.low[level][node] == labels[q]) & (self.high[level][node] == labels[q]))
            q, node, apart = q[keep], node[keep], apart[keep]
        return q, node


def link_shard(index: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Star edges (rows of two node ids) of one shard. index, queries: columns node id, fingerprint (uint64)."""
    index = index[np.argsort(gray_rank(index[:, 1]), kind="stable")]
    keys, n = index[:, 1], len(index)
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for gap in (1, 2, 3, 4):  # neighbours in Gray order first
        if n > gap:
            at = np.flatnonzero(np.bitwise_count(keys[gap:] ^ keys[:-gap]) <= RADIUS)
            a.append(at)
            b.append(at + gap)
    label = local_components(n, np.concatenate(a), np.concatenate(b))
    tree = Tree(keys, keys, label)
    everyone = np.concatenate([index, queries])
    every_label = np.concatenate([label, np.full(len(queries), -1)])
    for k in range(0, len(everyone), QUERIES):
        q, node = tree.search(everyone[k : k + QUERIES, 1], every_label[k : k + QUERIES])
        q = q + k
        keep = (q >= n) | (q > node)
        a.append(node[keep])
        b.append(q[keep])
    label = local_components(len(everyone), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(everyone)))
    return np.stack([everyone[label[moved], 0], everyone[moved, 0]], axis=1)


def links(nodes: DataFrame, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Edges (u, v) that connect all of nodes(nid, f), f different, whose fingerprints are at most RADIUS bits apart."""
    shards = max(least_shards, -(-nodes.count() // SHARD))

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, both, any_ = None, ~np.uint64(0), np.uint64(0)
        for b in batches:
            rank, key = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if len(rank):
                low = int(rank.min()) if low is None else min(low, int(rank.min()))
                both, any_ = both & np.bitwise_and.reduce(key), any_ | np.bitwise_or.reduce(key)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (low, int(both.view(np.int64)), int(any_.view(np.int64)))], names=["low", "all", "any"])

    ranked = nodes.select(gray_rank_column(F.col("f")).alias("rank"), "f").repartitionByRange(shards, "rank")
    top = sorted(tuple(r) for r in ranked.mapInArrow(about, "low long, all long, any long").collect())  # three numbers for each shard
    if not top:
        return nodes.select(F.col("nid").alias("u"), F.col("nid").alias("v"))
    cuts, both, any_ = np.array(top, np.int64).T
    shared = nodes.sparkSession.sparkContext.broadcast((cuts, Tree(both.view(np.uint64), any_.view(np.uint64))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, tree = shared.value
        for b in batches:
            nid, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = np.searchsorted(cuts, (gray_rank(f.view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64), side="right") - 1
            for k in range(0, len(f), QUERIES):
                q, shard = tree.search(f[k : k + QUERIES].view(np.uint64))
                q = q + k
                q, shard = q[shard >= own[q]], shard[shard >= own[q]]  # the earlier of two shards sends to the later
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[q] < shard), pa.array(nid[q]), pa.array(f[q])], names=["shard", "guest", "nid", "f"])

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data = np.stack([table.column(x).to_numpy().view(np.uint64) for x in ("nid", "f")], axis=1)
        guest = table.column("guest").to_numpy()
        pairs = link_shard(data[~guest], data[guest]).view(np.int64)
        return pa.table({"u": pa.array(np.ascontiguousarray(pairs[:, 0])), "v": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    sent = nodes.select("nid", "f").mapInArrow(route, "shard long, guest boolean, nid long, f long")
    return sent.groupBy("shard").applyInArrow(link, "u long, v long")


def placed(prints: DataFrame, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """(f, component) for each different fingerprint of prints(doc_id, f): the smallest doc_id in its component."""
    nodes = stored(prints.groupBy("f").agg(F.min("doc_id").alias("least")).select(F.monotonically_increasing_id().alias("nid"), "f", "least"), "nodes")
    roots = stored(components(links(nodes, least_shards)).select(F.col("v").alias("nid"), F.col("u").alias("root")), "roots")
    every = stored(roots.unionByName(roots.select(F.col("root").alias("nid"), "root").distinct()).join(nodes, "nid").select("nid", "f", "least", "root"), "linked")
    least = every.groupBy("root").agg(F.min("least").alias("component"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    linked = every.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALT)).cast("int")).join(least, ["root", "salt"]).select("f", "component")
    return linked.unionByName(nodes.join(every.select("nid"), "nid", "left_anti").select("f", F.col("least").alias("component")))


def near(sets: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the nodes of sets(nid, f) whose fingerprints are at most RADIUS bits apart (null: of none).

    Nodes of one fingerprint are linked to the least of them, fingerprints through the index as links() says.
    """
    prints = sets.where(F.col("f").isNotNull()).select("nid", "f")
    nodes = stored(prints.groupBy("f").agg(F.min("nid").alias("nid"), F.count("*").alias("n")), "prints")
    same = prints.join(nodes.where("n > 1").select(F.col("nid").alias("u"), "f"), "f").where("nid != u").select("u", F.col("nid").alias("v"))
    return same.unionByName(links(nodes.select("nid", "f")))


def dedupe(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """df with one row of each group of near copies, the one of the smallest id: fingerprints propose, whole sets decide."""
    return jaccard.dedupe(df, majority, near, doc_id, text, width)


def report(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 3-word shingles, links at 2 or fewer of 64 bits."""
    prints = stored(fingerprints(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "fingerprints")
    out = hot_join(prints, stored(placed(prints), "components"), ["f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


__all__ = ["dedupe", "fingerprints", "links", "report"]
