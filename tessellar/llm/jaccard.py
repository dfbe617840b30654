"""Near copies by the exact Jaccard similarity of whole shingle sets, with pairs proposed by fingerprints and by bands of min-hashes.

Equal sets collapse first. Each set has a fingerprint (simhash.py), whose links propose, and a key for each of BANDS bands of min-hashes;
sets that share a key are proposed too: fingerprints of 64 bits within the radius miss most pairs near the least similarity. Sets that
proposals connect are compared in full, those of large groups block by block, and pairs of similarity NUM/DEN or more are links. Texts move
only where a proposal needs them, and rows that stay are never shuffled.

Null and empty texts have the empty set, which equals only itself. Null ids come last when the row to keep is chosen; of repeated ids
any one row may stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.common import free, in_filter, stored, without
from tessellar.llm.graph import components, local_components
from tessellar.llm.words import mix, shingle_hashes

#: Sets of similarity NUM/DEN or more are linked. A pair meets in a band if BAND min-hashes agree: of pairs of similarity 0.8,
#: 1 in 9,700 meets in none of BANDS bands (fewer above); of similarity 0.3, 0.3 % meet.
NUM, DEN, BANDS, BAND = 4, 5, 50, 8
SLOTS = mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Groups of proposed pairs beyond so many sets are compared block by block.
BLOCK = 512


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width, 42))


def set_digest(h: np.ndarray) -> list[int]:
    data = h.tobytes()
    return [xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2)]


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of the min-hashes of a set (none of the empty set)."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(len(SLOTS), ~np.uint64(0))
    for k in range(0, len(h), 256):
        least = np.minimum(least, (SLOTS[:, None] * h[k : k + 256]).min(1))
    rows = least.reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def similar_pairs(sets: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of similarity NUM/DEN or more, counted; with side, of pairs of different sides only."""
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    column = np.cumsum(first) - 1
    repeated = np.bincount(column, minlength=1) > 1
    keep = repeated[column] if len(column) else column.astype(bool)
    number = np.cumsum(repeated) - 1
    owner, column = owner[keep], number[column[keep]]
    both = np.zeros((m, m), np.int64)
    for k in range(0, int(repeated.sum()), 8192):
        a, b = np.searchsorted(column, [k, k + 8192])
        has = np.zeros((m, 8192), np.float32)
        has[owner[a:b], column[a:b] - k] = 1
        both += (has @ has.T).astype(np.int64)
    ok = (DEN * both >= NUM * (n[:, None] + n[None, :] - both)) & (n[:, None] > 0)
    if side is not None:
        ok &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(ok, 1))


def proposed(sets: DataFrame) -> DataFrame:
    """Edges (u, v) from the least set of each shared key to the others: sets(nid, bands). A key of very many sets is met by partial minima."""
    keyed = sets.select("nid", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("nid").alias("u"), F.max("nid").alias("last")).where("u != last").drop("last")
    return keyed.join(least, "key").where("nid != u").select("u", F.col("nid").alias("v"))


def similar(proposals: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) that connect all sets of similarity NUM/DEN or more among those that proposals(u, v) connect; texts(nid, text)."""
    spark = texts.sparkSession
    roots = components(proposals)
    members = stored(roots.select(F.col("v").alias("nid"), F.col("u").alias("cluster")).unionByName(roots.select(F.col("u").alias("nid"), F.col("u").alias("cluster")).distinct()), "members")
    count = members.count()
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 500)
    blocks = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", F.explode(other)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("at"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))).otherwise(F.struct(F.col("cluster").alias("at"), "lo", "hi"))
    dealt = dealt.select(task.alias("task"), "cluster", "nid", "block").select("task.*", "cluster", "nid", "block")
    wanted = in_filter(texts, "nid", members.select("nid"), count, "wanted").where("wanted").drop("wanted")

    def link(table: pa.Table) -> pa.Table:
        nid, cluster, block = (table.column(x).to_numpy() for x in ("nid", "cluster", "block"))
        apart = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        column = table.column("text")
        u, v = [], []
        order = np.argsort(cluster, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            a, b = similar_pairs([shingle_set(column[i].as_py(), width) for i in at.tolist()], block[at] if apart else None)
            label = local_components(len(at), a, b)
            moved = np.flatnonzero(label != np.arange(len(at)))
            u.append(nid[at[label[moved]]])
            v.append(nid[at[moved]])
        return pa.table({"u": pa.array(np.concatenate(u).astype(np.int64)), "v": pa.array(np.concatenate(v).astype(np.int64))})

    return dealt.join(wanted, "nid").groupBy("at", "lo", "hi").applyInArrow(link, "u long, v long")


def dedupe(df: DataFrame, fingerprint: Callable[[np.ndarray], int], near: Callable[[DataFrame], DataFrame], doc_id: str, text: str, width: int) -> DataFrame:
    """df with one row of each group of near copies, the one of the smallest id. Other columns pass unchanged, whatever their names.

    fingerprint: of a set's hashes; near: edges (u, v) that connect sets(nid, f) of near fingerprints.
    """
    row, d0, d1, bands, f = free(df, "__row", "__d0", "__d1", "__bands", "__f")
    own, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, prints, seen = [], [], [], {}
            for t in batch.column(at).to_pylist():
                if t not in seen:
                    h = shingle_set(t, width)
                    seen[t] = (set_digest(h), band_keys(h).view(np.int64), int(np.uint64(fingerprint(h)).astype(np.int64)) if len(h) else None)
                for out, x in zip((digests, keys, prints), seen[t], strict=True):
                    out.append(x)
            d = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())], names=[*own, d0, d1, bands, f])

    schema = T.StructType([*df.schema.fields, T.StructField(d0, T.LongType()), T.StructField(d1, T.LongType()), T.StructField(bands, T.ArrayType(T.LongType())), T.StructField(f, T.LongType())])
    tagged = stored(df.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "tagged")
    least = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(row).alias("row")).alias("least")
    nodes = stored(tagged.select(d0, d1, least).groupBy(d0, d1).agg(F.min("least").alias("least")).select("least", F.col("least.row").alias("nid")), "nodes")
    repeats = stored(tagged.select(F.col(row).alias("nid")).join(nodes, "nid", "left_anti"), "repeats")
    sets = without(tagged.select(F.col(row).alias("nid"), F.col(bands).alias("bands"), F.col(f).alias("f")), "nid", repeats)
    edges = stored(similar(near(sets.select("nid", "f")).unionByName(proposed(sets)), tagged.select(F.col(row).alias("nid"), F.col(text).alias("text")), width), "similar")
    table = nodes.join(components(edges), F.col("nid") == F.col("v"), "left").select("least", F.coalesce("u", "nid").alias("root"))
    kept = table.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    gone = stored(tagged.select(row).join(kept, row, "left_anti"), "gone")
    return without(tagged.select(row, *own), row, gone).select(*own)
