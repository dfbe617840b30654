"""What the operators of this subpackage share: tables in the shared folder, filters of bounded size, free names, session settings."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word definition of these operators has it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without: a folder of its own then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="tessellar-")
    return base.rstrip("/")


_FOLDERS: list[str] = []


def _new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _FOLDERS.append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Collects the driver's garbage once its heap has grown to half of what it may take.

    A chain of many small jobs leaves plans, metrics and broadcast blocks behind, for which the heap grows to its limit though little of
    it is alive; a full collection gives that memory back. Spark removes shuffle files, too, only once the driver has collected what
    stood for them. Python's dead frames go first: each holds on to its plan.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        gc.collect()
        spark._jvm.java.lang.System.gc()


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and returns what was written.

    The lineage ends there: an executor that is lost later costs a read, not the work before it. The files go
    when the application ends, or sooner by discard(); the job's garbage goes by sweep().
    """
    spark = df.sparkSession
    path = _new_folder(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _FOLDERS.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() or bucketed() wrote; only for tables that no result still reads."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)


def written(step, name: str) -> DataFrame:
    """step()'s table, stored; everything that was stored on the way is deleted once that is written."""
    before = set(_FOLDERS)
    out = stored(step(), name)
    for path in [p for p in _FOLDERS if p not in before and p != out._stored_at]:
        _delete(out.sparkSession, path)
    return out


def bucketed(df: DataFrame, name: str, key: str, least: int = 1) -> DataFrame:
    """As stored(), in buckets of key, as many as there are shuffle partitions or least: later joins on key leave these rows where they are.

    Spark keeps buckets only for tables of its catalogue; the entry goes at once, the files stay as long as stored() ones.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = _new_folder(spark, name)
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out._stored_at = path
    out.inputFiles()  # the relation is resolved with its buckets before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return out


# Bloom filters of 64-bit hashes, in blocks of 2**15 bits: one block a key, three bits in it.

BLOCK_BITS, LEAST_BITS, MOST_BITS = 15, 18, 30
_SHIFTS = (16, 31, 46)


def filter_bits(keys: int) -> int:
    """Size (as a power of two) of a filter with at least 12 bits for each key, at most 2**MOST_BITS (128 MB): 90 million keys.

    With more keys a filter lets more through, in the end everything: results stay the same, only more rows move.
    """
    return min(MOST_BITS, max(LEAST_BITS, (12 * keys).bit_length()))


def filter_table(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(block, bits binary): at most 2**(bits - BLOCK_BITS) rows of 4 KB, from partial bitmaps of each task."""
    block = F.col(column).bitwiseAND(F.lit((1 << (bits - BLOCK_BITS)) - 1))
    places = F.array(*(F.shiftleft(block, BLOCK_BITS) + F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) + 1 for s in _SHIFTS))
    at = keys.select(F.explode(places).alias("p"))
    return at.groupBy((F.bitmap_bucket_number("p") - 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


class Filter:
    """A filter in numpy, for hashes that are made inside Python workers."""

    def __init__(self, keys: DataFrame, column: str, count: int):
        bits = filter_bits(count)
        self.blocks = 1 << (bits - BLOCK_BITS)
        self.packed = np.zeros(self.blocks << (BLOCK_BITS - 3), np.uint8)
        for r in filter_table(keys, column, bits).toLocalIterator():
            at = r["block"] << (BLOCK_BITS - 3)
            self.packed[at : at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        base = (h & np.uint64(self.blocks - 1)) << np.uint64(BLOCK_BITS)
        ok = np.ones(len(h), bool)
        for s in _SHIFTS:
            p = base + ((h >> np.uint64(s)) & np.uint64((1 << BLOCK_BITS) - 1))
            ok &= (self.packed[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def in_filter(df: DataFrame, column: str, keys: DataFrame, count: int, name: str) -> DataFrame:
    """df with a boolean column name: false only if the long in column is not in keys(column). A broadcast of at most 128 MB, no shuffle."""
    bits = filter_bits(count)
    hashed = keys.select(F.xxhash64(column).alias("h"))
    table = filter_table(hashed, "h", bits).select(F.col("block").alias(f"{name}_b"), F.col("bits").alias(f"{name}_m"))
    h = F.xxhash64(column)
    joined = df.join(F.broadcast(table), h.bitwiseAND(F.lit((1 << (bits - BLOCK_BITS)) - 1)) == F.col(f"{name}_b"), "left")

    def bit(s: int) -> Column:
        at = F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(f"{name}_m", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1

    found = F.col(f"{name}_b").isNotNull() & bit(_SHIFTS[0]) & bit(_SHIFTS[1]) & bit(_SHIFTS[2])
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop(f"{name}_b", f"{name}_m")


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of df, a stored table, whose long in column is not in gone(column), itself stored: an anti join that leaves rows where they are.

    A filter of gone settles most rows at once. Which of the others it let through wrongly is found by their keys alone; only those rows
    (and what a filter of them lets through) are shuffled.
    """
    (name,) = free(df, "__maybe")
    first = in_filter(df, column, gone, gone.count(), name)
    wrongly = stored(first.where(name).select(column).join(gone, column, "left_anti"), "passed")
    second = in_filter(first.where(name).drop(name), column, wrongly, wrongly.count(), name).where(name).drop(name)
    return first.where(~F.col(name)).drop(name).unionByName(second.join(wrongly, column, "left_semi").select(*df.columns))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], share: int = 10_000, least: int = 1000) -> DataFrame:
    """left join-ed (inner) with right, which has each key once; both are read from stored tables.

    Keys of at least one in share of left's rows, so at most share of them, are joined by broadcasting their rows of right: no task
    meets all rows of such a key. The others are joined as usual.
    """
    many = max(least, left.count() // share)
    hot = stored(left.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= many).select(*keys), "hot-keys")
    first = left.join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys)
    return first.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys))


def free(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores added until df has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(a: Column, join) -> Column:
    """For each element of a the join (associative) of all up to it: each round joins stretches of doubled length."""

    def doubled(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, join(F.get(acc, i - back), x)).otherwise(x))

    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(a) - 1)).cast("int"))
    return F.when(F.size(a) < 2, a).otherwise(F.aggregate(rounds, a, doubled))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def batch_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: documents are long, and workers hold a batch or two at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))
