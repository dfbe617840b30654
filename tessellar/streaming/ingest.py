"""A stream of changed rows kept as a table: each micro-batch replaces the rows of its keys.

The table is a base and the deltas since, merged when it is read; a batch writes only its own rows. Every
KEEP deltas are merged into a new base. Folders have names of their own for each attempt, and a batch counts
once the pointer names it: a batch that runs again after that is passed over, one that runs again before
writes anew beside what the first attempt left. What the pointer before the current one names stays, for
readers that have it open; older folders are deleted.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellar.plans.store import Files, Pointer

KEEP = 8


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the highest order of each key; of equal ones the one whose other values are highest."""
    rest = [c for c in rows.columns if c != order]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, *rest)).alias("r")).select("r.*")


def _merged(spark: SparkSession, path: str, folders: list[str], key: str, order: str) -> DataFrame:
    return newest(reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/{f}") for f in folders)), key, order)


def current(spark: SparkSession, path: str, key: str, order: str) -> DataFrame | None:
    """The table as it stands; None before the first batch."""
    now = Pointer(Files(spark), path).read()
    return _merged(spark, path, now["folders"], key, order) if now else None


def apply_batch(batch: DataFrame, number: int, path: str, key: str, order: str) -> None:
    spark = batch.sparkSession
    files = Files(spark)
    pointer = Pointer(files, path)
    now = pointer.read() or {"batch": -1, "folders": []}
    if now["batch"] >= number:
        return
    delta = f"delta-{number}-{uuid.uuid4().hex}"
    newest(batch, key, order).write.parquet(f"{path}/{delta}")
    folders = [*now["folders"], delta]
    if len(folders) > KEEP:
        base = f"base-{number}-{uuid.uuid4().hex}"
        _merged(spark, path, folders, key, order).write.parquet(f"{path}/{base}")
        folders = [base]
    pointer.move({"batch": number, "folders": folders})
    for name in files.names(path):
        if name.startswith(("delta-", "base-")) and name not in {*folders, *now["folders"]}:
            files.delete(f"{path}/{name}")


def upsert_stream(rows: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps, for each key, the row of the highest order seen; current() reads the table."""
    return rows.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
