"""Index tables in versioned folders: a version becomes visible when a pointer to it appears.

Pointers are numbered files that are never overwritten: the one with the highest number holds, so a
writer that dies at any moment leaves the last complete version in place. The version before stays
until the next one is written, for readers that have it open.

Everything goes through Hadoop's file system API, so a store can lie wherever Spark reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION, PARSER_VERSION, CHUNKER_VERSION = "1", "1", "1"
TABLES = {
    "files": "relative_path string, size_bytes long, mtime_ns long, content_hash string",
    "chunks": "chunk_id string, relative_path string, kind string, start_line int, end_line int, content string, path_text string, header_text string, file_symbol_text string, local_symbol_text string, body_text string, indexed_text string, embedding_id string",
    "identifiers": "doc_id string, relative_path string, kind string, symbol_name string, start_line int, end_line int, content string, path_text string, header_text string, symbol_name_text string, signature_text string, context_text string, indexed_text string, embedding_id string",
    "embeddings": "embedding_id string, provider string, model string, vector array<double>",
    "symbols": "relative_path string, language string, kind string, name string, signature string, line_start int, line_end int",
}


@dataclass(frozen=True)
class Metadata:
    schema_version: str
    provider: str
    model: str
    parser_version: str
    chunker_version: str
    ignore_fingerprint: str
    target: str


class Files:
    """The few file operations that a store needs on the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file: written beside path, then renamed."""
        tmp, fs = self._at(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(tmp, self._at(path)[0]):
            fs.delete(tmp, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


class Pointer:
    """The current value of a folder, as the highest of its files CURRENT-<number>."""

    def __init__(self, files: Files, root: str):
        self.files, self.root = files, root

    def numbers(self) -> list[int]:
        return sorted(int(n[8:]) for n in self.files.names(self.root) if n.startswith("CURRENT-") and n[8:].isdigit())

    def read(self, back: int = 0) -> dict | None:
        """The value, or the one before it by so many; None where there is none or it cannot be read."""
        known = self.numbers()
        text = self.files.read(f"{self.root}/CURRENT-{known[-1 - back]:012d}") if len(known) > back else None
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None

    def move(self, value: dict) -> None:
        """A new value; all but it and the one before are dropped. A writer that comes second fails."""
        known = self.numbers()
        self.files.write(f"{self.root}/CURRENT-{(known[-1] if known else 0) + 1:012d}", json.dumps(value, sort_keys=True))
        for n in known[:-1]:
            self.files.delete(f"{self.root}/CURRENT-{n:012d}")


class Store:
    """The index of one model over one tree."""

    def __init__(self, spark: SparkSession, cache_dir: str, namespace: str):
        self.spark, self.files = spark, Files(spark)
        self.root = f"{str(cache_dir).rstrip('/')}/indexes/{namespace}"
        self.pointer = Pointer(self.files, self.root)

    def current(self) -> dict | None:
        """The pointer's content (version, metadata), or None where there is no complete index."""
        found = self.pointer.read()
        ok = found and set(found.get("metadata", {})) == {*Metadata.__dataclass_fields__}
        return found if ok else None

    def metadata(self) -> Metadata | None:
        found = self.current()
        return Metadata(**found["metadata"]) if found else None

    def table(self, name: str) -> DataFrame:
        """A table as it stands; an empty one where there is no index."""
        found = self.current()
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{found['version']}/{name}")

    def publish(self, metadata: Metadata, tables: dict[str, DataFrame]) -> None:
        """Writes all tables of a new version, then points to it, then drops versions older than the one before."""
        version, before = f"v-{uuid.uuid4().hex}", self.current()
        for name, df in tables.items():
            df.select(*(c.split(" ")[0] for c in TABLES[name].split(", "))).write.option("compression", "zstd").parquet(f"{self.root}/{version}/{name}")
        self.pointer.move({"version": version, "metadata": asdict(metadata)})
        keep = {version, (before or {}).get("version")}
        for old in self.files.names(self.root):
            if old.startswith("v-") and old not in keep:
                self.files.delete(f"{self.root}/{old}")

    def clear(self) -> bool:
        return self.files.delete(self.root)


def namespaces(spark: SparkSession, cache_dir: str) -> list[str]:
    """Names of all indexes that have a pointer."""
    files, root = Files(spark), f"{str(cache_dir).rstrip('/')}/indexes"
    return [n for n in files.names(root) if Pointer(files, f"{root}/{n}").numbers()]
