"""Building, inspecting, refreshing and searching the index of a tree of files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.scoring import SearchOptions
from tessellar.operators import changes, search
from tessellar.operators.chunking import chunked
from tessellar.operators.documents import chunk_documents, identifier_documents
from tessellar.operators.embedding import Fetcher, embedded, fetched, hashing_embedder, misses, within
from tessellar.plans import models
from tessellar.plans.store import CHUNKER_VERSION, PARSER_VERSION, SCHEMA_VERSION, Metadata, Store, namespaces
from tessellar.sources import ignore
from tessellar.sources.files import INDEX_DEPTH, analysed, manifest, walk


class IndexMissing(FileNotFoundError):
    pass


class RebuildNeeded(ValueError):
    pass


@dataclass(frozen=True)
class Status:
    exists: bool
    stale: bool
    rebuild_required: bool
    provider: str | None
    model: str | None
    path: str
    indexed_files: int
    code_chunks: int
    identifier_docs: int
    changed_paths: tuple[str, ...] = ()
    removed_paths: tuple[str, ...] = ()


class Index:
    """The index of target_dir for one model; fetch turns texts into vectors."""

    def __init__(self, spark: SparkSession, target_dir: str | Path, model: str | models.Model, cache_dir: str | Path | None = None, fetch: Fetcher = hashing_embedder, depth: int = INDEX_DEPTH):
        self.spark, self.target = spark, Path(target_dir).resolve()
        self.model = models.explicit(model) if isinstance(model, str) else model
        self.cache = str(cache_dir or self.target / ".tessellar")
        self.store, self.depth = Store(spark, self.cache, self.model.namespace), depth
        self.fetch = within(fetch, self.model.environment, single=self.model.provider == "vertex_ai")

    # What is there, and what is wanted.

    def files(self) -> DataFrame:
        return walk(self.spark, self.target, depth=self.depth, texts=True)

    def wanted(self) -> Metadata:
        return Metadata(SCHEMA_VERSION, self.model.provider, self.model.name, PARSER_VERSION, CHUNKER_VERSION, ignore.fingerprint(self.target), str(self.target))

    def plan(self) -> DataFrame:
        return changes.refresh_plan(manifest(self.files()), self.store.table("files"), "relative_path", ["size_bytes", "mtime_ns", "content_hash"])

    def status(self) -> Status:
        if not self.store.current():
            return Status(False, False, False, None, None, self.store.root, 0, 0, 0)
        own = self.store.metadata()
        plan = [(r["relative_path"], r["action"]) for r in self.plan().orderBy("relative_path").collect()]
        of = lambda action: tuple(p for p, a in plan if a == action)
        rebuild = own != self.wanted()
        count = {n: self.store.table(n).count() for n in ("files", "chunks", "identifiers")}
        return Status(True, rebuild or bool(plan), rebuild, own.provider, own.model, self.store.root, count["files"], count["chunks"], count["identifiers"], of("changed"), of("removed"))

    # Changes.

    @contextmanager
    def _documents(self, files: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
        """Chunks, identifiers and symbols of files, which are read and parsed once while these are in use."""
        parsed = analysed(files).persist()
        chunks = chunk_documents(chunked(parsed), self.model.provider, self.model.name)
        docs = identifier_documents(parsed, self.model.provider, self.model.name)
        symbols = parsed.select("relative_path", "language", F.explode("symbols").alias("s")).select("relative_path", "language", "s.*")
        try:
            yield chunks, docs, symbols
        finally:
            parsed.unpersist()

    def _cache(self) -> tuple[str, DataFrame]:
        """Where this model's vectors by text are kept, and what is there."""
        path, schema = f"{self.cache.rstrip('/')}/embeddings/{self.model.namespace}", "text_sha string, vector array<double>"
        known = self.store.files.exists(path)
        return path, self.spark.read.schema(schema).parquet(path) if known else self.spark.createDataFrame([], schema)

    def _embeddings(self, chunks: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
        """known and the vectors of documents that it lacks; equal texts are fetched once, cached ones not at all."""
        every = chunks.select("embedding_id", F.col("indexed_text").alias("text")).union(docs.select("embedding_id", F.col("indexed_text").alias("text"))).dropDuplicates(["embedding_id"])
        lacking = every.join(known.select("embedding_id"), "embedding_id", "left_anti")
        path, cache = self._cache()
        _, new = embedded(lacking, cache, self.fetch)
        new.write.mode("append").parquet(path)
        cache = self._cache()[1].dropDuplicates(["text_sha"])
        keyed = lacking.withColumn("text_sha", F.sha2(F.col("text").cast("binary"), 256)).join(cache, "text_sha")
        fresh = keyed.select("embedding_id", F.lit(self.model.provider).alias("provider"), F.lit(self.model.name).alias("model"), "vector")
        return known.unionByName(fresh)

    def init(self) -> Status:
        """Builds everything anew."""
        files = self.files()
        none = self.store.spark.createDataFrame([], "embedding_id string, provider string, model string, vector array<double>")
        with self._documents(files) as (chunks, docs, symbols):
            self.store.publish(self.wanted(), {"files": manifest(files), "chunks": chunks, "identifiers": docs, "symbols": symbols, "embeddings": self._embeddings(chunks, docs, none)})
        return self.status()

    def refresh(self, full: bool = False) -> Status:
        """Brings the index up to date: only changed files are parsed, and only new texts embedded."""
        if full:
            return self.init()
        if not self.store.current():
            raise IndexMissing("Index not found. Build it first.")
        if self.store.metadata() != self.wanted():
            raise RebuildNeeded("The index was built with other settings; rebuild it in full.")
        files, plan = self.files(), self.plan().persist()
        changed = plan.where("action = 'changed'").select("relative_path")
        current = files.select("relative_path")
        table = self.store.table
        new_rows = lambda name, rows: changes.replaced(table(name), rows.select(*table(name).columns), changed, current, "relative_path")
        with self._documents(files.join(changed, "relative_path", "left_semi")) as (chunks, docs, symbols):
            tables = {"files": manifest(files), "chunks": new_rows("chunks", chunks), "identifiers": new_rows("identifiers", docs), "symbols": new_rows("symbols", symbols)}
            tables["embeddings"] = changes.referenced(self._embeddings(chunks, docs, table("embeddings")), "embedding_id", tables["chunks"], tables["identifiers"])
            self.store.publish(self.wanted(), tables)
        plan.unpersist()
        return self.status()

    def ensure(self) -> Status:
        """An index that can be searched: built if missing, refreshed if stale, an error if it must be rebuilt."""
        at = replace_depth(self, INDEX_DEPTH)
        now = at.status()
        if not now.exists:
            return at.init()
        if now.rebuild_required:
            raise RebuildNeeded("The index was built with other settings; rebuild it in full.")
        return at.refresh() if now.stale else now

    # Queries.

    def queries(self, texts: list[str]) -> DataFrame:
        """Query texts with their vectors, which are cached as documents' are: a text is fetched once."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        path, cache = self._cache()
        keyed = rows.withColumn("text_sha", F.sha2(F.col("text").cast("binary"), 256))
        lacking = misses(keyed, cache).persist()
        if lacking.head(1):
            fetched(lacking, self.fetch).write.mode("append").parquet(path)
        lacking.unpersist()
        known = self._cache()[1].join(F.broadcast(keyed.select("text_sha").distinct()), "text_sha").dropDuplicates(["text_sha"])
        return keyed.join(known, "text_sha").select("query_id", F.col("text").alias("query"), "vector")

    def search_code(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        self.ensure()
        return search.search_code(self.store.table("chunks"), self.store.table("embeddings"), self.queries([query]), options).orderBy("rank")

    def search_identifiers(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        self.ensure()
        return search.search_identifiers(self.store.table("identifiers"), self.store.table("embeddings"), self.queries([query]), options).orderBy("rank")


def replace_depth(index: Index, depth: int) -> Index:
    return index if index.depth == depth else Index(index.spark, index.target, index.model, index.cache, index.fetch, depth)


def clear(spark: SparkSession, cache_dir: str | Path, selector: str | None = None) -> bool:
    """Drops one model's index, or all; whether there was any. Cached vectors stay."""
    names = [models.explicit(selector).namespace] if selector else namespaces(spark, str(cache_dir))
    return any([Store(spark, str(cache_dir), n).clear() for n in names])


__all__ = ["Index", "IndexMissing", "RebuildNeeded", "Status", "clear", "replace"]
