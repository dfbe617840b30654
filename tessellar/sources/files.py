"""Files of a tree as a table: folders are listed by tasks, only files that count are read, and they are fingerprinted and parsed there.

The tree is one that all executors see under the same path. Spark's own file reader is not used: it passes over names
that start with '_' or '.', leaves out empty files, and reads every file before a filter on its path applies.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators.chunking import CODE, MARKDOWN, TEXT
from tessellar.sources.ignore import IgnoreRules
from tessellar.sources.parsing import parsed

# Folders that are never entered, and languages by suffix.
SKIPPED = (".git", ".tessellar", "__pycache__")
LANGUAGES = {
    ".go": "go", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin",
    ".py": "python", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript",
}
INDEX_DEPTH = 64


def language(ext: Column) -> Column:
    out = F.lit("text")
    for suffix, name in LANGUAGES.items():
        out = F.when(ext == suffix, name).otherwise(out)
    return out


def resolved(root: str | Path, target: str | None = None) -> tuple[Path, Path]:
    """(root, target), both absolute; the target must exist inside the root."""
    base = Path(root).resolve()
    at = (base / (target or ".")).resolve()
    if not at.exists():
        raise FileNotFoundError(f"no such file or directory: {at}")
    if at != base and base not in at.parents:
        raise ValueError(f"{at} is outside {base}")
    return base, at


SCHEMA = "relative_path string, depth int, ext string, size_bytes long, mtime_ns long, content binary"
#: Bytes of content that one batch holds, beyond its last file.
BATCH = 32 << 20


def _names(folder: str) -> list[os.DirEntry]:
    with os.scandir(folder) as found:
        return sorted(found, key=lambda e: e.name)


class Scope:
    """Which folders of a tree are entered and which files count."""

    def __init__(self, base: Path, depth: int, suffixes: tuple[str, ...], rules: IgnoreRules):
        self.base, self.depth, self.suffixes, self.rules = base.as_posix().rstrip("/") + "/", max(depth, 0), suffixes, rules

    def path(self, entry: os.DirEntry) -> str:
        return entry.path[len(self.base) :]

    def enters(self, entry: os.DirEntry, depth: int) -> bool:
        """Whether a folder that stands in one at this depth is entered."""
        return depth < self.depth and entry.name not in SKIPPED and entry.is_dir() and self.rules.includes(self.path(entry))

    def takes(self, entry: os.DirEntry) -> bool:
        return Path(entry.name).suffix.lower() in self.suffixes and entry.is_file() and self.rules.includes(self.path(entry))

    def below(self, folder: str, depth: int) -> Iterator[tuple[str, int]]:
        """(path, depth) of the files that count in a folder and below."""
        for e in _names(folder):
            if self.enters(e, depth):
                yield from self.below(e.path, depth + 1)
            elif self.takes(e):
                yield e.path, depth


def _read(paths: Iterator[tuple[str, int]], base: str) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    rows, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for path, depth in paths:
        content, stat = Path(path).read_bytes(), os.stat(path)
        rows.append((path[len(base) :], depth, Path(path).suffix.lower(), stat.st_size, stat.st_mtime_ns, content))
        size += len(content)
        if size >= BATCH:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def walk(spark: SparkSession, root: str | Path, target: str | None = None, depth: int = 2, texts: bool = False, rules: IgnoreRules | None = None) -> DataFrame:
    """(relative_path, depth, ext, size_bytes, mtime_ns, content binary) of the supported files under target, at most depth folders down.

    An ignored folder is not entered, so an override can bring back only what lies in a folder that is entered.
    A target that is a file is taken whatever its suffix, at depth 0, unless it is ignored.
    """
    base, at = resolved(root, target)
    rules = IgnoreRules.read(base) if rules is None else rules
    scope = Scope(base, depth, (*CODE, *((*MARKDOWN, *TEXT) if texts else ())), rules)
    inside = at.relative_to(base).parts
    above = ["/".join(inside[: n + 1]) for n in range(len(inside))]
    if any(p in SKIPPED for p in inside) or any(rules.ignores(p) for p in above):
        return spark.createDataFrame([], SCHEMA)
    # Files at the top and folders two levels down become rows; tasks list what is below each.
    tops: list[tuple[str, int, bool]] = []
    if at.is_file():
        tops.append((at.as_posix(), 0, True))
    else:
        open_ = [(at.as_posix(), 0)]
        while open_:
            folder, level = open_.pop()
            for e in _names(folder):
                if scope.enters(e, level):
                    (open_ if level < 2 else tops).append((e.path, level + 1) if level < 2 else (e.path, level + 1, False))
                elif scope.takes(e):
                    tops.append((e.path, level, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, int]]:
            for b in batches:
                for r in b.to_pylist():
                    yield from [(r["path"], r["depth"])] if r["file"] else scope.below(r["path"], r["depth"])

        yield from _read(found(), scope.base)

    rows = spark.createDataFrame(tops, "path string, depth int, file boolean")
    parts = min(max(1, len(tops)), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts).mapInArrow(run, SCHEMA)


def analysed(files: DataFrame) -> DataFrame:
    """files with their text in place of bytes, a content hash, language, header lines and symbols: one read, one parse."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    hashed = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("content", text).withColumn("language", language(F.col("ext")))
    return parsed(hashed)


def manifest(files: DataFrame) -> DataFrame:
    """(relative_path, size_bytes, mtime_ns, content_hash) of each file."""
    return files.select("relative_path", "size_bytes", "mtime_ns", F.sha2("content", 256).alias("content_hash"))


def by_directory(files: DataFrame) -> DataFrame:
    """(directory, paths): files grouped by their folder, '.' for the root."""
    folder = F.when(F.col("relative_path").contains("/"), F.regexp_replace("relative_path", "/[^/]*$", "")).otherwise(".")
    return files.groupBy(folder.alias("directory")).agg(F.sort_array(F.collect_list("relative_path")).alias("paths"))


def directories(paths: DataFrame, path: str = "relative_path") -> DataFrame:
    """Every folder above some path, once."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return paths.select(F.explode(above).alias("directory")).distinct()
