"""Where a symbol is used outside the file that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions.text import lines, mentions, strip


def usages(files: DataFrame, symbol: str, context_path: str | None = None) -> DataFrame:
    """(relative_path, line_number, line_text): lines of files(relative_path, content, symbols) that name the symbol and do
    not define it. A map over files: each file's definitions stand in its own row, so nothing is joined."""
    others = files if context_path is None else files.where(F.col("relative_path") != context_path)
    defined = F.transform(F.filter("symbols", lambda s: s["name"] == symbol), lambda s: s["line_start"])
    named = F.filter(
        F.transform(lines("content"), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line"))),
        lambda r: mentions(r["line"], symbol) & ~F.array_contains(F.col("__defined"), r["line_number"]),
    )
    hits = others.where(F.col("content").contains(symbol)).withColumn("__defined", defined).select("relative_path", F.explode(named).alias("r"))
    return hits.select("relative_path", "r.line_number", strip(F.col("r.line")).alias("line_text"))


def definition(symbols: DataFrame, symbol: str, path: str) -> DataFrame:
    """The first definition of exactly this name in a file, or no row."""
    return symbols.where((F.col("relative_path") == path) & (F.col("name") == symbol)).orderBy("line_start", "name").limit(1)
