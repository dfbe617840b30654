"""Stored documents: field texts, indexed text and content-addressed ids of chunks and of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.text import content_id, join_nonempty

SYMBOLS = "array<struct<kind:string,name:string,signature:string,line_start:int,line_end:int>>"


def file_symbol_text(symbols: Column) -> Column:
    """Signatures and names of all symbols, each text once."""
    each = F.flatten(F.transform(symbols, lambda s: F.array(s["signature"], s["name"])))
    return F.array_join(F.filter(F.array_distinct(each), lambda x: x != ""), "\n")


def symbol_of(symbols: Column, start: Column, end: Column) -> Column:
    """The symbol with exactly this range, else the first that contains it, else null."""
    same = F.filter(symbols, lambda s: (s["line_start"] == start) & (s["line_end"] == end))
    around = F.filter(symbols, lambda s: (s["line_start"] <= start) & (s["line_end"] >= end))
    return F.coalesce(F.get(same, F.lit(0)), F.get(around, F.lit(0)))


def chunk_documents(chunks: DataFrame, provider: str, model: str) -> DataFrame:
    """Rows of chunks(relative_path, header_lines, symbols, ordinal, kind, start, end, content) as stored code chunks.

    The ordinal of a chunk among equal ranges of a file is part of its id, so that two symbols on one line stay apart.
    """
    s = symbol_of(F.col("symbols"), F.col("start"), F.col("end"))
    local = F.when(s.isNull(), F.lit("")).otherwise(join_nonempty(s["signature"], s["name"]))
    rows = chunks.select(
        "relative_path",
        "kind",
        F.col("start").alias("start_line"),
        F.col("end").alias("end_line"),
        "content",
        "ordinal",
        F.col("relative_path").alias("path_text"),
        F.array_join("header_lines", "\n").alias("header_text"),
        file_symbol_text(F.col("symbols")).alias("file_symbol_text"),
        local.alias("local_symbol_text"),
        F.col("content").alias("body_text"),
    )
    rows = rows.withColumn("indexed_text", join_nonempty("header_text", "file_symbol_text", "local_symbol_text", "body_text", "path_text"))
    return rows.select(
        content_id("relative_path", "kind", "start_line", "end_line", "ordinal").alias("chunk_id"),
        *(c for c in rows.columns if c != "ordinal"),
        content_id(F.lit(provider), F.lit(model), "indexed_text").alias("embedding_id"),
    )


def identifier_documents(files: DataFrame, provider: str, model: str) -> DataFrame:
    """A row for each symbol of files(relative_path, header_lines, symbols)."""
    rows = files.select("relative_path", F.array_join("header_lines", "\n").alias("header_text"), F.posexplode("symbols").alias("ordinal", "s"))
    rows = rows.select(
        "relative_path",
        F.col("s.kind").alias("kind"),
        F.col("s.name").alias("symbol_name"),
        F.col("s.line_start").alias("start_line"),
        F.col("s.line_end").alias("end_line"),
        F.col("s.signature").alias("content"),
        "ordinal",
        F.col("relative_path").alias("path_text"),
        "header_text",
        F.col("s.name").alias("symbol_name_text"),
        F.col("s.signature").alias("signature_text"),
        join_nonempty("header_text", "s.name", "s.signature", "relative_path").alias("context_text"),
    )
    rows = rows.withColumn("indexed_text", join_nonempty("header_text", "symbol_name_text", "signature_text", "path_text", "context_text"))
    return rows.select(
        content_id("relative_path", "symbol_name", "start_line", "end_line", "ordinal").alias("doc_id"),
        *(c for c in rows.columns if c != "ordinal"),
        content_id(F.lit(provider), F.lit(model), "indexed_text").alias("embedding_id"),
    )
