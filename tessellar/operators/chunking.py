"""Chunks of texts: by symbols, by markdown headings, by paragraphs packed to a budget.

Every function is a column expression over one row's text, so chunking never shuffles. A chunk is a
struct (kind, start, end, content) with lines counted from 1, ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.text import bound, lines, strip

BUDGET = 600
HEADING = r"^(#{1,6})\s+\S"
RANGES = "array<struct<start:int,end:int,size:int>>"


def _greedy(items: Column, size_of, joined, starts_anew, budget: int) -> Column:
    """Ranges (start, end, size) of consecutive items, each as long as joined(range so far, item) stays in the budget.

    Only numbers are kept on the way: texts are put together once, from the ranges.
    """
    fields = ("start", "end", "size", "lead", "trail")
    empty = F.struct(F.array().cast(RANGES).alias("done"), *(F.lit(0).alias(f) for f in fields))

    def closed(a: Column) -> Column:
        own = F.struct(a["start"].alias("start"), a["end"].alias("end"), (a["size"] - a["lead"] - a["trail"]).alias("size"))
        return F.when(a["start"] == 0, a["done"]).otherwise(F.concat(a["done"], F.array(own)))

    def opened(done: Column, x: Column, start: Column, size: Column, lead: Column) -> Column:
        return F.struct(done.alias("done"), *(c.cast("int").alias(f) for c, f in zip((start, x["n"], size, lead, x["trail"]), fields, strict=True)))

    def step(a: Column, x: Column) -> Column:
        fresh = lambda done: opened(done, x, x["n"], size_of(x), x["lead"])
        size = joined(a, x)
        return (
            F.when(starts_anew(x), F.struct(closed(a).alias("done"), *(F.lit(0).alias(f) for f in fields)))
            .when(a["start"] == 0, fresh(a["done"]))
            .when(size - a["lead"] - x["trail"] > budget, fresh(closed(a)))
            .otherwise(opened(a["done"], x, a["start"], size, a["lead"]))
        )

    return F.aggregate(items, empty, step, closed)


def paragraph_ranges(text_lines: Column, budget: int = BUDGET) -> Column:
    """Runs of non-blank lines, cut before the line with which they would exceed the budget (stripped). A longer line stays whole."""

    def measured(x: Column, i: Column) -> Column:
        lead, own = F.length(F.regexp_extract(x, r"(?U)^\s*", 0)), F.length(strip(x))
        return F.struct((i + 1).alias("n"), F.length(x).alias("size"), lead.alias("lead"), (F.length(x) - lead - own).alias("trail"), (own == 0).alias("blank"))

    return _greedy(F.transform(text_lines, measured), lambda x: x["size"], lambda a, x: a["size"] + 1 + x["size"], lambda x: x["blank"], budget)


def text_chunks(text_lines: Column, budget: int = BUDGET) -> Column:
    """Paragraph ranges joined by blank lines up to the budget; a text without any is one chunk over all its lines."""

    def chunk(start: Column, end: Column, content: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), content.alias("content"))

    def packed(x: Column) -> Column:
        lines_, pieces = x["lines"], x["pieces"]
        numbered = F.transform(pieces, lambda p, i: F.struct((i + 1).alias("n"), p["size"].alias("size"), F.lit(0).alias("lead"), F.lit(0).alias("trail")))
        groups = _greedy(numbered, lambda p: p["size"], lambda a, p: a["size"] + 2 + p["size"], lambda p: F.lit(False), budget)

        def whole(g: Column) -> Column:
            own = F.transform(F.slice(pieces, g["start"], g["end"] - g["start"] + 1), lambda p: strip(line_range(lines_, p["start"], p["end"])))
            return chunk(F.element_at(pieces, g["start"])["start"], F.element_at(pieces, g["end"])["end"], F.array_join(own, "\n\n"))

        plain = F.array(chunk(F.lit(1), F.greatest(F.lit(1), F.size(lines_)), strip(F.array_join(lines_, "\n"))))
        return F.when(F.size(pieces) > 0, F.transform(groups, whole)).otherwise(plain)

    return bound(bound(text_lines, lambda t: F.struct(t.alias("lines"), paragraph_ranges(t, budget).alias("pieces"))), packed)


def line_range(text_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, joined; beyond the text there is nothing."""
    return F.array_join(F.slice(text_lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def markdown_sections(text_lines: Column) -> Column:
    """(start, end) of each section: a heading and what follows to the next; text before the first heading too. No heading: none."""
    heads = F.filter(F.transform(text_lines, lambda x, i: F.when(strip(x).rlike(HEADING), i + 1)), lambda n: n.isNotNull())
    first = F.get(heads, F.lit(0))
    lead = F.exists(F.slice(text_lines, 1, F.greatest(first - 1, F.lit(0))), lambda x: strip(x) != "")
    before = F.when((first > 1) & lead, F.array(F.struct(F.lit(1).alias("start"), (first - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    own = F.transform(heads, lambda n, i: F.struct(n.alias("start"), (F.coalesce(F.get(heads, i + 1), F.size(text_lines) + 1) - 1).alias("end")))
    return F.when(F.size(heads) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.concat(before, own))


def _of_ranges(text_lines: Column, ranges: Column, kind) -> Column:
    return F.transform(
        ranges,
        lambda r: F.struct(kind(r).alias("kind"), r["start"].alias("start"), r["end"].alias("end"), strip(line_range(text_lines, r["start"], r["end"])).alias("content")),
    )


def markdown_chunks(text_lines: Column, budget: int = BUDGET) -> Column:
    """One chunk for each section; as plain text where there is no heading."""
    sections = markdown_sections(text_lines)
    return F.when(F.size(sections) == 0, text_chunks(text_lines, budget)).otherwise(_of_ranges(text_lines, sections, lambda r: F.lit("markdown")))


def code_chunks(text_lines: Column, symbols: Column, budget: int = BUDGET) -> Column:
    """One chunk for each symbol, nested ones too; as plain text where there is none."""
    ranges = F.transform(symbols, lambda s: F.struct(s["line_start"].alias("start"), s["line_end"].alias("end"), s["kind"].alias("kind")))
    own = F.transform(
        ranges,
        lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end"), strip(line_range(text_lines, r["start"], r["end"])).alias("content")),
    )
    return F.when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, text_chunks(text_lines, budget)).otherwise(own)


def chunked(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A row for each chunk of files(relative_path, ext, content text, symbols), by the file's kind."""
    rows = files.withColumn("__lines", lines("content"))
    t = F.col("__lines")
    by_kind = (
        F.when(F.col("ext").isin(*MARKDOWN), markdown_chunks(t, budget)).when(F.col("ext").isin(*TEXT), text_chunks(t, budget)).otherwise(code_chunks(t, F.col("symbols"), budget))
    )
    keep = [c for c in files.columns if c != "content"]
    return rows.select(*keep, F.posexplode(by_kind).alias("ordinal", "chunk")).select(*keep, "ordinal", "chunk.*")


# File suffixes by kind.
CODE = (".go", ".js", ".jsx", ".kt", ".kts", ".py", ".rs", ".ts", ".tsx")
MARKDOWN = (".markdown", ".md", ".mdx")
TEXT = (".txt",)
