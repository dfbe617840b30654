"""Text expressions: lines, tokens, digests, snippets. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, as the corpus's line numbers count them.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"
#: Parts of identifiers (runs of letters, digits and underscores): cut at case changes and digits. An identifier of underscores
#: only is a part itself. What follows or precedes a part inside its identifier is seen in the text as a whole, so one pass finds all.
PART = "[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|(?<![A-Za-z0-9_])_++(?![A-Za-z0-9])"
SNIPPET_CHARS = 240


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column | str) -> Column:
    """The lines of a text; a break at the very end opens no further line. Null and empty: no lines."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1))


def strip(text: Column | str) -> Column:
    """text without white space (of any kind) at its ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def tokens(text: Column | str) -> Column:
    """Lower-case terms: identifiers cut at case changes and digits; those without any such part stay whole."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(PART), F.lit(0)), F.lower)


def terms(text: Column | str) -> Column:
    """Different tokens, in order of first appearance."""
    return F.array_distinct(tokens(text))


def squeezed(text: Column | str) -> Column:
    """The different tokens written together: equal for differently spelled forms of a name."""
    return F.array_join(terms(text), "")


def content_id(*parts: Column | str) -> Column:
    """SHA-256 (hex) of the parts joined by '::'. Parts must not be null."""
    return F.sha2(F.concat_ws("::", *(_col(p).cast("string") for p in parts)).cast("binary"), 256)


def join_nonempty(*parts: Column | str, sep: str = "\n") -> Column:
    return F.array_join(F.filter(F.array(*(F.coalesce(_col(p), F.lit("")) for p in parts)), lambda x: x != ""), sep)


def snippet(text: Column | str, limit: int = SNIPPET_CHARS) -> Column:
    """Stripped non-blank lines joined by a space, cut to limit characters with an ellipsis."""
    flat = F.array_join(F.filter(F.transform(lines(text), strip), lambda x: x != ""), " ")
    short = F.concat(F.regexp_replace(F.substring(flat, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(flat) > limit, short).otherwise(flat)


def header_lines(text: Column | str) -> Column:
    """Comment text of the first two lines: after '#' (and spaces), or after '//' (slashes and spaces)."""
    first = F.transform(F.slice(lines(text), 1, 2), strip)
    marked = F.filter(first, lambda x: x.startswith("#") | x.startswith("//"))
    return F.transform(marked, lambda x: F.when(x.startswith("#"), F.regexp_replace(x, "^[# ]+", "")).otherwise(F.regexp_replace(x, "^[/ ]+", "")))


def token_estimate(text: Column | str) -> Column:
    """Words between white space, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"(?U)\S+")))


def slug(text: Column | str) -> Column:
    return F.translate(_col(text), "/: ", "___")


def mentions(line: Column | str, name: str) -> Column:
    """Whether a line names exactly this symbol: not as a part of a longer word or after a dollar sign."""
    return _col(line).rlike(r"(?U)(?<![\w$])" + quote(name) + r"(?![\w$])")


def quote(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in name)
