"""Secret scans: patterns plus sliding-window entropy, with DataFrame functions only.

Each pattern's matches come from ``regexp_extract_all``; the pieces between them, from ``split``
on the same pattern, give exact code-point offsets by running sums. Candidate strings of one character
class are scored by the highest Shannon entropy of any window: counts of the class's characters, packed
into a few numbers, are changed by the character that enters and the one that leaves. Strings on the
allow list are suppressed. Time grows with the text's length (running sums: times the logarithm of the
number of matches), also for one string or one text of millions of characters.

Null and empty texts have no spans. Nothing is shuffled and no row is dropped. Other columns pass
unchanged, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import bound, free, running

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"

# Candidate classes of the entropy scan: name, pattern, characters, bits that a window must reach.
HEX_CHARACTERS = string.digits + "abcdefABCDEF"
BASE64_CHARACTERS = string.ascii_letters + string.digits + "+/="
ENTROPY_CLASSES = (
    ("entropy_hex", r"((?<![0-9A-Fa-f])[0-9A-Fa-f]{20,})", HEX_CHARACTERS, 3.0),
    ("entropy_base64", r"((?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2})", BASE64_CHARACTERS, 3.9),
)
# What makes a candidate harmless: one repeated character, runs of a keyboard or of an example.
ALLOW = r"(?i)^(.)\1+$|example|placeholder|changeme|0123456789|abcdefghij|^[0-9]+$|^[a-z]+$"
WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


#: Characters of the pieces that a text is cut into where it is put together anew.
PIECE = 4096
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, kind: str, pattern: str, keep, group: int = 0) -> Column:
    """Spans (start, rank, kind, end) of the pattern's leftmost non-overlapping matches for which keep(group) holds."""
    rx = F.lit(pattern)
    matches = F.regexp_extract_all(text, rx, F.lit(0))
    found = F.arrays_zip(
        F.transform(matches, lambda m: F.length(m)).alias("size"),
        (F.regexp_extract_all(text, rx, F.lit(group)) if group else matches).alias("g"),
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"),
    )
    rank = F.lit(KINDS.index(kind)).alias("rank")

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        each = F.zip_with(found, ends, lambda x, e: F.struct((e - x["size"]).alias("start"), rank, F.lit(kind).alias("kind"), e.alias("end"), x["g"].alias("g")))
        kept = F.filter(each, lambda x: keep(x["g"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), rank, F.lit(kind).alias("kind"), x["end"].alias("end")))

    # The piece after the last match has no match.
    return F.when(text.rlike(pattern), bound(F.filter(found, lambda x: x["size"].isNotNull()), placed)).otherwise(F.array().cast(SPAN))


def window_entropy(token: Column, characters: str = BASE64_CHARACTERS, width: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of width of the token's characters, all of them in characters; shorter tokens: 0.

    A character's count takes FIELD bits of one of a few longs, so a step changes two of them.
    """
    field = (width + 1).bit_length()
    each = 62 // field  # fields of a long
    at = {ord(c): i for i, c in enumerate(characters)}
    known = F.array(*(F.struct(F.lit(at.get(c, 0) // each).alias("long"), F.lit(at.get(c, 0) % each * field).alias("bit")) for c in range(128)))
    weight = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)))

    def scan(codes: Column) -> Column:
        def count(n: Column, x: Column) -> Column:
            return F.call_function("shiftright", F.get(n, x["long"]), x["bit"]).bitwiseAND(F.lit((1 << field) - 1)).cast("int")

        def one(x: Column, k: Column) -> Column:
            return F.when(k == x["long"], F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])).otherwise(F.lit(0).cast("long"))

        def step(a: Column, i: Column) -> Column:
            new = F.get(codes, i)
            entered = F.transform(a["n"], lambda v, k: v + one(new, k))
            up = F.get(weight, count(a["n"], new) + 1) - F.get(weight, count(a["n"], new))
            grown = F.struct(entered.alias("n"), (a["s"] + up).alias("s"))
            return bound(grown, lambda g: F.when(i < width, F.struct(g["n"].alias("n"), g["s"].alias("s"), _best(a, g["s"], i))).otherwise(leave(a, g, F.get(codes, i - width), i)))

        def leave(a: Column, g: Column, old: Column, i: Column) -> Column:
            down = F.get(weight, count(g["n"], old) - 1) - F.get(weight, count(g["n"], old))
            left = F.transform(g["n"], lambda v, k: v - one(old, k))
            return bound(F.struct(left.alias("n"), (g["s"] + down).alias("s")), lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), _best(a, x["s"], i)))

        def _best(a: Column, s: Column, i: Column) -> Column:
            return F.greatest(a["best"], F.when(i >= width - 1, F.lit(math.log2(width)) - s / width).otherwise(F.lit(0.0))).alias("best")

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(characters) // each)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["best"])

    return F.when(F.length(token) < width, F.lit(0.0)).otherwise(bound(F.transform(F.split(token, ""), lambda c: F.get(known, F.ascii(c))), scan))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with an array of spans (start, rank, kind, end), by start, then kind as listed; end is exclusive."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = [
        _spans(t, "assign", ASSIGN, lambda g: F.length(g) >= 8, group=1),
        _spans(t, "access", ACCESS, lambda g: F.lit(True)),
        _spans(t, "hex", HEX, lambda g: F.lit(True)),
    ]
    for kind, pattern, characters, bits in ENTROPY_CLASSES:
        parts.append(_spans(t, kind, pattern, lambda g, c=characters, b=bits: ~g.rlike(ALLOW) & (window_entropy(g, c) >= b)))
    return df.withColumn(out, F.array_sort(F.concat(*parts)))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans (sorted, not empty) replaced by one mark."""

    def build(x: Column) -> Column:
        spans, ends, pieces = x["spans"], x["ends"], x["pieces"]

        def part(start: Column, end: Column) -> Column:
            of = lambda k: F.substring(F.get(pieces, k), F.greatest(start - k * PIECE, F.lit(0)) + 1, F.least(end - k * PIECE, F.lit(PIECE)) - F.greatest(start - k * PIECE, F.lit(0)))
            return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")), of), ""))

        before = F.transform(spans, lambda s, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).alias("from"), s["start"].alias("to"), i.alias("i")))
        heads = F.filter(before, lambda b: (b["i"] == 0) | (b["to"] >= b["from"]))
        last = part(F.element_at(ends, -1), F.length(text))
        return F.concat(F.array_join(F.transform(heads, lambda b: F.concat(part(b["from"], b["to"]), F.lit(mark))), ""), last)

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return bound(F.struct(spans.alias("spans"), ends.alias("ends"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")), build)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of every kind replaced by mark; overlapping spans become one mark. Null texts stay null."""
    (tmp,) = free(df, "__spans")
    found = find_secrets(df, text, tmp)
    return found.withColumn(text, F.when(F.size(tmp) > 0, masked(F.col(text), F.col(tmp), mark)).otherwise(F.col(text))).drop(tmp)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, for each row."""
    s = F.col("__s")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return find_secrets(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")), "__t", "__s").select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["rank"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
