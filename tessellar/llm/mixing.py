"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words;
a target stops at max_rate times its source's words, and the excess is shared again by weight.

Rates: among all document rates from 0 to max_rate whose word totals meet the sources' targets, those
nearest to one copy of each document in relative entropy. They are tilted exponentially by the words that
the constraint counts: min(max_rate, exp(lambda * words)), with one multiplier for each source. The dual
is convex; Newton's iteration takes its gradient and Hessian from sums over all documents, gathered by
source and size beforehand, keeps a bracket around each root, halves it where a step would leave it,
and stops when every source's total is within TOLERANCE of its target. So a source above its target
loses its long documents first and one below it repeats them first. Sums are decimal and do not depend
on their order: reruns agree.

Rounding: within blocks of about BLOCK documents of one source, largest first, each document takes
the whole number of copies nearest to its rate plus what earlier ones left over, so a block's error
is about half its smallest document. Rows of equal source, id and size are counted and rounded together,
in pieces of at most PIECE, so that neither a hot source nor a hot id meets in one task.

Null texts have size 0 and take nothing; null sources are one source; repeated rows are separate
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import WORD, discard, stored

MAX_RATE = 3
BLOCK = 128
PIECE = 10_000
NEWTON_STEPS = 80
#: Of a target, besides a thousandth of a word.
TOLERANCE = 1e-8
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their position (from 0) in code-point order, null last, without putting all in one task."""
    table = stored(
        sources.sort(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("__m")), "mix-sources"
    )
    part = F.shiftright("__m", 33)
    counts = sorted((r["p"], r["n"]) for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    offset, at = [], 0
    for p, n in counts:
        offset += [F.lit(p), F.lit(at)]
        at += n
    base = F.element_at(F.create_map(*offset), part) if offset else F.lit(0)
    return table.withColumn("position", base.cast("long") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")


def fill_targets(sources: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """sources(source, source_size, weight) with target: shares of the whole by weight, none above max_rate times its size."""
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words, weights = float(total[0] or 0), float(total[1] or 0)
    level, full = (words / weights if weights else 0.0), -1
    cap = F.col("source_size") * float(max_rate)
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        got = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)
        ).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (words - got[0]) / float(got[1])
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def _rate(lam: Column, size: Column, scale: Column, max_rate: float) -> Column:
    return F.least(F.lit(float(max_rate)), F.exp(F.least(lam * size / scale, F.lit(50.0))))


def _spread(table: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """table with the columns of its source's row; null is a source too. Broadcast only if there are few sources."""
    right = sources.withColumnRenamed("source", "__source")
    return table.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def tilt(sources: DataFrame, sizes: DataFrame, small: bool, max_rate: float = MAX_RATE) -> DataFrame:
    """sources(source, source_size, scale, target) with lam, the dual's solution, and fixed: the rate where no document has a choice.

    sizes(source, size, n): how many documents of each size; scale: words by which sizes are measured.
    """
    cap = F.col("source_size") * float(max_rate)
    fixed = F.when((F.col("target") <= 0) | (F.col("source_size") <= 0), 0.0).when(F.col("target") >= cap * (1 - 1e-12), float(max_rate))
    none = F.lit(None).cast("double")
    now = stored(sources.withColumn("fixed", fixed).withColumn("lam", F.lit(0.0)).withColumn("low", none).withColumn("high", none), "mix-dual")
    for _ in range(NEWTON_STEPS):
        each = _spread(sizes, now.where("fixed is null").select("source", "lam", "scale"), small)
        rate, size = _rate(F.col("lam"), F.col("size"), F.col("scale"), max_rate), F.col("size").cast("double")
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        mass, free = F.col("n") * size * rate, rate < max_rate
        sums = each.groupBy("source").agg(exact(mass).alias("mass"), exact(F.when(free, mass * size / F.col("scale")).otherwise(0.0)).alias("slope"))
        joined = now.join(sums.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        gap, lam = F.col("target") - F.col("mass"), F.col("lam")
        low, high = F.when(gap > 0, lam).otherwise(F.col("low")), F.when(gap < 0, lam).otherwise(F.col("high"))
        far = F.greatest(F.abs(lam), F.lit(1.0))
        newton = F.greatest(lam - far, F.least(lam + far, F.when(F.col("slope") > 0, lam + gap / F.col("slope")).otherwise(lam + F.signum(gap) * far)))
        step = F.when((newton <= low) | (newton >= high), F.coalesce((low + high) / 2, newton)).otherwise(newton)
        done = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target") + 1e-3, F.lit(True))
        last, now = now, stored(joined.select(*sources.columns, "fixed", F.when(done, lam).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")), "mix-dual")
        discard(last)
        if not now.where(~F.col("done")).head(1):
            break
    return now.select(*sources.columns, "fixed", "lam")


def rounded(groups: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """groups(doc_id, source, size, n, source_size, target, n_docs, rate): n rows of equal id and size; a row for each with its copies."""
    pieces = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))).withColumn("n", F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE))
    mixed = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "size", "piece").cast("binary")), 1, 8), 16, 10).cast("long")
    block = mixed % F.ceil(F.col("n_docs") / F.lit(BLOCK))
    own = F.struct((-F.col("size")).alias("neg"), F.col("doc_id").alias("doc_id"), F.col("piece").alias("piece"), F.col("n").alias("n"), F.col("rate").alias("rate"))
    blocks = pieces.groupBy("source", "source_size", "target", block.alias("block")).agg(F.array_sort(F.collect_list(own)).alias("docs"))  # about BLOCK rows each

    def step(a: Column, x: Column) -> Column:
        size = (-x["neg"]).cast("double")
        want = x["rate"] * size * x["n"] + a["carry"]
        k = F.when(size > 0, F.greatest(F.lit(0).cast("long"), F.least(x["n"] * max_rate, F.round(want / size).cast("long")))).otherwise(F.lit(0).cast("long"))
        return F.struct((want - k * size).alias("carry"), F.concat(a["out"], F.array(k)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("out"))
    dealt = blocks.select("source", "source_size", "target", F.explode(F.arrays_zip("docs", F.aggregate("docs", start, step, lambda a: a["out"]).alias("k"))).alias("x"))
    d = F.col("x.docs")
    rows = dealt.select(d["doc_id"].alias("doc_id"), "source", (-d["neg"]).alias("size"), "source_size", "target", d["rate"].alias("rate"), d["n"].alias("n"), F.col("x.k").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), d["n"])).alias("i"))
    copies = F.floor(F.col("k") / F.col("n")) + (F.col("i") <= F.col("k") % F.col("n")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of df: doc_id, source, size, source_size, target, rate, copies, taken."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    groups = stored(docs.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "mix-groups")
    sizes = stored(groups.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    words = F.sum(F.col("size") * F.col("n"))
    totals = sizes.groupBy("source").agg(words.alias("source_size"), F.sum("n").alias("n_docs"), F.greatest(F.lit(1.0), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.nullif(words, F.lit(0))).alias("scale"))
    placed = stored(ranked(totals).withColumn("weight", F.col("position") % 3 + 1).drop("position"), "mix-weights")
    small = placed.count() <= BROADCAST_SOURCES
    rates = tilt(fill_targets(placed), sizes, small)
    joined = _spread(groups, rates.drop("weight"), small)
    return rounded(joined.withColumn("rate", F.coalesce("fixed", _rate(F.col("lam"), F.col("size"), F.col("scale"), MAX_RATE)))).withColumn("taken", F.col("size") * F.col("copies"))


def report(df: DataFrame) -> DataFrame:
    """The mix by document, targets to six digits: sums of doubles need not agree in the last ones."""
    return mix(df).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "copies")
