"""Hybrid search: vectors and fielded terms, thresholds, order, boosts for names, and diversity.

Queries are a table; one plan answers all of them: the corpus is read once, and the small query
table is broadcast after its size has been checked. Larger query tables go in blocks of MAX_QUERIES.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.functions import scoring as S
from tessellar.functions.intent import CODE_WEIGHTS, IDENTIFIER_WEIGHTS, intent
from tessellar.functions.text import snippet, strip, terms, tokens

MAX_QUERIES = 1024
CODE_FIELDS = {"path": "path_text", "header": "header_text", "file_symbol": "file_symbol_text", "local_symbol": "local_symbol_text", "body": "body_text"}
IDENTIFIER_FIELDS = {"path": "path_text", "header": "header_text", "symbol_name": "symbol_name_text", "signature": "signature_text", "context": "context_text"}
# How near two results are to count as one, and how far below the best another file may stand.
CLOSE, NEAR_LINES, FILE_GAP = 0.03, 3, 0.06


def prepared(queries: DataFrame) -> DataFrame:
    """queries(query_id, query, vector) with terms, intent and the vector's norm, all computed once for each query."""
    return queries.select(
        "query_id",
        "query",
        tokens("query").alias("__terms"),
        intent(F.col("query")).alias("intent"),
        F.transform("vector", lambda x: x.cast("double")).alias("__qv"),
        S.norm(F.col("vector")).alias("__qn"),
    )


def paired(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row with every query: blocks of at most MAX_QUERIES queries, broadcast to where the rows are."""
    n = queries.count()
    if n <= MAX_QUERIES:
        return rows.join(F.broadcast(queries))
    blocks = -(-n // MAX_QUERIES)
    of = lambda k: queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
    return reduce(DataFrame.unionByName, (rows.join(F.broadcast(of(k))) for k in range(blocks)))


def against(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of the corpus with every query, prepared."""
    return paired(corpus, prepared(queries))


def with_terms(corpus: DataFrame, fields: dict[str, str]) -> DataFrame:
    """corpus with the different terms of each field, cut once for each row, however many queries follow."""
    return corpus.withColumns({f"__terms_{name}": terms(c) for name, c in fields.items()})


def field_scores(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """rows of with_terms and prepared queries, with each field's score and the number of query terms in their place."""
    score = {f"__score_{n}": S.field_score(F.col("query"), F.col("__terms"), F.col(c), F.col(f"__terms_{n}")) for n, c in fields.items()}
    return rows.withColumns(score).drop(*(f"__terms_{n}" for n in fields))


def scored(corpus: DataFrame, queries: DataFrame, fields: dict[str, str], profiles: dict, options: S.SearchOptions) -> DataFrame:
    """Rows that pass the thresholds, with semantic, lexical and combined score, all rounded."""
    rows = field_scores(against(with_terms(corpus, fields).withColumn("__vn", S.norm(F.col("vector"))), queries), fields)
    columns, scores = {n: F.col(c) for n, c in fields.items()}, {n: F.col(f"__score_{n}") for n in fields}
    semantic = S.cosine(F.col("vector"), F.col("__qv"), F.col("__vn"), F.col("__qn"))
    lexical = F.when(F.size("__terms") == 0, F.lit(0.0)).otherwise(S.profiled_mean(F.col("intent"), scores, columns, profiles))
    # As an array of at most one struct, each score is computed once; as columns, the filter would be pushed below
    # them with copies of all they are made of.
    pair = F.array(F.struct(semantic.alias("semantic"), lexical.alias("lexical")))
    three = F.transform(pair, lambda x: F.struct(x["semantic"].alias("semantic"), x["lexical"].alias("lexical"), S.combined(x["semantic"], x["lexical"], options).alias("score")))
    kept = F.filter(three, lambda x: S.passes(x["semantic"], x["lexical"], x["score"], options))
    shown = [c for c in rows.columns if not c.startswith("__") and c != "vector"]
    rows = rows.select(*shown, F.explode(kept).alias("__s"))
    return rows.select(*shown, *(F.round(F.col(f"__s.{c}"), S.DIGITS).alias(c) for c in ("score", "semantic", "lexical")))


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query; limits are pushed below the shuffle by the rank filter."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _lexical(corpus: DataFrame, queries: DataFrame, fields: dict[str, str], profiles: dict) -> tuple[DataFrame, list[str | None]]:
    """corpus with __lexical, its score for each different query text, and those texts in that order."""
    texts = queries.select("query").distinct().select(F.struct("query", tokens("query").alias("terms"), intent(F.col("query")).alias("intent")).alias("t"))
    texts = texts.agg(F.sort_array(F.collect_list("t")).alias("__texts"))
    columns = {n: F.col(c) for n, c in fields.items()}

    def one(t):
        scores = {n: S.field_score(t["query"], t["terms"], F.col(c), F.col(f"__terms_{n}")) for n, c in fields.items()}
        return F.when(F.size(t["terms"]) == 0, F.lit(0.0)).otherwise(S.profiled_mean(t["intent"], scores, columns, profiles))

    order = [t["query"] for t in texts.first()["__texts"]]
    return with_terms(corpus, fields).join(F.broadcast(texts)).withColumn("__lexical", F.transform("__texts", one)), order


def _nearest(rows: DataFrame, asked: list, width: int, o: S.SearchOptions, most: int) -> DataFrame:
    """Of scored()'s rows at least the first most of each query, whatever ties: rows(*SHOWN, __lexical, vector), asked(query_id, number of its text, vector or None), vectors of so many numbers.

    All pairs are scored in numpy, by products of matrices; those that can be among a task's best are scored again as scored() does,
    in the same order of operations, and go on.
    """
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    total = o.semantic_weight + o.keyword_weight

    def combined(semantic: np.ndarray, lexical: np.ndarray) -> np.ndarray:
        own = np.where(semantic > 0, semantic, np.where(np.isnan(semantic), semantic, 0.0))
        x = (o.semantic_weight * own + o.keyword_weight * lexical) / total if total > 0 else semantic
        return np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))  # NaN counts as the greatest, as in Spark

    def in_turn(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
        out = np.zeros(len(a[i]) if isinstance(i, slice) else len(i))
        for x, y in zip(a.T, b.T, strict=True):
            out += x[i] * y[j]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, text = np.array([q[0] for q in shared.value], np.int64), np.array([q[1] for q in shared.value], np.int64)
        unknown = np.array([q[2] is None for q in shared.value], bool)
        v = np.array([q[2] or [0.0] * width for q in shared.value], float).reshape(len(ids), width)
        vn, least, waiting, held = np.sqrt(in_turn(v, v)), np.full(len(v), -np.inf), [], 0

        def best() -> list:
            whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            order = np.lexsort((-whole[3], whole[0]))
            q, score = whole[0][order], whole[3][order]
            first = np.searchsorted(q, np.arange(len(v)))
            full = np.flatnonzero(np.searchsorted(q, np.arange(len(v)), side="right") - first >= most)
            least[full] = score[first[full] + most - 1] - 1.5 * 10.0**-S.DIGITS  # rounded, lower ones may be equal
            keep = order[score >= least[q]]
            return [x[keep] for x in whole]

        tables, at = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            tables.append(t.select(list(SHOWN)))
            lists = b.column(b.schema.get_field_index("vector"))
            size = pc.list_value_length(lists)
            if not unknown.all() and pc.any(pc.not_equal(size, width)).as_py():
                raise ValueError("vectors of different lengths")
            none = np.array(pc.is_null(lists)).astype(bool)
            x = np.zeros((b.num_rows, width))
            if width and not none.all():
                flat = pc.list_flatten(lists)
                x[~none] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
                none[~none] = np.array(flat.is_null()).reshape(-1, width).any(1)
                x[none] = 0
            lexical = np.array(b.column(b.schema.get_field_index("__lexical")).to_pylist(), float).reshape(b.num_rows, -1)
            xn = np.sqrt(in_turn(x, x))
            step = max(1, 500_000 // max(1, len(v)))
            for k in range(0, b.num_rows if len(v) else 0, step):
                part = slice(k, k + step)
                norms = xn[part, None] * vn[None]
                rough = np.divide(x[part] @ v.T, norms, out=np.zeros_like(norms), where=norms != 0)
                i, j = np.nonzero(combined(rough, lexical[part][:, text]) >= np.maximum(least, o.min_combined) - 1e-9)
                i += k
                norm = xn[i] * vn[j]
                semantic = np.divide(in_turn(x, v, i, j), norm, out=np.zeros(len(i)), where=norm != 0)
                lex = lexical[i, text[j]]
                blank = (none[i] | unknown[j]) & ~(~none[i] & (xn[i] == 0) | ~unknown[j] & (vn[j] == 0))  # beside a zero vector, a null one counts as 0
                score = combined(semantic, lex)
                own = np.where(np.isnan(semantic), np.inf, np.maximum(semantic, 0.0))
                ok = (own >= o.min_semantic) & (lex >= o.min_keyword) & (score >= o.min_combined)
                ok &= (own > 0) & ~blank if o.require_semantic else True
                ok &= lex > 0 if o.require_keyword else True
                waiting.append([j[ok], i[ok] + at, np.where(blank, 2.0, semantic)[ok], score[ok], lex[ok]])
                held += int(ok.sum())
                if held > 2 * most * len(v):
                    waiting[:] = [best()]
                    held = len(waiting[0][0])
            at += b.num_rows
        if not waiting:
            return
        j, i, semantic, score, lex = best()
        whole = pa.concat_tables(tables)
        for k in range(0, len(j), 10_000):
            part = slice(k, k + 10_000)
            out = whole.take(pa.array(i[part]))
            out = out.append_column("query_id", pa.array(ids[j[part]])).append_column("score", pa.array(score[part])).append_column("lexical", pa.array(lex[part]))
            yield from out.append_column("semantic", pa.array(semantic[part], mask=semantic[part] == 2.0)).combine_chunks().to_batches()

    kept = rows.mapInArrow(run, "chunk_id string, relative_path string, start_line int, end_line int, query_id long, score double, lexical double, semantic double")
    return kept.select("query_id", *SHOWN, *(F.round(c, S.DIGITS).alias(c) for c in ("score", "semantic", "lexical")))


SHOWN = ("chunk_id", "relative_path", "start_line", "end_line")


def search_code(chunks: DataFrame, embeddings: DataFrame | None, queries: DataFrame, options: S.SearchOptions | None = None, first: int = 500) -> DataFrame:
    """(query_id, rank, relative_path, start_line, end_line, score, semantic, lexical, snippet) of each query's chunks.

    Without embeddings, chunks have their vectors. Each query reads its first rows, and eight times as many while those do not settle its outcome.
    """
    o = options or S.SearchOptions()
    spark = chunks.sparkSession
    corpus = chunks if embeddings is None else chunks.join(embeddings.select("embedding_id", "vector"), "embedding_id")
    rows, texts = _lexical(corpus, queries, CODE_FIELDS, CODE_WEIGHTS)
    rows = rows.select("chunk_id", "relative_path", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "__lexical", F.col("vector").cast("array<double>").alias("vector")).persist(StorageLevel.DISK_ONLY)
    number = {t: n for n, t in enumerate(texts)}
    asked = [(r[0], number[r[1]], None if r[2] is None or None in r[2] else r[2]) for r in queries.select(F.col("query_id").cast("long"), "query", F.col("vector").cast("array<double>")).collect()]
    width = max((len(q[2]) for q in asked if q[2] is not None), default=0)
    if any(len(q[2]) != width for q in asked if q[2] is not None):
        raise ValueError("vectors of different lengths")
    try:
        picked = _settled(spark, lambda most, ids: _nearest(rows, [q for q in asked if ids is None or q[0] in ids], width, o, most), o.top_k, first)
        # A snippet of an array's one element stays above the join: it is cut for the rows shown, not for all chunks.
        shown = chunks.select("chunk_id", "content").join(F.broadcast(picked), "chunk_id")  # at most top_k rows for each query
        return shown.select(*(c for c in picked.columns if c != "chunk_id"), F.explode(F.array("content")).alias("__content")).withColumn("snippet", snippet("__content")).drop("__content")
    finally:
        rows.unpersist()


ORDER = ("score", "lexical", "semantic", "relative_path", "start_line", "chunk_id")
RISING = (False, False, False, True, True, True)
PICKED = "query_id long, rank int, chunk_id string, relative_path string, start_line int, end_line int, score double, semantic double, lexical double"


def diversified(hits: DataFrame, k: int, first: int = 20_000) -> DataFrame:
    """hits(query_id, chunk_id, relative_path, start_line, end_line, three scores) re-ranked so that near twins and single files do not crowd out others.

    The choice is sequential, but rows far enough below the first k results cannot change them. So each query
    reads its best rows only; a query for which they do not settle the outcome reads eight times as many.
    """
    return _settled(hits.sparkSession, lambda most, ids: hits if ids is None else hits.where(F.col("query_id").isin(ids)), k, first)


def _settled(spark: SparkSession, hits_of, k: int, most: int) -> DataFrame:
    """hits_of(most, ids): hits that hold at least the first most rows of each query, of these ids (none: of all)."""
    order = [F.col(c) if up else F.desc(c) for c, up in zip(ORDER, RISING, strict=True)]
    out, open_ = [], None
    while True:
        rest = hits_of(most, open_).select(F.col("query_id").cast("long").alias("query_id"), *ORDER, "end_line")
        found = top(rest, most, *order).drop("rank").groupBy("query_id").applyInPandas(_picker(k, most), PICKED + ", settled boolean").collect()  # at most k rows for each query
        out += [tuple(r)[:-1] for r in found if r["settled"]]
        open_ = sorted({r["query_id"] for r in found if not r["settled"]})
        if not open_:
            return spark.createDataFrame(out, PICKED)
        most *= 8


def _picker(k: int, limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(ORDER), ascending=list(RISING), ignore_index=True)
        picked, settled = diverse_order(pdf, k)
        got = pdf.iloc[picked].copy()
        got["rank"] = range(1, len(got) + 1)
        got["settled"] = settled or len(pdf) < limit
        return got[[*(c.split(" ")[0] for c in PICKED.split(", ")), "settled"]]

    return run


def diverse_order(m: pd.DataFrame, k: int) -> tuple[list[int], bool]:
    """(positions of the first k results, whether rows below those of m could not change them). m is sorted by score."""
    path, score = m["relative_path"].tolist(), m["score"].tolist()
    start, end = m["start_line"].tolist(), m["end_line"].tolist()
    weight = [(e - s, lx, sm, -s) for s, e, lx, sm in zip(start, end, m["lexical"], m["semantic"], strict=True)]
    chosen: list[int] = []
    waiting: list[int] = []
    of_file: dict[str, list[int]] = {}  # chosen rows of each file, in order of choice

    # For each row the first later one of another file, and of each file its next rows: whether an unchosen file has a row near enough.
    later: dict[str, list[int]] = {}
    for j, p in enumerate(path):
        later.setdefault(p, []).append(j)
    unchosen = sorted((rows[0], p) for p, rows in later.items())
    at_file = dict.fromkeys(later, 0)

    def other_file_near(i: int) -> bool:
        """Whether a row after i, at most FILE_GAP below it, is of a file with no row chosen. Files come by their first row after i."""
        while unchosen:
            first, p = unchosen[0]
            if p in of_file:
                heapq.heappop(unchosen)
                continue
            if first > i:
                return score[i] - score[first] <= FILE_GAP
            own = later[p]
            while at_file[p] < len(own) and own[at_file[p]] <= i:
                at_file[p] += 1
            heapq.heappop(unchosen)
            if at_file[p] < len(own):
                heapq.heappush(unchosen, (own[at_file[p]], p))
        return False

    def twin_of(i: int) -> int | None:
        for c in of_file.get(path[i], ()):
            if abs(score[c] - score[i]) <= CLOSE and max(0, max(start[c], start[i]) - min(end[c], end[i])) <= NEAR_LINES:
                return c
        return None

    for i in range(len(path)):
        if len(chosen) > k and score[i] < min(score[c] for c in chosen[:k]) - FILE_GAP:
            return chosen[:k], True
        twin = twin_of(i)
        if twin is not None:
            if weight[i] > weight[twin]:
                own = of_file[path[i]]
                own[own.index(twin)] = i
                chosen[chosen.index(twin)] = i
                waiting.append(twin)
            else:
                waiting.append(i)
            continue
        if path[i] in of_file and other_file_near(i):
            waiting.append(i)
            continue
        last = chosen[-1] if chosen else None
        before = last is not None and path[last] != path[i] and score[last] - score[i] <= FILE_GAP and weight[i] > weight[last]
        chosen.insert(len(chosen) - before, i)
        of_file.setdefault(path[i], []).append(i)
    return (chosen + waiting)[:k] if len(chosen) < k else chosen[:k], False


def search_identifiers(docs: DataFrame, embeddings: DataFrame, queries: DataFrame, options: S.SearchOptions | None = None) -> DataFrame:
    """(query_id, rank, relative_path, kind, name, signature, line_start, line_end, score, semantic, lexical) of each query's symbols."""
    o = options or S.SearchOptions()
    corpus = docs.join(embeddings.select("embedding_id", "vector"), "embedding_id")
    hits = scored(corpus, queries, IDENTIFIER_FIELDS, IDENTIFIER_WEIGHTS, o)
    boosted = promoted(hits.withColumn("name", F.col("symbol_name")).withColumn("signature", F.col("signature_text")).withColumn("line_start", F.col("start_line")))
    best = top(boosted, o.top_k, F.desc("score"), F.desc("lexical"), F.desc("semantic"), "relative_path", "line_start", "name")
    return best.select(
        "query_id", "rank", "relative_path", S.inferred_kind(F.col("signature")).alias("kind"), "name", "signature", "line_start", F.col("end_line").alias("line_end"), "score", "semantic", "lexical"
    )


def promoted(hits: DataFrame) -> DataFrame:
    """hits(query, name, signature, header_text, score) with the boosts for names added to score (which may pass 1)."""
    boost = S.name_boost(F.col("query"), F.col("name"), F.col("signature"), F.col("header_text"))
    return hits.withColumn("score", F.round(F.col("score") + boost, S.DIGITS))


def _asked(rows: DataFrame, queries: DataFrame) -> dict[str, DataFrame]:
    """For each of name, signature and header_text the pairs (query, value) of different texts that gain by it, found by joins on terms where there are any."""
    q = queries.select("query").distinct().withColumns({"__q": terms("query"), "__p": F.lower(strip("query"))}).where("size(__q) > 0 or __p != ''")
    names = rows.select("name").distinct().withColumn("__n", terms("name"))
    same = q.where("size(__q) > 0").withColumn("__s", F.array_join("__q", "")).join(names.withColumn("__s", F.array_join("__n", "")), "__s").select("query", "name")
    # A wider name holds all of a query's terms: it is met by the one that the fewest names hold.
    held = names.where("size(__n) > 2").select("name", "__n", F.explode("__n").alias("__t"))
    spread = held.groupBy("__t").agg(F.count("*").alias("__c"))
    least = q.where("size(__q) > 1").select("query", "__q", F.explode("__q").alias("__t")).join(spread, "__t").groupBy("query").agg(F.min_by(F.struct("__t", "__q"), F.struct("__c", "__t")).alias("__a")).select("query", "__a.*")
    wider = least.join(held, "__t").where("size(__n) > size(__q) and size(array_except(__q, __n)) = 0").select("query", "name")
    inside = lambda c: q.where("__p != ''").join(rows.select(c).distinct(), F.lower(c).contains(F.col("__p"))).select("query", c)
    return {"name": same.unionByName(wider).distinct(), "signature": inside("signature"), "header_text": inside("header_text")}


def promoted_top(rows: DataFrame, queries: DataFrame, k: int, *tie: str) -> DataFrame:
    """top(promoted(paired(rows, queries)), k, score falling, *tie), for scores that do not depend on the query, without those pairs.

    rows(name, signature, header_text, score of at most DIGITS digits, *tie), queries(query_id, query). A row gains for its name,
    its signature and its header. Rows that agree in all by which a row gains gain no less, so a row among a query's first k is
    also among the first k, by score before the gains, of those rows. Only these are paired, with queries that name those values.
    """
    order = [F.desc("score"), *tie]
    parts = {"name": S.name_gain(F.col("query"), F.col("name")), "signature": S.phrase_gain(F.col("query"), F.col("signature"), S.IN_SIGNATURE), "header_text": S.phrase_gain(F.col("query"), F.col("header_text"), S.IN_HEADER)}
    asked, texts, hits = _asked(rows, queries), queries.select("query").distinct(), []
    for own in (c for n in range(len(parts) + 1) for c in combinations(parts, n)):
        if own:
            first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("rank") <= k).drop("rank")
            pairs = first.join(asked[own[0]], own[0])
            for c in own[1:]:
                pairs = pairs.join(asked[c], ["query", c])
        else:
            pairs = texts.crossJoin(F.broadcast(rows.orderBy(*order).limit(k)))
        # Each pair counts once: where it gains by just these.
        hits.append(pairs.where(reduce(lambda a, b: a & b, [(g > 0) == (c in own) for c, g in parts.items()])).select("query", *rows.columns))
    w = Window.partitionBy("query").orderBy(*order)
    best = promoted(reduce(DataFrame.unionByName, hits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumnRenamed("query", "__query").join(queries.select("query_id", "query"), F.col("__query").eqNullSafe(F.col("query"))).drop("__query")


def in_scope(path, target: str):
    """Whether a path is the target or lies under it; an empty target or '.' is everything."""
    t = target.strip().strip("/")
    if t in ("", "."):
        return F.lit(True)
    return (path == t) | path.startswith(t + "/")


__all__ = ["diversified", "in_scope", "promoted", "promoted_top", "scored", "search_code", "search_identifiers", "terms", "top"]
