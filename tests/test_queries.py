"""Registered queries against their SQL, on the driver's small tables, and single expressions against plain Python."""

import glob
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellar import catalog
from tessellar.functions import scoring as S
from tessellar.functions import text as X
from tessellar.functions.intent import intent
from tessellar.operators import changes, chunking, search
from tessellar.operators.embedding import embedded, hashing_embedder, numbers
from tessellar.plans.store import Files, Pointer
from tessellar.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else round(float(v), 9) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    texts = ["buildIndex metadata", "HTTPServer2Go", "___ a_b", "", "ABc XYZ", "x" * 50]
    plain = lambda t: [p.lower() for w in re.findall(r"[A-Za-z0-9_]+", t) for p in (re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", w) or [w])]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens("t").alias("k")).collect()
    assert all(g["k"] == plain(g["t"]) for g in got)


def test_lines_follow_the_line_model(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", chr(0x2028), "é"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.lines("t").alias("l")).collect()
    assert all(g["l"] == texts[g["i"]].splitlines() for g in got)


def test_snippet_and_headers(spark):
    long = "word " * 80
    assert one(spark, X.snippet("t"), t=long) == long[:237].rstrip() + "..." and one(spark, X.snippet("t"), t=" a \n\n b ") == "a b"
    assert one(spark, X.header_lines("t"), t="#!x\n  // y\n# no") == ["!x", "y"]


def test_scores(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, S.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, S.cosine(v(0, 0), v(1, 1))) == 0.0
    with pytest.raises(Exception, match="different lengths"):
        one(spark, S.cosine(v(1), v(1, 1)))
    assert one(spark, S.combined(F.lit(0.5), F.lit(0.75))) == pytest.approx(0.57)
    o = S.SearchOptions(top_k=0, min_semantic=25, min_combined=float("nan"), keyword_weight=-1)
    assert (o.top_k, o.min_semantic, o.min_combined, o.keyword_weight) == (1, 0.25, 0.1, 0.28)
    boost = lambda q, n, s="", h="": one(spark, F.round(S.name_boost(F.lit(q), F.lit(n), F.lit(s), F.lit(h)), 4))
    assert boost("build index", "buildIndex") == 0.12 and boost("build index", "buildIndexNow") == 0.04
    assert boost("build index", "other", "x Build Index", "build index") == 0.05


def test_intents(spark):
    want = {"how refresh works": "workflow_lookup", "buildIndex": "symbol_lookup", "process_payment": "workflow_lookup", "find user": "symbol_lookup", "sqlite index": "implementation_lookup", "plain words": "concept_lookup", "": "concept_lookup"}
    got = spark.createDataFrame([(q,) for q in want], "q string").select("q", intent(F.col("q")).alias("i")).collect()
    assert {g["q"]: g["i"] for g in got} == want


def plain_chunks(text, budget):
    lines, pieces, run = text.splitlines(), [], []
    for n, x in [*enumerate(lines, 1), (len(lines) + 1, "")]:
        if x.strip() and run and len("\n".join([*(y for _, y in run), x]).strip()) > budget or not x.strip() and run:
            pieces.append((run[0][0], run[-1][0], "\n".join(y for _, y in run).strip()))
            run = []
        if x.strip():
            run.append((n, x))
    out = []
    for s, e, c in pieces:
        if out and len(out[-1][2] + "\n\n" + c) <= budget:
            out[-1] = (out[-1][0], e, out[-1][2] + "\n\n" + c)
        else:
            out.append((s, e, c))
    return out or [(1, max(1, len(lines)), "\n".join(lines).strip())]


def test_text_chunks(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["alpha ", "b", "\n", "\n\n", " \n", "gamma gamma"]) for _ in range(r.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.text_chunks(X.lines("t"), 30).alias("c"))
    for g in df.collect():
        assert [(c["start"], c["end"], c["content"]) for c in g["c"]] == plain_chunks(texts[g["i"]], 30)


def test_markdown_sections(spark):
    text = "lead\n\n# A\nx\n## B\n```\n# C\n```"
    got = one(spark, chunking.markdown_sections(X.lines("t")), t=text)
    assert [(s["start"], s["end"]) for s in got] == [(1, 2), (3, 4), (5, 6), (7, 8)]
    assert one(spark, chunking.markdown_sections(X.lines("t")), t="no heading") == []


def test_refresh_plan_and_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "p string, h int")
    new = spark.createDataFrame([("a", 1), ("c", 3), ("d", 4)], "p string, h int")
    assert {tuple(r) for r in changes.refresh_plan(new, old, "p", ["h"]).collect()} == {("b", "removed"), ("c", "changed"), ("d", "changed")}
    assert {tuple(r) for r in changes.upserted(old, new, "p").collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4)}


def test_embeddings_are_fetched_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, text string")
    cache = spark.createDataFrame([], "text_sha string, vector array<double>")
    rows, new = embedded(texts, cache, hashing_embedder)
    assert new.count() == 2 and rows.count() == 3
    assert embedded(texts, new, hashing_embedder)[1].count() == 0
    assert numbers([1, "2.5"]) == [1.0, 2.5]
    with pytest.raises(ValueError):
        numbers([[1]])


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERIES", 2)
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    queries = spark.createDataFrame([(i, "q", [1.0, 1.0]) for i in range(5)], "query_id long, query string, vector array<double>")
    assert search.against(corpus, queries).count() == 10


def test_code_search_in_blocks_equals_all_pairs(spark):
    """The same rows as scoring every pair as columns gives, though each query first reads few rows; vectors may be null or zero."""
    r = random.Random(23)
    words = lambda n: " ".join(r.choice(("index", "build", "row", "user", "find", "x")) for _ in range(r.randint(0, n)))
    vector = lambda: r.choice((None, [0.0] * 4, *([round(r.gauss(0, 1), 1) for _ in range(4)] for _ in range(12))))
    kinds = ("header_text", "file_symbol_text", "local_symbol_text")
    data = [(f"c{i}", r.choice("abcdef"), 3 * i % 40, 3 * i % 40 + 2, words(8), words(2), words(2), f"e{i}", vector(), "", words(2), "") for i in range(900)]
    chunks = spark.createDataFrame(data, "chunk_id string, relative_path string, start_line int, end_line int, content string, path_text string, body_text string, embedding_id string, vector array<double>, " + ", ".join(f"{k} string" for k in kinds))
    queries = spark.createDataFrame([(i, words(3), vector()) for i in range(25)], "query_id long, query string, vector array<double>")
    shown = ["query_id", "rank", "relative_path", "start_line", "end_line", "score", "semantic", "lexical"]
    for o in (S.SearchOptions(), S.SearchOptions(require_semantic=True, min_keyword=0.1), S.SearchOptions(top_k=9, min_combined=0.0, require_keyword=True)):
        hits = search.scored(chunks, queries, search.CODE_FIELDS, search.CODE_WEIGHTS, o)
        want = search.diversified(hits, o.top_k).select(*shown).collect()
        got = search.search_code(chunks.drop("vector"), chunks.select("embedding_id", "vector"), queries, o, first=12).select(*shown).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 50


def test_promotion_pairs_only_what_counts(spark):
    """The same rows as all pairs give, without a join of all rows with all queries."""
    r = random.Random(17)
    word = lambda: r.choice(("red", "Bolt", "ring", "hot", "old", "a", "tin", "plate"))
    text = lambda n: r.choice((None, "", " ", *["".join((word().capitalize(), r.choice(("", "_", " "))) [0] + r.choice(("", "_", " ")) for _ in range(r.randint(1, n))) for _ in range(20)]))
    data = [(i, text(4), text(3), text(2), r.choice((None, *(x / 100 for x in range(40))))) for i in range(700)] + [(700 + i, "x y z", "s", "h", 0.9) for i in range(20)]
    rows = spark.createDataFrame(data, "id long, name string, signature string, header_text string, score double")
    queries = spark.createDataFrame([(i, text(3)) for i in range(60)] + [(90, "x y"), (91, "x y z"), (92, "z X"), (93, None)], "query_id long, query string")
    got = search.promoted_top(rows, queries, 7, "id").select("query_id", "rank", "id", "score")
    want = search.top(search.promoted(search.paired(rows, queries)), 7, F.desc("score"), "id").select("query_id", "rank", "id", "score")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() == 64 * 7


def test_stream_of_upserts(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "k string, v int, s string").write.parquet(str(src))
    run = lambda: ingest.upsert_stream(spark.readStream.schema("k string, v int, s string").parquet(str(src)), out, "k", "v", str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("b", 0, "late"), ("c", 5, "new")], "k string, v int, s string").write.mode("append").parquet(str(src))
    run()
    now = lambda: {tuple(r) for r in ingest.current(spark, out, "k", "v").collect()}
    assert now() == {("a", 2, "z"), ("b", 1, "y"), ("c", 5, "new")}
    # A batch whose commit was lost after the pointer moved runs again; nothing may change or go.
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    run()
    assert now() == {("a", 2, "z"), ("b", 1, "y"), ("c", 5, "new")}


def test_batches_survive_repeats_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "KEEP", 3)
    out, want = str(tmp_path / "out"), {}
    r = random.Random(3)
    assert ingest.current(spark, out, "k", "v") is None
    for n in range(9):
        rows = [(r.choice("abcdef"), r.randint(0, 50), f"{n}.{i}") for i in range(4)]
        batch = spark.createDataFrame(rows, "k string, v int, s string")
        before = ingest.current(spark, out, "k", "v")
        for _ in range(2 if n % 2 else 1):
            ingest.apply_batch(batch, n, out, "k", "v")
        for k, v, s in rows:
            want[k] = max(want.get(k, (v, k, s)), (v, k, s))
        assert {(x["v"], x["k"], x["s"]) for x in ingest.current(spark, out, "k", "v").collect()} == set(want.values())
        if before is not None:
            before.collect()  # a reader of the version before still finds its files
    # An attempt that died before the pointer moved leaves a folder that no one reads, and goes later.
    batch.write.parquet(f"{out}/delta-9-dead")
    ingest.apply_batch(batch, 9, out, "k", "v")
    assert "delta-9-dead" not in Files(spark).names(out) and len(Pointer(Files(spark), out).numbers()) == 2
