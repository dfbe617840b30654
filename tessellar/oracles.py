"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from tessellar.functions import intent as I


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_lit(w) for w in words) + "]"


def tokens(x: str) -> str:
    cut = r"regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda w: CASE WHEN regexp_matches(w, '[A-Za-z0-9]') THEN list_transform({cut}, lambda p: lower(p)) ELSE [lower(w)] END))"


def distinct(x: str) -> str:
    """Different elements in order of first appearance."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def lines(x: str) -> str:
    every = f"string_split(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    return f"CASE WHEN {every}[-1] = '' THEN {every}[:-2] ELSE {every} END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def coverage(q: str, d: str) -> str:
    return f"(CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_filter(list_distinct({q}), lambda t: list_contains({d}, t)))::DOUBLE / len(list_distinct({q})) END)"


def field(query: str, q: str, d: str, text: str) -> str:
    return f"(CASE WHEN {text} = '' THEN 0.0 ELSE least(1.0, greatest(0.0, 0.85 * {coverage(q, d)} + CASE WHEN {query} <> '' AND contains(lower({text}), lower({query})) THEN 0.15 ELSE 0.0 END)) END)"


def fielded(query: str, q: str, fields: dict[str, tuple[str, str]], weights: dict[str, float]) -> str:
    """fields: text and terms of each field that is not constantly empty."""
    used = [(fields[n], w) for n, w in weights.items() if n in fields]
    top = " + ".join(f"CASE WHEN {t} <> '' THEN {w} * {field(query, q, d, t)} ELSE 0 END" for (t, d), w in used)
    low = " + ".join(f"CASE WHEN {t} <> '' THEN {w} ELSE 0 END" for (t, _), w in used)
    return f"(CASE WHEN len({q}) = 0 OR ({low}) <= 0 THEN 0.0 ELSE ({top}) / ({low}) END)"


def sql(texts, intents, signatures, code_weights, identifier_weights, declarations) -> dict[str, str]:
    values = ", ".join(f"({i}::BIGINT, {_lit(t)})" for i, t in enumerate(texts))
    q = f"q AS (SELECT query_id, query, {tokens('query')} AS terms FROM (VALUES {values}) v(query_id, query))"
    docs = f"d AS (SELECT doc_id, source, lang, text, {tokens('text')} AS tt, {tokens('source')} AS ts, {tokens('lang')} AS tl FROM documents)"
    own = {"path": ("source", "ts"), "header": ("lang", "tl"), "body": ("text", "tt")}
    vec = "list_transform(embedding, lambda x: x::DOUBLE)"
    cos = lambda a, b: f"(CASE WHEN sqrt(list_dot_product({a}, {a})) = 0 OR sqrt(list_dot_product({b}, {b})) = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)"
    concept = fielded("query", "terms", {"path": own["path"], "body": own["body"]}, code_weights[I.CONCEPT])
    asking = f"q AS (SELECT query_id, query, {tokens('query')} AS terms FROM (SELECT vec_id AS query_id, ({_list(texts)})[(vec_id // 100) % {len(texts)} + 1] AS query FROM embeddings WHERE vec_id % 100 = 0))"
    hybrid = f"""WITH {asking}, {docs}, e AS (SELECT vec_id, {vec} AS v FROM embeddings),
      s AS (SELECT query_id, doc_id, source, {cos("e.v", "f.v")} AS sem, {concept} AS lex
            FROM d JOIN e ON doc_id = e.vec_id CROSS JOIN q JOIN e f ON f.vec_id = query_id),
      c AS (SELECT *, least(1.0, greatest(0.0, (0.72 * greatest(sem, 0.0) + 0.28 * lex) / (0.72 + 0.28))) AS com FROM s)"""
    chunk_step = lambda key, source, budget: f"""WITH RECURSIVE l AS (  -- lines, and which run of non-blank lines each is in
        SELECT {key} AS k, i AS n, x, {strip('x')} = '' AS blank FROM (SELECT {key}, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT {key}, {lines('text')} AS ls FROM {source}))),
      g AS (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS run FROM l WHERE NOT blank),
      o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM g),
      a AS (SELECT k, r, run, n AS s, n AS e, x AS cur, 0 AS piece FROM o WHERE r = 1
            UNION ALL
            SELECT o.k, o.r, o.run,
              CASE WHEN o.run <> a.run OR length({strip("a.cur || chr(10) || o.x")}) > {budget} THEN o.n ELSE a.s END, o.n,
              CASE WHEN o.run <> a.run OR length({strip("a.cur || chr(10) || o.x")}) > {budget} THEN o.x ELSE a.cur || chr(10) || o.x END,
              CASE WHEN o.run <> a.run OR length({strip("a.cur || chr(10) || o.x")}) > {budget} THEN a.piece + 1 ELSE a.piece END
            FROM a JOIN o ON o.k = a.k AND o.r = a.r + 1),
      p AS (SELECT k, piece, min(s) AS s, max(e) AS e, {strip("arg_max(cur, r)")} AS c FROM a GROUP BY k, piece),
      b AS (SELECT k, piece, s, e, c, 0 AS ordinal FROM p WHERE piece = 0
            UNION ALL
            SELECT p.k, p.piece,
              CASE WHEN length(b.c || chr(10) || chr(10) || p.c) > {budget} THEN p.s ELSE b.s END, p.e,
              CASE WHEN length(b.c || chr(10) || chr(10) || p.c) > {budget} THEN p.c ELSE b.c || chr(10) || chr(10) || p.c END,
              CASE WHEN length(b.c || chr(10) || chr(10) || p.c) > {budget} THEN b.ordinal + 1 ELSE b.ordinal END
            FROM b JOIN p ON p.k = b.k AND p.piece = b.piece + 1),
      f AS (SELECT k, ordinal, min(s) AS s, max(e) AS e, arg_max(c, piece) AS c FROM b GROUP BY k, ordinal),
      z AS (SELECT * FROM f UNION ALL
            SELECT {key}, 0, 1, greatest(1, len({lines('text')})), {strip(f"array_to_string({lines('text')}, chr(10))")} FROM {source} WHERE {key} NOT IN (SELECT k FROM f))"""  # noqa: E731
    talk = "(SELECT conv_id, string_agg(text || chr(10), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
    marked = "(SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
    symbol_chunks = f"""WITH l AS (SELECT doc_id, source, lang, {lines('text')} AS ls FROM documents), m AS (SELECT *, len(ls) AS n FROM l),
      r AS (SELECT *, unnest(range(0, (n - 1) // 50 + 1)) AS b FROM m WHERE n > 0),
      x AS (SELECT *, 2 * b AS ordinal, 'class' AS kind, b * 50 + 1 AS a, least(n, b * 50 + 50) AS e FROM r UNION ALL SELECT *, 2 * b + 1, 'function', least(n, b * 50 + 2), least(n, b * 50 + 6) FROM r),
      z AS (SELECT doc_id, source, lang, n, b, ordinal, kind, a, e, {strip("array_to_string(ls[a:e], chr(10))")} AS c FROM x UNION ALL SELECT doc_id, source, lang, n, 0, 0, 'text', 1, 1, '' FROM m WHERE n = 0)"""
    height = {x: b.count("\n") for x, _, _, b in declarations}
    text = lambda x, a, b: f"('{x}', {_lit(a)}, {_lit(b)})".replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    files = f"""p AS (SELECT p_brand, 'N' || p_partkey AS name, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
      d(ext, lead, rest) AS (VALUES {', '.join(text(x, a, b) for x, _, a, b in declarations)}),
      f AS (SELECT translate(p_brand, '# ', '__') || '/all' || ext AS path, ext, p_brand, CASE WHEN ext = '.py' THEN '# ' ELSE '// ' END || p_brand || chr(10) || string_agg(lead || name || rest, '' ORDER BY k) AS content FROM p CROSS JOIN d GROUP BY p_brand, ext)"""
    shown = {".py": "def {}(x):", ".ts": "function {}(x: string) {{", ".js": "class {} {{", ".go": "{} struct {{", ".rs": "pub trait {} {{", ".kt": "fun {}(x: Int): Int {{"}
    signature = "CASE ext " + " ".join(f"WHEN '{x}' THEN {_lit(v.split('{}')[0])} || name || {_lit(v.split('{}')[1].replace('{{', '{'))}" for x, v in shown.items()) + " END"
    languages = {".py": "python", ".ts": "typescript", ".js": "javascript", ".go": "go", ".rs": "rust", ".kt": "kotlin"}
    of = lambda table: "CASE ext " + " ".join(f"WHEN '{x}' THEN {v!r}" for x, v in table.items()) + " END"
    last = {x: h - 1 for x, h in height.items()}
    parts = {"path": ("p_type", "tp"), "header": ("p_brand", "th"), "symbol_name": ("p_name", "tn"), "signature": ("sig", "tg"), "context": ("ctx", "tc")}
    found = fielded("query", "terms", parts, identifier_weights[I.CONCEPT])
    squeeze = f"array_to_string({distinct(tokens('p_name'))}, '')"
    words = lambda ws: f"len(list_filter(t, lambda x: list_contains({_list(ws)}, x))) > 0"
    asked = ", ".join(f"({i - 100}::BIGINT, {_lit(t)})" for i, t in enumerate(intents))
    path = "(SELECT regexp_replace(url, '^[a-z]+://', '') AS relative_path FROM pages)"
    kinds = ", ".join(f"({_lit(s)})" for s in signatures)
    boost = f"""(CASE WHEN len(qt) > 0 AND array_to_string(qt, '') = array_to_string(nt, '') THEN 0.12
        WHEN len(qt) >= 2 AND len(nt) > len(qt) AND len(list_filter(qt, lambda x: NOT list_contains(nt, x))) = 0 THEN 0.04 ELSE 0.0 END
        + CASE WHEN contains(lower(p.p_type), lower({strip('q.p_name')})) THEN 0.03 ELSE 0.0 END + CASE WHEN contains(lower(p.p_brand), lower({strip('q.p_name')})) THEN 0.02 ELSE 0.0 END)"""
    return {
        "tokenize_counts": f"SELECT doc_id, len({tokens('text')})::BIGINT AS n_tokens, len(list_distinct({tokens('text')}))::BIGINT AS n_terms FROM documents",
        "term_frequency_topk": f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 50",
        "squeezed_names": f"SELECT p_partkey, {squeeze} AS squeezed FROM part",
        "header_lines": f"""SELECT conv_id, turn, regexp_replace({strip("'#  ' || role")}, '^[# ]+', '') || ' | ' || regexp_replace({strip(f"'// ' || ({lines('text')})[1]")}, '^[/ ]+', '') AS header FROM conversations""",
        "line_explode": f"SELECT doc_id, i::INTEGER AS line_number, {strip('x')} AS line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, {lines('text')} AS ls FROM documents))",
        "content_ids": "SELECT doc_id, sha256(source || '::' || lang || '::' || text) AS content_id FROM documents",
        "snippet_preview": rf"""WITH s AS (SELECT doc_id, array_to_string(list_filter(list_transform({lines('text')}, lambda x: {strip('x')}), lambda x: x <> ''), ' ') AS f FROM documents)
            SELECT doc_id, CASE WHEN length(f) > 240 THEN regexp_replace(f[1:237], '\s+$', '') || '...' ELSE f END AS snippet FROM s""",
        "join_text_parts": "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_mktsegment <> '' THEN c_name || chr(10) || c_mktsegment ELSE c_name END AS joined FROM customer",
        "token_budget": r"SELECT source, sum(greatest(1, len(regexp_extract_all(text, '\S+'))))::BIGINT AS tokens, CASE WHEN sum(greatest(1, len(regexp_extract_all(text, '\S+')))) <= 20000 THEN 'full' ELSE 'reduced' END AS mode FROM documents GROUP BY source",
        "namespace_slugs": "SELECT p_partkey, replace(replace(replace(p_brand || '/' || p_type, '/', '_'), ':', '_'), ' ', '_') AS namespace FROM part",
        "greedy_line_chunks": chunk_step("doc_id", "documents", 600) + " SELECT k AS doc_id, ordinal::INTEGER AS ordinal, s::INTEGER AS start_line, e::INTEGER AS end_line, length(c)::INTEGER AS n_chars, md5(c) AS digest FROM z",
        "paragraph_chunks": chunk_step("conv_id", talk, 400) + " SELECT k AS conv_id, ordinal::INTEGER AS ordinal, s::INTEGER AS start_line, e::INTEGER AS end_line, length(c)::INTEGER AS n_chars FROM z",
        "markdown_sections": rf"""WITH l AS (SELECT conv_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS x, len(ls) AS m FROM (SELECT conv_id, {lines('text')} AS ls FROM {marked})),
            h AS (SELECT conv_id, n, m FROM l WHERE regexp_matches({strip('x')}, '^(#{{1,6}})\s+\S'))
            SELECT conv_id, n::INTEGER AS start_line, coalesce(lead(n) OVER (PARTITION BY conv_id ORDER BY n) - 1, m)::INTEGER AS end_line FROM h""",
        "symbol_chunks": symbol_chunks + " SELECT doc_id, ordinal::INTEGER AS ordinal, kind, a::INTEGER AS start_line, e::INTEGER AS end_line, length(c)::INTEGER AS n_chars, md5(c) AS digest FROM z",
        "chunk_fields": symbol_chunks + """, y AS (SELECT source || '/' || doc_id AS p, lang, kind, a, e, ordinal, c, CASE WHEN n = 0 THEN '' WHEN kind = 'function' AND n > b * 50 + 1 THEN 'def open' || b || chr(10) || 'open' || b ELSE 'class Box' || b || chr(10) || 'Box' || b END AS local,
              CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform(range(0, (n - 1) // 50 + 1), lambda k: 'class Box' || k || chr(10) || 'Box' || k || chr(10) || 'def open' || k || chr(10) || 'open' || k), chr(10)) END AS every FROM z)
            SELECT p AS relative_path, sha256(p || '::' || kind || '::' || a || '::' || e || '::' || ordinal) AS chunk_id,
              sha256('ollama::m::' || array_to_string(list_filter([lang, every, local, c, p], lambda x: x <> ''), chr(10))) AS embedding_id, local AS local_symbol_text FROM y""",
        "cosine_topk": f"""WITH e AS (SELECT vec_id, {vec} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round({cos("e.v", "q.v")}, 6) AS similarity FROM e CROSS JOIN e q WHERE q.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10""",
        "vectors_join": f"SELECT doc_id, len(embedding)::BIGINT AS dims, round(sqrt(list_dot_product({vec}, {vec})), 6) AS norm FROM documents JOIN embeddings ON doc_id = vec_id",
        "fielded_keyword_score": f"WITH {q}, {docs} SELECT doc_id, query_id, " + ", ".join(f"round({fielded('query', 'terms', own, w)}, 6) AS {n}" for n, w in code_weights.items()) + " FROM d CROSS JOIN q",
        "whole_document_score": f"WITH {q}, {docs} SELECT doc_id, query_id, round(least(1.0, greatest(0.0, 0.65 * {coverage('terms', 'tt')} + 0.2 * {coverage('terms', 'ts')} + CASE WHEN contains(lower(text), lower(query)) THEN 0.15 ELSE 0.0 END)), 6) AS score FROM d CROSS JOIN q",
        "hybrid_search": hybrid + """, r AS (SELECT query_id, doc_id, source, round(com, 4) AS score, round(sem, 4) AS semantic, round(lex, 4) AS lexical FROM c WHERE com >= 0.1),
            t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical DESC, semantic DESC, source, doc_id)::INTEGER AS rank FROM r) SELECT query_id, rank, doc_id, score, semantic, lexical FROM t WHERE rank <= 10""",
        "score_thresholds": hybrid + " SELECT query_id, count(*) AS n FROM c WHERE lex > 0 AND greatest(sem, 0.0) >= 0.05 AND lex >= 0.2 AND com >= 0.25 GROUP BY query_id",
        "intent_classify": rf"""WITH a AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES {asked}) v(query_id, query)), b AS (SELECT query_id, {strip('query')} AS s, {tokens('query')} AS t FROM a)
            SELECT query_id, CASE WHEN {words(I.WORKFLOW_WORDS)} THEN '{I.WORKFLOW}'
              WHEN len(t) > 0 AND (contains(s, '_') OR regexp_matches(s, '[a-z][A-Z]|[A-Z]{{2,}}[a-z]') OR (len(t) <= 4 AND list_contains({_list(I.LEADING_VERBS)}, t[1]))) THEN '{I.SYMBOL}'
              WHEN {words(I.IMPLEMENTATION_WORDS)} THEN '{I.IMPLEMENTATION}' ELSE '{I.CONCEPT}' END AS intent FROM b""",
        "identifier_promotion": f"""WITH n AS (SELECT *, {distinct(tokens('p_name'))} AS nt FROM part), s AS (SELECT q.p_partkey AS query_id, p.p_partkey, q.nt AS qt, p.nt AS nt, p.p_size / 100 AS score, {boost.replace('qt', 'q.nt').replace('(nt', '(p.nt').replace('(nt,', '(p.nt,')} AS boost FROM n p CROSS JOIN n q WHERE q.p_partkey % 100 = 0),
            r AS (SELECT query_id, p_partkey, round(score + boost, 4) AS score FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey)::INTEGER AS rank FROM r) SELECT query_id, rank, p_partkey, score FROM t WHERE rank <= 10""",
        "kind_inference": f"""WITH s AS (SELECT DISTINCT signature FROM (SELECT * FROM (VALUES {kinds}) v(signature) UNION ALL SELECT ['class ', 'type ', 'let ', 'x function ', ''][(p_partkey % 5 + 1)::INTEGER] || p_name FROM part)), l AS (SELECT signature, lower(signature) AS s, ' ' || lower(signature) || ' ' AS p FROM s)
            SELECT signature, CASE WHEN starts_with(s, 'class ') OR contains(s, ' class ') THEN 'class' WHEN contains(p, ' interface ') THEN 'interface' WHEN contains(p, ' enum ') THEN 'enum' WHEN starts_with(s, 'type ') OR contains(p, ' type ') THEN 'type'
              WHEN starts_with(s, 'async def ') OR starts_with(s, 'def ') THEN 'function' WHEN contains(p, ' function ') THEN 'function' WHEN contains(s, 'const ') OR contains(s, 'let ') OR contains(s, 'var ') THEN 'variable' ELSE 'identifier' END AS kind FROM l""",
        "refresh_plan": """WITH n AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0), o AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)
            SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS action FROM n FULL OUTER JOIN o ON n.c_custkey = o.c_custkey
            WHERE n.c_custkey IS NULL OR o.c_custkey IS NULL OR n.c_acctbal IS DISTINCT FROM o.c_acctbal OR n.c_mktsegment IS DISTINCT FROM o.c_mktsegment""",
        "manifest_upsert": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
        "replace_file_rows": "SELECT l_linenumber, count(*) AS n, sum(quantity) AS quantity FROM (SELECT l_linenumber, l_quantity AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) UNION ALL SELECT l_linenumber, 0.0 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1) GROUP BY l_linenumber",
        "orphan_embeddings": "SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) AND vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)",
        "reference_counts": "SELECT doc_id, count(*) AS refs FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id",
        "embedding_cache_misses": "SELECT DISTINCT sha256(text) AS text_sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)",
        "status_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("documents", "embeddings", "labels", "pages", "conversations")),
        "metadata_rows": "SELECT p_partkey, p_partkey % 4 = 0 AS rebuild FROM part",
        "symbol_usages": rf"""SELECT doc_id::VARCHAR AS relative_path, i::INTEGER AS line_number, {strip('x')} AS line_text FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, {lines('text')} AS ls FROM documents))
            WHERE doc_id <> 5 AND regexp_matches(x, '(^|[^\pL\pN_$])worthless($|[^\pL\pN_$])')""",
        "directory_tree": f"SELECT DISTINCT array_to_string(parts[1:n], '/') AS directory FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(relative_path, '/') AS parts FROM {path}))",
        "files_by_directory": f"SELECT directory, count(*) AS n, string_agg(relative_path, ',' ORDER BY relative_path) AS paths FROM (SELECT CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '.' END AS directory, relative_path FROM {path}) GROUP BY directory",
        "language_symbols": f"""WITH {files}, s AS (SELECT translate(p_brand, '# ', '__') || '/all' || ext AS relative_path, ext, {of({x: k for x, k, _, _ in declarations})} AS kind, 2 + (i - 1) * {of(height)} AS a, 2 + (i - 1) * {of(height)} + {of(last)} AS e, {signature} AS sig FROM p CROSS JOIN d)
            SELECT relative_path, {of(languages)} AS language, 1 AS n_headers, kind, count(*) AS n, sum(a)::BIGINT AS starts, sum(e)::BIGINT AS ends, min(sig) AS first_signature FROM s GROUP BY ALL""",
        "file_manifest": f"WITH {files} SELECT path AS relative_path, octet_length(encode(content)) AS size_bytes, sha256(content) AS content_hash FROM f",
        "identifier_fields": f"""WITH {files}, s AS (SELECT translate(p_brand, '# ', '__') || '/all.py' AS path, p_brand AS header, name, 'def ' || name || '(x):' AS sig, (2 * i)::INTEGER AS a, (2 * i + 1)::INTEGER AS e, i - 1 AS ordinal FROM p),
            c AS (SELECT *, array_to_string([header, name, sig, path], chr(10)) AS ctx FROM s)
            SELECT path AS relative_path, name AS symbol_name, a AS start_line, e AS end_line, sig AS content, ctx AS context_text, sha256(path || '::' || name || '::' || a || '::' || e || '::' || ordinal) AS doc_id,
              sha256('ollama::m::' || array_to_string([header, name, sig, path, ctx], chr(10))) AS embedding_id FROM c""",
        "index_chunks": chunk_step("conv_id", f"(SELECT * FROM {marked} WHERE conv_id % 2 = 0)", 600) + f""", mt AS (SELECT conv_id, {lines('text')} AS ls FROM {marked}), ml AS (SELECT conv_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS x, len(ls) AS m FROM mt),
            mh AS (SELECT conv_id, n, m FROM ml WHERE regexp_matches({strip('x')}, '^(#{{1,6}})\\s+\\S')), mr AS (SELECT conv_id, n AS s, coalesce(lead(n) OVER (PARTITION BY conv_id ORDER BY n) - 1, m) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS ordinal FROM mh)
            SELECT conv_id, '.md' AS ext, ordinal::INTEGER AS ordinal, 'markdown' AS kind, s::INTEGER AS start_line, e::INTEGER AS end_line, length({strip("array_to_string(ls[s:e], chr(10))")})::INTEGER AS n_chars FROM mr JOIN mt USING (conv_id)
            UNION ALL SELECT k, '.txt', ordinal::INTEGER, 'text', s::INTEGER, e::INTEGER, length(c)::INTEGER FROM z""",
        "ignored_paths": rf"""SELECT relative_path, CASE WHEN regexp_matches(relative_path, '(^|/)m[.][^/]*/') OR regexp_matches(relative_path, '(^|/)[^/]*17(/|$)') THEN false
              ELSE regexp_matches(relative_path, '(^|/)en/1|^www[.][^/]*/de(/|$)|(^|/)[^/]*7(/|$)|(^|/)blog[.][^/]*/') END AS ignored FROM {path}""",
        "usages_outside_definitions": rf"""SELECT doc_id::VARCHAR AS relative_path, count(*) AS n, min(i)::INTEGER AS first_line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (SELECT doc_id, {lines('text')} AS ls FROM documents))
            WHERE i > 1 AND regexp_matches(x, '(^|[^\pL\pN_$])the($|[^\pL\pN_$])') GROUP BY doc_id""",
        "identifier_search": f"""WITH {asking}, e AS (SELECT vec_id, {vec} AS v FROM embeddings),
            d AS (SELECT p_partkey, p_name, p_type, p_brand, 'def ' || p_name AS sig, p_brand || ' ' || p_name AS ctx, {tokens('p_type')} AS tp, {tokens('p_brand')} AS th, {tokens('p_name')} AS tn, {tokens("'def ' || p_name")} AS tg, {tokens("p_brand || ' ' || p_name")} AS tc FROM part),
            s AS (SELECT d.*, q.*, {cos("e.v", "g.v")} AS sem, {found} AS lex FROM d JOIN e ON p_partkey = e.vec_id CROSS JOIN q JOIN e g ON g.vec_id = query_id),
            c AS (SELECT *, least(1.0, greatest(0.0, (0.72 * greatest(sem, 0.0) + 0.28 * lex) / (0.72 + 0.28))) AS com FROM s),
            b AS (SELECT *, {distinct('terms')} AS qt, {distinct('tn')} AS nt FROM c WHERE com >= 0.1),
            o AS (SELECT *, round(round(com, 4) + CASE WHEN len(qt) > 0 AND array_to_string(qt, '') = array_to_string(nt, '') THEN 0.12 WHEN len(qt) >= 2 AND len(nt) > len(qt) AND len(list_filter(qt, lambda x: NOT list_contains(nt, x))) = 0 THEN 0.04 ELSE 0.0 END
              + CASE WHEN contains(lower(sig), lower({strip('query')})) THEN 0.03 ELSE 0.0 END + CASE WHEN contains(lower(p_brand), lower({strip('query')})) THEN 0.02 ELSE 0.0 END, 4) AS score FROM b),
            t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(lex, 4) DESC, round(sem, 4) DESC, p_type, p_partkey)::INTEGER AS rank FROM o)
            SELECT query_id, rank, p_type AS relative_path, 'function' AS kind, p_name AS name, sig AS signature, p_partkey::INTEGER AS line_start, p_partkey::INTEGER AS line_end, score, round(sem, 4) AS semantic, round(lex, 4) AS lexical FROM t WHERE rank <= 5""",
        "path_scope": f"SELECT relative_path, true AS everything, relative_path = 'site1.example.com' OR starts_with(relative_path, 'site1.example.com/') AS one_host FROM {path}",
    }
