"""DuckDB SQL for those training-data queries that SQL can express, written from their definitions."""

from __future__ import annotations

import re

from tessellar.llm import licenses, mixing, pii, secrets

BACKOFF_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT r, i, c, lag(c, 1) OVER q AS b, lag(c, 2) OVER q AS a FROM t WINDOW q AS (PARTITION BY r ORDER BY i)),
u AS (SELECT c, count(*) AS n FROM p GROUP BY c), uo AS (SELECT r, c, count(*) AS n FROM p GROUP BY r, c),
v AS (SELECT b, c, count(*) AS n FROM p WHERE i > 1 GROUP BY b, c), vo AS (SELECT r, b, c, count(*) AS n FROM p WHERE i > 1 GROUP BY r, b, c),
x AS (SELECT a, b, c, count(*) AS n FROM p WHERE i > 2 GROUP BY a, b, c), xo AS (SELECT r, a, b, c, count(*) AS n FROM p WHERE i > 2 GROUP BY r, a, b, c),
k AS (SELECT p.r, p.i, u.n - uo.n AS one, ub.n - uob.n AS before, coalesce(v.n - vo.n, 0) AS two, coalesce(vb.n - vbo.n, 0) AS pair, coalesce(x.n - xo.n, 0) AS three
      FROM p JOIN u ON p.c = u.c JOIN uo ON p.r = uo.r AND p.c = uo.c
      LEFT JOIN u ub ON p.b = ub.c LEFT JOIN uo uob ON p.r = uob.r AND p.b = uob.c
      LEFT JOIN v ON p.b = v.b AND p.c = v.c LEFT JOIN vo ON p.r = vo.r AND p.b = vo.b AND p.c = vo.c
      LEFT JOIN v vb ON p.a = vb.b AND p.b = vb.c LEFT JOIN vo vbo ON p.r = vbo.r AND p.a = vbo.b AND p.b = vbo.c
      LEFT JOIN x ON p.a = x.a AND p.b = x.b AND p.c = x.c LEFT JOIN xo ON p.r = xo.r AND p.a = xo.a AND p.b = xo.b AND p.c = xo.c),
n AS (SELECT count(*) AS total FROM p),
s AS (SELECT k.r, avg(ln(CASE WHEN i > 2 AND three > 0 THEN three::DOUBLE / pair
        WHEN i > 1 AND two > 0 THEN CASE WHEN i = 2 THEN 1.0 ELSE 0.4 END * two / before
        ELSE CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN 0.4 ELSE 0.16 END * (one + 1) / (n.total - len(d.w) + 1) END)) AS score
      FROM k JOIN d ON k.r = d.r CROSS JOIN n GROUP BY k.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(s.score, 6) AS score FROM d LEFT JOIN s ON d.r = s.r
"""


#: Payloads and media files as hexadecimal digits; CRC-32 by its table of 256 remainders; features from one row for each byte.
MEDIA_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT *, len(h) // 2 AS n_bytes, greatest(192, (len(h) // 2 + 191) // 192 * 192) AS n FROM t),
q AS (SELECT *, h || repeat('20', n - n_bytes) AS x,
        list_transform([36 + n, n], lambda v: printf('%02X%02X%02X%02X', v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255)) AS le FROM p),
m AS (SELECT *, '52494646' || le[1] || '57415645666D74201000000001000100401F0000401F00000100080064617461' || le[2] || x AS w FROM q),
c AS (SELECT list_transform(range(256), lambda v: list_reduce(list_concat([v], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
b AS (SELECT r, i, ('0x' || d)::INTEGER AS v FROM (SELECT r, unnest(regexp_extract_all(x, '..')) AS d, unnest(range(n)) AS i FROM q)),
l AS (SELECT *, lag(v) OVER (PARTITION BY r ORDER BY i) AS u FROM b),
f AS (SELECT r, printf('mean=%.4f;rms=%.4f;min=%d;max=%d;crossings=%d', avg(v), sqrt(avg((v - 128) * (v - 128))), min(v), max(v), count_if((u < 128) <> (v < 128))::INTEGER) AS s FROM l GROUP BY r)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(x)) AS payload_sha256,
  xor(list_reduce(list_concat([4294967295], list_transform(range(16), lambda k: ('0x' || substr(x, 2 * n - 31 + 2 * k, 2))::BIGINT)), lambda a, v: xor(a >> 8, tab[(xor(a, v) & 255) + 1])), 4294967295) AS tail_crc32,
  n + 44 AS media_bytes, sha256(unhex(w)) AS media_sha256, 'n=' || n || ';' || s AS feature
FROM m JOIN f USING (r) CROSS JOIN c
"""


#: Windows by the digest of their 400 hexadecimal digits; runs of covered bytes as islands of window starts.
REPEATS_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM (SELECT r, h, unnest(range(1, len(h) // 2 - 198)) AS i FROM t)),
c AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS f FROM c),
s AS (SELECT r, i, sum(f) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
x AS (SELECT r, run, min(i) AS a, max(i) + 199 AS b FROM s GROUP BY r, run),
y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM x),
z AS (SELECT y.r, sum(b - a + 1) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p - 1)), '' ORDER BY a) AS kept FROM y JOIN t ON y.r = t.r GROUP BY y.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, (len(h) // 2 - coalesce(gone, 0))::BIGINT AS n_kept
FROM t LEFT JOIN z ON t.r = z.r
"""


def mixing_sql(max_rate: int = mixing.MAX_RATE, block: int = mixing.BLOCK, piece: int = mixing.PIECE) -> str:
    """Targets by refilling, multipliers by halving an interval, copies by carrying each block's rest from document to document."""
    mass = f"sum(h.n * h.size * least({max_rate}, exp(least(50.0, (b.low + b.high) / 2 * h.size / b.scale))))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, doc_id, size, count(*) AS n FROM d GROUP BY ALL), h AS (SELECT source, size, sum(n)::BIGINT AS n FROM g GROUP BY ALL),
t AS (SELECT source, sum(size * n)::BIGINT AS source_size, sum(n)::BIGINT AS n_docs, greatest(1.0, sum(size::DOUBLE * size * n) / nullif(sum(size * n), 0)) AS scale FROM h GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {max_rate}.0 * source_size AS cap FROM t),
f AS (SELECT 0 AS k, sum(source_size)::DOUBLE / sum(weight) AS level FROM w UNION ALL
      SELECT k + 1, coalesce(((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM w WHERE weight * level >= cap), 0)) / (SELECT sum(weight) FROM w WHERE weight * level < cap), level) FROM f WHERE k < 80),
o AS (SELECT w.*, least(weight * level, cap) AS target FROM w, f WHERE k = 80),
p AS (SELECT *, CASE WHEN target <= 0 OR source_size <= 0 THEN 0.0 WHEN target >= cap * (1 - 1e-12) THEN {max_rate}.0 END AS fixed, source IS NULL AS none FROM o),
b AS (SELECT 0 AS k, source, none, scale, target, -60.0::DOUBLE AS low, 60.0::DOUBLE AS high FROM p WHERE fixed IS NULL UNION ALL
      SELECT b.k + 1, b.source, b.none, b.scale, b.target, CASE WHEN {mass} < b.target THEN (b.low + b.high) / 2 ELSE b.low END, CASE WHEN {mass} < b.target THEN b.high ELSE (b.low + b.high) / 2 END
      FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source WHERE b.k < 90 GROUP BY b.k, b.source, b.none, b.scale, b.target, b.low, b.high),
r AS (SELECT p.*, b.low AS lam FROM p LEFT JOIN (SELECT * FROM b WHERE k = 90) b ON p.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, doc_id, size, piece, least({piece}, n - piece * {piece}) AS n FROM (SELECT *, unnest(range(0, (n - 1) // {piece} + 1)) AS piece FROM g)),
x AS (SELECT e.*, r.none, source_size, target, coalesce(fixed, least({max_rate}.0, exp(least(50.0, lam * size / scale)))) AS rate,
        ('0x' || substr(md5(concat_ws('|', doc_id, size, piece)), 1, 8))::BIGINT % ceil(n_docs / {block}.0)::BIGINT AS block FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS LAST, block) AS place, row_number() OVER (PARTITION BY source, block ORDER BY size DESC, doc_id NULLS FIRST, piece) AS i FROM x),
q AS (SELECT place, 0::BIGINT AS i, 0.0::DOUBLE AS carry, 0::BIGINT AS k FROM y GROUP BY place UNION ALL
      SELECT place, i, want - k * size, k FROM (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(n * {max_rate}, round(want / size)))::BIGINT ELSE 0 END AS k FROM (
        SELECT y.place, y.i, y.size, y.n, y.rate * y.size * y.n + q.carry AS want FROM q JOIN y ON q.place = y.place AND y.i = q.i + 1))),
z AS (SELECT y.*, q.k, unnest(range(1, y.n + 1)) AS j FROM y JOIN q ON y.place = q.place AND y.i = q.i)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (k // n + CASE WHEN j <= k % n THEN 1 ELSE 0 END) AS taken, source, (k // n + CASE WHEN j <= k % n THEN 1 ELSE 0 END)::INTEGER AS copies FROM z
"""


def pii_sql() -> str:
    """Matches with what stands before them (of kinds that need a boundary), validators, and words near each span."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    doubled = "list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(g)[i]::INTEGER WHEN reverse(g)[i]::INTEGER > 4 THEN 2 * reverse(g)[i]::INTEGER - 9 ELSE 2 * reverse(g)[i]::INTEGER END)"
    luhn = f"list_transform([{digits}], lambda g: length(g) BETWEEN 14 AND 19 AND list_sum({doubled}) % 10 = 0)[1]"
    code = "list_transform(string_split(substr(g, 5) || substr(g, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE c::INTEGER END)"
    mod97 = f"list_transform([replace(v, ' ', '')], lambda g: length(g) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], {code}), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1)[1]"
    parts = "list_transform(string_split(v, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false))"
    kinds = (
        ("email", r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true"),
        ("ip", r"()([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", f"list_bool_and({parts})"),
        ("card", r"()([0-9](?:[\x20-]?[0-9])+)", luhn),
        ("phone", r"()(\+[0-9][\x20().0-9-]+[0-9])", f"length({digits}) BETWEEN 10 AND 15"),
        ("iban", r"(^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)", mod97),
        ("ssn", r"(^|[^0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})", "NOT regexp_matches(substr(text, e + 1, 1), '[0-9-]') AND v[1:3] NOT IN ('000', '666') AND v[1:3] < '900' AND v[5:6] <> '00' AND v[8:11] <> '0000'"),
    )
    found = " UNION ALL ".join(
        f"""SELECT r, text, {rank} AS rank, s, e FROM (SELECT *, s + length(v) AS e FROM (
          SELECT r, text, v, (list_sum(gaps[1 : i]) + coalesce(list_sum(lens[1 : i - 1]), 0) + length(b))::BIGINT AS s FROM (
            SELECT r, text, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v, unnest(bs) AS b, gaps, lens FROM (
              SELECT r, text, regexp_extract_all(text, {quote(rx)}, 1) AS bs, regexp_extract_all(text, {quote(rx)}, 2) AS vs,
                list_transform(string_split_regex(text, {quote(rx)}), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, {quote(rx)}), lambda x: length(x)) AS lens
              FROM t WHERE regexp_matches(text, {quote(rx)}))))) WHERE {valid}"""
        for rank, (_, rx, valid) in enumerate(kinds)
    )
    each = ", ".join(f"({i}, '{k}', {pii.PRIOR[k]}, [{', '.join(map(quote, pii.NEAR[k]))}])" for i, k in enumerate(pii.KINDS))
    near = r"list_transform(regexp_extract_all(substr(text, greatest(1, s - 47), least(s, 48)) || ' ' || substr(text, e + 1, 48), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)?'), lambda w: lower(w))"
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE {cond}), '')"
    count = lambda rank: f"count(*) FILTER (WHERE rank = {rank})"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({found}), k(rank, kind, prior, words) AS (VALUES {each}),
n AS (SELECT r, rank, kind, s, e, least(1.0, prior + CASE WHEN list_has_any({near}, words) THEN {pii.BOOST} ELSE 0 END) AS score FROM m JOIN k USING (rank)),
f AS (SELECT * FROM n WHERE rank < {pii.BASE} OR score >= {pii.MIN_SCORE})
SELECT any_value(doc_id) AS doc_id, {count(0)} AS n_email, {count(1)} AS n_ip, {count(2)} AS n_card, {count(3)} AS n_phone, sha256({joined(f'rank < {pii.BASE}')}) AS base_sha256, {joined('rank IS NOT NULL')} AS spans,
  coalesce(string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY s, rank) FILTER (WHERE rank IS NOT NULL), '') AS scores
FROM t LEFT JOIN f USING (r) GROUP BY r
"""


def simhash_sql() -> str:
    """XXH64 of every shingle in arithmetic modulo 2**64, bit majorities, and components as what is reachable by links of two bits or fewer."""
    p1, p2, p3, p4, p5 = (f"{p}::UBIGINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    fold = lambda x: f"(({x}) % 18446744073709551616)::UBIGINT"
    add = lambda *xs: fold(" + ".join(f"({x})::UHUGEINT" for x in xs))
    mul = lambda a, b: fold(f"({a})::UHUGEINT * ({b})::UHUGEINT")
    # Steps that use a value twice take it as the one element of a list.
    rot = lambda x, k: f"list_transform([{x}], lambda z: {fold(f'z::UHUGEINT * {1 << k}')} | (z >> {64 - k}))[1]"
    down = lambda x, k: f"list_transform([{x}], lambda z: xor(z, z >> {k}))[1]"
    lane = lambda x, at, size: "('0x' || " + " || ".join(f"substr({x}, {at} + {2 * k}, 2)" for k in reversed(range(size))) + ")::UBIGINT"
    turn = lambda v, x: mul(rot(add(v, mul(x, p2)), 31), p1)
    stripes = f"list_transform(range(n // 32), lambda i: [{', '.join(lane('h', f'64 * i + {16 * k + 1}', 8) for k in range(4))}])"
    start = f"[{add(42, p1, p2)}, {add(42, p2)}, 42::UBIGINT, {fold(f'18446744073709551616::UHUGEINT + 42 - {p1}')}]"
    four = f"list_reduce(list_concat([{start}], {stripes}), lambda a, x: [{', '.join(turn(f'a[{k}]', f'x[{k}]') for k in (1, 2, 3, 4))}])"
    merged = add(*(rot(f"v[{k}]", r) for k, r in zip((1, 2, 3, 4), (1, 7, 12, 18), strict=True)))
    for k in (1, 2, 3, 4):
        merged = add(mul(f"xor({merged}, {turn('0', f'v[{k}]')})", p1), p4)
    eights = f"list_reduce(list_concat([h0], list_transform(range(n % 32 // 8), lambda i: {lane('h', 'n // 32 * 64 + 16 * i + 1', 8)})), lambda a, x: {add(mul(rot(f'xor(a, {turn("0", "x")})', 27), p1), p4)})"
    fours = f"CASE WHEN n % 8 >= 4 THEN {add(mul(rot(f'xor(h1, {mul(lane("h", "n // 8 * 16 + 1", 4), p1)})', 23), p2), p3)} ELSE h1 END"
    ones = f"list_reduce(list_concat([h2], list_transform(range(n % 4), lambda i: {lane('h', 'n // 4 * 8 + 2 * i + 1', 1)})), lambda a, x: {mul(rot(f'xor(a, {mul("x", p5)})', 11), p1)})"
    last = down(mul(down(mul(down("h3", 33), p2), 29), p3), 32)
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d WHERE len(w) > 0),
t AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM s)),
a AS (SELECT x, h, n, CASE WHEN n >= 32 THEN {four} END AS v FROM (SELECT x, h, len(h) // 2 AS n FROM t)),
b AS (SELECT x, h, n, {add(f"CASE WHEN n >= 32 THEN {merged} ELSE {add(42, p5)} END", "n")} AS h0 FROM a),
c AS (SELECT x, h, n, {eights} AS h1 FROM b), e AS (SELECT x, h, n, {fours} AS h2 FROM c), f AS (SELECT x, {ones} AS h3 FROM e), g AS (SELECT x, {last} AS y FROM f),
m AS (SELECT r, {' + '.join(f"CASE WHEN 2 * sum((y >> {k}) & 1) > count(*) THEN {1 << k}::HUGEINT ELSE 0 END" for k in range(64))} AS p FROM s JOIN g USING (x) GROUP BY r),
o AS (SELECT d.r, d.doc_id, coalesce(m.p, 0)::UBIGINT AS p FROM d LEFT JOIN m ON d.r = m.r),
k AS (SELECT p, min(doc_id) AS least FROM o GROUP BY p),
l AS (SELECT i.p AS p, j.p AS q FROM k i JOIN k j ON bit_count((xor(i.p, j.p) >> 32)::BIGINT) + bit_count((xor(i.p, j.p) & 4294967295)::BIGINT) <= 2),
u AS (SELECT p, p AS q FROM k UNION SELECT u.p, l.q FROM u JOIN l ON u.q = l.p),
z AS (SELECT u.p, min(k.least) AS component_id FROM u JOIN k ON u.q = k.p GROUP BY u.p)
SELECT doc_id, lpad(lower(to_hex(p)), 16, '0') AS fingerprint, component_id FROM o JOIN z USING (p)
"""


def licenses_sql(templates=licenses.TEMPLATES, dice: float = licenses.DICE) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    row = lambda i, name, text, b: f"({i}, {quote(name)}, {len(licenses.normalise(text).split(' ')) - 1}, [{', '.join(map(quote, b))}])"
    known = ", ".join(row(i, name, text, licenses.template_bigrams(text)) for i, (name, text) in enumerate(templates))
    return rf"""
WITH t(tid, license, length, b) AS (VALUES {known}),
l AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents),
u AS (SELECT r, doc_id, 0 AS line, text AS x FROM l UNION ALL SELECT r, doc_id, unnest(range(1, len(ls) + 1)), unnest(ls) FROM l),
w AS (SELECT r, doc_id, line, list_filter(string_split(trim(regexp_replace(lower(x), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' '), lambda v: v <> '') AS ws FROM u),
a AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS a FROM w),
s AS (SELECT doc_id, line, license, 2.0 * len(list_filter(b, lambda g: list_contains(a, g))) / (len(a) + len(b)) AS dice FROM a JOIN t ON len(a) * {2 - dice} >= len(b) * {dice} AND len(a) * {dice} <= len(b) * {2 - dice}),
m AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, line) AS top FROM s WHERE dice >= {dice}),
-- Windows: words of all lines in a row, places of templates' bigrams, and those places from which enough others follow.
f AS (SELECT r, doc_id, line, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS v FROM w WHERE line > 0),
g AS (SELECT r, doc_id, line, i, v || ' ' || lead(v) OVER (PARTITION BY r ORDER BY i) AS b FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY line, k) AS i FROM f)),
p AS (SELECT g.r, g.doc_id, g.line, g.i, g.b, tid, license, length, size FROM g JOIN (SELECT tid, license, length, len(b) AS size, unnest(b) AS b FROM t) x ON g.b = x.b),
c AS (SELECT o.r, o.doc_id, o.line, o.i, o.license, o.tid, o.length, o.size, count(DISTINCT e.b) AS shared FROM p o JOIN p e ON o.r = e.r AND o.tid = e.tid AND e.i >= o.i AND e.i < o.i + o.length
      GROUP BY ALL HAVING count(DISTINCT e.b) * {2 - dice} >= o.size * {dice} - 0.000000001),
n AS (SELECT c.doc_id, c.line, c.license, c.r, c.i, 2.0 * c.shared / (count(DISTINCT g.b) + c.size) AS dice FROM c JOIN g ON c.r = g.r AND g.i >= c.i AND g.i < c.i + c.length GROUP BY c.doc_id, c.line, c.license, c.r, c.i, c.tid, c.shared, c.size),
z AS (SELECT doc_id, line, license, dice, max(dice) OVER (PARTITION BY r, i) AS top FROM n WHERE dice >= {dice})
SELECT doc_id, license, round(max(dice), 6) AS dice, min(line)::INTEGER AS line FROM (SELECT doc_id, line, license, dice, top FROM m UNION ALL SELECT doc_id, line, license, dice, top FROM z) WHERE dice = top GROUP BY doc_id, license
"""


def secrets_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [("assign", secrets.ASSIGN, "length(g) >= 8"), ("access", secrets.ACCESS, "true"), ("hex", secrets.HEX, "true")]
    allowed = secrets.ALLOW.replace(r"^(.)\1+$|", "")
    for kind, pattern, _, bits in secrets.ENTROPY_CLASSES:
        windows = f"list_transform(range(1, length(g) - {secrets.WINDOW - 2}), lambda i: list_aggregate(string_split(g, '')[i : i + {secrets.WINDOW - 1}], 'entropy'))"
        plain = f"NOT regexp_matches(g, {quote(allowed)}) AND len(list_distinct(string_split(g, ''))) > 1"
        kinds.append((kind, re.sub(r"\(\?<![^)]*\)", "", pattern), f"{plain} AND list_max({windows}) >= {bits}"))
    parts = " UNION ALL ".join(
        f"""SELECT r, {rank} AS rank, '{kind}' AS kind, list_sum(gaps[1 : i]) + coalesce(list_sum(lens[1 : i - 1]), 0) AS s, list_sum(gaps[1 : i]) + list_sum(lens[1 : i]) AS e FROM (
          SELECT r, unnest(range(1, len(ms) + 1)) AS i, unnest(gs) AS g, gaps, lens FROM (
            SELECT r, regexp_extract_all(text, {quote(rx)}, 0) AS ms, regexp_extract_all(text, {quote(rx)}, 1) AS gs,
              list_transform(string_split_regex(text, {quote(rx)}), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, {quote(rx)}, 0), lambda x: length(x)) AS lens
            FROM t WHERE regexp_matches(text, {quote(rx)}))) WHERE {keep}"""
        for rank, (kind, rx, keep) in enumerate(kinds)
    )
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (WHERE {cond}), '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({parts})
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256({joined('rank < 3')}) AS base_sha256, {joined('rank IS NOT NULL')} AS spans
FROM t LEFT JOIN m USING (r) GROUP BY r
"""


def sql() -> dict[str, str]:
    return {"op1_media": MEDIA_SQL, "op4_mixing": mixing_sql(), "op6_simhash": simhash_sql(), "op9_pii": pii_sql(), "op2_suffix_dedup": REPEATS_SQL, "op10_secrets": secrets_sql(), "op5_lm_scoring": BACKOFF_SQL, "op8_licenses": licenses_sql()}
