"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessellar.llm import common, decontam, graph, jaccard, licenses, lm, media, mixing, pii, sais, secrets, simhash, suffix, toxicity
from tessellar.llm.words import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, spans string, f0 long, u string, target double"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(300)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    r = random.Random(9)
    base = prose(r, 90)
    near = base.split(" ")
    near[40] = "changed"
    out = [(i, prose(r, r.randint(1, 120)), "en", f"s{i % 3}") for i in range(40)]
    out += [(50, base, "en", "s0"), (51, base, "fr", "s1"), (52, " ".join(near), "en", None), (50, base, "en", "s0")]
    out += [(60, "", "en", "s0"), (61, None, None, None), (None, "only one row has no id " + prose(r, 60), "en", "s1"), (None, None, None, "s9")]
    out += [(70, "Ünï ©ode \U0001f600 " + prose(r, 50) + "\x0b\ttabs \n", "de", "s2"), (71, "x" * 30_000, "en", "s2"), (72, prose(r, 6000), "en", "s2"), (73, "ab " * 400, "en", "s2")]
    return [(*x, 1, 7, "clash", 5, "v", 1.5) for x in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is None, x or 0)


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_media_round_trip(docs, empty):
    got = collected(media.report(docs))
    assert len(got) == len(rows()) and media.report(empty).count() == 0
    want = Counter()
    for d, t, *_ in rows():
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[(d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert Counter((g["doc_id"], g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) for g in got) == want
    assert len({(g["payload_sha256"], g["media_sha256"], g["feature"]) for g in got}) == len({g["payload_sha256"] for g in got})


def test_gear_hash_and_cuts():
    r = random.Random(2)
    table = media._GEAR.tolist()
    for n in (1, 5, 31, 32, 33, 1000, 40_000):
        data = bytes(r.randrange(256) for _ in range(n))
        h, want = 0, []
        for x in data:
            h = ((h << 1) + table[x]) & 0xFFFFFFFF
            want.append(h)
        assert media.gear(data).tolist() == want
        ends = media.cuts(data)
        assert ends[-1] == n and all(0 < b - a <= media.MOST for a, b in zip([0, *ends], ends, strict=False))
    shared = bytes(r.randrange(256) for _ in range(60_000))
    one, two = ({d[:2] for d in media.chunked(lead + shared)} for lead in (b"a" * 700, b"bcd" * 500))
    assert len(one & two) > 0.7 * len(one)
    assert media.from_wav(media.to_wav(b"abc" * 64)) == b"abc" * 64


def brute_repeats(texts):
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("contexts, hot", [(64, 20_000), (2, 20_000), (64, 1)])
def test_suffix_dedup(spark, docs, empty, monkeypatch, contexts, hot):
    monkeypatch.setattr(suffix, "CONTEXTS", contexts)
    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(1)
    passage, line = prose(r, 80), prose(r, 45)
    more = [(100 + i, prose(r, 30) + " " + (passage if i % 2 else line) + " " + prose(r, 30), "en", "s", 1, 1, "", 1, "", 1.0) for i in range(30)]
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    all_rows = [*rows(), *more]
    want = brute_repeats([(x[1] or "").encode() for x in all_rows])
    got = collected(suffix.remove(df))
    assert Counter((g["doc_id"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in got) == Counter((x[0], *w) for x, w in zip(all_rows, want, strict=True))
    assert suffix.remove(empty).count() == 0


def test_suffix_arrays():
    r = random.Random(5)
    for _ in range(100):
        ss = sorted(([r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 60))] + [0] for _ in range(r.randint(1, 12))), key=len, reverse=True)
        off = np.concatenate([[0], np.cumsum([len(s) for s in ss])])
        sa = sais.suffix_arrays(np.array(sum(ss, []), np.int32), off)
        for b, s in enumerate(ss):
            assert (sa[off[b] : off[b + 1]] - off[b]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def edit_distance(item, doc):
    d = [0] * (len(doc) + 1)
    for i, c in enumerate(item):
        e = [i + 1]
        for j, x in enumerate(doc):
            e.append(min(d[j] + (x != c), d[j + 1] + 1, e[j] + 1))
        d = e
    return min(d)


def test_banded_alignment():
    r = random.Random(3)
    for _ in range(200):
        a, b = (np.array([r.randrange(3) for _ in range(r.randint(lo, hi))], np.uint32) for lo, hi in ((1, 8), (0, 14)))
        got = decontam.align(a, b, -len(a), len(b) + 2 * len(a) + 1, 99)
        assert got[0] == edit_distance(a.tolist(), b.tolist())
    assert decontam.align(np.array([1, 2, 3] * 9, np.uint32), np.array([7] * 40, np.uint32), 0, 20, 2) is None


def test_decontamination(spark, docs, empty):
    r = random.Random(7)
    items = [(i, prose(r, 30)) for i in range(20)] + [(90, None), (91, ""), (92, "tiny")]
    changed = items[3][1][:60] + "zz" + items[3][1][63:]
    more = [(200, prose(r, 50) + " " + items[1][1].upper() + ", " + prose(r, 20)), (201, "start " + changed), (202, prose(r, 200)), (203, "a tiny thing"), (None, items[2][1])]
    df = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 1, 1, "", 1, "", 1.0) for d, t in more], SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(200, 1), (201, 3), (203, 92), (None, 2)}
    for block in (10_000_000, 900):
        got = collected(decontam.matches(df, bench, block=block))
        assert {(g["doc_id"], g["item_id"]) for g in got} == want
    texts = {x[0]: x[1] for x in more}
    one = next(g for g in got if g["doc_id"] == 200)
    assert texts[200][one["start_at"] : one["end_at"]].lower().rstrip(",") == items[1][1] and one["edits"] == 0
    assert 0 < next(g for g in got if g["doc_id"] == 201)["edits"] <= 4
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 4
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0 and decontam.clean(df, bench.limit(0)).count() == df.count()


def test_decontamination_finds_what_the_bound_allows():
    r = random.Random(8)
    items = [prose(r, r.randint(14, 60)) for _ in range(20)]
    index = decontam.Index(list(enumerate(items)))
    for i, item in enumerate(items):
        x = list(item)
        for _ in range(index.budget[i]):
            p = r.randrange(len(x))
            x[p : p + 1] = r.choice((["q"], [], [x[p], "q"]))
        text = prose(r, 40) + " " + "".join(x) + " " + prose(r, 40)
        if edit_distance(list(item), list(text)) <= index.budget[i]:
            assert i in [f[0] for f in index.search(text)]
        assert index.search(prose(r, 400)) == []


def test_mixing(spark, docs, empty):
    got = collected(mixing.mix(docs))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((x[0], size(x[1])) for x in rows())
    totals = defaultdict(int)
    for x in rows():
        totals[x[3]] += size(x[1])
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(totals.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * totals[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            rest -= target[s]
        open_ -= over
    target |= share
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == totals[g["source"]] and math.isclose(g["target"], target[g["source"]], abs_tol=1e-6)
        assert g["taken"] % max(g["size"], 1) == 0 and g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    assert abs(taken["s0"] - target["s0"]) < 0.05 * target["s0"] and abs(taken["s1"] - target["s1"]) < 0.05 * target["s1"]
    for name in (*names[:2], None):  # the dual of each source, solved by halving
        own = [g for g in got if g["source"] == name and g["size"]]
        scale = sum(g["size"] ** 2 for g in own) / totals[name]
        low, high = -60.0, 60.0
        rate = lambda g, lam, scale=scale: min(3.0, math.exp(min(50.0, lam * g["size"] / scale)))
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(g["size"] * rate(g, mid) for g in own) < target[name] else (low, mid)
        assert all(math.isclose(g["rate"], rate(g, low), rel_tol=1e-3, abs_tol=1e-3) for g in own), name
    again, got = collected(mixing.report(docs.repartition(5))), collected(mixing.report(docs))
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.report(empty).count() == 0


def test_mixing_of_repeated_rows(spark):
    data = [(1 if i % 3 else None, "a b c d", "s") for i in range(25_000)] + [(i, "w " * (i % 40), "t") for i in range(3000)] + [(i, "", "u") for i in range(9)] + [(7, "long " * 9000, "t")]
    got = collected(mixing.report(spark.createDataFrame(data, "doc_id long, text string, source string")))
    assert Counter((g["doc_id"], g["source"], g["size"]) for g in got) == Counter((d, s, len(t.split())) for d, t, s in data)
    for s in "st":
        taken, target = sum(g["taken"] for g in got if g["source"] == s), next(g["target"] for g in got if g["source"] == s)
        assert abs(taken - target) < 0.01 * target
    assert all(0 <= g["copies"] <= 3 for g in got) and all(g["taken"] == 0 for g in got if g["source"] == "u")


def test_backoff_scores(docs, empty):
    words = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (x[1] or "").lower()) for x in rows()]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    every = Counter()
    for w in words:
        every.update(grams(w))
    total = sum(map(len, words))
    want = Counter()
    for x, w in zip(rows(), words, strict=True):
        own = grams(w)
        c = lambda *g, own=own: every[g] - own[g]
        logs = 0.0
        for i, v in enumerate(w):
            s = 0.16 * (c(v) + 1) / (total - len(w) + 1)
            if i and c(w[i - 1], v):
                s = 0.4 * c(w[i - 1], v) / c(w[i - 1])
            s = s / 0.16 if i == 0 else s / 0.4 if i == 1 else s
            if i > 1 and c(w[i - 2], w[i - 1], v):
                s = c(w[i - 2], w[i - 1], v) / c(w[i - 2], w[i - 1])
            logs += math.log(s)
        want[(x[0], len(w), round(logs / len(w), 6) if w else None)] += 1
    got = collected(lm.score(docs))
    assert Counter((g["doc_id"], g["n_words"], None if g["score"] is None else round(g["score"], 6)) for g in got) == want
    assert lm.score(empty).count() == 0


def plain_print(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    prints = [plain_print(x[1]) for x in rows()]
    n = len(prints)
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = [x[0] for x in rows()]
    least = {c: min((ids[i] for i in range(n) if label[i] == c and ids[i] is not None), default=None) for c in set(label)}
    want = Counter((ids[i], f"{prints[i]:016x}", least[label[i]]) for i in range(n))
    assert Counter((g["doc_id"], g["fingerprint"], g["component_id"]) for g in collected(simhash.report(docs))) == want
    assert simhash.report(empty).count() == 0


def test_gray_index_finds_all_neighbours():
    r = np.random.default_rng(4)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = (np.uint64(1) << r.integers(0, 63, (3000, 3), dtype=np.uint64)) * r.integers(0, 2, (3000, 3), dtype=np.uint64)
    keys = np.unique(np.concatenate([centres[r.integers(0, 12, 3000)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2], r.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    data = np.stack([np.arange(len(keys), dtype=np.uint64), keys], axis=1)
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 2
    want = graph.local_components(len(keys), *np.nonzero(near))
    edges = simhash.link_shard(data, data[:0]).astype(np.int64)
    got = graph.local_components(len(keys), edges[:, 0], edges[:, 1])
    assert (got == want).all() and len(edges) <= len(keys)
    half = len(keys) // 2
    edges = np.concatenate([simhash.link_shard(data[:half], data[half:]), simhash.link_shard(data[half:], data[:0])]).astype(np.int64)
    assert (graph.local_components(len(keys), edges[:, 0], edges[:, 1]) == want).all()


def test_near_dedup(docs, empty):
    got = simhash.dedupe(docs)
    kept = collected(got)
    assert got.columns == docs.columns
    ids = Counter(g["doc_id"] for g in kept)
    assert ids[50] == 1 and 51 not in ids and 52 not in ids and all(ids[i] == 1 for i in range(40))
    assert sum(1 for g in kept if not g["text"]) == 1 and simhash.dedupe(empty).count() == 0


def test_components(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, x) for x in range(200, 300)] + [(r.randint(600, 900), r.randint(600, 900)) for _ in range(150)]
    got = {x["v"]: x["u"] for x in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(70):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {v: got.get(v, v) for v in label} == label
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(12)
    bad = ["vile", "fool", "scum"]
    data = []
    for i in range(900):
        w = prose(r, r.randint(20, 80)).split(" ")
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        data.append((i, " ".join(w), "en" if i % 2 else "fr", int(toxic)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {g["doc_id"]: g for g in collected(toxicity.report(df, labels))}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert {d for d, g in got.items() if g["held_out"]} == {x[0] for x in held}
    assert sum(got[x[0]]["predicted"] == x[3] for x in held) > 0.9 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert toxicity.reject(df, labels).columns == df.columns
    assert toxicity.report(docs, labels.limit(0)).where("score = 0").count() == len(rows())
    assert toxicity.report(docs, labels).count() == len(rows()) and toxicity.report(empty, labels).count() == 0


def test_long_documents_score_as_short_ones():
    r = random.Random(1)
    docs_ = [next(toxicity.word_rows([prose(r, 30) + (" vile" if i % 2 else "")])) for i in range(60)]
    m = toxicity.train(docs_, np.array([i % 2 for i in range(60)]), ["en"] * 60, 0.5)
    long = np.concatenate([docs_[0]] * 40 + [docs_[1]] + [docs_[2]] * 40)
    whole = toxicity.score(m, [long])
    old = toxicity.BLOCK_WORDS
    try:
        toxicity.BLOCK_WORDS = 100
        assert np.allclose(toxicity.score(m, [long]), whole)
    finally:
        toxicity.BLOCK_WORDS = old
    h, n = word_hashes(["Ab  cd-ab", None, "", "é1"])
    assert n.tolist() == [3, 0, 0, 1] and h[0] == h[2]


def plain_licenses(text):
    """Lines, the whole text, and at each word the window of each template's length whose first bigram is one of its own."""
    best = {}
    known = [(n, set(licenses.template_bigrams(t)), len(licenses.normalise(t).split()) - 1) for n, t in licenses.TEMPLATES]
    lines = re.split("\r\n|\r|\n", text)
    words = [(i + 1, w) for i, x in enumerate(lines) for w in licenses.normalise(x).split()]
    grams = [(a[0], f"{a[1]} {b[1]}") for a, b in zip(words, words[1:], strict=False)]
    starts = [(line, [(n, {g for _, g in grams[i : i + k]}, b) for n, b, k in known if x in b]) for i, (line, x) in enumerate(grams)]
    units = [(i, set(licenses.template_bigrams(u))) for i, u in [(0, text), *((i + 1, x) for i, x in enumerate(lines))]]
    for line, unit in [*((i, [(n, a, b) for n, b, _ in known if a or b]) for i, a in units), *starts]:
        got = [(n, 2 * len(a & b) / (len(a) + len(b))) for n, a, b in unit]
        top = max((s for _, s in got), default=0)
        for n, s in got:
            if s == top and s >= 0.8:
                old = best.get(n, (0, line))
                best[n] = (max(old[0], s), min(old[1], line))
    return best


def test_licenses(spark, docs, empty):
    r = random.Random(3)
    texts = [prose(r, 40) + "\n" + t + "\n" + prose(r, 9) for _, t in licenses.TEMPLATES] + ["Released  under, the MIT license", "licensed", "the of a", prose(r, 30)]
    mit, gpl = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len), dict(licenses.TEMPLATES)["GPL-3.0"]
    texts.append("int main() { return 0; }\n/* " + "\n * ".join(textwrap.wrap(mit, 76)) + " */\nint x = 1;\n" + prose(r, 60))
    texts.append(prose(r, 20) + "\r\n# " + "\r\n# ".join(textwrap.wrap(gpl.replace("program", "library"), 40)) + "\r\n" + prose(r, 20))
    texts.append(prose(r, 5) + " Released under the MIT License. " + prose(r, 8))
    df = docs.unionByName(spark.createDataFrame([(300 + i, t, "en", "s", 1, 1, "", 1, "", 1.0) for i, t in enumerate(texts)], SCHEMA))
    want = {(300 + i, n, round(s, 6), line) for i, t in enumerate(texts) for n, (s, line) in plain_licenses(t).items()}
    assert {(g["doc_id"], g["license"], g["dice"], g["line"]) for g in collected(licenses.report(df))} == want and len(want) >= len(licenses.TEMPLATES)
    found = {(d - 300, n) for d, n, _, _ in want}
    assert {(len(texts) - 3, "MIT"), (len(texts) - 2, "GPL-3.0"), (len(texts) - 1, "MIT")} <= found
    assert licenses.report(empty).count() == 0


def base_pii(x):
    s = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    s += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            s.append((m.start(), 2, m.end()))
    s += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(s)


def test_pii(spark, docs, empty):
    r = random.Random(1)
    for _ in range(20_000):
        x = "".join(r.choice(r.choice(["a.@b_", "0.1.29 ", "01 -+().", "a@b.c-_ 1+"])) for _ in range(r.randint(0, 40)))
        assert [s[:3] for s in pii.find_spans(x) if s[1] < 4] == base_pii(x), x
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    found = pii.find_spans("my iban is GB82 WEST 1234 5698 7654 32, ssn 123-45-6789; part 123-45-6780 of " + "z " * 40 + "987-65-4321")
    assert [pii.KINDS[s[1]] for s in found][:2] == ["iban", "ssn"]
    text = "mail me: a.b@x.org or +1 (377) 555-0271"
    df = docs.unionByName(spark.createDataFrame([(400, text, "en", "s", 1, 1, "", 1, "", 1.0)], SCHEMA))
    got = collected(pii.report(df))
    one = next(g for g in got if g["doc_id"] == 400)
    base = "email:9:18,phone:22:39"
    assert (one["n_email"], one["n_phone"], one["spans"], one["base_sha256"]) == (1, 1, base, hashlib.sha256(base.encode()).hexdigest())
    assert len(got) == len(rows()) + 1 and pii.report(empty).count() == 0


def base_secrets(x):
    rx = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    s = [(m.start(), 0, "assign", m.end()) for m in rx.finditer(x) if len(m[2]) >= 8]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(s)


def test_secrets(spark, docs, empty):
    r = random.Random(2)
    parts = ["password = ", "Token:'", "api_key=", "APIKEY: ", "secret\"  :", "abcdefgh", "12345", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é ", " ", "\n", "=", "x", "\U0001f600", "Zx9+Qw7/Lm2Pk4Rt8Vb1Nc6"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    df = docs.unionByName(spark.createDataFrame([(500 + i, t, "en", "s", 1, 1, "", 1, "", 1.0) for i, t in enumerate(texts)], SCHEMA))
    got = {g["doc_id"]: g for g in collected(secrets.report(df.where("doc_id >= 500")))}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_secrets(t))
        assert got[500 + i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
    assert secrets.report(docs).count() == len(rows()) and secrets.report(empty).count() == 0
    masked = collected(secrets.redact(df).where("doc_id >= 500"))
    assert all("AKIAABCDEFGH1234" not in g["text"] for g in masked) and secrets.redact(df).columns == df.columns
    own = {500 + i: t for i, t in enumerate(texts)}
    assert all(g["text"] == own[g["doc_id"]] for g in masked if not got[g["doc_id"]]["spans"])


def test_window_entropy(spark):
    r = random.Random(4)
    tokens = ["".join(r.choice("abc123XYZ") for _ in range(r.randint(1, 70))) for _ in range(60)]

    def best(t):
        out = 0.0
        for i in range(len(t) - 19):
            c = Counter(t[i : i + 20])
            out = max(out, -sum(n / 20 * math.log2(n / 20) for n in c.values()))
        return out

    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.window_entropy(F.col("t")).alias("h")).collect()
    assert all(math.isclose(x["h"], best(x["t"]), abs_tol=1e-9) for x in got)


def test_near_dedup_counts_similarity(spark, docs):
    """Kept ids equal those of exact components; pairs lie closely around 0.8, and families chain and share boilerplate."""
    r = random.Random(21)
    texts = []
    for n in (12, 40, 150, 600):
        for edits in (1, 2, 3, 4, 5, 6) * 4:
            base = [f"{n}x{r.randint(0, 10**9)}" for _ in range(n)]
            copy = list(base)
            for at in r.sample(range(n), max(1, edits * n // 200)) if n > 12 else [r.choice([0, n - 1, 5])]:
                copy[at] = "new"
            texts += [" ".join(base), " ".join(copy)]
    shared = [f"b{i}" for i in range(60)]
    texts += [" ".join(shared + [f"own{r.randint(0, 10**9)}" for _ in range(r.randint(5, 40))]) for _ in range(40)]
    hot = [f"h{i}" for i in range(90)]
    for _ in range(600):
        copy = list(hot)
        for at in r.sample(range(90), r.randint(0, 3)):
            copy[at] = f"v{r.randint(0, 10**9)}"
        texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "", 1, "", 1.0) for i, t in enumerate(texts)], SCHEMA)
    assert {g["doc_id"] for g in collected(simhash.dedupe(df))} == {root(i) for i in range(len(texts))}


def test_fingerprints_propose_near_copies(spark, monkeypatch):
    """Without any shared min-hash key, pairs of near fingerprints are found, and sets decide; with them, other pairs come on top."""
    r = random.Random(77)
    texts = []
    for k in range(40):
        base = [f"w{r.randint(0, 10**9)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join([*base[: 399 - k % 8], "other"])]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "", 1, "", 1.0) for i, t in enumerate([*texts, "", None])], SCHEMA)
    prints = [simhash.majority(np.unique(simhash.shingle_hashes(t, 5, 42))) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS]
    want = graph.local_components(len(texts), *np.array(near).T)
    assert 40 < (want != np.arange(len(texts))).sum() < 80  # all of them have similarity 0.8 or more
    assert {g["doc_id"] for g in collected(simhash.dedupe(df))} == {*range(0, 120, 3), 120}
    monkeypatch.setattr(jaccard, "proposed", lambda sets: sets.select(F.col("nid").alias("u"), F.col("nid").alias("v")).limit(0))
    assert {g["doc_id"] for g in collected(simhash.dedupe(df))} == {*want.tolist(), 120}


def test_licenses_long_units_of_few_bigrams(spark):
    gpl = dict(licenses.TEMPLATES)["GPL-3.0"]
    texts = ["Released under the MIT License.\n" * 900, "Released under" + " -" * 9000 + " the MIT License.", "_Released_under_the_MIT_License_", "\n".join([gpl.replace(" ", "\n", 9)] * 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {(i, n, round(s, 6), line) for i, t in enumerate(texts) for n, (s, line) in plain_licenses(t).items()}
    assert {(g["doc_id"], g["license"], g["dice"], g["line"]) for g in licenses.report(df).collect()} == want and {w[0] for w in want} == {0, 1, 2, 3}


def plain_spans(x):
    """All spans by the definitions: base kinds, then classes whose best window reaches its bits."""
    out = base_secrets(x)
    for rank, (kind, rx, _, bits) in enumerate(secrets.ENTROPY_CLASSES, 3):
        for m in re.finditer(rx, x):
            counts = (Counter(m[0][i : i + 20]) for i in range(len(m[0]) - 19))
            if not re.search(secrets.ALLOW, m[0]) and any(-sum(n / 20 * math.log2(n / 20) for n in c.values()) >= bits - 1e-12 for c in counts):
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_secret_spans_and_masks_of_long_texts(spark):
    r = random.Random(31)
    code = lambda n: "".join(r.choice("ABCDEFGHabcdefgh01234567+/xyzXYZ") for _ in range(n))
    texts = [code(60_000), " ".join(f"{r.getrandbits(160):040x}" for _ in range(1500)), "é\U0001f600\n" * 9000 + "password = abcdefgh99 " + "z\r\n" * 5000, "", None]
    texts += ["".join(r.choice([code(25), "password=", "token: ", " ", "\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789abcdef0123", f"{r.getrandbits(140):x}", "AKIAABCDEFGH1234"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1, "kept") for i, t in enumerate(texts)], "doc_id long, text string, __t int, __spans string")
    got = {g["doc_id"]: g["spans"] for g in collected(secrets.report(df))}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_spans(t or "")) for i, t in enumerate(texts)}

    def plain_mask(t):
        out, at = "", 0
        for a, _, _, b in plain_spans(t):
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        return out + t[at:]

    masked = secrets.redact(df)
    assert masked.columns == df.columns
    assert {g["doc_id"]: (g["text"], g["__spans"]) for g in collected(masked)} == {i: (t and plain_mask(t), "kept") for i, t in enumerate(texts)}


def test_running_sums(spark):
    r = random.Random(1)
    rows_ = [([r.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 8, 9, 31, 64, 65, 1000)]
    got = spark.createDataFrame(rows_, "a array<int>").select("a", common.running(F.col("a"), lambda a, b: a + b).alias("s")).collect()
    assert all(x["s"] == [sum(x["a"][: i + 1]) for i in range(len(x["a"]))] for x in got)


def plain_toxicity(m, text):
    """The classifier's score word by word, from its own weights."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
    rows_ = [next(toxicity.word_rows([w.decode("utf-8", "replace")])) for w in words]
    x = [sum(t[int(r[0, k])].astype(float) for k, t in enumerate(m.tables)) for r in rows_] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    best = np.concatenate([np.max([sum(x[i + j] @ f[j] for j in range(w)) for i in range(len(x) - w + 1)], axis=0) for w, f in zip(toxicity.WIDTHS, m.filters, strict=True)])
    return 1 / (1 + math.exp(-float(np.maximum(best + m.bias, 0) @ m.out + m.shift)))


def test_toxicity_scores_equal_the_plain_network(spark):
    r = random.Random(14)
    words = [next(toxicity.word_rows([prose(r, r.randint(5, 40)) + (" vile scum" if i % 2 else "")])) for i in range(200)]
    m = toxicity.train(words, np.array([i % 2 for i in range(200)]), ["en"] * 200, 0.3)
    texts = [prose(r, n) for n in (1, 2, 3, 50)] + ["", None, "vile", "a vile\nscum of é\U0001f600 words", "VILE " * 40]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, "own") for i, t in enumerate(texts)], "doc_id long, text string, lang string, __score string")
    got = toxicity.apply(df, m, "s", "t").collect()
    assert all(math.isclose(g["s"], plain_toxicity(m, g["text"]), abs_tol=1e-4) for g in got)
    assert all(g["__score"] == "own" and g["t"] == (m.thresholds.get(g["lang"], m.threshold)) for g in got) and m.threshold == 0.3


def test_toxicity_held_out(spark):
    """Recall and precision on the held-out rows of the labels."""
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.report(d, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(g["predicted"] and g["toxic"] for g in got)
    assert hit > 0.9 * sum(g["toxic"] for g in got) and hit > 0.85 * sum(g["predicted"] for g in got)


def test_toxicity_trains_on_every_labelled_row(spark, monkeypatch):
    """Long texts too (all that is toxic here), in many shards; labels of held-out rows do not matter."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 50)
    r = random.Random(31)
    filler = [prose(r, 500) for _ in range(12)]
    data = []
    for i in range(400):
        w = prose(r, r.randint(20, 60)).split()
        if i % 4 == 0:
            w = (" ".join(w) + " " + " ".join(r.choice(filler) for _ in range(12))).split()
            for _ in range(6):
                w[r.randrange(len(w))] = r.choice(("vile", "scum"))
        data.append((i, " ".join(w), "en", int(i % 4 == 0)))
    assert all(len(x[1]) > 30_000 for x in data if x[3])
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic")
    held = {x[0] for x in data if zlib.crc32(str(x[0]).encode()) % 4 == 2}
    table = toxicity.labelled(df.unionByName(df), labels)
    assert {x["doc_id"] for x in table.collect()} == {x[0] for x in data} - held and table.count() == 400 - len(held)
    assert table.select("shard").distinct().count() == -(-table.count() // 50)
    got = {g["doc_id"]: g for g in toxicity.report(df, labels).collect()}
    assert sum(got[x[0]]["predicted"] == x[3] for x in data if x[0] in held) > 0.9 * len(held)
    other = {g["doc_id"]: g["score"] for g in toxicity.report(df, labels.withColumn("toxic", F.when(F.col("doc_id").isin(*held), 1).otherwise(F.col("toxic")))).collect()}
    assert all(math.isclose(g["score"], other[i], abs_tol=1e-6) for i, g in got.items())


def test_columns_of_any_name(spark):
    """Columns that clash with names the operators use inside come out as they went in."""
    r = random.Random(5)
    names = ("__score", "__threshold", "__row", "__d0", "__d1", "__bands", "__spans", "__maybe", "__Score_", "words", "toxic", "nid", "key", "u", "v", "secrets")
    rows_ = [(i, prose(r, 40) + (" password = abcd1234efgh" if i % 3 == 0 else "") + (" vile" if i % 4 == 0 else ""), "en", "s", *(f"{n}{i}" for n in names)) for i in range(60)]
    rows_ += [(100, rows_[1][1], *rows_[1][2:])]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    labels = df.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic")
    bench = spark.createDataFrame([(1, rows_[7][1])], "item_id long, text string")
    for out in (toxicity.reject(df, labels), simhash.dedupe(df), decontam.clean(df, bench), secrets.redact(df)):
        assert out.columns == df.columns
        own = {x[0]: x[4:] for x in rows_}
        got = out.collect()
        assert len(got) > 30 and all(tuple(g)[4:] == own[g["doc_id"]] for g in got)
    for report in (media.report, suffix.remove, mixing.report, lm.report, simhash.report, licenses.report, pii.report, secrets.report):
        report(df).collect()
    assert {g["doc_id"] for g in simhash.dedupe(df).collect()} == set(range(60))


def test_written_leaves_one_folder(spark):
    before = set(common._FOLDERS)
    rows_ = common.written(lambda: common.stored(common.stored(spark.range(9).toDF("id"), "a").where("id > 2"), "b"), "c")
    assert rows_.count() == 6 and [p for p in common._FOLDERS if p not in before] == [rows_._stored_at]
    common.discard(rows_)
    assert set(common._FOLDERS) == before


def test_stored_gives_back_the_drivers_memory(spark):
    """A heap that garbage made grow to over half of its limit shrinks once a step's table is written."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    spark._jvm.java.lang.System.gc()
    left = heap.maxMemory() * 7 // 10 - (heap.totalMemory() - heap.freeMemory())
    garbage = [spark._jvm.java.nio.ByteBuffer.allocate(16 << 20) for _ in range(left >> 24)]
    before = heap.totalMemory()
    assert 2 * before > heap.maxMemory()
    del garbage
    common.stored(spark.range(100), "few")
    assert heap.totalMemory() < 0.8 * before


def test_filters_pass_all_keys(spark):
    r = np.random.default_rng(3)
    keys = r.integers(0, 1 << 63, 20_000, dtype=np.int64)
    df = common.stored(spark.createDataFrame([(int(k),) for k in keys[:5000]], "h long"), "keys")
    held = common.Filter(df, "h", 5000).has(keys.view(np.uint64))
    assert held[:5000].all() and held[5000:].mean() < 0.02
    every = common.stored(spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "h long, i int"), "every")
    got = common.in_filter(every, "h", df, 5000, "maybe").collect()
    assert all(g["maybe"] for g in got if g["i"] < 5000) and sum(g["maybe"] for g in got if g["i"] >= 5000) < 300
    assert {g["i"] for g in common.without(every, "h", df).collect()} == set(range(5000, 20_000))
    assert common.without(every, "h", common.stored(df.limit(0), "none")).count() == 20_000
    small, most = common.MOST_BITS, common.LEAST_BITS
    try:
        common.MOST_BITS = common.LEAST_BITS = 15  # far too small: all pass, nothing is lost
        assert {g["i"] for g in common.without(every, "h", df).collect()} == set(range(5000, 20_000))
    finally:
        common.MOST_BITS, common.LEAST_BITS = small, most


def test_queries_equal_their_sql(spark):
    """Every registered query that has SQL, over the driver's smallest tables."""
    import duckdb

    from tessellar.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    for name, sql in queries.oracle_sql().items():
        ours = queries.queries()[name](spark, sf)
        theirs = con.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == sorted(ours.columns), name
        want = Counter(tuple(plain(x) for x in r) for r in theirs.fetchall())
        assert Counter(tuple(plain(x) for x in r) for r in ours.select(*names).collect()) == want, name
