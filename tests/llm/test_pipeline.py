"""The corpus pipeline over a small folder of tables, stage by stage."""

import random
from collections import Counter

import test_operators as plain

import corpus_pipeline
from tessellar.llm import decontam, toxicity


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0.6 * n < len(rows) <= n
        docs = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and {"doc_id", "taken", "copies"} <= {*out.columns}
    bench = {r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert not [r for r in docs.collect() if any(b in r["text"] for b in bench)]
    assert docs.groupBy("text").count().where("count > 1").count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "source_mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def tables(spark, folder):
    """Small tables that hold what every stage looks for, and nulls, empties, repeats and other columns."""
    r = random.Random(40)
    docs, labels, items = [], [], [(i, plain.prose(r, 25)) for i in range(6)] + [(7, None), (8, "")]
    for i in range(400):
        words = plain.prose(r, r.randint(12, 60)).split()
        if i % 4 == 0:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(("vile", "scum", "fool"))
        if i % 9 == 1:
            words += ["password", "=", "".join(r.choice("abcXYZ0189") for _ in range(12))]
        if i % 23 == 2:
            words[5:5] = r.choice(items[:6])[1].replace("o ", "a ", i % 3).split()
        docs.append([i, " ".join(words), r.choice(("en", "fr", None)), r.choice(("a", "b", "c", None)), 0])
        labels.append((i, int(i % 4 == 0)))
    for k in range(60):
        base = r.choice(docs)[1].split()
        for _ in range(r.choice((0, 0, 1, 2, 6))):
            base[r.randrange(len(base))] = "other"
        docs.append([1000 + k, " ".join(base), "en", "b", 0])
    docs += [[2000, "", "en", "a", 0], [2001, None, None, None, 0], [2002, "", "fr", "a", 0], [None, plain.prose(r, 30), "en", "c", 0], docs[7][:], docs[7][:]]
    rows = [(*d, f"extra{n}") for n, d in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def near_copies_kept(rows):
    """The least id of each component of exact similarity, which texts without words form among themselves."""
    sets = []
    for x in rows:
        w = (x["text"] or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = {}
    for i, x in enumerate(rows):
        key = (x["doc_id"] is None, x["doc_id"] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    return Counter(d if not none else None for none, d in least.values())


def holds_item(text, items):
    doc = decontam.normalised(text or "")[0].tolist()
    for i in decontam.Index(items).texts:
        k = max(0, min(int(decontam.EDITS * len(i)), (len(i) - decontam.Q) // decontam.Q))
        if plain.edit_distance(i.tolist(), doc) <= k:
            return True
    return False


def plain_mask(text):
    out, at = "", 0
    for a, _, _, b in plain.plain_spans(text):
        out, at = (out + text[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
    return out + text[at:]


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda rows: Counter(x["doc_id"] for x in rows)
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        before = docs.collect()
        path = f"{folder}/{name}"
        stages[name](spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        return before, docs.collect()

    before, after = step("toxicity")
    m = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    close = {x["doc_id"] for x in before if abs(plain.plain_toxicity(m, x["text"]) - m.thresholds.get(x["lang"], m.threshold)) < 1e-4}
    kept = [x for x in before if plain.plain_toxicity(m, x["text"]) < m.thresholds.get(x["lang"], m.threshold)]
    assert {k: v for k, v in ids(kept).items() if k not in close} == {k: v for k, v in ids(after).items() if k not in close} and len(kept) < len(before)
    before, after = step("simhash_near_dedup")
    assert ids(after) == near_copies_kept(before) and len(after) < len(before)
    before, after = step("benchmark_decontamination")
    assert ids(after) == ids([x for x in before if not holds_item(x["text"], items)]) and len(after) < len(before)
    before, after = step("secret_scan")
    text = {x["doc_id"]: x["text"] and plain_mask(x["text"]) for x in before}
    assert ids(after) == ids(before) and all(x["text"] == text[x["doc_id"]] and x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in after)
    assert any("[SECRET]" in (x["text"] or "") for x in after)
    before, after = step("source_mixing")
    assert Counter((x["doc_id"], x["size"]) for x in after) == Counter((x["doc_id"], len((x["text"] or "").split())) for x in before)
    for s in {x["source"] for x in after}:
        own = [x for x in after if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own)


def test_stages_over_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "source_mixing" or out.columns == docs.columns)
