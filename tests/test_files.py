"""Walking, parsing, chunking and the index over generated trees."""

import pandas as pd
import pytest

from tessellar import cli
from tessellar.operators.search import diverse_order
from tessellar.plans import models, render
from tessellar.plans.index import Index, RebuildNeeded
from tessellar.sources.files import analysed, by_directory, walk
from tessellar.sources.ignore import IgnoreRules
from tessellar.sources.parsing import symbols

MODEL = "ollama/test"


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return root


def pairs(code, lang):
    return [(k, n) for k, n, *_ in symbols(code, lang)]


def ranges(code, lang):
    return [(k, n, a, b) for k, n, _, a, b in symbols(code, lang)]


def test_python_symbols():
    code = "# A.\nclass Box:\n    @property\n    def size(self):\n        return 1\n\nasync def fetch(x):\n    return x\n"
    assert ranges(code, "python") == [("class", "Box", 2, 5), ("function", "size", 4, 5), ("function", "fetch", 7, 8)]
    assert [s[2] for s in symbols(code, "python")][2] == "async def fetch(x):"
    broken = "def ok(a):\n    return a\n\nclass Half(:\n    def inner(self):\n        pass\n"
    assert pairs(broken, "python") == [("function", "ok"), ("class", "Half"), ("function", "inner")]


def test_typescript_symbols():
    code = "// W.\nexport interface Shape {\n  id: string;\n}\n\nexport type Pair = { a: 1; b: 2 };\nexport enum Color { Red }\nexport const limit = 3, other = 'x';\nexport function make(id: string): Shape {\n  let inner = '}';\n  return { id };\n}\nclass Impl {\n  method() { return 1; }\n}\n"
    got = ranges(code, "typescript")
    assert ("interface", "Shape", 2, 4) in got and ("function", "make", 9, 12) in got and ("class", "Impl", 13, 15) in got
    assert {("type", "Pair"), ("enum", "Color"), ("constant", "limit"), ("constant", "other"), ("constant", "inner")} <= {g[:2] for g in got}
    assert ("function", "method") not in pairs(code, "typescript")
    by = {s[1]: s[2] for s in symbols(code, "typescript")}
    assert by["make"] == "function make(id: string): Shape {" and by["limit"] == "limit = 3"


def test_go_symbols():
    code = 'package p\n\ntype Srv struct {\n\tName string\n}\n\ntype Run interface {\n\tServe()\n}\n\ntype ID int\n\nfunc main() {\n\tx := "}"\n}\n\nfunc (s *Srv) Start(f func() error) error {\n\treturn nil\n}\n'
    assert ranges(code, "go") == [("struct", "Srv", 3, 5), ("interface", "Run", 7, 9), ("type", "ID", 11, 11), ("function", "main", 13, 15), ("function", "Start", 17, 19)]
    assert symbols(code, "go")[0][2] == "Srv struct {"


def test_rust_symbols():
    code = "pub fn foo<'a>(x: &'a str) -> &'a str { x }\n\npub struct Cfg {\n    x: i32,\n}\nenum E { A }\ntrait T {\n    fn need(&self);\n}\nimpl T for Cfg {\n    fn need(&self) {}\n}\nconst MAX: u8 = 3;\nmod inner {}\n"
    got = pairs(code, "rust")
    assert {("function", "foo"), ("struct", "Cfg"), ("enum", "E"), ("trait", "T"), ("impl", "T for Cfg"), ("constant", "MAX"), ("module", "inner")} <= set(got)
    assert got.count(("function", "need")) == 1
    assert ("struct", "Cfg", 3, 5) in ranges(code, "rust")


def test_kotlin_symbols():
    code = "package d\n\nfun hello(name: String): String {\n    return name\n}\n\ndata class User(val name: String)\n\ninterface Repo {\n    fun load(): User\n}\n\nobject One {\n    val x = 1\n}\n"
    got = ranges(code, "kotlin")
    assert {("function", "hello", 3, 5), ("class", "User", 7, 7), ("interface", "Repo", 9, 11), ("function", "load", 10, 10), ("object", "One", 13, 15)} <= set(got)
    assert ("property", "name") not in pairs(code, "kotlin")


def test_nested_generic_and_annotated_symbols():
    js = "export default class A extends B {\n  m() { const z = 1; }\n}\nconst f = async (x) => { let y = 2; return y; };\nfunction* gen() {}\nfor (const k of xs) {}\nfor (let i = 0; i < 3; i++) {}\nconst C = class D {};\nconst { a, b: [c] } = obj, e = () => { function deep() {} };\n"
    assert ranges(js, "javascript") == [("class", "A", 1, 3), ("constant", "z", 2, 2), ("constant", "f", 4, 4), ("constant", "y", 4, 4), ("constant", "i", 7, 7), ("constant", "C", 8, 8), ("function", "deep", 9, 9), ("constant", "e", 9, 9), ("constant", "{ a, b: [c] }", 9, 9)]
    ts = "export type Map2<K, V = string> = { [k in K]: V };\ndeclare function outer(a: string): void;\nfunction over(a: string): void;\nfunction over(a: any) { return a; }\nnamespace N { export interface I<T> { x: T } }\ntype Fn<T extends () => void = () => 1> = T\nlet type = 3\n"
    assert ranges(ts, "typescript") == [("type", "Map2", 1, 1), ("function", "over", 4, 4), ("interface", "I", 5, 5), ("type", "Fn", 6, 6), ("constant", "type", 7, 7)]
    go = "package p\ntype (\n\tA struct { X int }\n\tB = string\n\tC interface{ M() }\n\tD[T any] struct { v T }\n\tE func(int) (a int)\n)\nfunc Gen[T any](x T) T { return x }\nfunc (r *Recv[T]) Do(f func(int) error) (a int, err error) {\n\ttype inner int\n\treturn\n}\n"
    assert ranges(go, "go") == [("struct", "A", 3, 3), ("interface", "C", 5, 5), ("struct", "D", 6, 6), ("type", "E", 7, 7), ("function", "Gen", 9, 9), ("function", "Do", 10, 13), ("type", "inner", 11, 11)]
    rust = 'pub(crate) async unsafe fn a<T: Into<String>>(x: T) -> Option<T> where T: Copy { None }\nimpl<T> Foo<T> where T: X { pub const fn new() -> Self { Foo } const K: u8 = 1; }\npub struct Tup(u8, String);\nmacro_rules! mm { () => { fn hidden() {} } }\nextern "C" { fn ext(x: u8); }\nimpl<\'a> fmt::Display for E2<\'a> { fn fmt(&self) {} }\n'
    assert pairs(rust, "rust") == [("function", "a"), ("impl", "Foo<T>"), ("constant", "K"), ("function", "new"), ("struct", "Tup"), ("function", "fmt"), ("impl", "fmt::Display for E2<'a>")]
    kotlin = 'package a\n@Test\nclass A(val x: Int, @Inject private var y: String) : B() {\n    companion object { const val K = 1 }\n    @JvmStatic @Deprecated("x (y)") fun <T> m(a: T): T where T : Any = a\n    init { val local = 2 }\n    val q = foo(run { val inner = 1; inner })\n}\nsealed interface S\nobject O : P { var z = 3 }\n'
    assert ranges(kotlin, "kotlin") == [("class", "A", 2, 8), ("property", "K", 4, 4), ("function", "m", 5, 5), ("property", "local", 6, 6), ("property", "inner", 7, 7), ("property", "q", 7, 7), ("class", "S", 9, 9), ("object", "O", 10, 10), ("property", "z", 10, 10)]
    python = "@dec\nclass A(B):\n    @property\n    def x(self): return 1\n    async def y(self):\n        def z(): pass\n        return z\ndef long(\n    a,\n):\n    return lambda q: q\n"
    assert ranges(python, "python") == [("class", "A", 2, 7), ("function", "x", 4, 4), ("function", "y", 5, 7), ("function", "z", 6, 6), ("function", "long", 8, 11)]


def test_strings_and_comments_hide_declarations():
    assert pairs('// function a() {}\n/* class B {} */\nconst s = "function c() {}";\n', "javascript") == [("constant", "s")]
    assert symbols("x", "text") == []


def test_ignore_rules_order():
    r = IgnoreRules.of(["node_modules/", "*.log"], ["!node_modules/", "node_modules/private/"])
    assert r.includes("node_modules/public/index.js") and r.ignores("node_modules/private/index.js") and r.ignores("a/b.log") and r.includes("a/b.py")
    assert IgnoreRules.of(["/build", "doc/*.txt", "a/**/z"], []).ignores("build/x") and IgnoreRules.of(["/build"], []).includes("src/build")
    assert IgnoreRules.of(["a/**/z"], []).ignores("a/b/c/z") and IgnoreRules.of([], ["dist/"]).ignores("dist/app.js")


def test_walk(spark, tmp_path):
    put(tmp_path, {"a.py": "x=1\n", "pkg/b.ts": "", "pkg/deep/c.go": "", "pkg/deep/er/d.rs": "", "n.md": "# n", "x.bin": "", ".gitignore": "skip/\n", "skip/e.py": "", "__pycache__/f.py": "", "sp ace/g+h.py": ""})
    names = lambda **k: [r["relative_path"] for r in walk(spark, tmp_path, **k).orderBy("relative_path").collect()]
    assert names() == ["a.py", "pkg/b.ts", "pkg/deep/c.go", "sp ace/g+h.py"]
    assert names(depth=0) == ["a.py"] and names(depth=9, texts=True)[1] == "n.md"
    assert names(target="pkg", depth=0) == ["pkg/b.ts"] and names(target="n.md") == ["n.md"]
    assert {r["directory"]: list(r["paths"]) for r in by_directory(walk(spark, tmp_path, depth=1)).collect()}["."] == ["a.py"]
    with pytest.raises(ValueError):
        walk(spark, tmp_path / "pkg", "../a.py")
    with pytest.raises(FileNotFoundError):
        walk(spark, tmp_path, "none")


PROJECT = {
    "app/main.py": "# Entry point.\n# FEATURE: Demo.\nclass Greeter:\n    def greet(self):\n        return message_template()\n\ndef make_message(person):\n    return person\n",
    "app/consumer.py": "from main import Greeter\nitem = Greeter()\ngreeterName = 1\n",
    "src/widget.ts": "// Widget.\n// FEATURE: Demo.\nexport function buildWidget(id: string) {\n  return 'Greeter';\n}\n",
}


def test_renderings(spark, tmp_path):
    put(tmp_path, PROJECT)
    text = render.tree(spark, tmp_path)
    assert text.splitlines()[:6] == [f"{tmp_path.name}/", "  app/", "    consumer.py", "    main.py", "      header: Entry point. | FEATURE: Demo.", "      class Greeter [3-5]"]
    assert "class Greeter" not in render.tree(spark, tmp_path, symbols=False) and "header" not in render.tree(spark, tmp_path, max_tokens=1)
    assert render.skeleton(spark, tmp_path, "app/main.py").splitlines()[1:5] == ["language: python", "header:", "  - Entry point.", "  - FEATURE: Demo."]
    u = render.blast_radius(spark, tmp_path, "Greeter", "app/main.py")
    assert [(x["relative_path"], x["line_number"]) for x in u.usages] == [("app/consumer.py", 1), ("app/consumer.py", 2), ("src/widget.ts", 4)]
    assert u.definition["line_start"] == 3 and "usages: 3" in render.usage_report(u)
    assert render.tree_payload(spark, tmp_path)["directories"] == ["app", "src"]


def test_index_lifecycle(spark, tmp_path):
    root, cache = put(tmp_path / "p", {k: PROJECT[k] for k in ("app/main.py",)}), tmp_path / "cache"
    calls = []

    def fetch(texts):
        calls.append(len(texts))
        return [[float(len(t)), 1.0, float("widget" in t.lower())] for t in texts]

    at = Index(spark, root, MODEL, cache, fetch)
    assert not at.status().exists
    first = at.init()
    assert (first.indexed_files, first.code_chunks, first.identifier_docs, first.stale) == (1, 3, 3, False)
    put(root, {"docs/guide.md": "# One\ntext\n## Two\nmore\n"})
    assert at.status().changed_paths == ("docs/guide.md",)
    second = at.refresh()
    assert (second.indexed_files, second.code_chunks, second.identifier_docs) == (2, 5, 3)
    (root / "docs/guide.md").unlink()
    assert at.status().removed_paths == ("docs/guide.md",)
    third = at.ensure()
    assert (third.indexed_files, third.code_chunks) == (1, 3)
    assert at.store.table("embeddings").count() == 6
    put(root, {".ignore": "none\n"})
    with pytest.raises(RebuildNeeded):
        at.refresh()
    assert at.refresh(full=True).stale is False


def test_command_line(spark, tmp_path):
    root = put(tmp_path, PROJECT)
    base = ["--target-dir", str(root), "--cache-dir", str(tmp_path / "c")]
    text, payload = cli.run([*base, "search-code", "greet message", "--model", MODEL, "--top-k", "2"], spark)
    assert payload["matches"] and payload["matches"][0]["relative_path"] == "app/main.py" and "score=" in text
    text, payload = cli.run([*base, "search-identifiers", "build widget", "--model", MODEL], spark)
    assert payload["matches"][0]["name"] == "buildWidget"
    assert cli.run([*base, "index", "status", "--model", MODEL], spark)[0].startswith("Status: ready")
    with pytest.raises(cli.Refused) as e:
        cli.run([*base, "index", "init"], spark)
    assert e.value.code == "explicit_model_required"
    assert cli.run([*base, "index", "clear", "--all"], spark)[1]["cleared"] is True


def test_models():
    assert models.parse("ollama/a:b").namespace == "ollama_a_b" and models.parse("x/y").provider == "raw"
    assert models.requested(None, default="gemini").name == models.DEFAULT_MODELS["gemini"]
    assert models.vertex_environment({"VERTEX_LOCATION": "global"})["VERTEXAI_LOCATION"] == "us-central1"
    for wrong in (lambda: models.explicit("plain"), lambda: models.explicit("ollama/a", "gemini"), lambda: models.of_provider("none")):
        with pytest.raises(ValueError):
            wrong()


def test_symbol_and_text_chunks(spark, tmp_path):
    put(tmp_path, {"a.py": PROJECT["app/main.py"]})
    from tessellar.operators.chunking import chunked

    rows = chunked(analysed(walk(spark, tmp_path))).orderBy("ordinal").collect()
    assert [(r["kind"], r["start"], r["end"]) for r in rows] == [("class", 3, 5), ("function", 4, 5), ("function", 7, 8)]


def plain_order(m, k):
    """The diversity rules, row by row, over the whole list."""
    chosen, later = [], []
    rows = m.to_dict("records")
    key = lambda r: (r["end_line"] - r["start_line"], r["lexical"], r["semantic"], -r["start_line"])
    for i, r in enumerate(rows):
        gap = lambda c: max(0, max(c["start_line"], r["start_line"]) - min(c["end_line"], r["end_line"]))
        twin = next((c for c in chosen if c["relative_path"] == r["relative_path"] and abs(c["score"] - r["score"]) <= 0.03 and gap(c) <= 3), None)
        paths = {c["relative_path"] for c in chosen}
        if twin:
            if key(r) > key(twin):
                chosen[chosen.index(twin)] = r
                later.append(twin)
            else:
                later.append(r)
        elif r["relative_path"] in paths and any(x["relative_path"] not in paths and r["score"] - x["score"] <= 0.06 for x in rows[i + 1 :]):
            later.append(r)
        elif chosen and chosen[-1]["relative_path"] != r["relative_path"] and chosen[-1]["score"] - r["score"] <= 0.06 and key(r) > key(chosen[-1]):
            chosen.insert(-1, r)
        else:
            chosen.append(r)
    return [r["id"] for r in (chosen + later if len(chosen) < k else chosen)[:k]]


def test_diversity_matches_the_plain_rules():
    import random

    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 40)
        m = pd.DataFrame({"id": range(n), "relative_path": [f"f{r.randint(0, 4)}" for _ in range(n)], "start_line": [r.randint(1, 30) for _ in range(n)], "score": sorted((round(r.random() * 0.5, 3) for _ in range(n)), reverse=True), "lexical": [round(r.random(), 1) for _ in range(n)], "semantic": [round(r.random(), 1) for _ in range(n)]})
        m["end_line"] = m["start_line"] + [r.randint(0, 6) for _ in range(n)]
        assert diverse_order(m, 5)[0] == plain_order(m, 5)


def test_walk_takes_names_that_start_with_marks(spark, tmp_path):
    put(tmp_path, {"__init__.py": "", "_a/__main__.py": "x = 1\n", ".hidden/b.py": "", "c/d/e/f/g.py": "", ".ignore": "  c/d/e/f/  \n", ".git/h.py": "", "c/d/i.py": "", "c/d/e/j.py": "q"})
    rows = walk(spark, tmp_path, depth=9).orderBy("relative_path").collect()
    assert [(r["relative_path"], r["depth"], r["size_bytes"]) for r in rows] == [(".hidden/b.py", 1, 0), ("__init__.py", 0, 0), ("_a/__main__.py", 1, 6), ("c/d/e/j.py", 3, 1), ("c/d/i.py", 2, 0)]
    assert all(r["mtime_ns"] == (tmp_path / r["relative_path"]).stat().st_mtime_ns for r in rows)
    assert walk(spark, tmp_path, "c/d/e/f").count() == 0 and walk(spark, tmp_path, "c/d/e/f/g.py").count() == 0
    assert render.skeleton(spark, tmp_path, "__init__.py").endswith("symbols: none")


def test_queries_are_fetched_once(spark, tmp_path):
    import os

    from tessellar.operators.embedding import within

    log = tmp_path / "log"

    def fetch(texts):
        with log.open("a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [[float(len(t))] for t in texts]

    at = Index(spark, put(tmp_path / "p", {"a.py": "x = 1\n"}), MODEL, tmp_path / "cache", fetch)
    for _ in range(2):
        got = at.queries(["one", "three", "one"]).orderBy("query_id").collect()
        assert [(r["query"], list(r["vector"])) for r in got] == [("one", [3.0]), ("three", [5.0]), ("one", [3.0])]
    assert sorted(log.read_text().split()) == ["one", "three"]
    seen = []
    single = within(lambda texts: seen.append((len(texts), os.environ.get("TESSELLAR_T"))) or [[1.0]] * len(texts), {"TESSELLAR_T": "v"}, single=True)
    assert single(["a", "b"]) == [[1.0], [1.0]] and seen == [(1, "v"), (1, "v")] and "TESSELLAR_T" not in os.environ


def test_target_label(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.target_label(tmp_path.resolve()) == "." and cli.target_label(tmp_path.resolve() / "a/b") == "a/b"
    assert cli.target_label(tmp_path.resolve().parent) == tmp_path.resolve().parent.as_posix() and cli.target_label(tmp_path, "x/") == "x"


def test_store_keeps_the_version_before(spark, tmp_path):
    from tessellar.plans.store import Metadata, Store

    store, meta = Store(spark, str(tmp_path), "n"), Metadata("1", "p", "m", "1", "1", "f", "t")
    empty = lambda n: store.table(n)
    row = lambda h: spark.createDataFrame([("a.py", 1, 2, h)], "relative_path string, size_bytes long, mtime_ns long, content_hash string")
    seen = []
    for h in "abc":
        store.publish(meta, {"files": row(h), **{n: empty(n) for n in ("chunks", "identifiers", "embeddings", "symbols")}})
        seen.append(store.table("files"))
        assert [r["content_hash"] for t in seen[-2:] for r in t.collect()] == [*"abc"[max(0, len(seen) - 2) : len(seen)]]
    assert len(store.pointer.numbers()) == 2
    (tmp_path / "indexes/n/CURRENT-000000000004").write_text("{half")
    assert store.current() is None and store.pointer.read(1)["metadata"]["provider"] == "p"
