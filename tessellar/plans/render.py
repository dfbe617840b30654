"""Trees, skeletons, usage reports and search results as text and as JSON values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, is_dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators import impact
from tessellar.sources.files import analysed, language, resolved, walk

TREE_TOKENS = 20_000


def _indent(path: str, extra: int = 0) -> str:
    return "  " * max(path.count("/") + extra + 1, 1)


def entries(spark: SparkSession, root: str | Path, target: str = ".", depth: int = 2) -> DataFrame:
    """(relative_path, language, header_lines, symbols) of the tree's files, by path. Read and parsed once for every rendering."""
    return analysed(walk(spark, root, target, depth)).select("relative_path", "language", "header_lines", "symbols").orderBy("relative_path")


def _tree_lines(name: str, rows: list, headers: bool, symbols: bool) -> list[str]:
    out, seen = [f"{name}/"], set()
    for r in rows:
        path = r["relative_path"]
        for folder in reversed(PurePosixPath(path).parents):
            f = folder.as_posix()
            if f != "." and f not in seen:
                seen.add(f)
                out.append(f"{_indent(f)}{folder.name}/")
        out.append(f"{_indent(path)}{PurePosixPath(path).name}")
        if headers and r["header_lines"]:
            out.append(f"{_indent(path, 1)}header: {' | '.join(r['header_lines'])}")
        if symbols:
            out += [f"{_indent(path, 1)}{s['kind']} {s['name']} [{s['line_start']}-{s['line_end']}]" for s in r["symbols"]]
    return out


def tree(spark: SparkSession, root: str | Path, target: str = ".", depth: int = 2, symbols: bool = True, max_tokens: int = TREE_TOKENS) -> str:
    """The tree with headers and symbols, or with less where that exceeds the budget of words."""
    rows = entries(spark, root, target, depth).collect()  # what is rendered
    text = ""
    for headers, with_symbols in ((True, symbols), (True, False), (False, False)):
        text = "\n".join(_tree_lines(Path(root).resolve().name, rows, headers, with_symbols))
        if max(1, len(text.split())) <= max_tokens:
            break
    return text


def tree_payload(spark: SparkSession, root: str | Path, target: str = ".", depth: int = 2, symbols: bool = True, max_tokens: int = TREE_TOKENS) -> dict:
    rows = entries(spark, root, target, depth).collect()  # what is shown
    files = [
        {"path": r["relative_path"], "language": r["language"], "header_lines": list(r["header_lines"]), "symbols": [s.asDict() for s in r["symbols"]] if symbols else []}
        for r in rows
    ]
    folders = sorted({f.as_posix() for r in rows for f in PurePosixPath(r["relative_path"]).parents} - {"."})
    return {
        "command": "tree", "depth_limit": depth, "directories": folders, "files": files, "include_symbols": symbols,
        "max_tokens": max_tokens, "root": Path(root).resolve().name, "target_path": target,
    }


def _one(spark: SparkSession, root: str | Path, path: str):
    base, at = resolved(root, path)
    rows = spark.createDataFrame([(at.relative_to(base).as_posix(), at.suffix.lower(), at.read_bytes())], "relative_path string, ext string, content binary")
    return analysed(rows).first()


def skeleton_payload(spark: SparkSession, root: str | Path, path: str) -> dict:
    r = _one(spark, root, path)
    return {"command": "skeleton", "file": {"header_lines": list(r["header_lines"]), "language": r["language"], "path": r["relative_path"], "symbols": [s.asDict() for s in r["symbols"]]}}


def skeleton(spark: SparkSession, root: str | Path, path: str) -> str:
    f = skeleton_payload(spark, root, path)["file"]
    out = [f"file: {f['path']}", f"language: {f['language']}"]
    if f["header_lines"]:
        out += ["header:", *(f"  - {h}" for h in f["header_lines"])]
    if not f["symbols"]:
        return "\n".join([*out, "symbols: none"])
    return "\n".join([*out, "symbols:", *(f"  - {s['kind']} {s['name']} [{s['line_start']}-{s['line_end']}] :: {s['signature']}" for s in f["symbols"])])


@dataclass(frozen=True)
class Usages:
    symbol_name: str
    file_context: str
    definition: dict | None
    usages: list[dict]


def blast_radius(spark: SparkSession, root: str | Path, symbol: str, context: str, depth: int = 99) -> Usages:
    """Where a symbol is named in code files other than the one that is said to define it."""
    base, at = resolved(root, context)
    if not at.is_file():
        raise FileNotFoundError(f"not a file: {at}")
    own = _one(spark, root, context)
    first = next((s.asDict() for s in own["symbols"] if s["name"] == symbol), None)
    files = analysed(walk(spark, base, depth=depth))
    found = impact.usages(files, symbol, own["relative_path"]).orderBy("relative_path", "line_number")
    return Usages(symbol, own["relative_path"], first, [r.asDict() for r in found.collect()])


def usage_report(u: Usages) -> str:
    d = u.definition
    out = [f"symbol: {u.symbol_name}", f"file_context: {u.file_context}", f"definition: {d['kind']} {d['name']} [{d['line_start']}-{d['line_end']}]" if d else "definition: not found"]
    if not u.usages:
        return "\n".join([*out, "usages: none"])
    return "\n".join([*out, f"usages: {len(u.usages)}", *(f"- {x['relative_path']}:{x['line_number']} :: {x['line_text']}" for x in u.usages)])


def status_report(s) -> str:
    if not s.exists:
        return "Index not found. Run `tessellar index init` first."
    state = "rebuild required" if s.rebuild_required else "stale" if s.stale else "ready"
    label = f"{s.provider}/{s.model}" if s.provider and s.model else s.model or "unknown"
    out = [f"Status: {state}", f"Index: {s.path}", f"Model: {label}", f"Indexed files: {s.indexed_files}", f"Code chunks: {s.code_chunks}", f"Identifier docs: {s.identifier_docs}"]
    out += [f"Changed paths: {', '.join(s.changed_paths)}"] * bool(s.changed_paths) + [f"Removed paths: {', '.join(s.removed_paths)}"] * bool(s.removed_paths)
    return "\n".join(out)


def _scores(m: dict) -> str:
    return f"score={m['score']:.4f} semantic={m['semantic']:.4f} lexical={m['lexical']:.4f}"


def code_report(matches: list[dict]) -> str:
    out = [x for m in matches for x in (f"{m['relative_path']}:{m['start_line']}-{m['end_line']} {_scores(m)}", f"  snippet: {m['snippet']}")]
    return "\n".join(out) or "No code matches found."


def identifier_report(matches: list[dict]) -> str:
    out = [x for m in matches for x in (f"{m['relative_path']}:{m['line_start']}-{m['line_end']} {m['kind']} {m['name']} {_scores(m)}", f"  signature: {m['signature']}")]
    return "\n".join(out) or "No identifier matches found."


def as_json(value) -> str:
    def plain(x):
        if is_dataclass(x) and not isinstance(x, type):
            return plain(asdict(x))
        if isinstance(x, Path):
            return x.as_posix()
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)

    return json.dumps(plain(value), indent=2, sort_keys=True)


__all__ = ["as_json", "blast_radius", "code_report", "identifier_report", "language", "skeleton", "status_report", "tree", "usage_report"]
