"""The command line: trees, skeletons, index maintenance, searches, usage reports."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessellar import __version__
from tessellar.functions.scoring import SearchOptions
from tessellar.plans import index as indexes
from tessellar.plans import models, render
from tessellar.sources.files import INDEX_DEPTH


class Refused(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessellar", description="Index and search code and text on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--json", action="store_true")
    p.add_argument("--target-dir", default=".")
    p.add_argument("--cache-dir")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, of=sub, depth: int | None = None, model: bool = False):
        c = of.add_parser(name)
        if depth is not None:
            c.add_argument("--depth-limit", type=int, default=depth)
        if model:
            c.add_argument("--model")
            c.add_argument("--target-dir", dest="own_target")
        return c

    t = command("tree", depth=2)
    t.add_argument("path", nargs="?", default=".")
    t.add_argument("--include-symbols", dest="symbols", action="store_true", default=True)
    t.add_argument("--no-symbols", dest="symbols", action="store_false")
    t.add_argument("--max-tokens", type=int, default=render.TREE_TOKENS)
    command("skeleton").add_argument("file")
    i = sub.add_parser("index").add_subparsers(dest="action", required=True)
    command("init", i, INDEX_DEPTH, True)
    command("status", i, INDEX_DEPTH, True)
    command("refresh", i, INDEX_DEPTH, True).add_argument("--full", action="store_true")
    command("clear", i, model=True).add_argument("--all", action="store_true")
    for name in ("search-code", "search-identifiers"):
        s = command(name, depth=8, model=True)
        s.add_argument("query")
        s.add_argument("--top-k", type=int, default=5)
    b = command("blast-radius", depth=99)
    b.add_argument("symbol")
    b.add_argument("file")
    return p


def _model(a: argparse.Namespace, command: str) -> models.Model:
    if not (a.model or "").strip():
        raise Refused("explicit_model_required", f"--model provider/model is required for `{command}`.")
    try:
        return models.explicit(a.model)
    except ValueError as e:
        raise Refused("invalid_arguments", str(e)) from e


def target_label(target: Path, given: str | None = None) -> str:
    """How a search names its tree: as it was given with the command, else by its way from the working folder if it lies below that."""
    if given is not None:
        return Path(given).as_posix()
    here = Path.cwd().resolve()
    return (target.relative_to(here) if here in (target, *target.parents) else target).as_posix()


def run(argv: list[str], spark: SparkSession | None = None, fetch=None) -> tuple[str, dict]:
    """(text, payload) of a command. Refused is raised for wrong selections and for indexes that cannot be used."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessellar").getOrCreate()
    root = Path(a.target_dir).resolve()
    own = getattr(a, "own_target", None)
    target = root if own in (None, ".") else (root / own).resolve()
    cache = Path(a.cache_dir) if a.cache_dir else root / ".tessellar"
    more = {} if fetch is None else {"fetch": fetch}

    if a.command == "tree":
        given = (a.path, a.depth_limit, a.symbols, a.max_tokens)
        return render.tree(spark, root, *given) if not a.json else "", render.tree_payload(spark, root, *given) if a.json else {}
    if a.command == "skeleton":
        return render.skeleton(spark, root, a.file), render.skeleton_payload(spark, root, a.file) if a.json else {}
    if a.command == "blast-radius":
        u = render.blast_radius(spark, root, a.symbol, a.file, a.depth_limit)
        return render.usage_report(u), {"command": a.command, "definition": u.definition, "depth_limit": a.depth_limit, "file_context": u.file_context, "symbol_name": u.symbol_name, "usages": u.usages}

    if a.command == "index" and a.action == "clear":
        if a.all and (a.model or "").strip():
            raise Refused("invalid_arguments", "Pass either `--model provider/model` or `--all`, not both.")
        if not a.all:
            _model(a, "index clear")
        cleared = indexes.clear(spark, cache, None if a.all else a.model)
        return "Index cleared." if cleared else "No index found.", {"command": "index", "subcommand": "clear", "cleared": cleared}

    name = f"index {a.action}" if a.command == "index" else a.command
    at = indexes.Index(spark, target, _model(a, name), cache, depth=a.depth_limit, **more)
    try:
        if a.command == "index":
            status = {"init": at.init, "status": at.status, "refresh": lambda: at.refresh(a.full)}[a.action]()
            lead = {"init": "Index initialized.\n", "status": "", "refresh": "Index rebuilt.\n" if getattr(a, "full", False) else "Index refreshed.\n"}[a.action]
            return lead + render.status_report(status), {"command": "index", "subcommand": a.action, "status": status}
        find = at.search_code if a.command == "search-code" else at.search_identifiers
        matches = [r.asDict() for r in find(a.query, SearchOptions(top_k=a.top_k)).collect()]
    except indexes.IndexMissing as e:
        raise Refused("index_not_found", str(e)) from e
    except indexes.RebuildNeeded as e:
        raise Refused("full_rebuild_required", str(e)) from e
    show = render.code_report if a.command == "search-code" else render.identifier_report
    payload = {"command": a.command, "depth_limit": a.depth_limit, "matches": matches, "model": at.model.name, "provider": at.model.provider, "query": a.query, "target_dir": target_label(target, own), "top_k": a.top_k}
    return show(matches), payload


def main() -> int:
    as_json = "--json" in sys.argv
    try:
        text, payload = run(sys.argv[1:])
    except Refused as e:
        print(render.as_json({"error": {"code": e.code, "message": str(e)}}) if as_json else f"Error: {e}", file=sys.stderr)
        return 1
    print(render.as_json(payload) if as_json else text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
