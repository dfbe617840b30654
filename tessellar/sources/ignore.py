"""Ignore rules: patterns in the manner of git, as regular expressions, folded in order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str | None:
    """A regular expression that a whole relative path (a directory's ends in '/') must match; None for comments and blanks."""
    p = pattern.rstrip("\n")
    while p.endswith(" ") and not p.endswith("\\ "):
        p = p[:-1]
    if not p.strip() or p.startswith("#"):
        return None
    only_dirs = p.endswith("/")
    anchored = "/" in p.rstrip("/")
    p = p.strip("/") if not p.startswith("\\") else p.rstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif c == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j]
            body = "^" + body[1:] if body[0] in "!^" else body
            out, i = out + "[" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&") + "]", j + 1
        else:
            if c == "\\" and i + 1 < len(p):
                i += 1
                c = p[i]
            out, i = out + (c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/.*" if only_dirs else "(?:/.*)?")


def _read(path: Path) -> list[str]:
    lines = path.read_text(encoding="utf-8").splitlines() if path.is_file() else []
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]


@dataclass(frozen=True)
class IgnoreRules:
    """(regex, excludes) in order: the last rule that matches a path decides; rules of the override file come last."""

    rules: tuple[tuple[str, bool], ...]

    @staticmethod
    def of(baseline: list[str], overrides: list[str]) -> IgnoreRules:
        out = []
        for text in [*baseline, *overrides]:
            again = text.startswith("!")
            rx = pattern_regex(text[1:] if again else text)
            if rx:
                out.append((rx, not again))
        return IgnoreRules(tuple(out))

    @staticmethod
    def read(root: str | Path) -> IgnoreRules:
        return IgnoreRules.of(_read(Path(root) / ".gitignore"), _read(Path(root) / ".ignore"))

    def ignores(self, path: str) -> bool:
        out = False
        for rx, excludes in self.rules:
            if re.fullmatch(rx, path, re.S) or re.fullmatch(rx, path + "/", re.S):
                out = excludes
        return out

    def includes(self, path: str) -> bool:
        return not self.ignores(path)

    def ignored_column(self, path: Column) -> Column:
        """The same decision as a column."""
        out = F.lit(False)
        for rx, excludes in self.rules:
            whole = "(?s)^(?:" + rx + ")$"
            out = F.when(path.rlike(whole) | F.concat(path, F.lit("/")).rlike(whole), F.lit(excludes)).otherwise(out)
        return out


def fingerprint(root: str | Path) -> str:
    """A digest of both files' text; missing files count as empty."""
    import hashlib

    text = [p.read_text(encoding="utf-8") if (p := Path(root) / name).is_file() else "" for name in (".gitignore", ".ignore")]
    return hashlib.sha256("::".join(text).encode()).hexdigest()
