"""Symbols of source files: declarations and their line ranges, for six languages.

Python files are parsed by the standard library; where that fails, by indentation. The others are
scanned: strings and comments are blanked, declarations are found in what is left, and their ends by
matching brackets. Files that do not parse still give the declarations that can be recognised.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.functions.text import header_lines
from tessellar.operators.documents import SYMBOLS

Symbol = tuple[str, str, str, int, int]  # kind, name, signature, first and last line
NAME = r"[A-Za-z_$][\w$]*"


def blanked(code: str, lang: str) -> str:
    """code with strings and comments made blank, of the same length and with the same line feeds."""
    out, i, n = list(code), 0, len(code)
    nested = lang in ("rust", "kotlin")

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def quoted(at: int, mark: str, escapes: bool = True) -> int:
        k = at + len(mark)
        while k < n and not code.startswith(mark, k):
            if len(mark) == 1 and mark in "\"'" and code[k] == "\n" and lang != "rust":
                return k
            k += 2 if escapes and code[k] == "\\" else 1
        return k + len(mark)

    while i < n:
        c = code[i]
        if code.startswith("//", i):
            end = code.find("\n", i)
            end = n if end < 0 else end
        elif code.startswith("/*", i):
            end, depth = i + 2, 1
            while end < n and depth:
                if nested and code.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif code.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
        elif lang == "kotlin" and code.startswith('"""', i):
            end = quoted(i, '"""', False)
        elif lang == "rust" and (m := re.compile(r'b?r(#*)"').match(code, i)) and not (i and (code[i - 1].isalnum() or code[i - 1] == "_")):
            end = code.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
        elif c == '"':
            end = quoted(i, '"')
        elif c == "`" and lang in ("javascript", "typescript", "go"):
            end = quoted(i, "`", lang != "go")
        elif c == "'":
            if lang in ("rust", "kotlin", "go"):  # a character; otherwise a lifetime or a label
                m = re.compile(r"'(?:\\(?:u\{[^}]*\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'").match(code, i)
                end = m.end() if m else i + 1
            else:
                end = quoted(i, "'")
        elif c == "/" and lang in ("javascript", "typescript") and re.search(r"(?:^|[=(,:;!&|?{}\[\n]|\breturn)\s*$", "".join(out[max(0, i - 40) : i])) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(code, i)):
            end = m.end()
        else:
            i += 1
            continue
        blank(i, end)
        i = max(end, i + 1)
    return "".join(out)


def _closing(code: str, at: int) -> int:
    """The position after the bracket that closes the one at at (the end if there is none)."""
    depth = 0
    for k in range(at, len(code)):
        if code[k] in "([{":
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
            if depth == 0:
                return k + 1
    return len(code)


def _body_end(code: str, at: int, stop: str = ";") -> tuple[int, bool]:
    """(end, has a body) of a declaration whose head goes on at at: through its braces, or up to stop at the top level."""
    k = at
    while k < len(code):
        c = code[k]
        if c == "{":
            return _closing(code, k), True
        if c in "([":
            k = _closing(code, k)
            continue
        if c in stop or c in ")}]":
            return k + (c == ";"), False
        k += 1
    return len(code.rstrip()), False


def _expression_end(code: str, at: int, commas: bool) -> int:
    """The end of an expression: a semicolon or (if commas) a comma at the top level, a closing bracket, or a line end after which nothing continues it."""
    k = at
    while k < len(code):
        c = code[k]
        if c in "([{":
            k = _closing(code, k)
            continue
        if c in ")]};" or (commas and c == ","):
            break
        if c == "\n":
            before, after = code[at:k].rstrip(), code[k:].lstrip()
            goes_on = not before or before[-1] in "=+-*/%&|^<>?:,.(~!" or before.endswith("=>")
            if not goes_on and not re.match(r"[.?:+*/%&|^<>=,)\]]|-[^-]|instanceof\b|in\b|as\b", after):
                break
        k += 1
    return at + len(code[at:k].rstrip())


class _Lines:
    def __init__(self, code: str):
        self.code, self.starts = code, [0, *(m.end() for m in re.finditer("\n", code))]

    def symbol(self, kind: str, name: str, start: int, end: int) -> Symbol:
        import bisect

        text = self.code[start:end]
        row = lambda p: bisect.bisect_right(self.starts, p)
        return kind, name, text.split("\n", 1)[0].strip(), row(start), row(max(start, end - 1))


def _ecma(code: str, lang: str) -> Iterator[Symbol]:
    clean, lines = blanked(code, lang), _Lines(code)
    head = r"(?<![\w$.])"
    ahead = re.compile(r"(?:^|[;{}\n]|\bexport|\bdefault|\bdeclare)\s*$")
    rules = [("function", rf"{head}(?:async\s+)?function\s+({NAME})"), ("class", rf"{head}class\s+({NAME})")]
    if lang == "typescript":
        rules += [("interface", rf"{head}interface\s+({NAME})"), ("enum", rf"{head}(?:const\s+)?enum\s+({NAME})")]
    for kind, rx in rules:
        for m in re.finditer(rx, clean):
            if ahead.search(clean[max(0, m.start() - 60) : m.start()]):
                end, body = _body_end(clean, m.end())
                if body:
                    yield lines.symbol(kind, m[1], m.start(), end)
    if lang == "typescript":
        for m in re.finditer(rf"{head}type\s+({NAME})\s*(?=[<=])", clean):
            at = _parameters_end(clean, m.end())
            if clean[at : at + 1] == "=" and ahead.search(clean[max(0, m.start() - 60) : m.start()]):
                end = _expression_end(clean, at + 1, False)
                yield lines.symbol("type", m[1], m.start(), end + (clean[end : end + 1] == ";"))
    for m in re.finditer(rf"{head}(?:const|let)\s+(?!enum\b)", clean):
        at = m.end()
        while at < len(clean):
            at += len(clean[at:]) - len(clean[at:].lstrip())
            if clean[at : at + 1] in ("{", "["):
                name_end = _closing(clean, at)
            elif n := re.compile(NAME).match(clean, at):
                name_end = n.end()
            else:
                break
            end = _expression_end(clean, name_end, True)
            loop = re.search(r"\s+(?:of|in)\s", clean[name_end:end])
            if not loop or "=" in clean[name_end : name_end + loop.start()]:
                yield lines.symbol("constant", code[at:name_end], at, end)
            if clean[end : end + 1] != ",":
                break
            at = end + 1


def _parameters_end(clean: str, at: int) -> int:
    """The position after type parameters in angle brackets and blanks that begin at at; at itself where there are none."""
    depth, k = 0, at
    while k < len(clean):
        c = clean[k]
        if c == "<":
            depth += 1
        elif c == ">" and clean[k - 1] != "=":
            depth -= 1
        elif c in "([{":
            k = _closing(clean, k)
            continue
        elif not depth and not c.isspace():
            return k
        k += 1
    return k


def _go(code: str) -> Iterator[Symbol]:
    clean, lines = blanked(code, "go"), _Lines(code)
    for m in re.finditer(rf"(?m)^[ \t]*(func)\s+(?:\([^)]*\)\s*)?({NAME})\s*(?=[(\[])", clean):
        end, _ = _go_func_end(clean, m.end())
        yield lines.symbol("function", m[2], m.start(1), end)
    spec = re.compile(rf"\s*({NAME})(?:\[[^\]]*\])?\s+(?!=)")

    alias = re.compile(rf"\s*{NAME}(?:\[[^\]]*\])?\s+=")

    def one(at: int) -> tuple[Symbol | None, int] | None:
        """The declaration that begins at at (none for another name of a type) and its end."""
        m = spec.match(clean, at)
        if not m:
            return (None, _expression_end(clean, a.end(), False)) if (a := alias.match(clean, at)) else None
        kind = re.match(r"(struct|interface)\b", clean[m.end() :])
        end = _body_end(clean, m.end(), "\n;")[0] if kind else _expression_end(clean, m.end(), False)
        return lines.symbol(kind[1] if kind else "type", m[1], m.start(1), end), end

    for m in re.finditer(r"(?m)^[ \t]*type\b[ \t]*(\()?", clean):
        at = m.end()
        stop = _closing(clean, m.start(1)) - 1 if m[1] else at + 1
        while at < stop and (got := one(at)):
            if got[0]:
                yield got[0]
            at = got[1] + (clean[got[1] : got[1] + 1] == ";")


def _go_func_end(clean: str, at: int) -> tuple[int, bool]:
    k = at
    while k < len(clean):
        if clean[k] in "([":
            k = _closing(clean, k)
        elif clean[k] == "{":
            if re.search(r"\b(?:interface|struct)\s*$", clean[at:k]):
                k = _closing(clean, k)
            else:
                return _closing(clean, k), True
        elif clean[k] == "\n":
            return k, False
        else:
            k += 1
    return len(clean), False


def _without_macros(clean: str) -> str:
    """clean with what stands in the brackets of macros made blank: those are tokens, not declarations."""
    out, at = [], 0
    for m in re.finditer(r"\b\w+!\s*(?:\w+\s*)?(?=[(\[{])", clean):
        if m.end() >= at:
            end = _closing(clean, m.end())
            out += [clean[at : m.end() + 1], re.sub(r"[^\n]", " ", clean[m.end() + 1 : end - 1]), clean[end - 1 : end]]
            at = end
    return "".join(out) + clean[at:]


def _rust(code: str) -> Iterator[Symbol]:
    clean, lines = _without_macros(blanked(code, "rust")), _Lines(code)
    vis = r"(?<![\w'])(?:pub(?:\s*\([^)]*\))?\s+)?"
    items = [
        ("function", vis + rf"(?:(?:const|async|unsafe|extern(?:\s+(?:\"[^\"]*\"|\s+))?)\s+)*fn\s+({NAME})"),
        ("struct", vis + rf"struct\s+({NAME})"), ("enum", vis + rf"enum\s+({NAME})"),
        ("trait", vis + rf"(?:unsafe\s+)?trait\s+({NAME})"), ("type", vis + rf"type\s+({NAME})\s*(?:<[^=;]*>)?\s*="),
        ("constant", vis + rf"const\s+({NAME})\s*:"), ("module", vis + rf"mod\s+({NAME})"), ("static", vis + rf"static\s+(?:mut\s+)?({NAME})\s*:"),
    ]
    for kind, rx in items:
        for m in re.finditer(rx, clean):
            if kind in ("constant", "static", "type"):
                end = m.end()
                while end < len(clean) and clean[end] != ";":
                    end = _closing(clean, end) if clean[end] in "([{" else end + 1
                end += 1
            else:
                end, body = _body_end(clean, m.end())
                if kind == "function" and not body:
                    continue
            yield lines.symbol(kind, m[1], m.start(), end)
    for m in re.finditer(r"(?<![\w'])(?:unsafe\s+)?impl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*([^{;]+?)\s*(?:\bwhere\b[^{]*)?\{", clean):
        name = re.sub(r"\s+", " ", code[m.start(1) : m.end(1)])
        yield lines.symbol("impl", name, m.start(), _closing(clean, m.end() - 1))


def _kotlin(code: str) -> Iterator[Symbol]:
    clean, lines = blanked(code, "kotlin"), _Lines(code)
    note = r"@(?:\w+:)?[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s+"
    mods = rf"(?<![\w.@])((?:{note}|(?:public|private|internal|protected|open|abstract|final|sealed|data|enum|annotation|inline|value|inner|suspend|override|operator|infix|tailrec|external|const|lateinit|companion|actual|expect|fun(?=\s+interface))\s+)*)"
    around = _around(clean)
    name = r"(`[^`\n]+`|[A-Za-z_]\w*)"

    def end_of(at: int) -> int:
        k = at
        while k < len(clean):
            c = clean[k]
            if c in "([":
                k = _closing(clean, k)
            elif c == "{":
                return _closing(clean, k)
            elif c == "=":
                return _expression_end(clean, k + 1, False)
            elif c in ")};":
                return at + len(clean[at:k].rstrip())
            elif c == "\n" and not re.match(r"\s*(?:[:{=]|where\b)", clean[k:]) and clean[at:k].rstrip()[-1:] not in (",", ":"):
                return at + len(clean[at:k].rstrip())
            else:
                k += 1
        return len(clean.rstrip())

    for m in re.finditer(mods + r"fun\s+(?!interface\b)(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?" + name + r"\s*(?=\()", clean):
        yield lines.symbol("function", m[2].strip("`"), m.start(), end_of(m.end()))
    for m in re.finditer(mods + r"(class|interface|object)\s+" + name, clean):
        word = m[2] if m[2] == "object" or not m[1] else "class"
        yield lines.symbol(word, m[3].strip("`"), m.start(), end_of(m.end()))
    for m in re.finditer(mods + r"(?:val|var)\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?" + name, clean):
        if around[m.start()] != "(":
            yield lines.symbol("property", m[2].strip("`"), m.start(), end_of(m.end()))


def _around(clean: str) -> str:
    """For each position the innermost bracket that is open there; a blank outside of all."""
    out, open_ = [], [" "]
    for c in clean:
        if c in ")]}" and len(open_) > 1:
            open_.pop()
        out.append(open_[-1])
        if c in "([{":
            open_.append(c)
    return "".join(out)


def _python(code: str) -> Iterator[Symbol]:
    rows = code.split("\n")
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _indented(rows)
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield kind, node.name, rows[node.lineno - 1].strip(), node.lineno, node.end_lineno or node.lineno


def _indented(rows: list[str]) -> Iterator[Symbol]:
    for i, row in enumerate(rows):
        m = re.match(r"(\s*)(?:async\s+def|def|class)\s+([^\W\d]\w*)", row)
        if not m:
            continue
        last = i
        for k in range(i + 1, len(rows)):
            if rows[k].strip():
                if len(rows[k]) - len(rows[k].lstrip()) <= len(m[1]) and not rows[k].lstrip().startswith((")", "]", "}")):
                    break
                last = k
        yield "class" if row.lstrip().startswith("class") else "function", m[2], row.strip(), i + 1, last + 1


def symbols(code: str, lang: str) -> list[Symbol]:
    """Symbols by first line, then name. Unknown languages have none."""
    found = {"python": _python, "go": _go, "rust": _rust, "kotlin": _kotlin}.get(lang)
    if found is None and lang not in ("javascript", "typescript"):
        return []
    got = found(code) if found else _ecma(code, lang)
    return sorted(got, key=lambda s: (s[3], s[1], s[0], s[4]))


def parsed(files: DataFrame, content: str = "content", lang: str = "language") -> DataFrame:
    """files with header_lines and symbols; the parse runs where the file was read, on whole batches."""
    names = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("__symbols", T.ArrayType(T.StructType(_FIELDS)))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [[dict(zip(_NAMES, s, strict=True)) for s in symbols(c or "", g)] for c, g in zip(pdf[content], pdf[lang], strict=True)]
            yield pdf.assign(__symbols=pd.Series(rows, index=pdf.index, dtype=object))

    out = files.mapInPandas(run, schema)
    return out.select(*names, header_lines(content).alias("header_lines"), F.col("__symbols").cast(SYMBOLS).alias("symbols"))


_NAMES = ("kind", "name", "signature", "line_start", "line_end")
_FIELDS = [T.StructField(n, T.IntegerType() if n.startswith("line") else T.StringType()) for n in _NAMES]
