"""Symbols and dependencies of source files, as rows.

Python goes through the standard library's ``ast``; the other languages through patterns on the lines of
a declaration (up to its body) and bracket depth. That finds declarations as they are usually laid out; it
is no full grammar, and README lists what it misses.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parsed_language
from .rules import CALL, CONTAINERS, IMPORT_RULES, NO_CALLS, SYMBOL_RULES, import_targets

_QUIET = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', re.S)


def _python(source: str) -> tuple[list, list]:
    symbols, deps = [], []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return symbols, deps
    lines = source.split("\n")
    todo: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while todo:
        node, parent, function = todo.pop()
        if isinstance(node, ast.ClassDef):
            symbols.append((node.name, "class", node.lineno, node.end_lineno, lines[node.lineno - 1].strip().rstrip(":"), parent))
            parent = node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            symbols.append((node.name, "method" if parent else "function", node.lineno, node.end_lineno, lines[node.lineno - 1].strip().rstrip(":"), parent))
            function = node.name
        elif isinstance(node, ast.Import):
            deps.append((node.lineno, None, None, ", ".join(a.name + (f" as {a.asname}" if a.asname else "") for a in node.names), "imports"))
        elif isinstance(node, ast.ImportFrom):
            deps += [(node.lineno, None, "." * node.level + (node.module or ""), a.name, "imports") for a in node.names]
        elif isinstance(node, ast.Call):
            deps.append((node.lineno, function, None, ast.unparse(node.func), "calls"))
        todo += [(child, parent, function) for child in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, deps


_CONTINUED = re.compile(r"\s*(?:where\b|throws\b|->|\{|\)|:|extends\b|implements\b)")


def _last_line(bare: list[str], n: int) -> int:
    """The last line of what begins on line n: as far as its parentheses are open or the next line goes on before a body."""
    opened = bare[n - 1].count("(") - bare[n - 1].count(")")
    m = n
    while m < len(bare) and not ("{" in bare[m - 1] or ";" in bare[m - 1]) and (opened > 0 or _CONTINUED.match(bare[m]) or (m > n and bare[m - 1].rstrip().endswith((",", "where")))):
        m += 1
        opened += bare[m - 1].count("(") - bare[m - 1].count(")")
    return m


def _by_lines(source: str, language: str) -> tuple[list, list]:
    blank = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    raw, bare = source.split("\n"), blank.split("\n")
    symbols, deps, scopes, depth, held = [], [], [], 0, 0  # scopes: (depth inside, name, kind, index)
    for n, line in enumerate(bare, 1):
        if n <= held:  # inside a declaration of several lines
            depth += line.count("{") - line.count("}")
            continue
        last = _last_line(bare, n)
        whole = line if last == n else " ".join([line.rstrip(), *(x.strip() for x in bare[n:last])])
        inner = next((s for s in reversed(scopes) if s[2] in CONTAINERS.get(language, ())), None)
        function = next((s for s in reversed(scopes) if s[2] in ("function", "method")), None)
        for rule, kind in SYMBOL_RULES[language]:
            m = rule.match(whole)
            if not m:
                continue
            groups = m.groupdict()
            kind, parent = groups.get("kind") or kind, groups.get("parent") or (inner and inner[1])
            if kind == "method" and not parent:
                break
            kind = "method" if kind == "function" and parent and language == "rust" else kind
            symbols.append([groups["name"].strip(), kind, n, last, re.sub(r"(?s)\s*\{.*$", "", "\n".join(raw[n - 1 : last]).strip()), parent])
            held = last
            if whole.count("{") > whole.count("}"):
                scopes.append((depth + 1, re.sub(r"^.*\bfor\s+", "", groups["name"]).strip(), kind, len(symbols) - 1))
            function = None
            break
        else:
            deps += [(n, function and function[1], None, c["name"], "calls") for c in CALL.finditer(line) if c["name"] not in NO_CALLS]
        if (m := import_targets(language, raw[n - 1])) and IMPORT_RULES[language].match(raw[n - 1]):
            deps += [(n, None, path, name, "imports") for path, name in m]
        depth += line.count("{") - line.count("}")
        while held <= n and scopes and depth < scopes[-1][0]:
            symbols[scopes.pop()[3]][3] = n
    for scope in scopes:
        symbols[scope[3]][3] = len(raw)
    return [tuple(s) for s in symbols], deps


def extract(source: str | None, language: str | None) -> tuple[list, list]:
    """(symbols, deps) of one text; nothing for a null text or a language without extractor."""
    if not source or (language != "python" and language not in SYMBOL_RULES):
        return [], []
    return _python(source) if language == "python" else _by_lines(source, language)


def _rows(files: DataFrame, which: int, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *row) for path, source, language in zip(batch["path"], batch["source"], batch["language"], strict=True) for row in extract(source, language)[which]]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "source", parsed_language(F.col("path")).alias("language")).where("language is not null and source is not null").mapInPandas(run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of the files (path, source); line numbers start at 1 and include both ends."""
    columns = ["path", "name", "kind", "line_start", "line_end", "signature", "parent"]
    return _rows(files, 0, columns, "path string, name string, kind string, line_start int, line_end int, signature string, parent string")


def extract_deps(files: DataFrame) -> DataFrame:
    """One row per import and per call, repeated ones kept; calls hold the callee as written."""
    columns = ["source_path", "line", "source_symbol", "target_path", "target_symbol", "kind"]
    return _rows(files, 1, columns, "source_path string, line int, source_symbol string, target_path string, target_symbol string, kind string")
