"""Patterns that find symbols, imports and calls in a line of source, per language."""

from __future__ import annotations

import re

_W = r"[A-Za-z_$][\w$]*"


def _rules(*pairs: tuple[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(pattern), kind) for pattern, kind in pairs]


_JS = _rules(
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_W})", "function"),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_W})", "class"),
    (rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_W})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_W})[^=;]*=>", "function"),
    (rf"^\s+(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<name>{_W})\s*\([^;{{]*\)\s*(?::[^{{;]+)?\{{", "method"),
)
_C = _rules(
    (r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)", "struct"),
    (r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)", "enum"),
    (r"^(?!\s*(?:return|else|if|for|while|switch|typedef)\b)[A-Za-z_][\w\s*&<>:,]*?[\s*&](?P<name>\w+)\s*\([^;{]*\)\s*\{", "function"),
)
SYMBOL_RULES = {
    "rust": _rules(
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)[^;]*$", "function"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait|type)\s+(?P<name>\w+)", ""),
        (r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?P<name>[\w<>:, ]+?)\s*(?:where\b.*)?\{", "impl"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<name>\w+)\s*:", "const"),
    ),
    "javascript": _JS,
    "typescript": _JS,
    "go": _rules(
        (r"^func\s+\(\s*(?:\w+\s+)?\*?(?P<parent>\w+)[^)]*\)\s*(?P<name>\w+)", "method"),
        (r"^func\s+(?P<name>\w+)", "function"),
        (r"^\s*type\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\b", ""),
        (r"^\s*type\s+(?P<name>\w+)\s", "type"),
    ),
    "java": _rules(
        (r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?P<kind>class|interface|enum)\s+(?P<name>\w+)", ""),
        (r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.? ]+\s(?P<name>\w+)\s*\([^;]*\)[^;]*\{", "method"),
    ),
    "c": _C,
    "cpp": _C,
}
CONTAINERS = {"rust": {"impl", "trait", "struct"}, "javascript": {"class"}, "typescript": {"class"}, "java": {"class", "interface", "enum"}}
IMPORT_RULES = {
    "rust": re.compile(r"^\s*use\s+(?P<a>[^;]+);"),
    "javascript": re.compile(r"""^\s*import\s+(?:(?P<a>[^'"]+?)\s+from\s+)?['"](?P<b>[^'"]+)['"]"""),
    "go": re.compile(r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<b>[\w./-]+)"\s*$"""),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<a>[\w.*]+)\s*;"),
    "c": re.compile(r"""^\s*#\s*include\s+[<"](?P<a>[^>"]+)[>"]"""),
}
IMPORT_RULES |= {"typescript": IMPORT_RULES["javascript"], "cpp": IMPORT_RULES["c"]}
CALL = re.compile(rf"(?<![\w$.:>])(?P<name>{_W}(?:(?:\.|::|->){_W})*)\s*\((?!\s*\{{)")
NO_CALLS = frozenset(
    "if for while switch match catch return sizeof function fn func def class new typeof await yield in of else do super".split()
)


def import_targets(language: str, line: str) -> list[tuple[str | None, str]]:
    """(path, symbol) pairs that an import line brings in."""
    m = IMPORT_RULES[language].match(line)
    if not m:
        return []
    if language == "rust":
        text = m["a"].strip()
        if "{" in text:
            base, inner = text.split("{", 1)
            base = base.rstrip(":").strip()
            names = [x.split(" as ")[0].strip() for x in inner.rstrip("} ").split(",")]
            return [(base, n) for n in names if n and n != "*"]
        base, _, name = text.split(" as ")[0].strip().rpartition("::")
        return [] if name == "*" else [(base or None, name)]
    if language == "java":
        base, _, name = m["a"].rpartition(".")
        return [(base or None, name)]
    if language in ("c", "cpp"):
        return [(None, m["a"])]
    path = m["b"]
    if language == "go":
        return [(path, path.rsplit("/", 1)[-1])]
    if not m["a"]:
        return [(path, path.rsplit("/", 1)[-1])]
    named = re.sub(r"\*\s*as\s+", "", m["a"]).replace("{", ",").replace("}", ",")
    return [(path, n.split(" as ")[0].strip()) for n in named.split(",") if n.strip()]
