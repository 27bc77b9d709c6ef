"""Column functions on names, paths and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages of the overview (extension in lower case) and of the extractors (as written).
DISPLAY_LANGUAGES = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript (JSX)",
    "jsx": "JavaScript (JSX)", "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "C++", "cc": "C++",
    "cxx": "C++", "hpp": "C++", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin",
    "cs": "C#", "scala": "Scala", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "sql": "SQL", "html": "HTML",
    "htm": "HTML", "css": "CSS", "scss": "CSS", "sass": "CSS", "json": "JSON", "yaml": "YAML", "yml": "YAML",
    "toml": "TOML", "md": "Markdown", "markdown": "Markdown",
}
PARSED_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp",
}


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(path: Column) -> Column:
    """Text after the last dot of the whole path; without a dot the whole path."""
    return F.substring_index(path, ".", -1)


def display_language(path: Column) -> Column:
    return F.coalesce(_lookup(DISPLAY_LANGUAGES, F.lower(extension(path))), F.lit("Other"))


def parsed_language(path: Column) -> Column:
    """Language that the extractors use, or null. Case-sensitive."""
    return _lookup(PARSED_LANGUAGES, extension(path))


def first_segment(path: Column) -> Column:
    """First path segment: the repo, or the name itself of a file in the root."""
    return F.substring_index(path, "/", 1)


def contains_like(text: Column, pattern: str) -> Column:
    """``text LIKE '%pattern%'`` where % and _ are live, ASCII case is folded and nothing escapes."""
    parts = [{"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern]
    return text.rlike("(?is)" + "".join(parts))


def cap_bytes(text: Column, limit: int, marker: str = "\n…") -> Column:
    """At most ``limit`` UTF-8 bytes of a text, cut back to a character, with ``marker`` where cut. Null stays null."""
    raw = text.cast("binary")
    cut = F.lit("")
    for back in (3, 2, 1, 0):
        piece = F.substring(raw, 1, limit - back) if limit > back else F.lit(b"")
        cut = F.when(F.is_valid_utf8(piece.cast("string")), piece.cast("string")).otherwise(cut)
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit(marker))).otherwise(text)


def glob_words(pattern: Column) -> Column:
    """Words of a glob pattern: ** and then * / . become spaces; null where nothing is left."""
    spaced = F.regexp_replace(F.regexp_replace(pattern, r"\*\*", " "), r"[*/.]", " ")
    return F.nullif(F.trim(spaced), F.lit(""))


def split_lines(text: Column) -> Column:
    """Lines without their ends (\\n or \\r\\n); a final end opens no further line."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


# Letters that the text index treats as their base letter.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def terms(text: Column) -> Column:
    """Terms of the text index: folded runs of letters and digits; of null none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_words(text: str) -> list[list[str]]:
    """Bare words of a search text, each as the phrase of its terms (``a_b`` is the phrase a b)."""
    table = str.maketrans(_ACCENTED, _PLAIN)
    words = re.sub(r"[^\w ]", " ", text).split()
    phrases = [[t for t in re.split(r"[\W_]+", w.lower().translate(table)) if t] for w in words]
    return [p for p in phrases if p]


def query_tokens(text: str) -> list[str]:
    """Tokens for the exact-symbol boost: runs of letters, digits and _ of 3 bytes or more, case kept."""
    return list(dict.fromkeys(t for t in re.findall(r"\w+", text) if len(t.encode()) >= 3))
