"""Scan of a source tree and the filters in front of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders, extensions and file names that are never indexed.
IGNORED_PARTS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "dist", "build", "target", ".next", ".nuxt", "out", "vendor", "evals",
)
IGNORED_EXTENSIONS = (
    "lock", "map", "png", "jpg", "jpeg", "gif", "ico", "svg", "pdf", "zip", "tar", "gz", "bin", "so", "dylib", "dll",
    "exe", "o", "a", "class", "pyc", "pyo", "db", "sqlite", "sqlite3",
)
IGNORED_SUFFIXES = (".min.js", ".min.css")
IGNORED_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock", ".DS_Store",
)
WATCH_IGNORED_PARTS = (".git", "node_modules", "target", ".venv", "__pycache__", "dist", "build", ".next", "vendor")
MAX_FILE_BYTES = 100_000
SNIFFED_BYTES = 8192


def has_part(path: Column, parts: tuple[str, ...]) -> Column:
    """Whether any component of the path, the file name included, is one of ``parts``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def indexable_path(path: Column) -> Column:
    """The path filters: ignored components, extensions, suffixes and names. Null paths are no files."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    suffix = F.lit(False)
    for s in IGNORED_SUFFIXES:
        suffix = suffix | F.endswith(name, F.lit(s))
    drop = has_part(path, IGNORED_PARTS) | extension.isin(*IGNORED_EXTENSIONS) | suffix | name.isin(*IGNORED_NAMES)
    return F.coalesce(~drop, F.lit(False))


def scan_tree(spark: SparkSession, root: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """All indexable files under ``root``: path, length, content, readable.

    Spark's file listing leaves out names that begin with . or _; such files and folders are read
    where ``hidden`` names them (paths or globs under ``root``, such as ``.github``). The size filter
    and the column list reach the source. Files with a NUL byte at the start are binary and left out; ``readable``
    is false where the bytes are no UTF-8 (such a file is reported and not indexed).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *(f"{root.rstrip('/')}/{h}" for h in hidden)])
    prefix = root.rstrip("/") + "/"
    rel = F.expr(f"substring(path, locate('{prefix}', path) + {len(prefix)})")
    head = F.substring("content", 1, SNIFFED_BYTES)
    return (
        raw.where(F.col("length") <= MAX_FILE_BYTES)
        .select(rel.alias("path"), "length", "content")
        .where(indexable_path(F.col("path")))
        .where(~F.contains(head, F.unhex(F.lit("00"))))
        .withColumn("readable", F.is_valid_utf8(F.col("content").cast("string")))
    )


def porcelain_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of ``git status --porcelain`` as rows of path and status.

    Lines of fewer than 4 bytes (and nulls) are skipped. The first two characters are the code, the
    rest from the fourth on is the path; a rename keeps ``old -> new``.
    """
    line = F.col(column)
    code = F.trim(F.substring(line, 1, 2))
    status = (
        F.when(code.isin("M", "MM", "AM"), "modified").when(code.isin("A", "??"), "added")
        .when(code == "D", "deleted").otherwise("modified")
    )
    return lines.where(F.octet_length(line) >= 4).select(F.trim(F.expr(f"substring(`{column}`, 4)")).alias("path"), status.alias("status"))
