"""Look-ups and one-hop patterns on the symbol graph (symbols are vertices, deps are edges)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_like

SYMBOL_COLUMNS = ("name", "kind", "path", "line_start", "line_end", "signature", "parent")
EDGE_KINDS = ("calls", "imports")
SLICE_EDGES = 4096  # edges to one bare name whose pairs are made together; more are divided


def find_symbols(symbols: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    """Symbols whose name contains the pattern, in order of path and line."""
    found = symbols.where(contains_like(F.col("name"), pattern))
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy("path", "line_start", "id")


def callers(deps: DataFrame, symbol: str) -> DataFrame:
    """One row per call site whose callee text is exactly ``symbol``."""
    return deps.where((F.col("target_symbol") == symbol) & (F.col("kind") == "calls"))


def callees(deps: DataFrame, symbol: str) -> DataFrame:
    return deps.where((F.col("source_symbol") == symbol) & (F.col("kind") == "calls"))


def imports(deps: DataFrame, path: str) -> DataFrame:
    return deps.where((F.col("source_path") == path) & (F.col("kind") == "imports"))


def imports_per_file(deps: DataFrame) -> DataFrame:
    """(source_path, n_imports, n_targets): import edges of each file and the distinct paths they name."""
    found = deps.where(F.col("kind") == "imports")
    return found.groupBy("source_path").agg(F.count("*").alias("n_imports"), F.countDistinct("target_path").alias("n_targets"))


def importers(deps: DataFrame, path: str) -> DataFrame:
    return deps.where((F.col("target_path") == path) & (F.col("kind") == "imports"))


def chunk_for_symbol(chunks: DataFrame, symbol: str) -> DataFrame:
    """The chunk of a symbol; of several the one with the least id."""
    return chunks.where(F.col("symbol") == symbol).orderBy("id").limit(1)


def suggestions(symbols: DataFrame, pattern: str, limit: int = 5) -> DataFrame:
    """First ``limit`` distinct names that contain the pattern, in order of path and line."""
    first = F.min(F.struct("path", "line_start", "id")).alias("first")
    return symbols.where(contains_like(F.col("name"), pattern)).groupBy("name").agg(first).orderBy("first", "name").limit(limit).select("name")


def _conditions(where: list[tuple[str, str, str]]) -> Column:
    """(property, "=" or "contains", value) conditions, all of which must hold. Numbers compare as numbers."""
    tests = []
    for prop, op, value in where:
        if prop not in SYMBOL_COLUMNS:
            raise ValueError(f"unknown property: {prop}")
        if op not in ("=", "contains"):
            raise ValueError(f"unknown comparison: {op}")
        col = F.col(prop)
        if op == "contains":
            tests.append(contains_like(col.cast("string"), value))
        elif prop.startswith("line_"):
            tests.append(col.cast("double") == F.lit(value.strip()).try_cast("double"))
        else:
            tests.append(col == value)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def match_nodes(symbols: DataFrame, label: str | None = None, where: list[tuple[str, str, str]] = (), limit: int | None = None) -> DataFrame:
    """Symbols of a kind (the label, in any case) that meet all conditions; unknown kinds match nothing."""
    found = symbols.where(_conditions(list(where)))
    found = found if label is None else found.where(F.col("kind") == label.lower())
    return found if limit is None else found.limit(limit)


def returned(rows: DataFrame, items: list[str], limit: int | None = None) -> DataFrame:
    """Chosen parts of matched rows: ``a`` is the whole symbol, ``a.name`` one property; repeated items come once.

    Columns are named like the items. ``rows`` has a struct column per variable.
    """
    for item in items:
        variable, _, prop = item.partition(".")
        if variable not in rows.columns or (prop and prop not in SYMBOL_COLUMNS):
            raise ValueError(f"unknown item: {item}")
    out = rows.select(*[F.col(i).alias(i) for i in dict.fromkeys(items)])
    return out if limit is None else out.limit(limit)


def _with_sources(edges: DataFrame, a: DataFrame) -> DataFrame:
    """The edges with each symbol that they leave; a null source_symbol stands for every symbol of the file."""
    exact = edges.where("source_symbol is not null").join(a, (F.col("source_symbol") == F.col("a.name")) & (F.col("source_path") == F.col("a.path")))
    whole_file = edges.where("source_symbol is null").join(a, F.col("source_path") == F.col("a.path"))
    return exact.unionByName(whole_file)


def _with_named(sourced: DataFrame, b: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``sourced`` with every symbol b of their target_symbol, in any file.

    The edges of a name times its symbols can be far more rows than both, so nothing is shuffled after
    this join. A name with more than SLICE_EDGES edges is divided into slices by the source, and its
    symbols are sent to each of them; such names, at most one in SLICE_EDGES of ``edges``, are broadcast.
    """
    counts = edges.groupBy(F.col("target_symbol").alias("often")).agg(F.count("*").alias("n")).where(F.col("n") > SLICE_EDGES)
    often = F.broadcast(counts.select("often", F.ceil(F.col("n") / SLICE_EDGES).alias("slices")))
    slices = F.coalesce(F.col("slices"), F.lit(1).cast("long"))
    left = sourced.join(often, F.col("target_symbol") == F.col("often"), "left").withColumn("part", F.pmod(F.xxhash64("a.name", "a.path"), slices))
    right = b.join(often, F.col("b.name") == F.col("often"), "left").select("b", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("in_part"))
    return left.join(right, (F.col("target_symbol") == F.col("b.name")) & (F.col("part") == F.col("in_part")))


def match_edges(
    symbols: DataFrame,
    deps: DataFrame,
    kind: str,
    source: tuple[str | None, list] = (None, []),
    target: tuple[str | None, list] = (None, []),
    limit: int | None = None,
) -> DataFrame:
    """Rows (a, b) for each edge of ``kind`` from a symbol a to a symbol b.

    ``source`` and ``target`` are (label, conditions) as in ``match_nodes``; a and b are structs of
    the symbol columns. A null source_symbol stands for every symbol of the source file and a null
    target_path for every symbol of that name, wherever it is; repeated edges and symbols multiply
    rows (bag semantics). Each null case is an equi join of its own, so no join has an OR in its
    condition and AQE can split skewed keys. Names without a path are looked up last, as their pairs
    may grow with the square of the tables.
    """
    if kind.lower() not in EDGE_KINDS:
        raise ValueError(f"unknown edge: {kind}")
    pack = F.struct(*[F.col(c) for c in SYMBOL_COLUMNS])
    a = match_nodes(symbols, *source).select(pack.alias("a"))
    b = match_nodes(symbols, *target).select(pack.alias("b"))
    edges = deps.where(F.col("kind") == kind.lower()).select("source_path", "source_symbol", "target_path", "target_symbol")
    exact, bare = edges.where("target_path is not null"), edges.where("target_path is null")
    reached = exact.join(b, (F.col("target_symbol") == F.col("b.name")) & (F.col("target_path") == F.col("b.path")))
    found = _with_sources(reached, a).select("a", "b").unionByName(_with_named(_with_sources(bare, a), b, bare).select("a", "b"))
    return found if limit is None else found.limit(limit)


def nested_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object of its struct columns; nulls are kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def key_symbols(symbols: DataFrame, deps: DataFrame, limit: int = 10) -> DataFrame:
    """Most-called symbols: calls whose callee text is the bare name, times the symbol's rows.

    Calls are counted per callee and symbols per (name, kind, path) before they meet, so the join
    sees one row per name instead of one per call.
    """
    calls = deps.where("kind = 'calls'").groupBy(F.col("target_symbol").alias("name")).agg(F.count("*").alias("n"))
    rows = symbols.groupBy("name", "kind", "path").agg(F.count("*").alias("m"))
    counted = rows.join(calls, "name").select("name", "kind", "path", (F.col("m") * F.col("n")).alias("calls"))
    return counted.orderBy(F.desc("calls"), "name", "kind", "path").limit(limit)


def dead_code(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """Functions and methods that no call names, outside paths with ``test`` in them, in order of path and line."""
    called = deps.where("kind = 'calls'").select(F.col("target_symbol").alias("name")).distinct()
    live = (F.col("kind").isin("function", "method")) & ~F.col("name").isin("main", "new", "default")
    return symbols.where(live & ~F.col("path").rlike("(?i)test")).join(called, "name", "left_anti").orderBy("path", "line_start", "id")


def dead_code_count(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: the number of rows of ``dead_code``."""
    return dead_code(symbols, deps).agg(F.count("*").alias("dead"))


def entry_points(symbols: DataFrame, name: str = "main", parts: tuple[str, ...] = ("entry", "start")) -> DataFrame:
    """Symbols of that name or with one of ``parts`` in theirs, as ``name (kind) in path``."""
    hit = reduce(lambda a, b: a | b, [contains_like(F.col("name"), p) for p in parts], F.col("name") == name)
    return symbols.where(hit).select(F.concat("name", F.lit(" ("), "kind", F.lit(") in "), "path").alias("label"))


def graph_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.concat_ws("::", "path", "name").alias("node_id"), "name", "kind", "path")


def graph_edges(deps: DataFrame) -> DataFrame:
    return deps.where("source_symbol is not null").select(F.col("source_symbol").alias("source"), F.col("target_symbol").alias("target"), "kind")


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are node ids."""
    ids = nodes.select("node_id").distinct()
    kept = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
