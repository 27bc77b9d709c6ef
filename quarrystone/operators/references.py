"""References to records that do not exist (problem 3).

Everything that happens to a key of a referred table is a signed change: +1 existence when a record
appears, -1 when it goes, +1 reference for each edge that names the key. Running totals along time
tell what existed when an edge was seen; plain totals tell which keys are orphans now. A change of a
file is signed against the last known status of its path (``file_state``), so totals of batches add up
however the changes were divided and in whatever order they arrived; no old row is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import previous_value, running_sum

DAY = 86_400
SEPARATOR = "\x00"  # stands in no path or name, so joined keys stay distinct


def bare_name(target: Column) -> Column:
    """Callee text after its last ``.``, ``::`` or ``->``."""
    return F.regexp_replace(target, r"(?s)^.*(?:\.|::|->)", "")


def _key(*parts: Column) -> Column:
    return F.concat_ws(SEPARATOR, *parts)


def _repo(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def _told(changes: DataFrame) -> DataFrame:
    return changes.where("path is not null and changed_at is not null and status is not null and status != 'hash-mismatch'")


def file_state(changes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(path, changed_at, change_id, there): the last known existence of each path (1 or 0).

    ``before`` is the state of earlier batches. The last change is the one with the greatest
    (changed_at, change_id), so a late row of an older change alters nothing. Rows are as in ``file_deltas``.
    """
    there = F.when(F.col("status") == "deleted", 0).otherwise(1).cast("bigint").alias("there")
    rows = _told(changes).select("path", "changed_at", "change_id", there)
    rows = rows if before is None else rows.unionByName(before)
    last = rows.groupBy("path").agg(F.max(F.struct("changed_at", "change_id", "there")).alias("v"))
    return last.select("path", "v.changed_at", "v.change_id", "v.there")


def state_deltas(after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(ref_table, key, existing): signed changes of existence from one file state to the next.

    The state before is taken off (-1 for what existed) and the state after put on, in one aggregation.
    """
    rows = after.select("path", "there")
    if before is not None:
        rows = rows.unionByName(before.select("path", (-F.col("there")).alias("there")))
    moved = rows.groupBy(F.col("path").alias("key")).agg(F.sum("there").alias("existing"))
    return moved.where("existing != 0").select(F.lit("files").alias("ref_table"), "key", "existing")


def file_deltas(changes: DataFrame) -> DataFrame:
    """(ref_table, key, at, existing) along the whole time line: +1 where a path comes to exist, -1 where it is deleted.

    ``hash-mismatch`` rows say nothing about existence and are left out, as are rows without path or
    time. Replayed rows (same change_id, path, status and changed_at) count once; of changes at the
    same time the one with the greatest change_id is the last. A time line starts with nothing:
    batches of changes are added up by ``file_state`` and ``state_deltas``.
    """
    state = _told(changes).groupBy("path", "changed_at").agg(F.max_by("status", "change_id").alias("status"))
    state = state.select("path", "changed_at", F.when(F.col("status") == "deleted", 0).otherwise(1).cast("bigint").alias("there"))
    moved = previous_value(state, ["path"], ["changed_at"], "changed_at", "there", "was", 30 * DAY)
    delta = F.col("there") - F.coalesce("was", F.lit(0))
    return moved.select(F.lit("files").alias("ref_table"), F.col("path").alias("key"), F.col("changed_at").alias("at"), delta.alias("existing")).where("existing != 0")


def symbol_deltas(symbols: DataFrame) -> DataFrame:
    """+1 at seen_at and -1 at gone_at for the key (path, name) and for the key (repo, name).

    A row is live from seen_at (inclusive) to gone_at (exclusive); a row that was never live, or
    lacks path, name or seen_at, changes nothing. The same symbol under several ids counts once per
    row, which the sign of the total does not mind.
    """
    live = symbols.where("path is not null and name is not null and seen_at is not null and (gone_at is null or gone_at > seen_at)")
    keys = F.explode(F.array(_key(F.lit("p"), F.col("path"), F.col("name")), _key(F.lit("r"), _repo(F.col("path")), F.col("name"))))
    both = F.explode(F.array(F.struct(F.col("seen_at").alias("at"), F.lit(1).cast("bigint").alias("existing")), F.struct(F.col("gone_at").alias("at"), F.lit(-1).cast("bigint").alias("existing"))))
    rows = live.select(both.alias("d"), "path", "name").where("d.at is not null").select("d.*", "path", "name")
    return rows.select(F.lit("symbols").alias("ref_table"), keys.alias("key"), "at", "existing")


def reference_rows(deps: DataFrame, externals: DataFrame) -> DataFrame:
    """(ref_table, key, at, dep_id): every key of a referred table that an edge names.

    Edges to an externals package, and edges without path to an externals builtin, name nothing.
    Edges without seen_at, or without the parts of the key, name nothing either. ``externals`` is
    a small fixed table; Spark decides by its size whether to broadcast it.
    """
    kinds = lambda k: externals.where(F.col("kind") == k).select("name").distinct()
    edges = deps.where("seen_at is not null").select("id", "source_path", "target_path", "target_symbol", "seen_at")
    with_path = edges.where("target_path is not null").join(kinds("package").withColumnRenamed("name", "target_path"), "target_path", "left_anti")
    without = edges.where("target_path is null").join(kinds("builtin").withColumnRenamed("name", "target_symbol"), "target_symbol", "left_anti")
    name = bare_name(F.col("target_symbol"))
    row = lambda table, key: F.struct(F.lit(table).alias("ref_table"), key.alias("key"))
    symbol_key = F.when(F.col("target_symbol").isNotNull() & (F.col("target_symbol") != "*"), _key(F.lit("p"), F.col("target_path"), name))
    a = with_path.select(F.explode(F.array(row("files", F.col("target_path")), row("symbols", symbol_key))).alias("r"), F.col("seen_at").alias("at"), F.col("id").alias("dep_id"))
    repo_key = _key(F.lit("r"), _repo(F.col("source_path")), name)
    b = without.where("source_path is not null and target_symbol is not null").select(row("symbols", repo_key).alias("r"), F.col("seen_at").alias("at"), F.col("id").alias("dep_id"))
    return a.unionByName(b).where("r.key is not null").select("r.*", "at", "dep_id")


def orphan_references(deps: DataFrame, symbols: DataFrame, changes: DataFrame, externals: DataFrame) -> DataFrame:
    """(ref_table, dep_id, at) of the references whose key had no existing record at seen_at.

    Changes and references form one time line per key; a reference sees all changes up to and
    including its own time. Keys are cut into slices of time (see ``timeline``), so a key with a
    third of all references does not end in one task. Empty tables: without changes every reference
    is an orphan, without deps there are no rows.
    """
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    changes_in = file_deltas(changes).unionByName(symbol_deltas(symbols)).withColumn("dep_id", none)
    refs = reference_rows(deps, externals).withColumn("existing", zero)
    # Only equality of keys matters from here on: 128 bits of hash stand for the two strings and keep
    # the shuffles small. Two unlike keys meet with a chance of 1e-16 among 1e11 keys.
    hashed = [F.xxhash64("ref_table", "key").alias("h"), F.xxhash64("key", F.lit(1), "ref_table").alias("g")]
    line = changes_in.unionByName(refs).select(*hashed, (F.col("ref_table") == "files").alias("is_file"), "at", "existing", "dep_id")
    counted = running_sum(line, ["h", "g"], "at", "existing", "total", 7 * DAY)
    table = F.when(F.col("is_file"), "files").otherwise("symbols").alias("ref_table")
    return counted.where("dep_id is not null and total <= 0").select(table, "dep_id", "at")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(ref_table, month, orphans): orphan references per referred table and month of seen_at."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return orphans.select("ref_table", "dep_id", month).distinct().groupBy("ref_table", "month").agg(F.count("*").alias("orphans"))


def key_totals(*batches: DataFrame) -> DataFrame:
    """Signed totals (ref_table, key, refs, existing) of batches of deltas (``state_deltas``, ``symbol_deltas``, references) or of earlier totals."""
    fill = lambda b, c: F.col(c) if c in b.columns else F.lit(0).cast("bigint").alias(c)
    rows = [b.select("ref_table", "key", fill(b, "refs"), fill(b, "existing")) for b in batches]
    return reduce(DataFrame.unionByName, rows).groupBy("ref_table", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def current_orphans(deps: DataFrame, symbols: DataFrame, changes: DataFrame, externals: DataFrame) -> DataFrame:
    """(ref_table, key, refs): keys with references and no existing record now."""
    refs = reference_rows(deps, externals).groupBy("ref_table", "key").agg(F.count("*").alias("refs"))
    totals = key_totals(refs, state_deltas(file_state(changes)), symbol_deltas(symbols))
    return totals.where("refs > 0 and existing <= 0").select("ref_table", "key", "refs")
