"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from . import mixing, origin, packing, secrets, split, stuffing, syntax
from .tokens import TOKEN_PATTERN, setting

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- problem 1: credentials -----------------------------------------------------------------------


@query
def p1_found(s: SparkSession, d: str) -> DataFrame:
    found = secrets.places(read(s, d, "chunks"))
    return found.select("chunk_id", F.explode("line_nos").alias("line_no")).distinct()


@query
def p1_redacted(s: SparkSession, d: str) -> DataFrame:
    return secrets.places(read(s, d, "chunks")).select("chunk_id", F.size("line_nos").alias("n_places"), "redacted")


# -- problem 2: oversized items -------------------------------------------------------------------


def _pieces(s: SparkSession, d: str) -> DataFrame:
    meta = read(s, d, "meta")
    return split.pieces(read(s, d, "chunks"), int(setting(meta, "split.max_bytes", "6000")), int(setting(meta, "split.overlap_bytes", "240")))


@query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return _pieces(s, d).where("n_pieces > 1").select("chunk_id").distinct()


@query
def p2_pieces(s: SparkSession, d: str) -> DataFrame:
    return _pieces(s, d)


@query
def p2_reassembled(s: SparkSession, d: str) -> DataFrame:
    """Pieces without their overlaps put together again: bytes and hash of each oversized text, and the largest piece's excess over the limit."""
    own = F.substring(F.col("piece").cast("binary"), F.col("overlap_bytes") + 1, F.col("n_bytes")).cast("string")
    listed = F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own"))))
    text = F.array_join(F.transform(listed, lambda p: p["own"]), "")
    whole = _pieces(s, d).groupBy("chunk_id").agg(text.alias("t"), F.max(F.greatest(F.col("n_bytes") - 6000, F.col("overlap_bytes") - 240, F.lit(0))).alias("excess"))
    return whole.select("chunk_id", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("sha256"), "excess")


# -- problem 6: containers ------------------------------------------------------------------------


def _packed(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    meta = read(s, d, "meta")
    capacity = int(setting(meta, "pack.capacity_tokens", "2048"))
    items = packing.sized(read(s, d, "documents"), setting(meta, "token.pattern", TOKEN_PATTERN))
    return packing.pack(items, capacity), capacity


@query
def p6_containers(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d)[0]


@query
def p6_items(s: SparkSession, d: str) -> DataFrame:
    """Tokens and parts of every packed document."""
    packed, _ = _packed(s, d)
    return packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("parts"))


@query
def p6_overfull(s: SparkSession, d: str) -> DataFrame:
    """One row: tokens packed, and containers that hold more than their capacity."""
    packed, capacity = _packed(s, d)
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return filled.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > capacity).alias("overfull"))


@query
def p6_report(s: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(*_packed(s, d))


# -- problem 8: stuffed pages ---------------------------------------------------------------------


@query
def p8_found(s: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(read(s, d, "documents")).select("doc_id").distinct()


@query
def p8_report(s: SparkSession, d: str) -> DataFrame:
    found = stuffing.stuffed_pages(read(s, d, "documents"))
    return found.groupBy("lang").agg(F.countDistinct("doc_id").alias("pages"), F.round(F.avg("stuffed_share"), 3).alias("mean_share"))


# -- problem 5: files that do not parse -----------------------------------------------------------


@query
def p5_found(s: SparkSession, d: str) -> DataFrame:
    return syntax.file_verdicts(read(s, d, "chunks"), read(s, d, "files")).where("verdict != 'ok'").select("path")


@query
def p5_rates(s: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.file_verdicts(read(s, d, "chunks"), read(s, d, "files")))


# -- problem 4: generated, minified, vendored files and data --------------------------------------


@query
def p4_found(s: SparkSession, d: str) -> DataFrame:
    return origin.origins(read(s, d, "chunks"), read(s, d, "files")).select("path")


@query
def p4_origins(s: SparkSession, d: str) -> DataFrame:
    return origin.origins(read(s, d, "chunks"), read(s, d, "files")).groupBy("origin").agg(F.count("*").alias("files"))


# -- problem 7: mixture ---------------------------------------------------------------------------


def _mixture(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    meta = read(s, d, "meta")
    fraction = float(setting(meta, "mix.budget_fraction", "0.6"))
    return mixing.mixture(read(s, d, "documents"), read(s, d, "mix_targets"), fraction, setting(meta, "token.pattern", TOKEN_PATTERN))


@query
def p7_chosen(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d)[0]


@query
def p7_shares(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d)[1]
