"""Source files that do not parse (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_segment, parsed_language
from ..session import spread
from .grammars import verdict

_SCHEMA = "path string, language string, chunk_id bigint, kind string, verdict string"


def judged_chunks(chunks: DataFrame) -> DataFrame:
    """(path, language, chunk_id, kind, verdict) of the chunks (id, path, kind, source) in a known language.

    The verdict is ``ok``, the language the text turned out to be in, or ``corrupt``. Each chunk is
    judged as a complete excerpt where it is read: nothing is shuffled. Blank texts are ok; null
    paths and sources and unknown extensions are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = batch.column("source").to_pylist(), batch.column("language").to_pylist()
            told = pa.array([verdict(t, g) for t, g in zip(texts, languages, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("path", "language", "chunk_id", "kind")] + [told], names=["path", "language", "chunk_id", "kind", "verdict"])

    language = parsed_language(F.col("path")).alias("language")
    known = chunks.where("path is not null and source is not null").select("path", language, F.col("id").alias("chunk_id"), "kind", "source").where("language is not null")
    return spread(known).mapInArrow(run, _SCHEMA)


def file_verdicts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, verdict) of every path of ``files`` with a chunk in a known language.

    A file whose chunks are all ok is ok; else one foreign language for all bad chunks is a wrong
    extension, and anything else is corrupt. Re-delivered rows and repeated paths count once.
    """
    bad = F.col("verdict") != "ok"
    kinds = F.collect_set(F.when(bad, F.col("verdict")))  # at most one entry per language
    per_path = judged_chunks(chunks).groupBy("path").agg(F.first("language").alias("language"), kinds.alias("kinds"))
    told = F.when(F.size("kinds") == 0, "ok").when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("corrupt")
    return per_path.select("path", "language", told.alias("verdict")).join(files.select("path").distinct(), "path", "left_semi")


def rates(verdicts: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, wrong_extension, rate) per repo and language of the extension."""
    wrong = (F.col("verdict") != "ok") & (F.col("verdict") != "corrupt")
    counted = verdicts.groupBy(first_segment(F.col("path")).alias("repo"), "language").agg(
        F.count("*").alias("files"), F.count_if(F.col("verdict") != "ok").alias("invalid"), F.count_if(wrong).alias("wrong_extension")
    )
    return counted.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 4))
