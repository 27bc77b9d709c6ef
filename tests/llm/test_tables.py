"""Extra columns with clashing names, empty tables and null columns, for every operator of the package."""

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import mixing, origin, packing, secrets, split, stuffing, syntax
from quarrystone.sources.tables import read

CLASH = "value kind anchor spans line_no chunk_id language verdict tokens shared phrases sizes n_tokens part grp bucket rate p soft repeats lang2 blocks function words _text first n_pieces".split()


def run(chunks, documents, files, targets):
    chosen, shares = mixing.mixture(documents, targets, 0.5)
    return {
        "secrets": secrets.places(chunks).select("chunk_id", "redacted"),
        "split": split.pieces(chunks, 3000, 100).select("chunk_id", "piece_no", "piece"),
        "origin": origin.origins(chunks, files),
        "syntax": syntax.file_verdicts(chunks, files),
        "packing": packing.pack(packing.sized(documents), 2048),
        "chosen": chosen, "shares": shares,
        "stuffing": stuffing.stuffed_pages(documents),
    }


@pytest.fixture(scope="module")
def tables(spark, data):
    return [read(spark, data, n) for n in ("chunks", "documents", "files", "mix_targets")]


def rows(df):
    return sorted(map(str, df.collect()))


def test_extra_columns_change_nothing(tables):
    plain = {k: rows(v) for k, v in run(*tables).items()}
    wide = [t.withColumns({c: F.lit("x") for c in CLASH if c not in t.columns}) for t in tables]
    assert {k: rows(v) for k, v in run(*wide).items()} == plain
    assert all(plain[k] for k in ("split", "origin", "packing", "chosen", "shares", "stuffing"))


def test_repeated_rows_change_nothing(tables):
    chunks, documents, files, targets = tables
    once = {k: rows(v) for k, v in run(*tables).items()}
    twice = {k: rows(v) for k, v in run(chunks.union(chunks), documents.union(documents), files.union(files), targets).items()}
    for k in ("secrets", "split", "origin", "syntax", "packing", "chosen"):
        assert twice[k] == once[k]
    assert set(twice["stuffing"]) == set(once["stuffing"])


def test_empty_tables(tables):
    out = run(*[t.where("false") for t in tables])
    assert all(df.count() == 0 for df in out.values())


@pytest.mark.parametrize("null", ["id", "path", "source", "kind", "line_start", "line_end", "doc_id", "text", "lang"])
def test_a_column_of_nulls(tables, null):
    gone = [t.withColumn(null, F.lit(None).cast(dict(t.dtypes)[null])) if null in t.columns and "target_share" not in t.columns else t for t in tables]
    for df in run(*gone).values():
        df.count()
