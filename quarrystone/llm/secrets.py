"""Credentials embedded in source code (problem 1).

All literals of all texts are indexed with the repos that hold them. A value that a share of the repos
holds is a placeholder; a rare one is confirmed where a place names it as a credential, or where its form
is one that the corpus uses for named credentials. Every text is then scanned with an automaton for the
confirmed values: the places that come out are those of the scan, whether something names them or not.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_segment
from ..session import checkpointed, spread
from .secret_rules import credentials, literals, masked

OWNERS, OWNER_SHARE = 3, 0.03  # a value in more repos than this number and than this share of all repos is a placeholder
SHAPE_VALUES, SHAPE_NAMED = 3, 0.5  # named values a form needs, and their share of all its rare values
SCAN_BYTES = 1_000_000  # confirmed values of up to so many bytes form one automaton, more travel to their texts by a join
BITS = 24  # the filter of keys before that join is a bitmap of 2**BITS bits (2 MB), whatever the number of values
_RUN = re.compile(r"[A-Za-z0-9]+")
_INDEX = "h bigint, owner bigint, value string, shape string, role string, pieces int"
_PLACES = "chunk_id bigint, line_nos array<int>, redacted string"
_PLACES_ARROW = pa.schema([("chunk_id", pa.int64()), ("line_nos", pa.list_(pa.int32())), ("redacted", pa.string())])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, path, source) of the chunks with an id and a text."""
    return chunks.where("id is not null and source is not null").select(F.col("id").alias("chunk_id"), "path", "source")


def literal_index(chunks: DataFrame) -> DataFrame:
    """(h, owner, value, shape, role, pieces): the literals of chunks (id, path, source) and who holds them.

    One row per literal, repo, form and role of an Arrow batch; ``h`` is a hash of the literal. ``value`` is kept only for literals
    that may become credentials, the others are counted by their hash. ``pieces`` is -1 for a private key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("owner", pa.int64()), ("value", pa.string()), ("shape", pa.string()), ("role", pa.string()), ("pieces", pa.int32())])
        for batch in batches:
            rows = set()
            for repo, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                owner = _hash(repo)
                for x in literals(text):
                    kept = x.role == "named" or x.shape is not None
                    rows.add((_hash(x.value), owner, x.value, x.shape, x.role, x.pieces) if kept else (_hash(x.value), owner, None, None, "open", 1))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # a null path is an owner of its own
    return spread(_texts(chunks).select(F.coalesce(first_segment(F.col("path")), F.lit("")).alias("repo"), "source")).mapInArrow(run, _INDEX)


def owner_limit(index: DataFrame) -> int:
    """The number of repos from which on a value is shared: one number comes to the driver."""
    repos = index.select("owner").distinct().count()
    return max(OWNERS, int(OWNER_SHARE * repos))


def judged_values(index: DataFrame, max_owners: int) -> DataFrame:
    """(value, pieces, owners, named, issued, confirmed) of the literals that may be credentials.

    Spark counts distinct owners in two steps with partial sums, so a placeholder that fills the corpus
    stays cheap. A form counts as issued where at least ``SHAPE_VALUES`` rare values of it, and the
    share ``SHAPE_NAMED`` of all of them, stand at places that name a credential, and none is named as something public.
    """
    once = index.groupBy("h", "owner").agg(
        F.max(F.struct(F.col("value").isNotNull(), "value", "shape", "pieces")).alias("v"), F.max((F.col("role") == "named").cast("int")).alias("named"), F.max((F.col("role") == "public").cast("int")).alias("public"),
    )
    values = once.groupBy("h").agg(F.count("*").alias("owners"), F.max("v").alias("v"), F.max("named").alias("named"), F.max("public").alias("public"))
    values = values.where("v.value is not null").select("v.value", "v.shape", "v.pieces", "owners", "named", "public")
    rare = F.col("owners") <= max_owners
    shapes = values.where(rare & F.col("shape").isNotNull()).groupBy("shape").agg(F.sum("named").alias("n"), F.sum("public").alias("p"), F.count("*").alias("c"))
    shapes = shapes.where((F.col("n") >= SHAPE_VALUES) & (F.col("n") >= SHAPE_NAMED * F.col("c")) & (F.col("p") == 0)).select("shape", F.lit(True).alias("issued"))
    issued = F.coalesce("issued", F.lit(False))
    return values.join(shapes, "shape", "left").select("value", "pieces", "owners", "named", issued.alias("issued"), (rare & ((F.col("named") == 1) | issued)).alias("confirmed"))


def places(chunks: DataFrame, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(chunk_id, line_nos, redacted) of every chunk with a confirmed credential.

    ``line_nos`` are the 1-based lines on which values start, ``redacted`` is the source with only the
    values replaced: by zeros where the value is hexadecimal, else by REDACTED; the lines inside a
    private key go, its frame stays. A chunk that is delivered twice counts once. An empty table gives
    no rows. No text is shuffled: where the confirmed values have more than ``scan_bytes`` bytes, only the
    texts that hold the key of one move.
    """
    index = checkpointed(literal_index(chunks))
    values = checkpointed(judged_values(index, owner_limit(index)).where("confirmed").select("value", "pieces"))
    size = values.agg(F.sum(F.octet_length("value"))).collect()[0][0] or 0
    found = _scanned(_texts(chunks), values) if size <= scan_bytes else _joined(_texts(chunks), values)
    return found.dropDuplicates(["chunk_id"])


class Scanner:
    """Finds confirmed values in texts: those in one piece by an automaton, those in pieces and keys by their hash."""

    def __init__(self, whole: list[str], pieced: set[int]):
        self.pieced = pieced
        self.automaton = ahocorasick.Automaton()
        for value in whole:
            self.automaton.add_word(value, len(value))
        self.automaton.make_automaton()

    def row(self, chunk_id: int, text: str) -> dict | None:
        lines, spans = set(), []
        if self.pieced and _in_pieces(text):
            for hit in credentials(text):
                if (hit.kind == "private key" or len(hit.spans) > 1) and _hash(hit.value) in self.pieced:
                    lines.add(text.count("\n", 0, hit.start) + 1)
                    spans += hit.spans
        for end, size in self.automaton.iter_long(text) if self.automaton.kind == ahocorasick.AHOCORASICK else ():
            a, b = end + 1 - size, end + 1
            if not (text[b : b + 1].isalnum() or text[a - 1 : a].isalnum() and not _GLUED.search(text, max(0, a - 4), a)):
                lines.add(text.count("\n", 0, a) + 1)
                spans.append((a, b))
        return {"chunk_id": chunk_id, "line_nos": sorted(lines), "redacted": redact(text, spans)} if lines else None


_GLUED = re.compile(r"(?<![\w-])-[A-Za-z]$")  # an option such as -p right before its value
_PIECED = re.compile(r"[\"'`]\s*(?:\+|\.|\\\n)?\s*[\"'`]")


def _in_pieces(text: str) -> bool:
    return "PRIVATE KEY" in text or bool(_PIECED.search(text))


def _scanned(texts: DataFrame, values: DataFrame) -> DataFrame:
    """One automaton for all values (a checked number of bytes), one pass over the texts where they lie."""
    rows = values.collect()
    shared = texts.sparkSession.sparkContext.broadcast(([r["value"] for r in rows if r["pieces"] == 1], {_hash(r["value"]) for r in rows if r["pieces"] != 1}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            out = [scanner.row(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([r for r in out if r], schema=_PLACES_ARROW)

    return spread(texts.select("chunk_id", "source")).mapInArrow(run, _PLACES)


_KEPT: list = []  # the values of the last broadcast and their scanner


def _scanner(shared: Broadcast) -> Scanner:
    """The scanner of a broadcast, built once per worker process; only the last one is kept."""
    values = shared.value
    if not _KEPT or _KEPT[0] is not values:
        _KEPT[:] = [values, Scanner(*values)]
    return _KEPT[1]


def anchor(value: str) -> str | None:
    """The key by which texts meet a value: its longest two neighbouring runs of letters and digits, or its only run.

    A copy of a value has no letter or digit beside it, so its runs are runs of the text too.
    """
    runs = _RUN.findall(value)
    return max((f"{a} {b}" for a, b in zip(runs, runs[1:], strict=False)), key=len) if len(runs) > 1 else runs[0] if runs else None


def _keyed(values: DataFrame) -> DataFrame:
    """(anchor, value, pieces): values in one piece with their key, the others with their hash as key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [anchor(v) if p == 1 else str(_hash(v)) for v, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0), batch.column(1)], names=["anchor", "value", "pieces"])

    return values.mapInArrow(run, "anchor string, value string, pieces int").where("anchor is not null")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2**BITS bits: those of the crc32 of every key (anchor) and of its first run. At most 2**(BITS - 6) rows come to the driver."""
    either = keys.select(F.explode(F.array("anchor", F.substring_index("anchor", " ", 1))).alias("k"))
    bit = either.select((F.crc32(F.col("k").cast("binary")) % (1 << BITS)).cast("int").alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit & 63))").alias("word")).collect()
    out = np.zeros(1 << BITS - 6, np.int64)
    for at, word in words:
        out[at] = word
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little")


def _held(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk_id, source, keys) of the texts that may hold a key; the filter lets some others through and keeps all that do."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(keys)).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        known: dict[str, bool] = {}

        def may(key: str) -> bool:
            k = zlib.crc32(key.encode()) & ((1 << BITS) - 1)
            return bool(bits[k >> 3] >> (7 - (k & 7)) & 1)

        for batch in batches:
            out = []
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = _RUN.findall(text)
                for w in (distinct := set(runs)):
                    if w not in known:
                        known[w] = may(w)
                first = {w for w in distinct if known[w]}
                found = {*first, *filter(may, {f"{a} {b}" for a, b in zip(runs, runs[1:], strict=False) if a in first})} if first else set()
                if _in_pieces(text):
                    found |= {str(_hash(h.value)) for h in credentials(text) if h.kind == "private key" or len(h.spans) > 1}
                if found:
                    out.append({"chunk_id": chunk_id, "source": text, "keys": sorted(found)})
                if len(known) > 500_000:
                    known.clear()
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chunk_id", pa.int64()), ("source", pa.string()), ("keys", pa.list_(pa.string()))]))

    return spread(texts.select("chunk_id", "source")).mapInArrow(run, "chunk_id bigint, source string, keys array<string>")


def _joined(texts: DataFrame, values: DataFrame) -> DataFrame:
    """The same rows where the values are too many for one automaton: each text meets the values whose key it holds."""
    keys = _keyed(values)
    held = checkpointed(_held(texts, keys))
    met = held.select("chunk_id", F.explode("keys").alias("anchor")).join(keys, "anchor")
    met = met.groupBy("chunk_id").agg(F.collect_set(F.struct("value", "pieces")).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            told = {(v["value"], v["pieces"]) for r in rows for v in r["values"]}
            scanner = Scanner([v for v, p in told if p == 1], {_hash(v) for v, p in told if p != 1})
            out = [scanner.row(r["chunk_id"], r["source"]) for r in rows]
            yield pa.RecordBatch.from_pylist([r for r in out if r], schema=_PLACES_ARROW)

    return held.select("chunk_id", "source").join(met, "chunk_id").mapInArrow(run, _PLACES)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans replaced; of overlapping spans the first counts. Line ends in a span stay."""
    out, at = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            value = text[a:b]
            inside = re.split(r"(\\n|\n[ \t]*)", value)
            out += [text[at:a], "".join(p if p.startswith(("\n", "\\n")) or not p else masked(p) for p in inside)]
            at = b
    return "".join(out) + text[at:]
