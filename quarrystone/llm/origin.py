"""Generated, minified or vendored source files (problem 4)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_segment
from ..session import checkpointed
from .repair import grammars, mix

_TOKEN = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?|(?:(?:[A-Za-z]+_+)+[A-Za-z]*|[A-Za-z][a-z]*(?:[A-Z][a-z]+)+)\d+\b|[A-Z]?[a-z]+|[A-Z]+(?![a-z])|_+\d*|[^\s\w]|\w")
_SCHEMA = (
    "path string, tokens int, chars int, long_lines double, spaces double, literal double, fresh double, reused double, counted double, stretch int, marked boolean, sizes array<int>, phrases array<bigint>"
)
PHRASE = 8  # mean number of tokens of a phrase
#: Extensions of configuration, documentation and plain records, which are never cases. Any other last part of a name counts.
NOT_CODE = (
    "md markdown mdx rst adoc asciidoc txt text tex pod org rtf pdf man log json jsonc json5 jsonl ndjson yaml yml toml ini cfg conf config cnf env properties "
    "xml plist editorconfig gitignore gitattributes gitmodules dockerignore lock sum csv tsv"
).split()


def file_texts(chunks: DataFrame) -> DataFrame:
    """(path, chunks): the chunks of every path, each id once, in one shuffle by path."""
    known = chunks.where("path is not null and source is not null").select("path", "id", "kind", "line_start", "source")
    once = known.repartition("path").dropDuplicates(["path", "id"])
    return once.groupBy("path").agg(F.collect_list(F.struct("kind", "line_start", "id", "source")).alias("chunks"))


def whole_text(chunks: list[dict]) -> str:
    """The text of a file from its chunks: the whole-file chunk, or its outermost parts in order."""
    whole = [c for c in chunks if c["kind"] == "file"]
    if whole:
        return max(whole, key=lambda c: (len(c["source"]), c["id"]))["source"]
    classes = [c["source"] for c in chunks if c["kind"] == "class"]
    outer = [c for c in chunks if c["kind"] != "method" or not any(c["source"] in k for k in classes)]
    return "\n".join(c["source"] for c in sorted(outer, key=lambda c: (c["line_start"] or 0, c["id"] or 0)))


def _name(token: str) -> int:
    """A stable 64-bit name of a token."""
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


#: Numbers share a name, and so do strings and names of several words that end in a counter.
NUMBER, COUNTER, STRING, COMMA = _name("#"), _name("_#"), _name("''"), _name(",")
_DENSE = re.compile(r"[^\s\"'`]{38,}")  # a stretch without blanks in a string of any form
#: A comment that says a tool wrote the file: what tools commonly put at the top, in the corpus's languages.
_MARK = re.compile(
    r"(?i)@generated|auto-?generated|code generated by|machine[- ]written|generated (?:file|code|by)|was produced by|do not edit(?:\.|$| manually| by hand)|manual changes will be lost|automatisch erzeugt|nicht bearbeiten|généré automatiquement|ne pas modifier|generado autom|no editar"
)
_COMMENT = re.compile(r"^\s*(?:\d+:\s*)?(?://|#|/?\*|\"\"\"|--)")


def _measures(text: str, names: dict[str, int]) -> tuple[list[int], list[str], dict]:
    """Token names of a text, its literals (numbers, and packed or listed strings in groups of characters) and what its lines say."""
    out, literals, literal_chars, previous_end, token_count = [], [], 0, -1, 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        first = token[0]
        token_count += 1
        if first.isdigit():
            glued = m.start() == previous_end and text[previous_end - 1].isalpha()
            out.append(COUNTER if glued else NUMBER)
            if not glued:
                literals.append(token)
                literal_chars += len(token) + 2
        elif token[-1].isdigit() and first not in "\"'`":
            out.append(COUNTER)  # a name of several words that ends in a counter, or such an end
        elif first in "\"'`" and len(token) > 1:
            out.append(STRING)
            packed = _DENSE.findall(token) if len(token) >= 40 else ()
            if packed:
                literals += [x[k : k + 4] for x in packed for k in range(0, len(x) - 3, 4)]
                literal_chars += sum(map(len, packed)) + 2
            elif len(token) <= 40 and " " not in token and out[-2:-1] == [COMMA]:
                literals.append(token)  # one of a list of short strings
                literal_chars += len(token) + 2
        else:
            name = names.get(token)
            if name is None:
                name = names[token] = _name(token)
            out.append(name)
        previous_end = m.end()
    lines = text.split("\n")
    long_chars = sum(len(x) for x in lines if len(x) > 250)
    head = [x for x in lines[:12] if _COMMENT.match(x)]
    return out, literals, {
        "tokens": token_count, "chars": len(text), "long_lines": (long_chars - literal_chars) / max(1, len(text)), "spaces": sum(map(text.count, " \t")) / max(1, len(text)),
        "literal": literal_chars / max(1, len(text)),
        "marked": any(_MARK.search(x) for x in head),
    }


def grammar_features(texts: DataFrame) -> DataFrame:
    """Grammar and literal measures of files (path, chunks), with the hashes of their phrases.

    reused: share of tokens that rules used 4 times or more derive; counted: the same for rules that
    hold the counter of a name; stretch: the longest row of tokens that such rules derive; literal: share of characters in numbers
    and in packed or listed strings; fresh: the size of the grammar of these literals by their number (1: no rule shortens them).
    Phrases are cut where the hash of two neighbouring tokens is least, so equal content gives equal
    phrases wherever it stands: they are the rules that a grammar of the whole corpus would share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounds the texts and arrays of one grammar run
                part = batch.slice(k, 256)
                yield _batch(part.column(0).to_pylist(), part.column(1).to_pylist(), names)
            if len(names) > 1_000_000:
                names.clear()

    return texts.mapInArrow(run, _SCHEMA)


def _batch(paths: list[str], groups: list[list[dict]], names: dict[str, int]) -> pa.RecordBatch:
    rows, symbols, owner, literals = [], [], [], []
    for k, chunks in enumerate(groups):
        out, held, row = _measures(whole_text(chunks), names)
        symbols.append(np.array(out, np.uint64))
        literals.append(np.array([_literal_name(x) for x in held], np.uint64))
        owner.append(np.full(len(out), k, np.int64))
        rows.append(row)
    symbol, own = np.concatenate(symbols), np.concatenate(owner)
    n = len(paths)
    g = grammars(symbol, own, symbol == np.uint64(COUNTER))
    covered = np.bincount(own, weights=g["reused"], minlength=n)
    counted = np.bincount(own, weights=g["counted"], minlength=n)
    stretch = _stretches(g["counted"], own, n)
    sizes = [s.size for s in symbols]
    fresh = _incompressible(literals)
    phrase_owner, phrase_size, phrase_hash = _phrases(symbol, own)
    cuts = np.searchsorted(phrase_owner, np.arange(n + 1))
    for k, row in enumerate(rows):
        total = max(1, sizes[k])
        row |= {"path": paths[k], "fresh": float(fresh[k]), "reused": float(covered[k] / total), "counted": float(counted[k] / total), "stretch": int(stretch[k])}
        row |= {"sizes": phrase_size[cuts[k] : cuts[k + 1]].tolist(), "phrases": phrase_hash[cuts[k] : cuts[k + 1]].astype(np.int64).tolist()}
    schema = pa.schema([("path", pa.string()), ("tokens", pa.int32()), ("chars", pa.int32()), *[(c, pa.float64()) for c in ("long_lines", "spaces", "literal", "fresh", "reused", "counted")], ("stretch", pa.int32()), ("marked", pa.bool_()), ("sizes", pa.list_(pa.int32())), ("phrases", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _literal_name(literal: str) -> int:
    return zlib.crc32(literal.encode("utf-8", "surrogatepass"))


def _incompressible(literals: list[np.ndarray]) -> np.ndarray:
    """Per file the length of the Re-Pair grammar of its literals by their number: the final sequence and two symbols a rule."""
    sizes = np.array([x.size for x in literals])
    own = np.repeat(np.arange(len(literals)), sizes)
    g = grammars(np.concatenate(literals), own, np.zeros(len(own), bool))
    return (np.bincount(g["own"], minlength=len(sizes)) + 2 * np.bincount(g["rules"], minlength=len(sizes))) / np.maximum(1, sizes)


def _stretches(marked: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Per owner the length of its longest row of marked tokens."""
    out = np.zeros(n, np.int64)
    if len(own):
        starts = np.flatnonzero(np.concatenate([[True], (marked[1:] != marked[:-1]) | (own[1:] != own[:-1])]))
        sizes = np.diff(np.append(starts, len(own)))
        np.maximum.at(out, own[starts], np.where(marked[starts], sizes, 0))
    return out


def _phrases(symbol: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, token count and hash of content-defined phrases of about ``PHRASE`` tokens."""
    if not len(symbol):
        none = np.zeros(0, np.int64)
        return none, none, none
    h = mix(symbol, np.concatenate([symbol[1:], [np.uint64(0)]]))
    first = np.concatenate([[True], own[1:] != own[:-1]])
    cut = first | (h % np.uint64(PHRASE) == 0)
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(symbol)))
    place = np.arange(len(symbol)) - np.repeat(starts, sizes)
    mixed = mix(symbol, place.astype(np.uint64))
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(mixed, starts)
    return own[starts], sizes, hashes.view(np.int64)


def shared_phrases(features: DataFrame) -> DataFrame:
    """(path, shared): share of a file's tokens in long phrases that another repo holds too.

    Repos per phrase are counted with partial sums, so a phrase that fills the corpus stays cheap; a
    hot phrase in the join that follows is split by AQE.
    """
    rows = features.select("path", F.explode(F.arrays_zip("phrases", "sizes")).alias("p")).select("path", first_segment(F.col("path")).alias("repo"), F.col("p.phrases").alias("phrase"), F.col("p.sizes").alias("size"))
    rows = rows.where(F.col("size") >= PHRASE).groupBy("path", "repo", "phrase").agg(F.sum("size").alias("size"))
    repos = rows.groupBy("phrase").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a != b").select("phrase")
    found = rows.join(repos, "phrase").groupBy("path").agg(F.sum("size").alias("shared"))
    long = F.aggregate(F.filter("sizes", lambda s: s >= PHRASE), F.lit(0), lambda a, s: a + s)
    return features.select("path", long.alias("long")).join(found, "path").select("path", "long", (F.col("shared") / F.greatest("long", F.lit(1))).alias("shared"))


def origins(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, origin) of the files that were not written by hand: generated, minified, vendored or data.

    All paths of ``files`` count but those whose extension (in any case) is in ``NOT_CODE``: an unknown
    last part, as of a bundle that lost its ``.js``, counts as no extension. Re-delivered rows count
    once; files without text are by hand.
    """
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")
    features = checkpointed(grammar_features(file_texts(chunks.where(~extension.isin(*NOT_CODE)))))
    judged = features.drop("phrases", "sizes").join(shared_phrases(features), "path", "left")
    shared, long = F.coalesce("shared", F.lit(0.0)), F.coalesce("long", F.lit(0))
    generated = (F.col("counted") >= 0.5) & (F.col("stretch") >= 30) | (F.col("stretch") >= 60) | F.col("marked") & ((F.col("counted") >= 0.1) | (F.col("reused") >= 0.2))
    origin = (
        F.when((F.col("literal") >= 0.75) & (F.col("fresh") >= 0.6), "data")
        .when((F.col("long_lines") >= 0.5) & (F.col("spaces") < 0.12), "minified")
        .when(generated, "generated").when((shared >= 0.75) & (long >= 60) | (shared >= 0.9) & (long >= 24), "vendored")
    )
    return judged.select("path", origin.alias("origin")).where("origin is not null").join(files.select("path").distinct(), "path", "left_semi")
