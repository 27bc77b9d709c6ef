"""Splitting oversized items at natural boundaries (problem 2).

Every place where a text may be cut has a penalty. Dynamic programming over these places picks cuts
with the least sum of penalties and size imbalance such that each piece, with the overlap it repeats
from the piece before, keeps under the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of a cut, best first: before an unindented line after a blank one, after a blank line, before an unindented
#: line, where the indentation falls, at any other line end, and inside a line after a statement, a blank, a character.
BLOCK, BLANK, TOP, DEDENT, LINE, STATEMENT, SPACE, ANYWHERE = 0.0, 0.3, 0.5, 0.8, 1.0, 3.0, 4.0, 8.0
IMBALANCE = 1.0  # weight of the squared relative deviation of a piece from the mean size
_BLANK, _CLOSING, _FULL_STOP = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", b";}])>", b".!?"))
_SCHEMA = "chunk_id bigint, piece_no int, n_pieces int, line_start int, line_end int, n_bytes int, overlap_bytes int, piece string"


def boundaries(data: bytes, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending byte offsets where ``data`` may be cut (the end included) and their penalties.

    Inside a line that is longer than a quarter of ``room`` statements and blanks are places too, and
    where these leave a gap of more than half of ``room``, any character is. Of the places within a
    128th of ``room`` the first of the cheapest is kept: a shift by so little changes no piece to speak of.
    """
    n, raw = len(data), np.frombuffer(data, np.uint8)
    dark = ~_BLANK[raw]
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    starts = starts[starts < n]
    sizes = np.diff(np.append(starts, n))
    written = np.append(np.flatnonzero(dark), n)
    indent = written[np.searchsorted(written, starts)] - starts
    blank = indent >= sizes
    before = np.concatenate([[False], blank[:-1]])
    last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(starts))))  # the last line with text up to here
    last = np.concatenate([[-1], last[:-1]])
    last_indent = np.where(last >= 0, indent[last], 0)
    inner = np.where(before, BLANK, np.where(indent < last_indent, DEDENT, LINE))
    cost = np.where(blank, LINE, np.where(indent == 0, np.where(before, BLOCK, TOP), inner))
    places, penalty = [starts[1:]], [cost[1:]]
    long = np.repeat(sizes > room // 4, sizes)
    if long.any():
        follows = np.append(dark[1:], False)
        statement = long & (_CLOSING[raw] | _FULL_STOP[raw] & ~follows | (raw == 44) & follows)
        space = long & ~dark & follows & ~statement
        for found, c in ((statement, STATEMENT), (space, SPACE)):
            k = np.flatnonzero(found) + 1
            k = k[(k < n) & (raw[np.minimum(k, n) - 1] != 10)]
            places.append(k)
            penalty.append(np.full(len(k), c))
    at, c = np.concatenate(places), np.concatenate(penalty)
    order = np.lexsort((at, c, at // max(1, room // 128)))
    at, c = at[order], c[order]
    first = np.concatenate([[True], np.diff(at // max(1, room // 128)) != 0]) if len(at) else np.zeros(0, bool)
    at, c = np.append(at[first], n), np.append(c[first], 0.0)
    gaps = np.flatnonzero(np.diff(np.concatenate([[0], at])) > room // 2)
    extra = []
    for g in gaps.tolist():  # no natural place: any character
        previous, place = int(at[g - 1]) if g else 0, int(at[g])
        while place - previous > room // 2:
            previous += room // 4
            while previous < place and data[previous] & 0xC0 == 0x80:
                previous += 1
            if previous < place:
                extra.append(previous)
    if extra:
        at, c = np.concatenate([at, extra]), np.concatenate([c, np.full(len(extra), ANYWHERE)])
        order = np.argsort(at, kind="stable")
        at, c = at[order], c[order]
    return at.astype(np.int64), c


def overlap_starts(data: bytes, ends: np.ndarray, overlap: int) -> np.ndarray:
    """Where the pieces after the cuts ``ends`` begin: the first line start (else character) at most ``overlap`` bytes before."""
    raw = np.append(np.frombuffer(data, np.uint8), np.uint8(0))
    lines = np.append(np.flatnonzero(raw == 10), len(data) + 1)
    low = np.maximum(0, ends - overlap)
    line = lines[np.searchsorted(lines, np.maximum(0, low - 1))]
    character = low.copy()
    for _ in range(3):
        character += (character < ends) & (raw[character] & 0xC0 == 0x80)
    # a line before the cut that is longer than the overlap is not repeated
    out = np.where(line < ends - 1, line + 1, np.where(raw[np.maximum(ends, 1) - 1] == 10, ends, character))
    return np.where(ends <= overlap, 0, out)


def cuts(data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``data``; each but the first starts up to ``overlap`` bytes early.

    ``limit`` must exceed twice the overlap and 16 bytes.
    """
    if len(data) <= limit:
        return [(0, len(data))]
    if limit <= 2 * overlap + 16:
        raise ValueError("limit must be more than twice the overlap and 16 bytes")
    places, penalty = boundaries(data, limit - overlap)
    ends = np.concatenate([[0], places])
    starts = overlap_starts(data, ends, overlap)
    pieces = -(-(len(data) - overlap) // (limit - overlap))
    mean = len(data) / pieces
    best = np.full(len(ends), np.inf)
    best[0] = 0.0
    came = np.zeros(len(ends), np.int64)
    low = 0
    for j in range(1, len(ends)):
        while ends[j] - starts[low] > limit:
            low += 1
        size = ends[j] - ends[low:j]
        value = best[low:j] + IMBALANCE * ((size - mean) / mean) ** 2
        k = int(np.argmin(value))
        best[j] = value[k] + penalty[j - 1]
        came[j] = low + k
    out, j = [], len(ends) - 1
    while j:
        out.append((int(starts[came[j]]), int(ends[j])))
        j = came[j]
    return out[::-1]


def pieces(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of all chunks (id, source, line_start, line_end) of more than ``limit`` UTF-8 bytes.

    ``line_start`` and ``line_end`` of a piece count lines of the source from the chunk's first line
    (the lesser of its two numbers, 1 where both are missing or below 1). Pieces without their
    overlaps, put together, give the source. Null sources and null ids have no pieces; a chunk that is
    delivered twice is cut once. Only oversized rows leave the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_id", "piece_no", "n_pieces", "line_start", "line_end", "n_bytes", "overlap_bytes", "piece"]
        types = [pa.int64(), *[pa.int32()] * 6, pa.string()]
        for batch in batches:
            for chunk_id, source, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = source.encode()
                parts = cuts(data, limit, overlap)
                rows, done = [], 0
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                begun, ended = (np.searchsorted(ends, [p[k] for p in parts]).tolist() for k in (0, 1))
                for n, (a, b) in enumerate(parts, 1):
                    line = first + begun[n - 1]
                    last = first + ended[n - 1] - (data[b - 1 : b] == b"\n")
                    rows.append((chunk_id, n, len(parts), line, last, b - a, done - a, data[a:b].decode()))
                    done = b
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    first = F.coalesce(F.greatest(F.least("line_start", "line_end"), F.lit(1)), F.lit(1)).cast("int")
    large = chunks.where((F.octet_length("source") > limit) & F.col("id").isNotNull()).select("id", "source", first.alias("first"))
    return large.dropDuplicates(["id"]).mapInArrow(run, _SCHEMA)
