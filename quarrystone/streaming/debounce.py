"""Leading-edge debounce of change events, as a batch job and as a stream with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scan import WATCH_IGNORED_PARTS, has_part

QUIET_MS = 500


def watched(events: DataFrame, path: str = "path", ignored: tuple[str, ...] = WATCH_IGNORED_PARTS) -> DataFrame:
    """Events of paths without an ignored component; null paths are dropped."""
    return events.where(~has_part(F.col(path), ignored))


def _next(t: np.ndarray, quiet_ms: float) -> np.ndarray:
    """For each of the ascending times the place of the first that is ``quiet_ms`` later, at least the next one."""
    return np.maximum(np.searchsorted(t, t + quiet_ms, "left"), np.arange(1, len(t) + 1))


def debounce(events: DataFrame, key: str, at: str, event_id: str, quiet_ms: int = QUIET_MS, slice_seconds: int = 86_400) -> DataFrame:
    """Events that are emitted: the first of a key, then each at least ``quiet_ms`` after the last emitted.

    Equal times are ordered by ``event_id``; rows without key or time are dropped. A key is cut into
    slices of time, so its events are never in one task. A slice first tells what it would emit last
    for every time at which it could be entered (as steps, of which most fall together); the steps of
    the slices of a key are chained in order; then every slice knows when it is entered and emits.
    """
    seconds = max(slice_seconds, 2 * quiet_ms // 1000 + 1)
    types = dict(events.dtypes)
    ms = (F.unix_micros(F.col(at)) / 1000).alias("_ms")
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), ms, F.col(event_id).alias("_id"), F.floor(F.unix_seconds(F.col(at)) / seconds).alias("_s"))

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["_ms"].to_numpy())
        later, last = _next(t, quiet_ms), np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if later[i] < len(t):
                last[i] = last[later[i]]
        begin = float(rows["_s"].iloc[0]) * seconds * 1000
        entries = slice(0, int(np.searchsorted(t, begin + quiet_ms, "left")) + 1)
        until, leaves = t[entries], t[last[entries]]
        kept = np.append(leaves[1:] != leaves[:-1], True)
        return pd.DataFrame({"_k": rows["_k"].iloc[0], "_s": rows["_s"].iloc[0], "until": until[kept], "leaves": leaves[kept]})

    def entered(rows: pd.DataFrame) -> pd.DataFrame:
        out, emitted = [], -np.inf
        for s, part in rows.sort_values(["_s", "until"]).groupby("_s", sort=True):
            out.append((s, emitted + quiet_ms))
            place = int(np.searchsorted(part["until"].to_numpy(), emitted + quiet_ms, "left"))
            emitted = part["leaves"].iloc[place] if place < len(part) else emitted
        return pd.DataFrame({"_k": rows["_k"].iloc[0], "_s": [s for s, _ in out], "entered": [e for _, e in out]})

    def emit(rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({event_id: []})
        rows = rows.sort_values(["_ms", "_id"])
        t = rows["_ms"].to_numpy()
        later, i, kept = _next(t, quiet_ms), int(np.searchsorted(t, begin["entered"].iloc[0], "left")), []
        while i < len(t):
            kept.append(i)
            i = int(later[i])
        return pd.DataFrame({event_id: rows["_id"].to_numpy()[kept]})

    kind = f"`_k` {types[key]}, `_s` bigint"
    stepped = rows.select("_k", "_s", "_ms").groupBy("_k", "_s").applyInPandas(steps, f"{kind}, until double, leaves double")
    begun = stepped.groupBy("_k").applyInPandas(entered, f"{kind}, entered double")
    emitted = rows.groupBy("_k", "_s").cogroup(begun.groupBy("_k", "_s")).applyInPandas(emit, f"`{event_id}` {types[event_id]}")
    return events.join(emitted, event_id, "left_semi")


def debounce_stream(events: DataFrame, key: str, at: str, event_id: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The same rule on a stream: (key, event_id, at) of the emitted events, in append mode.

    State is the last emitted time of each key. Within a micro-batch events are put in order; an
    event older than the last emitted one is suppressed.
    """
    stream = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    stream = stream.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), (F.unix_micros(F.col(at)) / 1000).alias("ms"))

    def emit(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(batches).sort_values(["ms", "event_id"])
        keep = []
        for ms in rows["ms"]:
            keep.append(ms - last >= quiet_ms)
            last = ms if keep[-1] else last
        state.update((float(last),))
        yield rows[keep]

    return stream.groupBy("key").applyInPandasWithState(emit, "key string, event_id bigint, ms double", "last double", "append", GroupStateTimeout.NoTimeout)
