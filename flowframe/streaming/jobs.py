"""Streams: event-time windows, sessions, first-of-key, count windows, drop-while, latest values, resumable runs over new files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, column: str = "ts", late: str | None = None) -> DataFrame:
    """The column as a timestamp with a zone, as watermarks need; with a watermark on request."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late else out


def tumbling(df: DataFrame, width: str, keys: list[str], *aggregates: Column, slide: str | None = None, column: str = "ts") -> DataFrame:
    """Aggregates by event-time window (sliding with ``slide``) and keys, batch or stream alike."""
    window = F.window(column, width, slide) if slide else F.window(column, width)
    return _started(df.groupBy(window.alias("w"), *keys).agg(*aggregates), "window_start")


def sessions(df: DataFrame, gap: str, keys: list[str], *aggregates: Column, column: str = "ts") -> DataFrame:
    """Aggregates by session: rows of a key closer than ``gap`` to the one before belong together."""
    return _started(df.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(*aggregates), "session_start")


def _started(df: DataFrame, name: str) -> DataFrame:
    """The window's start instead of the window."""
    return df.select(F.col("w.start").alias(name), *[c for c in df.columns if c != "w"])


def first_of_key(stream: DataFrame, keys: list[str], column: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return event_time(stream, column, late).dropDuplicatesWithinWatermark(keys)


def count_windows(stream: DataFrame, key: str, value: str, size: int, idle_ms: int | None = None) -> DataFrame:
    """(key, n_window, total): sums over each key's consecutive ``size`` values, as they arrive; state holds the rest.

    With ``idle_ms`` a key that brings nothing for so long is forgotten, with the rest it holds.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, held = state.get if state.exists else (0, [])
        held = list(held)
        out = []
        for frame in frames:
            held.extend(frame[value].astype(float))
            while len(held) >= size:
                out.append((group[0], done, sum(held[:size])))
                held, done = held[size:], done + 1
        _keep(state, (done, held), idle_ms)
        yield pd.DataFrame(out, columns=["key", "n_window", "total"])

    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, n_window bigint, total double", "done bigint, held array<double>", "append", _timeout(idle_ms))


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _keep(state: GroupState, value: tuple, idle_ms: int | None) -> None:
    state.update(value)
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)


def drop_while(stream: DataFrame, key: str, order: str, predicate: Column) -> DataFrame:
    """Each key's rows from the first one on where the predicate is false or null, over all that has arrived.

    Rows of a key that arrive together are taken in the order of ``order``; a key's state is one flag.
    """
    names, flag = stream.columns, "drop_while_holds"
    rows = stream.withColumn(flag, F.coalesce(predicate, F.lit(False)))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = bool(state.get[0]) if state.exists else False
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        if not begun:
            at = (~frame[flag].astype(bool)).to_numpy()
            begun = bool(at.any())
            frame = frame.iloc[at.argmax():] if begun else frame.iloc[:0]
        state.update((begun,))
        yield frame[names]

    return rows.groupBy(key).applyInPandasWithState(step, stream.schema, "begun boolean", "append", GroupStateTimeout.NoTimeout)


def latest_by_key(stream: DataFrame, key: str, version: str, value: str, idle_ms: int | None = None) -> DataFrame:
    """(key, version, value, live) whenever a key's latest value changes; output mode update.

    State holds the value of the largest version. With ``idle_ms`` a key that brings nothing for so
    long is evicted: it comes once more with ``live`` false and is forgotten.
    """
    kinds = [stream.schema[c].dataType.simpleString() for c in (key, version, value)]
    names = ["key", "version", "value", "live"]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            gone = state.get
            state.remove()
            yield pd.DataFrame([(group[0], *gone, False)], columns=names)
            return
        rows = pd.concat(list(frames))
        best = rows.loc[rows[version].idxmax()]
        held = state.get if state.exists else None
        if held is None or best[version] > held[0]:
            held = (best[version].item() if hasattr(best[version], "item") else best[version], best[value].item() if hasattr(best[value], "item") else best[value])
            yield pd.DataFrame([(group[0], *held, True)], columns=names)
        _keep(state, held, idle_ms)

    return stream.groupBy(key).applyInPandasWithState(step, f"key {kinds[0]}, version {kinds[1]}, value {kinds[2]}, live boolean", f"version {kinds[1]}, value {kinds[2]}", "update", _timeout(idle_ms))


def run_available(stream: DataFrame, target: str, checkpoint: str, files: str = "parquet") -> None:
    """Takes in what is new since the last run, exactly once, and stops."""
    query = stream.writeStream.format(files).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
