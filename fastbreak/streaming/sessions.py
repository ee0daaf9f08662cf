"""Streams of events: windows with late data, sessions, and running lineups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(df: DataFrame, size: str, by: list[str], value: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    out = event_time(df, ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    out = event_time(df, ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def running_lineups(events: DataFrame) -> DataFrame:
    """On-floor players of each game and team as substitutions (seq, player, direction) arrive.

    State is the set on the floor and the last sequence number; rows of a batch apply in order, and a
    row older than the state is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        floor, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), -1)
        rows = []
        pdf = pd.concat(list(frames)).sort_values("seq")
        for seq, player, direction in zip(pdf.seq, pdf.player, pdf.direction, strict=True):
            if seq <= last:
                continue
            (floor.add if direction == "in" else floor.discard)(player)
            last = int(seq)
            rows.append((*key, last, sorted(floor)))
        state.update((sorted(floor), last))
        yield pd.DataFrame(rows, columns=["gameId", "team", "seq", "floor"])

    return events.groupBy("gameId", "team").applyInPandasWithState(step, "gameId string, team string, seq bigint, floor array<string>", "floor array<string>, last bigint", "append", GroupStateTimeout.NoTimeout)
