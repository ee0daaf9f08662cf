"""Lineups from play-by-play with gaps filled by who was active in a window of time.

Periods and times are window functions. What stands on the floor is ordered state that each row hands
to the next, so it is walked through within a game, whose rows a game's length bounds; a player's acts
are a sorted list of times, in which two searches count those of a window.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, PERIOD = 600, 1200
FLOOR = "gameId string, seq int, team string, onfloor array<string>, filled array<string>, dropped array<string>"


def with_periods(events: DataFrame, clock: str = "clock", length: int = PERIOD) -> DataFrame:
    """period and t (seconds since the start) from a clock that counts down in each period: it starts anew where it goes up.

    Rows without a clock stand at the time of the row before.
    """
    w = W.partitionBy("gameId").orderBy("seq")
    known = F.last(clock, ignorenulls=True).over(w)
    e = events.withColumn("_c", F.coalesce(known, F.lit(length)))
    up = F.coalesce(F.col("_c") > F.lag("_c").over(w), F.lit(False)).cast("int")
    e = e.withColumn("_up", up).withColumn("period", (F.sum("_up").over(w) + 1).cast("int"))
    t = (F.col("period") - 1) * length + F.least(F.greatest(F.lit(length) - F.col("_c"), F.lit(0)), F.lit(length))
    return e.withColumn("t", t.cast("int")).drop("_c", "_up")


def windowed_lineups(events: DataFrame, window: int = WINDOW, size: int = 5) -> DataFrame:
    """Who stands on the floor at each row of a team, before the row's own substitution takes effect.

    events: gameId, seq, team, t (seconds since the start), player, direction (in, out or null) and
    optionally lineup, the players a row names as on the floor. The starters are those of the first
    named lineup with the substitutions before it taken back, else the most active of the game. At each
    row a floor of fewer than `size` takes in the most active players of the last `window` seconds (rows
    of the same second included, later ones too; in the first `window` seconds the whole game counts),
    and a larger one loses the least active of them; of equally active ones the first names stay or come
    in. What was filled or dropped stays so until a substitution says otherwise. Acts are rows that name
    a player and, for a lineup row, each of its players. A row's result has the names sorted; with
    fewer players than `size` in the game it is short.
    """
    named = "lineup" in events.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for team, g in pdf.sort_values("seq", kind="stable").groupby("team", sort=True):
            rows = list(zip(g.seq, g.t, g.player, g.direction, g.lineup if named else [None] * len(g), strict=True))
            acts: dict[str, list[int]] = {}
            for _, t, p, _, lineup in rows:
                for x in (*([p] if isinstance(p, str) else []), *(sorted(set(lineup)) if lineup is not None else [])):
                    acts.setdefault(x, []).append(t)
            for own in acts.values():
                own.sort()
            total = {p: len(own) for p, own in acts.items()}

            def by_activity(t: int, acts=acts, total=total) -> list[str]:
                count = total if t < window else {p: bisect.bisect_right(own, t) - bisect.bisect_left(own, t - window) for p, own in acts.items()}
                return sorted(acts, key=lambda p: (-count[p], p))

            first = next((i for i, r in enumerate(rows) if r[4] is not None and len(r[4])), None)
            if first is None:
                floor = set(sorted(acts, key=lambda p: (-total[p], p))[:size])
            else:
                floor = set(rows[first][4])
                for _, _, p, d, _ in rows[:first][::-1]:
                    if isinstance(p, str) and d in ("in", "out"):
                        (floor.discard if d == "in" else floor.add)(p)
            for seq, t, p, d, _ in rows:
                filled, dropped = [], []
                if len(floor) != size:
                    order = by_activity(t)
                    if len(floor) > size:
                        # of equally active ones (players without an act come last) the larger names leave
                        keep = [x for x in order if x in floor] + sorted(floor - set(order))
                        dropped = keep[size:]
                    else:
                        filled = [x for x in order if x not in floor][: size - len(floor)]
                    floor = (floor | set(filled)) - set(dropped)
                out.append((g.gameId.iloc[0], int(seq), team, sorted(floor), sorted(filled), sorted(dropped)))
                if isinstance(p, str) and d == "in":
                    floor = floor | {p}
                elif isinstance(p, str) and d == "out":
                    floor = floor - {p}
        return pd.DataFrame(out, columns=["gameId", "seq", "team", "onfloor", "filled", "dropped"])

    cols = ["gameId", "seq", "team", "t", "player", "direction", *(["lineup"] if named else [])]
    return events.select(*cols).groupBy("gameId").applyInPandas(one, FLOOR)


def fill_shares(lineups: DataFrame) -> DataFrame:
    """Per game the share of rows that needed players filled in or dropped, and of rows still short."""
    some: Column = (F.size("filled") > 0) | (F.size("dropped") > 0)
    return lineups.groupBy("gameId").agg(F.count("*").alias("rows"), F.avg(some.cast("double")).alias("mended"), F.avg((F.size("onfloor") < 5).cast("double")).alias("short"))
