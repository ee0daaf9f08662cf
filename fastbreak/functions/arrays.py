"""Arrays of structs and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONFLOOR = "array<struct<id:string,name:string,team:string>>"


def element(c: Column, one_based: int) -> Column:
    """Null beyond the end."""
    return F.get(c, F.lit(one_based - 1))


def json_value(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def parse_players(c: Column) -> Column:
    """JSON array of players; bad JSON is an empty array."""
    return F.coalesce(F.from_json(c, ONFLOOR, {"mode": "PERMISSIVE"}), F.array().cast(ONFLOOR))


def lineup_key(ids: Column) -> Column:
    """The same for every order of the players; null for no players."""
    return F.when(F.size(ids) > 0, F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), "::"))


def ids_of_team(players: Column, team: Column, same: bool = True) -> Column:
    """Ids on (or off) a team, without repeats, in order."""
    return F.array_distinct(F.transform(F.filter(players, lambda p: p["team"].eqNullSafe(team) if same else ~p["team"].eqNullSafe(team)), lambda p: p["id"]))


def lower_keys(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])
