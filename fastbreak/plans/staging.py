"""From nested events to player and team facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fastbreak.functions.rates import is_corner_three, is_garbage, is_high_leverage, ratio, shot_distance
from fastbreak.operators.aggregates import split_cube, wavg


def shots(plays: DataFrame) -> DataFrame:
    """One row per shot with its shooter, place and game state; bad coordinates are null."""
    s = F.col("shotInfo")
    margin = F.abs(F.col("homeScore") - F.col("awayScore"))
    return plays.where(F.col("shootingPlay") & s["shooter"]["id"].isNotNull()).select(
        "gameId", "season", "teamId", "opponentId", "period", "secondsRemaining",
        s["shooter"]["id"].alias("athleteId"), s["made"].cast("boolean").alias("made"), s["range"].alias("range"), F.coalesce(s["assisted"], F.lit(False)).alias("assisted"),
        s["assistedBy"]["id"].alias("assistId"), s["location"]["x"].try_cast("double").alias("x"), s["location"]["y"].try_cast("double").alias("y"),
        is_high_leverage(F.col("period"), F.col("secondsRemaining"), margin).alias("high_leverage"), is_garbage(margin).alias("garbage"),
    )


#: Members of a player season's nested groups and the flat columns they become.
SEASON_FIELDS = {
    "fieldGoals": {"made": "fg_made", "attempted": "fg_attempted", "pct": "fg_pct"},
    "twoPointFieldGoals": {"made": "two_made", "attempted": "two_attempted", "pct": "two_pct"},
    "threePointFieldGoals": {"made": "three_made", "attempted": "three_attempted", "pct": "three_pct"},
    "freeThrows": {"made": "ft_made", "attempted": "ft_attempted", "pct": "ft_pct"},
    "rebounds": {"offensive": "oreb", "defensive": "dreb", "total": "reb"},
    "winShares": {"offensive": "ws_offensive", "defensive": "ws_defensive", "total": "ws_total", "totalPer40": "ws_totalPer40"},
}


def flat_player_seasons(df: DataFrame) -> DataFrame:
    """Nested groups of a player's season as nineteen flat columns, null where the group, or the table's type, lacks the member; other columns stay, and seasonType is there in any case."""
    def member(group: str, key: str):
        kind = df.schema[group].dataType if group in df.columns else None
        if isinstance(kind, T.MapType):
            return F.element_at(group, key).cast("double")
        if isinstance(kind, T.StructType) and key in kind.names:
            return F.col(group)[key].cast("double")
        return F.lit(None).cast("double")

    flat = {name: member(group, key) for group, keys in SEASON_FIELDS.items() for key, name in keys.items()}
    out = df.withColumns(flat).drop(*SEASON_FIELDS)
    return out if "seasonType" in out.columns else out.withColumn("seasonType", F.lit(None).cast("string"))


def participants(plays: DataFrame) -> DataFrame:
    return plays.select("gameId", "season", F.col("id").alias("playId"), "teamId", F.explode("participants").alias("p")).select("gameId", "season", "playId", "teamId", F.col("p.id").alias("athleteId"), F.col("p.name").alias("athlete"))


def stint_athletes(stints: DataFrame) -> DataFrame:
    return stints.select("gameId", "teamId", "idHash", "totalSeconds", "pace", "offenseRating", "defenseRating", "netRating", F.explode("athletes").alias("a")).select("*", F.col("a.id").alias("athleteId")).drop("a")


def player_game_impact(stints: DataFrame) -> DataFrame:
    """Seconds-weighted ratings of a player in a game."""
    w = F.col("totalSeconds")
    return stint_athletes(stints).groupBy("gameId", "teamId", "athleteId").agg(F.sum(w).alias("seconds"), *[wavg(F.col(c), w).alias(c) for c in ("pace", "offenseRating", "defenseRating", "netRating")])


def player_game_shots(shot: DataFrame) -> DataFrame:
    made = F.col("made") & F.col("made").isNotNull()
    return shot.groupBy("gameId", "athleteId", "range").agg(F.count("*").alias("att"), F.count_if(made).alias("made"), F.count_if(F.col("assisted") & made).alias("assisted"), F.count_if("high_leverage").alias("hl_att"), F.count_if("garbage").alias("garbage_att"))


SPATIAL = {"xy_shots": 25, "xy_3_shots": 15, "xy_rim_shots": 20}


def split_features(shot: DataFrame, leverage: str = "leverage", strength: str = "strength") -> DataFrame:
    """Counts and gated rates of every leverage x strength split, margins included, one aggregation."""
    d, xy = shot_distance(F.col("x"), F.col("y")), F.col("x").isNotNull() & F.col("y").isNotNull()
    three, made = F.col("range") == "three_pointer", F.col("made")
    n = lambda c, name: F.count_if(c).alias(name)
    aggs = [
        *[x for k, r in (("rim", "rim"), ("mid", "jumper"), ("three", "three_pointer"), ("ft", "free_throw")) for x in (n(F.col("range") == r, f"{k}_att"), n((F.col("range") == r) & made, f"{k}_made"))],
        n(made & F.col("assisted"), "assisted_made"), n(xy, "xy_shots"), n(xy & three, "xy_3_shots"), n(xy & (F.col("range") == "rim"), "xy_rim_shots"),
        n(xy & three & is_corner_three(F.col("x"), F.col("y")), "corner_3"), n(xy & three & (d > 27), "deep_3"), n(xy & (d < 4), "restricted"),
        F.sum(F.when(xy, d)).alias("dist_sum"), F.sum(F.when(xy, d * d)).alias("dist_sq_sum"),
    ]
    out = split_cube(shot, ["season", "athleteId"], [leverage, strength], aggs)
    gate = lambda c: F.col(c) >= SPATIAL[c]
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    mean = rate("dist_sum", "xy_shots")
    return out.withColumns(
        {
            "rim_fg_pct": rate("rim_made", "rim_att"),
            "three_fg_pct": rate("three_made", "three_att"),
            "ft_pct": rate("ft_made", "ft_att"),
            "avg_shot_dist": F.when(gate("xy_shots"), mean),
            "shot_dist_var": F.when(gate("xy_shots"), F.greatest(rate("dist_sq_sum", "xy_shots") - mean * mean, F.lit(0.0))),
            "corner_3_rate": F.when(gate("xy_3_shots"), rate("corner_3", "xy_3_shots")),
            "deep_3_rate": F.when(gate("xy_3_shots"), rate("deep_3", "xy_3_shots")),
            "rim_purity": F.when(gate("xy_rim_shots"), rate("restricted", "xy_rim_shots")),
        }
    )


def team_strength(games: DataFrame) -> DataFrame:
    """Average margin plus the opponents' average margin, ranked in each season; one scan of the games."""
    side = lambda me, opp, a, b: F.struct(F.col(me).alias("teamId"), F.col(opp).alias("oppId"), (F.col(a) - F.col(b)).alias("margin"))
    sides = F.array(side("homeTeamId", "awayTeamId", "homePoints", "awayPoints"), side("awayTeamId", "homeTeamId", "awayPoints", "homePoints"))
    rows = games.where(F.col("homePoints").isNotNull() & F.col("awayPoints").isNotNull()).select("season", F.explode(sides).alias("s")).select("season", "s.*")
    own = rows.groupBy("season", "teamId").agg(F.avg("margin").alias("avg_margin"), F.count("*").alias("games"))
    opp = own.select("season", F.col("teamId").alias("oppId"), F.col("avg_margin").alias("opp_margin"))
    schedule = rows.join(opp, ["season", "oppId"], "left").groupBy("season", "teamId").agg(F.avg("opp_margin").alias("sos"))
    out = own.join(schedule, ["season", "teamId"], "left").withColumn("srs", F.col("avg_margin") + F.coalesce("sos", F.lit(0.0)))
    return out.withColumn("rank", F.dense_rank().over(W.partitionBy("season").orderBy(F.desc("srs"))))


def box_from_events(plays: DataFrame) -> DataFrame:
    """Assists, steals, blocks, turnovers and games of each player from event participants."""
    kind = F.lower(F.col("playType"))
    actor, second = F.get(F.col("participants"), F.lit(0))["id"], F.get(F.col("participants"), F.lit(1))["id"]
    made = F.col("scoringPlay")
    roles = F.array_compact(F.array(
        F.when(made & second.isNotNull(), F.struct(second.alias("athleteId"), F.lit("ast").alias("stat"))),
        F.when(kind.contains("steal"), F.struct(actor.alias("athleteId"), F.lit("stl").alias("stat"))),
        F.when(kind.contains("block"), F.struct(actor.alias("athleteId"), F.lit("blk").alias("stat"))),
        F.when(kind.contains("turnover"), F.struct(actor.alias("athleteId"), F.lit("tov").alias("stat"))),
    ))
    stats = plays.select("season", F.explode(roles).alias("r")).where("r.athleteId is not null").groupBy("season", F.col("r.athleteId").alias("athleteId")).agg(*[F.count_if(F.col("r.stat") == s).alias(s) for s in ("ast", "stl", "blk", "tov")])
    games = participants(plays).groupBy("season", "athleteId").agg(F.count_distinct("gameId").alias("games"))
    return games.join(stats, ["season", "athleteId"], "left").fillna(0, ["ast", "stl", "blk", "tov"])


def missing_flags(df: DataFrame, cols: list[str]) -> list[Column]:
    return [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols]
