"""Tables of the site: seasons by split, careers, overlay rows and the comparison of players."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.functions.rates import color_scale, per_40, true_shooting
from fastbreak.operators.aggregates import overlapping_splits


def season_table(games: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per player, season and split (all, against the top 50, against the top 100): totals and rates."""
    r = games.join(ranks.select("season", F.col("teamId").alias("oppId"), F.col("rank").alias("opp_rank")), ["season", "oppId"], "left")
    cut = lambda n: F.coalesce(F.col("opp_rank") <= n, F.lit(False))
    s = overlapping_splits(r, {"ALL": F.lit(True), "VS_TOP50": cut(50), "VS_TOP100": cut(100)})
    sums = ["minutes", "pts", "fga", "fta", "ast", "trb"]
    out = s.groupBy("player", "team", "season", "split_id").agg(F.count("*").alias("g"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumns({"ts": true_shooting(F.col("pts"), F.col("fga"), F.col("fta")), "mpg": F.col("minutes") / F.col("g"), **{f"{c}_40": per_40(F.col(c), F.col("minutes")) for c in ("pts", "ast", "trb")}})


def career_table(seasons: DataFrame) -> DataFrame:
    a = seasons.where("split_id = 'ALL'")
    out = a.groupBy("player").agg(F.count_distinct("season").alias("seasons"), F.max_by("team", "season").alias("team"), F.max("season").alias("last_season"), *[F.sum(c).alias(c) for c in ("g", "minutes", "pts", "fga", "fta")])
    return out.withColumn("ts", true_shooting(F.col("pts"), F.col("fga"), F.col("fta")))


def overlay_rows(dataset: DataFrame, shown: DataFrame) -> DataFrame:
    """Dataset rows that the page does not show, neither by player nor by player and team."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    s = shown.select(key("player").alias("_p"), key("team").alias("_t"))
    d = dataset.withColumns({"_p": key("player"), "_t": key("team")})
    alone = s.where(F.col("_t").isNull() | (F.col("_t") == "")).select("_p").distinct()
    return d.join(s.select("_p", "_t").distinct(), ["_p", "_t"], "left_anti").join(alone, "_p", "left_anti").drop("_p", "_t")


def insert_sorted(shown: DataFrame, added: DataFrame, c: str, ties: list) -> DataFrame:
    """Shown and added rows in the direction of the shown order (column pos): that of its first unequal neighbours.

    For one shown page: its rows are compared in one task.
    """
    w = W.orderBy("pos")
    step = shown.select("pos", (F.col(c) - F.lag(c).over(w)).alias("d")).where("d <> 0").orderBy("pos").limit(1)
    sign = step.agg(F.coalesce(F.first(F.signum("d")), F.lit(-1.0))).scalar()
    both = shown.unionByName(added, allowMissingColumns=True).withColumn("_key", F.col(c) * sign)
    return both.orderBy(F.col("_key").asc_nulls_last(), *ties).drop("_key")


def compare(seasons: DataFrame, a: str, b: str, stats: list[str], inverted: frozenset[str] = frozenset()) -> DataFrame:
    """Two players season by season (Y1, Y2, ...): z-scores in the league season and the edge of the first."""
    from fastbreak.operators.windows import zscore
    from fastbreak.plans.careers import align_seasons

    z = seasons.withColumns({f"z_{c}": zscore(F.col(c), ["season"]) * (-1 if c in inverted else 1) for c in stats})
    both = align_seasons(z.where(F.col("player").isin(a, b)))
    long = both.select("player", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(f"z_{c}").alias("z"), color_scale(F.col(f"z_{c}")).alias("color")) for c in stats])).alias("x")).select("player", "label", "x.*")
    side = lambda p, n: long.where(F.col("player") == p).select("label", "stat", F.col("z").alias(f"z_{n}"), F.col("color").alias(f"color_{n}"))
    return side(a, "a").join(side(b, "b"), ["label", "stat"], "full").withColumn("edge", F.col("z_a") - F.col("z_b"))


def latest(seasons: DataFrame, players: list[str]) -> DataFrame:
    """The last season of each of the players named; of equal seasons any one is as good as they repeat a player's year."""
    w = W.partitionBy("player").orderBy(F.desc("season"))
    return seasons.where(F.col("player").isin(players)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def spread(league: DataFrame, stats: list[str]) -> DataFrame:
    """Mean and population sd of each stat over all rows: stat, mean, sd."""
    one = league.agg(*(x for i, c in enumerate(stats) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")) for i, c in enumerate(stats)))).alias("x")).select("x.*")


def _against(seasons: DataFrame, players: list[str], stats: list[str], league: DataFrame | None) -> DataFrame:
    """player, stat, v, mean, sd of the players' last seasons."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in stats))).alias("x")
    return latest(seasons, players).select("player", each).select("player", "x.*").join(F.broadcast(spread(seasons if league is None else league, stats)), "stat")


def radar(seasons: DataFrame, players: list[str], stats: list[str], inverted: frozenset[str] = frozenset(), league: DataFrame | None = None) -> DataFrame:
    """player, stat, value of a chart from 0 to 100 whose middle is the league's mean and whose ends are 2.5 sds off.

    Values are those of a player's last season; stats in `inverted` count the other way round; a missing
    value, or a stat without spread, stands in the middle. The league is all seasons, or rows of its own.
    """
    z = (F.col("v") - F.col("mean")) / F.col("sd") * F.when(F.col("stat").isin(*inverted), -1).otherwise(1) if inverted else (F.col("v") - F.col("mean")) / F.col("sd")
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (z + 2.5) / 5 * 100))
    return _against(seasons, players, stats, league).select("player", "stat", F.when(F.col("v").isNotNull() & (F.col("sd") > 0), value).otherwise(50.0).alias("value"))


def scatter(seasons: DataFrame, players: list[str], x: str, y: str, league: DataFrame | None = None) -> DataFrame:
    """player, x, y of the players' last seasons (0 where missing) with the league's means as the cross of the chart."""
    wide = _against(seasons, players, [x, y], league).groupBy("player")
    at = lambda c, v: F.coalesce(F.max(F.when(F.col("stat") == c, F.col(v))), F.lit(0.0))
    return wide.agg(at(x, "v").alias("x"), at(y, "v").alias("y"), at(x, "mean").alias("x_mean"), at(y, "mean").alias("y_mean"))


def edges(seasons: DataFrame, a: str, b: str, stats: list[str], inverted: frozenset[str] = frozenset(), league: DataFrame | None = None) -> DataFrame:
    """stat, diff: how many of the league's sds the second player's last season is ahead of the first's; missing values are 0, no spread is no edge."""
    both = _against(seasons, [a, b], stats, league).groupBy("stat").agg(F.max("sd").alias("sd"), *(F.coalesce(F.max(F.when(F.col("player") == p, F.col("v"))), F.lit(0.0)).alias(n) for p, n in ((a, "a"), (b, "b"))), F.count_distinct("player").alias("n"))
    sign = F.when(F.col("stat").isin(*inverted), -1).otherwise(1) if inverted else F.lit(1)
    return both.where("n = 2").select("stat", F.when(F.col("sd") > 0, sign * (F.col("b") - F.col("a")) / F.col("sd")).otherwise(0.0).alias("diff"))
