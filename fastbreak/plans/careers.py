"""Player seasons and careers: roll-ups, windows, transfers, development, exposure, peaks, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.functions.rates import late_bloom, ratio, recency_weight, shock
from fastbreak.operators.aggregates import wls_slope
from fastbreak.operators.windows import changed, last_n_totals, peak, rolling_mean, sessionize, top_one


def collapse_teams(df: DataFrame, counts: list[str], meta: list[str], minutes: str = "minutes_total", by: tuple[str, ...] = ("athlete_id", "season")) -> DataFrame:
    """One row per player and season: counts summed over teams (all null stays null), meta of the team with most minutes."""
    best = F.max(F.struct(F.coalesce(F.col(minutes), F.lit(-1.0)).alias("m"), *[F.col(c).alias(c) for c in meta]))
    out = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], best.alias("_b"))
    return out.select(*by, *counts, *[F.col(f"_b.{c}").alias(c) for c in meta])


def final_season(df: DataFrame, counts: list[str], meta: list[str], minutes: str = "minutes_total", split: str | None = "split_id") -> DataFrame:
    """The literal last season of each player; its nulls are not filled from earlier ones."""
    base = df.where(F.coalesce(F.col(split), F.lit("ALL")) == "ALL") if split and split in df.columns else df
    last = W.partitionBy("athlete_id").orderBy(F.desc("season"))
    return collapse_teams(base, counts, meta, minutes).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def panel(df: DataFrame, draft: DataFrame | None = None) -> DataFrame:
    """Seasons before the draft with team stints: stint_id, transfer_flag, seasons_in_stint, season_idx."""
    if draft is not None:
        df = df.join(draft.select("athlete_id", "draft_year"), "athlete_id", "left").where(F.col("draft_year").isNull() | (F.col("season") < F.col("draft_year"))).withColumn("has_draft", F.col("draft_year").isNotNull().cast("int"))
    by, order = ["athlete_id"], [F.col("season")]
    moved = changed(F.col("teamId"), by, order)
    out = df.withColumn("transfer_flag", moved.cast("int"))
    out = sessionize(out, by, order, F.col("transfer_flag") == 1, "stint_id")
    out = out.withColumn("seasons_in_stint", F.row_number().over(W.partitionBy("athlete_id", "stint_id").orderBy("season")))
    return out.withColumn("season_idx", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def trajectory(seasons: DataFrame, stat: str) -> DataFrame:
    """Mean, sd, last, final-stint mean, slope (2+ seasons), acceleration (3+) and late bloom of a stat, with missing flags."""
    last_stint = F.max("stint_id").over(W.partitionBy("athlete_id"))
    r = seasons.withColumn("_last", F.col("stint_id") == last_stint)
    order = W.partitionBy("athlete_id").orderBy("season_idx")
    r = r.withColumn("_d", F.col(stat) - F.lag(stat).over(order))
    x, n = F.col("season_idx").cast("double"), F.count(stat)
    out = r.groupBy("athlete_id").agg(
        n.alias("n"), F.avg(stat).alias("mean"), F.stddev_samp(stat).alias("sd"), F.max_by(stat, "season_idx").alias("last"),
        F.avg(F.when(F.col("_last"), F.col(stat))).alias("final_stint_mean"),
        F.when(n >= 2, F.regr_slope(F.col(stat).cast("double"), x)).alias("slope"), F.when(n >= 3, F.regr_slope(F.col("_d").cast("double"), x)).alias("accel"),
    )
    out = out.withColumn("late_bloom", late_bloom(F.col("last"), F.col("mean"), F.col("sd")))
    return out.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in ("slope", "accel", "late_bloom")})


def career(seasons: DataFrame, totals: list[str], rates: list[str], weight: str = "minutes_total") -> DataFrame:
    """Totals, last and first values, mean slopes, deltas and recency-weighted means over a career."""
    w = W.partitionBy("athlete_id").orderBy("season")
    r = seasons.withColumns({"rank": F.row_number().over(w), "years": F.count("*").over(W.partitionBy("athlete_id"))})
    r = r.withColumn("_w", recency_weight(F.col("rank"), F.col("years")))
    aggs: list[Column] = [F.max("years").alias("career_years"), F.max("season").alias("final_season"), *[F.sum(c).alias(f"{c}_career") for c in totals]]
    for c in rates:
        last, first = F.max_by(c, "season"), F.min_by(c, "season")
        ok = F.col(c).isNotNull()
        aggs += [last.alias(f"{c}_final"), F.when(F.count("*") > 1, (last - first) / (F.count("*") - 1)).alias(f"{c}_slope"), (F.sum(F.when(ok, F.col(c) * F.col("_w"))) / F.nullif(F.sum(F.when(ok, F.col("_w"))), F.lit(0.0))).alias(f"{c}_recent"), F.max(F.struct(F.col(c), F.col("season")))["season"].alias(f"{c}_best_season")]
    return r.groupBy("athlete_id").agg(*aggs)


def deltas(seasons: DataFrame, cols: list[str], first_is_zero: bool) -> DataFrame:
    """Change to the season before; the first season is 0 where it has a value, or null."""
    w = W.partitionBy("athlete_id").orderBy("season")
    first = F.row_number().over(w) == 1
    d = lambda c: F.when(first & F.col(c).isNotNull(), F.lit(0.0) if first_is_zero else None).otherwise(F.col(c) - F.lag(c).over(w))
    return seasons.withColumns({f"{c}_delta": d(c) for c in cols})


def season_windows(games: DataFrame, made: str, tried: str, n: int = 5) -> DataFrame:
    """Totals of the last n games and the n before in each season, their rates and change; values are null where the mask is 0."""
    t = last_n_totals(games, ["athlete_id", "season"], [F.col("game_date"), F.col("game_id")], [made, tried], n)
    last, prev = ratio(F.col(f"{made}_last{n}"), F.col(f"{tried}_last{n}")), ratio(F.col(f"{made}_prev{n}"), F.col(f"{tried}_prev{n}"))
    return t.withColumns({f"rate_last{n}": last, f"rate_prev{n}": prev}).withColumns({f"rate_delta{n}": F.col(f"rate_last{n}") - F.col(f"rate_prev{n}"), f"has_last{n}": F.col(f"{tried}_last{n}").isNotNull().cast("int")})


def breakout(games: DataFrame, stat: str, n: int = 3) -> DataFrame:
    """When in a season the best rolling mean ends: 0 first game, 1 last."""
    by, order = ["athlete_id", "season"], [F.col("game_date"), F.col("game_id")]
    w = W.partitionBy(*by).orderBy(*order)
    r = games.withColumns({"_m": rolling_mean(by, order, stat, n), "_i": F.row_number().over(w), "_n": F.count("*").over(W.partitionBy(*by))}).where("_m is not null")
    best = top_one(r, by, [F.desc("_m"), F.col("_i")])
    return best.select(*by, F.col("_m").alias("best"), F.when(F.col("_n") > 1, (F.col("_i") - 1) / (F.col("_n") - 1)).alias("timing"))


def transfers(seasons: DataFrame, scales: dict[str, float]) -> DataFrame:
    """One row per change of team with before, after, change and the overall shock."""
    w = W.partitionBy("athlete_id").orderBy("season")
    r = seasons.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ["teamId", "season", *scales]}).where(F.col("prev_teamId").isNotNull() & (F.col("prev_teamId") != F.col("teamId")))
    r = r.withColumns({f"{c}_change": F.col(c) - F.col(f"prev_{c}") for c in scales})
    return r.withColumn("shock", shock([(F.col(f"{c}_change"), s) for c, s in scales.items()]))


def transfer_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("athlete_id").agg(F.count("*").alias("n_transfers"), F.max("season").alias("last_transfer"), F.avg("shock").alias("mean_shock"), F.max(F.abs("shock")).alias("max_shock"))


def development(seasons: DataFrame, y: str, weight: str, t: str = "t") -> DataFrame:
    """Weighted slope over seasons with standard error and Gaussian 10/50/90 % points."""
    out = seasons.groupBy("athlete_id").agg(*wls_slope(F.col(t).cast("double"), F.col(y), F.col(weight)))
    z = 1.2815515655446004
    return out.withColumns({"p10": F.col("slope") - z * F.col("slope_se"), "p50": F.col("slope"), "p90": F.col("slope") + z * F.col("slope_se")})


def development_shrunk(seasons: DataFrame, y: str, weight: str, t: str = "t", prior_var: float | None = None) -> DataFrame:
    """Empirical-Bayes slopes: own slopes shrunk to the weighted mean by their variance; the between variance is estimated by moments."""
    own = development(seasons, y, weight, t).where(F.col("slope").isNotNull()).withColumn("_v", F.coalesce(F.pow("slope_se", 2), F.lit(1.0)) + 1e-9)
    mu = own.agg(F.sum(F.col("slope") / F.col("_v")) / F.sum(1 / F.col("_v"))).scalar()
    tau2 = F.lit(prior_var) if prior_var is not None else own.agg(F.greatest(F.var_samp("slope") - F.avg("_v"), F.lit(1e-6))).scalar()
    both = own.withColumn("_k", tau2 / (tau2 + F.col("_v")))
    return both.select("athlete_id", "n", "slope", (F.col("_k") * F.col("slope") + (1 - F.col("_k")) * mu).alias("slope_shrunk"), F.sqrt(F.col("_k") * F.col("_v")).alias("sd_shrunk"))


def exposure(df: DataFrame) -> DataFrame:
    """Games played with provenance: the feed, the backfill if the feed lacks it or is 5 short, text, then derived; conflict if the top two differ by 8."""
    api, back, text, derived = (F.col(c).cast("double") for c in ("games_played", "backfill_games_played", "hist_games_played_text", "college_games_played"))
    use_back = back.isNotNull() & (api.isNull() | (back >= api + 5))
    source = F.when(use_back, "backfill").when(api.isNotNull(), "api").when(text.isNotNull(), "text").when(derived.isNotNull(), "derived").otherwise("missing")
    value = F.when(use_back, back).otherwise(F.coalesce(api, text, derived))
    ranked = F.sort_array(F.array_compact(F.array(api, back, text, derived)), asc=False)
    conflict = F.coalesce(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)) >= 8, F.lit(False))
    return df.withColumns({"games_final": value, "games_source": source, "games_conflict": conflict})


def rookie_season(seasons: DataFrame, draft: DataFrame, least_minutes: float = 200) -> DataFrame:
    """Year after the draft, else the first season over the minutes, else the first season."""
    first = seasons.groupBy("nba_id").agg(F.min(F.when(F.col("minutes") > least_minutes, F.col("season"))).alias("_big"), F.min("season").alias("_any"))
    return first.join(draft.select("nba_id", "draft_year"), "nba_id", "left").select("nba_id", F.coalesce(F.col("draft_year") + 1, "_big", "_any").alias("rookie_season"))


def first_year(seasons: DataFrame, rookie: DataFrame) -> DataFrame:
    """The rookie season's row with most minutes."""
    at = seasons.join(rookie, "nba_id").where(F.col("season") == F.col("rookie_season"))
    return top_one(at, ["nba_id"], [F.desc("minutes"), F.col("team")])


def peak_window(seasons: DataFrame, stat: str) -> DataFrame:
    return peak(seasons, ["nba_id"], "season", stat)


def horizon(seasons: DataFrame, stat: str, years: int = 7) -> DataFrame:
    """Best value and last change inside the first years of a career."""
    w = W.partitionBy("nba_id").orderBy("season")
    r = seasons.withColumn("_y", F.col("season") - F.min("season").over(W.partitionBy("nba_id"))).where(F.col("_y") < years).withColumn("_d", F.col(stat) - F.lag(stat).over(w))
    return r.groupBy("nba_id").agg(F.max(stat).alias("peak"), F.max_by("_d", "season").alias("last_change"), F.count(stat).alias("seasons"))


def gaps(nba: DataFrame, college: DataFrame, crosswalk: DataFrame, stats: list[str]) -> DataFrame:
    both = crosswalk.join(nba, "nba_id").join(college.select("athlete_id", *[F.col(c).alias(f"c_{c}") for c in stats]), "athlete_id")
    return both.select("nba_id", "athlete_id", *[(F.col(c) - F.col(f"c_{c}")).alias(f"{c}_gap") for c in stats])


def growth(seasons: DataFrame, who: str, season: str, cols: list[str]) -> DataFrame:
    """First and largest value of each measure, the gain between, and whether two seasons or more have one; players without any are left out."""
    aggs = []
    for c in cols:
        x = F.col(c).try_cast("double")
        first, top = F.min_by(x, F.when(x.isNotNull(), F.col(season))), F.max(x)
        aggs += [first.alias(f"{c}_first"), top.alias(f"{c}_max"), (top - first).alias(f"{c}_gain"), (F.count_distinct(F.when(x.isNotNull(), F.col(season))) >= 2).alias(f"{c}_seasons")]
    return seasons.groupBy(who).agg(*aggs).where(F.coalesce(*[F.col(f"{c}_max") for c in cols]).isNotNull())


def impact_stack(sources: dict[str, DataFrame]) -> DataFrame:
    """Union with provenance; one row per player and season, the one with most possessions, ties by source."""
    parts = [d.withColumn("source", F.lit(k)) for k, d in sources.items()]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return top_one(out, ["season", "athlete_id"], [F.desc_nulls_last("poss"), F.col("source")])


def align_seasons(df: DataFrame, who: str = "player") -> DataFrame:
    """Y1, Y2, ... of each player."""
    return df.withColumn("label", F.concat(F.lit("Y"), F.row_number().over(W.partitionBy(who).orderBy("season"))))
