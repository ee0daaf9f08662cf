"""Queries of table shaping: weighted windows, boards, nested seasons, lines of text, merged columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fastbreak.functions import arrays, clock
from fastbreak.operators import aggregates as agg
from fastbreak.operators import joins, ordering, windows
from fastbreak.plans import impact, staging
from fastbreak.queries import SEASON, query, r, season, t
from fastbreak.sources import files

TEAM_GAMES = "(SELECT l_suppkey AS team, year(l_shipdate) AS season, l_orderkey AS game, l_linenumber AS n, l_partkey AS part, l_extendedprice AS price, l_quantity AS q, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity END AS poss, CASE WHEN l_orderkey % 6 > 0 THEN l_extendedprice / 1000 END AS net FROM lineitem)"


@query(f"""SELECT team, season, game, n, part, v.k AS window_id, CASE v.k WHEN 'last10' THEN count(*) OVER ten ELSE count(*) OVER whole END AS n_games,
round(CASE v.k WHEN 'last10' THEN sum(coalesce(poss, 0)) OVER ten ELSE sum(coalesce(poss, 0)) OVER whole END, 2) AS poss,
round(CASE v.k WHEN 'last10' THEN CASE WHEN sum(coalesce(poss, 0)) OVER ten > 0 THEN sum(coalesce(net, 0) * coalesce(poss, 0)) OVER ten / sum(coalesce(poss, 0)) OVER ten END
ELSE CASE WHEN sum(coalesce(poss, 0)) OVER whole > 0 THEN sum(coalesce(net, 0) * coalesce(poss, 0)) OVER whole / sum(coalesce(poss, 0)) OVER whole END END, 3) AS net
FROM {TEAM_GAMES} g CROSS JOIN (VALUES ('last10'), ('season')) v(k)
WINDOW ten AS (PARTITION BY v.k, team, season ORDER BY game, n, part, price, q ROWS 9 PRECEDING), whole AS (PARTITION BY v.k, team, season ORDER BY game, n, part, price, q ROWS UNBOUNDED PRECEDING)""")
def window_weighted(spark, d):
    """Ratings of a team over its last ten games and the season so far, weighted by possessions."""
    li = t(spark, d, "lineitem")
    g = li.select(F.col("l_suppkey").alias("team"), F.year("l_shipdate").alias("season"), F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity")).alias("poss"), F.when(F.col("l_orderkey") % 6 > 0, F.col("l_extendedprice") / 1000).alias("net"))
    out = windows.rolling_weighted(g.withColumn("w", F.col("poss")), ["team", "season"], [F.col(c) for c in ("game", "n", "part", "price", "q")], "w", ["net"], ["poss"])
    return out.select("team", "season", "game", "n", "part", "window_id", "n_games", r("poss", 2).alias("poss"), r("net", 3).alias("net"))


@query(f"""WITH s AS {SEASON}, b AS (SELECT athlete_id, season, 'pts' AS board, pts AS value FROM s WHERE games >= 2 UNION ALL SELECT athlete_id, season, 'rate', pts / minutes_total FROM s WHERE games >= 2 UNION ALL SELECT athlete_id, season, 'cheap', CASE WHEN disc > 0 THEN -pts END FROM s WHERE games >= 2)
SELECT board, row_number() OVER (PARTITION BY board ORDER BY value DESC, athlete_id, season) AS place, athlete_id, season, round(value, 4) AS value FROM b WHERE value IS NOT NULL QUALIFY place <= 8""")
def order_featured(spark, d):
    """Eight leading player seasons on each of three boards."""
    boards = {"pts": F.col("pts"), "rate": F.col("pts") / F.col("minutes_total"), "cheap": F.when(F.col("disc") > 0, -F.col("pts"))}
    return ordering.featured(season(spark, d), boards, "games", 2, 8, [F.col("athlete_id"), F.col("season")]).select("board", "place", "athlete_id", "season", r("value").alias("value"))


@query("""SELECT o_custkey, coalesce(bool_or(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice > 450000 END), false) AS some, bool_and(coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice > 50000 END, false)) AS every FROM orders GROUP BY o_custkey""")
def agg_any_all(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return t(spark, d, "orders").groupBy("o_custkey").agg(agg.any_true(F.when(k % 4 > 0, p > 450000)).alias("some"), agg.all_true(F.when(k % 9 > 0, p > 50000)).alias("every"))


@query("""SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END) AS price, o_orderstatus AS status_x FROM orders""")
def join_suffixes(spark, d):
    """A merge's two price columns as one, the right side first; a column without a partner stays."""
    o, k, p = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    return joins.coalesce_suffixes(o.select(k.alias("k"), F.when(k % 2 == 0, p * 2).alias("price_x"), F.when(k % 3 == 0, p).alias("price_y"), F.col("o_orderstatus").alias("status_x")))


@query("""WITH a AS (SELECT c_custkey AS ak, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 700 END AS ai, upper(c_name) || ' ' AS an FROM customer), b AS (SELECT c_custkey AS bk, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 500 END AS bi, c_name AS bn FROM customer)
SELECT ak, bk FROM a JOIN b ON ai = bi UNION ALL SELECT ak, bk FROM a JOIN b ON lower(trim(an)) = lower(trim(bn)) AND (ai IS NULL OR bi IS NULL)""")
def join_ids_and_names(spark, d):
    """Customers linked by repeated ids where both sides have one, by names where one lacks it."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    a = c.select(k.alias("ak"), F.when(k % 3 > 0, k % 700).alias("ai"), F.concat(F.upper("c_name"), F.lit(" ")).alias("an"))
    b = c.select(k.alias("bk"), F.when(k % 4 > 0, k % 500).alias("bi"), F.col("c_name").alias("bn"))
    return joins.by_id_or_name(a, b, "ai", "bi", "an", "bn").select("ak", "bk")


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS fg_made, l_extendedprice AS fg_attempted, NULL::DOUBLE AS fg_pct, NULL::DOUBLE AS two_made, CASE WHEN l_linenumber > 1 THEN l_tax END AS three_made, NULL::DOUBLE AS ft_pct, l_discount AS oreb, NULL::DOUBLE AS reb, l_tax AS "ws_totalPer40", NULL::VARCHAR AS "seasonType" FROM lineitem""")
def plan_flat_seasons(spark, d):
    """Nested groups made of line items, flattened; some lack members, one is missing in part of the rows."""
    c = F.col
    li = t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct(c("l_quantity").alias("made"), c("l_extendedprice").alias("attempted")).alias("fieldGoals"), F.when(c("l_linenumber") > 1, F.struct(c("l_tax").alias("made"))).alias("threePointFieldGoals"),
        F.create_map(F.lit("offensive"), c("l_discount")).alias("rebounds"), F.struct(c("l_tax").alias("totalPer40")).alias("winShares"),
    )
    return staging.flat_player_seasons(li).select("l_orderkey", "l_linenumber", "fg_made", "fg_attempted", "fg_pct", "two_made", "three_made", "ft_pct", "oreb", "reb", "ws_totalPer40", "seasonType")


@query("""SELECT c_custkey AS k, 'Say "' || c_name || '", twice' AS said, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS bal FROM customer""")
def fn_csv_lines(spark, d):
    """Lines of quoted text parsed back into columns, whose names are then cleaned."""
    c = t(spark, d, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"Say ""'), F.col("c_name"), F.lit('"", twice",'), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal").cast("string")).otherwise(""))
    rows = c.select(files.parse_csv_line(line, "K bigint, Said string, Bal double").alias("x")).select("x.*")
    return arrays.lower_keys(rows.toDF(" K", "Said ", "BAL"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 7 > 0 THEN 703.0 * (100 + p_size) / power(60 + p_size % 7, 2) END, 6) AS bmi FROM part""")
def fn_bmi(spark, d):
    size = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", r(clock.bmi(100 + size, F.when(size % 7 > 0, 60 + size % 7).otherwise(0)), 6).alias("bmi"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, list_sort(list(DISTINCT l_partkey % 13) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS f, CASE WHEN l_quantity < 5 THEN 0.1 ELSE 1.0 END AS c FROM lineitem),
g AS (SELECT l_orderkey, avg(CASE WHEN len(f) = 5 THEN 1.0 ELSE 0.0 END) AS full_share, avg(CASE WHEN c <= 0.1 THEN 1.0 ELSE 0.0 END) AS low, len(list_distinct(flatten(list(f)))) AS players FROM l GROUP BY l_orderkey)
SELECT l_orderkey AS "gameId", round(full_share, 6) AS full_share, round(low, 6) AS low, players, full_share >= 0.8 AND low <= 0.05 AND players >= 10 AS passes FROM g""")
def plan_game_quality(spark, d):
    """Orders as games whose floor is the last five lines' parts."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(-4, 0)
    floor = F.array_sort(F.collect_set(F.col("l_partkey") % 13).over(w)).cast("array<string>")
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("gameId"), floor.alias("onfloor"), F.when(F.col("l_quantity") < 5, 0.1).otherwise(1.0).alias("confidence"))
    return impact.game_quality(li).select("gameId", r("full", 6).alias("full_share"), r("placeholder", 6).alias("low"), "players", "passes")


LEAGUE = f"(SELECT athlete_id::VARCHAR AS player, season, pts, games::DOUBLE AS games, CASE WHEN games > 1 THEN disc END AS disc FROM {SEASON})"


def league(spark, d):
    return season(spark, d).select(F.col("athlete_id").cast("string").alias("player"), "season", "pts", F.col("games").cast("double").alias("games"), F.when(F.col("games") > 1, F.col("disc")).alias("disc"))


@query(f"""WITH l AS {LEAGUE}, p AS (SELECT * FROM l WHERE player IN ('7', '11', '42') QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) = 1),
x AS (SELECT player, 'pts' AS stat, pts AS v, (SELECT avg(pts) FROM l) AS m, (SELECT stddev_pop(pts) FROM l) AS s FROM p UNION ALL SELECT player, 'games', games, (SELECT avg(games) FROM l), (SELECT stddev_pop(games) FROM l) FROM p UNION ALL SELECT player, 'disc', disc, (SELECT avg(disc) FROM l), (SELECT stddev_pop(disc) FROM l) FROM p)
SELECT player, stat, round(CASE WHEN v IS NULL OR NOT s > 0 THEN 50 ELSE greatest(0, least(100, ((v - m) / s * CASE WHEN stat = 'disc' THEN -1 ELSE 1 END + 2.5) / 5 * 100)) END, 5) AS value FROM x""")
def plan_radar(spark, d):
    from fastbreak.plans import site

    return site.radar(league(spark, d), ["7", "11", "42"], ["pts", "games", "disc"], frozenset({"disc"})).select("player", "stat", r("value", 5).alias("value"))


@query(f"""WITH l AS {LEAGUE} SELECT player, round(coalesce(pts, 0), 2) AS x, round(coalesce(disc, 0), 6) AS y, round((SELECT avg(pts) FROM l), 4) AS x_mean, round((SELECT avg(disc) FROM l), 6) AS y_mean FROM l WHERE player IN ('7', '11', '42') QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) = 1""")
def plan_scatter(spark, d):
    from fastbreak.plans import site

    s = site.scatter(league(spark, d), ["7", "11", "42"], "pts", "disc")
    return s.select("player", r("x", 2).alias("x"), r("y", 6).alias("y"), r("x_mean").alias("x_mean"), r("y_mean", 6).alias("y_mean"))


@query(f"""WITH l AS {LEAGUE}, p AS (SELECT * FROM l WHERE player IN ('7', '11') QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) = 1), a AS (SELECT * FROM p WHERE player = '7'), b AS (SELECT * FROM p WHERE player = '11')
SELECT 'pts' AS stat, round((coalesce(b.pts, 0) - coalesce(a.pts, 0)) / (SELECT stddev_pop(pts) FROM l), 6) AS diff FROM a, b UNION ALL SELECT 'disc', round(-(coalesce(b.disc, 0) - coalesce(a.disc, 0)) / (SELECT stddev_pop(disc) FROM l), 6) FROM a, b""")
def plan_edges(spark, d):
    from fastbreak.plans import site

    return site.edges(league(spark, d), "7", "11", ["pts", "disc"], frozenset({"disc"})).select("stat", r("diff", 6).alias("diff"))


@query("""SELECT year(o_orderdate)::INTEGER AS season, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def src_seasons(spark, d):
    """Orders written to a file of each year and read back by one pattern, the year from the files' names."""
    import uuid

    from fastbreak.session import shared_folder

    path = f"{shared_folder(spark)}/seasons-{uuid.uuid4().hex}"
    o = t(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice")
    for (year,) in o.select("y").distinct().orderBy("y").collect():  # a few years
        files.write_csv(o.where(F.col("y") == year).drop("y"), f"{path}/stats_{year}.csv")
    back = files.read_season_files(spark, f"{path}/stats_*.csv", "o_orderkey bigint, o_totalprice double")
    return back.groupBy("season").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
