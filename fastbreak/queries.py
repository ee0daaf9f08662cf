"""Queries over the driver's star-schema tables, each with the SQL that checks it.

Parts stand for players, suppliers for teams, orders for games, line items for player games, and the
ship year for the season.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastbreak.functions import arrays, clock, rates, text
from fastbreak.operators import aggregates as agg
from fastbreak.operators import joins, ordering, sets, windows
from fastbreak.operators import predicates as pred
from fastbreak.plans import audits, careers, staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, n: int = 4):
    return F.round(c, n)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").withColumn("season", F.year("l_shipdate"))


LINES = "(SELECT *, year(l_shipdate)::INTEGER AS season FROM lineitem)"
#: A player's season with one team, and a player's season.
TEAM_SEASON = f"(SELECT l_partkey AS athlete_id, season, l_suppkey AS teamId, sum(l_quantity) AS minutes_total, count(*) AS games, sum(l_extendedprice) AS pts FROM {LINES} GROUP BY ALL)"
SEASON = f"(SELECT l_partkey AS athlete_id, season, sum(l_quantity) AS minutes_total, count(*) AS games, sum(l_extendedprice) AS pts, sum(l_discount) AS disc FROM {LINES} GROUP BY ALL)"


def team_season(spark, d):
    return lines(spark, d).groupBy(F.col("l_partkey").alias("athlete_id"), "season", F.col("l_suppkey").alias("teamId")).agg(F.sum("l_quantity").alias("minutes_total"), F.count("*").alias("games"), F.sum("l_extendedprice").alias("pts"))


def season(spark, d):
    return lines(spark, d).groupBy(F.col("l_partkey").alias("athlete_id"), "season").agg(F.sum("l_quantity").alias("minutes_total"), F.count("*").alias("games"), F.sum("l_extendedprice").alias("pts"), F.sum("l_discount").alias("disc"))


def games(spark, d):
    """Customer nation against supplier nation in a year, scored by price and tax."""
    li, o, c, s = lines(spark, d), t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "supplier")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select("season", F.col("c_nationkey").alias("homeTeamId"), F.col("s_nationkey").alias("awayTeamId"), F.floor(F.col("l_extendedprice") / 1000).alias("homePoints"), F.floor(F.col("l_quantity")).alias("awayPoints"))


GAMES = f"(SELECT season, c_nationkey AS h, s_nationkey AS a, floor(l_extendedprice / 1000) AS hp, floor(l_quantity) AS ap FROM {LINES} l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"""WITH g AS {GAMES}, x AS (SELECT season, h AS t, a AS o, hp - ap AS m FROM g UNION ALL SELECT season, a, h, ap - hp FROM g),
own AS (SELECT season, t, avg(m) AS am, count(*) AS n FROM x GROUP BY ALL), sos AS (SELECT x.season, x.t, avg(own.am) AS s FROM x LEFT JOIN own ON own.season = x.season AND own.t = x.o GROUP BY ALL)
SELECT season, t AS "teamId", n AS games, round(am, 4) AS avg_margin, round(am + coalesce(s, 0), 4) AS srs, dense_rank() OVER (PARTITION BY season ORDER BY round(am + coalesce(s, 0), 9) DESC) AS rank FROM own LEFT JOIN sos USING (season, t)""")
def team_strength(spark, d):
    s = staging.team_strength(games(spark, d)).drop("rank")
    from pyspark.sql import Window as W

    rank = F.dense_rank().over(W.partitionBy("season").orderBy(F.desc(F.round("srs", 9))))
    return s.select("season", "teamId", "games", r("avg_margin").alias("avg_margin"), r("srs").alias("srs"), rank.alias("rank"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, count(*) FILTER (WHERE l_discount > 0.05) AS n_disc, round(sum(CASE WHEN l_tax > 0.04 THEN l_extendedprice END), 2) AS taxed,
round(avg(l_quantity), 4) AS mean_qty, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS teams FROM lineitem GROUP BY ALL""")
def agg_conditional(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"), F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), r(F.sum(F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice"))), 2).alias("taxed"),
        r(F.avg("l_quantity")).alias("mean_qty"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count_distinct("l_suppkey").alias("teams"))


@query("""WITH x AS (SELECT l_suppkey, CASE WHEN l_discount > 0.02 THEN l_tax END AS x, l_quantity - 5 AS w FROM lineitem)
SELECT l_suppkey, round(sum(x * w) / nullif(sum(w), 0), 6) AS wavg, round(sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END) / nullif(sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END), 0), 6) AS wavg_present FROM x GROUP BY 1""")
def agg_weighted(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_discount") > 0.02, F.col("l_tax")).alias("x"), (F.col("l_quantity") - 5).alias("w"))
    return x.groupBy("l_suppkey").agg(r(agg.wavg(F.col("x"), F.col("w")), 6).alias("wavg"), r(agg.wavg_present(F.col("x"), F.col("w")), 6).alias("wavg_present"))


@query("""SELECT l_suppkey, l_quantity, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS k FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1""")
def agg_mode(spark, d):
    return agg.mode_by(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""SELECT l_suppkey, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(stddev_samp(l_tax), 8) AS sd, round(stddev_pop(l_tax), 8) AS sdp FROM lineitem GROUP BY 1""")
def agg_quantiles(spark, d):
    p = lambda q: r(F.percentile("l_extendedprice", F.lit(q)))
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(r(F.median("l_extendedprice")).alias("med"), p(0.05).alias("p05"), p(0.95).alias("p95"), r(F.stddev_samp("l_tax"), 8).alias("sd"), r(F.stddev_pop("l_tax"), 8).alias("sdp"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS prios, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1""")
def agg_lists(spark, d):
    keys = agg.ordered_list(F.col("o_orderkey").cast("string"), F.struct("o_orderdate", "o_orderkey"))
    return t(spark, d, "orders").groupBy("o_custkey").agg(agg.distinct_list(F.col("o_orderpriority")).alias("prios"), F.array_join(keys, ",").alias("keys"))


@query("""SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def agg_duplicates(spark, d):
    return agg.duplicate_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query(f"""SELECT season, CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM {LINES} GROUP BY GROUPING SETS ((season), (season, l_returnflag), (season, l_linestatus), (season, l_returnflag, l_linestatus))""")
def agg_split_cube(spark, d):
    return agg.split_cube(lines(spark, d), ["season"], ["l_returnflag", "l_linestatus"], [F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty")])


@query("""SELECT split_id, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM (SELECT 'ALL' AS split_id, * FROM lineitem UNION ALL SELECT 'VS_TOP50', * FROM lineitem WHERE l_suppkey <= 50 UNION ALL SELECT 'VS_TOP100', * FROM lineitem WHERE l_suppkey <= 100) GROUP BY 1""")
def agg_overlapping_splits(spark, d):
    s = agg.overlapping_splits(t(spark, d, "lineitem"), {"ALL": F.lit(True), "VS_TOP50": F.col("l_suppkey") <= 50, "VS_TOP100": F.col("l_suppkey") <= 100})
    return s.groupBy("split_id").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F')::DECIMAL(18,2)::DOUBLE AS "F_total", sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O')::DECIMAL(18,2)::DOUBLE AS "O_total", sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P')::DECIMAL(18,2)::DOUBLE AS "P_total" FROM orders GROUP BY 1""")
def agg_pivot(spark, d):
    return agg.pivot_wide(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], {"total": r(F.sum("o_totalprice"), 2)})


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_tax > 0.03 THEN l_tax END AS tax FROM lineitem)
SELECT 'l_orderkey' AS "column", count(*) AS n, (count(*) - count(l_orderkey)) AS n_null, round((count(*) - count(l_orderkey)) / count(*), 6) AS null_share FROM x UNION ALL SELECT 'tax', count(*), count(*) - count(tax), round((count(*) - count(tax)) / count(*), 6) FROM x""")
def agg_null_profile(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_tax") > 0.03, F.col("l_tax")).alias("tax"))
    return agg.null_profile(x).withColumn("null_share", r("null_share", 6))


@query("""SELECT o_orderpriority, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)""")
def agg_value_shares(spark, d):
    return agg.value_shares(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus").withColumn("share", r("share", 6))


@query("""WITH x AS (SELECT l_suppkey, l_quantity AS a, l_extendedprice AS b FROM lineitem), k AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY a) + (count(*) OVER (PARTITION BY l_suppkey, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY l_suppkey ORDER BY b) + (count(*) OVER (PARTITION BY l_suppkey, b) - 1) / 2 AS rb FROM x)
SELECT l_suppkey, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY 1""")
def agg_spearman(spark, d):
    return agg.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]).withColumn("spearman", r("spearman", 6))


@query("""SELECT l_suppkey, round(greatest(sum(l_quantity * l_quantity) / count(*) - power(sum(l_quantity) / count(*), 2), 0), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY 1""")
def agg_moments(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(r(agg.variance_from_moments(F.sum(q), F.sum(q * q), F.count("*")), 6).alias("v"), r(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"))


@query("""WITH g AS (SELECT avg(l_discount) AS g FROM lineitem), s AS (SELECT l_partkey, count(l_discount) AS n, avg(l_discount) AS m FROM lineitem GROUP BY 1)
SELECT l_partkey, n, round(m, 6) AS mean, round(n / (n + 20.0) * m + (1 - n / (n + 20.0)) * g, 6) AS shrunk FROM s, g""")
def agg_shrunk_mean(spark, d):
    return agg.shrunk_mean(t(spark, d, "lineitem"), ["l_partkey"], "l_discount", 20.0).select("l_partkey", "n", r("mean", 6).alias("mean"), r("shrunk", 6).alias("shrunk"))


@query("""SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1""")
def agg_linear_fit(spark, d):
    fit = t(spark, d, "lineitem").groupBy("l_suppkey").agg(*agg.linear_fit("l_extendedprice", "l_quantity"))
    return fit.select("l_suppkey", r("intercept", 2).alias("intercept"), r("slope").alias("slope"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), b AS (SELECT *, greatest(ceil((k - 1) * 10 / (n - 1)) - 1, 0)::INTEGER AS decile FROM x)
SELECT o_orderstatus, decile, round(avg(o_totalprice), 4) AS mean_predicted, round(avg(o_orderkey), 4) AS mean_actual, count(*) AS n FROM b GROUP BY ALL""")
def agg_calibration(spark, d):
    return agg.calibration(t(spark, d, "orders"), "o_totalprice", "o_orderkey", ["o_orderstatus"]).withColumns({"mean_predicted": r("mean_predicted"), "mean_actual": r("mean_actual")})


@query("""WITH x AS (SELECT o_orderpriority, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS e FROM orders)
SELECT o_orderpriority, count(e) AS n, round(avg(e), 3) AS mean, round(stddev_samp(e), 3) AS sd, round(avg(abs(e)), 3) AS mean_abs, CASE WHEN avg(e) > 0 THEN 'over' WHEN avg(e) < 0 THEN 'under' ELSE 'even' END AS direction FROM x GROUP BY 1""")
def agg_residual_slices(spark, d):
    o = t(spark, d, "orders")
    e = o.withColumn("e", F.col("o_totalprice") - o.agg(F.avg("o_totalprice")).scalar())
    return agg.residual_slices(e, "o_orderpriority", "e").withColumns({c: r(c, 3) for c in ("mean", "sd", "mean_abs")})


@query("""SELECT c_custkey, c_name, n_name, r_name, coalesce(n, 0) AS n_orders, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def join_star(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    c, n, g = t(spark, d, "customer"), t(spark, d, "nation"), t(spark, d, "region")
    j = c.join(o, "c_custkey", "left").join(n, n.n_nationkey == c.c_nationkey).join(g, g.r_regionkey == n.n_regionkey)
    return j.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"), r("total", 2).alias("total"))


@query("""SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def join_full(spark, d):
    a = t(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"))
    b = t(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("y"))
    return joins.full_outer(a, b, ["k"])


@query(f"""WITH p AS {SEASON}, x AS (SELECT a.athlete_id, a.season, b.season AS prior, round(b.pts, 2) AS prior_pts, row_number() OVER (PARTITION BY a.athlete_id, a.season ORDER BY b.season DESC) AS k
FROM p a LEFT JOIN p b ON a.athlete_id = b.athlete_id AND b.season BETWEEN a.season - 4 AND a.season - 2) SELECT athlete_id, season, prior, prior_pts FROM x WHERE k = 1""")
def join_latest_prior(spark, d):
    p = season(spark, d).select("athlete_id", "season", "pts")
    right = p.select("athlete_id", (F.col("season") + 2).alias("at"), F.col("season").alias("prior"), r("pts", 2).alias("prior_pts"))
    return joins.latest_prior(p, right, ["athlete_id"], "season", "at", 2).select("athlete_id", "season", "prior", "prior_pts")


@query(f"""WITH a AS {SEASON}, b AS (SELECT athlete_id, season, round(pts, 2) AS v FROM {SEASON} WHERE games > 1), m AS (SELECT athlete_id, season + s AS season, v, s FROM b, (VALUES (0), (1)) t(s)), k AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, season ORDER BY s) AS n FROM m)
SELECT a.athlete_id, a.season, k.v, k.s AS shift FROM a LEFT JOIN k ON k.athlete_id = a.athlete_id AND k.season = a.season AND n = 1""")
def join_season_shift(spark, d):
    p = season(spark, d)
    right = p.where("games > 1").select("athlete_id", "season", r("pts", 2).alias("v"))
    return joins.shifted(p.select("athlete_id", "season"), right, ["athlete_id"], "season", [0, 1])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def join_anti(spark, d):
    return joins.not_in(t(spark, d, "customer"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def join_semi(spark, d):
    return t(spark, d, "part").join(t(spark, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("""SELECT p_partkey AS k, CASE WHEN l.k IS NULL THEN 0 ELSE 1 END AS covered FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) l ON l.k = p_partkey""")
def join_coverage(spark, d):
    return joins.coverage(t(spark, d, "part").select(F.col("p_partkey").alias("k")), t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), ["k"])


@query("""SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_f, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_p FROM customer""")
def join_presence(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return joins.presence(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), {"has_f": o.where("o_orderstatus = 'F'"), "has_p": o.where("o_orderstatus = 'P'")}, ["k"])


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, a, b) AS k FROM p) WHERE k = 1)
SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s DESC, a, b) AS k2 FROM x) WHERE k2 = 1""")
def join_one_to_one(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("s"))
    return joins.one_to_one(p, "a", "b", [F.desc("s"), F.col("a"), F.col("b")])


@query("""SELECT p_partkey, p_name FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand, p_type) AS n FROM part) WHERE n = 1""")
def join_unique_keys(spark, d):
    return joins.unique_keys(t(spark, d, "part"), ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer), t1 AS (SELECT k, count(DISTINCT s_suppkey) AS m, min(s_suppkey) AS v FROM c JOIN supplier ON s_suppkey = k AND s_nationkey = n GROUP BY k),
t2 AS (SELECT k, count(DISTINCT s_suppkey) AS m, min(s_suppkey) AS v FROM c JOIN supplier ON s_nationkey = n WHERE k NOT IN (SELECT k FROM t1) GROUP BY k)
SELECT c.k, CASE WHEN t1.m = 1 THEN t1.v WHEN t2.m = 1 THEN t2.v END AS v, CASE WHEN t1.m = 1 THEN 'id' WHEN t2.m = 1 THEN 'nation' WHEN t1.m > 1 OR t2.m > 1 THEN 'ambiguous' ELSE 'unresolved' END AS tier FROM c LEFT JOIN t1 USING (k) LEFT JOIN t2 USING (k)""")
def join_tiered(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return joins.tiered(c, "k", [("id", s, ["k", "n"]), ("nation", s.drop("k"), ["n"])], "v")


@query("""SELECT o_orderkey, 'manual' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'api' FROM orders WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def join_prefer(spark, d):
    o = t(spark, d, "orders")
    return joins.prefer(o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("manual").alias("src")), o.where("o_totalprice > 100000").select("o_orderkey", F.lit("api").alias("src")), ["o_orderkey"])


@query("""SELECT p_partkey AS k, coalesce(CASE WHEN p_size > 25 THEN p_size END, CASE WHEN p_retailprice > 950 THEN -p_size END) AS v FROM part""")
def join_override(spark, d):
    p = t(spark, d, "part")
    return joins.override(p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("v")), p.where("p_retailprice > 950").select(F.col("p_partkey").alias("k"), (-F.col("p_size")).alias("v")), ["k"])


@query("""SELECT a.o_orderkey, b.o_orderpriority AS latest FROM orders a JOIN (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1) b USING (o_custkey)""")
def join_latest_value(spark, d):
    o = t(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return joins.latest_value(o, "o_custkey", "at", "o_orderpriority").select("o_orderkey", F.col("o_orderpriority").alias("latest"))


@query("""SELECT round(avg(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 0 ELSE 1 END), 6) AS lost_share FROM part""")
def join_lost_share(spark, d):
    return joins.lost_share(t(spark, d, "part").select(F.col("p_partkey").alias("k")), t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k")), ["k"]).select(r("lost_share", 6).alias("lost_share"))


@query("""WITH c AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS x FROM customer GROUP BY ALL) SELECT CASE l WHEN 1 THEN s ELSE 'ALL' END AS s, CASE m WHEN 1 THEN n::VARCHAR ELSE 'ALL' END AS n, sum(x)::BIGINT AS x FROM c, (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(m) GROUP BY 1, 2""")
def join_wildcards(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("n"), F.col("c_mktsegment").alias("s"))
    return joins.any_wildcard(c, ["n", "s"]).groupBy("s", "n").agg(F.count("*").alias("x"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 3""")
def window_top_k(spark, d):
    return windows.top_k(t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) - 1) / 2 AS ar FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC NULLS LAST)""")
def window_ranks(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    ranks = windows.value_ranks(o, ["o_orderstatus"], "o_orderpriority", True).alias("v")
    both = o.alias("o").join(ranks, F.col("o.o_orderstatus").eqNullSafe(F.col("v.o_orderstatus")) & F.col("o.o_orderpriority").eqNullSafe(F.col("v.o_orderpriority")))
    return both.select("o_orderkey", F.col("rank").alias("rk"), F.col("dense_rank").alias("dr"), F.col("average_rank").alias("ar"))


@query("""WITH x AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, 1 + sum(CASE WHEN n > 1 AND p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM x""")
def window_sessionize(spark, d):
    order = [F.col("ts"), F.col("event_id")]
    e = windows.sessionize(t(spark, d, "events"), ["user_id"], order, windows.changed(F.col("event_type"), ["user_id"], order))
    return e.select("event_id", F.col("session").cast("bigint").alias("session"))


@query("""WITH x AS (SELECT user_id, event_id, ts, value, value * 2 AS tried FROM events), f AS (
SELECT event_id, 'last5' AS window_id, count(*) OVER w AS n_games, sum(value) OVER w AS v, sum(tried) OVER w AS a FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)
UNION ALL SELECT event_id, 'season', count(*) OVER w, sum(value) OVER w, sum(tried) OVER w FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, window_id, n_games, round(v, 3) AS value, round(CASE WHEN a > 0 THEN v / a END, 4) AS ratio FROM f""")
def window_rolling(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "ts", "value", (F.col("value") * 2).alias("tried"))
    w = windows.rolling_long(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["value", "tried"], {"ratio": ("value", "tried")}, (5,))
    return w.select("event_id", "window_id", "n_games", r("value", 3).alias("value"), r("ratio").alias("ratio"))


@query("""WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, round(CASE WHEN count(*) FILTER (WHERE k <= 10) = 10 THEN sum(value) FILTER (WHERE k <= 10) END, 3) AS last10, round(CASE WHEN count(*) FILTER (WHERE k > 10 AND k <= 20) = 10 THEN sum(value) FILTER (WHERE k > 10 AND k <= 20) END, 3) AS prev10 FROM x GROUP BY 1""")
def window_last_n(spark, d):
    w = windows.last_n_totals(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["value"], 10)
    return w.select("user_id", r("value_last10", 3).alias("last10"), r("value_prev10", 3).alias("prev10"))


@query(f"""WITH s AS (SELECT *, avg(pts) OVER w AS m, stddev_samp(pts) OVER w AS sd, sum(pts) OVER w AS t FROM {SEASON} WINDOW w AS (PARTITION BY season))
SELECT athlete_id, season, round(CASE WHEN sd > 0 THEN (pts - m) / sd ELSE 0 END, 5) AS z, round(pts - m, 2) AS resid, round(pts / t, 8) AS share FROM s""")
def window_zscore(spark, d):
    return season(spark, d).select("athlete_id", "season", r(windows.zscore(F.col("pts"), ["season"]), 5).alias("z"), r(windows.residual(F.col("pts"), ["season"]), 2).alias("resid"), r(windows.share(F.col("pts"), ["season"]), 8).alias("share"))


@query(f"""WITH s AS {SEASON}, f AS (SELECT *, avg(games) OVER (PARTITION BY athlete_id ORDER BY season ROWS 2 PRECEDING) AS m3, count(*) OVER (PARTITION BY athlete_id ORDER BY season ROWS 2 PRECEDING) AS n3, avg(games) OVER (PARTITION BY athlete_id ORDER BY season ROWS 1 PRECEDING) AS m2, count(*) OVER (PARTITION BY athlete_id ORDER BY season ROWS 1 PRECEDING) AS n2 FROM s),
c AS (SELECT athlete_id, 3 AS k, m3 AS m, season FROM f WHERE n3 = 3 UNION ALL SELECT athlete_id, 2, m2, season FROM f WHERE n2 = 2 UNION ALL SELECT athlete_id, 1, games, season FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY k DESC, m DESC, season) AS n FROM c) SELECT athlete_id, round(m, 6) AS peak, season AS peak_end, k AS peak_seasons FROM b WHERE n = 1""")
def window_peak(spark, d):
    return windows.peak(season(spark, d), ["athlete_id"], "season", "games").withColumn("peak", r("peak", 6))


@query(f"""WITH s AS {SEASON} SELECT athlete_id, season, round(CASE WHEN count(*) OVER w = 3 THEN regr_slope(pts, season) OVER w END, 6) AS slope FROM s WINDOW w AS (PARTITION BY athlete_id ORDER BY season ROWS 2 PRECEDING)""")
def window_trailing_slope(spark, d):
    return windows.trailing_slope(season(spark, d), ["athlete_id"], "season", "pts").select("athlete_id", "season", r("slope", 6).alias("slope"))


@query("""SELECT o_orderkey, o_custkey, prev AS prev_o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL AND prev <> o_orderstatus""")
def window_changes(spark, d):
    return windows.consecutive_changes(t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus", []).select("o_orderkey", "o_custkey", "prev_o_orderstatus")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN row_number() OVER (PARTITION BY o_orderstatus, o_totalprice > 250000 ORDER BY o_totalprice DESC, o_orderkey) END AS place FROM orders""")
def window_rank_within(spark, d):
    return t(spark, d, "orders").select("o_orderkey", windows.rank_within(["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("o_totalprice") > 250000).alias("place"))


@query("""WITH x AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey, c_acctbal * 2 + c_nationkey AS s FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey, c_name, round(s, 4) AS index FROM x WHERE c_acctbal >= 1000 ORDER BY s DESC, c_custkey LIMIT 25""")
def order_leaderboard(spark, d):
    b = ordering.leaderboard(t(spark, d, "customer"), [F.col("c_mktsegment") == "BUILDING"], [("c_acctbal", ">=", 1000)], {"index": [("+", 2.0, "c_acctbal"), ("+", 1.0, "c_nationkey")]}, "index", True, [F.col("c_custkey")], 25)
    return b.select("c_custkey", "c_name", r("index").alias("index"))


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red' THEN 1000 WHEN starts_with(lower(p_name), 'red') THEN 500 WHEN contains(lower(p_name), ' red') THEN 300 ELSE 0 END + p_size AS score FROM part WHERE contains(lower(p_name), 'red') ORDER BY score DESC, p_partkey LIMIT 50""")
def order_search(spark, d):
    score = ordering.relevance(F.col("p_name"), "red") + F.col("p_size")
    return ordering.search(t(spark, d, "part"), "p_name", "red", score, [F.col("p_partkey")]).select("p_partkey", "p_name", F.col("score").cast("int").alias("score"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS p, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC, o_orderkey) AS a FROM orders)
SELECT o_orderstatus, round(count(*) FILTER (WHERE p <= 100 AND a <= 100) / least(count(*), 100), 6) AS hit_rate, round(sum(o_custkey / log2(p + 1)) FILTER (WHERE p <= 100) / sum(o_custkey / log2(a + 1)) FILTER (WHERE a <= 100), 6) AS ndcg FROM x GROUP BY 1""")
def order_rank_metrics(spark, d):
    o = t(spark, d, "orders").withColumn("gain", F.col("o_custkey").cast("double"))
    return ordering.rank_metrics(o, ["o_orderstatus"], "o_totalprice", "gain", 100, [F.col("o_orderkey")]).select("o_orderstatus", r("hit_rate", 6).alias("hit_rate"), r("ndcg", 6).alias("ndcg"))


@query("""WITH q AS (SELECT * FROM customer WHERE c_custkey % 20 = 0), x AS (SELECT q.c_custkey AS q_id, c.c_custkey, abs(c.c_acctbal - q.c_acctbal) AS distance FROM q JOIN customer c ON c.c_custkey <> q.c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, c_custkey) AS place FROM x) SELECT q_id, c_custkey, round(distance, 6) AS distance, place::INTEGER AS place FROM k WHERE place <= 5""")
def order_nearest(spark, d):
    c = t(spark, d, "customer")
    return ordering.nearest(c.where("c_custkey % 20 = 0"), c, "c_custkey", ["c_acctbal"], 5).select("q_id", "c_custkey", r("distance", 6).alias("distance"), "place")


@query("""WITH q AS (SELECT * FROM customer WHERE c_custkey % 20 = 0), x AS (SELECT q.c_custkey AS q_id, c.c_custkey, sqrt(power(c.c_acctbal - q.c_acctbal, 2) + power(c.c_nationkey - q.c_nationkey, 2)) AS distance FROM q JOIN customer c ON c.c_custkey <> q.c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, c_custkey) AS place FROM x) SELECT q_id, c_custkey, round(distance, 6) AS distance, place::INTEGER AS place FROM k WHERE place <= 5""")
def order_nearest_all(spark, d):
    """Every customer whose key is divisible by 20 against all, by two features; order_nearest has one."""
    c = t(spark, d, "customer")
    return ordering.nearest(c.where("c_custkey % 20 = 0"), c, "c_custkey", ["c_acctbal", "c_nationkey"], 5).select("q_id", "c_custkey", r("distance", 6).alias("distance"), "place")


@query(f"""WITH g AS {GAMES} SELECT season, 'home' AS side, h AS team, sum(hp)::BIGINT AS pts FROM g GROUP BY ALL UNION ALL SELECT season, 'away', a, sum(ap)::BIGINT FROM g GROUP BY ALL""")
def set_unpivot(spark, d):
    u = sets.unpivot_sides(games(spark, d).withColumn("awayPoints", F.col("awayPoints").cast("bigint")), {"home": {"team": "homeTeamId", "pts": "homePoints"}, "away": {"team": "awayTeamId", "pts": "awayPoints"}}, ["season"])
    return u.groupBy("season", "side", "team").agg(F.sum("pts").alias("pts"))


@query("""SELECT k, v, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v) AS n FROM (SELECT c_nationkey AS k, c_name AS v, 'c' AS src, 0 AS p FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_name, 's', 1 FROM supplier)) WHERE n = 1""")
def set_first_source(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.lit("c").alias("src"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"), F.lit("s").alias("src"))
    return sets.first_source_wins([c, s], ["k"], [F.col("v")])


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS a, CASE WHEN o_orderstatus = 'F' THEN 1 END AS b FROM orders)
SELECT o_custkey, o_orderkey, a, b FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (a IS NOT NULL)::INT + (b IS NOT NULL)::INT DESC, o_orderkey) AS n FROM x) WHERE n = 1""")
def set_most_complete(spark, d):
    x = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderstatus") == "F", 1).alias("b"))
    return sets.most_complete(x, ["o_custkey"], [F.col("o_orderkey")])


@query("""(SELECT c_nationkey AS k, 'both' AS w FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'only' FROM customer EXCEPT SELECT s_nationkey, 'only' FROM supplier)""")
def set_keys(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return sets.keys_in_both(a, b, ["k"]).withColumn("w", F.lit("both")).unionByName(sets.keys_only_in(a, b, ["k"]).withColumn("w", F.lit("only")))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice > 100000 AND o_totalprice <= 300000 THEN 'mid' WHEN o_totalprice > 300000 AND o_totalprice <= 1000000 THEN 'high' END AS bin,
CASE WHEN o_totalprice > 400000 THEN 400000 WHEN o_totalprice < 50000 THEN 50000 ELSE o_totalprice END AS clipped, CASE WHEN o_totalprice BETWEEN 50000 AND 400000 THEN o_totalprice END AS kept,
CASE WHEN o_custkey BETWEEN 1 AND 14 THEN 'lottery' WHEN o_custkey BETWEEN 15 AND 30 THEN 'late_first' WHEN o_custkey BETWEEN 31 AND 60 THEN 'second' ELSE 'undrafted' END AS pick FROM orders""")
def pred_bins(spark, d):
    p = F.col("o_totalprice")
    return t(spark, d, "orders").select("o_orderkey", pred.cut(p, [0, 100000, 300000, 1000000], ["low", "mid", "high"]).alias("bin"), rates.clip(p, 50000.0, 400000.0).alias("clipped"), rates.keep_between(p, 50000, 400000).alias("kept"), pred.pick_bucket(F.col("o_custkey")).alias("pick"))


@query(f"""SELECT athlete_id, season, CASE WHEN games < 3 THEN 'games' WHEN NOT (games * 10 >= 60 OR minutes_total >= 100) THEN 'volume' ELSE 'ok' END AS reason FROM {SEASON}""")
def pred_qualified(spark, d):
    return season(spark, d).select("athlete_id", "season", pred.qualified(F.col("games"), F.col("games") * 10, F.col("minutes_total"), 3, 60, 100)["reason"].alias("reason"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 THEN l_tax END AS tax FROM lineitem) SELECT l_orderkey, count(*) AS n, sum((tax IS NULL)::INT)::BIGINT AS missing, round(sum(coalesce(tax, 0)), 4) AS total FROM x GROUP BY 1""")
def pred_mask_fill(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_tax") > 0.05, F.col("l_tax")).alias("tax"))
    return pred.mask_then_fill(x, ["tax"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("tax_missing").alias("missing"), r(F.sum("tax")).alias("total"))


@query(f"""SELECT 'train' AS fold, count(*) AS n FROM {LINES} WHERE season <= 1998 UNION ALL SELECT 'val', count(*) FROM {LINES} WHERE season = 1999 UNION ALL SELECT 'test', count(*) FROM {LINES} WHERE season = 2000""")
def pred_walk_forward(spark, d):
    parts = pred.walk_forward(lines(spark, d), "season", 2000)
    out = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("fold"), "n") for k, p in zip(("train", "val", "test"), parts, strict=True)]
    return sets.union_all(*out)


@query(r"""SELECT c_custkey, split_part(c_name, '#', 2) AS num, try_cast(split_part(c_name, '#', 2) AS BIGINT) AS id, regexp_extract(c_name, '([a-zA-Z]+)#', 1) AS word, regexp_replace(upper(c_name), '[ .'']', '', 'g') AS ku, regexp_replace(lower(c_name), '[^a-z]', '', 'g') AS kl, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS ka,
CASE WHEN regexp_matches(lower(c_mktsegment), 'auto') THEN 'a' WHEN regexp_matches(lower(c_mktsegment), 'b|m') THEN 'b' ELSE 'z' END AS rule FROM customer""")
def fn_text(spark, d):
    n = F.col("c_name")
    return t(spark, d, "customer").select("c_custkey", text.split_part(n, "#", 2).alias("num"), rates.clean_id(text.split_part(n, "#", 2)).alias("id"), F.regexp_extract(n, "([a-zA-Z]+)#", 1).alias("word"), text.key_upper(n).alias("ku"), text.key_letters(n).alias("kl"), text.key_alnum(n).alias("ka"), text.first_rule(F.col("c_mktsegment"), [("a", "auto"), ("b", "b|m")], "z").alias("rule"))


@query("""SELECT event_id, floor(epoch(ts))::BIGINT AS unix, strftime(ts, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def fn_dates(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", clock.unix_seconds(F.col("ts")).alias("unix"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd").alias("next_day"), arrays.json_value(F.col("props"), "$.k").try_cast("int").alias("k"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, 1 + l_linenumber % 4 AS p, (l_quantity * 20)::DOUBLE AS s, l_partkey % 940 AS x, l_suppkey % 500 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p <= 2 THEN (p - 1) * 1200 + 1200 - s ELSE 2400 + (p - 3) * 300 + 300 - s END AS t, round(sqrt(power(x / 10 - CASE WHEN x < 470 THEN 5.25 ELSE 88.75 END, 2) + power(y / 10 - 25, 2)), 6) AS dist FROM x""")
def fn_court(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 + F.col("l_linenumber") % 4).alias("p"), (F.col("l_quantity") * 20).alias("s"), (F.col("l_partkey") % 940).alias("x"), (F.col("l_suppkey") % 500).alias("y"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", clock.game_seconds(F.col("p"), F.col("s")).alias("t"), r(rates.shot_distance(F.col("x"), F.col("y")), 6).alias("dist"))


@query(f"""SELECT athlete_id, season, round((games + 2) / (games + minutes_total + 4), 6) AS shrunk, round(least(1, minutes_total / 2000), 6) AS weight, round(minutes_total / (minutes_total + 300), 6) AS rel, round(CASE WHEN minutes_total > 0 THEN 40 * round(pts, 2) / minutes_total END, 6) AS per40, round(ln(greatest(least(disc / games, 0.99), 0.01) / (1 - greatest(least(disc / games, 0.99), 0.01))), 5) AS logit FROM {SEASON}""")
def fn_rates(spark, d):
    s, c = season(spark, d), F.col
    return s.select("athlete_id", "season", r(rates.shrink(c("games"), c("games") + c("minutes_total")), 6).alias("shrunk"), r(rates.exposure_weight(c("minutes_total")), 6).alias("weight"), r(rates.reliability_possessions(c("minutes_total")), 6).alias("rel"), r(rates.per_40(r("pts", 2), c("minutes_total")), 6).alias("per40"), r(rates.logit(c("disc") / c("games")), 5).alias("logit"))


@query("""SELECT l_orderkey, string_agg(k, '::' ORDER BY k) AS lineup FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS k FROM lineitem) GROUP BY 1""")
def fn_lineup_key(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(arrays.lineup_key(F.collect_set("l_partkey")).alias("lineup"))


@query(f"""WITH x AS {TEAM_SEASON}, l AS (SELECT athlete_id, season, round(sum(minutes_total), 2) AS minutes_total, sum(games)::BIGINT AS games, arg_max(teamId, (minutes_total, teamId)) AS "teamId" FROM x GROUP BY ALL) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY season DESC) = 1""")
def plan_final_season(spark, d):
    return careers.final_season(team_season(spark, d), ["minutes_total", "games"], ["teamId"]).withColumn("minutes_total", r("minutes_total", 2))


@query(f"""WITH x AS {TEAM_SEASON}, l AS (SELECT athlete_id, season, arg_max(teamId, (minutes_total, teamId)) AS team FROM x GROUP BY ALL), c AS (SELECT *, lag(team) OVER (PARTITION BY athlete_id ORDER BY season) AS p FROM l), s AS (SELECT *, CASE WHEN p IS NOT NULL AND p <> team THEN 1 ELSE 0 END AS f FROM c),
k AS (SELECT *, 1 + sum(f) OVER (PARTITION BY athlete_id ORDER BY season ROWS UNBOUNDED PRECEDING)::BIGINT AS stint_id FROM s)
SELECT athlete_id, season, team AS "teamId", f AS transfer_flag, stint_id, row_number() OVER (PARTITION BY athlete_id, stint_id ORDER BY season) AS seasons_in_stint, row_number() OVER (PARTITION BY athlete_id ORDER BY season) AS season_idx FROM k""")
def plan_panel(spark, d):
    one = careers.collapse_teams(team_season(spark, d), ["games"], ["teamId"])
    return careers.panel(one).select("athlete_id", "season", "teamId", "transfer_flag", F.col("stint_id").cast("bigint").alias("stint_id"), "seasons_in_stint", "season_idx")


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY season) AS k, count(*) OVER (PARTITION BY athlete_id) AS n FROM {SEASON}), w AS (SELECT *, greatest(0.2, 1 - (n - k) * 0.2) AS wt FROM s)
SELECT athlete_id, max(n) AS career_years, max(season) AS final_season, sum(games)::BIGINT AS games_career, round(arg_max(pts, season), 2) AS pts_final, round(CASE WHEN count(*) > 1 THEN (arg_max(pts, season) - arg_min(pts, season)) / (count(*) - 1) END, 6) AS pts_slope, round(sum(pts * wt) / sum(wt), 6) AS pts_recent FROM w GROUP BY 1""")
def plan_career(spark, d):
    c = careers.career(season(spark, d), ["games"], ["pts"])
    return c.select("athlete_id", "career_years", "final_season", "games_career", r("pts_final", 2).alias("pts_final"), *[r(x, 6).alias(x) for x in ("pts_slope", "pts_recent")])


@query(f"""WITH x AS {TEAM_SEASON}, l AS (SELECT athlete_id, season, arg_max(teamId, (minutes_total, teamId)) AS team, sum(games) AS g FROM x GROUP BY ALL), c AS (SELECT *, lag(team) OVER w AS p, lag(g) OVER w AS pg FROM l WINDOW w AS (PARTITION BY athlete_id ORDER BY season))
SELECT athlete_id, season, p AS "prev_teamId", team AS "teamId", (g - pg)::BIGINT AS games_change, round(sqrt(power((g - pg) / 2, 2)), 6) AS shock FROM c WHERE p IS NOT NULL AND p <> team""")
def plan_transfers(spark, d):
    one = careers.collapse_teams(team_season(spark, d), ["games"], ["teamId"])
    return careers.transfers(one, {"games": 2.0}).select("athlete_id", "season", "prev_teamId", "teamId", "games_change", r("shock", 6).alias("shock"))


@query(f"""WITH s AS (SELECT athlete_id, (season - 1990)::DOUBLE AS t, pts, minutes_total AS w FROM {SEASON}), m AS (SELECT athlete_id, count(*) AS n, sum(w) AS sw, sum(w * t) AS sx, sum(w * pts) AS sy, sum(w * t * t) AS sxx, sum(w * t * pts) AS sxy FROM s WHERE w > 0 GROUP BY 1)
SELECT athlete_id, n, round(CASE WHEN sxx - sx * sx / sw > 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) END, 2) AS slope FROM m""")
def plan_development(spark, d):
    s = season(spark, d).withColumn("t", F.col("season") - 1990)
    return careers.development(s, "pts", "minutes_total").select("athlete_id", "n", r("slope", 2).alias("slope"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 40)::DOUBLE END AS a, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 37)::DOUBLE END AS b, CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 31)::DOUBLE END AS c FROM orders)
SELECT o_orderkey, CASE WHEN b IS NOT NULL AND (a IS NULL OR b >= a + 5) THEN b ELSE coalesce(a, c) END AS games_final, CASE WHEN b IS NOT NULL AND (a IS NULL OR b >= a + 5) THEN 'backfill' WHEN a IS NOT NULL THEN 'api' WHEN c IS NOT NULL THEN 'text' ELSE 'missing' END AS games_source,
coalesce(list_reverse_sort(list_filter([a, b, c], lambda v: v IS NOT NULL))[1] - list_reverse_sort(list_filter([a, b, c], lambda v: v IS NOT NULL))[2] >= 8, false) AS games_conflict FROM x""")
def plan_exposure(spark, d):
    k = F.col("o_custkey")
    x = t(spark, d, "orders").select("o_orderkey", F.when(k % 3 > 0, (k % 40).cast("double")).alias("games_played"), F.when(k % 5 > 0, (k % 37).cast("double")).alias("backfill_games_played"), F.when(k % 7 > 0, (k % 31).cast("double")).alias("hist_games_played_text"), F.lit(None).cast("double").alias("college_games_played"))
    return careers.exposure(x).select("o_orderkey", "games_final", "games_source", "games_conflict")


@query("""SELECT 'price' AS "check", count(*) AS n, count(*) FILTER (WHERE NOT coalesce(l_extendedprice > 0, false)) AS n_failed, count(*) FILTER (WHERE NOT coalesce(l_extendedprice > 0, false)) = 0 AS passes FROM lineitem UNION ALL SELECT 'discount', count(*), count(*) FILTER (WHERE NOT coalesce(l_discount < 0.1, false)), count(*) FILTER (WHERE NOT coalesce(l_discount < 0.1, false)) = 0 FROM lineitem""")
def plan_checks(spark, d):
    return audits.checks(t(spark, d, "lineitem"), {"price": F.col("l_extendedprice") > 0, "discount": F.col("l_discount") < 0.1})


@query()
def plan_rapm(spark, d):
    """Ridge ratings from stints built of line items: the parts of an order in the order of their keys, the first half (rounded up) against the rest."""
    from fastbreak.plans.impact import rapm

    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("p"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("x"), F.year(F.min("l_shipdate")).alias("season"))
    half = F.ceil(F.size("p") / 2).cast("int")
    stint = li.select("season", F.col("l_orderkey").alias("gameId"), F.lit(1).alias("stint"), F.slice("p", F.lit(1), half).alias("home"), F.slice("p", half + 1, F.size("p")).alias("away"), F.lit(0).alias("h0"), F.col("x").alias("h1"), F.lit(0).alias("a0"), (F.col("q") / 1000).alias("a1"), F.col("q").alias("poss"))
    return rapm(stint, 100.0).select("season", "player", r("rapm").alias("rapm"), r("poss", 2).alias("poss"))


@query()
def join_close_matches(spark, d):
    """Similar part names; similarity is no SQL function."""
    p = t(spark, d, "part").select("p_name").distinct()
    return joins.close_matches(p, p.withColumnRenamed("p_name", "other"), "p_name", "other").withColumn("score", r("score"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def stream_daily(spark, d):
    """A stream of the events table, windowed by day, run to its end."""
    import uuid

    from fastbreak.session import shared_folder
    from fastbreak.streaming.sessions import windowed

    batch = t(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    path = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    out = windowed(stream, "1 day", ["event_type"], "value", late="60 days").writeStream.outputMode("update").trigger(availableNow=True)
    # a batch writes the windows it changed to a folder of its own, which a repeated batch replaces; the last one counts
    out = out.option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}"))
    out.start().awaitTermination()
    seen = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    last = seen.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v")).select("window_start", "event_type", "v.*")
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", r("total", 2).alias("total"))
