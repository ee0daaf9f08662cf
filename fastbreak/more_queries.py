"""More queries over the driver's star-schema tables: functions, joins by id or name, careers, sources.

The stand-ins are those of `queries`: parts are players, suppliers teams, orders games.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fastbreak.functions import arrays, clock, rates, text
from fastbreak.operators import aggregates as agg
from fastbreak.operators import joins, ordering, windows
from fastbreak.operators import predicates as pred
from fastbreak.plans import audits, careers, context, impact, matching, site, staging
from fastbreak.queries import LINES, SEASON, lines, query, r, season, t
from fastbreak.session import shared_folder
from fastbreak.sources import files
from fastbreak.sources.catalog import Catalog, restrict

#: Shots of line items: place in tenths of a foot, margin and clock.
SHOTS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 7 % 940)::INTEGER AS x, (l_suppkey * 13 % 500)::INTEGER AS y, (l_orderkey % 61 - 30)::INTEGER AS margin, (l_quantity * 24)::DOUBLE AS secs, (1 + l_linenumber % 4)::INTEGER AS period FROM lineitem)"


def shots(spark, d):
    c = F.col
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_partkey") * 7 % 940).cast("int").alias("x"), (c("l_suppkey") * 13 % 500).cast("int").alias("y"),
        (c("l_orderkey") % 61 - 30).cast("int").alias("margin"), (c("l_quantity") * 24).cast("double").alias("secs"), (1 + c("l_linenumber") % 4).cast("int").alias("period"),
    )


@query(f"""WITH s AS (SELECT *, sqrt(power(x / 10 - CASE WHEN x < 470 THEN 5.25 ELSE 88.75 END, 2) + power(y / 10 - 25, 2)) AS dist, least(x / 10, 94 - x / 10) <= 14 AND (y / 10 <= 3 OR y / 10 >= 47) AS corner FROM {SHOTS})
SELECT l_orderkey, l_linenumber, l_partkey, corner, CASE WHEN dist < 4 THEN 'restricted' WHEN dist < 8 THEN 'paint' WHEN corner THEN 'corner3' WHEN dist < 22.15 THEN 'mid' WHEN dist > 27 THEN 'deep3' ELSE 'above3' END AS zone,
period >= 2 AND secs < 300 AND abs(margin) <= 5 AS high, abs(margin) > 20 AS garbage FROM s""")
def fn_shots(spark, d):
    x, y = F.col("x"), F.col("y")
    return shots(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", rates.is_corner_three(x, y).alias("corner"), rates.zone(x, y).alias("zone"), rates.is_high_leverage(F.col("period"), F.col("secs"), F.col("margin")).alias("high"), rates.is_garbage(F.col("margin")).alias("garbage"))


@query("""SELECT p_partkey, CASE WHEN contains(n, 'dunk') THEN 'dunk' WHEN contains(n, 'layup') THEN 'layup' WHEN contains(n, 'tip') THEN 'tip' WHEN contains(n, 'hook') THEN 'hook' WHEN contains(n, 'three') OR contains(n, '3pt') THEN 'three' WHEN contains(n, 'jumper') THEN 'jumper' ELSE 'other' END AS family
FROM (SELECT p_partkey, lower(['Dunk ', 'LAYUP ', 'tip in ', 'Hook shot ', '3PT jumper ', 'Jumper ', ''][1 + p_partkey % 7] || p_name) AS n FROM part)""")
def fn_shot_family(spark, d):
    kinds = F.array(*map(F.lit, ["Dunk ", "LAYUP ", "tip in ", "Hook shot ", "3PT jumper ", "Jumper ", ""]))
    return t(spark, d, "part").select("p_partkey", rates.shot_family(F.concat(F.get(kinds, (F.col("p_partkey") % 7).cast("int")), F.col("p_name"))).alias("family"))


WP = "1 / (1 + exp(-({m}) / (0.45 * sqrt(greatest({s}, 0) / 60.0 + 0.25) * 4)))"


@query(f"""WITH s AS (SELECT *, {WP.format(m="margin", s="secs")} AS wp FROM {SHOTS}),
l AS (SELECT *, least(sqrt({" + ".join(f"{f} * power({WP.format(m=f'margin + {p}', s='greatest(secs - 18.0, 0.0)')} - wp, 2)" for p, f in rates.OUTCOMES.items())}) / 0.5, 1.0) AS li FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(wp, 6) AS wp, round(li, 6) AS li, CASE WHEN round(li, 9) < 0.05 THEN 'garbage' WHEN round(li, 9) < 0.10 THEN 'low' WHEN round(li, 9) < 0.20 THEN 'medium' WHEN round(li, 9) < 0.35 THEN 'high' ELSE 'very_high' END AS bucket, round(-0.02 * margin * secs / 60, 6) AS rubber FROM l""")
def fn_leverage(spark, d):
    m, s = F.col("margin").cast("double"), F.col("secs")
    li = rates.leverage_index(m, s)
    return shots(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", r(rates.win_probability(m, s), 6).alias("wp"), r(li, 6).alias("li"), rates.leverage_bucket(F.round(li, 9)).alias("bucket"), r(rates.rubber_band(m, s / 60), 6).alias("rubber"))


@query(f"""WITH s AS (SELECT athlete_id, season, minutes_total AS m, games AS g, disc AS x FROM {SEASON}), p AS (SELECT *, 1.75 / sqrt(m / 100) AS sd FROM s)
SELECT athlete_id, season, round(greatest(0.05, least(10, 1 / (sd * sd))), 5) AS precision, round(g / (2 * (m + 0.44 * g)), 6) AS ts, round(greatest(0, least(0.6, CASE WHEN m / 40 * g > 5 THEN m / (m / 40 * g) ELSE x END)), 6) AS usage,
round(100 * g / m, 5) AS per100, round(1 / (m + 1), 8) AS variance, round(greatest(0, least(1, power(2, -(g::DOUBLE) / 3))), 6) AS half, round(least(1, m * 60 / 3000), 6) AS rel FROM p""")
def fn_box_rates(spark, d):
    s = season(spark, d).select("athlete_id", "season", F.col("minutes_total").alias("m"), F.col("games").alias("g"), F.col("disc").alias("x"))
    m, g, x = F.col("m"), F.col("g"), F.col("x")
    return s.select("athlete_id", "season", r(rates.precision_possessions(m), 5).alias("precision"), r(rates.true_shooting(g, m, g), 6).alias("ts"), r(rates.usage(m, m, g, x), 6).alias("usage"), r(rates.per_100(g, m), 5).alias("per100"), r(rates.exposure_variance(m), 8).alias("variance"), r(rates.half_life_weight(g, 3.0), 6).alias("half"), r(rates.reliability_seconds(m * 60), 6).alias("rel"))


@query(f"""WITH z AS (SELECT athlete_id, season, CASE WHEN stddev_samp(pts) OVER w > 0 THEN (pts - avg(pts) OVER w) / stddev_samp(pts) OVER w ELSE 0 END AS z FROM {SEASON} WINDOW w AS (PARTITION BY season))
SELECT athlete_id, season, round((greatest(-2.5, least(2.5, z)) + 2.5) / 5, 6) AS color, round((greatest(-2.5, least(2.5, -z)) + 2.5) / 5, 6) AS inverted, round(greatest(-1, least(1, z)), 6) AS filled FROM z""")
def fn_color(spark, d):
    z = season(spark, d).select("athlete_id", "season", windows.zscore(F.col("pts"), ["season"]).alias("z"), windows.zscore_filled(F.col("pts"), ["season"], 1.0).alias("filled"))
    return z.select("athlete_id", "season", r(rates.color_scale(F.col("z")), 6).alias("color"), r(rates.color_scale(F.col("z"), True), 6).alias("inverted"), r("filled", 6).alias("filled"))


@query(r"""WITH n AS (SELECT c_custkey, ['Smith, ' || c_mktsegment, c_mktsegment || ' O''Neal Jr.', 'Université ' || c_mktsegment, c_mktsegment || ' State University & Co'][1 + c_custkey % 4] AS n FROM customer)
SELECT c_custkey, n, strip_accents(n) AS folded, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '&', ' and ', 'g'), '[^a-z0-9 ]', '', 'g'), '\b(university|college|state|st)\b', '', 'g'), '\s+', ' ', 'g')) AS team,
regexp_replace(upper(CASE WHEN contains(n, ',') THEN split_part(n, ',', 2) || split_part(n, ',', 1) ELSE n END), '[^A-Z0-9]', '', 'g') AS last_first, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '[^a-z0-9 ]', '', 'g'), '\s+(jr|sr|ii|iii|iv|v)\.?$', ''), '\s+', ' ', 'g')) AS no_suffix,
CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 2)) || ' ' || split_part(n, ',', 1) ELSE n END AS turned, array_to_string(list_sort(string_split(trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS sorted FROM n""")
def fn_names(spark, d):
    seg, k = F.col("c_mktsegment"), (F.col("c_custkey") % 4).cast("int")
    n = F.get(F.array(F.concat(F.lit("Smith, "), seg), F.concat(seg, F.lit(" O'Neal Jr.")), F.concat(F.lit("Université "), seg), F.concat(seg, F.lit(" State University & Co"))), k)
    c = F.col("n")
    return t(spark, d, "customer").select("c_custkey", n.alias("n")).select("c_custkey", "n", text.ascii_fold(c).alias("folded"), text.clean_team(c).alias("team"), text.key_last_first(c).alias("last_first"), text.key_no_suffix(c).alias("no_suffix"), text.last_first_to_first_last(c).alias("turned"), text.token_sort(c).alias("sorted"))


@query("""WITH a AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS x, string_split(lower(p_brand || ' ' || p_name), ' ') AS y, lower(p_name) AS n FROM part)
SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard, array_to_string(list_sort(list_distinct([replace(n, ' ', ''), array_to_string(list_sort(x), ''), n[1:1] || x[-1], n[1:1] || x[-1][1:1]])), '|') AS variants FROM a""")
def fn_tokens(spark, d):
    n = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", r(text.token_jaccard(n, F.concat("p_brand", F.lit(" "), n)), 6).alias("jaccard"), F.array_join(F.array_sort(text.name_variants(n)), "|").alias("variants"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 40 AS h, o_orderkey % 300 AS w FROM orders)
SELECT o_orderkey, CASE WHEN h < 12 THEN 72 + h WHEN h < 24 THEN (180 + h) / 2.54 WHEN h < 30 THEN CASE WHEN 50 + h BETWEEN 60 AND 96 THEN (50 + h)::DOUBLE END END AS height,
CASE WHEN w < 95 THEN CASE WHEN w * 2.2046226218 BETWEEN 110 AND 400 THEN w * 2.2046226218 END WHEN w BETWEEN 110 AND 400 THEN w::DOUBLE END AS weight, CASE WHEN w >= 50 AND w < 130 THEN CASE WHEN w * 2.2046226218 >= 110 THEN w * 2.2046226218 END WHEN w BETWEEN 130 AND 380 THEN w::DOUBLE END AS mixed,
h * 60 + w / 10 AS clock, CASE WHEN h = 0 AND w = 0 THEN 0 ELSE h * 60 + w END AS span, 1990 + h AS year FROM x""")
def fn_units(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("h"), (F.col("o_orderkey") % 300).alias("w"))
    h, w = F.col("h").cast("string"), F.col("w").cast("string")
    height = F.when(F.col("h") < 12, F.concat(F.lit("6-"), h)).when(F.col("h") < 24, F.concat((F.col("h") + 180).cast("string"), F.lit(" cm"))).when(F.col("h") < 30, F.concat((F.col("h") + 50).cast("string"), F.lit('"'))).otherwise("tall")
    return x.select("o_orderkey", clock.height_inches(height).alias("height"), clock.weight_pounds(w).alias("weight"), clock.mixed_weight_pounds(w).alias("mixed"), clock.clock_seconds(F.concat(h, F.lit(":"), (F.col("w") / 10).cast("string"))).alias("clock"), clock.clock_seconds(F.concat(F.lit("PT"), h, F.lit("M"), w, F.lit("S"))).cast("double").alias("span"), clock.year_in_name(F.concat(F.lit("stats_"), (F.col("h") + 1990).cast("string"), F.lit(".csv"))).alias("year"))


@query("""WITH e AS (SELECT event_id, user_id, ts, (floor(value) * 37)::INTEGER % 1300 AS left_ FROM events), n AS (SELECT *, lead(left_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM e), g AS (SELECT *, CASE WHEN nx > left_ THEN left_ ELSE left_ - nx END AS gap FROM n),
p AS (SELECT *, coalesce(left_ - lag(left_) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 60, false)::INT AS f FROM g)
SELECT event_id, CASE WHEN gap BETWEEN 0 AND 1200 THEN gap ELSE 0 END AS secs, (1 + sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS period, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS parsed FROM p""")
def fn_clock(spark, d):
    from pyspark.sql import Window as W

    order = [F.col("ts"), F.col("event_id")]
    e = t(spark, d, "events").select("event_id", "user_id", "ts", ((F.floor("value") * 37).cast("int") % 1300).alias("left_"))
    e = e.withColumn("secs", clock.interval_seconds(F.col("left_"), F.lead("left_").over(W.partitionBy("user_id").orderBy(*order))))
    p = windows.periods(e, ["user_id"], order, "left_")
    said = F.when(F.col("event_id") % 3 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return p.select("event_id", "secs", F.col("period").cast("bigint").alias("period"), clock.unix_seconds(clock.parse_timestamp(said)).alias("parsed"))


@query("""WITH o AS (SELECT l_orderkey, list(DISTINCT l_suppkey::VARCHAR ORDER BY l_suppkey::VARCHAR) AS ids, min(l_suppkey)::VARCHAR AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(ids, lambda i: i = m), ',') AS mine, array_to_string(list_filter(ids, lambda i: i <> m), ',') AS others, ids[3] AS third, len(ids) AS n FROM o""")
def fn_players(spark, d):
    """Players as a JSON array and back."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("ids"), F.min("l_suppkey").cast("string").alias("m"))
    said = F.to_json(F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit("x").alias("name"), i.alias("team"))))
    p = li.select("l_orderkey", "m", arrays.parse_players(said).alias("p"))
    ids = lambda same: F.array_join(arrays.ids_of_team(F.col("p"), F.col("m"), same), ",")
    return p.select("l_orderkey", ids(True).alias("mine"), ids(False).alias("others"), arrays.element(F.col("p"), 3)["id"].alias("third"), F.size("p").cast("bigint").alias("n"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS a, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS b, o_orderpriority AS p, substr(o_orderpriority, 1, 1)::INTEGER AS k, o_totalprice AS t FROM orders)
SELECT o_orderkey, a IS NOT NULL OR b IS NOT NULL AS some, p IN ('1-URGENT', '2-HIGH') AS early, coalesce(CASE WHEN k > 2 THEN p END, 'ALL') = 'ALL' AS in_all, a IS NOT NULL OR k = 1 AS nba, (k = 1) AND a IS NULL AS undrafted, t >= 50000 AND t <= 200000 AND coalesce(a >= 10, false) AS within, k IN (1, 3, 4) AND k NOT IN (4) AS seasons, coalesce(a >= 100, true) AS cohort, round(t / 100, 4) AS share FROM x""")
def pred_filters(spark, d):
    c = F.col
    x = t(spark, d, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", c("o_custkey")).alias("a"), F.when(c("o_orderstatus") == "O", c("o_custkey")).alias("b"), F.col("o_orderpriority").alias("p"), F.substring("o_orderpriority", 1, 1).cast("int").alias("k"), F.col("o_totalprice").alias("t"), F.lit(1).alias("unused"))
    x = pred.percent_column(pred.drop_if_present(pred.whitelist(x, ["o_orderkey", "a", "b", "p", "k", "unused"], ("t",)), "unused", "absent").withColumn("u", c("t")), "t")
    early = pred.experience_in(F.when(c("p") == "1-URGENT", "Fr").when(c("p") == "2-HIGH", "So").otherwise("Sr"), "FrSo")
    listed = c("k") == 1
    return x.select("o_orderkey", pred.any_present(c("a"), c("b")).alias("some"), early.alias("early"), pred.in_split(F.when(c("k") > 2, c("p")), "ALL").alias("in_all"), pred.membership(c("a"), listed, "nba").alias("nba"), pred.membership(c("a"), listed, "undrafted").alias("undrafted"), pred.within({"u": (50000, 200000), "a": (10, None)}).alias("within"), pred.seasons_in(c("k"), [1, 3, 4], [4]).alias("seasons"), pred.cohort(c("a"), 100, True).alias("cohort"), r("t").alias("share"))


@query("""WITH x AS (SELECT l_suppkey, CASE WHEN l_discount > 0.05 THEN l_quantity END AS q, CASE WHEN l_suppkey % 2 = 0 THEN l_tax ELSE 0 END AS w, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS k FROM lineitem)
SELECT l_suppkey, coalesce(sum(CASE WHEN q > 49 THEN q END), 0)::DOUBLE AS big, round(coalesce(sum(CASE WHEN w > 0 THEN q * w END) / nullif(sum(CASE WHEN q IS NOT NULL AND w > 0 THEN w END), 0), avg(q)), 6) AS mean, round(avg(CASE WHEN q IS NOT NULL THEN greatest(q - 15, 0) END), 6) AS regret,
arg_min(q, k) FILTER (WHERE q IS NOT NULL) AS first_q, arg_max(q, k) FILTER (WHERE q IS NOT NULL) AS last_q, min(q) AS some_q, bool_or(coalesce(q > 49, false)) AS any_big, bool_and(coalesce(q > 1, true)) AS all_over FROM x GROUP BY 1""")
def agg_more(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("q"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_tax")).otherwise(0.0).alias("w"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("k"))
    q = F.col("q")
    return x.groupBy("l_suppkey").agg(
        agg.sum_or_zero(F.when(q > 49, q)).cast("double").alias("big"), r(agg.wavg_or_mean(q, F.col("w")), 6).alias("mean"), r(agg.regret(q), 6).alias("regret"), agg.first_present("q", "k").alias("first_q"), agg.last_present("q", "k").alias("last_q"),
        agg.any_value("q").alias("some_q"), F.bool_or(F.coalesce(q > 49, F.lit(False))).alias("any_big"), F.bool_and(F.coalesce(q > 1, F.lit(True))).alias("all_over"),
    )


@query("""WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2, avg(l_extendedprice) AS my, corr(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS k1, covar_pop(l_discount, l_extendedprice) AS k2 FROM lineitem),
b AS (SELECT *, n + 1000 AS a, n * c AS o, n * k1 / s1 AS r1, n * k2 / s2 AS r2 FROM m)
SELECT 'intercept' AS term, round(my, 3) AS coef, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS sd FROM b UNION ALL SELECT 'l_quantity', round((a * r1 - o * r2) / (a * a - o * o), 3), round(m1, 6), round(s1, 6) FROM b UNION ALL SELECT 'l_discount', round((a * r2 - o * r1) / (a * a - o * o), 3), round(m2, 6), round(s2, 6) FROM b""")
def agg_ridge(spark, d):
    fit = agg.ridge(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 1000.0)
    return fit.select("term", r("coef", 3).alias("coef"), r("mean", 6).alias("mean"), r("sd", 6).alias("sd"))


@query("""SELECT l_suppkey, round(regr_intercept(l_tax, l_discount), 5) AS a, round(regr_slope(l_tax, l_discount), 5) AS b, round(greatest(sqrt(greatest(var_pop(l_tax) - power(covar_pop(l_tax, l_discount), 2) / var_pop(l_discount), 0)), 0.02), 5) AS sd FROM lineitem GROUP BY 1""")
def agg_evidence(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(*[r(c, 5).alias(n) for n, c in zip(("a", "b", "sd"), agg.evidence_fit("l_tax", "l_discount", 0.02), strict=True)])


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, round(CASE WHEN v IS NULL THEN 0 ELSE (v - (SELECT avg(v) FROM x)) / (SELECT stddev_pop(v) FROM x) END, 6) AS z, (v IS NULL)::INTEGER AS missing FROM x""")
def agg_standardise(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return agg.standardise(x, ["v"]).select("o_orderkey", r("z_v", 6).alias("z"), F.col("v_missing").alias("missing"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def window_top_one(spark, d):
    return windows.top_one(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


NULLED = "(SELECT CASE WHEN o_orderstatus <> '{s}' THEN o_custkey END AS k FROM orders WHERE o_totalprice > {p})"


@query(f"""SELECT c_custkey, 'nulls' AS case_ FROM customer WHERE c_custkey NOT IN {NULLED.format(s="P", p=200000)} UNION ALL SELECT c_custkey, 'whole' FROM customer WHERE c_custkey NOT IN {NULLED.format(s="none", p=200000)} UNION ALL SELECT c_custkey, 'empty' FROM customer WHERE c_custkey NOT IN {NULLED.format(s="P", p=100000000)} UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE NOT EXISTS (SELECT 1 FROM {NULLED.format(s="P", p=200000)} x WHERE x.k = c_custkey)""")
def join_not_in(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders")
    right = lambda s, p: o.where(F.col("o_totalprice") > p).select(F.when(F.col("o_orderstatus") != s, F.col("o_custkey")).alias("c_custkey"))
    tag = lambda df, n: df.withColumn("case_", F.lit(n))
    out = tag(joins.not_in_sql(c, right("P", 200000), "c_custkey"), "nulls").unionByName(tag(joins.not_in_sql(c, right("none", 200000), "c_custkey"), "whole"))
    return out.unionByName(tag(joins.not_in_sql(c, right("P", 100000000), "c_custkey"), "empty")).unionByName(tag(joins.not_in(c, right("P", 200000), "c_custkey"), "anti"))


@query("""WITH g AS (SELECT o_orderkey::VARCHAR AS game_id, o_custkey FROM orders UNION SELECT (o_orderkey + o_custkey * 1000000)::VARCHAR, o_custkey FROM orders WHERE o_orderstatus = 'F'), x AS (SELECT l_orderkey::VARCHAR AS game_id, l_quantity FROM lineitem UNION ALL SELECT (o_orderkey + o_custkey * 1000000)::VARCHAR, 1 FROM orders)
SELECT o_custkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM x JOIN g USING (game_id) GROUP BY 1""")
def join_either_id(spark, d):
    source = (F.col("o_orderkey") + F.col("o_custkey") * 1000000).cast("string")
    o = t(spark, d, "orders")
    dim = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", source).alias("source"), "o_custkey")
    facts = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("game_id"), "l_quantity").unionByName(o.select(source.alias("game_id"), F.lit(1.0).alias("l_quantity")))
    return facts.join(joins.by_either_id(dim, ["o_orderkey", "source"], "game_id"), "game_id").groupBy("o_custkey").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


@query("""WITH l AS (SELECT p_partkey AS k, CASE WHEN p_size <= 10 THEN p_partkey END AS id, p_name AS name, p_size AS yr FROM part), q AS (SELECT p_partkey AS id, p_name AS name, p_size + 1 AS yr, p_partkey AS v FROM part WHERE p_retailprice < 1000),
e AS (SELECT l.k, min(q.v) AS v FROM l JOIN q USING (id) GROUP BY 1), n AS (SELECT l.k, arg_min(q.v, (abs(l.yr - q.yr), q.v)) AS v FROM l JOIN q ON l.name = q.name WHERE abs(l.yr - q.yr) <= 2 AND l.k NOT IN (SELECT k FROM e) GROUP BY 1)
SELECT k, v, 'id' AS method FROM e UNION ALL SELECT k, v, 'name_year' FROM n""")
def join_id_then_name(spark, d):
    p = t(spark, d, "part")
    left = p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") <= 10, F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("at"))
    right = p.where("p_retailprice < 1000").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") + 1).alias("yr"), F.col("p_partkey").alias("v"))
    return joins.id_then_name(left, right, "k", "id", "name", "at", "yr", "v")


@query("""WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS ai, lower(s_name) AS an FROM supplier), b AS (SELECT s_suppkey AS m, CASE WHEN s_acctbal > 2000 THEN s_nationkey END AS bi, lower(s_name) AS bn FROM supplier)
SELECT k, m FROM a JOIN b ON CASE WHEN ai IS NOT NULL AND bi IS NOT NULL THEN ai = bi ELSE an = bn END""")
def join_id_or_name(spark, d):
    s = t(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("ai"), F.col("s_name").alias("an"))
    b = s.select(F.col("s_suppkey").alias("m"), F.when(F.col("s_acctbal") > 2000, F.col("s_nationkey")).alias("bi"), F.upper("s_name").alias("bn"))
    return joins.by_id_or_name(a, b, "ai", "bi", "an", "bn").select("k", "m")


@query("""WITH tg AS (SELECT c_custkey AS k, c_custkey AS id, c_nationkey AS yr, c_name AS name, c_mktsegment AS team, c_acctbal AS v FROM customer), n AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS id, o_custkey % 25 AS yr, 'Customer#' || lpad(((o_custkey * 2) % 400)::VARCHAR, 9, '0') AS name, 'BUILDING' AS team, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders WHERE o_totalprice > 300000),
h1 AS (SELECT seq, min(tg.k) AS k FROM n JOIN tg USING (id, yr) GROUP BY 1), h2 AS (SELECT seq, min(tg.k) AS k FROM n JOIN tg USING (name, team) WHERE seq NOT IN (SELECT seq FROM h1) GROUP BY 1), h3 AS (SELECT seq, min(tg.k) AS k FROM n JOIN tg USING (name) WHERE seq NOT IN (SELECT seq FROM h1 UNION ALL SELECT seq FROM h2) GROUP BY 1),
h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3), u AS (SELECT k, max(seq) AS s, arg_max(v, seq) FILTER (WHERE v IS NOT NULL) AS v, arg_max(name, seq) AS name FROM h JOIN n USING (seq) GROUP BY 1)
SELECT tg.k, coalesce(u.name, tg.name) AS name, round(coalesce(u.v, tg.v), 2) AS v FROM tg LEFT JOIN u USING (k) UNION ALL SELECT NULL, name, round(v, 2) FROM n WHERE seq NOT IN (SELECT seq FROM h)""")
def join_merge_tiers(spark, d):
    target = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("yr"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"), F.col("c_acctbal").alias("v"))
    o = t(spark, d, "orders").where("o_totalprice > 300000")
    name = F.concat(F.lit("Customer#"), F.lpad(((F.col("o_custkey") * 2) % 400).cast("string"), 9, "0"))
    new = o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("id"), (F.col("o_custkey") % 25).cast("bigint").alias("yr"), name.alias("name"), F.lit("BUILDING").alias("team"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return joins.merge_tiers(target, new, "k", "seq", [["id", "yr"], ["name", "team"], ["name"]]).select("k", "name", r("v", 2).alias("v"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS no_box, b.k IS NOT NULL AS no_pbp FROM a FULL JOIN b ON a.k = b.k""")
def join_missing_flags(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return joins.missing_flags(o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '1-URGENT'"), ["k"], ("no_box", "no_pbp"))


@query("""WITH e AS (SELECT c_custkey AS k FROM customer), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'f' AS source, count(*) AS covered FROM e SEMI JOIN f USING (k) UNION ALL SELECT 'p', count(*) FROM e SEMI JOIN p USING (k) UNION ALL SELECT 'any', count(*) FROM e WHERE k IN (SELECT k FROM f) OR k IN (SELECT k FROM p)""")
def join_covered_by(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return joins.covered_by(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), {"f": o.where("o_orderstatus = 'F'"), "p": o.where("o_orderstatus = 'P'")}, ["k"], {"f": o.where("o_orderpriority = '5-LOW'")})


@query("""WITH l AS (SELECT c_nationkey AS n, c_name AS a FROM customer), m AS (SELECT c_nationkey AS n, 'X ' || c_name AS b FROM customer WHERE c_mktsegment = 'BUILDING'), h AS (SELECT n, a, b, count(*) OVER (PARTITION BY n, a) AS k FROM l JOIN m USING (n) WHERE ends_with(b, a) AND length(b) > length(a)) SELECT n, a, b FROM h WHERE k = 1""")
def join_suffix(spark, d):
    c = t(spark, d, "customer")
    right = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n"), F.concat(F.lit("X "), F.col("c_name")).alias("b"))
    return joins.suffix_match(c.select(F.col("c_nationkey").alias("n"), F.col("c_name").alias("a")), right, ["n"], "a", "b").select("n", "a", "b")


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS a, p_name AS x FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), q AS (SELECT a.o, a.a, b.a AS b, CASE WHEN a.x = b.x THEN 1.0 ELSE 0.0 END AS s FROM l a JOIN l b USING (o) WHERE a.x = b.x)
SELECT o, a, b, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY o, a ORDER BY s DESC, b) AS k FROM q) WHERE k = 1""")
def join_fuzzy_exact(spark, d):
    """Names inside a game by similarity of 1: the exact tier of the fuzzy join, which SQL can say."""
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    l = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("a"), F.col("p_name").alias("x")).distinct()  # noqa: E741
    left = l.withColumn("ka", F.concat_ws("/", "o", "a"))
    return joins.fuzzy(left, l.select("o", F.col("a").alias("b"), F.col("x").alias("y")), ["o"], "x", "y", 1.0, "ka", "b").select("o", "a", "b", "score")


@query("""WITH a AS (SELECT o_orderkey AS l, o_orderdate::DATE AS dt, (floor(o_totalprice)::BIGINT % 7) AS hp, (o_custkey % 5) AS ap FROM orders), b AS (SELECT o_orderkey AS r, o_orderdate::DATE AS dt, (floor(o_totalprice)::BIGINT % 7) AS hp, (o_custkey % 5) AS ap FROM orders), j AS (SELECT l, r, count(*) OVER (PARTITION BY l) AS n FROM a JOIN b ON a.dt = b.dt AND a.hp = b.hp AND a.ap = b.ap)
SELECT l AS l_id, r AS r_id, 1.0::DOUBLE AS confidence, 'score_exact' AS method FROM j WHERE n = 1""")
def join_games_by_score(spark, d):
    """Games of a date by their score; names are unlike on purpose, so that only the exact tier holds."""
    o = t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), (F.floor("o_totalprice") % 7).alias("hp"), (F.col("o_custkey") % 5).alias("ap"))
    side = lambda s, n: o.select(F.col("o_orderkey").alias(f"{s}_id"), "date", F.lit(n).alias(f"{s}_home"), F.lit(n).alias(f"{s}_away"), F.col("hp").alias(f"{s}_hp"), F.col("ap").alias(f"{s}_ap"))
    return joins.games_by_score(side("l", "aaaa"), side("r", "zzzz"))


@query(f"""WITH s AS (SELECT athlete_id, season, games, pts FROM {SEASON}), x AS (SELECT 'pbp' AS source, athlete_id, season, games AS poss, pts FROM s WHERE games > 2 UNION ALL SELECT 'box', athlete_id, season, 3, pts + 1 FROM s UNION ALL SELECT 'manual', athlete_id, season, NULL, pts + 2 FROM s)
SELECT athlete_id, season, source, round(pts, 2) AS pts FROM (SELECT *, row_number() OVER (PARTITION BY season, athlete_id ORDER BY poss DESC NULLS LAST, source) AS k FROM x) WHERE k = 1""")
def plan_impact_stack(spark, d):
    s = season(spark, d).select("athlete_id", "season", F.col("games").alias("poss"), "pts")
    parts = {"pbp": s.where("poss > 2"), "box": s.withColumns({"poss": F.lit(3).cast("bigint"), "pts": F.col("pts") + 1}), "manual": s.withColumns({"poss": F.lit(None).cast("bigint"), "pts": F.col("pts") + 2})}
    return careers.impact_stack(parts).select("athlete_id", "season", "source", r("pts", 2).alias("pts"))


NBA = f"(SELECT athlete_id AS nba_id, season, minutes_total AS minutes, games, pts FROM {SEASON})"


def nba(spark, d):
    return season(spark, d).select(F.col("athlete_id").alias("nba_id"), "season", F.col("minutes_total").alias("minutes"), "games", "pts")


@query(f"""WITH s AS {NBA}, d AS (SELECT p_partkey AS nba_id, 1991 + p_size % 6 AS dy FROM part WHERE p_size > 20), f AS (SELECT nba_id, min(season) FILTER (WHERE minutes > 100) AS big, min(season) AS anyy FROM s GROUP BY 1), k AS (SELECT nba_id, coalesce(dy + 1, big, anyy)::INTEGER AS rookie FROM f LEFT JOIN d USING (nba_id))
SELECT k.nba_id, rookie AS rookie_season, round(s.pts, 2) AS pts FROM k LEFT JOIN s ON s.nba_id = k.nba_id AND s.season = rookie""")
def plan_first_year(spark, d):
    s, draft = nba(spark, d), t(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("nba_id"), (1991 + F.col("p_size") % 6).alias("draft_year"))
    rookie = careers.rookie_season(s, draft, 100).withColumn("rookie_season", F.col("rookie_season").cast("int"))
    first = careers.first_year(s.withColumn("team", F.lit("x")), rookie)
    return rookie.join(first.select("nba_id", r("pts", 2).alias("pts")), "nba_id", "left").select("nba_id", "rookie_season", "pts")


@query(f"""WITH s AS {NBA}, y AS (SELECT *, season - min(season) OVER (PARTITION BY nba_id) AS yr, pts - lag(pts) OVER (PARTITION BY nba_id ORDER BY season) AS dd FROM s), z AS (SELECT *, CASE WHEN yr < 4 THEN 1 END AS ok, CASE WHEN yr < 4 THEN row_number() OVER (PARTITION BY nba_id ORDER BY season) END AS k FROM y)
SELECT nba_id, round(max(pts), 2) AS peak, round(arg_max(coalesce(CASE WHEN k > 1 THEN dd END, -1e300), season), 2) AS last_change, count(pts) AS seasons FROM z WHERE ok = 1 GROUP BY 1""")
def plan_horizon(spark, d):
    return careers.horizon(nba(spark, d), "pts", 4).select("nba_id", r("peak", 2).alias("peak"), r(F.coalesce("last_change", F.lit(-1e300)), 2).alias("last_change"), "seasons")


@query(f"""WITH n AS (SELECT nba_id, sum(pts) AS pts, sum(games)::BIGINT AS games FROM {NBA} WHERE season >= 1996 GROUP BY 1), c AS (SELECT nba_id AS athlete_id, sum(pts) AS pts, sum(games)::BIGINT AS games FROM {NBA} WHERE season < 1996 GROUP BY 1)
SELECT n.nba_id, c.athlete_id, round(n.pts - c.pts, 2) AS pts_gap, n.games - c.games AS games_gap FROM n JOIN c ON c.athlete_id = n.nba_id""")
def plan_gaps(spark, d):
    s = nba(spark, d)
    total = lambda df, k: df.groupBy(F.col("nba_id").alias(k)).agg(F.sum("pts").alias("pts"), F.sum("games").alias("games"))
    n, c = total(s.where("season >= 1996"), "nba_id"), total(s.where("season < 1996"), "athlete_id")
    g = careers.gaps(n, c, n.select("nba_id", F.col("nba_id").alias("athlete_id")), ["pts", "games"])
    return g.select("nba_id", "athlete_id", r("pts_gap", 2).alias("pts_gap"), "games_gap")


@query(f"""WITH s AS (SELECT nba_id, season, CASE WHEN games > 1 THEN games END AS ht, CASE WHEN minutes > 60 THEN round(minutes, 2) END AS wt FROM {NBA})
SELECT nba_id, arg_min(ht, season) FILTER (WHERE ht IS NOT NULL)::DOUBLE AS ht_first, max(ht)::DOUBLE AS ht_max, (max(ht) - arg_min(ht, season) FILTER (WHERE ht IS NOT NULL))::DOUBLE AS ht_gain, count(ht) >= 2 AS ht_seasons, arg_min(wt, season) FILTER (WHERE wt IS NOT NULL) AS wt_first, max(wt) AS wt_max, round(max(wt) - arg_min(wt, season) FILTER (WHERE wt IS NOT NULL), 2) AS wt_gain, count(wt) >= 2 AS wt_seasons FROM s GROUP BY 1 HAVING max(ht) IS NOT NULL OR max(wt) IS NOT NULL""")
def plan_growth(spark, d):
    s = nba(spark, d).select("nba_id", "season", F.when(F.col("games") > 1, F.col("games").cast("string")).alias("ht"), F.when(F.col("minutes") > 60, r("minutes", 2)).alias("wt"))
    return careers.growth(s, "nba_id", "season", ["ht", "wt"]).withColumn("wt_gain", r("wt_gain", 2))


@query(f"""WITH s AS (SELECT athlete_id, season, (season - 1990)::DOUBLE AS t, pts / 1000 AS y, minutes_total AS w FROM {SEASON}), m AS (SELECT athlete_id, count(*) AS n, sum(w) AS sw, sum(w * t) AS sx, sum(w * y) AS sy, sum(w * t * t) AS sxx, sum(w * t * y) AS sxy, sum(w * y * y) AS syy FROM s WHERE w > 0 GROUP BY 1),
f AS (SELECT athlete_id, n, sxx - sx * sx / sw AS d, CASE WHEN sxx - sx * sx / sw > 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) END AS b, sxy - sx * sy / sw AS c, syy - sy * sy / sw AS e FROM m), g AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(e - b * c, 0) / (n - 2) / d) END AS se FROM f)
SELECT athlete_id, n, round(b, 4) AS p50, round(b - 1.2815515655446004 * se, 4) AS p10, round(b + 1.2815515655446004 * se, 4) AS p90 FROM g""")
def plan_development_bands(spark, d):
    s = season(spark, d).withColumns({"t": F.col("season") - 1990, "y": F.col("pts") / 1000})
    return careers.development(s, "y", "minutes_total").select("athlete_id", "n", *[r(c, 4).alias(c) for c in ("p50", "p10", "p90")])


@query("""WITH x AS (SELECT l_partkey AS a, l_suppkey AS s, l_linenumber AS src, l_quantity AS conf, CASE WHEN l_tax > 0.02 THEN l_tax END AS h, CASE WHEN l_discount > 0.02 THEN l_discount END AS w, l_orderkey AS m FROM lineitem), y AS (SELECT *, 10 * src + 2 * conf + 0.25 * ((h IS NOT NULL)::INT + (w IS NOT NULL)::INT) + m / 1000000.0 AS total FROM x)
SELECT a AS athlete_id, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY total DESC, s) AS k FROM y) WHERE k = 1""")
def plan_physicals(spark, d):
    c = F.col
    x = t(spark, d, "lineitem").select(c("l_partkey").alias("athlete_id"), c("l_suppkey").alias("source"), c("l_linenumber").alias("source_rank"), c("l_quantity").alias("confidence"), F.when(c("l_tax") > 0.02, c("l_tax")).alias("height"), F.when(c("l_discount") > 0.02, c("l_discount")).alias("weight"), F.lit(None).cast("double").alias("wingspan"), (c("l_orderkey") / 1000000.0).alias("match_score"))
    return matching.canonical_physicals(x).select("athlete_id", r("total", 6).alias("total"))


@query("""WITH e AS (SELECT user_id AS athlete_id, event_id % 3 AS season, ts, event_id, value FROM events), f AS (SELECT *, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS m, row_number() OVER (PARTITION BY athlete_id, season ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY athlete_id, season) AS n FROM e WINDOW w AS (PARTITION BY athlete_id, season ORDER BY ts, event_id ROWS 2 PRECEDING)),
b AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, season ORDER BY m DESC, i) AS k FROM f WHERE m IS NOT NULL) SELECT athlete_id, season, round(m, 4) AS best, round(CASE WHEN n > 1 THEN (i - 1) / (n - 1) END, 6) AS timing FROM b WHERE k = 1""")
def plan_breakout(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("athlete_id"), (F.col("event_id") % 3).alias("season"), F.col("ts").alias("game_date"), F.col("event_id").alias("game_id"), "value")
    return careers.breakout(e, "value").select("athlete_id", "season", r("best").alias("best"), r("timing", 6).alias("timing"))


@query("""WITH e AS (SELECT user_id AS athlete_id, event_id % 3 AS season, value AS m, value + 1 AS a, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT athlete_id, season, count(*) FILTER (WHERE k <= 5) = 5 AS h, CASE WHEN count(*) FILTER (WHERE k <= 5) = 5 THEN sum(m) FILTER (WHERE k <= 5) / sum(a) FILTER (WHERE k <= 5) END AS l, CASE WHEN count(*) FILTER (WHERE k BETWEEN 6 AND 10) = 5 THEN sum(m) FILTER (WHERE k BETWEEN 6 AND 10) / sum(a) FILTER (WHERE k BETWEEN 6 AND 10) END AS p FROM e GROUP BY ALL)
SELECT athlete_id, season, round(l, 6) AS rate_last5, round(l - p, 6) AS rate_delta5, h::INTEGER AS has_last5 FROM s""")
def plan_season_windows(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("athlete_id"), (F.col("event_id") % 3).alias("season"), F.col("ts").alias("game_date"), F.col("event_id").alias("game_id"), F.col("value").alias("m"), (F.col("value") + 1).alias("a"))
    return careers.season_windows(e, "m", "a").select("athlete_id", "season", r("rate_last5", 6).alias("rate_last5"), r("rate_delta5", 6).alias("rate_delta5"), "has_last5")


@query(f"""WITH x AS (SELECT athlete_id, season, arg_max(l, (m, l)) AS team, sum(g) AS g FROM (SELECT l_partkey AS athlete_id, season, l_suppkey AS l, sum(l_quantity) AS m, count(*) AS g FROM {LINES} GROUP BY ALL) GROUP BY 1, 2), c AS (SELECT *, lag(team) OVER w AS p, lag(g) OVER w AS pg FROM x WINDOW w AS (PARTITION BY athlete_id ORDER BY season)), e AS (SELECT athlete_id, season, abs(g - pg) / 2 AS shock FROM c WHERE p <> team)
SELECT athlete_id, count(*) AS n_transfers, max(season) AS last_transfer, round(avg(shock), 6) AS mean_shock, round(max(shock), 6) AS max_shock FROM e GROUP BY 1""")
def plan_transfer_summary(spark, d):
    from fastbreak.queries import team_season

    one = careers.collapse_teams(team_season(spark, d), ["games"], ["teamId"])
    s = careers.transfer_summary(careers.transfers(one, {"games": 2.0}))
    return s.select("athlete_id", "n_transfers", "last_transfer", r("mean_shock", 6).alias("mean_shock"), r("max_shock", 6).alias("max_shock"))


STINTS = f"(SELECT season, l_orderkey AS g, p[1:2] AS home, p[3:4] AS away, x AS hp, q / 1000 AS ap, q AS poss FROM (SELECT l_orderkey, list(DISTINCT l_partkey::VARCHAR ORDER BY l_partkey::VARCHAR) AS p, sum(l_quantity) AS q, sum(l_discount) AS x, year(min(l_shipdate)) AS season FROM {LINES} GROUP BY 1) WHERE len(p) >= 4)"


def stints(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("p"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("x"), F.year(F.min("l_shipdate")).alias("season")).where(F.size("p") >= 4)
    return li.select("season", F.col("l_orderkey").alias("gameId"), F.lit(1).alias("stint"), F.slice("p", 1, 2).alias("home"), F.slice("p", 3, 2).alias("away"), F.lit(0).alias("h0"), F.col("x").alias("h1"), F.lit(0).alias("a0"), (F.col("q") / 1000).alias("a1"), F.col("q").alias("poss"))


@query(f"""WITH s AS (SELECT season, g, poss, unnest(home) AS p, hp - ap AS net FROM {STINTS} UNION ALL SELECT season, g, poss, unnest(away), ap - hp FROM {STINTS})
SELECT season, p AS player, round(sum(poss), 2) AS poss, round(100 * sum(net) / sum(poss), 9) + 0.0 AS on_net FROM s GROUP BY ALL""")
def plan_on_off(spark, d):
    return impact.on_off(stints(spark, d)).select("season", "player", r("poss", 2).alias("poss"), (r("on_net", 9) + 0.0).alias("on_net"))


@query(f"""WITH s AS {STINTS}, p AS (SELECT season, count(DISTINCT u) AS players FROM (SELECT season, unnest(list_concat(home, away)) AS u FROM s) GROUP BY 1), g AS (SELECT season, count(*) AS stints, max(players) AS players FROM s JOIN p USING (season) GROUP BY 1), x AS (SELECT season, count(*) AS rows, count(*) FILTER (WHERE l_tax > 0.06) AS u, count(*) FILTER (WHERE l_tax > 0.07) AS f FROM {LINES} GROUP BY 1)
SELECT season, stints, concat_ws(';', CASE WHEN stints < 200 THEN 'stints' END, 'five_on_five', CASE WHEN players < 300 THEN 'players' END, CASE WHEN u / rows > 0.2 THEN 'unresolved' END, CASE WHEN f / rows > 0.05 THEN 'parse' END) AS reason FROM g JOIN x USING (season)""")
def plan_season_gate(spark, d):
    parsed = lines(spark, d).groupBy("season").agg(F.count("*").alias("rows"), F.count_if(F.col("l_tax") > 0.06).alias("unresolved"), F.count_if(F.col("l_tax") > 0.07).alias("failed"))
    return impact.season_gate(stints(spark, d), 200, 300, parsed).select("season", "stints", "reason")


@query("""WITH s AS (SELECT l_orderkey AS g, l_suppkey AS tm, l_partkey AS a, 1 + l_linenumber % 2 AS p, (l_quantity * 20)::INTEGER AS i, (l_discount * 10000)::INTEGER AS o FROM lineitem)
SELECT tm AS "teamId", a AS "athleteId", round(sum(greatest((p * 1200 - o) - (p * 1200 - i), 0)) / 60, 4) AS minutes, count(*) AS spells, count(DISTINCT g) AS games FROM s GROUP BY ALL""")
def plan_minutes_from_subs(spark, d):
    c = F.col
    spell = lambda left: F.struct((1 + c("l_linenumber") % 2).alias("period"), left.cast("int").alias("secondsRemaining"))
    s = t(spark, d, "lineitem").select(c("l_orderkey").alias("gameId"), c("l_suppkey").alias("teamId"), c("l_partkey").alias("athleteId"), spell(F.round(c("l_quantity") * 20)).alias("subIn"), spell(F.round(c("l_discount") * 10000)).alias("subOut"))
    return impact.minutes_from_substitutions(s).withColumn("minutes", r("minutes"))


@query(f"""WITH g AS (SELECT season, l_partkey AS player, l_suppkey AS team, l_linenumber * 20 AS opp, l_quantity AS m, l_extendedprice / 1000 AS pts, l_tax AS fga, l_discount AS fta FROM {LINES}), s AS (SELECT 'ALL' AS split_id, * FROM g UNION ALL SELECT 'VS_TOP50', * FROM g WHERE opp <= 50 UNION ALL SELECT 'VS_TOP100', * FROM g WHERE opp <= 100)
SELECT player, team, season, split_id, count(*) AS g, round(sum(pts), 6) AS pts, round(CASE WHEN sum(fga) + 0.44 * sum(fta) > 0 THEN sum(pts) / (2 * (sum(fga) + 0.44 * sum(fta))) END, 9) AS ts, round(sum(m) / count(*), 4) AS mpg FROM s GROUP BY ALL""")
def plan_season_table(spark, d):
    c = F.col
    g = lines(spark, d).select("season", c("l_partkey").alias("player"), c("l_suppkey").alias("team"), c("l_linenumber").alias("oppId"), c("l_quantity").alias("minutes"), (c("l_extendedprice") / 1000).alias("pts"), c("l_tax").alias("fga"), c("l_discount").alias("fta"), c("l_tax").alias("ast"), c("l_tax").alias("trb"))
    ranks = g.select("season", c("oppId").alias("teamId"), (c("oppId") * 20).alias("rank")).distinct()
    return site.season_table(g, ranks).select("player", "team", "season", "split_id", "g", r("pts", 6).alias("pts"), r("ts", 9).alias("ts"), r("mpg").alias("mpg"))


@query("""WITH a AS (SELECT c_custkey AS k, lower(c_name) AS p, lower(c_mktsegment) AS tm FROM customer), s AS (SELECT lower(c_name) AS p, CASE WHEN c_nationkey > 3 THEN lower(c_mktsegment) END AS tm FROM customer WHERE c_acctbal < 0)
SELECT k FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.p = a.p AND s.tm = a.tm) AND p NOT IN (SELECT p FROM s WHERE tm IS NULL)""")
def plan_overlay(spark, d):
    c = t(spark, d, "customer")
    shown = c.where("c_acctbal < 0").select(F.upper("c_name").alias("player"), F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("team"))
    return site.overlay_rows(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("player"), F.col("c_mktsegment").alias("team")), shown).select("k")


@query(f"""WITH b AS (SELECT athlete_id, season, games FROM {SEASON}), f AS (SELECT athlete_id, season, round(pts, 2) AS pts FROM {SEASON} WHERE games > 1), y AS (SELECT p_partkey AS athlete_id, p_size AS target FROM part WHERE p_size > 20)
SELECT b.athlete_id, b.season, games, pts, (f.athlete_id IS NOT NULL)::INTEGER AS has_box, target, 1 AS target_mask FROM b LEFT JOIN f USING (athlete_id, season) JOIN y ON y.athlete_id = b.athlete_id""")
def plan_unified(spark, d):
    s = season(spark, d)
    y = t(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("athlete_id"), F.col("p_size").alias("target"))
    return context.unified(s.select("athlete_id", "season", "games"), {"box": s.where("games > 1").select("athlete_id", "season", r("pts", 2).alias("pts"))}, ["athlete_id", "season"], y, forbidden={"target"})


@query("""SELECT (SELECT count(*) FROM orders) AS expected, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 10) AS covered, round((SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 10) / (SELECT count(*) FROM orders), 6) AS rate, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 10) / (SELECT count(*) FROM orders) >= 0.5 AS passes""")
def plan_coverage_gate(spark, d):
    have = t(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return audits.coverage_gate(t(spark, d, "orders"), have, ["o_orderkey"], 0.5).withColumn("rate", r("rate", 6))


@query("""SELECT o_orderstatus, round(count(*) FILTER (WHERE p <= 50 AND o_custkey > 100) / least(count(*), 50), 6) AS precision, round(count(*) FILTER (WHERE p <= 50 AND o_custkey > 100) / nullif(count(*) FILTER (WHERE o_custkey > 100), 0), 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) GROUP BY 1""")
def order_precision(spark, d):
    o = t(spark, d, "orders").withColumn("gain", F.when(F.col("o_custkey") > 100, 1.0).otherwise(0.0))
    return ordering.rank_metrics(o, ["o_orderstatus"], "o_totalprice", "gain", 50, [F.col("o_orderkey")]).select("o_orderstatus", r("precision", 6).alias("precision"), r("recall", 6).alias("recall"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN v END AS v FROM orders JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) USING (o_custkey)""")
def join_latest_known(spark, d):
    o = t(spark, d, "orders").withColumns({"at": F.struct("o_orderdate", "o_orderkey"), "yr": F.year("o_orderdate")})
    return joins.latest_value(o, "o_custkey", "at", "o_orderpriority", o.where("o_orderstatus = 'P'"), "yr", 1997).select("o_orderkey", F.col("o_orderpriority").alias("v"))


@query("""SELECT s_suppkey AS k, s_name AS name, round(s_acctbal, 2) AS v, CASE WHEN s_acctbal > 5000 THEN s_nationkey END AS extra FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'late ' || s_name, NULL, NULL FROM supplier WHERE s_acctbal <= 0""")
def src_catalog(spark, d):
    """A table created, appended to by shared columns, widened by a column, upserted and read with a parameter."""
    c = Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), r("s_acctbal", 2).alias("v"), "s_nationkey")
    c.init({"teams": "k bigint, name string, v double"})
    c.append("teams", s.where("v > 0"))
    c.append_tolerant("teams", s.where("v <= 0").select(F.col("k").cast("string").alias("k"), F.concat(F.lit("late "), "name").alias("name"), F.lit("no number").alias("v")))
    c.add_column("teams", "extra", "int")
    c.upsert("teams", s.where("v > 5000").select("k", "name", "v", F.col("s_nationkey").cast("int").alias("extra")), ["k"])
    c.vacuum("teams")
    return c.query("SELECT * FROM teams WHERE k > :least", {"least": -1}).select("k", "name", "v", "extra")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus, 1990 + o_orderkey % 3 AS season FROM orders""")
def src_csv(spark, d):
    """CSV files of several seasons, with quotes and commas in a text, written and read with the year in their names."""
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    said = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('", x'))
    o = t(spark, d, "orders").select("o_orderkey", said.alias("said"), "o_orderstatus", (1990 + F.col("o_orderkey") % 3).alias("y"))
    for y in (1990, 1991, 1992):
        files.write_csv(o.where(F.col("y") == y).drop("y"), f"{base}/stats_{y}")
    back = files.read_csv(spark, f"{base}/*", "o_orderkey bigint, said string, o_orderstatus string")
    back = back.withColumn("season", clock.year_in_name(F.element_at(F.split(F.input_file_name(), "/"), -2)))
    return back.select("o_orderkey", F.regexp_extract("said", '^"(.*)", x$', 1).alias("o_orderpriority"), "o_orderstatus", "season")


@query("""SELECT c_mktsegment AS seg, c_custkey AS k, round(c_acctbal, 2) AS bal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def src_partitions(spark, d):
    """JSON files by partition with their manifest, one of them read back and restricted by keys."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.struct(F.col("c_custkey").alias("k"), r("c_acctbal", 2).alias("bal")).alias("c"))
    manifest = files.write_partitioned(c, path, "seg", ["k"])
    url = files.dataset_for(manifest, "seg", "BUILDING").first()["url"]
    back = files.flatten(spark.read.schema("c struct<k:bigint,bal:double>").json(url)).select(F.lit("BUILDING").alias("seg"), F.col("c_k").alias("k"), F.col("c_bal").alias("bal"))
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return restrict(back, "k", o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


#: Plays of a game: nested shots with a shooter, a place given as text (some bad), a score and two participants.
PLAYS = """(SELECT l_orderkey AS g, l_linenumber AS i, l_partkey AS pk, year(l_shipdate)::INTEGER AS season, l_suppkey AS tm, (1 + l_linenumber % 4)::INTEGER AS period, (l_quantity * 24)::INTEGER AS secs, (l_orderkey % 50)::INTEGER AS hs, (l_partkey % 50)::INTEGER AS aw, l_returnflag <> 'N' AS shot, CASE WHEN l_suppkey % 7 > 0 THEN l_partkey END AS shooter, l_linestatus = 'F' AS made,
['rim', 'three_pointer', 'jumper', 'free_throw'][1 + l_partkey % 4] AS range_, l_tax > 0.04 AS assisted, CASE WHEN l_tax > 0.04 THEN l_suppkey END AS helper, CASE WHEN l_linenumber % 5 > 0 THEN (l_partkey * 7 % 940) END AS x, (l_suppkey * 13 % 500) AS y, ['Steal', 'Block Shot', 'Turnover', 'Jumper'][1 + l_partkey % 4] AS kind FROM lineitem)"""


def plays(spark, d):
    c = F.col
    who = lambda x: F.struct(x.cast("int").alias("id"), F.lit("n").alias("name"))
    pick = lambda k, *v: F.get(F.array(*map(F.lit, v)), (c(k) % len(v)).cast("int"))
    helper = F.when(c("l_tax") > 0.04, c("l_suppkey"))
    place = F.struct(F.when(c("l_linenumber") % 5 > 0, (c("l_partkey") * 7 % 940).cast("string")).otherwise("bad").alias("x"), (c("l_suppkey") * 13 % 500).cast("string").alias("y"))
    shot = F.struct(F.struct(F.when(c("l_suppkey") % 7 > 0, c("l_partkey")).cast("int").alias("id"), F.lit("n").alias("name")).alias("shooter"), (c("l_linestatus") == "F").alias("made"), pick("l_partkey", "rim", "three_pointer", "jumper", "free_throw").alias("range"), (c("l_tax") > 0.04).alias("assisted"), who(helper).alias("assistedBy"), place.alias("location"))
    return t(spark, d, "lineitem").select(
        c("l_linenumber").cast("long").alias("id"), c("l_orderkey").alias("gameId"), F.year("l_shipdate").alias("season"), c("l_suppkey").alias("teamId"), c("l_suppkey").alias("opponentId"), (1 + c("l_linenumber") % 4).cast("int").alias("period"), (c("l_quantity") * 24).cast("int").alias("secondsRemaining"),
        (c("l_orderkey") % 50).cast("int").alias("homeScore"), (c("l_partkey") % 50).cast("int").alias("awayScore"), (c("l_returnflag") != "N").alias("shootingPlay"), (c("l_linestatus") == "F").alias("scoringPlay"), pick("l_partkey", "Steal", "Block Shot", "Turnover", "Jumper").alias("playType"),
        F.array(who(c("l_partkey")), who(helper)).alias("participants"), shot.alias("shotInfo"),
    )


SHOT_ROWS = f"(SELECT *, abs(hs - aw) AS margin, period >= 2 AND secs < 300 AND abs(hs - aw) <= 5 AS hl, abs(hs - aw) > 20 AS gb FROM {PLAYS} WHERE shot AND shooter IS NOT NULL)"


@query(f"""SELECT g AS "gameId", shooter AS "athleteId", range_ AS range, count(*) AS att, count(*) FILTER (WHERE made) AS made, count(*) FILTER (WHERE assisted AND made) AS assisted, count(*) FILTER (WHERE hl) AS hl_att, count(*) FILTER (WHERE gb) AS garbage_att FROM {SHOT_ROWS} GROUP BY ALL""")
def plan_player_game_shots(spark, d):
    return staging.player_game_shots(staging.shots(plays(spark, d)))


@query(f"""WITH s AS (SELECT season, shooter, range_, made, assisted, CASE WHEN hl THEN 'HIGH' WHEN gb THEN 'GARBAGE' ELSE 'NORMAL' END AS lev, x, y, sqrt(power(x / 10 - CASE WHEN x < 470 THEN 5.25 ELSE 88.75 END, 2) + power(y / 10 - 25, 2)) AS dist, least(x / 10, 94 - x / 10) <= 14 AND (y / 10 <= 3 OR y / 10 >= 47) AS corner FROM {SHOT_ROWS})
SELECT season, shooter AS "athleteId", CASE WHEN grouping(lev) = 1 THEN 'ALL' ELSE lev END AS leverage, count(*) FILTER (WHERE range_ = 'rim') AS rim_att, count(*) FILTER (WHERE range_ = 'rim' AND made) AS rim_made, count(*) FILTER (WHERE made AND assisted) AS assisted_made, count(*) FILTER (WHERE x IS NOT NULL) AS xy_shots,
round(count(*) FILTER (WHERE range_ = 'three_pointer' AND made) / nullif(count(*) FILTER (WHERE range_ = 'three_pointer'), 0), 6) AS three_fg_pct, round(CASE WHEN count(x) >= 25 THEN avg(dist) END, 5) AS avg_shot_dist,
round(CASE WHEN count(x) FILTER (WHERE range_ = 'three_pointer') >= 15 THEN count(*) FILTER (WHERE x IS NOT NULL AND range_ = 'three_pointer' AND corner) / count(x) FILTER (WHERE range_ = 'three_pointer') END, 6) AS corner_3_rate FROM s GROUP BY GROUPING SETS ((season, shooter), (season, shooter, lev))""")
def plan_split_features(spark, d):
    s = staging.shots(plays(spark, d))
    s = s.withColumns({"leverage": F.when(F.col("high_leverage"), "HIGH").when(F.col("garbage"), "GARBAGE").otherwise("NORMAL"), "strength": F.lit("TOP")})
    out = staging.split_features(s).where("strength = 'ALL'")
    return out.select("season", "athleteId", "leverage", "rim_att", "rim_made", "assisted_made", "xy_shots", r("three_fg_pct", 6).alias("three_fg_pct"), r("avg_shot_dist", 5).alias("avg_shot_dist"), r("corner_3_rate", 6).alias("corner_3_rate"))


@query(f"""WITH p AS (SELECT season, g, pk AS a, kind, made, helper FROM {PLAYS}), e AS (SELECT season, helper AS a, 'ast' AS s FROM p WHERE made AND helper IS NOT NULL UNION ALL SELECT season, a, CASE kind WHEN 'Steal' THEN 'stl' WHEN 'Block Shot' THEN 'blk' WHEN 'Turnover' THEN 'tov' END FROM p WHERE kind <> 'Jumper'),
w AS (SELECT season, g, a FROM p UNION ALL SELECT season, g, helper FROM p), n AS (SELECT season, a, count(DISTINCT g) AS games FROM w GROUP BY ALL), c AS (SELECT season, a, count(*) FILTER (WHERE s = 'ast') AS ast, count(*) FILTER (WHERE s = 'stl') AS stl, count(*) FILTER (WHERE s = 'blk') AS blk, count(*) FILTER (WHERE s = 'tov') AS tov FROM e GROUP BY ALL)
SELECT n.season, n.a AS "athleteId", games, coalesce(ast, 0) AS ast, coalesce(stl, 0) AS stl, coalesce(blk, 0) AS blk, coalesce(tov, 0) AS tov FROM n LEFT JOIN c ON c.season = n.season AND c.a = n.a""")
def plan_box(spark, d):
    return staging.box_from_events(plays(spark, d))


@query("""WITH s AS (SELECT l_orderkey AS g, l_suppkey AS tm, l_quantity AS sec, l_extendedprice / 1000 AS net, unnest([l_partkey, l_partkey + 1]) AS a FROM lineitem) SELECT g AS "gameId", tm AS "teamId", a AS "athleteId", sum(sec) AS seconds, round(sum(net * sec) / sum(sec), 7) AS net FROM s GROUP BY ALL""")
def plan_player_game_impact(spark, d):
    c = F.col
    who = lambda x: F.struct(x.alias("id"), F.lit("n").alias("name"))
    s = t(spark, d, "lineitem").select(c("l_orderkey").alias("gameId"), c("l_suppkey").alias("teamId"), F.lit("h").alias("idHash"), c("l_quantity").alias("totalSeconds"), c("l_tax").alias("pace"), c("l_tax").alias("offenseRating"), c("l_tax").alias("defenseRating"), (c("l_extendedprice") / 1000).alias("netRating"), F.array(who(c("l_partkey")), who(c("l_partkey") + 1)).alias("athletes"))
    return staging.player_game_impact(s).select("gameId", "teamId", "athleteId", "seconds", r("netRating", 7).alias("net"))


@query("""WITH e AS (SELECT event_id % 5 AS season, user_id AS g, event_id, (floor(value) * 37)::INTEGER % 1300 AS rem, ts FROM events), n AS (SELECT *, lead(rem) OVER (PARTITION BY g ORDER BY event_id) AS nx FROM e), s AS (SELECT *, CASE WHEN nx > rem THEN rem ELSE rem - nx END AS gap FROM n)
SELECT season, p AS player, round(sum(CASE WHEN gap BETWEEN 0 AND 1200 THEN gap ELSE 0 END) / 60, 4) AS minutes, count(DISTINCT g) AS games FROM (SELECT *, unnest([event_id % 9, 100 + event_id % 4]) AS p FROM s) GROUP BY ALL""")
def plan_minutes_on_floor(spark, d):
    who = lambda x: F.struct(x.alias("id"), F.lit("n").alias("name"), F.lit("t").alias("team"))
    k = F.col("event_id")
    e = t(spark, d, "events").select((k % 5).alias("season"), F.col("user_id").alias("gameId"), k.alias("seq"), ((F.floor("value") * 37).cast("int") % 1300).alias("remaining"), F.array(who(k % 9), who(100 + k % 4)).alias("onFloor"))
    return impact.minutes_on_floor(e).withColumn("minutes", r("minutes"))


@query(f"""WITH s AS (SELECT *, CASE WHEN games > 1 THEN pts / games END AS a, disc AS b FROM {SEASON}), i AS (SELECT *, coalesce(a, b) AS raw, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' ELSE 'none' END AS src, minutes_total / (minutes_total + 300) AS rel, percent_rank() OVER (PARTITION BY season ORDER BY minutes_total) >= 0.9 AS hi FROM s),
f AS (SELECT *, raw * CASE WHEN hi THEN greatest(rel, 0.5) ELSE rel END AS impact FROM i)
SELECT athlete_id, season, src AS impact_source, round(impact, 6) AS impact, round(impact - lag(impact) OVER (PARTITION BY athlete_id ORDER BY season), 6) AS velocity, (minutes_total < 200)::INTEGER AS flag_low_volume FROM f""")
def plan_context(spark, d):
    s = season(spark, d).withColumns({"a": F.when(F.col("games") > 1, F.col("pts") / F.col("games")), "b": F.col("disc")})
    return context.pathway_context(s, ["a", "b"], {"games": 1.0}, "minutes_total").select("athlete_id", "season", "impact_source", r("impact", 6).alias("impact"), r("velocity", 6).alias("velocity"), "flag_low_volume")


@query(f"""WITH s AS (SELECT athlete_id, season, games AS g, row_number() OVER (PARTITION BY athlete_id ORDER BY season) AS i FROM {SEASON}), z AS (SELECT *, (g - avg(g) OVER (PARTITION BY season)) / nullif(stddev_samp(g) OVER (PARTITION BY season), 0) AS z FROM s), a AS (SELECT * FROM z WHERE athlete_id = 10), b AS (SELECT * FROM z WHERE athlete_id = 20)
SELECT 'Y' || coalesce(a.i, b.i) AS label, round(a.z, 6) AS z_a, round(b.z, 6) AS z_b, round(a.z - b.z, 6) AS edge FROM a FULL JOIN b ON a.i = b.i""")
def plan_compare(spark, d):
    """Two players side by side: the feature is the comparison of a pair."""
    s = season(spark, d).select(F.col("athlete_id").cast("string").alias("player"), "season", "games")
    return site.compare(s, "10", "20", ["games"]).select("label", r("z_a", 6).alias("z_a"), r("z_b", 6).alias("z_b"), r("edge", 6).alias("edge"))


@query(f"""WITH s AS (SELECT l_partkey AS player, season, max(l_suppkey) AS team, count(*) AS g, sum(l_quantity) AS minutes FROM {LINES} GROUP BY ALL) SELECT player, count(DISTINCT season) AS seasons, arg_max(team, season) AS team, max(season) AS last_season, sum(g)::BIGINT AS g, sum(minutes) AS minutes FROM s GROUP BY 1""")
def plan_career_table(spark, d):
    s = lines(spark, d).groupBy(F.col("l_partkey").alias("player"), "season").agg(F.max("l_suppkey").alias("team"), F.count("*").alias("g"), F.sum("l_quantity").alias("minutes"), F.sum("l_extendedprice").alias("pts"), F.sum("l_tax").alias("fga"), F.sum("l_discount").alias("fta"))
    return site.career_table(s.withColumn("split_id", F.lit("ALL"))).select("player", "seasons", "team", "last_season", "g", "minutes")


@query(f"""WITH s AS (SELECT athlete_id, row_number() OVER (PARTITION BY athlete_id ORDER BY season) AS i, games AS g FROM {SEASON}), d AS (SELECT *, g - lag(g) OVER (PARTITION BY athlete_id ORDER BY i) AS dd FROM s)
SELECT athlete_id, count(g) AS n, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd, arg_max(g, i) AS last, round(CASE WHEN count(g) >= 2 THEN regr_slope(g, i) END, 6) + 0.0 AS slope, round(CASE WHEN count(g) >= 3 THEN regr_slope(dd, i) END, 6) + 0.0 AS accel, round(CASE WHEN stddev_samp(g) IS NULL THEN NULL WHEN stddev_samp(g) < 0.01 THEN 0 ELSE (arg_max(g, i) - avg(g)) / stddev_samp(g) END, 6) + 0.0 AS late_bloom FROM d GROUP BY 1""")
def plan_trajectory(spark, d):
    from pyspark.sql import Window as W

    s = season(spark, d).withColumns({"season_idx": F.row_number().over(W.partitionBy("athlete_id").orderBy("season")), "stint_id": F.lit(1)})
    return careers.trajectory(s, "games").select("athlete_id", "n", r("mean", 6).alias("mean"), r("sd", 6).alias("sd"), "last", (r("slope", 6) + 0.0).alias("slope"), (r("accel", 6) + 0.0).alias("accel"), (r("late_bloom", 6) + 0.0).alias("late_bloom"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS season, l_suppkey AS team, 'Al ' || p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT DISTINCT l_orderkey AS season, l_suppkey AS team, p_name AS match FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT season, team, name, w, string_split(lower(name), ' ')[w] AS tok, 3 - w AS prio FROM m, (VALUES (1), (2), (3)) v(w)), u AS (SELECT season, team, match, unnest(list_distinct(string_split(lower(match), ' '))) AS tok FROM k), h AS (SELECT season, team, name, prio, count(DISTINCT match) AS n, min(match) AS match FROM t JOIN u USING (season, team, tok) WHERE length(tok) > 2 GROUP BY ALL)
SELECT season, team, name, match FROM (SELECT *, row_number() OVER (PARTITION BY season, team, name ORDER BY prio) AS r FROM h WHERE n = 1) WHERE r = 1""")
def join_token_rescue(spark, d):
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    k = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("season"), F.col("l_suppkey").alias("team"), F.col("p_name").alias("name")).distinct()
    return matching.token_rescue(k.withColumn("name", F.concat(F.lit("Al "), "name")), k)


@query("""WITH a AS (SELECT c_nationkey AS season, c_mktsegment AS team, c_custkey % 11 AS jersey, c_custkey % 9 + 70 AS height, c_name AS name FROM customer), k AS (SELECT c_nationkey AS season, c_mktsegment AS team, c_custkey % 7 AS jersey, c_custkey % 5 + 71 AS height, 'X ' || c_name AS name FROM customer)
SELECT season, team, name, match, points FROM (SELECT a.season, a.team, a.name, k.name AS match, 6 + (a.name = k.name[3:])::INTEGER AS points, row_number() OVER (PARTITION BY a.season, a.team, a.name ORDER BY 6 + (a.name = k.name[3:])::INTEGER DESC, k.name) AS r FROM a JOIN k USING (season, team) WHERE a.jersey = k.jersey AND abs(a.height - k.height) <= 1) WHERE r = 1""")
def join_body_rescue(spark, d):
    c = F.col
    base = t(spark, d, "customer").select(c("c_nationkey").alias("season"), c("c_mktsegment").alias("team"), "c_custkey", "c_name")
    side = lambda j, h, low, name: base.select("season", "team", (c("c_custkey") % j).alias("jersey"), (c("c_custkey") % h + low).alias("height"), name.alias("name"))
    return matching.body_rescue(side(11, 9, 70, c("c_name")), side(7, 5, 71, F.concat(F.lit("X "), "c_name")))


@query("""WITH a AS (SELECT p_partkey AS i, lower(p_name) AS n, CASE WHEN p_size > 5 THEN p_size END AS yr FROM part), t AS (SELECT i, n, yr, unnest(list_distinct([string_split(n, ' ')[1], string_split(n, ' ')[-1]])) AS b FROM a)
SELECT DISTINCT l.i AS nba_id, k.i AS athlete_id FROM t l JOIN t k USING (b) WHERE (l.yr IS NULL OR abs(l.yr - coalesce(k.yr, 1)) <= 3)""")
def join_candidates(spark, d):
    p = t(spark, d, "part")
    size = F.when(F.col("p_size") > 5, F.col("p_size"))
    left = p.select(F.col("p_partkey").alias("nba_id"), F.col("p_name").alias("player_name"), size.alias("draft_year_proxy"))
    return matching.candidates(left, p.select(F.col("p_partkey").alias("athlete_id"), F.col("p_name").alias("athlete_name"), F.coalesce(size, F.lit(1)).alias("final_season"))).select("nba_id", "athlete_id")


@query("""SELECT o_orderkey, 'new' AS kind FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'failed' FROM orders WHERE o_orderstatus = 'P'""")
def src_incremental(spark, d):
    """Rows a catalog table lacks, and failures logged with their time."""
    c = Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    c.write("seen", o.where("o_orderstatus = 'F'"))
    c.log_failures("failures", o.where("o_orderstatus = 'P'"))
    new = c.missing(o, "seen", "o_orderkey").select("o_orderkey", F.lit("new").alias("kind"))
    return new.unionByName(c.table("failures").where("failed_at IS NOT NULL").select("o_orderkey", F.lit("failed").alias("kind")))


TOTALS = "sum(l_quantity)::BIGINT AS fga_total, sum(l_linenumber)::BIGINT AS ft_att, count(*) AS ft_made, count(*) FILTER (WHERE l_tax > 0.02) AS rim_made, count(*) FILTER (WHERE l_tax > 0.05) AS mid_made, count(*) FILTER (WHERE l_discount > 0.05) AS three_made, count(*) FILTER (WHERE l_discount > 0.02) AS tov_total, count(*) AS shots_total"


def totals(df):
    n = lambda cond, k: F.count_if(cond).alias(k)
    return df.groupBy("season", F.col("l_suppkey").alias("athlete_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("fga_total"), F.sum("l_linenumber").cast("bigint").alias("ft_att"), F.count("*").alias("ft_made"), n(F.col("l_tax") > 0.02, "rim_made"), n(F.col("l_tax") > 0.05, "mid_made"), n(F.col("l_discount") > 0.05, "three_made"), n(F.col("l_discount") > 0.02, "tov_total"), F.count("*").alias("shots_total"),
        n(F.col("l_tax") > 0.01, "rim_att"), n(F.col("l_tax") > 0.06, "dunk_att"), n(F.col("l_linenumber") > 2, "orb_total"), n(F.col("l_linenumber") > 3, "putback_att"), n(F.col("l_quantity") > 10, "transition_att"), n(F.col("l_quantity") > 30, "transition_made"), F.sum("l_quantity").alias("poss"),
        n(F.col("l_quantity") > 40, "stl_total"), n(F.col("l_quantity") > 45, "blk_total"), n(F.col("l_quantity") > 20, "pf_total"), n((F.col("l_tax") > 0.05) & (F.col("l_discount") > 0.05), "assisted_made"),
    )


@query(f"""WITH b AS (SELECT season, l_suppkey AS a, {TOTALS}, count(*) FILTER (WHERE l_tax > 0.01) AS rim_att, count(*) FILTER (WHERE l_tax > 0.06) AS dunk, count(*) FILTER (WHERE l_linenumber > 2) AS orb, count(*) FILTER (WHERE l_linenumber > 3) AS put, count(*) FILTER (WHERE l_quantity > 10) AS tr, count(*) FILTER (WHERE l_quantity > 30) AS trm, sum(l_quantity) AS poss, count(*) FILTER (WHERE l_quantity > 40) AS stl, count(*) FILTER (WHERE l_quantity > 45) AS blk, count(*) FILTER (WHERE l_quantity > 20) AS pf, count(*) FILTER (WHERE l_tax > 0.05 AND l_discount > 0.05) AS helped FROM {LINES} GROUP BY ALL),
s AS (SELECT season, l_suppkey AS a, l_returnflag = 'R' AS hi, {TOTALS} FROM {LINES} GROUP BY ALL), e AS (SELECT season, a, hi, shots_total AS n, CASE WHEN fga_total + 0.44 * ft_att + tov_total > 10 THEN tov_total / (fga_total + 0.44 * ft_att + tov_total) END AS lost, CASE WHEN fga_total + 0.44 * ft_att > 10 THEN (2 * rim_made + 3 * three_made + 2 * mid_made + ft_made) / (2 * (fga_total + 0.44 * ft_att)) END AS ts FROM s),
j AS (SELECT b.*, rim_made + mid_made + three_made AS made, h.n AS hn, h.lost AS hl, h.ts AS ht, l.lost AS ll, l.ts AS lt FROM b LEFT JOIN e h ON h.season = b.season AND h.a = b.a AND h.hi LEFT JOIN e l ON l.season = b.season AND l.a = b.a AND NOT l.hi)
SELECT season, a AS athlete_id, round(CASE WHEN rim_att >= 10 THEN (dunk + 2) / (rim_att + 4) END, 6) AS dunk_rate, round(CASE WHEN fga_total >= 10 THEN dunk / fga_total END, 6) AS dunk_freq, round(CASE WHEN orb >= 5 THEN put / (orb + 1) END, 6) AS putback_rate, round(CASE WHEN fga_total >= 10 THEN tr / fga_total END, 6) AS transition_freq, round(CASE WHEN tr >= 10 THEN (trm + 2) / (tr + 4) END, 6) AS transition_eff,
round(CASE WHEN fga_total >= 10 AND poss > 0 THEN (rim_att + 0.44 * ft_att) / poss END, 6) AS rim_pressure_index, round(CASE WHEN poss >= 50 THEN 1.5 * stl / poss + 0.5 * blk / poss END, 6) AS deflection_proxy, round(CASE WHEN poss >= 50 THEN blk / poss / (blk / poss + pf / poss + 0.01) END, 6) AS contest_proxy, round(hl - ll, 6) AS pressure_handle_proxy, round(ht - lt, 6) AS clutch_shooting_delta,
round(CASE WHEN made >= 10 THEN (made - helped) / made END, 6) AS self_creation_rate, round(CASE WHEN made - helped >= 5 THEN (made - helped + 2) / ((made - helped) * 1.5 + 4) END, 6) AS self_creation_eff, round(CASE WHEN shots_total >= 10 THEN coalesce(hn, 0) / shots_total END, 6) AS leverage_poss_share, (CASE WHEN shots_total >= 10 THEN 0 ELSE 1 END) AS leverage_poss_share_missing FROM j""")
def plan_advanced_features(spark, d):
    li = lines(spark, d)
    f = context.advanced_features(totals(li), totals(li.where("l_returnflag = 'R'")), totals(li.where("l_returnflag <> 'R'")))
    names = [x for x in f.columns if not x.endswith("_missing") and x not in ("season", "athlete_id")]
    return f.select("season", "athlete_id", *[r(x, 6).alias(x) for x in names], "leverage_poss_share_missing")
