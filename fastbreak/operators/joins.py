"""Joins beyond the built-in kinds: nearest prior, tiers, one-to-one, blocked similarity, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.functions.text import similarity, token_sort
from fastbreak.operators.similar import close_matches as close_matches
from fastbreak.operators.similar import numbered_parts, reaches


def full_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys coalesced, every other column kept."""
    return left.join(right, on, "full")


def any_wildcard(df: DataFrame, cols: list[str], all_value: str = "ALL") -> DataFrame:
    """Each row once for every choice of own value or ALL per column: a disjunctive join without a nested loop."""
    for c in cols:
        df = df.withColumn(c, F.explode(F.array_distinct(F.array(F.lit(all_value), F.col(c)))))
    return df


def latest_prior(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, most: float, ties: list[Column] = ()) -> DataFrame:
    """For each left row the right row with the same keys that is nearest before it, at most `most` back.

    Left rows without one stay, with nulls. Each key and time of the left is looked up once.
    """
    at = [*on, left_at]
    near = left.select(*at).distinct().join(right, on).where((F.col(left_at) - F.col(right_at)).between(0, most))
    first = W.partitionBy(*at).orderBy(F.desc(right_at), *ties)
    return left.join(near.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), at, "left")


def shifted(left: DataFrame, right: DataFrame, on: list[str], season: str, shifts: list[int], keep: list[Column] = ()) -> DataFrame:
    """Join the right side's season moved by each shift; the first shift in the list that matches wins."""
    moved = right.withColumn("_shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn(season, F.col(season) + F.col("_shift"))
    order = F.array_position(F.array(*[F.lit(s) for s in shifts]), F.col("_shift"))
    best = moved.withColumn("_n", F.row_number().over(W.partitionBy(*on, season).orderBy(order, *keep))).where("_n = 1").drop("_n")
    return left.join(best, [*on, season], "left").withColumnRenamed("_shift", "shift")


def coverage(expected: DataFrame, present: DataFrame, on: list[str], flag: str = "covered") -> DataFrame:
    """Expected keys with 0/1."""
    return expected.select(*on).distinct().join(present.select(*on).distinct().withColumn(flag, F.lit(1)), on, "left").fillna({flag: 0})


def presence(expected: DataFrame, sources: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Expected keys with one boolean per source."""
    out = expected.select(*on).distinct()
    for name, df in sources.items():
        out = out.join(df.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").fillna({name: False})
    return out


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the right, null keys included; unlike SQL's NOT IN a null on the right rejects nothing."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def not_in_sql(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """As SQL's NOT IN: a null on the right rejects every row, a null key is rejected unless the right is empty."""
    n, nulls = right.agg(F.count("*")).scalar(), right.agg(F.count_if(F.col(key).isNull())).scalar()
    rest = left.join(right.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rest.where((n == 0) | ((nulls == 0) & F.col(key).isNotNull())).select(*left.columns)


def by_either_id(dim: DataFrame, ids: list[str], name: str) -> DataFrame:
    """The dimension once under each of its ids, as text in `name`; an id that repeats an earlier one of its row adds nothing."""
    each = F.array_distinct(F.array_compact(F.array(*[F.col(i).cast("string") for i in ids])))
    return dim.withColumn(name, F.explode(each))


def many_to_many(left: DataFrame, right: DataFrame, on: list[str], rows: int = 3000) -> DataFrame:
    """Inner join on keys that many rows of both sides share, whose pairs many tasks make although the sides are small.

    The right rows of a key are dealt into parts of about `rows` by their content; a left row goes to every part of its key.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    n = right.groupBy(*on).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    dealt = right.join(n, on).withColumn("_part", F.pmod(F.xxhash64(*right.columns), "_parts")).drop("_parts")
    asked = left.join(n, on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    at = [*on, "_part"]
    return asked.repartition(tasks, *at).join(dealt.repartition(tasks, *at), at).drop("_part")


def id_then_name(left: DataFrame, right: DataFrame, key: str, id_: str, name: str, left_year: str, right_year: str, value: str, most: int = 2) -> DataFrame:
    """(key, value, method): the right row with the same id, else of those with the same name the nearest in years, at most `most` away.

    Ids match as numbers. Ties go to the smaller value; rows that nothing matches are left out.
    """
    number = lambda c: F.col(c).try_cast("double")
    r = right.select(number(id_).alias("_id"), F.col(name).alias("_name"), number(right_year).alias("_year"), F.col(value).alias("_v"))
    l = left.select(key, number(id_).alias("_id"), F.col(name).alias("_name"), number(left_year).alias("_at"))  # noqa: E741
    exact = l.join(r.groupBy("_id").agg(F.min("_v").alias("_v")), "_id").groupBy(key).agg(F.min("_v").alias(value)).withColumn("method", F.lit("id"))
    rest = l.join(exact.select(key), key, "left_anti")
    # each name and year is looked up once, however many rows have it
    years = rest.select("_name", "_at").distinct().join(r.groupBy("_name", "_year").agg(F.min("_v").alias("_v")), "_name").withColumn("_gap", F.abs(F.col("_at") - F.col("_year")))
    near = years.where(F.col("_gap") <= most).groupBy("_name", "_at").agg(F.min(F.struct("_gap", "_v")).alias("_near"))
    named = rest.join(near, ["_name", "_at"]).groupBy(key).agg(F.min("_near")["_v"].alias(value)).withColumn("method", F.lit("name_year"))
    return exact.unionByName(named)


def by_id_or_name(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str) -> DataFrame:
    """Pairs with equal ids where both sides have one, else with equal lower-case names."""
    lower = lambda c: F.lower(F.trim(F.col(c)))
    keyed = lambda a, b: many_to_many(left.withColumn("_k", a), right.withColumn("_k", b), ["_k"]).drop("_k")
    ids = keyed(F.col(left_id).cast("string"), F.col(right_id).cast("string"))
    names = keyed(lower(left_name), lower(right_name)).where(F.col(left_id).isNull() | F.col(right_id).isNull())
    return ids.unionByName(names)


def merge_tiers(target: DataFrame, incoming: DataFrame, key: str, seq: str, tiers: list[list[str]]) -> DataFrame:
    """Upsert by the first tier of columns under which an incoming row meets a target row (the one with the smallest key).

    Values of incoming rows replace the target's where they are not null, later ones (by seq) over
    earlier ones; rows that meet nothing are appended with a null key. All tiers look at the target as it was.
    """
    rest, hits = incoming, []
    for on in tiers:
        found = rest.select(seq, *on).join(target.select(key, *on), on).groupBy(seq).agg(F.min(key).alias(key))
        hits.append(found)
        rest = rest.join(found.select(seq), seq, "left_anti")
    met = hits[0]
    for h in hits[1:]:
        met = met.unionByName(h)
    shared = [c for c in target.columns if c in incoming.columns and c not in (key, seq)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_n_{c}") for c in shared]
    new = met.join(incoming, seq).groupBy(key).agg(*last)
    kept = target.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in shared}).select(*target.columns)
    return kept.unionByName(rest.select(*shared), allowMissingColumns=True)


def games_by_score(left: DataFrame, right: DataFrame, least_tied: float = 0.80, least: float = 0.85) -> DataFrame:
    """Games of a date by their score: the only one, or of several the likest teams; without one the likest teams of the date.

    left: l_id, date, l_home, l_away, l_hp, l_ap; right: r_id, date, r_home, r_away, r_hp, r_ap. Likeness is
    of sorted tokens, sides direct or swapped, ties to the smaller r_id.
    """
    like = lambda a, b: similarity(token_sort(F.col(a)), token_sort(F.col(b)))
    at, mine, theirs = ["date", "_hp", "_ap"], ["l_home", "l_away"], ["r_home", "r_away"]
    left, right = (df.withColumnsRenamed({f"{s}_hp": "_hp", f"{s}_ap": "_ap"}) for s, df in (("l", left), ("r", right)))
    # games do not meet row by row: those of one score are counted, those of one pair of names compared once
    same = right.groupBy(*at).agg(F.count("*").alias("_c"), F.min("r_id").alias("r_id"))
    both = left.join(same, at, "left").withColumn("_n", F.sum(F.coalesce("_c", F.lit(0))).over(W.partitionBy("l_id")))
    alone = both.where("_n = 1 AND _c = 1").select("l_id", "r_id", F.lit(1.0).alias("confidence"), F.lit("score_exact").alias("method"))
    score = F.greatest(like("l_home", "r_home") + like("l_away", "r_away"), like("l_home", "r_away") + like("l_away", "r_home")) / 2

    def likest(rest: DataFrame, on: list[str], above: float, confidence: Column, method: str) -> DataFrame:
        names = right.groupBy(*on, *theirs).agg(F.min("r_id").alias("r_id"))
        # pairs with a null name have no score and are left out by the joins
        pairs = rest.select(*on, *mine).distinct().join(names, on)
        scored = pairs.select(*mine, *theirs).distinct().withColumn("score", score).where(F.col("score") > above)
        first = W.partitionBy(*on, *mine).orderBy(F.desc("score"), "r_id")
        top = pairs.join(scored, [*mine, *theirs]).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*on, *mine, "r_id", "score")
        found = rest.join(top, [*on, *mine])
        found = found.withColumn("_r", F.row_number().over(W.partitionBy("l_id").orderBy(F.desc("score"), "r_id"))).where("_r = 1")
        return found.select("l_id", "r_id", confidence.alias("confidence"), F.lit(method).alias("method"))

    rest = both.drop("r_id")
    tied = likest(rest.where("_n > 1 AND _c > 0"), at, least_tied, F.lit(0.95), "score_teams")
    return alone.unionByName(tied).unionByName(likest(rest.where("_n = 0"), ["date"], least, F.col("score"), "teams"))


def missing_flags(a: DataFrame, b: DataFrame, on: list[str], names: tuple[str, str]) -> DataFrame:
    """Keys of either list with a flag for each."""
    one, two = (d.select(*on).distinct().withColumn(n, F.lit(True)) for d, n in zip((a, b), names, strict=True))
    return one.join(two, on, "full").fillna({n: False for n in names})


def covered_by(expected: DataFrame, sources: dict[str, DataFrame], on: list[str], void: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, covered) and a row `any`: expected keys each source holds, without the keys it is void for."""
    want, rows = expected.select(*on).distinct(), []
    for name, df in sources.items():
        own = df.select(*on)
        if void and name in void:
            own = own.join(void[name].select(*on).distinct(), on, "left_anti")
        rows.append(want.join(own.distinct(), on, "left_semi").withColumn("source", F.lit(name)))
    held = rows[0]
    for r in rows[1:]:
        held = held.unionByName(r)
    each = held.groupBy("source").agg(F.count("*").alias("covered"))
    return each.unionByName(held.select(*on).distinct().agg(F.count("*").alias("covered")).select(F.lit("any").alias("source"), "covered"))


def unique_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*on))).where("_n = 1").drop("_n")


def one_to_one(pairs: DataFrame, left_key: str, right_key: str, order: list[Column]) -> DataFrame:
    """Best row of each left key, then best of those for each right key; greedy, not optimal."""
    for key in (left_key, right_key):
        pairs = pairs.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return pairs


def tiered(left: DataFrame, key: str, tiers: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Resolve left rows tier by tier: each tier (name, table, join columns) gives `value`.

    A tier with two different values for one row marks it ambiguous; what no tier resolves is
    unresolved. One row per left key; a key that the left repeats raises an error when it is read.
    """
    once = F.count("*").over(W.partitionBy(key))
    left = left.withColumn("_n", once).where(F.assert_true(F.col("_n") == 1, F.lit("left repeats a key")).isNull()).drop("_n")
    rest, done = left, []
    for name, df, on in tiers:
        # the values of the same columns are counted once, so a left row meets one row
        found = rest.select(key, *on).join(df.groupBy(*on).agg(F.count_distinct(value).alias("_k"), F.min(value).alias(value)), on)
        tier = found.select(key, F.when(F.col("_k") == 1, F.col(value)).alias(value), F.when(F.col("_k") == 1, name).otherwise("ambiguous").alias("tier"))
        done.append(tier)
        rest = rest.join(tier.select(key), key, "left_anti")
    done.append(rest.select(key, F.lit(None).cast(done[0].schema[value].dataType).alias(value), F.lit("unresolved").alias("tier")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fuzzy(left: DataFrame, right: DataFrame, block: list[str], left_text: str, right_text: str, least: float, left_key: str, right_key: str, penalty: Column | None = None) -> DataFrame:
    """Best right row for each left row inside the same block by similarity, at least `least`; equal texts are 1 without a comparison.

    Without a penalty, pairs that cannot reach `least` by their lengths and shared characters are not compared.
    """
    equal = F.col(left_text) == F.col(right_text)
    like = F.when(equal, F.lit(1.0)).otherwise(similarity(F.col(left_text), F.col(right_text)))
    if penalty is None and least >= 1:
        # only equal texts have the ratio 1
        both = left.join(right.withColumn(left_text, F.col(right_text)), [*block, left_text]).withColumn("score", F.lit(1.0))
    elif penalty is None:
        # the characters of a text are sorted once, not for each pair
        made = lambda df, c: df.withColumns({f"_{c}1": numbered_parts(F.col(c), 1), f"_{c}2": numbered_parts(F.col(c), 2)})
        a, b = ((F.col(f"_{c}1"), F.col(f"_{c}2")) for c in (left_text, right_text))
        pairs = made(left, left_text).join(made(right, right_text), block).where(equal | reaches(F.length(left_text), F.length(right_text), a, b, least))
        both = pairs.drop(*(f"_{c}{i}" for c in (left_text, right_text) for i in (1, 2))).withColumn("score", like)
    else:
        both = left.join(right, block).withColumn("score", like - penalty)
    best = W.partitionBy(left_key).orderBy(F.desc("score"), right_key)
    return both.where(F.col("score") >= least).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def fuzzy_by_date(left: DataFrame, right: DataFrame, least: float = 0.70, day_penalty: float = 0.03) -> DataFrame:
    """Games matched by date and team names, sides direct or swapped; a day off only where the date has no game at all, however unlike.

    left: l_id, date, l_home, l_away; right: r_id, date, r_home, r_away.
    """
    days = right.withColumn("_off", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("date", F.date_add("date", F.col("_off")))
    both = left.join(days, "date")
    direct = (similarity(F.col("l_home"), F.col("r_home")) + similarity(F.col("l_away"), F.col("r_away"))) / 2
    swapped = (similarity(F.col("l_home"), F.col("r_away")) + similarity(F.col("l_away"), F.col("r_home"))) / 2
    scored = both.withColumn("_direct", direct).withColumn("_swapped", swapped)
    scored = scored.withColumn("score", F.greatest("_direct", "_swapped") - F.abs("_off") * day_penalty).withColumn("swapped", F.col("_swapped") > F.col("_direct"))
    same_day = F.max((F.col("_off") == 0).cast("int")).over(W.partitionBy("l_id"))
    allowed = scored.withColumn("_same", same_day).where(((F.col("_off") == 0) | (F.col("_same") == 0)) & (F.col("score") >= least))
    best = one_to_one(allowed, "l_id", "r_id", [F.desc("score"), F.col("l_id"), F.col("r_id")])
    return best.select("l_id", "r_id", "score", "swapped", F.col("_off").alias("day_offset"))


def prefer(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """All of the first, and of the second what the first lacks."""
    return first.unionByName(second.join(first.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)


def override(base: DataFrame, rescued: DataFrame, on: list[str]) -> DataFrame:
    """Fill nulls of base from rescued, for all columns they share."""
    shared = [c for c in base.columns if c in rescued.columns and c not in on]
    other = rescued.select(*on, *[F.col(c).alias(f"_r_{c}") for c in shared])
    return base.join(other, on, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).select(*base.columns)


def override_tagged(base: DataFrame, rescued: DataFrame, on: list[str], first: str = "base", second: str = "rescued") -> DataFrame:
    """As `override`, with <column>_source of each shared column: which table its value is from, or missing.

    The rescuing table must have each key once; one that repeats a key raises an error when it is read.
    """
    shared = [c for c in base.columns if c in rescued.columns and c not in on]
    once = F.count("*").over(W.partitionBy(*on))
    other = rescued.withColumn("_n", once).where(F.assert_true(F.col("_n") == 1, F.lit("rescued repeats a key")).isNull())
    both = base.join(other.select(*on, *[F.col(c).alias(f"_r_{c}") for c in shared]), on, "left")
    source = lambda c: F.when(F.col(c).isNotNull(), first).when(F.col(f"_r_{c}").isNotNull(), second).otherwise("missing")
    both = both.withColumns({f"{c}_source": source(c) for c in shared})
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).select(*base.columns, *[f"{c}_source" for c in shared])


def coalesce_suffixes(df: DataFrame, left: str = "_x", right: str = "_y") -> DataFrame:
    """Each pair of columns <name><left>, <name><right> that a merge left as one <name>, the right side's value first."""
    names = [c.removesuffix(left) for c in df.columns if c.endswith(left) and c.removesuffix(left) + right in df.columns]
    made = [F.coalesce(F.col(f"`{n}{right}`"), F.col(f"`{n}{left}`")).alias(n) for n in names]
    paired = {n + s for n in names for s in (left, right)}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in paired and c not in names], *made)


def suffix_match(left: DataFrame, right: DataFrame, on: list[str], left_name: str, right_name: str) -> DataFrame:
    """Right names that end in a longer form of the left name; only unique hits."""
    # joined on each shorter ending; a hit is unique where both sides have its name or ending once
    ends = F.transform(F.sequence(F.lit(2), F.length(right_name) + 1), lambda i: F.substring(F.col(right_name), i, F.length(right_name)))
    longer = right.where(F.length(right_name) > 0).withColumn(left_name, F.explode(ends))
    known = left.select(*on, left_name).distinct()
    once = unique_keys(longer.join(known, [*on, left_name], "left_semi"), [*on, left_name])
    return unique_keys(left, [*on, left_name]).join(once, [*on, left_name])


def latest_value(df: DataFrame, name: str, at: str, value: str, known: DataFrame | None = None, year: str | None = None, last_year: int | None = None) -> DataFrame:
    """Every row gets the value of its name's latest record.

    With `known`, names that are not in it lose the value; with `year`, rows after `last_year` do.
    """
    out = df.drop(value).join(df.groupBy(name).agg(F.max_by(value, at).alias(value)), name, "left")
    if known is not None:
        out = out.join(known.select(name).distinct().withColumn("_known", F.lit(True)), name, "left").withColumn(value, F.when(F.col("_known"), F.col(value))).drop("_known")
    return out.withColumn(value, F.when(F.col(year) <= last_year, F.col(value))) if year else out


def lost_share(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Share of old keys that are gone: one row."""
    flagged = coverage(old, new, on)
    return flagged.agg(F.avg(1 - F.col("covered")).alias("lost_share"))
