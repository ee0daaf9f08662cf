"""Exact search for similar texts by the matching-block ratio, without comparing all pairs.

The ratio of two texts of together L characters with M of them matched on each side is 2M / L; U = L - 2M
are unmatched. Two facts bound who can reach a ratio:

* What is matched is a common subsequence, so texts with U of at most 2 are equal after two deletions at
  most between them. Texts that have enough such neighbours need no others: from 7 characters on, each of
  these ratios is above any with U of 3 or more.
* M characters are shared, repeats counted; with a text's characters in order of rarity, two texts that
  reach the ratio share one of the first few. The matched blocks are at most U + 1, so at least M - U - 1
  pairs of adjacent characters are shared too.

The first fact and the rarest characters give candidates, which the counts of shared characters and
pairs thin out before the ratio itself is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fastbreak.functions.text import similarity

#: Lengths of texts whose near neighbours are looked up by deletions; longer ones have too many.
NEAR_LEAST, NEAR_MOST = 7, 32
EPS = 1e-9


def numbered_parts(c: Column, size: int) -> Column:
    """Sorted substrings of `size` characters, each with its number among equal ones; none in shorter texts."""
    last = F.length(c) - (size - 1)
    parts = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))
    # the outer transform binds the parts, which would be built anew for each of them otherwise
    numbered = F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: F.concat(p, (i - F.array_position(ps, p)).cast("string"))))[0]
    return F.when(last >= 1, numbered).otherwise(F.array().cast("array<string>"))


def least_matched(length: Column, least: float) -> Column:
    """Matched characters that a ratio of `least` needs in texts of together `length`."""
    return F.ceil(length * (least / 2) - EPS)


def reaches(la: Column, lb: Column, a: tuple[Column, Column], b: tuple[Column, Column], least: float) -> Column:
    """False only where the ratio of two texts is below `least`, by their lengths and numbered parts of one and two characters."""
    total = la + lb
    need = least_matched(total, least)
    shared = [F.size(F.array_intersect(x, y)) for x, y in zip(a, b, strict=True)]
    return F.when(F.least(la, lb) < need, False).when(shared[0] < need, False).otherwise(shared[1] >= 3 * need - total - 1)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """As `reaches`, from the texts themselves."""
    parts = lambda c: (numbered_parts(c, 1), numbered_parts(c, 2))
    return reaches(F.length(a), F.length(b), parts(a), parts(b), least)


def deletions(name: str, count: int) -> Column:
    """Distinct texts that are left after deleting `count` (0, 1 or 2) characters."""
    c = F.col(name)
    without = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    if count == 0:
        return F.array(c)
    one = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: without(c, i))
    if count == 1:
        return F.array_distinct(one)
    two = F.transform(F.sequence(F.lit(2), F.length(c)), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: without(without(c, j), i)))
    return F.array_distinct(F.flatten(two))


def near_pairs(l: DataFrame, r: DataFrame) -> DataFrame:  # noqa: E741
    """_l, _r: all pairs of texts that are equal after deleting at most two characters between them; `l` has texts of some length only."""
    def keys(df: DataFrame, name: str, counts: tuple[int, ...]) -> DataFrame:
        parts = [df.select(name, F.explode(deletions(name, k)).alias("_key")) for k in counts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    r = r.where(F.length("_r").between(NEAR_LEAST - 2, NEAR_MOST + 2))
    # two deletions on one side matter only where the other side has texts that much shorter
    lengths = {side: [x[0] for x in df.select(F.length(name)).distinct().collect()] for side, df, name in (("l", l, "_l"), ("r", r, "_r"))}
    out = keys(l, "_l", (0, 1)).join(keys(r, "_r", (0, 1)), "_key").select("_l", "_r")
    for df, name, other, other_name, known in ((l, "_l", r, "_r", lengths["r"]), (r, "_r", l, "_l", lengths["l"])):
        longer = df.where((F.length(name) - 2).isin(known)) if known else df.where("false")
        out = out.unionByName(keys(longer, name, (2,)).join(other.withColumn("_key", F.col(other_name)), "_key").select("_l", "_r"))
    return out.distinct()


def by_rare_characters(l: DataFrame, r: DataFrame, least: float) -> DataFrame:  # noqa: E741
    """_l, _r: pairs that share one of their first few characters, rarest first and repeats numbered, as all pairs that reach `least` do."""
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(F.when(F.length(name) == 0, F.array(F.lit(""))).otherwise(numbered_parts(F.col(name), 1))).alias("_t"))

    lp, rp = parts(l, "_l"), parts(r, "_r")
    use = lp.select("_t").unionAll(rp.select("_t")).groupBy("_t").agg(F.count("*").alias("_u"))

    def heads(df: DataFrame, name: str) -> DataFrame:
        ranked = df.join(use, "_t").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_u", "_t"))).alias("_h"))
        few = F.greatest(F.size("_h") - F.ceil(F.size("_h") * (least / (2 - least)) - EPS) + 1, F.lit(1))
        return ranked.select(name, F.explode(F.slice("_h", F.lit(1), few.cast("int"))).alias("_h")).select(name, F.col("_h._t").alias("_t"))

    return heads(lp, "_l").join(heads(rp, "_r"), "_t").select("_l", "_r").distinct()


def thinned(pairs: DataFrame, l: DataFrame, r: DataFrame, least: float) -> DataFrame:  # noqa: E741
    """The pairs that `reaches` does not rule out; the parts of each text are made once."""
    parts = lambda df, c: df.select(c, numbered_parts(F.col(c), 1).alias(f"{c}1"), numbered_parts(F.col(c), 2).alias(f"{c}2"))
    short = pairs.where(F.least(F.length("_l"), F.length("_r")) >= least_matched(F.length("_l") + F.length("_r"), least))
    both = short.join(parts(l, "_l"), "_l").join(parts(r, "_r"), "_r")
    return both.where(reaches(F.length("_l"), F.length("_r"), (F.col("_l1"), F.col("_l2")), (F.col("_r1"), F.col("_r2")), least)).select("_l", "_r")


def candidates(l: DataFrame, r: DataFrame, least: float) -> DataFrame:  # noqa: E741
    """Pairs (_l, _r) of distinct texts among which are all that reach `least`."""
    return thinned(by_rare_characters(l, r, least), l, r, least)


def edit_pairs(l: DataFrame, r: DataFrame, on: list[str], least: float) -> DataFrame:  # noqa: E741
    """(*on, _l, _r): pairs of distinct texts of equal `on` among which are all whose edit distance is at most 1 - `least` of the longer length.

    Texts at an edit distance of d are equal after deleting at most d characters of each. Where that
    allows three edits or more (texts of 3 / (1 - `least`) characters), all texts of near length meet.
    """
    allowed = lambda n: F.floor(n * (1 - least) + EPS)
    l, r = l.select(*on, "_l").distinct(), r.select(*on, "_r").distinct()  # noqa: E741

    def keys(df: DataFrame, name: str) -> DataFrame:
        # the longer text may have up to `least`-th more characters, and so one edit more than this one alone
        most = allowed(F.length(name) / least)
        parts = [df.where(most >= k).select(*on, name, F.explode(F.when(F.length(name) >= k, deletions(name, k)).otherwise(F.array(F.lit("")))).alias("_key")) for k in (0, 1, 2)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    near = keys(l, "_l").join(keys(r, "_r"), [*on, "_key"]).select(*on, "_l", "_r")
    long = lambda df, c: df.where(allowed(F.length(c) / least) >= 3)
    far = long(l, "_l").join(long(r, "_r"), on).where(F.abs(F.length("_l") - F.length("_r")) <= allowed(F.greatest(F.length("_l"), F.length("_r"))))
    return near.unionByName(far.select(*on, "_l", "_r")).distinct()


def close_matches(left: DataFrame, right: DataFrame, left_name: str, right_name: str, n: int = 3, least: float = 0.8) -> DataFrame:
    """Up to n similar names for each name among all names of the right, as difflib.get_close_matches: of equal scores the larger name first.

    Names count once; null names match nothing. Names with n near neighbours are done with those; the
    others are compared with what shares their rare parts.
    """
    if not least > 0:
        raise ValueError("least must be above 0")
    l = left.select(F.col(left_name).alias("_l")).where("_l IS NOT NULL").distinct()  # noqa: E741
    r = right.select(F.col(right_name).alias("_r")).where("_r IS NOT NULL").distinct()
    # the ratio depends on the order of its sides; difflib puts the candidate first
    score = similarity(F.col("_r"), F.col("_l"))
    unmatched = (1 - F.col("score")) * (F.length("_l") + F.length("_r"))
    near = near_pairs(l.where(F.length("_l").between(NEAR_LEAST, NEAR_MOST)), r).withColumn("score", score).where(unmatched < 2.5)
    done = near.groupBy("_l").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("_l")
    rest = candidates(l.join(done, "_l", "left_anti"), r, least).withColumn("score", score)
    scored = near.join(done, "_l", "left_semi").unionByName(rest).where(F.col("score") >= least)
    placed = scored.withColumn("place", F.row_number().over(W.partitionBy("_l").orderBy(F.desc("score"), F.desc("_r")))).where(F.col("place") <= n)
    return placed.select(F.col("_l").alias(left_name), F.col("_r").alias(right_name), "score", "place")
