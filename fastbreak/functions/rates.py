"""Basketball arithmetic as expressions; zero denominators give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def keep_between(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), c)


def shot_distance(x: Column, y: Column) -> Column:
    """Feet to the nearer hoop; x and y in tenths of a foot."""
    hoop = F.when(x < 470, 5.25).otherwise(88.75)
    return F.sqrt(F.pow(x / 10 - hoop, 2) + F.pow(y / 10 - 25, 2))


def is_corner_three(x: Column, y: Column) -> Column:
    """Within 14 feet of a baseline and 3 of a sideline."""
    along = F.least(x / 10, 94 - x / 10)
    return (along <= 14) & ((y / 10 <= 3) | (y / 10 >= 47))


def zone(x: Column, y: Column) -> Column:
    d = shot_distance(x, y)
    return F.when(d.isNull(), None).when(d < 4, "restricted").when(d < 8, "paint").when(is_corner_three(x, y), "corner3").when(d < 22.15, "mid").when(d > 27, "deep3").otherwise("above3")


def shot_family(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("dunk"), "dunk").when(t.contains("layup"), "layup").when(t.contains("tip"), "tip").when(t.contains("hook"), "hook").when(t.contains("three") | t.contains("3pt"), "three").when(t.contains("jumper"), "jumper").otherwise("other")


def win_probability(margin: Column, seconds_left: Column) -> Column:
    """Logistic in margin over the root of the time left."""
    return 1 / (1 + F.exp(-margin / (0.45 * F.sqrt(F.greatest(seconds_left, F.lit(0)) / 60.0 + 0.25) * 4)))


#: Points of a possession and their shares.
OUTCOMES = {0: 0.51, 1: 0.09, 2: 0.28, 3: 0.11, 4: 0.01}


def leverage_index(margin: Column, seconds_left: Column, step: float = 18.0) -> Column:
    """Root mean squared change of win probability over one possession, on a scale to 1."""
    now, after = win_probability(margin, seconds_left), F.greatest(seconds_left - step, F.lit(0.0))
    total = sum((f * F.pow(win_probability(margin + p, after) - now, 2) for p, f in OUTCOMES.items()), F.lit(0.0))
    return F.least(F.sqrt(total) / 0.5, F.lit(1.0))


def leverage_bucket(li: Column) -> Column:
    return F.when(li < 0.05, "garbage").when(li < 0.10, "low").when(li < 0.20, "medium").when(li < 0.35, "high").otherwise("very_high")


def is_high_leverage(period: Column, seconds: Column, margin: Column) -> Column:
    return (period >= 2) & (seconds < 300) & (F.abs(margin) <= 5)


def is_garbage(margin: Column) -> Column:
    return F.abs(margin) > 20


def rubber_band(margin: Column, minutes: Column) -> Column:
    return -0.02 * margin * minutes


def shrink(made: Column, tried: Column, a: float = 2, b: float = 2) -> Column:
    return (made + a) / (tried + a + b)


def logit(p: Column, eps: float = 0.01) -> Column:
    q = clip(F.when(p > 1, p / 100).otherwise(p), eps, 1 - eps)
    return F.log(q / (1 - q))


def exposure_weight(minutes: Column, full: float = 2000) -> Column:
    return F.least(F.lit(1.0), minutes / full)


def exposure_variance(minutes: Column, eps: float = 1.0) -> Column:
    return 1 / (minutes + eps)


def reliability_seconds(seconds: Column) -> Column:
    return F.least(F.lit(1.0), seconds / 3000.0)


def reliability_possessions(poss: Column) -> Column:
    return poss / (poss + 300.0)


def precision_possessions(poss: Column) -> Column:
    sd = 1.75 / F.sqrt(poss / 100.0)
    return F.when(poss > 0, clip(1 / (sd * sd), 0.05, 10))


def points(rim: Column, mid: Column, three: Column, ft: Column) -> Column:
    """Null only if all are."""
    made = [(rim, 2), (mid, 2), (three, 3), (ft, 1)]
    total = sum((F.coalesce(c, F.lit(0)) * v for c, v in made), F.lit(0))
    return F.when(F.coalesce(*(c for c, _ in made)).isNotNull(), total)


def true_shooting(pts: Column, fga: Column, fta: Column) -> Column:
    return ratio(pts, 2 * (fga + 0.44 * fta))


def usage(poss: Column, minutes: Column, pace: Column, team_share: Column) -> Column:
    own = F.when((minutes > 0) & (pace > 0) & (minutes / 40 * pace > 5), poss / (minutes / 40 * pace))
    return clip(F.coalesce(own, team_share), 0.0, 0.6)


def per_100(x: Column, poss: Column) -> Column:
    return ratio(100.0 * x, poss)


def per_40(x: Column, minutes: Column, poss: Column | None = None) -> Column:
    """Per 40 minutes; without minutes per 100 possessions times 0.40."""
    own = ratio(40.0 * x, minutes)
    return own if poss is None else F.coalesce(own, 0.40 * per_100(x, poss))


def shock(deltas: list[tuple[Column, float]]) -> Column:
    """Root of the summed squares of scaled changes; nulls are skipped, all null is null."""
    total = sum((F.coalesce(F.pow(c / s, 2), F.lit(0.0)) for c, s in deltas), F.lit(0.0))
    return F.when(F.coalesce(*(c for c, _ in deltas)).isNotNull(), F.sqrt(total))


def late_bloom(final: Column, mean: Column, std: Column) -> Column:
    return F.when(F.coalesce(final, mean, std).isNull() | final.isNull() | mean.isNull() | std.isNull(), None).when(std < 0.01, 0.0).otherwise((final - mean) / std)


def color_scale(z: Column, lower_is_better: bool = False, limit: float = 2.5) -> Column:
    """z as 0..1, clamped."""
    v = clip(-z if lower_is_better else z, -limit, limit)
    return (v + limit) / (2 * limit)


def custom_stat(terms: list[tuple[str, float, Column]]) -> Column:
    """Left-to-right fold of coefficient * stat with + - * /; null is 0, dividing by 0 divides by 1."""
    out = F.lit(0.0)
    for i, (op, k, c) in enumerate(terms):
        v = k * F.coalesce(c.cast("double"), F.lit(0.0))
        if i == 0 or op == "+":
            out = v if i == 0 else out + v
        elif op == "-":
            out = out - v
        elif op == "*":
            out = out * v
        elif op == "/":
            out = out / F.when(v == 0, 1.0).otherwise(v)
        else:
            raise ValueError(f"unknown operator {op!r}")
    return out


def recency_weight(rank: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.2), 1 - (total - rank) * 0.2)


def half_life_weight(age: Column, half_life: float) -> Column:
    return clip(F.pow(F.lit(2.0), -age / half_life), 0.0, 1.0)


def clean_id(c: Column) -> Column:
    """Whole number of a text or float, else -1."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(-1).cast("bigint"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
