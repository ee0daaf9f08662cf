import datetime

import pytest
from pyspark.sql import functions as F

from fastbreak.functions import arrays, clock, rates, text


def one(spark, c, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (text.ascii_fold, "Dončić", "Doncic"),
        (text.ascii_fold, None, None),
        (text.clean_team, "Texas A&M University", "texas a and m"),
        (text.key_upper, "D'Angelo St. X", "DANGELOSTX"),
        (text.key_last_first, "SMITH,JOHN", "JOHNSMITH"),
        (text.key_no_suffix, "Gary Payton II", "gary payton"),
        (text.key_letters, "A-b 1", "ab"),
        (text.key_alnum, "A-b 1", "ab1"),
        (text.last_first_to_first_last, "Smith, John", "John Smith"),
        (text.number, "$1,234.5x", 1234.5),
        (text.number, "none", None),
        (clock.clock_seconds, "12:34", 754.0),
        (clock.clock_seconds, "PT2M5S", 125.0),
        (clock.clock_seconds, "17.5", 17.5),
        (clock.clock_seconds, "bad", 0.0),
        (clock.height_inches, "6-5", 77.0),
        (clock.height_inches, "198", 77.95275590551181),
        (clock.height_inches, "3", None),
        (clock.weight_pounds, "100kg", 220.46226218),
        (clock.weight_pounds, "210 lb", 210.0),
        (clock.weight_pounds, "94", 207.2345264492),
        (clock.weight_pounds, "95", None),
        (clock.weight_pounds, "135", 135.0),
        (clock.mixed_weight_pounds, "129.9", 286.38047857),
        (clock.mixed_weight_pounds, "130", 130.0),
        (clock.mixed_weight_pounds, "49", None),
        (clock.height_inches, "119", None),
        (clock.height_inches, "194 cm", 76.37795275590551),
        (clock.height_inches, "6.5", 78.0),
        (clock.height_inches, '79"', 79.0),
        (clock.clock_seconds, "PT3M", 180.0),
        (clock.clock_seconds, "PT0.5S", 0.5),
        (clock.clock_seconds, "PT", 0.0),
        (clock.clock_seconds, "PT5X", 0.0),
        (clock.clock_seconds, "1:2:3", 0.0),
        (text.header_team, "Time | HOME U | Score | AWAY", "HOME U"),
        (text.header_team, "Time | Score", ""),
        (text.header_team, " TIME |  | score | Away St. ", "Away St."),
        (text.header_team, "Scoreville | time", "Scoreville"),
        (text.header_team, None, ""),
        (clock.year_in_name, "torvik_2019.csv", 2019),
    ],
)
def test_scalar(spark, fn, given, want):
    got = one(spark, fn(F.col("v").cast("string")), v=given)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_substitution_and_score(spark):
    assert tuple(one(spark, text.substitution(F.col("v")), v="J. Smith Enters Game")) == ("J. Smith", "in")
    assert tuple(one(spark, text.substitution(F.col("v")), v="Substitution Out: Jones")) == ("Jones", "out")
    assert tuple(one(spark, text.score(F.col("v")), v="12-34 x")) == (12, 34)
    assert tuple(one(spark, text.score(F.col("v")), v="none")) == (None, None)


def test_lineup_text(spark):
    assert one(spark, text.explicit_lineup(F.col("v")), v="TEAM For Duke: #01 SMITH,JOHN #22 O'NEAL,A. #01 SMITH,JOHN") == ["SMITH,JOHN", "O'NEAL,A."]
    assert one(spark, text.explicit_lineup(F.col("v")), v="SMITH,JOHN Enters Game") == []
    assert tuple(one(spark, text.score(F.col("v")), v="12 - 34")) == (12, 34)
    assert tuple(one(spark, text.score(F.col("v")), v="Lead 3, -7 then 101-\t99 and 1-2")) == (101, 99)
    assert one(spark, text.explicit_lineup(F.col("v")), v="team for away:#5 #7 de la Cruz, J.R. 3#11LEE-ANN, B") == ["DE LA CRUZ, J.R.", "LEE-ANN, B"]
    assert one(spark, text.explicit_lineup(F.col("v")), v="Foul #3 on #4: none") == []


def test_token_set(spark):
    like = lambda a, b: one(spark, text.token_set(F.col("a"), F.col("b")), a=a, b=b)
    assert like("north carolina", "Carolina, North Tar") == 1.0 and like("abc", "xyz") == 0.0 and 0 < like("abc d", "abd e") < 1


def test_similarity(spark):
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="abcd", b="abcd") == 1.0
    assert one(spark, text.token_jaccard(F.col("a"), F.col("b")), a="a b", b="b c") == pytest.approx(1 / 3)
    assert one(spark, text.token_sort(F.col("a")), a="b, A") == "a b"


def test_clock(spark):
    assert one(spark, clock.game_seconds(F.col("p"), F.col("s")), p=2, s=1200) == 1200
    assert one(spark, clock.game_seconds(F.col("p"), F.col("s")), p=3, s=300) == 2400
    gap = lambda a, b: one(spark, clock.interval_seconds(F.lit(a).cast("int"), F.lit(b).cast("int")), v=1)
    assert [gap(30, 1200), gap(900, 880), gap(900, None), gap(None, 5), gap(1500, 100)] == [30, 20, 0, 0, 0]
    ts = datetime.datetime(2024, 1, 15, 12, 30)
    assert one(spark, clock.unix_seconds(F.lit(ts)), v=1) == 1705321800


def test_rates(spark):
    f = lambda x: F.lit(x).cast("double")
    assert one(spark, rates.late_bloom(f(0.6), f(0.55), f(0.03)), v=1) == pytest.approx(1.667, abs=0.1)
    assert one(spark, rates.late_bloom(f(0.6), f(0.55), f(0.001)), v=1) == 0
    assert one(spark, rates.late_bloom(f(None), f(0.55), f(0.03)), v=1) is None
    assert one(spark, rates.clip(f(None), 0, 1), v=1) is None
    assert one(spark, rates.ratio(f(1), f(0)), v=1) is None
    assert one(spark, rates.custom_stat([("+", 2, f(3)), ("*", 1, f(4)), ("/", 1, f(0)), ("-", 1, f(None))]), v=1) == 24
    assert one(spark, rates.points(f(None), f(None), f(None), f(None)), v=1) is None
    assert one(spark, rates.points(f(1), f(None), f(2), f(None)), v=1) == 8
    assert one(spark, rates.shot_distance(f(52.5), f(250)), v=1) == 0
    assert one(spark, rates.leverage_bucket(rates.leverage_index(f(40), f(60))), v=1) == "garbage"
    assert one(spark, rates.leverage_index(f(0), f(20)), v=1) > one(spark, rates.leverage_index(f(15), f(2000)), v=1)
    assert one(spark, rates.shock([(f(3), 1.0), (f(None), 1.0), (f(4), 1.0)]), v=1) == 5


def test_arrays(spark):
    assert one(spark, arrays.element(F.array(F.lit(5)), 2), v=1) is None
    assert one(spark, arrays.lineup_key(F.array(*map(F.lit, ["b", "a"]))), v=1) == "a::b"
    players = arrays.parse_players(F.lit('[{"id":"1","team":"A"},{"id":"2","team":"B"},{"id":"1","team":"A"}]'))
    assert one(spark, arrays.ids_of_team(players, F.lit("A")), v=1) == ["1"]
    assert one(spark, arrays.parse_players(F.lit("bad")), v=1) in ([], [None])
