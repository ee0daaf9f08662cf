import random

from fastbreak.plans.lineups import fill_shares, windowed_lineups, with_periods


def by_hand(rows, window, size=5):
    """rows of one team in order: (seq, t, player, direction, lineup); counts anew for every row and player."""
    acts = [(p, r[1]) for r in rows for p in ([r[2]] if r[2] else []) + sorted(set(r[4] or []))]
    names = sorted({p for p, _ in acts})
    total = {p: sum(q == p for q, _ in acts) for p in names}
    said = [k for k, r in enumerate(rows) if r[4]]
    if said:
        floor = list(rows[said[0]][4])
        for r in reversed(rows[: said[0]]):
            if r[2] and r[3] == "in":
                floor = [x for x in floor if x != r[2]]
            elif r[2] and r[3] == "out":
                floor = [*floor, r[2]]
    else:
        floor = sorted(names, key=lambda p: (-total[p], p))[:size]
    out, floor = [], set(floor)
    for seq, t, p, d, _ in rows:
        recent = {x: total[x] if t < window else sum(q == x and t - window <= s <= t for q, s in acts) for x in names}
        order = sorted(names, key=lambda x: (-recent[x], x))
        while len(floor) > size:
            last = max(floor, key=lambda x: (x not in recent, -recent.get(x, 0), x))
            floor = floor - {last}
        for x in order:
            if len(floor) < size:
                floor = floor | {x}
        out.append((seq, sorted(floor)))
        floor = floor | {p} if p and d == "in" else floor - {p} if p and d == "out" else floor
    return out


def test_windowed_lineups_against_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for game in range(12):
        for team in "AB":
            names = [f"{team}{k}" for k in range(rng.randrange(3, 10))]
            t, own = 0, []
            for seq in range(60):
                t += rng.choice([0, 0, 5, 30, 90])  # many rows of one second
                p = rng.choice([*names, None])
                lineup = rng.sample(names, min(5, len(names))) if game % 3 == 0 and rng.random() < 0.08 else None
                own.append((seq, t, p, rng.choice(["in", "out", None, None]) if p else None, lineup))
            rows += [(f"g{game}", seq, team, t, p, d, lineup) for seq, t, p, d, lineup in own]
            want[f"g{game}", team] = by_hand(own, 600)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "gameId string, seq int, team string, t int, player string, direction string, lineup array<string>")
    found = windowed_lineups(df)
    got = {}
    for r in found.collect():
        got.setdefault((r["gameId"], r["team"]), []).append((r["seq"], r["onfloor"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    shares = {r["gameId"]: r for r in fill_shares(found).collect()}
    assert len(shares) == 12 and all(0 <= r["mended"] <= 1 for r in shares.values())
    assert windowed_lineups(df.where("false")).count() == 0


def test_periods_begin_where_the_clock_goes_up(spark):
    clocks = [1200, 600, None, 0, 1200, 30, 1190, 1190]
    df = spark.createDataFrame([("g", k, c) for k, c in enumerate(clocks)], "gameId string, seq int, clock int")
    got = [(r["period"], r["t"]) for r in with_periods(df).orderBy("seq").collect()]
    assert got == [(1, 0), (1, 600), (1, 600), (1, 1200), (2, 1200), (2, 2370), (3, 2410), (3, 2410)]
