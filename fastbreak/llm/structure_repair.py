r"""Repair of conversation structure at least cost, as edits of turns.

A conversation should have the role initials (s?(ua)+)?, no blank turns, no repeated turns and no
text that breaks off. Keep costs 0, Rerole (to user or assistant) 3, Delete 4 and Insert (an empty
turn of user or assistant, anywhere) 3; a kept or reroled turn that breaks off adds 3; blank and
repeated turns must be deleted. Positions between turns times the four states of the roles' automaton
(nothing yet, after s, after u, after a) are the nodes of a graph, edits its arcs.

Minimum costs from the start and to the end tell which arcs are tight, that is on some cheapest path:
cost to the arc's tail + its cost + cost from its head = total. From the start the frontier of nodes
reached by the letters so far takes the least letter of all tight arcs at each step, which gives the
ASCII-least of the cheapest audits.

Scale: a conversation is cut in blocks of BLOCK turns. A block's costs between states are a 4 x 4
matrix; a conversation's matrices (one in BLOCK turns) give the costs at its block borders, with which
each block finds its tight arcs by itself, for each state it may be entered in. So no task holds the
turns of a long conversation, and texts are not touched before the edits are known.

Defined cases: null ids, turns, roles and texts read as one space (so a null id is a conversation of
its own and a null text is blank); rows of equal turn are taken by role, then text; equal rows are
carried once with their number; a conversation without rows has an empty audit; other columns are
left out. Roles are read by their first character only, case as it is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fastbreak.llm.common import materialize, scratch
from fastbreak.llm.turns import crc_sql, digests, numbered

BLOCK = 4096
FAR = 1 << 60

#: Characters that are no content, and those that end a whole text.
BLANK, ENDS = " \t\n\x0b\x0c\r", [".", "!", "?"]

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The role initial that each state may take by Rerole or Insert leads to:
ONWARD = (2, 2, 3, 2)
#: kind of a role initial (0 s, 1 u, 2 a, 3 other) -> states it may follow, and the state it leads to.
MOVES = {0: ((0,), 1), 1: ((0, 1, 3), 2), 2: ((2,), 3), 3: ((), 0)}
ACCEPTED = (0, 3)
#: Cheapest inserts that end a conversation in each state.
AT_END = tuple(0 if s in ACCEPTED else INSERT * (1 if s == 2 else 2) for s in range(4))
#: kind * 4 + next kind of the neighbours su, ua and au.
LEGAL = (1, 6, 9)


def arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """For a turn's code (kind * 3 + 0 whole, 1 broken off, 2 to delete): per state the letters, costs and next states, in order of the letters."""
    kind, fault = divmod(code, 3)
    after, to = MOVES[kind]
    out = []
    for s in range(4):
        own = [("D", DELETE, s)]
        if fault != 2:
            more = CUT_OFF * fault
            if s in after:
                own.append(("K", KEEP + more, to))
            own.append(("R", REROLE + more, ONWARD[s]))
        out.append(own)
    return out


ARCS = [arcs(code) for code in range(12)]


def inserted(costs: list[int]) -> list[int]:
    """Costs of the states after any inserts at a place."""
    costs = list(costs)
    for s in (0, 1, 3, 2):  # a cheapest run of inserts leads over at most two arcs
        costs[ONWARD[s]] = min(costs[ONWARD[s]], costs[s] + INSERT)
    return costs


def forward(costs: list[int], code: int, extra: int) -> list[int]:
    """Costs of the states after inserts, a turn and `extra` deletions of its copies."""
    out = [FAR] * 4
    for s, c in enumerate(inserted(costs)):
        for _, w, to in ARCS[code][s]:
            out[to] = min(out[to], c + w)
    return [c + DELETE * extra for c in out]


def backward(costs: list[int], code: int, extra: int) -> list[int]:
    """Costs to the end before a turn, of which `costs` are those after it and its copies."""
    out = [min(w + costs[to] for _, w, to in ARCS[code][s]) + DELETE * extra for s in range(4)]
    for s in (2, 0, 1, 3):
        out[s] = min(out[s], out[ONWARD[s]] + INSERT)
    return out


def block_matrix(codes, extras) -> list[int]:
    """Sixteen costs: from each state at the first turn (inserts included) to each state after the last."""
    out = []
    for s in range(4):
        costs = [0 if t == s else FAR for t in range(4)]
        for code, extra in zip(codes, extras, strict=True):
            costs = forward(costs, code, extra)
        out += [min(c, FAR) for c in costs]
    return out


def chain(matrices: list) -> tuple[int, list[list[int]], list[list[int]]]:
    """Total, and per block the costs from the start at its first turn and to the end after its last."""
    costs, at_start = [0, FAR, FAR, FAR], []
    for m in matrices:
        at_start.append(costs)
        costs = [min(FAR, *(costs[s] + m[4 * s + t] for s in range(4))) for t in range(4)]
    total = min(c + e for c, e in zip(costs, AT_END, strict=True))
    costs, at_end = list(AT_END), []
    for m in reversed(matrices):
        at_end.append(costs)
        costs = [min(FAR, *(m[4 * s + t] + costs[t] for t in range(4))) for s in range(4)]
    return total, at_start, at_end[::-1]


def tight_letters(codes, extras, at_start, at_end, total: int) -> list[tuple[int, int, list[str], list[str], str]]:
    """For each state in which a cheapest path may enter the block: that state, the one it leaves in, per turn the letters and states after them, and all letters."""
    ahead = [list(at_start)]
    for code, extra in zip(codes, extras, strict=True):
        ahead.append(forward(ahead[-1], code, extra))
    behind = [list(at_end)]
    for code, extra in zip(reversed(codes), reversed(extras), strict=True):
        behind.append(backward(behind[-1], code, extra))
    behind.reverse()
    out = []
    for entry in range(4):
        if ahead[0][entry] + behind[0][entry] != total:
            continue
        frontier, letters, states = {entry: ahead[0][entry]}, [], []
        for i, (code, extra) in enumerate(zip(codes, extras, strict=True)):
            took, left = "", ""
            while True:
                found: dict[str, dict[int, int]] = {}
                for s, cost in frontier.items():
                    for letter, w, to in ARCS[code][s]:
                        if cost + w + DELETE * extra + behind[i + 1][to] == total:
                            found.setdefault(letter, {})[to] = cost + w + DELETE * extra
                    if cost + INSERT + behind[i][ONWARD[s]] == total:
                        found.setdefault("I", {})[ONWARD[s]] = cost + INSERT
                least = min(found)
                frontier = found[least]
                took, left = took + least, left + str(min(frontier))
                if least != "I":
                    break
            letters.append(took)
            states.append(left)
        out.append((entry, min(frontier), letters, states, "".join(x + "D" * extra for x, extra in zip(letters, extras, strict=True))))
    return out


COSTS = ArrayType(LongType())
CHAIN = StructType([StructField("total", LongType()), StructField("at_start", ArrayType(COSTS)), StructField("at_end", ArrayType(COSTS))])
LETTERS = StructType([StructField("entry", IntegerType()), StructField("leave", IntegerType()), StructField("letters", ArrayType(StringType())), StructField("states", ArrayType(StringType())), StructField("audit", StringType())])
ENTERED = StructType([StructField("entries", ArrayType(IntegerType())), StructField("last", IntegerType())])


def dicts(rows: list, kind: StructType) -> list[dict]:
    return [dict(zip(kind.names, x, strict=True)) for x in rows]


@F.arrow_udf(COSTS)
def matrix_of(codes: pa.Array, extras: pa.Array) -> pa.Array:
    return pa.array([block_matrix(c, x) for c, x in zip(codes.to_pylist(), extras.to_pylist(), strict=True)], to_arrow_type(COSTS))


@F.arrow_udf(CHAIN)
def chained(matrices: pa.Array) -> pa.Array:
    return pa.array(dicts([chain(ms) for ms in matrices.to_pylist()], CHAIN), to_arrow_type(CHAIN))


@F.arrow_udf(ArrayType(LETTERS))
def letters_of(codes: pa.Array, extras: pa.Array, at_start: pa.Array, at_end: pa.Array, total: pa.Array) -> pa.Array:
    args = zip(*(x.to_pylist() for x in (codes, extras, at_start, at_end, total)), strict=True)
    return pa.array([dicts(tight_letters(*x), LETTERS) for x in args], to_arrow_type(ArrayType(LETTERS)))


@F.arrow_udf(ENTERED)
def entered(ways: pa.Array) -> pa.Array:
    """From the (entry, leave) pairs of each block, the state in which each is entered and the last one left."""
    out = []
    for blocks in ways.to_pylist():
        state, own = 0, []
        for pairs in blocks:
            own.append(state)
            state = next(p["leave"] for p in pairs if p["entry"] == state)
        out.append((own, state))
    return pa.array(dicts(out, ENTERED), to_arrow_type(ENTERED))


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and n (copies) of the rows that a fixed rule on conversation and turn leaves, some of them changed."""
    text = F.coalesce("text", F.lit(" "))
    rule = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    return conversations.select(
        conv_key().alias("conv"),
        "turn",
        F.when(rule == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(rule == 1, "").when(rule == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(rule == 3, 2).otherwise(1).alias("n"),
        rule.alias("rule"),
    ).where("rule <> 0").drop("rule")


def conv_key():
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, n copies), equal ones merged, with pos, fault (of the first copy) and code."""
    merged = turns.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    merged = merged.withColumns({"said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), "blank": F.btrim("text", F.lit(BLANK)) == ""})
    merged = materialize(merged, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = merged.where(~F.col("blank")).groupBy("conv", "said").agg(F.min(when).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    seen = merged.join(materialize(again, "again"), ["conv", "said"], "left")
    last = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate")
        .when(~last.isin(ENDS), "truncated")
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = kind * 3 + F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    return numbered(seen.withColumn("fault", fault).withColumn("code", code).drop("said", "blank", "first"), "conv", F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))


def edits(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows of `with_faults`: letters and states after them per (conv, pos); cost, audit and last state per conv.

    The letters of a row are its inserts (before it) and its own; its copies are deleted besides.
    """
    block = F.expr(f"pos div {BLOCK}")
    own = F.sort_array(F.collect_list(F.struct("pos", "code", (F.col("n") - 1).alias("extra"))))
    blocks = turns.groupBy("conv", block.alias("block")).agg(own.alias("own")).select("conv", "block", F.col("own.pos").alias("pos"), F.col("own.code").alias("codes"), F.col("own.extra").alias("extras"))
    blocks = materialize(blocks.withColumn("matrix", matrix_of("codes", "extras")), "blocks")
    matrices = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("ms"))
    costs = materialize(matrices.select("conv", chained("ms.matrix").alias("c")), "costs")
    borders = costs.select("conv", "c.total", F.posexplode(F.arrays_zip("c.at_start", "c.at_end")).alias("block", "b")).select("conv", F.col("block").cast("bigint").alias("block"), "total", "b.at_start", "b.at_end")
    ways = blocks.join(borders, ["conv", "block"]).withColumn("ways", letters_of("codes", "extras", "at_start", "at_end", "total")).select("conv", "block", "pos", "ways")
    ways = materialize(ways, "ways")
    pairs = F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["leave"].alias("leave")))
    states = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", pairs.alias("pairs")))).alias("bs")).select("conv", entered("bs.pairs").alias("e"))
    states = materialize(states, "states")
    entry = states.select("conv", F.posexplode("e.entries").alias("block", "entry"))
    chosen = ways.join(entry, ["conv", "block"]).withColumn("way", F.filter("ways", lambda w: w["entry"] == F.col("entry"))[0])
    rows = chosen.select("conv", F.explode(F.arrays_zip("pos", F.col("way.letters").alias("letters"), F.col("way.states").alias("states"))).alias("r")).select("conv", "r.*")
    audit = chosen.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "way.audit"))).alias("a")).select("conv", F.array_join("a.audit", "").alias("audit"))
    ending = F.repeat(F.lit("I"), F.when(F.col("e.last") == 2, 1).when(F.col("e.last") == 1, 2).otherwise(0))
    return rows, costs.join(states, "conv").join(audit, "conv").select("conv", F.col("c.total").alias("cost"), F.concat("audit", ending).alias("audit"), F.col("e.last").alias("last"))


def repaired(turns: DataFrame, letters: DataFrame, totals: DataFrame) -> DataFrame:
    """Every edit in order (conv, pos, step): its letters, and role and text of what stands after it (null if deleted)."""
    step = F.posexplode(F.split(F.concat("letters", F.when(F.col("n") > 1, "X").otherwise("")), ""))
    each = turns.join(letters, ["conv", "pos"]).select("conv", "pos", "role", "text", "n", "states", step.alias("step", "edit"))
    state = F.substring("states", F.col("step") + 1, F.lit(1))
    new = F.when(state == "2", "user").otherwise("assistant")
    each = each.select(
        "conv", "pos", "step",
        F.when(F.col("edit") == "X", F.expr("repeat('D', cast(n - 1 AS int))")).otherwise(F.col("edit")).alias("edit"),
        F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit").isin("R", "I"), new).alias("role"),
        F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", "").alias("text"),
    )
    ending = F.when(F.col("last") == 2, F.array(F.lit("assistant"))).when(F.col("last") == 1, F.array(F.lit("user"), F.lit("assistant")))
    tail = totals.select("conv", F.lit((1 << 63) - 1).alias("pos"), F.posexplode(ending).alias("step", "role")).select("conv", "pos", "step", F.lit("I").alias("edit"), "role", F.lit("").alias("text"))
    return each.unionByName(tail)


def summary(turns: DataFrame) -> DataFrame:
    """Per conv: gaps in the turn numbers, faults, and neighbours whose role initials are not su, ua or au."""
    extra = F.col("n") - 1
    counts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"),
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("n")).otherwise(extra)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    distinct = turns.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))
    kind = F.expr("code div 3")
    here = turns.select("conv", "pos", kind.alias("kind"), extra.alias("extra"))
    before = turns.select("conv", (F.col("pos") + 1).alias("pos"), kind.alias("before"))
    fine = (F.col("before") * 4 + F.col("kind")).isin(*LEGAL)
    pairs = here.join(before, ["conv", "pos"], "left").groupBy("conv").agg(F.sum(F.col("extra") + F.when(F.col("before").isNotNull() & ~fine, 1).otherwise(0)).alias("illegal"))
    return counts.join(distinct, "conv", "left").join(pairs, "conv").select("conv", (F.col("span") - F.coalesce("turns", F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def op12_structure_repair(conversations: DataFrame) -> DataFrame:
    """The query: damage by the fixed rule, then find and apply the cheapest edits."""
    spark = conversations.sparkSession
    with scratch(spark) as keep:
        turns = with_faults(damage(conversations))
        letters, totals = edits(turns)
        steps = materialize(repaired(turns, letters, totals), "steps")
        texts = digests(steps.withColumn("line", F.when(F.col("role").isNotNull(), F.concat("role", F.lit(":"), "text"))), ["conv"], ["pos", "step"], "line", "\n", "repaired_sha256")
        ids = conversations.select("conv_id", conv_key().alias("conv")).distinct()
        whole = ids.join(summary(turns), "conv", "left").join(totals.drop("last"), "conv", "left").join(texts, "conv", "left")
        counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return keep(materialize(whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")), "repairs"))


def _plus(v: str, cost: str, letter: str) -> str:
    """DuckDB: a cost and an audit, kept as one string that sorts by both, with an edit before it."""
    return f"(lpad((substr({v}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{letter}' || substr({v}, 13))"


#: DuckDB: from a conversation's last turn back, the least (cost, audit) of each state as one string.
SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
hurt AS (SELECT *, {crc_sql("conv || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS r FROM src),
kept AS (
  SELECT conv, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN r = 1 THEN '' WHEN r = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN r = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hurt WHERE r <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM kept),
seen AS (SELECT *, substr(role, 1, 1) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
                row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM placed),
turns AS (
  SELECT conv, i, turn, role, text, k, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(k) OVER (PARTITION BY conv ORDER BY i) AS before
  FROM seen),
total AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || k NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv),
back AS (
  SELECT conv, n + 1 AS i, '000000000000' AS v0, '000000000006II' AS v1, '000000000003I' AS v2, '000000000000' AS v3 FROM total
  UNION ALL
  SELECT conv, i, least(b0, {_plus("c2", "3", "I")}), least(b1, {_plus("c2", "3", "I")}), c2, least(b3, {_plus("c2", "3", "I")})
  FROM (SELECT *, least(b2, {_plus("b3", "3", "I")}) AS c2
    FROM (SELECT back.conv, turns.i,
        least({_plus("v0", "4", "D")}, CASE WHEN gone THEN NULL ELSE least(CASE WHEN k = 'u' THEN {_plus("v2", "w", "K")} WHEN k = 's' THEN {_plus("v1", "w", "K")} END, {_plus("v2", "(w + 3)", "R")}) END) AS b0,
        least({_plus("v1", "4", "D")}, CASE WHEN gone THEN NULL ELSE least(CASE WHEN k = 'u' THEN {_plus("v2", "w", "K")} END, {_plus("v2", "(w + 3)", "R")}) END) AS b1,
        least({_plus("v2", "4", "D")}, CASE WHEN gone THEN NULL ELSE least(CASE WHEN k = 'a' THEN {_plus("v3", "w", "K")} END, {_plus("v3", "(w + 3)", "R")}) END) AS b2,
        least({_plus("v3", "4", "D")}, CASE WHEN gone THEN NULL ELSE least(CASE WHEN k = 'u' THEN {_plus("v2", "w", "K")} END, {_plus("v2", "(w + 3)", "R")}) END) AS b3
      FROM back JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS w FROM turns) turns
      ON turns.conv = back.conv AND turns.i = back.i - 1))),
best AS (SELECT conv, substr(v0, 1, 12)::BIGINT AS cost, substr(v0, 13) AS audit FROM back WHERE i = 1),
letter AS (SELECT conv, unnest(range(1, length(audit) + 1)) AS j, string_split(audit, '')[j] AS e FROM best),
step AS (SELECT conv, j, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv ORDER BY j) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv ORDER BY j) AS m FROM letter),
line AS (
  SELECT step.conv, j, e, m, CASE WHEN e = 'I' THEN '' ELSE text END AS text, CASE WHEN e = 'K' THEN role END AS role,
         max(CASE WHEN e = 'K' AND k = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY step.conv) AS s
  FROM step LEFT JOIN turns ON turns.conv = step.conv AND turns.i = step.i),
text AS (
  SELECT conv, sha256(string_agg(coalesce(role, CASE WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS h
  FROM line WHERE e <> 'D' GROUP BY conv)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM src) ids LEFT JOIN total ON total.conv = ids.conv LEFT JOIN best ON best.conv = ids.conv LEFT JOIN text ON text.conv = ids.conv
"""
