"""Structure repair, prefix trie and licence scan against brute force, on odd tables and hot groups."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fastbreak.llm import license_scan, prefix_trie, structure_repair
from fastbreak.llm.license_texts import PHRASES, TEMPLATES
from fastbreak.llm.turns import dense_names, numbered

TURNS = "conv_id long, turn long, role string, text string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def turns(spark, rows, **extra):
    return spark.createDataFrame(rows, TURNS).withColumns({k: F.lit(v) for k, v in extra.items()})


def messy(seed, convs=30, most=9):
    rng = random.Random(seed)
    role = lambda: rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
    text = lambda: rng.choice(["Yes.", "No", "a b! ", "", None, " \n", "what?\t", "Yes.", "c.d", "é z."])
    out = [(c, rng.choice([t, t, t, None, 2]), role(), text()) for c in [*range(-3, convs), None] for t in range(rng.randrange(0, most))]
    return out + [r for r in out if rng.random() < 0.05]


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        r = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if r == 0:
            continue
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        out[c] += [(t, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def everything(rows, kinds):
    """All ways with at most two inserts in a gap: the least (cost, audit), and the roles it gives."""
    gaps = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    best = None
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(("D", "K", "Ru", "Ra"), repeat=len(rows)):
            if any(e != "D" and k in ("blank", "duplicate") for e, k in zip(edits, kinds, strict=True)):
                continue
            cost, audit, initials, lines = 0, "", "", []
            for i, gap in enumerate(inserts):
                for x in gap:
                    cost, audit, initials = cost + 3, audit + "I", initials + x
                    lines.append({"u": "user", "a": "assistant"}[x] + ":")
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if e != "D" and kinds[i] == "truncated" else 0)
                    if e != "D":
                        role = {"K": role, "Ru": "user", "Ra": "assistant"}[e]
                        initials += role[:1] or "-"
                        lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(lines)
    return best


def backward(rows, kinds):
    """The least (cost, audit, lines) by going from the last turn to the first."""
    onward = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def relaxed(v):
        for _ in range(4):
            for s, (to, role) in onward.items():
                if v[to] is not None:
                    new = (v[to][0] + 3, "I" + v[to][1], (role + ":", *v[to][2]))
                    if v[s] is None or new[:2] < v[s][:2]:
                        v[s] = new
        return v

    v = relaxed([(0, "", ()), None, None, (0, "", ())])
    for (_, role, text), k in reversed(list(zip(rows, kinds, strict=True))):
        new = []
        for s in range(4):
            ways = [(v[s][0] + 4, "D" + v[s][1], v[s][2])]
            if k not in ("blank", "duplicate"):
                more = 3 if k == "truncated" else 0
                to, other = onward[s]
                ways.append((v[to][0] + 3 + more, "R" + v[to][1], (f"{other}:{text}", *v[to][2])))
                keep = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                if keep:
                    ways.append((v[keep][0] + more, "K" + v[keep][1], (f"{role}:{text}", *v[keep][2])))
            new.append(min(ways))
        v = relaxed(new)
    return v[0][0], v[0][1], "\n".join(v[0][2])


def expected_repairs(rows, best):
    fixed, out = damaged(rows), {}
    for c in {r[0] for r in rows}:
        own = fixed.get(c, [])
        kinds, known = faults(own), [t for t, _, _ in own if t is not None]
        cost, audit, text = best(own, kinds)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repairs(df):
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}


def test_repair_against_every_way():
    rng = random.Random(3)
    for _ in range(12):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", "No", "", "Hm?"])) for t in range(rng.randrange(0, 4))]
        assert everything(rows, faults(rows)) == backward(rows, faults(rows))


@pytest.mark.parametrize("block", [4096, 3])
def test_repair_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(structure_repair, "BLOCK", block)
    rows = messy(1) + [(77, t, r, x) for t, (_, _, r, x) in enumerate(messy(2, 20)[:100])]
    assert repairs(structure_repair.op12_structure_repair(turns(spark, rows, cost=1, pos="x", n=None))) == expected_repairs(rows, backward)


def test_repair_of_many_copies_and_nothing(spark):
    rows = [(5, 1, "user", "Go on.")] * 300 + [(5, 2, "assistant", "Yes.")]
    assert repairs(structure_repair.op12_structure_repair(turns(spark, rows))) == expected_repairs(rows, backward)
    assert structure_repair.op12_structure_repair(turns(spark, [])).count() == 0


def test_repaired_rows_follow_the_rule(spark):
    fixed = structure_repair.with_faults(structure_repair.damage(turns(spark, messy(4))))
    letters, totals = structure_repair.edits(fixed)
    said = defaultdict(str)
    for r in structure_repair.repaired(fixed, letters, totals).where("role IS NOT NULL").orderBy("conv", "pos", "step").collect():
        said[r["conv"]] += r["role"][:1]
    assert said and all(re.fullmatch("(s?(ua)+)?", x) for x in said.values())


def expected_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(x)] for c, x in own.items()}
    mixed = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        mixed[c] = own.get(base, [])[:h] + x[h:]
    nodes = defaultdict(list)
    for c, x in sorted(mixed.items()):
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        own = (len(nodes[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves, saved = (0, own) if children[p] else (1, own)
        for x in children[p]:
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = {}
    for p, ids in nodes.items():
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in ids if len(mixed[c]) == len(p))
        out[ids[0], len(p)] = (nodes[p[:-1]][0] if p else None, len(ids), len(children[p]), leaves, saved, sha(ends))
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_trie_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(5)
    rows = messy(6, 45)
    long = [(t, rng.choice(["user", "assistant"]), f"turn {t} of many") for t in range(70)]
    rows += [(c, *r) for c in (100, 101, 120) for r in long[: 70 if c != 120 else 33]]
    rows += [(c, 0, "user", "the same words") for c in range(200, 240)]
    got = prefix_trie.op13_prefix_trie(turns(spark, rows, depth=1, name="x", node=0)).collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(found) == len(got) and found == expected_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.op13_prefix_trie(turns(spark, [])).count() == 0
    assert prefix_trie.op13_prefix_trie(turns(spark, [(None, 1, "user", "x")])).count() == 0


def test_positions_and_names(spark):
    df = spark.createDataFrame([("a", i % 7) for i in range(500)] + [("b", 3)] * 200, "k string, v int").repartition(6)
    got = numbered(df, "k", F.col("v")).orderBy("k", "pos").collect()
    assert [(r["k"], r["pos"]) for r in got] == [("a", i) for i in range(500)] + [("b", i) for i in range(200)]
    assert [r["v"] for r in got if r["k"] == "a"] == sorted(i % 7 for i in range(500))
    named = dense_names(df, ["k", "v"], "id").select("k", "v", "id").distinct().collect()
    assert sorted(r["id"] for r in named) == list(range(8))


def licence_docs():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "Software", "license", "gnu", "mit", "cc", "by", "xyzzy", "é", "general", "public", "apache", "copy", "to", "use"])
    noise = lambda n: " ".join(word() for _ in range(n))
    mit = TEMPLATES["mit"].split()
    out = [None, "", "!!", "MIT-License", "cc by", "x GNU general, Public\nLicense version 3 cc by-nc the MIT license"]
    out += [noise(rng.randrange(1, 200)) for _ in range(40)]
    out += [f"{noise(20)} {' '.join(mit[:60] + ['odd', 'words'] + mit[60:])} {noise(20)}", " ".join(mit[:20]), TEMPLATES["bsd-2-clause"].upper() + " end", TEMPLATES["apache"], noise(50) + " " + " ".join(mit[100:]) + " " + TEMPLATES["isc"]]
    return out


def test_licence_against_brute_force(spark):
    texts = licence_docs()
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(texts)] + [(None, "mit license", "mine", 1)], "doc_id long, text string, spans string, score int")
    got = {r["doc_id"]: r for r in license_scan.op11_license_scan(df).collect()}
    assert got[None]["n_base"] == 1 and len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, starts = got[i], [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    n = len(texts)
    assert "mit" in got[n - 5]["labels"].split(",") and got[n - 5]["score"] == 1.0 and got[n - 3]["labels"] == "bsd-2-clause"
    assert set(got[n - 1]["labels"].split(",")) >= {"isc"} and {"apache", "apache-2.0"} <= set(got[n - 2]["labels"].split(","))
    assert got[5]["labels"] == "cc-by,cc-by-nc,gpl,gpl-3.0,mit"


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        letters = "abcd"
        templates = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randrange(6, 25)))) for k in range(3)]
        auto = license_scan.Automaton(templates, [("b c", "bc", True), ("a", "one", True)])
        text = [rng.choice(letters + "e") for _ in range(80)]
        found, diagonals = auto.matches(text)
        want = {}
        for t, (_, template) in enumerate(templates):
            w = template.split()
            for i, e in itertools.product(range(len(text)), range(len(w))):
                n = 0
                while n <= min(i, e) and text[i - n] == w[e - n]:
                    n += 1
                ended = i + 1 == len(text) or e + 1 == len(w) or text[i + 1] != w[e + 1]
                if n >= license_scan.MIN_MATCH and ended:
                    want.setdefault(t, set()).add((i, e, n))
        assert {t: set(m) for t, m in diagonals.items()} == want
        alone = [i for i in range(len(text)) if text[i] == "a" and (i and text[i - 1] != "e" or i + 1 < len(text) and text[i + 1] != "e")]
        assert sorted(x for x in found if x[2] == 0) == [(i - 1, i, 0) for i in range(1, len(text)) if text[i - 1 : i + 1] == ["b", "c"]]
        assert sorted(x[0] for x in found if x[2] == 1) == alone


def test_licence_spans_point_into_the_text(spark):
    text = "Ä! " + TEMPLATES["zlib"]
    r = license_scan.find_licenses(spark.createDataFrame([(text, 3)], "text string, n_words int")).first()
    span = next(s for s in r["spans"] if s["label"] == "zlib")
    assert text[span["start"] : span["end"]] == TEMPLATES["zlib"] and span["coverage"] == 1.0
    assert license_scan.find_licenses(spark.createDataFrame([], "text string")).count() == 0


def test_licence_in_a_very_long_text(spark):
    text = (TEMPLATES["mit"] + " filler words between ") * 400 + "mit license " * 20000
    r = license_scan.op11_license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_base"] == 20000 and r["labels"] == "mit" and r["score"] == 1.0
