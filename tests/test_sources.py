import json

from fastbreak.sources import files
from fastbreak.sources.catalog import Catalog, restrict


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.append("people", spark.createDataFrame([(1, "Alice")], "id long, name string"))
    c.append("people", spark.createDataFrame([(2, "Bob", 7)], "id long, name string, extra int"))
    assert {tuple(r) for r in c.table("people").collect()} == {(1, "Alice"), (2, "Bob")}
    c.upsert("people", spark.createDataFrame([(2, "Bobby")], "id long, name string"), ["id"])
    assert {tuple(r) for r in c.table("people").collect()} == {(1, "Alice"), (2, "Bobby")}
    c.append("people", spark.createDataFrame([], "id long, name string"))
    assert c.table("people").count() == 2
    c.append_tolerant("people", spark.createDataFrame([("x", "Carl"), ("4", "Dee")], "id string, name string"))
    assert {r["id"] for r in c.table("people").collect()} == {1, 2, None, 4}
    c.add_column("people", "age", "int")
    c.add_column("people", "age", "int")
    assert c.columns("people")["age"] == "int"
    c.create("people", "id long")
    c.create("empty", "id long")
    assert c.table("empty").count() == 0
    assert c.query("SELECT count(*) AS n FROM people WHERE id = :k", {"k": 1}).first()["n"] == 1
    assert c.missing(spark.createDataFrame([(1,), (9,)], "id long"), "people", "id").first()["id"] == 9
    before = sorted(x.name for x in (tmp_path / "people").iterdir())
    files_before = {x for x in (tmp_path / "people").rglob("*.parquet")}
    c.append("people", spark.createDataFrame([(50, "Eve")], "id long, name string"))
    assert sorted(x.name for x in (tmp_path / "people").iterdir()) == before  # no new version
    assert files_before < {x for x in (tmp_path / "people").rglob("*.parquet")} and c.table("people").where("id = 50 AND age IS NULL").count() == 1
    c.execute("old", "SELECT id FROM people WHERE id > :k", {"k": 40})
    c.write("parted", spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string"), ["p"])
    c.append("parted", spark.createDataFrame([("a", 3)], "p string, id int"))
    assert {tuple(r) for r in c.table("parted").collect()} == {(1, "a"), (2, "b"), (3, "a")} and c.table("old").first()["id"] == 50
    n = c.table("people").count()
    c.vacuum("people")
    assert c.table("people").count() == n and len([x for x in (tmp_path / "people").iterdir()]) == 1
    assert c.values([(1, "x")], "a int, b string").count() == 1
    c.log_failures("failures", spark.createDataFrame([("g1", "boom")], "game string, why string"))
    assert c.table("failures").count() == 1


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    c, table = Catalog(spark, str(tmp_path)), tmp_path / "t"
    rows = lambda: sorted((tuple(r) for r in c.table("t").collect()), key=str)
    data = lambda: {x for x in table.rglob("*.parquet") if "_bucket=" in str(x)}
    kinds = "k long, g string, v int"
    want = {(k, "a"): 0 for k in range(200)}
    c.write("t", spark.createDataFrame([(k, g, v) for (k, g), v in want.items()] + [(None, "a", 7)], kinds))
    c.upsert("t", spark.createDataFrame([(5, "a", 1)], kinds), ["k", "g"], 16)
    first = data()
    assert len({x.parent for x in first}) == 16 and len(rows()) == 201
    before = {x: x.stat().st_mtime_ns for x in first}
    c.upsert("t", spark.createDataFrame([(5, "a", 2), (5, "b", 3)], kinds), ["k", "g"])
    want |= {(5, "a"): 2, (5, "b"): 3}
    new = data() - first
    assert 1 <= len({x.parent.name for x in new}) <= 2 and {x: x.stat().st_mtime_ns for x in first} == before
    assert rows() == sorted([(k, g, v) for (k, g), v in want.items()] + [(None, "a", 7)], key=str)
    c.append("t", spark.createDataFrame([(900, "a", 4), (901, "a", 4)], kinds))
    c.add_column("t", "w", "double")
    c.upsert("t", spark.createDataFrame([(900, "a", 5, 1.5), (None, "a", 8, None)], f"{kinds}, w double"), ["k", "g"])
    want |= {(900, "a"): 5, (901, "a"): 4}
    expected = sorted([(k, g, v, 1.5 if k == 900 else None) for (k, g), v in want.items()] + [(None, "a", 7, None), (None, "a", 8, None)], key=str)
    assert rows() == expected
    held = len(data())
    c.vacuum("t")
    assert rows() == expected and len(data()) < held
    c.upsert("t", spark.createDataFrame([(3, "z", 9, None)], f"{kinds}, w double"), ["k"])  # another key: written anew
    assert [r for r in rows() if r[0] == 3] == [(3, "z", 9, None)] and len(rows()) == len(expected)


def test_restrict(spark):
    df = spark.range(5)
    assert {r["id"] for r in restrict(df, "id", spark.range(1, 4), spark.range(2, 3)).collect()} == {1, 3}


def test_files(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    for y in (2019, 2020):
        (d / f"stats_{y}.csv").write_text('player,pts\n"Smith, ""JJ""",10\n')
    got = files.read_season_files(spark, f"{d}/stats_*.csv", "player string, pts int")
    assert {(r["player"], r["season"]) for r in got.collect()} == {('Smith, "JJ"', 2019), ('Smith, "JJ"', 2020)}
    assert files.read_tree(spark, str(tmp_path), "stats_*.csv").count() == 2
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"p": {"id": 1, "n": "x"}}, {"p": {"id": 2, "n": "y"}}]}))
    flat = files.flatten(files.read_json_rows(spark, str(tmp_path / "a.json")))
    assert flat.columns == ["p_id", "p_n"] and flat.count() == 2
    m = files.write_partitioned(got, str(tmp_path / "out"), "season", ["player"])
    assert {r["rows"] for r in m.collect()} == {1}
    assert files.dataset_for(m, "season", 2019).count() == 1
