"""Waypoint trees, state numbers and clipping against plain versions."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tilelake.operators import archive as R
from tilelake.operators import catalog as C


def plain_tree(inner):
    """What a walk of one root's trees makes of a file's path below the root: tree, kind, world, folder."""
    parts = inner.split("/")
    for tree in (["xaero", "minimap"], ["config", "xaero", "minimap"], ["minimap"]):
        if parts[: len(tree)] == tree:
            kind = "live"
            break
    else:
        if not parts[0].startswith("XaeroWaypoints") or len(parts) < 2:
            return None
        tree, kind = parts[:1], "archived"
    *folders, name = parts[len(tree) :]
    backup = re.compile("backup-*")
    while folders and folders[0] != "temp_to_add" and backup.fullmatch(folders[0]):
        tree, kind, folders = [*tree, folders[0]], "archived", folders[1:]
    if not folders or folders[0] == "temp_to_add":
        return None
    world, folders = folders[0], folders[1:]
    while folders and backup.fullmatch(folders[0]):
        kind, folders = "archived", folders[1:]
    if len(folders) > 1 or folders == ["temp_to_add"] or not re.fullmatch(r"waypoints\.txt|[^_]*_.*\.txt", name):
        return None
    return "/".join(tree), kind, world, folders[0] if folders else None


def test_waypoint_trees(spark):
    rng = random.Random(2)
    pieces = ["xaero", "minimap", "config", "XaeroWaypoints", "XaeroWaypoints_B", "backup", "backup--", "temp_to_add", "w", "Overworld", "dim%-1"]
    names = ["waypoints.txt", "mw$default_1.txt", "config.txt", "x"]
    paths = {"/".join([*rng.choice([["a"], ["a", "xaero", "minimap"], ["a", "b"], ["a", "b", "minimap"], ["c"]]), *rng.choices(pieces, k=rng.randint(0, 6)), rng.choice(names)]) for _ in range(3000)}
    roots = ["a", "a/b", "nothing"]
    got = {r["path"]: (r["root"], r["tree"], r["kind"], r["world"], r["folder"]) for r in R.waypoint_trees(spark.createDataFrame([(f"/{p}" if k % 2 else p.replace("/", "//", 1),) for k, p in enumerate(sorted(paths))] + [(p,) for p in paths], "path string"), spark.createDataFrame([(r,) for r in roots], "root string")).collect()}
    wanted = {}
    for p in paths:
        for root in roots:  # a longer root comes later
            if p.startswith(root + "/") and (found := plain_tree(p[len(root) + 1 :])):
                wanted[p] = (root, *found)
    assert got == wanted and len(wanted) > 50


def test_worlds_without_maps_or_databases_are_none(spark):
    rows = [("r", "one", "DIM1/mw$default/0_0.zip"), ("r", "one", "null/x"), ("r", "one", "a$b/x"), ("r", "two", "XaeroPlusOld.db"), ("r", "two", "sub/XaeroPlusOld.db"), ("r", "none", "notes.txt"), ("r", "none", "cache/0_0.zip")]
    points = spark.createDataFrame([("one", "p"), ("none", "p")], "world string, path string")
    got = {r["world"]: (r["dims"], r["databases"], r["waypoint_files"]) for r in R.world_rows(spark.createDataFrame(rows, "root string, world string, rest string"), points).collect()}
    assert got == {"one": (["null", "DIM1", "a$b"], [], 1), "two": ([], ["XaeroPlusOld.db"], 0)}


def test_ancestors_of_deep_paths(spark):
    deep = "/".join(f"d{k}" for k in range(100))
    assert len(spark.range(1).select(R.ancestors(F.lit(deep)).alias("a")).first()["a"]) == 99


def test_state_numbers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    table = C.state_table(frame([(0, "minecraft:air"), (4, "minecraft:b[z=1,a=2]"), (5, "minecraft:b"), (6, "minecraft:c[k=x=y]")]))
    entries = spark.createDataFrame([("minecraft:b", {"a": "2", "z": "1"}, 3), ("minecraft:b", {}, 1), ("minecraft:c", {"k": "x=y"}, 1), ("minecraft:b", {"a": "2"}, 5), ("minecraft:b", {"a": "2"}, 2)], "block string, properties map<string, string>, n long")
    out = C.state_ids(entries, table)
    assert sorted((r["key"], r["id"], r["known"]) for r in out.collect()) == sorted([("minecraft:b[a=2,z=1]", 4, True), ("minecraft:b", 5, True), ("minecraft:c[k=x=y]", 6, True), ("minecraft:b[a=2]", 0, False), ("minecraft:b[a=2]", 0, False)])
    assert [tuple(r) for r in C.unknown_states(out, "n").collect()] == [("minecraft:b[a=2]", 7)]
    for bad in ([(1, "minecraft:stone")], [(0, "minecraft:air"), (1, "x[a=1,b=2]"), (2, "x[b=2,a=1]")]):
        with pytest.raises(ValueError, match="states"):
            C.state_table(frame(bad))


def exact(s, w):
    """The part of a segment in a window, in exact numbers."""
    (ax, az, bx, bz), (x0, z0, x1, z1) = s, w
    low, high = Fraction(0), Fraction(1)
    for a, b, lo, hi in ((ax, bx, x0, x1), (az, bz, z0, z1)):
        if a == b:
            if not lo <= a <= hi:
                return None
            continue
        t = sorted((Fraction(lo - a, b - a), Fraction(hi - a, b - a)))
        low, high = max(low, t[0]), min(high, t[1])
    if low > high:
        return None
    return tuple(round(float(a + t * (b - a)), 6) for t in (low, high) for a, b in ((ax, bx), (az, bz)))


def test_clipping(spark):
    rng = random.Random(7)
    rows = [(k, *(rng.randint(-9, 9) for _ in range(4)), -rng.randint(0, 6), -rng.randint(0, 6), rng.randint(0, 6), rng.randint(0, 6)) for k in range(2000)]
    got = {r["k"]: tuple(round(r[c], 6) + 0.0 for c in ("ax", "az", "bx", "bz")) for r in C.clipped(spark.createDataFrame(rows, "k long, ax long, az long, bx long, bz long, x0 long, z0 long, x1 long, z1 long")).collect()}
    assert got == {r[0]: tuple(v + 0.0 for v in c) for r in rows if (c := exact(r[1:5], r[5:]))}


def test_windows_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("d", k, -k, 1, "x") for k in range(50)], "dim string, x long, z long, color long, more string").write.parquet(f"{tmp_path}/t")
    found = C.drawings_in_window(spark.read.parquet(f"{tmp_path}/t"), "d", 3, 9, -7, 0).select("x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,3)" in plan and "more" not in plan.split("ReadSchema")[1]
    assert sorted(r["x"] for r in found.collect()) == [3, 4, 5, 6, 7]


def test_tables_of_drawings(spark):
    """A table that the destination lacks, one without declared keys, and columns that only one side has."""
    frame = spark.createDataFrame
    dest = {"a": frame([(1, "old", 5)], "k long, v string, own long"), "free": frame([(1,)], "k long")}
    source = {"a": frame([(1, "new", 7), (2, "new", 7), (2, "again", 7)], "k long, v string, other long"), "free": frame([(1,), (1,)], "k long"), "fresh": frame([(4, 4)], "k long, w long")}
    merged, counts = C.merge_drawing_tables(dest, source, {"a": ["k"], "fresh": ["k"]})
    rows = sorted(map(tuple, merged["a"].collect()))
    assert rows[0] == (1, "old", 5) and rows[1][0] == 2 and rows[1][2] is None and len(rows) == 2 and merged["a"].columns == ["k", "v", "own"]
    assert merged["free"].count() == 3 and merged["fresh"].count() == 1
    assert {r["name"]: tuple(r)[1:] for r in counts.collect()} == {"a": (3, 1, 1, 3), "free": (2, 1, 0, 3), "fresh": (1, 0, 0, 1)}
