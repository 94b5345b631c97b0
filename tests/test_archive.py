"""Pairing, merging and listings on small rows, against plain loops."""

import random

from pyspark.sql import functions as F
from tilelake.functions import naming as N
from tilelake.operators import archive as R
from tilelake.operators import merging as M
from tilelake.operators import waypoints as W


def server(name):
    name = name.removeprefix("Multiplayer_")
    for end in (".org", ".net", ".com"):
        while name.endswith(end):
            name = name[: -len(end)]
    return name.lower()


def claims(a, b, aliases, auto):
    """One world after another, in three passes."""
    partner, taken, out = {}, {}, []
    tests = [("exact", lambda x, y: x == y), ("alias", lambda x, y: (x, y) in aliases or (y, x) in aliases), ("domain", lambda x, y: x != y and server(x) == server(y))]
    for how, test in tests:
        for x in sorted(a):
            claim = None if x in partner else next((y for y in sorted(b) if test(x, y)), None)
            if claim is None:
                continue
            if claim in taken:
                out.append((x, claim, "blocked", taken[claim]))
            elif how == "domain" and not auto:
                out.append((x, claim, "suggested", None))
            else:
                partner[x], taken[claim] = claim, x
                out.append((x, claim, how, None))
    return sorted(out, key=str)


def test_worlds_claim_each_other(spark):
    dice = random.Random(3)
    names = [f"{p}{n}{e}" for p in ("Multiplayer_", "") for n in ("play", "Play", "srv", "old") for e in ("", ".net", ".org.net", ".com")]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "world string")
    for auto in (False, True):
        a, b = dice.sample(names, 14), dice.sample(names, 14)
        aliases = {(dice.choice(names), dice.choice(names)) for _ in range(12)}
        got = M.pair_worlds(frame(a + a[:3]), frame(b), spark.createDataFrame(sorted(aliases), "x string, y string"), auto)
        assert sorted(map(tuple, got.collect()), key=str) == claims(a, b, aliases, auto)
        assert M.pair_worlds(frame(a), frame([]), None, auto).count() == 0


def test_merge_keeps_what_can_be_read(spark):
    index = "layer string, rx int, rz int, mtime_ms long, size long"
    a = spark.createDataFrame([("s", k, 0, 10 + k, 5) for k in range(5)], index)
    b = spark.createDataFrame([("s", k, 0, 12, 5) for k in range(1, 6)], index)
    tile = "layer string, rx int, rz int, tx int, tz int, v string"
    ta = spark.createDataFrame([("s", k, 0, t, 0, f"a{k}{t}") for k in range(5) for t in (0, 1)], tile)
    tb = spark.createDataFrame([("s", k, 0, t, 0, f"b{k}{t}") for k in range(1, 6) for t in (1, 2)], tile)
    bad = spark.createDataFrame([("s", 2, 0, "A"), ("s", 3, 0, "B"), ("s", 4, 0, "A"), ("s", 4, 0, "B"), ("s", 5, 0, "B")], "layer string, rx int, rz int, side string")
    tiles, regions = M.merge_tiles(M.plan(a, b), ta, tb, bad)
    found = {}
    for r in tiles.collect():
        found.setdefault(r["rx"], set()).add(r["v"])
    assert found == {0: {"a00", "a01"}, 1: {"a10", "b11", "b12"}, 2: {"b21", "b22"}, 3: {"a30", "a31"}, 5: {"b51", "b52"}}
    got = {r["rx"]: (r["action"], r["mtime_ms"], r["tiles"], r["from_b"], r["note"]) for r in regions.collect()}
    assert got == {
        0: ("copy_a", 10, 2, 0, None), 1: ("merge", 12, 3, 2, None), 2: ("merge", 12, 2, 2, "a unreadable, copied b"), 3: ("merge", 13, 2, 0, "b unreadable, copied a"),
        4: ("merge", None, 0, 0, "both unreadable"), 5: ("copy_b", 12, 2, 2, None),
    }
    preferred = M.merge_tiles(M.plan(a, b, "a"), ta, tb, bad.limit(0))[0].where("rx = 1 and tx = 1").collect()
    assert [r["v"] for r in preferred] == ["a11"]


def test_roots(spark):
    rows = [
        ("x/one", "null/mw$default/0_0.zip"), ("x/two", "w/null/mw$default/0_0.zip"), ("x/two", "xaero/world-map/v/DIM1/mw$default/0_0.zip"), ("x/two", "xaero/world-map/v/notes/a.txt"), ("x/none", "a/b/c.txt"),
        ("x/conf", "world-map/w/server_config.txt"), ("x/db", "w/XaeroPlusPortals.db"), ("x/db", "w2/corrupted_XaeroPlusPortals.db"), ("x/db", None),
    ]
    got = {tuple(r) for r in R.world_files(spark.createDataFrame(rows, "root string, path string")).select("root", "layout", "world", "rest").collect()}
    assert got == {
        ("x/one", "", "one", "null/mw$default/0_0.zip"), ("x/two", "xaero/world-map/", "v", "DIM1/mw$default/0_0.zip"), ("x/two", "xaero/world-map/", "v", "notes/a.txt"),
        ("x/conf", "world-map/", "w", "server_config.txt"), ("x/db", "", "w", "XaeroPlusPortals.db"),
    }


def test_changes_find_the_first_world(spark):
    worlds = spark.createDataFrame([(0, "in", "s/w"), (1, "out", "s")], "ord int, world string, root string")
    maps = spark.createDataFrame([(0, "null", "mw$default"), (1, "w", "null")], "ord int, folder string, mw string")
    databases = spark.createDataFrame([(0, "D.db")], "ord int, db string")
    paths = ["s/w/null/mw$default/1_-2.zip", "s/w/null/mw$default/caves/-3/1_2.zip", "s/w/null/mw$default/caves/x/1_2.zip", "s/w/D.db-shm", "s/w/D.db", "s/w/E.db", "t", "", "s/w/null/mw$default/1_2.zip.tmp", "s/w", "s/w/null/3_4.zip"]
    found = R.classify(spark.createDataFrame([(p,) for p in paths], "path string"), worlds, maps, databases)
    got = {tuple(r) for r in found.select("world", "kind", "layer", "rx", "rz", "db").collect()}
    assert got == {("in", "region", "surface", 1, -2, None), ("in", "region", "-3", 1, 2, None), ("in", "database", None, None, None, "D.db")}


def test_small_parsers(spark):
    rows = [("surface", "#a0B1c2", "0,255"), (None, None, None), ("cave:-2147483648", " ##000001 ", " 7 ,+8 "), ("cave:99999999999", "# 000001", "1,256"), ("cave-4", "1234567", ","), ("", "", "")]
    frame = spark.createDataFrame(rows, "spec string, hex string, roof string")
    o, w = N.roof(F.col("roof"))
    got = [tuple(r) for r in frame.select(N.layer_of_spec(F.col("spec")), N.layer_of_spec(F.col("spec"), "cave-"), N.tint(F.col("hex")), o, w).collect()]
    assert got == [
        ("surface", "surface", 0xA0B1C2, 0, 255), ("surface", "surface", None, None, None), ("-2147483648", None, 1, 7, 8), (None, None, None, None, None), (None, "4", None, None, None), (None, None, None, None, None),
    ]
    lines = spark.createDataFrame([("dimensionType:a$b/c:minecraft$the_end\r",), ("dimensionType:alone",), ("x:y:z",), (None,)], "line string")
    assert [(r["level"], r["type"]) for r in W.dimension_types(lines).collect()] == [("a:b/c", "minecraft:the_end")]


def test_one_sides_waypoints_stay_as_they_are(spark):
    lines = [("f", "A", 0, "#"), ("f", "A", 1, "sets:b:b"), ("g", "A", 0, "sets:b:a"), ("g", "A", 1, "note"), ("g", "B", 0, "sets:c:b"), ("g", "B", 1, "note"), ("g", "B", 2, "#x"), ("g", "B", 3, "own\r")]
    out = W.union_files(spark.createDataFrame(lines, "file string, side string, ord int, line string"), ["file"]).orderBy("file", "part", "side", "ord", "pos").collect()
    assert [(r["file"], r["part"], r["text"]) for r in out] == [("f", 3, "#"), ("f", 3, "sets:b:b"), ("g", 0, "b"), ("g", 0, "a"), ("g", 0, "c"), ("g", 2, "note"), ("g", 2, "own")]


def test_ancestors_stop_at_the_deepest_root(spark):
    """A path meets as many of its ancestors as can be roots, not all of them."""
    from pyspark.sql import functions as F

    from tilelake.operators import archive as R

    rows = spark.createDataFrame([("a/b/c/d/e.txt",), ("a/f",), ("g",)], "path string").select(R.ancestors_to(F.col("path"), 2).alias("x")).collect()
    assert [r["x"] for r in rows] == [["", "a", "a/b"], ["", "a"], [""]]
    assert spark.range(1).select(R.ancestors_to(F.lit("a/b"), 0).alias("x")).first()["x"] == [""]
