"""Binary regions: what is written is read, any prefix gives the tiles before its end, faults are rows."""

import random
import struct

import pytest

from tilelake.sources import files, regions


def tile(rng, chunk, cx, cz, tx, tz):
    n = lambda low, high: [rng.randint(low, high) for _ in range(256)]
    maybe = lambda high: [rng.choice([None, *range(high)]) for _ in range(256)]
    overlays = [[{"params": 0x11, "state": 1, "opacity": None}] if rng.random() < 0.1 else [] for _ in range(256)]
    return {"chunk_ord": chunk, "cx": cx, "cz": cz, "tx": tx, "tz": tz, "interp_version": 1, "cave_start": -5, "cave_depth": 3, "params": [0x300] * 256, "state": maybe(3), "height": n(-2048, 2047), "top": maybe(200), "biome": maybe(2), "overlays": overlays}


STATES = [regions.name_entry(x) for x in ("minecraft:stone", "minecraft:water", "minecraft:dirt")]
BIOMES = [b"minecraft:plains", b"minecraft:river"]


@pytest.fixture(scope="module")
def stream():
    rng = random.Random(7)
    return regions.encode([tile(rng, 0, 1, 2, 0, 3), tile(rng, 0, 1, 2, 1, 0), tile(rng, 1, 7, 7, 3, 3)], STATES, BIOMES)


def test_encoding_is_a_fixed_point(stream):
    one = regions.Region(stream)
    assert (one.major, one.minor, one.truncated, len(one.tiles)) == (7, 8, False, 3)
    assert {name for _, name in one.states} == {"minecraft:stone", "minecraft:water", "minecraft:dirt"}
    names = ["chunk_ord", "cx", "cz", "tx", "tz", "interp_version", "cave_start", "cave_depth", "params", "state", "height", "top", "biome", "overlays"]
    rows = [dict(zip(names, t)) for t in one.tiles]
    for r in rows:
        r["overlays"] = [[dict(zip(("params", "state", "opacity"), o)) for o in own] for own in r["overlays"]]
    assert regions.encode(rows, [s for s, _ in one.states], [b for b, _ in one.biomes]) == stream


def test_values_survive(stream):
    rng = random.Random(7)
    first = tile(rng, 0, 1, 2, 0, 3)
    got = regions.Region(stream).tiles[0]
    assert got[:8] == (0, 1, 2, 0, 3, 1, -5, 3)
    assert got[10] == first["height"] and got[11] == first["top"]
    assert [s is None for s in got[9]] == [s is None for s in first["state"]]


@pytest.mark.parametrize("part", range(0, 20))
def test_any_prefix_gives_a_prefix(stream, part):
    whole = regions.Region(stream).tiles
    cut = stream[: 5 + (len(stream) - 5) * part // 20]
    got = regions.Region(cut)
    assert got.tiles == whole[: len(got.tiles)] and len(got.tiles) < 3


def test_new_spelling_of_states():
    raw = b"\x0a\0\0\x08\0\2id\0\3a:b\x0a\0\x0aproperties\x08\0\1k\0\1v\0\x08\0\4Name\0\1x\0"
    entry, name = regions.state_entry(regions.Stream(raw), 8)
    assert name == "a:b" and b"Properties" in entry and b"Name" in entry and b"id" not in entry
    assert regions.state_entry(regions.Stream(entry), 7) == (entry, "a:b")


def test_deep_and_broken_tags_end():
    deep = b"\x09\0\0" + b"\x09\0\0\0\1" * 5000
    with pytest.raises(regions.Short):
        regions.state_entry(regions.Stream(deep), 7)
    with pytest.raises(regions.Short):
        regions.skip_tag(regions.Stream(b"\xff" * 8), 7)
    assert regions.java_text(b"a\xc0\x80\xed\xa0\xbd\xed\xb8\x80") == "a\0\U0001f600"


def test_files_to_rows_and_back(spark, tmp_path, stream):
    (tmp_path / "0_0.zip").write_bytes(files.make_container(stream))
    (tmp_path / "1_0.zip").write_bytes(files.make_container(stream[:-3]))
    (tmp_path / "2_0.xaero").write_bytes(struct.pack(">BHH", 0xFF, 2, 5))
    (tmp_path / "3_0.xaero").write_bytes(b"\0")
    found = files.contents(spark, str(tmp_path))
    probed = {r["path"].rsplit("/", 1)[1]: r for r in regions.probe(found).collect()}
    assert (probed["0_0.zip"]["tiles"], probed["0_0.zip"]["truncated"], probed["0_0.zip"]["error"]) == (3, False, None)
    assert (probed["1_0.zip"]["tiles"], probed["1_0.zip"]["truncated"]) == (2, True)
    assert "unsupported" in probed["2_0.xaero"]["error"] and "no save version" in probed["3_0.xaero"]["error"]
    tiles, palette = regions.tiles(found), regions.palettes(found)
    back = {r["path"].rsplit("/", 1)[1]: bytes(r["stream"]) for r in regions.regions(tiles, palette).collect()}
    assert back["0_0.zip"] == stream and set(back) == {"0_0.zip", "1_0.zip"}
    row = regions.named(tiles, palette).where("path like '%0_0.zip' and tx = 0").first()
    assert set(row["state_name"]) - {None} == {"minecraft:stone", "minecraft:water", "minecraft:dirt"}
