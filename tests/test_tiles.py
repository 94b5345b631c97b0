"""Tiles from stored sizes, by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tilelake.operators import tiles as T

SCHEMA = "layer string, rx int, rz int, mtime_ms long, px int, pz int, r int, g int, b int, a int"
SIDES = {"mip": 2, "thumb": 4, "full": 8}


def picture(rng, rx, rz, mtime, side):
    return [("l", rx, rz, mtime, px, pz, *(rng.randint(0, 255) for _ in range(3)), rng.choice([0, 90, 255])) for px in range(side) for pz in range(side) if rng.random() < 0.9]


def stored(rng):
    """Twelve regions; some sizes are missing or of an earlier time, one region has nothing."""
    out = {t: [] for t in SIDES}
    for rx in range(-2, 2):
        for rz in range(3):
            for t, side in SIDES.items():
                if (rx, rz) != (1, 2) and rng.random() < (0.95 if t == "full" else 0.6):
                    out[t] += picture(rng, rx, rz, rng.choice([5, 5, 4]) if t != "full" else 5, side)
    return out


def plain(rows, cell, span):
    at = {t: {} for t in SIDES}
    for t, found in rows.items():
        for _, rx, rz, mtime, *pixel in found:
            if mtime == 5:
                at[t].setdefault((rx, rz), []).append(pixel)
    out = {}
    for region in {r for t in at for r in at[t]}:
        tier = next((t for t in SIDES if SIDES[t] >= cell and region in at[t]), None)
        if tier is None:
            continue
        factor, boxes = SIDES[tier] // cell, {}
        for px, pz, *c in at[tier][region]:
            boxes.setdefault((px // factor, pz // factor), []).append(c)
        for (px, pz), own in boxes.items():
            a = sum(c[3] for c in own)
            colour = [sum(c[k] * c[3] for c in own) // a if a else 0 for k in range(3)] if factor > 1 else own[0][:3]
            rx, rz = region
            out["l", rx // span, rz // span, rx % span * cell + px, rz % span * cell + pz] = (*colour, a // factor**2)
    return out


@pytest.mark.parametrize(("zoom", "cell"), [(0, 8), (-1, 4), (-2, 2), (-3, 1)])
def test_tiles_from_the_best_size(spark, zoom, cell):
    rows = stored(random.Random(cell))
    pictures = {t: spark.createDataFrame(r, SCHEMA) for t, r in rows.items()}
    index = spark.createDataFrame([("l", rx, rz, 5) for rx in range(-2, 2) for rz in range(3)], "layer string, rx int, rz int, mtime_ms long")
    got = T.tile_from_tiers(index, pictures, zoom, SIDES, tile=8).collect()
    assert {(r["layer"], r["x"], r["y"], r["tx"], r["tz"]): (r["r"], r["g"], r["b"], r["a"]) for r in got} == plain(rows, cell, 1 << -zoom)
    one = T.tile_span(index, -1, 0, zoom)
    part = T.tile_from_tiers(one, pictures, zoom, SIDES, tile=8).collect()
    assert len(part) == sum(r["x"] == -1 and r["y"] == 0 for r in got)


def test_regions_narrower_than_a_pixel(spark):
    """32 regions to a tile of 8 pixels: 16 regions share a pixel; colours by alpha, alpha by area, 64 at least."""
    rng = random.Random(9)
    rows = {"mip": [p for rx in range(6) for rz in range(4) for p in picture(rng, rx, rz, 5, 2)], "thumb": picture(rng, 6, 0, 5, 4), "full": []}
    pictures = {t: spark.createDataFrame(r, SCHEMA) for t, r in rows.items()}
    index = spark.createDataFrame([("l", rx, rz, 5) for rx in range(8) for rz in range(4)], "layer string, rx int, rz int, mtime_ms long")
    got = {(r["tx"], r["tz"]): tuple(r[c] for c in "rgba") for r in T.tile_from_tiers(index, pictures, -5, SIDES, tile=8).collect()}
    sums = {}
    for t, side in SIDES.items():
        for _, rx, rz, _, _, _, *c in rows[t]:
            s = sums.setdefault((rx // 4, rz // 4), [0.0] * 4)
            for k in range(3):
                s[k] += c[k] * c[3] / side**2
            s[3] += c[3] / side**2
    assert got == {p: (*(int(s[k] / s[3] + 1e-9) for k in range(3)), int(max(64, min(255, s[3] / 16)) + 1e-9)) for p, s in sums.items() if s[3]}


def test_each_region_is_read_at_one_size(spark):
    rows = stored(random.Random(1))
    index = spark.createDataFrame([("l", rx, rz, 5) for rx in range(-2, 2) for rz in range(3)], "layer string, rx int, rz int, mtime_ms long")
    here = spark.createDataFrame([(*p[:4], t) for t, r in rows.items() for p in r], "layer string, rx int, rz int, mtime_ms long, tier string").distinct()
    chosen = T.sources(index, here, 2, SIDES)
    assert chosen.groupBy("rx", "rz").count().where("count > 1").count() == 0
    assert chosen.where(F.col("tier") == "full").count() > 0
