"""Grids, merges and upserts on rows small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from tilelake.operators import highlights as H


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(-64, -64, 500), (-63, -64, 400), (-1, -1, 900), (0, 0, 100), (63, 63, 700)], "x int, z int, found_time long")


def cells(df):
    return {(r["cell_x"], r["cell_z"]): r["n"] for r in df.collect()}


def test_grid_with_negative_coordinates(five):
    assert cells(H.tile_grid(five, -64, -64, 128, 4)) == {(0, 0): 2, (1, 1): 1, (2, 2): 1, (3, 3): 1}


def test_zoomed_in_a_cell_is_a_chunk(five):
    assert cells(H.tile_grid(five, -64, -64, 32, 512)) == {(0, 0): 1, (1, 0): 1}


def test_row_cap_is_exact(five):
    assert tuple(H.row_cap(five, 2).first()) == (2, True)
    assert tuple(H.row_cap(five, 5).first()) == (5, False)


def test_lava_hides_low_columns(spark):
    lava = spark.createDataFrame([(0, 0, 0), (1, 0, 3), (2, 0, 7), (3, 0, 40)], "x int, z int, v long")
    got = {r["cell_x"]: r["value"] for r in H.tile_grid(lava, 0, 0, 4, 4, "v", True, 5).collect()}
    assert got == {2: 7, 3: 40}
    heights = spark.createDataFrame([(h,) for h in (0, 4, 5, 32, 123)], "h long").select(H.lava_alpha(F.col("h")))
    assert [r[0] for r in heights.collect()] == [None, None, 40, 255, 255]


def test_merge_commutes_and_repeats_change_nothing(spark):
    a = spark.createDataFrame([("o", 1, 1, 3), ("o", 2, 2, None)], "dim string, x int, z int, found_time long")
    b = spark.createDataFrame([("o", 1, 1, 40), ("o", 2, 2, 9)], "dim string, x int, z int, found_time long")
    got = {tuple(r) for r in H.merge(a, b).collect()}
    assert got == {("o", 1, 1, 3), ("o", 2, 2, 9)} == {tuple(r) for r in H.merge(b, a, b).collect()}
    assert {tuple(r) for r in H.merge(a, b, largest=True).collect()} == {("o", 1, 1, 40), ("o", 2, 2, 9)}


def test_report_adds_up(spark, small):
    from tilelake.plans.views import highlights

    h = highlights(spark, small)
    for r in H.merge_report(h.where("side = 'A'"), h.where("side = 'B'")).collect():
        assert r["dest_after"] == r["dest_before"] + r["source_rows"] - r["overlap"]


def test_live_upsert_keeps_the_oldest(spark):
    schema = "dim string, x int, z int, found_time long"
    table = spark.createDataFrame([("o", 5, 6, 2000), ("o", 1, 1, None)], schema)
    after = H.live_upsert(table, spark.createDataFrame([("o", 5, 6, 1000), ("o", 5, 6, 3000), ("o", 1, 1, 7), ("o", 9, 9, 1)], schema))
    assert {tuple(r) for r in after.collect()} == {("o", 5, 6, 1000, True), ("o", 1, 1, None, False), ("o", 9, 9, 1, True)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "dim string, x int, z int, found_time long")
    assert H.tile_grid(none, 0, 0, 4, 4, "found_time").count() == 0
    assert H.merge(none, none).count() == 0
    assert H.merge_report(none, none).count() == 0


def test_window_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) x", "cast(id as int) z", "id found_time", "id other").write.parquet(f"{tmp_path}/t")
    plan = H.tile_grid(spark.read.parquet(f"{tmp_path}/t"), 0, 0, 4, 4)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,0)" in plan and "found_time" not in plan and "other" not in plan
