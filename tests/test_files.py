"""File forms: what is written can be read back, and what is broken is a row with its error."""

import io
import sqlite3
import zipfile

import numpy as np
import pandas as pd
import pytest

from tilelake.sources import files, sinks


def test_container_round_trip():
    assert files.open_container(files.make_container(b"stream")) == b"stream"
    assert files.open_container(b"bare") == b"bare"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("first", b"1")
        z.writestr(files.REGION_ENTRY, b"2")
    assert files.open_container(other.getvalue()) == b"2"


def test_bad_container_is_a_row(spark, tmp_path):
    (tmp_path / "0_0.zip").write_bytes(b"PK broken")
    (tmp_path / "1_0.xaero").write_bytes(b"ok")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.containers(files.contents(spark, str(tmp_path))).collect()}
    assert bytes(rows["1_0.xaero"]["stream"]) == b"ok" and rows["1_0.xaero"]["error"] is None
    assert rows["0_0.zip"]["stream"] is None and "Bad" in rows["0_0.zip"]["error"]


def test_region_listing(spark, tmp_path):
    layer = tmp_path / "w" / "null"
    layer.mkdir(parents=True)
    for name in ("0_0.zip", "0_0.xaero", "-1_2.zip", "3_3.zip.tmp", "readme.txt", "1_1.sync-conflict-1-A.zip"):
        (layer / name).write_bytes(b"x")
    from tilelake.operators.index import best_files

    got = {(r["rx"], r["rz"], r["is_zip"]) for r in best_files(files.region_files(spark, str(tmp_path))).collect()}
    assert got == {(0, 0, True), (-1, 2, True)}


def test_highlight_batches():
    body = files.highlight_batch(np.array([1, -2]), np.array([3, 4]), np.array([5, 6]))
    assert [tuple(r) for r in files.highlight_rows(body)] == [(1, 3, 5), (-2, 4, 6)]
    for bad in (b"", b"XTHX" + body[4:], body[:4] + b"\2" + body[5:], body + b"1", files.highlight_batch(np.array([-(1 << 31)]), np.array([0]), np.array([0]))):
        with pytest.raises(ValueError):
            files.highlight_rows(bad)


def test_preview_batches():
    body = b"XTPV" + bytes([1]) + (1).to_bytes(2, "little") + np.array([7, -8], "<i4").tobytes() + np.full(256, 0xF800, "<u2").tobytes()
    (chunk,) = files.preview_chunks(body)
    assert (chunk["cx"], chunk["cz"]) == (7, -8) and set(chunk["rgb565"]) == {0xF800}
    with pytest.raises(ValueError):
        files.preview_chunks(body[:-1])


def test_highlight_databases(spark, tmp_path):
    (tmp_path / "a.db").write_bytes(files.highlight_database({"minecraft:the_end": pd.DataFrame({"x": [1], "z": [2], "found_time": [3]})}))
    old = sqlite3.connect(tmp_path / "b.db")
    old.execute('create table "-1" (x integer, z integer, foundTime integer)')
    old.execute('create table "-1_v2_migration" (x integer, z integer, foundTime integer)')
    old.execute('insert into "-1" values (4, 5, 6)')
    old.execute('insert into "-1_v2_migration" values (9, 9, 9)')
    old.commit()
    old.close()
    dbs = files.contents(spark, str(tmp_path), "*.db")
    assert {(r["dim"], r["x"], r["z"], r["found_time"]) for r in files.highlight_databases(dbs).collect()} == {("minecraft:the_end", 1, 2, 3), ("minecraft:the_nether", 4, 5, 6)}
    assert {(r["dim"], r["rows"], r["version"]) for r in files.highlight_database_info(dbs).collect()} == {("minecraft:the_end", 1, 2), ("minecraft:the_nether", 1, 0)}


def test_drawing_databases(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "d.db")
    db.execute('create table "minecraft:overworld-highlights" (x integer, z integer, color integer)')
    db.execute('insert into "minecraft:overworld-highlights" values (1, 2, -1)')
    db.commit()
    db.close()
    got = files.drawing_databases(files.contents(spark, str(tmp_path)), "highlights").collect()
    assert [(r["dim"], r["x"], r["z"], r["color"]) for r in got] == [("minecraft:overworld", 1, 2, 0xFFFFFFFF)]


def test_pictures_and_saving(spark, tmp_path):
    grid = spark.createDataFrame([("a/t.png", 0, 1, 110)], "path string, cell_x int, cell_z int, alpha int")
    pictures = sinks.tile_pictures(grid, 2, 0x010203, 4)
    assert [tuple(r) for r in sinks.save(pictures, str(tmp_path)).collect()][0][0] == "a/t.png"
    assert (tmp_path / "a/t.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    assert not list(tmp_path.rglob("*.tmp-xt"))


def test_waypoint_text_round_trip(spark, tmp_path):
    from tilelake.operators import waypoints as W

    lines = ["sets:gui.default", "waypoint:a§§b:A:1:~:-2:21:true:0:gui.default:false:0:0:true", "waypoint:short:A:1", "waypoint:x:A:1.5:2:3:0:false:0:s"]
    (tmp_path / "mw_1.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = W.parse(files.text_lines(spark, str(tmp_path)))
    (r,) = got.withColumns({"again": W.format_line(), "rgb": W.colour(got["color"])}).collect()
    assert (r["name"], r["y"], r["z"], r["disabled"], r["destination"], r["rgb"]) == ("a:b", None, -2, True, True, "#0000aa")
    assert r["again"] == lines[1]


def test_sums_of_times_beyond_64_bits(spark, tmp_path):
    """Times whose sum no bigint holds come out whole; sums that fit one are bigints."""
    from tilelake.plans.file_queries import summed_times

    rows = spark.createDataFrame([("a", 1, 2, 1 << 62), ("a", 1, 3, 1 << 62), ("a", 1, 4, 5), ("b", 0, 0, 7)], "dim string, x int, z int, found_time long")
    found = summed_times(rows, f"file://{tmp_path}/large")
    assert {tuple(map(str, r)) for r in found.collect()} == {("a", "3", str((1 << 63) + 5), "3009"), ("b", "1", "7", "0")}
    found = summed_times(rows.where("dim = 'b'"), f"file://{tmp_path}/small")
    assert found.dtypes == [("dim", "string"), ("n", "bigint"), ("time", "bigint"), ("place", "bigint")] and found.first()["time"] == 7


def test_containers_leave_workers_in_pieces():
    """Rows go on in batches bounded by bytes, a larger row by itself, and none is lost."""
    import pyarrow as pa

    from tilelake.sources.files import pieces

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    rows = [(str(k), bytes(n)) for k, n in enumerate([400] * 10 + [5000, 0, 10])]
    found = list(pieces(iter(rows), schema, 1000))
    assert [r for b in found for r in zip(b["path"].to_pylist(), b["content"].to_pylist())] == rows
    assert all(b.num_rows == 1 or sum(len(c) for c in b["content"].to_pylist()) <= 1000 for b in found)
    assert list(pieces(iter([]), schema)) == []
