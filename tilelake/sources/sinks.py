"""What an archive is written back as: containers, databases, waypoint files and pictures, as rows of path and content."""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilelake.sources.files import highlight_batch, highlight_database, make_container, pieces

FILES = "path string, content binary"


def png(rgba: np.ndarray) -> bytes:
    """A height x width x 4 array of bytes as PNG."""
    height, width, _ = rgba.shape
    lines = np.zeros((height, 1 + width * 4), np.uint8)
    lines[:, 1:] = rgba.reshape(height, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def tile_pictures(grids: DataFrame, cells: int, rgb: int, tile_size: int = 512) -> DataFrame:
    """path and content (PNG) of each tile of grids (path, cell_x, cell_z, alpha): cells in one colour, by alpha."""
    scale = tile_size // cells

    def paint(group: pd.DataFrame) -> pd.DataFrame:
        picture = np.zeros((cells, cells, 4), np.uint8)
        picture[group["cell_z"], group["cell_x"], :3] = [rgb >> 16, rgb >> 8 & 255, rgb & 255]
        picture[group["cell_z"], group["cell_x"], 3] = group["alpha"]
        return pd.DataFrame({"path": [group["path"].iloc[0]], "content": [png(picture.repeat(scale, 0).repeat(scale, 1))]})

    return grids.groupBy("path").applyInPandas(paint, FILES)


def containers(streams: DataFrame) -> DataFrame:
    """Region streams (path, stream) in their containers."""

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(((p.as_py(), make_container(s.as_py())) for b in batches for p, s in zip(b["path"], b["stream"])), schema)

    return streams.select("path", "stream").mapInArrow(run, FILES)


def databases(highlights: DataFrame) -> DataFrame:
    """One SQLite file for each path of highlights (path, dim, x, z, found_time). A file is built by one task, as it must
    be; give large worlds a path for each square of regions."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [group["path"].iloc[0]], "content": [highlight_database(dict(tuple(group.groupby("dim"))))]})

    return highlights.select("path", "dim", "x", "z", "found_time").groupBy("path").applyInPandas(build, FILES)


def batches(highlights: DataFrame, most: int = 4096) -> DataFrame:
    """dim and body of client batches of at most most rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for dim, group in rows.groupby("dim"):
                cut = [group.iloc[k : k + most] for k in range(0, len(group), most)]
                yield pd.DataFrame({"dim": dim, "body": [highlight_batch(g["x"], g["z"], g["found_time"]) for g in cut]})

    return highlights.select("dim", "x", "z", "found_time").mapInPandas(run, "dim string, body binary")


def waypoint_files(lines: DataFrame) -> DataFrame:
    """Lines (path, ord, line) as one text for each path, in order."""
    return lines.groupBy("path").agg(F.encode(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), "\n"), F.lit("\n")), "UTF-8").alias("content"))


def save(files: DataFrame, root: str) -> DataFrame:
    """Write files (path, content) below root, a folder that all executors share; path and bytes of each.

    Each is written beside its place and renamed, so a task that is run again leaves whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                place = os.path.join(root, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with tempfile.NamedTemporaryFile(dir=os.path.dirname(place), suffix=".tmp-xt", delete=False) as f:
                    f.write(content)
                os.replace(f.name, place)
            yield pd.DataFrame({"path": rows["path"], "bytes": [len(c) for c in rows["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, bytes long")
