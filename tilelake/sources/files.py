"""Archive files as DataFrames: listings, containers, databases, client batches, text and JSON.

Contents are read by Spark's binary and text sources, so paths may lie in any store; decoders get bytes, never paths. A
file that cannot be decoded becomes a row with its error, and other files go on.
"""

from __future__ import annotations

import ctypes
import io
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.functions import naming as N
from tilelake.operators.highlights import LEGACY_DIMENSIONS

#: Fixed values of the formats.
REGION_ENTRY, MOST_STREAM = "region.xaero", 64 << 20
HIGHLIGHT_MAGIC, PREVIEW_MAGIC, BATCH_VERSION = b"XTHL", b"XTPV", 1
MOST_ROWS, MOST_CHUNKS, MOST_COORDINATE = 4096, 256, 2_600_000
ROWS_A_BATCH, PIECE_BYTES = 50_000, 8 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, name, mtime_ms, size of all files below root that aren't empty; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        "path", F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"),
        F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"),
    )


def region_files(spark: SparkSession, root: str) -> DataFrame:
    """Region files below root: layer (their folder), rx, rz, mtime_ms, size, is_zip, path; transient files are left out."""
    files = listing(spark, root).where(~N.is_transient(F.col("name")))
    rx, rz, zipped = N.region_coordinates(F.col("name"))
    out = files.withColumns({"rx": rx, "rz": rz, "is_zip": zipped}).where("rx is not null")
    return out.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("layer"), "rx", "rz", "mtime_ms", "size", "is_zip", "path", F.xxhash64("path").alias("ord"))


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def open_container(data: bytes) -> bytes:
    """The stream of a region container: the entry of its name in a zip, else the first; other bytes are the stream."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if not names:
                raise ValueError("empty container")
            with z.open(REGION_ENTRY if REGION_ENTRY in names else names[0]) as f:
                data = f.read(MOST_STREAM + 1)
    if len(data) > MOST_STREAM:
        raise ValueError(f"more than {MOST_STREAM} bytes")
    return bytes(data)


def make_container(stream: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(REGION_ENTRY), stream, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def containers(files: DataFrame) -> DataFrame:
    """path, stream, error of files (path, content)."""

    schema = pa.schema([("path", pa.string()), ("stream", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces((_tried(p.as_py(), c.as_py(), open_container) for b in batches for p, c in zip(b["path"], b["content"])), schema)

    return files.select("path", "content").mapInArrow(run, "path string, stream binary, error string")


def pieces(rows: Iterable[tuple], schema: pa.Schema, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some most bytes, or one larger row; freed memory is given back after each.

    A worker holds what Spark sends at a time, which it doesn't copy, and one such batch, however many files there are.
    """
    own, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, f.type) for column, f in zip(zip(*own), schema)], schema=schema)

    for row in rows:
        wide = sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if own and size + wide > most:
            yield batch()
            own, size = [], 0
            _give_back()
        own.append(row)
        size += wide
    if own:
        yield batch()
        own = []
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _tried(path: str, data: bytes, decode: Callable[[bytes], bytes]) -> tuple:
    try:
        return path, decode(data), None
    except (ValueError, OSError, zipfile.BadZipFile, NotImplementedError) as e:
        return path, None, f"{type(e).__name__}: {e}"


def highlight_rows(body: bytes) -> np.ndarray:
    """x, z, found_time of a client's batch; ValueError if it isn't whole and in range."""
    if len(body) < 7 or body[:4] != HIGHLIGHT_MAGIC:
        raise ValueError("bad magic")
    if body[4] != BATCH_VERSION:
        raise ValueError("unsupported batch version")
    n = int.from_bytes(body[5:7], "little")
    if n > MOST_ROWS or len(body) != 7 + 16 * n:
        raise ValueError("batch length does not match its count")
    rows = np.frombuffer(body, np.dtype([("x", "<i4"), ("z", "<i4"), ("found_time", "<i8")]), n, 7)
    if n and max(np.abs(rows[c].astype(np.int64)).max() for c in ("x", "z")) > MOST_COORDINATE:
        raise ValueError("chunk coordinates out of range")
    return rows


def highlight_batch(x: np.ndarray, z: np.ndarray, found_time: np.ndarray) -> bytes:
    rows = np.empty(len(x), np.dtype([("x", "<i4"), ("z", "<i4"), ("found_time", "<i8")]))
    rows["x"], rows["z"], rows["found_time"] = x, z, found_time
    return HIGHLIGHT_MAGIC + bytes([BATCH_VERSION]) + len(rows).to_bytes(2, "little") + rows.tobytes()


def preview_chunks(body: bytes) -> np.ndarray:
    """cx, cz and 256 16-bit colours of each chunk of a preview batch."""
    n = int.from_bytes(body[5:7], "little")
    if body[:4] != PREVIEW_MAGIC or body[4] != BATCH_VERSION or not 1 <= n <= MOST_CHUNKS or len(body) != 7 + 520 * n:
        raise ValueError("bad preview batch")
    return np.frombuffer(body, np.dtype([("cx", "<i4"), ("cz", "<i4"), ("rgb565", "<u2", 256)]), n, 7)


def decoded_batches(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batches (keys, body): keys, x, z, found_time, error; a bad batch is one row with its error."""
    types = {k: batches.schema[k].dataType.simpleString() for k in keys}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for key, body in zip(rows[keys].itertuples(index=False), rows["body"]):
                try:
                    out = pd.DataFrame(highlight_rows(bytes(body))).assign(error=None)
                except ValueError as e:
                    out = pd.DataFrame({"x": [None], "z": [None], "found_time": [None], "error": [str(e)]})
                yield out.assign(**dict(zip(keys, key)))[[*keys, "x", "z", "found_time", "error"]]

    schema = ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", x int, z int, found_time long, error string"
    return batches.select(*keys, "body").mapInPandas(run, schema)


# --- SQLite files -----------------------------------------------------------------------------------------------------

_SKIPPED = re.compile(r"^(?:sqlite_.*|metadata|.*_v2_migration)$")
DRAWING = {"highlights": "x, z, color", "lines": "x1, z1, x2, z2, color", "texts": "value, x, z, color, scale", "ellipses": "centerX, centerZ, radiusX, radiusZ, color"}


def _opened(data: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    db.execute("pragma query_only = on")
    return db


def _tables(db: sqlite3.Connection) -> list[str]:
    names = [n for (n,) in db.execute("select name from sqlite_master where type = 'table' order by name")]
    return [n for n in names if not _SKIPPED.match(n)]


def _columns(db: sqlite3.Connection, name: str) -> list[str]:
    quoted = name.replace('"', '""')
    return [r[1] for r in db.execute(f'pragma table_info("{quoted}")')]


def highlight_databases(files: DataFrame) -> DataFrame:
    """path, dim, x, z, found_time, ord of all highlight tables in SQLite files (path, content), old table names resolved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, data in zip(rows["path"], rows["content"]):
                db = _opened(bytes(data))
                for name in _tables(db):
                    if {"x", "z", "foundTime"} <= set(_columns(db, name)):
                        quoted = name.replace('"', '""')
                        cursor, at = db.execute(f'select x, z, foundTime from "{quoted}"'), 0
                        while found := cursor.fetchmany(ROWS_A_BATCH):
                            out = pd.DataFrame(found, columns=["x", "z", "found_time"])
                            yield out.assign(path=path, dim=LEGACY_DIMENSIONS.get(name, name), ord=range(at, at + len(out)))[["path", "dim", "x", "z", "found_time", "ord"]]
                            at += len(out)

    return files.select("path", "content").mapInPandas(run, "path string, dim string, x int, z int, found_time long, ord long")


def highlight_database_info(files: DataFrame) -> DataFrame:
    """path, dim, rows and version of each highlight table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, data in zip(rows["path"], rows["content"]):
                db = _opened(bytes(data))
                known = db.execute("select count(*) from sqlite_master where name = 'metadata'").fetchone()[0]
                version = (db.execute("select max(version) from metadata").fetchone()[0] or 0) if known else 0
                out = [(path, LEGACY_DIMENSIONS.get(n, n), db.execute('select count(*) from "{}"'.format(n.replace('"', '""'))).fetchone()[0], version) for n in _tables(db)]
                yield pd.DataFrame(out, columns=["path", "dim", "rows", "version"])

    return files.select("path", "content").mapInPandas(run, "path string, dim string, rows long, version int")


def drawing_databases(files: DataFrame, family: str) -> DataFrame:
    """path, dim and the columns of one family of drawings; colours are unsigned."""
    columns = DRAWING[family].split(", ")
    kinds = {"value": "string", "scale": "double"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, data in zip(rows["path"], rows["content"]):
                db = _opened(bytes(data))
                for name in _tables(db):
                    if name.endswith(f"-{family}"):
                        found = db.execute('select {} from "{}"'.format(", ".join(columns), name.replace('"', '""'))).fetchall()
                        out = pd.DataFrame(found, columns=columns)
                        out["color"] = out["color"].astype("int64") & 0xFFFFFFFF
                        yield out.assign(path=path, dim=name[: -len(family) - 1])[["path", "dim", *columns]]

    schema = "path string, dim string, " + ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in columns)
    return files.select("path", "content").mapInPandas(run, schema)


def highlight_database(tables: dict[str, pd.DataFrame]) -> bytes:
    """A SQLite file of version 2: one table (x, z, foundTime) for each dimension."""
    db = sqlite3.connect(":memory:")
    db.execute("create table metadata (id integer primary key, version integer)")
    db.execute("insert into metadata values (0, 2)")
    for dim, rows in tables.items():
        quoted = dim.replace('"', '""')
        db.execute(f'create table "{quoted}" (x integer, z integer, foundTime integer, primary key (x, z)) without rowid')
        db.executemany(f'insert into "{quoted}" values (?, ?, ?)', rows[["x", "z", "found_time"]].sort_values(["x", "z"]).itertuples(index=False, name=None))
    db.commit()
    return db.serialize()


# --- text and JSON ----------------------------------------------------------------------------------------------------


def text_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, ord, line of text files, in file order."""
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return lines.where("line <> ''")


def pearls(texts: DataFrame, column: str = "json") -> DataFrame:
    """owner, pearl and its place, of JSON maps {owner: {pearl: {uuid, dimensionKey, x, y, z}}}; bad JSON has no rows."""
    kind = "map<string, map<string, struct<uuid: string, dimensionKey: string, x: int, y: int, z: int>>>"
    kept = [c for c in texts.columns if c != column]
    owners = texts.select(*kept, F.explode(F.from_json(column, kind)).alias("owner", "own"))
    return owners.select(*kept, "owner", F.explode("own").alias("pearl", "p")).select(*kept, "owner", "pearl", "p.*")


def points_of_interest(spark: SparkSession, path: str) -> DataFrame:
    """Atlas places with a name and finite coordinates; tags are split at commas."""
    schema = "name string, x double, y double, z double, dimension double, tags string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("x", "y", "z", "dimension")]
    return rows.where(F.col("name").isNotNull()).where(finite[0] & finite[1] & finite[2] & finite[3]).withColumn("tags", F.split(F.coalesce("tags", F.lit("")), " *, *"))


def dimension_settings(lines: DataFrame) -> DataFrame:
    """Settings of a dimension: kind (name, cave_mode, type, other), id, value of each line (path, ord, line)."""
    line = F.col("line")
    rest = F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1)
    mode = line.startswith("caveModeType:") & rest.rlike("^-?[0-9]+$")
    kind = F.when(line.startswith("MWName:"), "name").when(mode, "cave_mode").when(line.startswith("dimensionTypeId:"), "type").otherwise("other")
    name = F.replace(F.regexp_extract(rest, "(?s)^[^:]*:(.*)$", 1), F.lit("^col^"), F.lit(":"))
    out = lines.withColumn("kind", kind)
    return out.withColumns({"id": F.when(F.col("kind") == "name", F.substring_index(rest, ":", 1)), "value": F.when(F.col("kind") == "name", name).when(F.col("kind") == "other", line).otherwise(rest)})


def report(rows: DataFrame) -> DataFrame:
    """Rows as JSON, one object a line."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


