"""Binary map regions as tile rows, and tile rows as regions.

A region is decoded by the task that reads it (at most 64 MiB), into one row for each tile: parallel arrays of its 256
pixels, whose states and biomes are indexes into the region's palettes, which are rows of their own. From there on all
work is columnar. Save versions with palettes (majors 4 to 8) are read, 7.8 is written; a stream that ends early gives the
tiles before its end, any other fault a row with its error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilelake.sources.files import open_container

#: Fixed values of the format: bits of a pixel's and of an overlay's parameters, sizes of named binary tags.
NOT_GRASS, OVERLAYS, HEIGHT_BYTE, BIOME, STATE_NEW, BIOME_NEW, BIOME_NUMBER, TOP = (1 << b for b in (0, 1, 6, 20, 21, 22, 23, 24))
O_STATE, O_SKIP, O_OPACITY, O_STATE_NEW = (1 << b for b in (0, 2, 3, 10))
HEIGHT_LOW, HEIGHT_HIGH = 12, 25
TAG_BYTES, ARRAY_BYTES = {1: 1, 2: 2, 3: 4, 4: 8, 5: 4, 6: 8}, {7: 1, 11: 4, 12: 8}
END, STRING, LIST, COMPOUND, DEEPEST = 0, 8, 9, 10, 512
VERSIONED, WRITTEN = 0xFF, (7, 8)

TILES = (
    "path string, chunk_ord int, cx int, cz int, tx int, tz int, interp_version int, cave_start int, cave_depth int, params array<long>, state array<int>, height array<int>, top array<int>, biome array<int>, "
    "overlays array<array<struct<params: long, state: int, opacity: int>>>"
)
PALETTE = "path string, kind string, idx int, raw binary, name string"
PROBE = "path string, major int, minor int, tiles long, truncated boolean, error string"


class Short(Exception):
    """The stream ends within a structure."""


class Stream:
    """Big-endian values from bytes, in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        end = self.at + n
        if n < 0 or end > len(self.data):
            raise Short
        out, self.at = self.data[self.at : end], end
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def short(self) -> int:
        return int.from_bytes(self.take(2), "big")

    def int(self, signed: bool = True) -> int:
        return int.from_bytes(self.take(4), "big", signed=signed)

    def text(self) -> bytes:
        return self.take(self.short())


def java_text(raw: bytes) -> str:
    """Java's modified UTF-8: zero in two bytes, characters beyond the plane as two surrogates."""
    text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass") if raw.isascii() or _sound(raw) else raw.decode("utf-8", "replace")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _sound(raw: bytes) -> bool:
    try:
        raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


def skip_tag(s: Stream, tag: int) -> None:
    """Past the value of a named binary tag; what is still open stands on a list, not on Python's stack."""
    todo: list[list[int]] = [[tag, 1]]  # a tag and how often it follows; compounds end by themselves
    while todo:
        if len(todo) > DEEPEST:
            raise Short
        kind, left = todo[-1]
        if left == 0:
            todo.pop()
        elif kind == COMPOUND and left == -1:  # within a compound: its next entry
            if (inner := s.byte()) == END:
                todo.pop()
            else:
                s.text()
                todo.append([inner, 1])
        else:
            todo[-1][1] -= 1
            if kind in TAG_BYTES:
                s.take(TAG_BYTES[kind] * (1 + todo[-1][1]))
                todo.pop()
            elif kind in ARRAY_BYTES:
                s.take(ARRAY_BYTES[kind] * s.int())
            elif kind == STRING:
                s.text()
            elif kind == LIST:
                inner, n = s.byte(), s.int()
                todo.append([inner, max(0, n)])
            elif kind == COMPOUND:
                todo.append([COMPOUND, -1])
            else:
                raise Short


def state_entry(s: Stream, major: int) -> tuple[bytes, str]:
    """A block state's bytes and name. Major 8 spells its keys anew; here they have the older spelling."""
    start = s.at
    if s.byte() != COMPOUND:
        s.at = start
        if (tag := s.byte()) != END:
            s.text()
            skip_tag(s, tag)
        return s.data[start : s.at], ""
    s.text()
    new = {(STRING, b"id"): b"Name", (COMPOUND, b"properties"): b"Properties"} if major >= 8 else {}
    parts, name = [s.data[start : s.at]], None
    while (tag := s.byte()) != END:
        key = s.text()
        value = s.at
        skip_tag(s, tag)
        if (tag, key) in ((STRING, b"Name"), (COMPOUND, b"Properties")) and major >= 8:
            continue
        key = new.get((tag, key), key)
        if (tag, key) == (STRING, b"Name") and name is None:
            name = java_text(s.data[value + 2 : s.at])
        parts.append(struct.pack(">BH", tag, len(key)) + key + s.data[value : s.at])
    return b"".join(parts) + b"\0", name or ""


def name_entry(name: str) -> bytes:
    """The bytes of a block state that has only a name."""
    raw = name.encode()
    return struct.pack(">BHBH", COMPOUND, 0, STRING, 4) + b"Name" + struct.pack(">H", len(raw)) + raw + b"\0"


class Region:
    """Tiles (in TILES' order, without the path) and palettes of a stream."""

    def __init__(self, data: bytes):
        s, self.tiles, self.truncated = Stream(data), [], False
        self.states: list[tuple[bytes, str]] = []
        self.biomes: list[tuple[bytes, str]] = []
        try:
            if s.byte() != VERSIONED:
                raise ValueError("unsupported: no save version")
            version = s.int(False)
        except Short:
            raise ValueError("no header") from None
        self.major, self.minor = version >> 16, version & 0xFFFF
        if not (4 <= self.major <= 8 and 5 <= self.minor <= 8):
            raise ValueError(f"unsupported: save version {self.major}.{self.minor}")
        try:
            chunk = 0
            while s.at < len(data):
                marker = s.byte()
                if marker & 0x88:
                    raise Short
                for k in range(16):
                    first = s.int(False)
                    if first != 0xFFFFFFFF:
                        self.tiles.append((chunk, marker >> 4, marker & 15, k >> 2, k & 3, *self._tile(s, first)))
                chunk += 1
        except Short:
            self.truncated = True

    def _tile(self, s: Stream, first: int) -> tuple:
        pixels = [self._pixel(s, first if k == 0 else s.int(False)) for k in range(256)]
        version = s.byte()
        start = s.int() if self.minor >= 6 else 2**31 - 1
        depth = s.byte() if self.minor >= 7 else 32
        return version, start, depth, *map(list, zip(*pixels))

    def _state(self, s: Stream, new: bool) -> int:
        if not new:
            return s.int()
        self.states.append(state_entry(s, self.major))
        return len(self.states) - 1

    def _pixel(self, s: Stream, params: int) -> tuple:
        state = self._state(s, bool(params & STATE_NEW)) if params & NOT_GRASS else None
        if params & HEIGHT_BYTE:
            height = s.byte()
        else:
            height = params >> HEIGHT_LOW & 255 | (params >> HEIGHT_HIGH & 15) << 8
            height -= 4096 if height >= 2048 else 0
        top = s.byte() if params & TOP else None
        overlays = [self._overlay(s) for _ in range(s.byte())] if params & OVERLAYS else []
        biome = None
        if params & BIOME:
            if not params & BIOME_NEW:
                biome = s.int()
            else:
                raw = b"#" + str(s.int()).encode() if params & BIOME_NUMBER else s.text()
                self.biomes.append((raw, java_text(raw)))
                biome = len(self.biomes) - 1
        return params, state, height, top, biome, overlays

    def _overlay(self, s: Stream) -> tuple:
        params = s.int(False)
        state = self._state(s, bool(params & O_STATE_NEW)) if params & O_STATE else None
        if params & O_SKIP:
            s.int()
        if self.minor >= 8:
            return params, state, None
        return params, state, s.int() if params & O_OPACITY else 1


_P_KEPT = ~(NOT_GRASS | OVERLAYS | HEIGHT_BYTE | 0xFF << HEIGHT_LOW | BIOME | STATE_NEW | BIOME_NEW | BIOME_NUMBER | TOP | 15 << HEIGHT_HIGH)
_O_KEPT = ~(O_STATE | O_SKIP | O_OPACITY | O_STATE_NEW)


def encode(tiles: list[dict], states: list[bytes], biomes: list[bytes]) -> bytes:
    """A stream of version 7.8; palettes are numbered anew, by first appearance."""
    out = [struct.pack(">BHH", VERSIONED, *WRITTEN)]
    seen: tuple[dict[int, int], dict[int, int]] = ({}, {})

    def entry(kind: int, index: int, source: list[bytes]) -> tuple[bool, bytes]:
        """Whether a palette entry is new, and its bytes or number; what points nowhere stays as it is."""
        if not 0 <= index < len(source):
            return False, struct.pack(">i", index)
        if index in seen[kind]:
            return False, struct.pack(">i", seen[kind][index])
        seen[kind][index] = len(seen[kind])
        return True, source[index] if kind == 0 else struct.pack(">H", len(source[index])) + source[index]

    def pixel(params: int, state: int | None, height: int, top: int | None, biome: int | None, overlays: list) -> None:
        height &= 0xFFF
        flags = params & _P_KEPT | (height & 255) << HEIGHT_LOW | height >> 8 << HEIGHT_HIGH | (TOP if top is not None else 0) | (OVERLAYS if len(overlays) or params & OVERLAYS else 0)
        rest = []
        if state is not None:
            new, raw = entry(0, state, states)
            flags |= NOT_GRASS | (STATE_NEW if new else 0)
            rest.append(raw)
        if top is not None:
            rest.append(bytes([top]))
        if flags & OVERLAYS:
            rest.append(bytes([len(overlays)]))
            for o in overlays:
                own, raw = o["params"] & _O_KEPT, b""
                if o["state"] is not None:
                    new, raw = entry(0, o["state"], states)
                    own |= O_STATE | (O_STATE_NEW if new else 0)
                if o["opacity"] is not None:
                    own = own & ~(15 << 11) | max(0, min(15, o["opacity"])) << 11
                rest.append(struct.pack(">I", own & 0xFFFFFFFF) + raw)
        if biome is not None:
            new, raw = entry(1, biome, biomes)
            flags |= BIOME | (BIOME_NEW if new else 0)
            rest.append(raw)
        out.append(struct.pack(">I", flags & 0xFFFFFFFF) + b"".join(rest))

    chunks: dict[tuple[int, int, int], dict[tuple[int, int], dict]] = {}
    for t in tiles:
        chunks.setdefault((t["chunk_ord"], t["cx"], t["cz"]), {})[t["tx"], t["tz"]] = t
    for (_, cx, cz), own in sorted(chunks.items()):
        out.append(bytes([cx << 4 | cz]))
        for k in range(16):
            t = own.get((k >> 2, k & 3))
            if t is None:
                out.append(b"\xff\xff\xff\xff")
                continue
            for values in zip(t["params"], t["state"], t["height"], t["top"], t["biome"], t["overlays"]):
                pixel(*values)
            out.append(struct.pack(">BiB", t["interp_version"], t["cave_start"], t["cave_depth"]))
    return b"".join(out)


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.replace("params: long, state: int, opacity: int", "").split(",")]


_WHOLE, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_OVERLAYS = pa.list_(pa.list_(pa.struct([("params", pa.int64()), ("state", pa.int32()), ("opacity", pa.int32())])))
_ARROW = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in _names(TILES)[1:9]), ("params", _LONGS), *((c, _WHOLE) for c in ("state", "height", "top", "biome")), ("overlays", _OVERLAYS)])


def tiles(files: DataFrame) -> DataFrame:
    """Tile rows of region files (path, content); undecodable files have none (see probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                region = _opened(content)[0]
                if region and region.tiles:
                    columns = [[path] * len(region.tiles), *map(list, zip(*region.tiles))]
                    columns[-1] = [[[dict(zip(("params", "state", "opacity"), o)) for o in own] for own in t] for t in columns[-1]]
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(columns, _ARROW)], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, TILES)


def palettes(files: DataFrame) -> DataFrame:
    """Palette rows of region files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                region = _opened(content)[0]
                if region:
                    found = [(path, kind, k, raw, name) for kind, own in (("state", region.states), ("biome", region.biomes)) for k, (raw, name) in enumerate(own)]
                    yield pd.DataFrame(found, columns=_names(PALETTE))

    return files.select("path", "content").mapInPandas(run, PALETTE)


def probe(files: DataFrame) -> DataFrame:
    """Version, tiles and state of each region file: what statistics and diagnoses are made of. Of chunks written twice the last counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"]):
                region, error = _opened(content)
                last = {} if region is None else {(t[1], t[2]): t[0] for t in region.tiles}
                n = 0 if region is None else sum(last[t[1], t[2]] == t[0] for t in region.tiles)
                out.append((path, region and region.major, region and region.minor, n, bool(region and region.truncated), error))
            yield pd.DataFrame(out, columns=_names(PROBE))

    return files.select("path", "content").mapInPandas(run, PROBE)


def _opened(content: bytes) -> tuple[Region | None, str | None]:
    try:
        return Region(open_container(bytes(content))), None
    except Exception as e:  # a file of any kind may lie in an archive: its fault is its row
        return None, f"{type(e).__name__}: {e}"


def regions(tile_rows: DataFrame, palette_rows: DataFrame) -> DataFrame:
    """path and stream of each region, from its tiles and palettes; a region is one task's, as one file must be."""

    def build(own: pa.Table, palette: pa.Table) -> pa.Table:
        out: dict[str, list] = {"path": [], "stream": []}
        if own.num_rows:
            entries = {kind: [bytes(r["raw"]) for r in sorted(palette.to_pylist(), key=lambda r: r["idx"]) if r["kind"] == kind] for kind in ("state", "biome")}
            out = {"path": [own.column("path")[0].as_py()], "stream": [encode(own.to_pylist(), entries["state"], entries["biome"])]}
        return pa.table({"path": pa.array(out["path"], pa.string()), "stream": pa.array(out["stream"], pa.binary())})

    own = palette_rows.select(F.col("path").alias("of"), "kind", "idx", "raw")
    return tile_rows.groupBy("path").cogroup(own.groupBy("of")).applyInArrow(build, "path string, stream binary")


def named(tile_rows: DataFrame, palette_rows: DataFrame) -> DataFrame:
    """Tile rows with each pixel's state and biome by name, null where an index points nowhere.

    The palette of a region is one array, joined once for a tile and not once for each pixel.
    """
    by_index = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("idx", "name")))), lambda e: e["name"])
    own = palette_rows.groupBy("path").agg(by_index("state").alias("states"), by_index("biome").alias("biomes"))
    look = lambda column, names: F.transform(column, lambda k: F.when(k >= 0, F.get(F.col(names), k)))
    return tile_rows.join(own, "path", "left").withColumns({"state_name": look("state", "states"), "biome_name": look("biome", "biomes")}).drop("states", "biomes")
