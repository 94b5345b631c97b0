"""Coordinates: blocks, chunks (16 blocks), regions (32 chunks) and buckets of 64 regions, by floor division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION_BLOCKS, REGION_CHUNKS, BUCKET_REGIONS = 512, 32, 64


def floor_div(x: Column, n: int) -> Column:
    """Quotient rounded down, also for negative x; powers of two are shifts."""
    if n & (n - 1) == 0:
        return F.shiftright(x, n.bit_length() - 1)
    return F.floor(x / n)


def region_of_block(x: Column) -> Column:
    return floor_div(x, REGION_BLOCKS)


def region_of_chunk(x: Column) -> Column:
    return floor_div(x, REGION_CHUNKS)


def bucket_of_region(x: Column) -> Column:
    return floor_div(x, BUCKET_REGIONS)


def cell_pixels(zoom: int) -> int:
    """Pixels of one region in a tile of 512 at zoom <= 0."""
    return 512 >> -zoom if zoom > -10 else 0


def signed12(raw: Column) -> Column:
    """A height of twelve bits with sign."""
    return raw - F.when(raw >= 2048, 4096).otherwise(0)


def pixel_fields(params: Column) -> dict[str, Column]:
    """Fields packed in a pixel's parameters."""
    bit = lambda n: F.shiftrightunsigned(params, n).bitwiseAND(1) == 1
    low, high = F.shiftright(params, 12).bitwiseAND(255), F.shiftright(params, 25).bitwiseAND(15)
    return {"grass": ~bit(0), "overlays": bit(1), "cave": bit(7), "light": F.shiftright(params, 8).bitwiseAND(15), "height": signed12(high * 256 + low), "biome": bit(20)}


def rgb565(v: Column) -> dict[str, Column]:
    """Channels of a 16-bit colour, scaled to 0..255 and rounded."""
    parts = {"r": (F.shiftright(v, 11).bitwiseAND(31), 31), "g": (F.shiftright(v, 5).bitwiseAND(63), 63), "b": (v.bitwiseAND(31), 31)}
    return {k: F.floor((p * 255 + top // 2) / top).cast("int") for k, (p, top) in parts.items()}
