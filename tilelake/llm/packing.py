"""Packing: token ids of documents laid into sequences of at most 1024, by bounded-space best fit.

Each partition keeps a fixed number of open windows. Whole sequences are cut off a document first; the rest goes to the
window that it fills best. Where it fits none and no further window may be opened, the fullest is emitted: its gap is
first filled by a cut of the rest if that is SHORTEST_CUT ids or more. Windows still open at a partition's end are
leftovers: those of neighbouring partitions are merged, longest piece first, into the window that each fills best.

The first pass is written to the shared folder before leftovers are merged, so that lost executors cannot deal the rows
another way in between. No task holds more than one batch of texts, the open windows, or one group's leftovers.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed like others; documents of
any length are cut; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.common import slices, stage, table

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE, END_ID = 1024, 0
OPEN_WINDOWS, SHORTEST_CUT = 64, 16
LONG_SPACE = 1000
#: Partitions whose leftovers one group merges; its windows' rows are at most so many times OPEN_WINDOWS windows' pieces.
MERGED_PARTITIONS = 32
#: Sequence ids hold a partition's number above so many bits; merged sequences count partitions from FIRST_MERGED.
ID_BITS, FIRST_MERGED = 40, 1 << 21

_long_space = re.compile(rf"\s{{{LONG_SPACE}}}")
_encoders: dict[str, Callable[[str], bytes]] = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"


def _byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, where merges come in the order of their ids and the pattern is the public one."""
    with open(path, "rb") as f:
        own = json.load(f)
    split, vocabulary = own["pre_tokenizer"] or {}, own["model"].get("vocab", {})
    if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or own["normalizer"]:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"]]
    made = [vocabulary["".join(m)] for m in pairs]
    special = {t["content"] for t in own["added_tokens"]}
    ordinary = {t: i for t, i in vocabulary.items() if t not in special}
    if made != sorted(made) or len(made) + 256 != len(ordinary):
        return None
    byte = _byte_characters()
    return {bytes(byte[c] for c in t): i for t, i in ordinary.items()}


def encoder(path: str) -> Callable[[str], bytes]:
    """Texts to ids as bytes (little-endian, 32 bits); special strings are ordinary text.

    The ids are those of the tokenizers library. Where its file states merges that stand in the order of their ids, all of
    its vocabulary and the public pattern, tiktoken gives the same ids for these ranks in a quarter of the time and takes
    over, but for texts with a run of LONG_SPACE white-space characters or more, on which its pattern's engine gives up.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        own, ranks = Tokenizer.from_file(path), _ranks(path)
        own.encode_special_tokens = True
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

        def encode(text: str) -> bytes:
            if fast is None or _long_space.search(text):
                return array("I", own.encode(text, add_special_tokens=False).ids).tobytes()
            return array("I", fast.encode_ordinary(text)).tobytes()

        _encoders[path] = encode
    return _encoders[path]


class Windows:
    """The open windows of one partition; a piece is (row, start, length)."""

    def __init__(self, most: int = OPEN_WINDOWS, size: int = SEQUENCE):
        self.most, self.size = most, size
        self.gaps: list[tuple[int, int]] = []  # (ids still free, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, row: tuple, total: int) -> Iterator[list[tuple]]:
        """Lay a document of total ids; yields the sequences that close."""
        start = 0
        while total - start >= self.size:
            yield [(row, start, self.size)]
            start += self.size
        while start < total:
            need = total - start
            k = bisect.bisect_left(self.gaps, (need, -1))
            if k < len(self.gaps):
                gap, window = self.gaps.pop(k)
            elif len(self.gaps) < self.most:
                gap, window = self.size, self.opened
                self.held[window] = []
                self.opened += 1
            else:
                gap, window = self.gaps.pop(0)
                if gap < SHORTEST_CUT:
                    yield self.held.pop(window)
                    continue
            length = min(need, gap)
            self.held[window].append((row, start, length))
            start += length
            if length == gap:
                yield self.held.pop(window)
            else:
                bisect.insort(self.gaps, (gap - length, window))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, partition int, leftover boolean"


def _rows(sequences: list[tuple[int, list[tuple]]], partition: int, leftover: bool, with_ids: bool) -> pa.RecordBatch:
    out: dict[str, list] = {c.split()[0]: [] for c in _PIECES.split(", ")}
    for number, pieces in sequences:
        offset = 0
        for (doc, ids), start, length in pieces:
            own = memoryview(ids)[4 * start : 4 * (start + length)]
            values = (doc, start, length, zlib.crc32(own), len(ids) // 4, number, offset, bytes(own) if with_ids else None, partition, leftover)
            for c, v in zip(out.values(), values):
                c.append(v)
            offset += length
    types = {"ids": pa.binary(), "partition": pa.int32(), "leftover": pa.bool_()}
    return pa.record_batch({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})


def _pack(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, windows, encode, number = TaskContext.get().partitionId(), Windows(), encoder(path), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                done = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    for pieces in windows.add((doc, ids), len(ids) // 4):
                        done.append(((partition << ID_BITS) + number, pieces))
                        number += 1
                yield _rows(done, partition, False, with_ids)
        rest = [((partition << ID_BITS) + number + k, pieces) for k, pieces in enumerate(windows.held.values())]
        yield _rows(rest, partition, True, with_ids)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """The leftover pieces of some partitions, longest first, each in the window that it fills best."""
    lengths = group.column("length").to_numpy()
    ids, docs, starts = (group.column(c).to_pylist() for c in ("sequence_id", "doc_id", "start"))
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], docs[k] is None, docs[k] or 0, starts[k], ids[k]))
    first = (FIRST_MERGED + group.column("partition")[0].as_py() // MERGED_PARTITIONS) << ID_BITS
    gaps: list[tuple[int, int]] = []
    opened = 0
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order:
        at = bisect.bisect_left(gaps, (int(lengths[k]), -1))
        if at < len(gaps):
            gap, window = gaps.pop(at)
        else:
            gap, window, opened = SEQUENCE, opened, opened + 1
        number[k], offset[k] = first + window, SEQUENCE - gap
        bisect.insort(gaps, (gap - int(lengths[k]), window))
    return group.set_column(group.schema.get_field_index("sequence_id"), "sequence_id", pa.array(number)).set_column(group.schema.get_field_index("offset"), "offset", pa.array(offset))


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    path = path or public_tokenizers.path(TOKENIZER)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(docs.mapInArrow(_pack(path, with_ids), _PIECES))
    group = F.floor(F.col("partition") / MERGED_PARTITIONS)
    merged = pieces.where("leftover").groupBy(group).applyInArrow(_merge, pieces.schema)
    return pieces.where("not leftover").unionByName(merged).drop("partition", "leftover", *([] if with_ids else ["ids"]))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
