"""Byte-level BPE by longest matches: encode with an Aho-Corasick automaton and backtracking, decode by table.

A token string is the BPE encoding of its bytes exactly if each two neighbours are compatible: encoding the two tokens'
joined bytes gives these two again. Encoding therefore goes left to right, always with the longest token that matches
here and is compatible with the one before; where none is left it steps back and takes the next shorter one. A position
whose tokens all failed is never tried again, so the work is linear in the bytes. Compatibility of two tokens is found
by undoing their merges along the seam, and memoised. The automaton (pyahocorasick) holds the vocabulary as Latin-1
strings, one character a byte.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.common import slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most entries of each memo in a worker (about 150 bytes each); a full memo starts anew.
MEMO = 600_000


class Bpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        import ahocorasick  # in workers only

        self.automaton = ahocorasick.Automaton()
        for text, i in ranks.items():
            self.automaton.add_word(text, (i, len(text) - 1))
        self.automaton.make_automaton()
        self.lengths = {i: len(t) for t, i in ranks.items()}
        #: For each token, the longest other token that is a prefix of it.
        self.shorter: dict[int, int] = {}
        for text, i in ranks.items():
            for n in range(len(text) - 1, 0, -1):
                if (k := ranks.get(text[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.parts = self._parts()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token: lower ranks only, and themselves compatible."""
        parts: dict[int, tuple[int, int]] = {}
        for text, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            for n in range(1, len(text)):
                a, b = self.ranks.get(text[:n]), self.ranks.get(text[n:])
                if a is not None and b is not None and a < i and b < i and self._fits(a, b, i, parts):
                    parts[i] = (a, b)
                    break
        return parts

    def _fits(self, left: int, right: int, limit: int, parts: dict[int, tuple[int, int]]) -> bool:
        """Whether left and right stay apart: no merge over their seam precedes one that made them, or limit.

        The later merge of the two tokens at the seam is undone, again and again. Of equal merges the one further left
        comes first, so one over the seam precedes an equal one inside the right token.
        """
        ranks, tokens = self.ranks, self.tokens
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            if left in parts and (left > right or right not in parts):
                limit, left = left, parts[left][1]
            elif right in parts:
                limit, right = right + 1, parts[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[left, right] = self._fits(left, right, 1 << 40, self.parts)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 of its UTF-8 bytes."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, tokens, shorter, pairs = len(piece), self.lengths, self.shorter, self.pairs
        longest = [0] * size
        for last, (i, back) in self.automaton.iter(piece):
            longest[last - back] = i  # ends ascend: the last match from a position is its longest
        failed, out, at, token, before = set(), [], 0, longest[0], -1
        while True:
            end = at + tokens[token]
            if end not in failed:
                if before < 0:
                    fits = True
                elif (fits := pairs.get((before, token))) is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return out
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter.get(token, -1)
            if token < 0:  # no token fits here: step back
                failed.add(at)
                token = out.pop()
                at -= tokens[token]
                before = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        memo, out = self.pieces, []
        for piece in self.pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = array("I", self.encode_piece(piece if piece.isascii() else piece.encode().decode("latin-1"))).tobytes()
                if len(piece) <= 64:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return "".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).encode("latin-1")


class Spaced:
    """Encodes a text by its runs between single spaces, each run once: the pattern never joins what such a space parts.

    A space between two characters that are not white space opens a new match of the pattern, so the runs' ids one after
    another are the text's.
    """

    def __init__(self, encode, most: int = MEMO):
        self.encode, self.most, self.runs = encode, most, {}

    def __call__(self, text: str) -> bytes:
        runs = text.replace(" ", "\0 ").split("\0") if "\0" not in text and not _odd.search(text) else _apart.split(text)
        memo, missing = self.runs, None
        try:
            return b"".join([memo[r] for r in runs])
        except KeyError:
            missing = [r for r in dict.fromkeys(runs) if r not in memo]
        found = self.encode(missing)
        own = dict(zip(missing, found))
        out = b"".join([own[r] if r in own else memo[r] for r in runs])
        if len(memo) + len(own) > self.most:
            memo.clear()
        memo.update((r, i) for r, i in own.items() if len(r) <= 64)
        return out


#: White space next to a space, or at an end: then runs are found one by one.
_odd = re.compile(r" \s|[^\S ] |^\s|\s$")
_apart = re.compile(r"(?<=\S)(?= \S)")
assert array("I").itemsize == 4 and sys.byteorder == "little"
_known: dict[str, tuple[Bpe, Spaced]] = {}


def bpe(path: str) -> tuple[Bpe, Spaced]:
    """The vocabulary at path, once for each worker."""
    if path not in _known:
        own = Bpe(path)
        _known[path] = own, Spaced(lambda runs: [own.encode(r) for r in runs])
    return _known[path]


def _codec(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encode = bpe(path)
        for batch in batches:
            for part in slices(batch):
                ids = [encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([own.decode(i) for i in ids], pa.binary())})

    return run


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers as binary) and decoded (the bytes that they stand for).

    A null text counts as empty and has no ids; repeated rows stay; null ids pass through; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select("doc_id", "text").mapInArrow(_codec(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
