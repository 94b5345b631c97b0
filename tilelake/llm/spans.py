"""Spans of pattern matches in code points, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Stands for a separator inside a match; such characters in a text itself are first replaced by another of their length.
MARK, OTHER = "\ue000", "\u00a4"
#: Code points in a block of a text.
BLOCK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array's numbers, the fold by op (associative, with zero) of those before it, and of all as a last one.

    Arrays can only be extended by copying them, so numbers are folded in blocks of about the root of their count, then
    the blocks' folds: n numbers take n^1.5 copies, not n^2.
    """

    def steps(own: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(own, F.array(F.lit(zero)), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), value(x)))))

    def fold(own: Column) -> Column:
        n = F.size(own)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        inner = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: steps(F.slice(own, b * width + 1, width), lambda x: x))
        return let(inner, lambda i: let(steps(i, lambda s: F.element_at(s, -1)), lambda before: F.concat(flat(i, before), F.slice(before, -1, 1))))

    def flat(inner: Column, before: Column) -> Column:
        return F.flatten(F.transform(inner, lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: op(F.get(before, k), x))))

    return let(values, lambda own: F.when(F.size(own) > 0, fold(own)).otherwise(F.array(F.lit(zero))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def find(df: DataFrame, out: str, text: str, pattern: str, where: Column | None = None) -> DataFrame:
    """df with out: start, end (code points, end exclusive) and text of all matches, leftmost first, not overlapping.

    The parts between matches and the matches themselves alternate, so their lengths add up to the positions. Texts for
    which where is false, and null texts, have no matches.
    """
    test = F.col(text).isNotNull() if where is None else F.col(text).isNotNull() & where
    df = df.withColumn("__match", F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.size("__match") > 0
    df = df.withColumn("__part", F.when(some, F.slice(F.split(text, pattern, -1), F.lit(1), F.size("__match"))))
    df = df.withColumn("__size", F.when(some, F.zip_with("__part", "__match", lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))))
    df = df.withColumn("__at", F.when(some, running(F.transform("__size", lambda s: s["p"] + s["m"]), _plus, 0)))

    def span(m: Column, k: Column) -> Column:
        start = F.get("__at", k) + F.get("__size", k)["p"]
        return F.struct(start.alias("start"), (start + F.get("__size", k)["m"]).alias("end"), m.alias("text"))

    found = F.coalesce(F.when(some, F.transform("__match", span)).cast(SPAN), F.array().cast(SPAN))
    return df.withColumn(out, found).drop("__match", "__part", "__size", "__at")


def free(spans: str, taken: str) -> Column:
    """Those of the array spans that no span of the array taken overlaps: both are sorted together and folded both ways."""
    low = F.lit(-(1 << 31) + 1)
    both = F.concat(
        F.transform(taken, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("other"), s["end"].alias("end"), F.lit(-1).alias("k"))),
        F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), F.lit(1).alias("other"), s["end"].alias("end"), k.alias("k"))),
    )

    def of(own: Column) -> Column:
        ends = running(F.transform(own, lambda s: F.when(s["other"] == 0, s["end"]).otherwise(low)), F.greatest, -(1 << 31) + 1)
        starts = running(F.transform(F.reverse(own), lambda s: F.when(s["other"] == 0, -s["start"]).otherwise(low)), F.greatest, -(1 << 31) + 1)
        before, after = F.slice(ends, F.lit(1), F.size(own)), F.reverse(F.slice(starts, F.lit(1), F.size(own)))
        kept = F.filter(F.arrays_zip(own.alias("s"), before.alias("e"), after.alias("t")), lambda x: (x["s"]["other"] == 1) & (x["e"] <= x["s"]["start"]) & (-x["t"] >= x["s"]["end"]))
        return F.transform(kept, lambda x: F.get(spans, x["s"]["k"]))

    some = (F.size(spans) > 0) & (F.size(taken) > 0)
    return F.when(some, let(F.array_sort(both), of)).otherwise(F.col(spans))


def blocks(text: str) -> Column:
    """A text in pieces of BLOCK code points: what lies far inside is reached without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, in code points."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    own = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(own, start - first * BLOCK + 1, end - start)).otherwise("")


def marked(text: Column, pattern: str) -> Column:
    """text with each one-character match of pattern replaced by MARK."""
    return F.regexp_replace(F.translate(text, MARK, OTHER), pattern, MARK)


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of all spans (structs with kind, start, end), by start, then by kind as listed."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def replaced(df: DataFrame, out: str, text: str, spans: str, label: str) -> DataFrame:
    """df with out: the column text with each span's characters, overlapping spans taken together, replaced by label."""
    some = F.size(spans) > 0
    df = df.withColumn("__sorted", F.when(some, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    df = df.withColumn("__upto", F.when(some, running(F.transform("__sorted", lambda s: s["end"]), F.greatest, 0))).withColumn("__blocks", F.when(some, blocks(text)))

    def kept(s: Column, k: Column) -> Column:
        before = F.get("__upto", k)
        return F.when(s["start"] < before, "").otherwise(F.concat(cut(F.col("__blocks"), before, s["start"]), F.lit(label)))

    tail = cut(F.col("__blocks"), F.element_at("__upto", -1), F.length(text))
    new = F.when(some, F.concat(F.array_join(F.transform("__sorted", kept), ""), tail)).otherwise(F.col(text))
    return df.withColumn(out, new).drop("__sorted", "__upto", "__blocks")
