"""Places of regular expressions in texts, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that are appended one by one to an array; longer results are arrays of such blocks.
BLOCK = 256
#: Code points a piece of a text that is cut for many substrings; a look for a place reads one piece, not the text before it.
PIECE = 1024
EMPTY = "array<struct<start:int,end:int,match:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``step`` makes of each item in turn: array of ``kind``.

    ``step(state, item)`` gives struct(state, out), beginning with state ``zero``. Results gather in blocks, so the
    work does not grow with the square of the items.
    """

    def one(acc: Column, item: Column) -> Column:
        return bound(step(acc["state"], item), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["outs"], r["out"]).alias("outs")))

    def block(acc: Column, part: Column) -> Column:
        first = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("outs"))
        return bound(F.aggregate(part, first, one), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["blocks"], r["outs"]).alias("blocks")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))
    parts = bound(items, lambda i: F.transform(F.sequence(F.lit(0), F.greatest(((F.size(i) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(i, b * BLOCK + 1, BLOCK)))
    return F.flatten(F.aggregate(parts, start, block, lambda acc: acc["blocks"]))


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(pieces: Column, start: Column, length: Column) -> Column:
    """The ``length`` code points after the first ``start`` ones of a text in pieces; reads the pieces they lie in."""
    first = (start / PIECE).cast("int")
    held = F.slice(pieces, first + 1, ((start + length) / PIECE).cast("int") - first + 1)
    return F.when(length > 0, F.substring(F.array_join(held, ""), start - first * PIECE + 1, length)).otherwise("")


def no_spans() -> Column:
    return F.array().cast(EMPTY)


def match_spans(text: Column, pattern: Column | str) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pattern must not match the empty text: what lies between the matches is then one piece more than there are matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def step(at: Column, piece: Column) -> Column:
        start = at + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        return F.struct(end.alias("state"), F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("match")).alias("out"))

    spans = running(pieces, F.lit(0), step, "struct<start:int,end:int,match:string>")
    return F.filter(spans, lambda s: s["match"].isNotNull())
