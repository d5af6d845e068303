"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.session import written

__all__ = ["ascii_lower", "columns_of", "fresh", "smallest", "texts_of", "sliced", "stored", "split_long"]

#: Rows that one step of a Python task works on at a time.
SLICE_ROWS = 256
#: Bytes of text after which a slice ends, so that long texts do not pile up.
SLICE_BYTES = 4 << 20

#: Leading bits of a hash that are counted before rows are ranked by it.
HASH_BITS = 14

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

stored = written


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` long and ``text``, null texts as empty ones; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with so many underscores before it that no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(names: list[str]) -> list[Column]:
    return [F.col("`{}`".format(name.replace("`", "``"))) for name in names]


def smallest(rows: DataFrame, key: str, n: int, group: str | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``, of each value of ``group``; ties go by all columns.

    Counts by the leading bits of the hash (at most 2 ** HASH_BITS a group) tell how far to look, so only about ``n``
    rows are ranked however many tasks there are. ``group`` must have few values. Fewer rows come back as they are.
    """
    part, own = F.shiftright(F.xxhash64(key), 64 - HASH_BITS), F.lit(0) if group is None else F.col(group)
    held, last = Counter(), {}
    for value, at, size in sorted(map(tuple, rows.groupBy(own.alias("value"), part.alias("at")).count().collect())):
        if held[value] < n:
            last[value] = at
        held[value] += size
    near = reduce(or_, [(own == value) & (part <= at) for value, at in last.items()], F.lit(False))
    place = fresh(rows, "place")
    order = Window.partitionBy(own).orderBy(F.xxhash64(key), *columns_of(rows.columns))
    return rows.where(near).withColumn(place, F.row_number().over(order)).where(F.col(place) <= n).drop(place)


def sliced(
    work: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS, most: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: hands ``work`` short pieces of each batch, cut by ``rows`` and by ``most`` bytes of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in split_long(batch, text, rows, most):
                yield work(piece)

    return run


def split_long(batch: pa.RecordBatch, text: str = "text", rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and (row - start >= rows or held + (size or 0) > most):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)
