"""Packing of tokenised documents into windows of fixed length.

Bounded-space online packing: every partition keeps a fixed number of open
windows. A piece goes to the fullest window that still takes it whole; when none
does, the fullest window takes the head of the piece, leaves full, and the rest
goes on. What is open at the end of a partition is merged over groups of
partitions, level by level, by the same rule.

Cases: a null text is an empty one; every document has at least the closing id.
Rows without ``doc_id`` are packed like others, repeated rows one by one. An
empty table gives no pieces. Other columns of the input are left behind.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import split_long, stored, texts_of
from varuvakt.llm.word_tokens import encoder

SEQUENCE = 2048
END_ID = 1
OPEN_WINDOWS = 32
#: Partitions whose leftovers one task merges.
MERGE_GROUP = 64

#: Sequence ids: the place where a window was closed in the high bits, a counter in the low ones.
COUNTER_BITS = 32
#: Places of the merging levels lie above those of the partitions.
LEVEL_STEP = 1 << 24

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("window", pa.int64()), ("offset", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()),
    ]
)


class OpenWindows:
    """At most ``room`` windows, ordered by fill; ``put`` yields (window, offset, length) for the parts of a piece."""

    def __init__(self, size: int, room: int):
        self.size, self.room, self.made = size, room, 0
        self.fills: list[tuple[int, int]] = []

    def put(self, length: int) -> Iterator[tuple[int, int, int]]:
        while length:
            at = bisect_left(self.fills, (self.size - length + 1, -1)) - 1
            if at < 0 and len(self.fills) < self.room:
                fill, window, part = 0, self.made, min(length, self.size)
                self.made += 1
            else:
                fill, window = self.fills.pop(at)  # at -1: none fits, so the fullest takes what it can
                part = min(length, self.size - fill)
            if fill + part < self.size:
                insort(self.fills, (fill + part, window))
            yield window, fill, part
            length -= part


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, room: int = OPEN_WINDOWS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian
    unsigned 32-bit, where ``keep_ids``). ``tokenizer`` is a tokenizers file that every executor can read."""

    def place_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        encode, windows, closing = encoder(tokenizer), OpenWindows(size, room), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in split_long(batch):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids = encode(text) + closing
                    total, start = len(ids) // 4, 0
                    for window, offset, length in windows.put(total):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(own), total, (place << COUNTER_BITS) + window, offset, place, own if keep_ids else None))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, place long, ids binary"
    pieces = stored(texts_of(docs).mapInArrow(place_texts, fields), "pieces")
    moved = merge_open(pieces, size, room)
    return pieces.join(moved, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("sequence_id", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def merge_open(pieces: DataFrame, size: int, room: int) -> DataFrame:
    """Windows that no partition filled -> sequence_id and shift after merging; windows stay whole here.

    A partition leaves ``room`` windows at most, so a task gets MERGE_GROUP * room rows at most; the levels end when one group is left.
    """
    left = pieces.groupBy("window", "place").agg(F.sum("length").alias("fill")).where(F.col("fill") < size)
    left = stored(left.select("window", F.col("window").alias("sequence_id"), F.lit(0).cast("long").alias("shift"), "fill", "place"), "open-windows")
    places = left.agg(F.max("place")).first()[0]
    level, done = 0, None
    while places is not None:
        level += 1
        # Of the windows merged so far, each is one item; its members move with it.
        items = left.groupBy("sequence_id").agg(F.sum("fill").alias("fill"), F.max("place").alias("place"))
        merged = (
            items.withColumn("group", F.floor(F.col("place") / MERGE_GROUP))
            .groupBy("group")
            .applyInPandas(_merger(size, room, level), "sequence_id long, merged long, by long, shut boolean, place long")
        )
        merged = left.join(merged.withColumnRenamed("place", "next_place"), "sequence_id").select(
            "window", F.col("merged").alias("sequence_id"), (F.col("shift") + F.col("by")).alias("shift"), "fill", F.col("next_place").alias("place"), "shut"
        )
        merged = stored(merged, "open-windows")
        places = None if places < MERGE_GROUP else places // MERGE_GROUP
        closed = merged if places is None else merged.where("shut")
        left = merged.where("NOT shut").drop("shut")
        done = closed if done is None else done.union(closed)
    done = left if done is None else done
    return done.select("window", "sequence_id", "shift")


def _merger(size: int, room: int, level: int):
    def merge(items: pd.DataFrame) -> pd.DataFrame:
        """Largest first, each to the fullest merged window that takes it; at most ``room`` stay open for the next level."""
        items = items.sort_values(["fill", "sequence_id"], ascending=[False, True])
        group = int(items["place"].iloc[0]) // MERGE_GROUP
        first = (LEVEL_STEP * level + group) << COUNTER_BITS
        fills: list[tuple[int, int]] = []
        rows, made = [], 0
        for sequence_id, fill in zip(items["sequence_id"], items["fill"], strict=True):
            at = bisect_left(fills, (size - int(fill) + 1, -1)) - 1
            have, merged = fills.pop(at) if at >= 0 else (0, made)
            made += at < 0
            insort(fills, (have + int(fill), merged))
            rows.append((sequence_id, first + merged, have))
        stay = {merged for _, merged in fills[:room]}
        out = pd.DataFrame(rows, columns=["sequence_id", "merged", "by"])
        out["shut"] = ~(out["merged"] - first).isin(stay)
        out["place"] = group
        return out

    return merge
