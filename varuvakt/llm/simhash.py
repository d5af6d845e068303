"""Near duplicates by 64-bit SimHash fingerprints.

Fingerprint: lower-case A-Z, take words between ASCII white space and shingles of three
words, repeats included; a bit is set where over half of the shingles' XXH64
(seed 42) have it. Fingerprints that differ in at most three bits are linked.

Search: of five blocks of bits, two at least are equal in every linked pair, so each of
the ten pairs of blocks makes a table of buckets. Inside a bucket fingerprints
lie as 64 bit planes; a query looks at 64 of them by one word operation, its
distances are counted in carry-save counters, and a look is abandoned as soon as all
its counters have passed the radius. Buckets over TILE fingerprints are split into
tiles that are compared two by two, each pair in a group of its own. A group
gives each member's link to the smallest one of its component, not all pairs.

Cases: null and empty texts and texts of blanks have fingerprint zero and are linked like others.
Rows without ``doc_id`` get a fingerprint but no component, and never link others. Repeated rows
come back one by one. An empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.llm.common import fresh, sliced, stored, texts_of
from varuvakt.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = 5
TILE = 4096
#: Shingles whose bits are counted at a time.
STEP = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        starts, ends = [0], [len(joined)]
    else:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        ends = (after[SHINGLE - 1 :] - 1).tolist()
        starts = [0, *after[:-SHINGLE].tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), print (a hash of the text, which tells rows of one doc_id apart)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts], pa.int64()), batch.column(2)], names=["doc_id", "fp", "print"])

    rows = texts_of(docs).withColumn("print", F.xxhash64("text"))
    return rows.mapInArrow(sliced(work), "doc_id long, fp long, print long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of all unions of ``blocks - radius`` blocks, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(group) for group in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def classes(rows: DataFrame) -> DataFrame:
    """fp, root of the fingerprints of rows with doc_id; equal roots are one class."""
    nodes = stored(rows.where("doc_id IS NOT NULL").select("fp", F.col("fp").alias("node")).distinct(), "fingerprint-nodes")
    return nodes.join(components(links(nodes)), "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest linked doc_id)."""
    rows = stored(fingerprints(docs), "fingerprints")
    grouped = stored(classes(rows), "fingerprint-classes")
    least = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = grouped.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rows.join(grouped.join(named, "root").select("fp", "component_id"), "fp", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` of which one per group of near duplicates stays: that with the smallest doc_id, then with the smallest hash of its text.

    Rows of one doc_id with different texts are different documents; of rows with the same doc_id and text one stays. Rows
    without doc_id stay as they are.
    """
    keeper, mark = fresh(docs, "keeper"), fresh(docs, "print")
    rows = stored(fingerprints(docs).where("doc_id IS NOT NULL"), "fingerprints")
    least = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "print")).alias("least"))
    first = classes(rows).join(least, "fp").groupBy("root").agg(F.min("least").alias("least"))
    keepers = stored(first.select(F.col("least.doc_id").alias(keeper), F.col("least.print").alias(mark)), "keepers")
    marked = docs.where(F.col("doc_id").isNotNull()).withColumn(keeper, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(keepers, [keeper, mark], "left_semi").dropDuplicates([keeper, mark]).drop(keeper, mark)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp, node) -> edges (a, b) of nodes that join all fingerprints within the radius."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks())])
    banded = nodes.select("fp", "node", F.explode(tables).alias("band")).select("fp", "node", "band.*")
    sizes = banded.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / TILE).alias("tiles"))
    crowded = banded.join(sizes, ["t", "key"])
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    dealt = crowded.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.where("tiles = 1 OR other <> tile")
    dealt = dealt.select("t", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "fp", "node")
    group = ["t", "key", "i", "j"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare_groups, "a long, b long").distinct()


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> each member's edge to the smallest node of its component in the group."""
    held: np.ndarray | None = None
    for batch in batches:
        rows = np.column_stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(6)])
        if held is not None:
            rows = np.vstack([held, rows])
        if not len(rows):
            continue
        heads = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(1)])
        held = rows[heads[-1] :]
        yield _edges(rows[: heads[-1]], heads[:-1])
    if held is not None and len(held):
        yield _edges(held, np.array([0]))


def _edges(rows: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
    pairs = [np.empty((0, 2), np.int64)]
    if len(rows):
        sizes = np.diff(np.r_[heads, len(rows)])
        small = sizes <= 64
        if small.any():
            pairs.append(_small_groups(rows, heads[small], sizes[small]))
        for head, size in zip(heads[~small], sizes[~small], strict=True):
            pairs.append(_large_group(rows[head : head + size, 4].view(np.uint64), rows[head : head + size, 5]))
    found = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def count_within(queries: np.ndarray, planes: np.ndarray, word: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, int]:
    """Per look: the lanes of word ``word`` of the planes within RADIUS (3) of the query, and how many looks were abandoned.

    A look is one query at one word of 64 lanes. Lanes set in ``over`` (the query itself, empty or foreign lanes) count as
    past the radius from the start, so a look ends as soon as no lane is left that could be near.
    """
    result, alive = np.zeros(len(queries), np.uint64), np.flatnonzero(over != ALL)
    asked, word, over = queries[alive], word[alive], over[alive]
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    abandoned = len(queries) - len(alive)
    for bit in range(64):
        differs = planes[bit][word] ^ (np.uint64(0) - ((asked >> np.uint64(bit)) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if bit % 4 == 3 and bit < 63:
            live = over != ALL
            left = int(np.count_nonzero(live))
            if left == len(alive):
                continue
            abandoned += len(alive) - left
            alive, asked, word, ones, twos, over = (x[live] for x in (alive, asked, word, ones, twos, over))
            if not left:
                break
    result[alive] = ~over
    return result, abandoned


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words; lane l of word w is fingerprint 64 w + l. Empty lanes hold zeros."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _near(queries: np.ndarray, fps: np.ndarray, planes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """queries x words: the lanes near to each of the ``queries`` (places in ``fps``), themselves left out."""
    over = np.tile(~lanes, (len(queries), 1))
    over[np.arange(len(queries)), queries >> 6] |= np.uint64(1) << (queries & 63).astype(np.uint64)
    words = np.tile(np.arange(len(lanes)), len(queries))
    return count_within(np.repeat(fps[queries], len(lanes)), planes, words, over.ravel())[0].reshape(over.shape)


def _large_group(fps: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    planes, n = bit_planes(fps), len(fps)
    lanes = np.full(planes.shape[1], ALL)
    if n % 64:
        lanes[-1] = np.uint64((1 << (n % 64)) - 1)
    near = np.concatenate([_near(np.arange(at, min(at + 512, n)), fps, planes, lanes) for at in range(0, n, 512)])
    unseen, edges = lanes.copy(), []
    order = np.argsort(nodes, kind="stable")
    for seed in order:
        if not (int(unseen[seed >> 6]) >> int(seed & 63)) & 1:
            continue
        fresh, found = np.array([seed]), []
        unseen[seed >> 6] &= ~(np.uint64(1) << np.uint64(seed & 63))
        while len(fresh):
            reach = np.bitwise_or.reduce(near[fresh], axis=0) & unseen
            unseen &= ~reach
            fresh = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little")[:n])
            found.append(fresh)
        members = np.concatenate(found)
        if len(members):
            edges.append(np.column_stack([nodes[members], np.full(len(members), nodes[seed])]))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def _small_groups(rows: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Groups of up to 64 share words: each word holds whole groups, and a query looks at its own word only."""
    word, lane, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 64
    at = -1
    for k, size in enumerate(sizes.tolist()):
        if used + size > 64:
            at, used = at + 1, 0
        word[k], lane[k] = at, used
        used += size
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(heads, sizes) + inside
    words, lanes = np.repeat(word, sizes), np.repeat(lane, sizes) + inside
    fps, nodes = rows[row, 4].view(np.uint64), rows[row, 5]
    laid = np.zeros((at + 1) * 64, np.uint64)
    laid[words * 64 + lanes] = fps
    planes = bit_planes(laid)
    first, count = np.repeat(lane, sizes).astype(np.uint64), np.repeat(sizes, sizes).astype(np.uint64)
    own = (ALL >> (np.uint64(64) - count)) << first
    near, _ = count_within(fps, planes, words, ~own | (np.uint64(1) << lanes.astype(np.uint64)))
    hit = np.flatnonzero(near)
    bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    query, found = np.nonzero(bits)
    at_lane = np.full((at + 1) * 64, -1, np.int64)
    at_lane[words * 64 + lanes] = nodes
    a, b = nodes[hit[query]], at_lane[words[hit[query]] * 64 + found]
    pair = np.column_stack([a, b])[a > b]
    return pair
