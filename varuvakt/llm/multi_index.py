"""Near duplicates of vectors by an inverted multi-index.

Codebooks of the two halves of unit vectors, learnt apart, span a grid of cells; every vector lies in the cell of its nearest codeword
of either half. A vector then visits cells by growing sum of its two squared distances (multi-sequence traversal) until the sum passes that of its own cell by
``slack``, and is compared in double precision with the vectors that lie there.

Target recall: for sampled vectors a partner at exactly the threshold is drawn in a random direction, the hardest that counts; ``slack`` is the value
with which in TARGET of these pairs one of the two visits the other's cell. Closer pairs are found more often.

At scale: codebooks (up to CODEWORDS words a half, learnt on the driver from a bounded sample) grow with the root of the number of vectors, so cells stay small. Equal vectors are one
node with a count. A crowded cell is split into tiles of its residents and its visitors, each pair of tiles in a group of its own; a group gives sums of links
per node and an edge to the smallest member of its component, not the pairs. A pair that both sides find counts once: a visitor
leaves it to the other side where that one visits back and comes first.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, vectors of different lengths never link,
and rows without vec_id take no part (no component, 0 links). Repeated rows are returned one by one and are links of each other.
Rows of one vec_id with different vectors are different vectors. An empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from varuvakt.llm.common import smallest, stored
from varuvakt.llm.components import components

THRESHOLD = 0.95
TARGET = 0.98
#: Vectors a cell on average and codewords of a half at most.
OCCUPANCY = 16
CODEWORDS = 4096
#: Sampled vectors a codeword, and components of all sampled vectors of a length at most.
SAMPLE_EACH = 64
SAMPLE_VALUES = 1 << 23
ROUNDS = 8
#: Sampled vectors with a drawn partner.
PROBES = 2000
#: Residents or visitors of a cell in one group; fewer for vectors of over WIDE components.
TILE = 4096
WIDE = 256
BLOCK = 1024


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, good: whether the vector can link; v has floats if the column has, else doubles."""
    own = embeddings.schema["embedding"].dataType
    kind = "float" if isinstance(own, ArrayType) and isinstance(own.elementType, FloatType) else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Grid:
    """Codebooks of both halves and the slack of a traversal."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, target: float):
        rng = np.random.default_rng(len(sample))
        self.half, self.words = sample.shape[1] // 2, words
        self.books = [means(part, words, rng) for part in self.halves(sample)]
        self.slack = self.calibrated(sample[rng.permutation(len(sample))[:PROBES]], threshold, target, rng)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [squared(part, book) for part, book in zip(self.halves(vectors), self.books, strict=True)]

    def calibrated(self, probes: np.ndarray, threshold: float, target: float, rng: np.random.Generator) -> float:
        aside = rng.normal(size=probes.shape)
        aside -= (aside * probes).sum(1, keepdims=True) * probes
        aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-300)
        both = [self.distances(probes), self.distances(threshold * probes + np.sqrt(1 - threshold**2) * aside)]
        row, needed = np.arange(len(probes)), []
        for own, other in (both, both[::-1]):
            needed.append(sum(own[h][row, other[h].argmin(1)] - own[h].min(1) for h in (0, 1)))
        return float(np.quantile(np.minimum(*needed), target))

    def visits(self, vectors: np.ndarray) -> Iterator[list[int]]:
        """Cells that each vector visits, its own first."""
        first, second = self.distances(vectors)
        for a, b in zip(first, second, strict=True):
            yield self.traverse(a, b)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        rows, columns = (np.flatnonzero(x <= x.min() + self.slack) for x in (a, b))
        rows, columns = rows[np.argsort(a[rows], kind="stable")], columns[np.argsort(b[columns], kind="stable")]
        x, y = a[rows].tolist(), b[columns].tolist()
        most, heap, cells = x[0] + y[0] + self.slack, [(x[0] + y[0], 0, 0)], []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > most:
                break
            cells.append(int(rows[i]) * self.words + int(columns[j]))
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return cells


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * points @ book.T


def means(points: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; a codeword that nothing is nearest to stays where it is."""
    book = points[rng.choice(len(points), words, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([squared(points[at : at + BLOCK], book).argmin(1) for at in range(0, len(points), BLOCK)])
        sizes, sums = np.bincount(nearest, minlength=words), np.zeros_like(book)
        np.add.at(sums, nearest, points)
        book[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return book


def grids(nodes: DataFrame, threshold: float, target: float) -> dict[int, Grid]:
    """A grid for each length of vectors, learnt from the vectors with the smallest hashes of vec_id."""
    found = {}
    for dims, size in sorted(tuple(r) for r in nodes.groupBy("dims").count().collect()):
        words = min(CODEWORDS, int(np.ceil(np.sqrt(size / OCCUPANCY))))
        sample = smallest(nodes.where(F.col("dims") == dims).select("least", "v"), "least", min(max(SAMPLE_VALUES // dims, 1), SAMPLE_EACH * words))
        rows = sample.orderBy(F.xxhash64("least"), "least", "v").select("v").toArrow().column(0).combine_chunks()
        found[dims] = Grid(unit(matrix(rows)), min(words, len(rows)), threshold, target)
    return found


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable by links), kept; one row per vector."""
    rows = usable(embeddings)
    copies = rows.where("good").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(copies.select(F.monotonically_increasing_id().alias("node"), "least", "copies", F.size("v").alias("dims"), "v"), "vector-nodes")
    found = stored(links(nodes, threshold, grids(nodes, threshold, target)), "vector-links")
    sums = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = stored(components(found.where("b IS NOT NULL").select("a", "b")), "vector-components")
    named = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(named, "root").select("node", "component_id")
    known = nodes.join(sums, "node", "left").join(linked, "node", "left").select(
        F.col("v").alias("own"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    joined = rows.where("good").join(known, F.col("v") == F.col("own")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def links(nodes: DataFrame, threshold: float, grid: dict[int, Grid]) -> DataFrame:
    """Partial results of the groups: (a, null, n): n links of node a; (a, b, 0): an edge of the components."""
    kind = nodes.schema["v"].dataType.elementType.simpleString()
    placed = stored(nodes.mapInArrow(_places(grid), f"dims int, cell long, resident boolean, node long, copies long, home long, seen array<long>, v array<{kind}>"), "vector-cells")
    key = ["dims", "cell"]
    sizes = placed.groupBy(*key).agg(F.count(F.when(F.col("resident"), 1)).alias("residents"), F.count("*").alias("all"))
    tile = F.ceil(F.lit(TILE) / F.greatest(F.lit(1), F.col("dims") / WIDE))
    counted = [F.greatest(F.lit(1), F.ceil(F.col(c) / tile)).alias(n) for c, n in (("residents", "rt"), ("visitors", "vt"))]
    tiles = sizes.withColumn("visitors", F.col("all") - F.col("residents")).where(F.col("all") > tile).select(*key, *counted)
    spread = placed.join(tiles, key, "left").fillna(1, ["rt", "vt"])
    own = F.when(F.col("resident"), F.col("rt")).otherwise(F.col("vt"))
    other = F.when(F.col("resident"), F.col("vt")).otherwise(F.col("rt"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    tile = [F.when(F.col("resident"), F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("own", "other", "i"), ("other", "own", "j"))]
    dealt = spread.select(*key, *tile, "resident", "node", "copies", "home", "seen", "v")
    group = [*key, "i", "j"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared(threshold), "a long, b long, n long")


def _places(grid: dict[int, Grid]):
    """Each node once as a resident of its cell, with the cells it visits, and once as a visitor of each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == dims))
                for at in range(0, rows.num_rows, BLOCK):
                    piece = rows.slice(at, BLOCK)
                    seen = list(grid[dims].visits(unit(matrix(piece.column(4)))))
                    count = np.array([len(s) + 1 for s in seen])
                    take = pa.array(np.repeat(np.arange(len(seen)), count))
                    first = np.cumsum(count) - count
                    resident = np.zeros(len(take), bool)
                    resident[first] = True
                    home = np.repeat([s[0] for s in seen], count)
                    cell = np.array([c for s in seen for c in (s[0], *s)], np.int64)
                    lists = [()] * len(take)
                    for k, s in zip(first.tolist(), seen, strict=True):
                        lists[k] = s
                    columns = [
                        pa.array(np.full(len(take), dims, np.int32)), pa.array(cell), pa.array(resident), piece.column(0).take(take), piece.column(2).take(take),
                        pa.array(home), pa.array(lists, pa.list_(pa.int64())), piece.column(4).take(take),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["dims", "cell", "resident", "node", "copies", "home", "seen", "v"])

    return run


def _compared(threshold: float):
    """Groups of (dims, cell, i, j), sorted, of which one at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(4)])
            heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]).tolist()
            for start, end in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                key = tuple(keys[start].tolist())
                if key != last and held:
                    yield from group_links(held, threshold)
                    held = []
                last = key
                held.append(batch.slice(start, end - start))
        if held:
            yield from group_links(held, threshold)

    return run


def group_links(batches: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    resident, node, copies, home = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(4, 8))
    if len(node) < 2 or resident.all() or not resident.any():
        return
    vectors = unit(matrix(rows.column(9)))
    here, there = np.flatnonzero(resident), np.flatnonzero(~resident)
    # (resident, cell it visits) as sorted numbers.
    seen = rows.column(8).take(pa.array(here))
    cells, place = np.unique(np.r_[home[there], seen.flatten().to_numpy(zero_copy_only=False)], return_inverse=True)
    visitor_home, visited = place[: len(there)], place[len(there) :]
    size = np.diff(seen.offsets.to_numpy())
    back = np.sort(np.repeat(np.arange(len(here)), size) * len(cells) + visited)
    sums, star = np.zeros(len(node), np.int64), np.arange(len(node))
    # A node may be in the group twice, as a resident and as a visitor; results name nodes.
    for at in range(0, len(there), BLOCK):
        some = there[at : at + BLOCK]
        v, r = np.nonzero(vectors[some] @ vectors[here].T >= threshold)
        u, w = some[v], here[r]
        wanted = r * len(cells) + visitor_home[at + v]
        mutual = back[np.minimum(np.searchsorted(back, wanted), len(back) - 1)] == wanted
        keep = (node[u] != node[w]) & (~mutual | (node[u] < node[w]))
        u, w = u[keep], w[keep]
        if len(u):
            np.add.at(sums, u, copies[w])
            np.add.at(sums, w, copies[u])
            star = joined(star, u, w)
    counted = np.flatnonzero(sums)
    moved = np.flatnonzero(star != np.arange(len(node)))
    a = np.r_[node[counted], node[moved]]
    b = pa.array(np.r_[np.zeros(len(counted), np.int64), node[star[moved]]], mask=np.r_[np.ones(len(counted), bool), np.zeros(len(moved), bool)])
    yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.r_[sums[counted], np.zeros(len(moved), np.int64)])], names=["a", "b", "n"])


def joined(label: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Smallest label of each component after the edges (u, w) are added to components given by labels."""
    while True:
        now = label.copy()
        for x, y in ((u, w), (w, u)):
            np.minimum.at(now, x, label[y])
        np.minimum.at(now, label, now)  # a component moves as a whole
        now = now[now]
        if (now == label).all():
            return label
        label = now
