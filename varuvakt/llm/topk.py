"""Exact top-k by inner product with pivot-table elimination.

Components become floor(256 x). The distances of every vector to a few pivots are computed once.
For a query and a candidate the triangle inequality gives a lower bound of their distance, the largest over
all pivots, and with both norms an upper bound of the inner product. Candidates
are scored in the order of their bounds until the k-th score passes all bounds left.

The stated queries are compared with all rows block by block: a task holds at most
QUERY_BLOCK queries and CANDIDATE_BLOCK candidates and gives k rows a query; the best k of all blocks follow.

Cases: a vector that is null or empty or holds null or non-finite components takes no part, nor does a row without vec_id. Vectors of
different lengths are never compared. Ties go to the smaller vec_id; a row never answers a query of its own vec_id.
Repeated queries answer as one, repeated candidates count one by one. Components up to 2^20 are exact for up to
4096 dimensions; larger ones are computed in 64-bit integers, which wrap beyond 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.llm.common import smallest

K = 5
EVERY = 50
PIVOTS = 24
#: Vectors from which the pivots are chosen, by smallest hash of vec_id.
PIVOT_POOL = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16_384
#: Candidates scored before the bounds are looked at again.
STEP = 512


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, dims, v (array of long)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    return whole.select("vec_id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"))


def choose_pivots(vectors: DataFrame, count: int, pool: int) -> dict[int, np.ndarray]:
    """Per length, pivots far from one another, out of a bounded pool."""
    taken = smallest(vectors, "vec_id", pool).orderBy(F.xxhash64("vec_id"), "vec_id", "v").toPandas()
    chosen = {}
    for dims, own in taken.groupby("dims"):
        points = np.stack([np.asarray(v, np.float64) for v in own["v"]])
        far, picked = np.full(len(points), np.inf), [0]
        while len(picked) < min(count, len(points)):
            far = np.minimum(far, ((points - points[picked[-1]]) ** 2).sum(1))
            picked.append(int(far.argmax()))
        chosen[int(dims)] = points[picked]
    return chosen


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for every query: the rows whose vec_id is divisible by ``every``."""
    vectors = scaled(embeddings)
    table = choose_pivots(vectors, pivots, PIVOT_POOL)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                points = table.get(len(v))
                out.append([] if points is None else np.sqrt(((points - np.array(v, np.float64)) ** 2).sum(1)).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "dims", "v", "d"])

    tabled = vectors.mapInArrow(distances, "vec_id long, dims int, v array<long>, d array<double>")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    sizes = vectors.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks, query_blocks = max(1, -(-sizes[0] // candidate_block)), max(1, -(-sizes[1] // query_block))

    def dealt(rows: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.withColumn(own, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id() if own == "c" else F.lit(0)), F.lit(count)).cast("int")).withColumn(other, spread)

    queries = dealt(tabled.where(asked).dropDuplicates(["vec_id", "v"]), "q", query_blocks, "c", blocks)
    candidates = dealt(tabled, "c", blocks, "q", query_blocks)
    keys = ["dims", "q", "c"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        lambda a, b: search(a, b, k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
    if queries.empty or candidates.empty:
        return empty
    candidates = candidates.sort_values("vec_id")
    ids, query_ids = candidates["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
    x, q = np.stack(candidates["v"].to_list()), np.stack(queries["v"].to_list())
    if max(np.abs(x).max(), np.abs(q).max()) <= 1 << 20:
        x, q = x.astype(np.float64), q.astype(np.float64)  # exact, and faster
    xs, qs = x.astype(np.float64), q.astype(np.float64)
    norms, own = (xs * xs).sum(1), (qs * qs).sum(1)
    dx, dq = np.stack(candidates["d"].to_list()), np.stack(queries["d"].to_list())
    out = []
    for at in range(len(q)):
        apart = np.zeros(len(x))
        for p in range(dx.shape[1]):
            np.maximum(apart, np.abs(dx[:, p] - dq[at, p]), out=apart)
        bound = (norms + own[at] - apart * apart) / 2
        bound += 1e-9 * (norms + own[at] + 1)  # what rounding may take away
        bound[ids == query_ids[at]] = -np.inf
        best_score, best_id = np.empty(0, np.int64), np.empty(0, np.int64)
        left = np.flatnonzero(bound > -np.inf)
        while len(left):
            if len(left) > STEP:
                split = np.argpartition(-bound[left], STEP - 1)
                now, left = left[split[:STEP]], left[split[STEP:]]
            else:
                now, left = left, left[:0]
            score = np.rint(x[now] @ q[at]).astype(np.int64) if x.dtype == np.float64 else x[now] @ q[at]
            best_score, best_id = np.r_[best_score, score], np.r_[best_id, ids[now]]
            order = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[order], best_id[order]
            if len(best_score) == k:  # an equal score may still win by its id
                left = left[bound[left] >= best_score[-1]]
        out.append((np.full(len(best_id), query_ids[at]), best_id, best_score))
    return pd.DataFrame({name: np.concatenate([o[n] for o in out]) for n, name in enumerate(("query_id", "vec_id", "score"))})
