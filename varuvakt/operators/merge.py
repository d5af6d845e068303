"""Keyed table changes as joins: fold a batch, upsert, insert-if-absent, patch, delete.

Every function is pure: it takes the current table and a batch of changes and
returns the new table. A batch is first folded to one row per key with a
partial aggregate, so a key repeated many times in one batch never meets
another copy of itself in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.session import written

# Number of hash buckets dense ids are handed out from; three hex digits of MD5.
ID_BUCKETS = 16**3
HOT_KEYS_MAX = 10_000


def last_known(col: str, ord_col: str) -> Column:
    """Last non-NULL value in batch order, which is what repeated COALESCE(new, old) leaves."""
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col(ord_col))).alias(col)


def first_seen_value(col: str, ord_col: str) -> Column:
    """Value of the earliest change, NULL included."""
    return F.min_by(col, ord_col).alias(col)


def fold(
    changes: DataFrame,
    keys: Sequence[str],
    ord_col: str,
    coalesce_cols: Sequence[str] = (),
    first_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the last known value of some columns, the first of others."""
    aggs = [last_known(c, ord_col) for c in coalesce_cols] + [first_seen_value(c, ord_col) for c in first_cols]
    return changes.groupBy(*keys).agg(*aggs)


def absent(changes: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` (unique on keys) whose key is not in ``base``.

    The large table is only narrowed by a semi join against the batch, which
    broadcasts while the batch is small; the anti join then meets two
    batch-sized sides.
    """
    keys = list(keys)
    known = base.select(*keys).join(changes.select(*keys), keys, "left_semi")
    return changes.join(known, keys, "left_anti")


def insert_absent(base: DataFrame, new_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING; ``new_rows`` must be unique on keys."""
    return base.unionByName(absent(new_rows, base, keys), allowMissingColumns=True)


def update_existing(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    assignments: dict[str, Column],
) -> DataFrame:
    """UPDATE ... FROM changes: rows without a change pass through.

    ``changes`` must be unique on keys and its columns carry the prefix ``new_``
    (keys excepted). Assignments may refer to both sides.
    """
    keys = list(keys)
    touched = F.coalesce(F.col("_touched"), F.lit(False))
    joined = base.join(changes.withColumn("_touched", F.lit(True)), keys, "left")
    cols = [
        F.when(touched, assignments[c]).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c)
        if c in assignments
        else F.col(c)
        for c in base.columns
    ]
    return joined.select(*cols)


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str = "new_") -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def known_keys(base: DataFrame, changes: DataFrame, keys: Sequence[str], id_col: str | None = None) -> DataFrame:
    """The keys of ``changes`` (unique) that ``base`` holds, and one row (``_known`` NULL) for all other rows of ``base``.

    One narrow pass over ``base``: rows without a change fold into a single group before the shuffle, so what is shuffled
    has the size of the batch. ``_top`` is the largest id of each group, the maximum over all groups that of the table. The
    result is stored, as a filter on it would otherwise be pushed into a second pass over ``base``.
    """
    keys = list(keys)
    marked = changes.select(*keys, F.lit(True).alias("_known"))
    seen = base.select(*dict.fromkeys([*keys, *([id_col] if id_col else [])])).join(marked, keys, "left")
    top = F.max(id_col) if id_col else F.lit(None)
    groups = seen.groupBy(*[F.when(F.col("_known"), F.col(k)).alias(k) for k in keys], "_known")
    return written(groups.agg(top.cast("long").alias("_top")), "known")


def upsert(
    base: DataFrame,
    folded: DataFrame,
    keys: Sequence[str],
    assignments: dict[str, Column],
    insert_values: dict[str, Column],
    id_col: str | None = None,
    ids_after: DataFrame | None = None,
) -> DataFrame:
    """Update matched keys, insert the rest.

    ``assignments`` see the folded columns as ``new_*``; ``insert_values`` see
    them under their own names. Columns of ``base`` with no insert value become
    NULL. New ids follow those of ``ids_after``, the whole table when ``base`` is
    only a part of it. The folded batch is stored first, as it meets the table twice: in the
    update and in one narrow pass that finds the known keys and the largest id.
    """
    keys = list(keys)
    folded = written(folded, "changes")
    updated = update_existing(base, prefixed(folded, keys), keys, assignments)
    values = {k: F.col(k) for k in keys} | insert_values
    inserted = insert_rows(base, folded, keys, values, id_col, ids_after)
    return updated.unionByName(inserted)


def insert_rows(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    id_col: str | None = None,
    ids_after: DataFrame | None = None,
) -> DataFrame:
    """The rows ``base`` gets for the keys of ``changes`` (unique) it does not hold, in the columns of ``base``.

    Columns without a value are NULL; ids as in ``upsert``.
    """
    probe = known_keys(base, changes, keys, id_col if ids_after is None else None)
    fresh = changes.join(probe.filter("_known"), list(keys), "left_anti")
    inserted = fresh.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema if f.name != id_col]
    )
    if id_col is None:
        return inserted
    last = probe.agg(F.max("_top")) if ids_after is None else ids_after.agg(F.max(id_col))
    return with_ids_from(inserted, F.coalesce(last.scalar(), F.lit(0)), id_col, list(keys))


def delete_keys(base: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    return base.join(doomed.select(*keys).distinct(), keys, "left_anti").select(*base.columns)


def with_new_ids(rows: DataFrame, base: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Give rows dense ids after the largest id of ``base``."""
    return with_ids_from(rows, base.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar(), id_col, order)


def with_ids_from(rows: DataFrame, start: Column, id_col: str, order: Sequence[str]) -> DataFrame:
    """Give rows dense ids after ``start``.

    The order is (MD5 bucket, key), so ids depend only on the data: a retried
    task or another cluster size yields the same ids. Each bucket is numbered on
    its own and shifted by the row count of the buckets before it; that count
    table has at most ``ID_BUCKETS`` rows, which is the proven bound for its
    broadcast. Rows must be unique on ``order``.
    """
    order = list(order)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    tagged = rows.withColumn("_bucket", F.substring(digest, 1, 3))
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        tagged.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(id_col, (start + F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def hot_keys(df: DataFrame, keys: Sequence[str], threshold: int, at_most: int = HOT_KEYS_MAX) -> DataFrame:
    """The keys with more than ``threshold`` rows, at most the ``at_most`` most frequent.

    The cap bounds the broadcast of the result and costs no exactness: a key
    outside the list only misses special treatment, and by counting it holds
    less than ``1 / at_most`` of all rows.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return counts.filter(F.col("_rows") > threshold).orderBy(F.desc("_rows"), *keys).limit(at_most).select(*keys)
