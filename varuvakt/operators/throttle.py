"""Attempt throttling: at most ``limit`` allowed attempts until a quiet period has passed.

The counter of a key grows with every allowed attempt and expires one window
after the last allowed one. An attempt at the limit is denied and does not
prolong the wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.operators.merge import hot_keys
from varuvakt.session import written

# Fixed values: (limit, window in seconds) of the two guarded actions.
LIMITS = {"signup": (5, 3600), "login": (10, 600)}

KEY = ["bucket", "ip"]
TABLE_SCHEMA = "bucket string, ip string, slot long, code int, at long, exit_count int, exit_expires long"
ENTRY_SCHEMA = "bucket string, ip string, slot long, count int, expires long"
PASS, UNCHANGED = -1, -1
NEVER = -(2**62)


def step(ts: np.ndarray, count: int, expires: int, limit: int, window_ms: int) -> tuple[np.ndarray, int, int]:
    """Decisions for one key's attempts in time order, from and to a counter state.

    Works in runs: a denied stretch is skipped with one search for the expiry.
    """
    allowed = np.zeros(len(ts), dtype=bool)
    i, n = 0, len(ts)
    while i < n:
        if ts[i] >= expires:
            count = 0
        if count >= limit:
            i = int(np.searchsorted(ts, expires, side="left"))
            continue
        allowed[i] = True
        count += 1
        expires = int(ts[i]) + window_ms
        i += 1
    return allowed, count, expires


def throttle_attempts(
    attempts: DataFrame, limit: int, window_seconds: int, hot_rows: int = 5_000_000, fan_out: int = 16
) -> DataFrame:
    """Attempts (bucket, ip, ts, attempt_id) with the decision ``allowed``.

    A decision depends on all earlier attempts of its key, so ordinary keys are
    streamed through a counter in time order. A key with more than ``hot_rows``
    attempts would keep one task busy; such keys are cut in time and decided in
    parallel, see ``_scan_hot``.
    """
    window_ms = window_seconds * 1000
    columns = attempts.columns
    hot = hot_keys(attempts, KEY, hot_rows)
    if hot.isEmpty():
        return _stream_keys(attempts, limit, window_ms)
    ordinary = attempts.join(F.broadcast(hot), KEY, "left_anti").select(*columns)
    crowded = attempts.join(F.broadcast(hot), KEY, "left_semi").select(*columns)
    return _stream_keys(ordinary, limit, window_ms).unionByName(_scan_hot(crowded, limit, window_ms, fan_out))


def _stream_keys(attempts: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Sort by key and time (Spark spills to disk) and walk each partition with a fixed-size counter."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in attempts.schema)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, expires = None, 0, 0
        for batch in batches:
            changes = (batch["bucket"].ne(batch["bucket"].shift()) | batch["ip"].ne(batch["ip"].shift())).to_numpy()
            starts = [*np.flatnonzero(changes), len(batch)]
            allowed = np.zeros(len(batch), dtype=bool)
            ts = batch["ts"].to_numpy()
            for lo, hi in zip(starts[:-1], starts[1:]):
                this = (batch["bucket"].iat[lo], batch["ip"].iat[lo])
                if this != key:
                    key, count, expires = this, 0, 0
                allowed[lo:hi], count, expires = step(ts[lo:hi], count, expires, limit, window_ms)
            yield batch.assign(allowed=allowed)

    return (
        attempts.repartition(*KEY)
        .sortWithinPartitions(*KEY, "ts", "attempt_id")
        .mapInPandas(decide, f"{fields}, allowed boolean")
    )


def _scan_hot(attempts: DataFrame, limit: int, window_ms: int, fan_out: int) -> DataFrame:
    """Decide heavily used keys in parallel with a tree of counter transfers.

    Time is cut into slots of one window. Within a slot no counter expires
    after its first allowed attempt, so the allowed attempts of a slot are one
    run: from its first attempt, or from the first one at or after the expiry
    brought in. What a slot does to the counter is therefore a small table:
    entry (how the run starts) to exit (count, expiry). Tables of consecutive
    slots compose to the table of a longer stretch, with the entries of the
    first slot, level by level up to the whole time; going down again gives
    every slot its true entry. A task holds ``fan_out`` tables of one key, each
    no longer than the attempts of one window.
    """
    first = attempts.agg(F.min("ts"), F.max("ts")).first()
    low = first[0] // window_ms
    levels, slots = 0, first[1] // window_ms - low + 1
    while slots > 1:
        levels, slots = levels + 1, -(-slots // fan_out)
    cut = attempts.withColumn("slot", (F.floor(F.col("ts") / F.lit(window_ms)) - F.lit(low)).cast("long"))
    tables = [written(_slot_tables(cut, limit, window_ms), "throttle")]
    parent = F.floor(F.col("slot") / F.lit(fan_out)).cast("long")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        return _compose(rows, limit)

    for _ in range(levels):
        grouped = tables[-1].withColumn("parent", parent).groupBy(*KEY, "parent")
        tables.append(written(grouped.applyInPandas(compose, TABLE_SCHEMA), "throttle"))

    def descend(states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _descend(states, rows, limit)

    entries = tables[-1].select(*KEY, "slot").distinct().select(
        *KEY, "slot", F.lit(0).alias("count"), F.lit(NEVER).alias("expires")
    )
    for level in range(levels - 1, -1, -1):
        above = entries.withColumnRenamed("slot", "parent").groupBy(*KEY, "parent")
        below = tables[level].withColumn("parent", parent).groupBy(*KEY, "parent")
        entries = above.cogroup(below).applyInPandas(descend, ENTRY_SCHEMA)

    slot = Window.partitionBy(*KEY, "slot")
    place = F.row_number().over(slot.orderBy("ts", "attempt_id"))
    late = F.min(F.when(F.col("ts") >= F.col("expires"), F.col("place"))).over(slot)
    expired = F.min("ts").over(slot) >= F.col("expires")
    return (
        cut.withColumn("place", place)
        .join(entries, [*KEY, "slot"])
        .withColumn("start", F.when(expired | (F.col("count") < limit), F.lit(1)).otherwise(late))
        .withColumn("run", F.when(expired, F.lit(limit)).when(F.col("count") < limit, F.lit(limit) - F.col("count")).otherwise(limit))
        .withColumn("allowed", F.coalesce((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("run")), F.lit(False)))
        .select(*attempts.columns, "allowed")
    )


def _slot_tables(cut: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Transfer table of every slot, as rows (code, at) to (exit_count, exit_expires).

    Code 0 starts a new count at the attempt time ``at``; code c > 0 goes on
    from count c at the first attempt; PASS stands for an expiry after all
    attempts of the slot, which leaves the counter as it came in.
    """
    slot = Window.partitionBy(*KEY, "slot")
    ordered = slot.orderBy("ts", "attempt_id")
    numbered = cut.select(
        *KEY, "slot", "ts",
        F.row_number().over(ordered).alias("place"),
        F.count("*").over(slot).alias("n"),
        F.max("ts").over(slot).alias("last"),
        F.lag("ts").over(ordered).alias("before"),
        F.lead("ts", limit - 1).over(ordered).alias("full"),
        *[F.lead("ts", limit - c - 1).over(ordered).alias(f"full_{c}") for c in range(1, limit)],
    ).filter("before IS NULL OR before < ts")

    def entry(code: int, used: Column, full: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            F.when(F.lit(code) == 0, F.col("ts")).alias("at"),
            F.when(full.isNotNull(), F.lit(limit)).otherwise(used).cast("int").alias("exit_count"),
            (F.coalesce(full, F.col("last")) + F.lit(window_ms)).alias("exit_expires"),
        )

    fresh = entry(0, F.col("n") - F.col("place") + 1, F.col("full"))
    ongoing = [entry(c, F.col("n") + c, F.col(f"full_{c}")) for c in range(1, limit)]
    skipped = F.struct(
        F.lit(PASS).alias("code"), F.lit(None).cast("long").alias("at"), F.lit(UNCHANGED).alias("exit_count"), F.lit(0).cast("long").alias("exit_expires")
    )
    rows = F.when(F.col("place") == 1, F.array(fresh, *ongoing, skipped)).otherwise(F.array(fresh))
    return numbered.select(*KEY, "slot", F.inline(rows))


class _Transfer:
    """One table as arrays."""

    def __init__(self, rows: pd.DataFrame):
        new = rows[rows["code"] == 0].sort_values("at")
        self.at = new["at"].to_numpy(dtype=np.int64)
        self.new = new["exit_count"].to_numpy(), new["exit_expires"].to_numpy(dtype=np.int64)
        going = rows[rows["code"] > 0].sort_values("code")
        self.going = going["exit_count"].to_numpy(), going["exit_expires"].to_numpy(dtype=np.int64)
        skipped = rows[rows["code"] == PASS].iloc[0]
        self.skipped = int(skipped["exit_count"]), int(skipped["exit_expires"])

    def apply(self, count: np.ndarray, expires: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Counters after this stretch. An UNCHANGED counter has expired by the time it gets here."""
        index = np.where(count == UNCHANGED, 0, np.searchsorted(self.at, expires, side="left"))
        inside = np.minimum(index, len(self.at) - 1)
        out_count, out_expires = self.new[0][inside], self.new[1][inside]
        ongoing = (index > 0) & (count < limit) & (count > 0)
        if ongoing.any():
            out_count = np.where(ongoing, self.going[0][np.where(ongoing, count - 1, 0)], out_count)
            out_expires = np.where(ongoing, self.going[1][np.where(ongoing, count - 1, 0)], out_expires)
        beyond = (index == len(self.at)) & ~ongoing
        same = self.skipped[0] == UNCHANGED
        out_count = np.where(beyond, count if same else self.skipped[0], out_count)
        out_expires = np.where(beyond, expires if same else self.skipped[1], out_expires)
        return out_count, out_expires


def _stretches(rows: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    return sorted(((int(slot), part) for slot, part in rows.groupby("slot")), key=lambda entry: entry[0])


def _compose(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    (_, head), *rest = _stretches(rows)
    count, expires = head["exit_count"].to_numpy(), head["exit_expires"].to_numpy(dtype=np.int64)
    for _, part in rest:
        count, expires = _Transfer(part).apply(count, expires, limit)
    out = head[[*KEY, "code", "at"]].copy()
    out.insert(2, "slot", rows["parent"].iat[0])
    out["at"] = out["at"].astype("Int64")
    out["exit_count"], out["exit_expires"] = count, expires
    return out


def _descend(states: pd.DataFrame, rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    count, expires = states["count"].to_numpy()[:1], states["expires"].to_numpy(dtype=np.int64)[:1]
    entries = []
    for slot, part in _stretches(rows):
        entries.append((*states[KEY].iloc[0], slot, int(count[0]), int(expires[0])))
        count, expires = _Transfer(part).apply(count, expires, limit)
    return pd.DataFrame(entries, columns=[*KEY, "slot", "count", "expires"])
