"""Throttling as a stateful stream: the state of a key is its counter and expiry, and it is forgotten when that has passed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from varuvakt.operators.throttle import step

OUT_SCHEMA = "bucket string, ip string, ts long, attempt_id long, allowed boolean"
STATE_SCHEMA = "count int, expires long"
#: Decisions handed on at a time.
CHUNK = 10_000


def throttle_stream(attempts: DataFrame, limit: int, window_seconds: int, lateness: str = "1 minute") -> DataFrame:
    """Streaming attempts (bucket, ip, ts, attempt_id) with the decision ``allowed``.

    Attempts of one key must arrive in time order over micro-batches, up to ``lateness`` apart; what lags more gets no decision.
    Within a micro-batch they are put in order here, as two numbers an attempt. Once event time has passed a counter's expiry, it
    would start anew, so its state is dropped.
    """
    window_ms = window_seconds * 1000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, expires = state.get if state.exists else (0, 0)
        parts = [rows[["ts", "attempt_id"]].to_numpy(np.int64) for rows in batches]
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        allowed, count, expires = step(rows[:, 0], count, expires, limit, window_ms)
        if expires > state.getCurrentWatermarkMs():
            state.update((count, expires))
            state.setTimeoutTimestamp(expires)
        elif state.exists:
            state.remove()
        for at in range(0, len(rows), CHUNK):
            piece = rows[at : at + CHUNK]
            yield pd.DataFrame({"bucket": key[0], "ip": key[1], "ts": piece[:, 0], "attempt_id": piece[:, 1], "allowed": allowed[at : at + CHUNK]})

    timed = attempts.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", lateness)
    return timed.groupBy("bucket", "ip").applyInPandasWithState(decide, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
