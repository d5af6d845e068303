"""Price points as a stream with keyed state: the newest pair of a product, the cooldown of a watch, accepted deliveries fed back.

Two queries, joined by folders under one root:

``stream_pairs``: points -> the two newest points of each product as state -> ``pairs``, one row per batch for a product
with new points whose newest pair is a drop, or was one before.
``stream_alerts``: pairs fanned out to their watches, and accepted deliveries -> per watch the standing drop, the time of its last accepted
alert and of the one under way -> alerts -> messages -> ``deliver`` -> ``accepted``, which this query reads again.

Neither reads the price history, the alerts or the deliveries of earlier batches. A watch is asked again by timers in event time (the messages'
arrival ``at``): when a cooldown ends while the drop still stands, and ``retry_ms`` after an alert that no channel accepted, or whose outcome was
lost. Only an accepted alert starts the cooldown. A watch without a standing drop, an alert under way or a running cooldown keeps no state.

A batch that runs again after a failure raises the same alerts; messages of a batch whose deliveries are stored are not sent again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from varuvakt.operators.describe import Deliver, deliver_with
from varuvakt.operators.prices import COOLDOWN_HOURS, HOUR_MS, MIN_DROP_KR, MIN_DROP_PCT, alert_messages, drop_pct
from varuvakt.streaming.intake import finished, query_id

#: A price point as it arrives: ``at`` is the time of its arrival, ``message_id`` that of its message, if it has one.
POINT_SCHEMA = "product_id long, price long, ts long, at long, message_id string"
PAIR_SCHEMA = "product_id long, at long, old_price long, new_price long"
#: Products, and watches, are dealt into so many groups, each with one row of state: lists with an entry per product or watch. A group costs some
#: milliseconds of Python a batch however few entries it has, so a group per product or watch would cost that for each of them.
GROUPS = 4096
#: Seen messages are only looked up, all of a group at once, so fewer and longer lists do.
SEEN_GROUPS = 512
POINT = ["product_id", "price", "ts", "at"]
SEEN_STATE = "ids binary, until binary"
#: Seen messages outgrow the executors' memory, so the query of pairs keeps its state on their disks, and each batch stores what it changed.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PAIR_STATE = "product_id array<long>, ts array<long>, price array<long>, ts_before array<long>, price_before array<long>, points array<long>"
ACCEPTED_SCHEMA = "account_id long, product_id long, at long"
ALERT_SCHEMA = "account_id long, product_id long, at long, old_price long, new_price long"
WATCH_STATE = (
    "account_id array<long>, product_id array<long>, old_price array<long>, new_price array<long>, standing array<boolean>, "
    "last_alert array<long>, asked array<long>, due array<long>"
)
WATCH_KEY = ["account_id", "product_id"]
#: Fields of a message by which a watch's rows are ordered and walked; of equal times an accepted delivery comes before a pair.
WALKED = ["at", "pair", "old_price", "new_price", "standing", "last_alert"]

NEVER = -(2**62)
RETRY_MS = 300_000
#: How far event time stays behind the newest message; messages that lag more are left out.
LATENESS_MS = 1_000
REDELIVERED_WITHIN = "2 days"


def two_newest(points: DataFrame) -> DataFrame:
    """At most two rows per product leave a batch of a task, the newest first; ``at`` is the product's last arrival in it."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            order = np.lexsort((rows["price"], rows["ts"], rows["product_id"]))[::-1]
            rows = rows.take(order)
            first = np.r_[True, np.diff(rows["product_id"]) != 0][: len(rows)]
            # A product's first two rows: its newest, and the one after a newest.
            near, number = first | np.r_[False, first[:-1]][: len(rows)], np.cumsum(first) - 1
            last = np.maximum.reduceat(rows["at"].to_numpy(), np.flatnonzero(first)) if len(rows) else np.empty(0, np.int64)
            yield rows[near].assign(at=last[number[near]])

    whole = points.select("product_id", "price", "ts", "at").dropna()
    return whole.mapInPandas(keep, "product_id long, price long, ts long, at long")


class Unseen(StatefulProcessor):
    """Lets the points of a group through whose digest it does not remember, and remembers each for ``span_ms`` from its time."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", SEEN_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        water = timerValues.getCurrentWatermarkInMs()
        # An entry per batch, so a batch adds to the state and rewrites it only when something is forgotten.
        held = [(np.frombuffer(ids, np.int64).reshape(-1, 2), np.frombuffer(until, np.int64)) for ids, until in self.seen.get()]
        kept = [(ids[until > water], until[until > water]) for ids, until in held]
        if sum(len(until) for _, until in kept) < sum(len(until) for _, until in held):
            self.seen.put([(ids.tobytes(), until.tobytes()) for ids, until in kept if len(until)])
        new = pd.concat(list(rows))
        known = np.concatenate([ids for ids, _ in kept]) if kept else np.empty((0, 2), np.int64)
        ids = np.concatenate([known, digests(new)])
        order = np.lexsort((ids[:, 1], ids[:, 0]))  # stable: a held one, else the first to come, leads its equals
        leads = np.r_[True, (np.diff(ids[order], axis=0) != 0).any(axis=1)]
        fresh = np.sort(order[leads]) - len(known)
        new = new.iloc[fresh[fresh >= 0]]
        timed = new[new["timed"]]  # without a time a message is forgotten at once
        if len(timed):
            self.seen.appendValue((digests(timed).tobytes(), (timed["at"].to_numpy() + self.span_ms).tobytes()))
        yield new.loc[new["whole"], POINT]

    def close(self) -> None:
        pass


def digests(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["digest"]), np.int64).reshape(-1, 2)


def counted_once(points: DataFrame, within: str) -> DataFrame:
    """Streaming points without those delivered again, as by ``intake.once``; points without product, price or time are left out after that.

    A message is remembered by 16 bytes of a digest and 8 of the time until which, in lists of its group on the executors' disks: a row of state per
    message takes some hundred bytes of memory. A group forgets when it next gets a message.
    """
    span_ms = points.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{within}')").first()[0]
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in points.columns])), 256)
    named = points.withColumn("time", F.timestamp_millis("at")).withWatermark("time", within)
    digest = F.unhex(F.substring(F.sha2(F.coalesce("message_id", content), 256), 1, 32))
    plain = [F.coalesce(c, F.lit(0)).alias(c) for c in POINT]  # integers with NULLs would come as floats
    whole = reduce(and_, [F.col(c).isNotNull() for c in POINT])
    told = named.select("time", digest.alias("digest"), F.col("at").isNotNull().alias("timed"), whole.alias("whole"), *plain)
    dealt = told.withColumn("group", F.pmod(F.xxhash64("digest"), F.lit(SEEN_GROUPS)))
    shape = ", ".join(f"{c} long" for c in POINT)
    return dealt.groupBy("group").transformWithStateInPandas(Unseen(span_ms), shape, "append", "EventTime")


def price_pairs(points: DataFrame) -> DataFrame:
    """Streaming points -> product_id, at, old_price, new_price of the products that had points in the batch and whose pair is a drop, or was one before."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches))
        held = [np.array(c, np.int64) for c in state.get] if state.exists else [np.empty(0, np.int64)] * 6
        product, ts, price, ts_before, price_before, points = held
        two = points == 2
        n_new, n_held, n_two = len(new), len(product), int(two.sum())
        # New points, the newest held ones and the second newest; a held one has no arrival, the newest of a drop tells that.
        ids = np.concatenate([new["product_id"], product, product[two]])
        times = np.concatenate([new["ts"], ts, ts_before[two]])
        prices = np.concatenate([new["price"], price, price_before[two]])
        at = np.concatenate([new["at"], np.full(n_held + n_two, NEVER)])
        fell = np.concatenate([np.zeros(n_new, bool), price < price_before, np.zeros(n_two, bool)])
        order = np.lexsort((prices, times, ids))[::-1]
        ids, times, prices, at, fell = (c[order] for c in (ids, times, prices, at, fell))
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        second = np.minimum(first + 1, len(ids) - 1)
        second = np.where(ids[second] == ids[first], second, first)
        state.update(tuple(c.tolist() for c in (ids[first], times[first], prices[first], times[second], prices[second], 1 + (second > first))))
        at, fell = np.maximum.reduceat(at, first), np.logical_or.reduceat(fell, first)
        told = (at != NEVER) & ((prices[first] < prices[second]) | fell)
        if told.any():
            first, second = first[told], second[told]
            yield pd.DataFrame({"product_id": ids[first], "at": at[told], "old_price": prices[second], "new_price": prices[first]})

    dealt = two_newest(points).withColumn("group", F.pmod(F.xxhash64("product_id"), F.lit(GROUPS)))
    return dealt.groupBy("group").applyInPandasWithState(pair, PAIR_SCHEMA, PAIR_STATE, "append", GroupStateTimeout.NoTimeout)


def watched_pairs(pairs: DataFrame, watch: DataFrame, products: DataFrame, channels: DataFrame, min_pct: float = 0, min_kr: float = 0) -> DataFrame:
    """Pairs for every watch of a known product by a reachable account; ``standing``: a drop past both thresholds (zero: the default)."""
    kr, pct = F.col("old_price") - F.col("new_price"), drop_pct(F.col("old_price"), F.col("new_price"))
    standing = (kr > 0) & (pct >= (min_pct or MIN_DROP_PCT)) & (kr >= (min_kr or MIN_DROP_KR))
    known = products.select(F.col("id").alias("product_id"))
    reachable = channels.filter("enabled = 1").select("account_id")
    return (
        pairs.withColumn("standing", F.coalesce(standing, F.lit(False)))
        .join(known, "product_id", "left_semi")
        .join(watch.select(*WATCH_KEY, "last_alert"), "product_id")
        .join(reachable, "account_id", "left_semi")
        .select(*WATCH_KEY, "at", "old_price", "new_price", "standing", F.coalesce("last_alert", F.lit(NEVER)).alias("last_alert"), F.lit(True).alias("pair"))
    )


def due_alerts(messages: DataFrame, cooldown_ms: int, retry_ms: int, lateness_ms: int) -> DataFrame:
    """Watched pairs and accepted deliveries, in event time ``time`` -> alerts to send now.

    The rows of a watch in one batch are walked by time; of several pairs that arrived since the last batch each may alert, if
    nothing is under way.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(a, p): kept for a, p, *kept in zip(*state.get)} if state.exists else {}
        water = state.getCurrentWatermarkMs()
        arrived: dict[tuple[int, int], list[tuple]] = {}
        for part in batches:
            # Plain tuples: a watch has a row or two a batch, for which frames cost more than the work.
            for a, p, *row in zip(*[part[c].tolist() for c in [*WATCH_KEY, *WALKED]], strict=True):
                arrived.setdefault((a, p), []).append(row)
        timed_out = [watch for watch, kept in held.items() if kept[-1] < water and watch not in arrived]
        alerts = []
        for watch in [*arrived, *timed_out]:
            old, new, standing, last, asked, _ = held.pop(watch, (0, 0, False, NEVER, NEVER, NEVER))
            rows = sorted(arrived.get(watch, ()))
            now = rows[-1][0] if rows else water + lateness_ms
            # Without a row it is the timer that asks.
            for at, pair, old_price, new_price, stands, alerted in rows or [(now, None, 0, 0, False, NEVER)]:
                if pair:
                    old, new, standing, last = old_price, new_price, stands, max(last, alerted)
                elif pair is not None:
                    last, asked = max(last, at), NEVER if asked == at else asked
                    continue
                if asked != NEVER and asked + retry_ms <= at:
                    asked = NEVER  # not accepted, or its outcome was lost
                if standing and asked == NEVER and (last == NEVER or last + cooldown_ms <= at):
                    alerts.append((*watch, at, old, new))
                    asked = at
            cooled = last + cooldown_ms if last != NEVER else NEVER
            due = asked + retry_ms if asked != NEVER else cooled if cooled > now or standing else NEVER
            if due != NEVER:
                held[watch] = (old, new, standing, last, asked, max(due, water + 1, 1))
        if held:
            state.update(tuple(map(list, zip(*[(*watch, *kept) for watch, kept in held.items()]))))
            state.setTimeoutTimestamp(max(min(kept[-1] for kept in held.values()), water + 1, 1))
        elif state.exists:
            state.remove()
        if alerts:
            yield pd.DataFrame(np.array(alerts, np.int64), columns=[*WATCH_KEY, "at", "old_price", "new_price"])

    dealt = messages.withColumn("group", F.pmod(F.xxhash64(*WATCH_KEY), F.lit(GROUPS)))
    return dealt.groupBy("group").applyInPandasWithState(decide, ALERT_SCHEMA, WATCH_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _land(spark: SparkSession, folder: str, schema: str) -> str:
    """A folder that a stream may read before anything is written to it."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return folder


def stream_pairs(spark: SparkSession, source: str, root: str, within: str = REDELIVERED_WITHIN, trigger: dict | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Parquet files of points in ``source`` -> ``root``/pairs. A point that is delivered again within ``within`` of its arrival counts once."""
    points = spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = price_pairs(counted_once(points, within)).writeStream.format("parquet").option("checkpointLocation", f"{root}/pairs-checkpoint")
    before = {key: spark.conf.get(key, None) for key in ON_DISK}
    try:
        for key, value in ON_DISK.items():
            spark.conf.set(key, value)
        return out.trigger(**(trigger or {"availableNow": True})).start(f"{root}/pairs")  # which keeps a copy of the settings
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_alerts(
    spark: SparkSession,
    root: str,
    watch: DataFrame,
    products: DataFrame,
    channels: DataFrame,
    deliver: Deliver,
    min_pct: float = 0,
    min_kr: float = 0,
    cooldown_hours: float = 0,
    retry_ms: int = RETRY_MS,
    lateness_ms: int = LATENESS_MS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """``root``/pairs and ``root``/accepted -> ``root``/alerts, ``root``/deliveries and ``root``/accepted.

    The three tables are read anew when the query starts.
    """
    pairs = spark.readStream.schema(PAIR_SCHEMA).parquet(f"{root}/pairs")
    back = spark.readStream.schema(ACCEPTED_SCHEMA).parquet(_land(spark, f"{root}/accepted", ACCEPTED_SCHEMA))
    fed = back.selectExpr(*WATCH_KEY, "at", "0L AS old_price", "0L AS new_price", "false AS standing", f"{NEVER}L AS last_alert", "false AS pair")
    messages = watched_pairs(pairs, watch, products, channels, min_pct, min_kr).unionByName(fed)
    timed = messages.withColumn("time", F.timestamp_millis("at")).withWatermark("time", f"{lateness_ms} milliseconds")
    alerts = due_alerts(timed, int((cooldown_hours or COOLDOWN_HOURS) * HOUR_MS), retry_ms, lateness_ms)
    checkpoint = f"{root}/alerts-checkpoint"
    named = query_id(spark, checkpoint)

    def send(batch: DataFrame, number: int) -> None:
        place = f"writer={named()}/batch={number}"
        raised_at, sent_at = f"{root}/alerts/{place}", f"{root}/deliveries/{place}"
        batch.write.mode("overwrite").parquet(raised_at)
        raised = spark.read.schema(ALERT_SCHEMA).parquet(raised_at)
        if not finished(spark, sent_at):
            drop = [(F.col("old_price") - F.col("new_price")).alias("drop_kr"), drop_pct(F.col("old_price"), F.col("new_price")).alias("drop_pct")]
            told = raised.select("*", *drop).join(products.select(F.col("id").alias("product_id"), "title", "url"), "product_id")
            deliver_with(alert_messages(told, channels), deliver).write.mode("overwrite").parquet(sent_at)
        sent = spark.read.parquet(sent_at).where("ok").select(*WATCH_KEY).distinct()
        raised.join(sent, WATCH_KEY, "left_semi").select(*WATCH_KEY, "at").write.mode("append").parquet(f"{root}/accepted")

    out = alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def raised_alerts(spark: SparkSession, root: str) -> DataFrame:
    """account_id, product_id, at, old_price, new_price, ok: every alert raised so far and whether a channel accepted it."""
    raised = spark.read.schema(ALERT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/alerts")
    accepted = spark.read.schema(ACCEPTED_SCHEMA).parquet(f"{root}/accepted").distinct().withColumn("ok", F.lit(True))
    return raised.join(accepted, [*WATCH_KEY, "at"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
