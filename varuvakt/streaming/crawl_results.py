"""Crawl results as a stream into the catalogue, the price history and the job table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varuvakt.functions.text import blank_to_null
from varuvakt.operators.catalogue import apply_crawl_batch, detail_history, list_history
from varuvakt.operators.crawl import (
    MAX_ATTEMPTS,
    apply_job_results,
    flatten_results,
    link_detail_jobs,
    with_jobs,
)
from varuvakt.schemas import CRAWL_RESULT, TABLES
from varuvakt.sources.snapshots import BUCKETS, SnapshotStore
from varuvakt.streaming.clock import Clock, read_clock
from varuvakt.streaming.intake import COMPACT_AFTER, REJECT_SCHEMA, json_lines, query_id, split_rejects

NAMES = ("products", "price_history", "render_jobs")


def open_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> SnapshotStore:
    """``buckets``: folders of each laid-out base; choose them so that one holds a few files of a task's size."""
    keys = {"products": ["url"], "price_history": None, "render_jobs": ["id"]}
    schemas = {n: TABLES[n] for n in NAMES} | {"rejects": REJECT_SCHEMA}
    layout = {"products": "url", "price_history": "product_id", "render_jobs": "id"}
    return SnapshotStore(spark, root, schemas, keys | {"rejects": None}, layout, buckets)


def changed_tables(
    products: DataFrame,
    history: DataFrame,
    jobs: DataFrame,
    results: DataFrame,
    now_ms: int,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows,
    lookup: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Rows of the three tables that a batch of results adds or replaces.

    The tables are first narrowed to what the batch touches, so the work beyond
    that grows with the batch. ``keep`` may store a named intermediate result that is used several times;
    ``lookup(name, keys)`` may give fewer rows than the whole table, as long as all rows of ``keys`` (of one column) are
    among them. Whole columns are read only for the largest ids and for the jobs of found links.
    History is looked up, and details are judged with list prices, only for products with a list price in the batch: no others can get a point from a list.
    """
    whole = dict(zip(NAMES, (products, history, jobs), strict=True))

    def touched_by(name: str, keys: DataFrame) -> DataFrame:
        return (lookup(name, keys) if lookup else whole[name]).join(keys, keys.columns[0], "left_semi")

    reported = keep("reported", touched_by("render_jobs", results.select(F.col("job_id").alias("id"))))
    known = keep("known", with_jobs(results, reported))
    details, links, items = flatten_results(known)
    # Kept, so that their number is known when they meet the products.
    urls = keep("urls", details.select("url").unionByName(links.select("url")).unionByName(items.select("url")).distinct())
    touched = keep("touched", touched_by("products", urls))
    after = keep("products", apply_crawl_batch(touched, details, links, items, now_ms, ids_after=products))

    ids = after.select("url", F.col("id").alias("product_id"))
    item_place = F.struct("ord", F.lit(2).alias("kind"), F.col("pos").cast("int").alias("pos"))
    detail_place = F.struct("ord", F.lit(0).alias("kind"), F.lit(0).alias("pos"))
    offered = items.join(ids, "url").select("product_id", "price", item_place.alias("ord"))
    listed = keep("listed", offered.filter("price IS NOT NULL").select("product_id").distinct())
    seen = details.join(ids, "url").select("product_id", "price", detail_place.alias("ord")).join(listed, "product_id", "left_semi")
    priced = keep("history", touched_by("price_history", listed))
    points = detail_history(details, after, now_ms).unionByName(list_history(offered, priced, now_ms, seen))

    failed = blank_to_null(F.col("error")).isNotNull()
    reports = known.select("job_id", "ord", (failed & (F.col("attempts") < MAX_ATTEMPTS)).alias("active_after"))
    filled = (
        touched.filter("source_text IS NOT NULL")
        .select("url", F.lit(-1).cast("long").alias("ord"))
        .unionByName(details.filter("source_text IS NOT NULL").select("url", "ord"))
        .groupBy("url")
        .agg(F.min("ord").alias("filled_at"))
    )
    unfilled = items.join(filled, "url", "left").filter("filled_at IS NULL OR ord < filled_at")
    wanted = keep(
        "wanted", links.select("url", "site_id", "ord").unionByName(unfilled.select("url", "site_id", "ord"))
    )
    job_rows = apply_job_results(reported, results, now_ms)
    if not wanted.isEmpty():
        candidates = keep(
            "candidates", jobs.filter("type = 'detail'").join(wanted.select("url").distinct(), "url", "left_semi")
        )
        fresh_jobs = link_detail_jobs(candidates, wanted, now_ms, reports=reports, ids_after=jobs)
        job_rows = job_rows.unionByName(fresh_jobs)
    return {"products": after, "price_history": points, "render_jobs": job_rows}


def apply_results(store: SnapshotStore, results: DataFrame, batch: int, now_ms: Clock, writer: str = "") -> bool:
    """Commit one batch of results and its unreadable lines; a batch that is committed already changes nothing."""
    if store.is_committed(batch, writer):
        return False
    now = read_clock(now_ms)
    kept: list[DataFrame] = [results.persist()]

    def keep(name: str, rows: DataFrame) -> DataFrame:
        if name == "products":
            return store.stage(name, rows)
        # Filled at once: the many small jobs below would otherwise each compute it while it is not there yet.
        kept.append(rows.persist())
        kept[-1].count()
        return kept[-1]

    try:
        readable, rejects = split_rejects(kept[0])
        changes = changed_tables(*[store.read(n) for n in NAMES], readable, now, keep, store.lookup)
        del changes["products"]
        return store.commit(batch, changes | rejects, writer)
    finally:
        for rows in kept:
            rows.unpersist()


def stream_crawl_results(
    spark: SparkSession, source: str, store: SnapshotStore, checkpoint: str, now_ms: Clock, files_per_batch: int = 1, compact_after: int = COMPACT_AFTER, within: str | None = None
) -> StreamingQuery:
    """Consume JSON result files from ``source`` until none is left, one committed change per micro-batch.

    ``now_ms`` is a time or a function that is asked once per batch. Lines that do not fit the schema go to the table ``rejects``.
    With ``within`` (a time such as "2 days") messages that are delivered again count once.
    """
    writer = query_id(spark, checkpoint)

    def work(batch: DataFrame, number: int) -> None:
        apply_results(store, batch, number, now_ms, writer())
        store.compact(compact_after)

    return (
        json_lines(spark, source, CRAWL_RESULT, files_per_batch, within)
        .writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
