"""Catalogue and price-history changes from crawl results and bulk lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.operators.merge import first_seen_value, fold, insert_rows, last_known, upsert
from varuvakt.session import written


def _keep_known(col: str) -> Column:
    return F.coalesce(F.col(f"new_{col}"), F.col(col))


def _source_stamp(now_ms: int) -> Column:
    return F.when(F.col("new_source_text").isNotNull(), F.lit(now_ms)).otherwise(F.col("source_text_updated_at"))


def _upsert_products(
    products: DataFrame, changes: DataFrame, now_ms: int, value_cols: list[str]
) -> DataFrame:
    """Upsert by url. The site and the first-seen time of a known product never change."""
    folded = fold(changes, ["url"], "ord", coalesce_cols=value_cols, first_cols=["site_id"])
    assignments = {c: _keep_known(c) for c in value_cols}
    assignments["last_updated"] = F.lit(now_ms)
    values = {c: F.col(c) for c in value_cols}
    values |= {"site_id": F.col("site_id"), "first_seen": F.lit(now_ms), "last_updated": F.lit(now_ms)}
    if "source_text" in value_cols:
        assignments["source_text_updated_at"] = _source_stamp(now_ms)
        values["source_text_updated_at"] = F.when(F.col("source_text").isNotNull(), F.lit(now_ms))
    return upsert(products, folded, ["url"], assignments, values, id_col="id")


def upsert_detail_results(products: DataFrame, details: DataFrame, now_ms: int) -> DataFrame:
    """Products after detail results (url, site_id, ord, title, price, source_text, category).

    A result without any of the four values changes nothing.
    """
    given = details.filter(
        "title IS NOT NULL OR price IS NOT NULL OR source_text IS NOT NULL OR category IS NOT NULL"
    ).withColumnRenamed("price", "current_price")
    return _upsert_products(
        products, given, now_ms, ["title", "current_price", "source_text", "category"]
    )


def upsert_list_items(products: DataFrame, items: DataFrame, now_ms: int) -> DataFrame:
    """Products after list items (url, site_id, ord, title, price, category); items without url are dropped."""
    given = items.filter("url IS NOT NULL AND url != ''").withColumnRenamed("price", "current_price")
    return _upsert_products(products, given, now_ms, ["title", "current_price", "category"])


def ingest_products(products: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """Products after a bulk list (url, site_id, ord, title, price, source_text); no category, no history."""
    given = rows.filter("url IS NOT NULL AND url != ''").withColumnRenamed("price", "current_price")
    return _upsert_products(products, given, now_ms, ["title", "current_price", "source_text"])


def upsert_link_stubs(products: DataFrame, links: DataFrame, now_ms: int) -> DataFrame:
    """Bare urls become product stubs; known urls are left alone."""
    folded = written(fold(links, ["url"], "ord", first_cols=["site_id"]), "changes")
    values = {"url": F.col("url"), "site_id": F.col("site_id"), "first_seen": F.lit(now_ms), "last_updated": F.lit(now_ms)}
    return products.unionByName(insert_rows(products, folded, ["url"], values, id_col="id"))


def apply_crawl_batch(
    products: DataFrame,
    details: DataFrame,
    links: DataFrame,
    items: DataFrame,
    now_ms: int,
    ids_after: DataFrame | None = None,
) -> DataFrame:
    """Products after one batch mixing details, bare links and list items.

    The three kinds are upserted as one fold by url in batch order, so the base
    table is read once. Bare links only create; they never touch a known row.
    """
    null = F.lit(None)
    values = ["title", "current_price", "source_text", "category"]

    def shaped(df: DataFrame, kind: int, pos: Column, present: list[str]) -> DataFrame:
        return df.select(
            "url",
            F.col("site_id").cast("long").alias("site_id"),
            F.struct("ord", F.lit(kind).alias("kind"), pos.cast("int").alias("pos")).alias("ord"),
            (F.lit(kind) != 1).alias("writes"),
            *[
                F.col("price" if c == "current_price" else c).alias(c)
                if c in present
                else null.cast("long" if c == "current_price" else "string").alias(c)
                for c in values
            ],
        )

    given = details.filter(
        "title IS NOT NULL OR price IS NOT NULL OR source_text IS NOT NULL OR category IS NOT NULL"
    )
    changes = (
        shaped(given, 0, F.lit(0), values)
        .unionByName(shaped(links, 1, F.col("pos"), []))
        .unionByName(shaped(items, 2, F.col("pos"), ["title", "current_price", "category"]))
    )
    folded = changes.groupBy("url").agg(
        *[last_known(c, "ord") for c in values],
        first_seen_value("site_id", "ord"),
        F.max("writes").alias("writes"),
    )
    assignments = {c: _keep_known(c) for c in values}
    assignments["last_updated"] = F.when(F.col("new_writes"), F.lit(now_ms)).otherwise(F.col("last_updated"))
    assignments["source_text_updated_at"] = _source_stamp(now_ms)
    inserted = {c: F.col(c) for c in values} | {
        "site_id": F.col("site_id"),
        "first_seen": F.lit(now_ms),
        "last_updated": F.lit(now_ms),
        "source_text_updated_at": F.when(F.col("source_text").isNotNull(), F.lit(now_ms)),
    }
    return upsert(products, folded, ["url"], assignments, inserted, id_col="id", ids_after=ids_after)


def detail_history(details: DataFrame, products: DataFrame, now_ms: int) -> DataFrame:
    """A history point for every detail price, repeated or not."""
    priced = details.filter("price IS NOT NULL").select("url", "price")
    ids = products.select(F.col("id").alias("product_id"), "url")
    return priced.join(ids, "url").select("product_id", "price", F.lit(now_ms).cast("long").alias("ts"))


def list_history(
    items: DataFrame, history: DataFrame, now_ms: int, details: DataFrame | None = None
) -> DataFrame:
    """History points that list prices add, judged in batch order.

    ``items`` and ``details`` have product_id, price, ord. A list price is
    written unless it is among the prices at the product's latest point. Once
    something is written at ``now_ms`` the latest point is this batch itself, so
    from the first written price on, each distinct price is written once.
    ``now_ms`` must not lie before a product's latest point.
    """
    offers = items.filter("price IS NOT NULL").select("product_id", "price", "ord", F.lit(True).alias("listed"))
    if details is not None:
        offers = offers.unionByName(
            details.filter("price IS NOT NULL").select("product_id", "price", "ord", F.lit(False).alias("listed"))
        )
    # One row per (product, price): where it first occurs, and where it first occurs as a detail.
    firsts = offers.groupBy("product_id", "price").agg(
        F.min("ord").alias("first_ord"), F.min(F.when(~F.col("listed"), F.col("ord"))).alias("detail_ord")
    )
    touched = history.join(firsts.select("product_id").distinct(), "product_id", "left_semi")
    latest = touched.groupBy("product_id").agg(F.max("ts").alias("ts"))
    # Joining on (product, ts) spreads one product's points over tasks.
    current = (
        touched.join(latest, ["product_id", "ts"], "left_semi")
        .select("product_id", "price", (F.col("ts") == F.lit(now_ms)).alias("same_tick"))
        .distinct()
    )
    standing = firsts.join(current, ["product_id", "price"], "left")
    # A price among the latest points is no news by itself; only a detail writes it.
    opens = F.when(F.col("same_tick").isNull(), F.col("first_ord")).otherwise(F.col("detail_ord"))
    starts = standing.groupBy("product_id").agg(F.min(opens).alias("start_ord"))
    in_play = (
        offers.join(starts, "product_id")
        .filter(F.col("ord") >= F.col("start_ord"))
        .groupBy("product_id", "price")
        .agg(F.min_by("listed", "ord").alias("listed_first"))
        .filter("listed_first")
    )
    # Within the tick of the latest point its prices stay part of the set.
    return (
        in_play.join(current.filter("same_tick"), ["product_id", "price"], "left_anti")
        .select("product_id", "price", F.lit(now_ms).cast("long").alias("ts"))
    )
