"""Operator statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NEWEST_ACCOUNTS = 500


def account_stats(accounts: DataFrame, now_ms: int) -> DataFrame:
    since = F.lit(now_ms - 30 * DAY_MS)
    return accounts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(F.col("created_at") >= since).alias("new_30d"),
    )


def product_stats(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total"),
        F.count("description").alias("described"),
        F.count("source_text").alias("with_source"),
    )


def status_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("status").agg(F.count("*").alias("n"))


def table_totals(
    history: DataFrame, watch: DataFrame, channels: DataFrame, items: DataFrame, sites: DataFrame
) -> DataFrame:
    """Six totals in one row. Each table is counted on its own; the one-row results are stacked and folded."""

    def counted(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        n = F.count("*") if condition is None else F.count_if(condition)
        return df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")

    parts = [
        counted(history, "price_points"),
        counted(watch, "watches"),
        counted(channels, "channels", F.col("enabled") == 1),
        counted(items, "bistand"),
        counted(sites, "sites_enabled", F.col("enabled") == 1),
        counted(sites, "sites_total"),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    names = ["price_points", "watches", "channels", "bistand", "sites_enabled", "sites_total"]
    return stacked.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])


def daily_counts(table: DataFrame, ts_col: str, now_ms: int, days: int) -> DataFrame:
    """Rows per UTC day over the ``days`` days ending today, empty days included as zero."""
    today = now_ms // DAY_MS
    first = today - days + 1
    # A literal range on the raw column, so it reaches the scan.
    counted = (
        table.filter(F.col(ts_col).between(F.lit(first * DAY_MS), F.lit((today + 1) * DAY_MS - 1)))
        .groupBy(F.floor(F.col(ts_col) / F.lit(DAY_MS)).alias("day_no"))
        .agg(F.count("*").alias("n"))
    )
    axis = table.sparkSession.range(first, today + 1, 1, 1).withColumnRenamed("id", "day_no")
    return axis.join(counted, "day_no", "left").select(
        F.date_format(F.date_from_unix_date(F.col("day_no").cast("int")), "yyyy-MM-dd").alias("d"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def account_activity(
    accounts: DataFrame,
    jobs: DataFrame,
    watch: DataFrame,
    items: DataFrame,
    suggestions: DataFrame,
    limit: int | None = NEWEST_ACCOUNTS,
) -> DataFrame:
    """Activity counts of the newest accounts (all when ``limit`` is None).

    The four activity tables are counted in one aggregation, after a semi join
    with the listed accounts.
    """
    listed = accounts.select("id", "email", "role", "created_at")
    if limit is not None:
        listed = listed.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    sources = {"jobs": jobs, "watches": watch, "bistand": items, "suggestions": suggestions}
    stacked = None
    for name, table in sources.items():
        part = table.select("account_id", F.lit(name).alias("kind"))
        stacked = part if stacked is None else stacked.unionByName(part)
    keys = listed.select(F.col("id").alias("account_id"))
    counts = (
        stacked.join(keys if limit is None else F.broadcast(keys), "account_id", "left_semi")
        .groupBy(F.col("account_id").alias("id"))
        .agg(*[F.count_if(F.col("kind") == name).alias(name) for name in sources])
    )
    return listed.join(counts, "id", "left").select(
        "id", "email", "role", "created_at",
        *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in sources],
    )


def site_coverage(sites: DataFrame, products: DataFrame) -> DataFrame:
    """Product, description and source-text counts per site, by site name."""
    counts = products.groupBy(F.col("site_id").alias("id")).agg(
        F.count("*").alias("products"),
        F.count("description").alias("described"),
        F.count("source_text").alias("with_source"),
    )
    return (
        sites.join(counts, "id", "left")
        .select(
            "id", "name", "base_url", "detail_selector", "use_stealth", "enabled", "scrape_interval", "last_crawled",
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("products", "described", "with_source")],
        )
        .orderBy("name", "id")
    )


def expiring_tokens(tokens: DataFrame, now_ms: int, days: int = 0) -> DataFrame:
    """Tokens (name, expires_on ms) that expire within ``days`` (0 means 30), nearest first; past ones too."""
    limit = F.lit(now_ms + (days or 30) * DAY_MS)
    left = (F.col("expires_on") - F.lit(now_ms)) / F.lit(float(DAY_MS))
    return (
        tokens.filter(F.col("expires_on").isNotNull() & (F.col("expires_on") <= limit))
        .select("name", "expires_on", F.floor(left + F.lit(0.5)).alias("days_left"))
        .orderBy("days_left", "expires_on", "name")
    )


def expiry_summary(expiring: DataFrame) -> DataFrame:
    """One row with the count and subject line of an expiry notice; no row when nothing expires."""
    one = F.concat(F.lit("Token utgår om "), F.col("soonest").cast("string"), F.lit(" dagar"))
    many = F.concat(
        F.col("n").cast("string"), F.lit(" tokens utgår, närmast om "), F.col("soonest").cast("string"), F.lit(" dagar")
    )
    return (
        expiring.agg(F.count("*").alias("n"), F.min("days_left").alias("soonest"))
        .filter("n > 0")
        .select("n", "soonest", F.when(F.col("n") == 1, one).otherwise(many).alias("subject"))
    )
