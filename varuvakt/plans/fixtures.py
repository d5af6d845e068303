"""Domain views over the given tables, one SQL text for both engines.

``STR`` is the text type and ``MS(col)`` the unix milliseconds of a timestamp
column; raw tables are written ``{name}``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

NOW_MS = 1706659200000  # 2024-01-31T00:00Z
NOW_PRICES_MS = 1004918400000  # 2001-11-05T00:00Z, just after the last ship date

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "sites": """
SELECT s_suppkey AS id, s_name AS name, concat('https://shop', cast(s_suppkey AS STR), '.example') AS base_url,
 '.product' AS product_selector, '.title' AS title_selector, '.price' AS price_selector, 'a' AS link_selector,
 CASE WHEN s_suppkey % 3 = 0 THEN '.product-description' ELSE '' END AS detail_selector,
 CASE WHEN s_suppkey % 4 = 0 THEN 'single' ELSE 'query' END AS pagination_type,
 1 + s_suppkey % 5 AS max_pages, CASE WHEN s_suppkey % 2 = 0 THEN '/cart' ELSE '' END AS exclude_link_pattern,
 concat('https://shop', cast(s_suppkey AS STR), '.example/p/') AS url_scope,
 cast(s_suppkey % 2 AS int) AS use_stealth,
 CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE 1 END AS enabled,
 cast(3600 * (1 + s_nationkey % 3) AS bigint) AS scrape_interval,
 CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE 1706659200000 - 1800000 * s_nationkey END AS last_crawled
 FROM {supplier}""",
    "products": """
SELECT p_partkey AS id, concat('https://shop', cast(p_partkey % 10 AS STR), '.example/p/', cast(p_partkey AS STR)) AS url,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 10 END AS site_id,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS title,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE cast(floor(p_retailprice) AS bigint) END AS current_price,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat(p_name, ' ', p_brand) END AS source_text,
 CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE p_type END AS category,
 CASE WHEN p_size % 2 = 0 THEN concat('En ', p_name) ELSE NULL END AS description,
 CASE WHEN p_size % 4 = 0 THEN concat('Bra ', p_brand) ELSE NULL END AS description_why,
 CASE WHEN p_size % 2 = 0 THEN 1706659200000 - cast(p_size AS bigint) * 86400000 + p_partkey ELSE NULL END AS description_updated_at,
 cast(NULL AS bigint) AS source_text_updated_at,
 1704067200000 + p_partkey AS first_seen, 1704067200000 + 2 * p_partkey AS last_updated FROM {part}""",
    "price_history": """
SELECT l_partkey AS product_id, cast(floor(l_extendedprice / l_quantity) AS bigint) AS price, MS(l_shipdate) AS ts
 FROM {lineitem}""",
    "accounts": """
SELECT c_custkey AS id, concat('user', cast(c_custkey AS STR), '@example.com') AS email,
 CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role, 'auto' AS describe_mode,
 1706659200000 - (c_custkey % 60) * 86400000 + c_custkey AS created_at FROM {customer}""",
    "price_watch": """
SELECT o_custkey AS account_id, l_partkey AS product_id,
 CASE WHEN l_partkey % 5 = 0 THEN 1706659200000 - (l_partkey % 48) * 3600000 ELSE NULL END AS last_alert,
 min(MS(o_orderdate)) AS created_at
 FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY o_custkey, l_partkey""",
    "alert_channels": """
SELECT c_custkey AS id, c_custkey AS account_id,
 CASE c_nationkey % 5 WHEN 0 THEN 'ntfy' WHEN 1 THEN 'slack' WHEN 2 THEN 'telegram' WHEN 3 THEN 'webhook' ELSE 'fax' END AS kind,
 CASE c_custkey % 6 WHEN 0 THEN 'https://hooks.example.com/a' WHEN 1 THEN 'http://hooks.example.com/a' WHEN 2 THEN 'https://10.1.2.3/x'
  WHEN 3 THEN 'https://172.16.0.1/x' WHEN 4 THEN '12345:AbC:678' ELSE 'https://printer.local/x' END AS target,
 CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END AS enabled, 1704067200000 + c_custkey AS created_at FROM {customer}""",
    "render_jobs": """
SELECT event_id AS id, concat('https://shop', cast(user_id % 10 AS STR), '.example/p/', cast(user_id AS STR)) AS url,
 user_id % 10 AS site_id, CASE WHEN event_id % 50 = 0 THEN 'list' ELSE 'detail' END AS type,
 CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'leased' WHEN 'error' THEN 'error' ELSE 'done' END AS status,
 cast(event_id % 6 AS int) AS attempts,
 CASE WHEN event_type = 'view' THEN MS(ts) + (event_id % 20) * 86400000 ELSE NULL END AS lease_until,
 cast(NULL AS STR) AS last_error, MS(ts) AS created_at, MS(ts) AS updated_at FROM {events}""",
    "page_suggestions": """
SELECT conv_id * 100 + turn AS id, conv_id % 40 AS account_id,
 concat('user', cast(conv_id % 40 AS STR), '@example.com') AS email, text AS title, '' AS description,
 CASE conv_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'coded' WHEN 2 THEN 'approved' ELSE 'rejected' END AS status,
 1704067200000 + conv_id * 1000 + turn AS created_at FROM {conversations} WHERE role = 'user'""",
    "bistand_items": """
SELECT o_custkey AS account_id, l_partkey AS product_id,
 CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('behov ', cast(l_partkey AS STR)) END AS motivation,
 min(MS(o_orderdate)) AS created_at FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_linenumber = 2
 GROUP BY o_custkey, l_partkey""",
    "upload_rows": """
SELECT conv_id AS job_id, turn AS row_index, text AS product FROM {conversations} WHERE role = 'user'""",
    "row_results": """
SELECT conv_id AS job_id, turn - 1 AS row_index, CASE WHEN turn % 4 = 1 THEN '' ELSE text END AS beskrivning,
 CASE WHEN turn % 4 = 1 THEN '' ELSE concat('varför ', cast(turn AS STR)) END AS varfor
 FROM {conversations} WHERE role = 'assistant' AND turn > 0""",
    "crawl_items": """
SELECT MS(l_shipdate) AS ts, l_partkey AS product_id, cast(floor(l_extendedprice / l_quantity) AS bigint) AS price,
 (l_orderkey * 10 + l_linenumber) * 1000000 + cast(floor(l_extendedprice / l_quantity) AS bigint) AS ord FROM {lineitem}""",
    "jobs": """
SELECT conv_id AS id, conv_id % 40 AS account_id,
 CASE conv_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'paused' WHEN 3 THEN 'done' ELSE 'error' END AS status,
 concat('fil ', cast(conv_id AS STR), '.csv') AS filename, cast(NULL AS STR) AS output_key,
 CASE conv_id % 6 WHEN 0 THEN 'saklig' WHEN 1 THEN 'entusiastisk' WHEN 2 THEN 'humoristisk' WHEN 3 THEN 'lyxig' WHEN 4 THEN 'okänd' ELSE NULL END AS tone,
 CASE conv_id % 4 WHEN 0 THEN 'kort' WHEN 1 THEN 'medel' WHEN 2 THEN 'lang' ELSE '' END AS length,
 CASE conv_id % 3 WHEN 0 THEN '  barn ' WHEN 1 THEN '  ' ELSE NULL END AS audience,
 CASE conv_id % 2 WHEN 0 THEN ' skriv kort ' ELSE '' END AS custom_direction,
 count(*) AS total, cast(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS bigint) AS succeeded,
 cast(NULL AS STR) AS error_message,
 1704067200000 + conv_id * 3600000 AS created_at, 1704067200000 + conv_id * 3600000 AS updated_at
 FROM {conversations} GROUP BY conv_id""",
    # A fetcher's answers to every page job.
    "crawl_results": """
SELECT event_id AS job_id, event_id AS ord, CASE WHEN event_type = 'error' THEN concat('timeout ', props) ELSE NULL END AS error,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Titel ', cast(event_id AS STR)) END AS title,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(floor(value) AS bigint) END AS price,
 CASE WHEN event_id % 3 = 0 THEN concat('Info ', props) ELSE NULL END AS source_text,
 CASE WHEN event_id % 7 = 0 THEN event_type ELSE NULL END AS category FROM {events}""",
    # List items in one batch order: crawl day, job, line, price.
    "list_items": """
SELECT concat('https://shop', cast(l_partkey % 10 AS STR), '.example/p/', cast(l_partkey + l_partkey % 3 * 1000000 AS STR)) AS url,
 l_partkey + l_partkey % 3 * 1000000 AS product_id, l_suppkey % 10 AS site_id,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('Titel ', cast(l_orderkey AS STR)) END AS title,
 CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE cast(floor(l_extendedprice / l_quantity) AS bigint) END AS price,
 CASE WHEN l_linenumber = 2 THEN l_returnflag ELSE NULL END AS category,
 ((MS(l_shipdate) DIV 86400000 * 10000000 + l_orderkey) * 10 + l_linenumber) * 1000000 + l_suppkey * 1000
  + cast(floor(l_extendedprice) AS bigint) % 1000 AS ord FROM {lineitem}""",
    # Urls found on listing pages; some lead to products, some are new.
    "found_links": """
SELECT concat('https://shop', cast(l_partkey * 3 % 10 AS STR), '.example/p/', cast(l_partkey * 3 AS STR)) AS url,
 l_suppkey AS site_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS ord FROM {lineitem}""",
}


def render(view: str, dialect: str) -> str:
    """SQL text of a view for ``spark`` or ``duckdb``; raw tables stay as ``{name}`` for Spark."""
    spark = dialect == "spark"
    millis = r"unix_millis(cast(\1 AS timestamp))" if spark else r"(epoch_us(\1) DIV 1000)"
    sql = re.sub(r"MS\((\w+)\)", millis, VIEWS[view])
    sql = re.sub(r"\bSTR\b", "string" if spark else "varchar", sql)
    if spark:
        return sql
    return re.sub(r"\{(\w+)\}", r"\1", sql.replace(" DIV ", " // "))


class Fixture:
    """Raw tables and domain views of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = render(name, "spark")
        used = set(re.findall(r"\{(\w+)\}", sql))
        return self.spark.sql(sql, **{table: self.raw(table) for table in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in RAW:
            return self.raw(name)
        raise AttributeError(name)

    @cached_property
    def upload_headers(self) -> DataFrame:
        return self.spark.sql(
            "SELECT DISTINCT job_id, array('Site', 'Product', 'Price (SEK)', 'Link') AS fieldnames FROM {rows}",
            rows=self.upload_rows,
        )

    @cached_property
    def upload_cells(self) -> DataFrame:
        return self.spark.sql(
            "SELECT job_id, row_index, array('butik, 1', product, cast(row_index * 10 AS string), '') AS cells FROM {rows}",
            rows=self.upload_rows,
        )
