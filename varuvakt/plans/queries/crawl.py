"""Page jobs and catalogue changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.operators import catalogue, crawl
from varuvakt.plans.fixtures import NOW_MS, Fixture
from varuvakt.plans.registry import query
from varuvakt.schemas import INGEST_BODY
from varuvakt.sources.exports import from_ndjson, to_ndjson

# Two queues in id order, that of the list jobs before the other.
CLAIMABLE = """queues AS (SELECT id, type = 'list' AS first, row_number() OVER (PARTITION BY type = 'list' ORDER BY id) AS place FROM render_jobs
 WHERE CASE status WHEN 'pending' THEN true WHEN 'leased' THEN lease_until < {now} ELSE false END),
claimable AS (SELECT j.* FROM render_jobs j JOIN queues q USING (id)
 WHERE q.place + CASE WHEN q.first THEN 0 ELSE (SELECT count(*) FROM queues WHERE first) END <= 50)"""
SITE_COLS = crawl.LIST_ONLY_SETTINGS


@query(
    "lease_batch",
    f"""WITH {CLAIMABLE}
SELECT j.id, j.url, j.site_id, j.type, CASE WHEN c.id IS NULL THEN j.status ELSE 'leased' END AS status,
 CASE WHEN c.id IS NULL THEN j.attempts ELSE j.attempts + 1 END AS attempts,
 CASE WHEN c.id IS NULL THEN j.lease_until ELSE {{now}} + CASE j.type WHEN 'list' THEN 900000 ELSE 120000 END END AS lease_until,
 CASE WHEN c.id IS NULL THEN j.updated_at ELSE {{now}} END AS updated_at
FROM render_jobs j LEFT JOIN claimable c ON c.id = j.id""",
)
def _lease_batch(fx: Fixture) -> DataFrame:
    after = crawl.lease_batch(fx.render_jobs, 70, NOW_MS)
    return after.select("id", "url", "site_id", "type", "status", "attempts", "lease_until", "updated_at")


@query(
    "lease_feed",
    f"""WITH {CLAIMABLE}
SELECT c.id, c.url, c.type, c.site_id, coalesce(s.detail_selector, '') AS detail_selector, coalesce(s.use_stealth, 0) AS use_stealth,
 {", ".join(f"CASE WHEN c.type = 'list' THEN s.{col} END AS {col}" for col in SITE_COLS)}
FROM claimable c LEFT JOIN sites s ON s.id = c.site_id""",
)
def _lease_feed(fx: Fixture) -> DataFrame:
    return crawl.lease_feed(crawl.claimable(fx.render_jobs, 50, NOW_MS), fx.sites)


@query(
    "reclaim_leases",
    """SELECT id, CASE WHEN status = 'leased' AND lease_until < {now} THEN 'pending' ELSE status END AS status, attempts, lease_until,
 CASE WHEN status = 'leased' AND lease_until < {now} THEN {now} ELSE updated_at END AS updated_at FROM render_jobs""",
)
def _reclaim_leases(fx: Fixture) -> DataFrame:
    return crawl.reclaim_leases(fx.render_jobs, NOW_MS).select("id", "status", "attempts", "lease_until", "updated_at")


# Every job reports once, some twice with a differing outcome.
JOB_RESULTS = """
SELECT event_id AS job_id, 2 * event_id AS ord, CASE WHEN event_id % 3 = 0 THEN concat(repeat('fel ', 200), props) WHEN event_id % 3 = 1 THEN '' ELSE NULL END AS error FROM events
UNION ALL SELECT event_id - event_id % 4 AS job_id, 2 * event_id + 1 AS ord, CASE WHEN event_type = 'error' THEN props ELSE NULL END AS error FROM events"""


@query(
    "apply_job_results",
    f"""WITH results AS ({JOB_RESULTS}),
folded AS (SELECT job_id, coalesce(last(coalesce(error, '') ORDER BY ord), '') AS last_result,
  last(error ORDER BY ord) FILTER (coalesce(error, '') <> '') AS last_text FROM results GROUP BY job_id)
SELECT j.id, j.attempts,
 CASE WHEN f.job_id IS NULL THEN j.status WHEN last_result = '' THEN 'done' WHEN j.attempts >= 5 THEN 'error' ELSE 'pending' END AS status,
 left(last_text, 500) AS last_error, CASE WHEN f.job_id IS NULL THEN j.updated_at ELSE {{now}} END AS updated_at
FROM render_jobs j LEFT JOIN folded f ON f.job_id = j.id""",
)
def _apply_job_results(fx: Fixture) -> DataFrame:
    results = fx.spark.sql(JOB_RESULTS.replace("FROM events", "FROM {events}"), events=fx.events)
    after = crawl.apply_job_results(fx.render_jobs, results, NOW_MS)
    return after.select("id", "attempts", "status", "last_error", "updated_at")


NEW_JOB_COLS = "id, url, site_id, type, status, attempts, created_at"


def new_jobs_sql(source: str, job_type: str, order: str = "url, site_id", where: str = "true") -> str:
    """Rows of a (url, site_id) source as numbered pending jobs."""
    key = "concat_ws('|', url, site_id::varchar)"
    return f"""SELECT (SELECT max(id) FROM render_jobs) + row_number() OVER (ORDER BY BUCKET({key}), {order}) AS id, url, site_id,
 '{job_type}' AS type, 'pending' AS status, 0 AS attempts, {{now}} AS created_at FROM {source} WHERE {where}"""


# Open jobs per page and per site.
URL_LOAD, SITE_LOAD = (
    f"""{name} AS (SELECT {key}, count(*) FILTER (status IN ('pending', 'leased')) AS n_open FROM render_jobs WHERE type = '{kind}' GROUP BY {key})"""
    for name, key, kind in (("url_load", "url", "detail"), ("site_load", "site_id", "list"))
)
DUE_DETAIL = f"""{URL_LOAD},
due AS (SELECT id AS pid, products.url, site_id FROM products LEFT JOIN url_load ON url_load.url = products.url
 WHERE coalesce(n_open, 0) = 0 AND NOT (source_text IS NOT NULL AND category IS NOT NULL) QUALIFY row_number() OVER (ORDER BY id) <= 200)"""
DUE_CRAWLS = f"""{SITE_LOAD},
due_sites AS (SELECT id AS sid, base_url AS url, id AS site_id FROM sites LEFT JOIN site_load ON site_load.site_id = sites.id
 WHERE coalesce(n_open, 0) = 0 AND enabled = 1 AND coalesce({{now}} - last_crawled > scrape_interval * 1000, last_crawled IS NULL))"""


@query("detail_jobs_due", f"WITH {DUE_DETAIL} {new_jobs_sql('due', 'detail')}")
def _detail_jobs_due(fx: Fixture) -> DataFrame:
    jobs = crawl.schedule_detail_jobs(fx.products, fx.render_jobs, NOW_MS)
    return jobs.select(*NEW_JOB_COLS.split(", "))


@query("crawls_due", f"WITH {DUE_CRAWLS} {new_jobs_sql('due_sites', 'list')}")
def _crawls_due(fx: Fixture) -> DataFrame:
    return crawl.schedule_crawls(fx.sites, fx.render_jobs, NOW_MS)[0].select(*NEW_JOB_COLS.split(", "))


@query(
    "crawled_sites",
    f"""WITH {DUE_CRAWLS}
SELECT id, name, CASE WHEN id IN (SELECT sid FROM due_sites) THEN {{now}} ELSE last_crawled END AS last_crawled FROM sites""",
)
def _crawled_sites(fx: Fixture) -> DataFrame:
    return crawl.schedule_crawls(fx.sites, fx.render_jobs, NOW_MS)[1].select("id", "name", "last_crawled")


LINK_JOBS = f"""{URL_LOAD},
firsts AS (SELECT url, arg_min(site_id, ord) AS site_id FROM found_links LEFT JOIN url_load USING (url) WHERE coalesce(n_open, 0) = 0 GROUP BY url),
item_firsts AS (SELECT * FROM firsts WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.url = firsts.url AND p.source_text IS NOT NULL))"""


@query(
    "link_detail_jobs",
    f"""WITH {LINK_JOBS}
SELECT 'link' AS variant, * FROM ({new_jobs_sql('firsts', 'detail')}) UNION ALL SELECT 'item', * FROM ({new_jobs_sql('item_firsts', 'detail')})""",
)
def _link_detail_jobs(fx: Fixture) -> DataFrame:
    sourced = fx.products.filter("source_text IS NOT NULL").select("url", F.lit(-1).cast("long").alias("ord"))
    cols = NEW_JOB_COLS.split(", ")
    plain = crawl.link_detail_jobs(fx.render_jobs, fx.found_links, NOW_MS).select(F.lit("link").alias("variant"), *cols)
    items = crawl.link_detail_jobs(fx.render_jobs, fx.found_links, NOW_MS, sourced)
    return plain.unionByName(items.select(F.lit("item").alias("variant"), *cols))


PRODUCT_COLS = (
    "id", "url", "site_id", "title", "current_price", "source_text", "category", "source_text_updated_at", "first_seen", "last_updated",
)


def upsert_sql(folded: str, values: list[str]) -> str:
    """Products after a folded change set with ``url``, ``site_id`` and the value columns."""
    stamp = (
        "CASE WHEN f.source_text IS NOT NULL THEN {now} ELSE p.source_text_updated_at END"
        if "source_text" in values
        else "p.source_text_updated_at"
    )
    fresh_stamp = "CASE WHEN f.source_text IS NOT NULL THEN {now} END" if "source_text" in values else "NULL::bigint"

    def old(col: str) -> str:
        return f"coalesce(f.{col}, p.{col})" if col in values else f"p.{col}"

    def new(col: str) -> str:
        return f"f.{col}" if col in values else "NULL"

    cols = ("title", "current_price", "source_text", "category")
    return f"""{folded}
SELECT p.id, p.url, p.site_id, {", ".join(f"{old(c)} AS {c}" for c in cols)}, {stamp} AS source_text_updated_at, p.first_seen,
 CASE WHEN f.url IS NULL THEN p.last_updated ELSE {{now}} END AS last_updated
FROM products p LEFT JOIN folded f ON f.url = p.url
UNION ALL
SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY BUCKET(f.url), f.url), f.url, f.site_id,
 {", ".join(new(c) for c in cols)}, {fresh_stamp}, {{now}}, {{now}}
FROM folded f WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.url = f.url)"""


def last_sql(col: str) -> str:
    return f"last({col} ORDER BY ord) FILTER ({col} IS NOT NULL)"


DETAILS = """details AS (SELECT j.url, j.site_id, r.* EXCLUDE (error) FROM crawl_results r JOIN render_jobs j ON j.id = r.job_id
 WHERE r.error IS NULL AND (title IS NOT NULL OR price IS NOT NULL OR source_text IS NOT NULL OR category IS NOT NULL))"""
DETAIL_FOLD = f"""WITH {DETAILS},
folded AS (SELECT url, arg_min(site_id, ord) AS site_id, {last_sql('title')} AS title, {last_sql('price')} AS current_price,
 {last_sql('source_text')} AS source_text, {last_sql('category')} AS category FROM details GROUP BY url)"""


def details(fx: Fixture) -> DataFrame:
    results = fx.crawl_results.filter("error IS NULL")
    jobs = fx.render_jobs.select(F.col("id").alias("job_id"), "url", "site_id")
    return results.join(jobs, "job_id")


@query("upsert_detail_result", upsert_sql(DETAIL_FOLD, ["title", "current_price", "source_text", "category"]))
def _upsert_detail_result(fx: Fixture) -> DataFrame:
    return catalogue.upsert_detail_results(fx.products, details(fx), NOW_MS).select(*PRODUCT_COLS)


@query(
    "detail_price_history",
    f"""WITH after AS ({upsert_sql(DETAIL_FOLD, ["title", "current_price", "source_text", "category"])}), {DETAILS}
SELECT a.id AS product_id, d.price, {{now}} AS ts FROM details d JOIN after a ON a.url = d.url WHERE d.price IS NOT NULL""",
)
def _detail_price_history(fx: Fixture) -> DataFrame:
    changes = details(fx)
    after = catalogue.upsert_detail_results(fx.products, changes, NOW_MS)
    return catalogue.detail_history(changes, after, NOW_MS)


ITEM_FOLD = f"""WITH folded AS (SELECT url, arg_min(site_id, ord) AS site_id, {last_sql('title')} AS title,
 {last_sql('price')} AS current_price, {last_sql('category')} AS category FROM list_items GROUP BY url)"""


@query("upsert_list_items", upsert_sql(ITEM_FOLD, ["title", "current_price", "category"]))
def _upsert_list_items(fx: Fixture) -> DataFrame:
    return catalogue.upsert_list_items(fx.products, fx.list_items, NOW_MS).select(*PRODUCT_COLS)


@query(
    "list_price_history",
    """WITH latest AS (SELECT product_id, max(ts) AS ts FROM price_history GROUP BY product_id),
standing AS (SELECT DISTINCT h.product_id, h.price FROM price_history h JOIN latest l ON l.product_id = h.product_id AND l.ts = h.ts),
offers AS (SELECT product_id, price, ord, EXISTS (SELECT 1 FROM standing s WHERE s.product_id = i.product_id AND s.price = i.price) AS known
  FROM list_items i WHERE price IS NOT NULL),
opened AS (SELECT *, bool_or(NOT known) OVER (PARTITION BY product_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS live FROM offers)
SELECT DISTINCT product_id, price, {now} AS ts FROM opened WHERE live""",
)
def _list_price_history(fx: Fixture) -> DataFrame:
    return catalogue.list_history(fx.list_items, fx.price_history, NOW_MS)


@query(
    "upsert_link_stubs",
    """WITH firsts AS (SELECT url, arg_min(site_id, ord) AS site_id FROM found_links GROUP BY url)
SELECT id, url, site_id, title, first_seen, last_updated FROM products
UNION ALL SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY BUCKET(url), url), url, site_id, NULL, {now}, {now}
FROM firsts WHERE url NOT IN (SELECT url FROM products)""",
)
def _upsert_link_stubs(fx: Fixture) -> DataFrame:
    after = catalogue.upsert_link_stubs(fx.products, fx.found_links, NOW_MS)
    return after.select("id", "url", "site_id", "title", "first_seen", "last_updated")


INGEST_ROWS = """
SELECT p_partkey AS ord,
 CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat('https://ny.example/p/', cast(p_partkey AS {s}))
  ELSE concat('https://shop', cast(p_partkey % 10 AS {s}), '.example/p/', cast(p_partkey AS {s})) END AS url,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(p_name, ' "ny" åäö') END AS title,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(p_size AS bigint) * 10 END AS price,
 CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 10 END AS site_id,
 CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE NULL END AS source_text FROM part"""


@query(
    "ingest_products",
    upsert_sql(
        f"""WITH folded AS (SELECT url, site_id, title, price AS current_price, source_text, NULL AS category
 FROM ({INGEST_ROWS.replace('{s}', 'varchar')}) WHERE url <> '')""",
        ["title", "current_price", "source_text"],
    ),
)
def _ingest_products(fx: Fixture) -> DataFrame:
    rows = fx.spark.sql(INGEST_ROWS.replace("{s}", "string").replace("FROM part", "FROM {part}"), part=fx.part)
    # The list arrives as one JSON body per row, like the lines of a transfer file.
    body = F.struct("url", "title", "price", "site_id", "source_text")
    lines = to_ndjson(rows.select("ord", F.array(body).alias("products")))
    arrived = from_ndjson(lines, f"ord long, {INGEST_BODY}").select("ord", F.inline("products"))
    return catalogue.ingest_products(fx.products, arrived, NOW_MS).select(*PRODUCT_COLS)


@query(
    "page_links",
    """WITH found AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
numbered AS (SELECT page_id, site, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM found),
links AS (SELECT page_id, site AS site_id, cast(pos AS bigint) AS pos, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS link FROM numbered)
SELECT * FROM links WHERE starts_with(link, CASE WHEN length(site_id) % 2 = 0 THEN site_id ELSE site_id || '/t' END)
 AND (length(site_id) % 3 <> 0 OR NOT contains(link, 'th'))""",
)
def _page_links(fx: Fixture) -> DataFrame:
    pages = fx.pages.select("page_id", "url", "html", F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("site_id"))
    settings = pages.select("site_id").distinct().selectExpr(
        "site_id",
        "CASE WHEN length(site_id) % 2 = 0 THEN site_id ELSE concat(site_id, '/t') END AS url_scope",
        "CASE WHEN length(site_id) % 3 = 0 THEN 'th' ELSE '' END AS exclude_link_pattern",
    )
    return crawl.page_links(pages, settings)


@query(
    "list_pages",
    """SELECT id AS site_id, page_no, CASE WHEN pagination_type = 'query' THEN base_url || '?page=' || page_no ELSE base_url END AS url
FROM (SELECT *, unnest(generate_series(1, CASE WHEN pagination_type = 'query' THEN max_pages ELSE 1 END)) AS page_no FROM sites)""",
)
def _list_pages(fx: Fixture) -> DataFrame:
    return crawl.list_pages(fx.sites)
