"""Catalogue search and request triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.urls import safe_target_url
from varuvakt.operators import channels, describe, postings, search
from varuvakt.plans.fixtures import Fixture
from varuvakt.plans.registry import query
from varuvakt.session import shared_dir

# A channel request's target, padded, and an address space of test URLs.
TARGETS = """
 CASE c_custkey % 12 WHEN 0 THEN concat(' https://hooks.example.com/', cast(c_custkey AS STR), ' ')
  WHEN 1 THEN concat('http://hooks.example.com/', cast(c_custkey AS STR)) WHEN 2 THEN 'https://LOCALHOST/x'
  WHEN 3 THEN 'https://a.internal' WHEN 4 THEN 'https://[::1]/x' WHEN 5 THEN 'not a url' WHEN 6 THEN '   '
  WHEN 7 THEN 'https://2130706433/' WHEN 8 THEN '12345:AbC:678'
  ELSE concat('https://', cast(c_custkey * 7 % 256 AS STR), '.', cast(c_custkey % 256 AS STR), '.0.1/x') END"""
SAFE = """coalesce(
 regexp_matches(u, '^https://[^\\s/]', 'i') AND NOT regexp_matches(u, '\\s') AND NOT contains(host, ':') AND NOT contains(host, '[')
 AND host <> 'localhost' AND NOT regexp_matches(host, '\\.(localhost|internal|local)$')
 AND CASE WHEN regexp_full_match(host, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}') THEN NOT (
   a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
   OR (a = 100 AND b BETWEEN 64 AND 127))
  ELSE NOT regexp_matches(host, '(^|\\.)(\\d+|0x[0-9a-f]*)\\.?$') END, false)"""


def parsed(source: str) -> str:
    return f"""
hosts AS (SELECT *, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM ({source})),
octets AS (SELECT *, try_cast(split_part(host, '.', 1) AS int) AS a, try_cast(split_part(host, '.', 2) AS int) AS b FROM hosts)"""


def channel_requests(fx: Fixture) -> DataFrame:
    kind = "CASE c_nationkey % 5 WHEN 0 THEN 'ntfy' WHEN 1 THEN 'slack' WHEN 2 THEN 'telegram' WHEN 3 THEN 'webhook' ELSE 'fax' END"
    return fx.customer.selectExpr(
        "c_custkey AS account_id", f"{kind} AS kind", f"{TARGETS.replace('STR', 'string')} AS target"
    )


CHANNEL_REQUESTS = f"""
SELECT c_custkey AS account_id,
 CASE c_nationkey % 5 WHEN 0 THEN 'ntfy' WHEN 1 THEN 'slack' WHEN 2 THEN 'telegram' WHEN 3 THEN 'webhook' ELSE 'fax' END AS kind,
 TRIM({TARGETS.replace('STR', 'varchar')}) AS u FROM customer"""


CALLS = {"title": (" RING ", 5, ""), "newest": ("", 0, "  "), "wild": ("E_ g", -3, "ECONOMY")}
CATALOG_PAGES = """WITH found AS (
 (SELECT 'title' AS variant, id, url, title, current_price, description FROM products
  WHERE FOLD(title) LIKE '%ring%' ORDER BY id LIMIT 30 OFFSET 5)
 UNION ALL (SELECT 'newest', id, url, title, current_price, description FROM products ORDER BY id DESC LIMIT 30)
 UNION ALL (SELECT 'wild', id, url, title, current_price, description FROM products
  WHERE FOLD(title) LIKE '%e_ g%' AND category = 'ECONOMY' ORDER BY id LIMIT 30))
SELECT * FROM found"""


def pages(search_one) -> DataFrame:
    found = [search_one(*args).withColumn("variant", F.lit(name)) for name, args in CALLS.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("catalog_search", CATALOG_PAGES)
def _catalog_search(fx: Fixture) -> DataFrame:
    return pages(lambda *args: search.catalog_search(fx.products, *args))


@query("catalog_search_postings", CATALOG_PAGES)
def _catalog_search_postings(fx: Fixture) -> DataFrame:
    root = shared_dir(fx.spark, "postings")
    postings.write_postings(fx.products, root)
    return pages(lambda *args: postings.catalog_search(fx.products, root, *args))


@query(
    "catalog_filter",
    """SELECT id, coalesce(FOLD(title) LIKE '%bolt%', false) AS by_title, coalesce(category = 'PROMO', false) AS by_category,
 coalesce(FOLD(title) LIKE '%o%d%' AND category = 'SMALL', false) AS by_both, true AS by_none FROM products""",
)
def _catalog_filter(fx: Fixture) -> DataFrame:
    calls = {"by_title": ("BoLt", ""), "by_category": ("", " PROMO "), "by_both": ("O%D", "SMALL"), "by_none": ("", "")}
    return fx.products.select(
        "id", *[F.coalesce(search.catalog_filter(*args), F.lit(False)).alias(name) for name, args in calls.items()]
    )


@query(
    "category_counts",
    """SELECT category, count(*) AS n FROM products WHERE category IS NOT NULL AND category <> ''
GROUP BY category ORDER BY n DESC, category LIMIT 100""",
)
def _category_counts(fx: Fixture) -> DataFrame:
    return search.category_counts(fx.products)


@query("safe_target_url", f"WITH {parsed(CHANNEL_REQUESTS)} SELECT account_id, u AS target, {SAFE} AS safe FROM octets")
def _safe_target_url(fx: Fixture) -> DataFrame:
    from varuvakt.functions.text import trim_ws

    trimmed = channel_requests(fx).select("account_id", trim_ws("target").alias("target"))
    return trimmed.withColumn("safe", safe_target_url(F.col("target")))


@query(
    "valid_channels",
    f"""WITH {parsed(CHANNEL_REQUESTS)}
SELECT account_id, kind, u AS target FROM octets
WHERE u <> '' AND (kind = 'telegram' OR (kind IN ('ntfy', 'slack', 'webhook') AND {SAFE}))""",
)
def _valid_channels(fx: Fixture) -> DataFrame:
    return channels.valid_channels(channel_requests(fx))


@query("enabled_channels", "SELECT account_id, id, kind, target, created_at FROM alert_channels WHERE enabled = 1")
def _enabled_channels(fx: Fixture) -> DataFrame:
    return channels.enabled_channels(fx.alert_channels)


REQUESTS = """
SELECT event_id AS request_id,
 CASE event_id % 5 WHEN 0 THEN concat('https://shop', cast(user_id % 10 AS {s}), '.example/p/', cast(user_id AS {s}))
  WHEN 1 THEN concat('  https://shop', cast(user_id % 10 AS {s}), '.example/p/', cast(user_id AS {s}), ' ')
  WHEN 2 THEN '  ' WHEN 3 THEN 'https://okänd.example/' ELSE NULL END AS url,
 CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id + 1000000 ELSE NULL END AS id,
 event_id % 7 = 0 AS refresh, event_id % 11 <> 0 AS may_generate FROM events"""


@query(
    "describe_requests",
    f"""WITH asked AS (SELECT request_id, nullif(TRIM(url), '') AS url, CASE WHEN id > 0 THEN id END AS id, refresh, may_generate
  FROM ({REQUESTS.replace('{s}', 'varchar')})),
looked AS (SELECT a.*, p.id AS pid, p.description, p.description_why FROM asked a LEFT JOIN products p
  ON (a.id IS NULL AND p.url = a.url) OR (a.url IS NULL AND p.id = a.id)),
judged AS (SELECT *, CASE WHEN (url IS NULL) = (id IS NULL) THEN 'bad_request' WHEN pid IS NULL THEN 'not_found'
  WHEN coalesce(description, '') <> '' AND NOT refresh THEN 'cached' WHEN may_generate THEN 'generate' ELSE 'forbidden' END AS status FROM looked)
SELECT request_id, CASE WHEN status = 'bad_request' THEN NULL ELSE pid END AS product_id, status,
 CASE WHEN status = 'cached' THEN description END AS beskrivning,
 CASE WHEN status = 'cached' THEN coalesce(description_why, '') END AS varfor FROM judged""",
)
def _describe_requests(fx: Fixture) -> DataFrame:
    requests = fx.spark.sql(
        REQUESTS.replace("{s}", "string").replace("FROM events", "FROM {events}"), events=fx.events
    )
    return describe.describe_requests(requests, fx.products)


WORKLIST = """worklist AS (
 SELECT p.id, p.title, p.category, p.source_text, p.current_price, s.name AS site_name
 FROM products p LEFT JOIN sites s ON s.id = p.site_id WHERE p.description IS NULL)"""


@query(
    "describe_worklist",
    f"WITH {WORKLIST} SELECT * FROM worklist ORDER BY (source_text IS NOT NULL) DESC, id LIMIT 200",
)
def _describe_worklist(fx: Fixture) -> DataFrame:
    return describe.describe_worklist(fx.products, fx.sites, 200)


MESSAGE = """'Produkt: ' || coalesce(title, '')
 || CASE WHEN TRIM(coalesce(category, '')) <> '' THEN chr(10) || 'Kategori: ' || TRIM(category) ELSE '' END
 || CASE WHEN TRIM(coalesce(source_text, '')) <> '' THEN chr(10) || 'Produktinfo: ' || TRIM(source_text) ELSE '' END
 || chr(10) || 'Butik: ' || coalesce(site_name, '') || chr(10) || 'Pris: ' || coalesce(current_price::varchar, '') || ' kr'"""


@query("user_message", f"WITH {WORKLIST} SELECT id, {MESSAGE} AS message FROM worklist")
def _user_message(fx: Fixture) -> DataFrame:
    work = describe.with_prompts(describe.describe_worklist(fx.products, fx.sites, None))
    return work.select("id", F.col("user_message").alias("message"))


@query(
    "describe_with",
    f"""WITH {WORKLIST}
SELECT id, CASE WHEN trim(coalesce(title, '')) <> '' THEN title END AS beskrivning,
 CASE WHEN trim(coalesce(title, '')) <> '' THEN trim('Finns hos ' || coalesce(site_name, '')) END AS varfor,
 CASE WHEN trim(coalesce(title, '')) <> '' THEN 'described' ELSE 'empty' END AS status, cast(NULL AS bigint) AS resume_at
FROM worklist""",
)
def _describe_with(fx: Fixture) -> DataFrame:
    work = describe.with_prompts(describe.describe_worklist(fx.products, fx.sites, None))
    return describe.describe_with(work, describe.template_reply, ["id"])


@query(
    "write_descriptions",
    f"""WITH {WORKLIST}
SELECT p.id, CASE WHEN w.id IS NOT NULL THEN w.title ELSE p.description END AS description,
 CASE WHEN w.id IS NOT NULL THEN trim('Finns hos ' || coalesce(w.site_name, '')) ELSE p.description_why END AS description_why,
 CASE WHEN w.id IS NOT NULL THEN {{now}} ELSE p.description_updated_at END AS description_updated_at
FROM products p LEFT JOIN (SELECT * FROM worklist WHERE coalesce(title, '') <> '') w ON w.id = p.id""",
)
def _write_descriptions(fx: Fixture) -> DataFrame:
    from varuvakt.plans.fixtures import NOW_MS

    work = describe.with_prompts(describe.describe_worklist(fx.products, fx.sites, None))
    described = describe.describe_with(work, describe.template_reply, ["id"])
    after = describe.write_descriptions(fx.products, described, NOW_MS)
    return after.select("id", "description", "description_why", "description_updated_at")
