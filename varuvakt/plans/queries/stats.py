"""Operator statistics, exports and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.text import csv_line
from varuvakt.operators import stats
from varuvakt.operators.reconcile import reconcile
from varuvakt.plans.fixtures import NOW_MS, NOW_PRICES_MS, Fixture
from varuvakt.plans.registry import query
from varuvakt.schemas import TABLES
from varuvakt.sources import exports


@query(
    "account_stats",
    """SELECT count(*) AS total, count(*) FILTER (role = 'admin') AS admins,
 count(*) FILTER (created_at >= {now} - 30 * 86400000::bigint) AS new_30d FROM accounts""",
)
def _account_stats(fx: Fixture) -> DataFrame:
    return stats.account_stats(fx.accounts, NOW_MS)


@query(
    "product_stats",
    "SELECT count(*) AS total, count(description) AS described, count(source_text) AS with_source FROM products",
)
def _product_stats(fx: Fixture) -> DataFrame:
    return stats.product_stats(fx.products)


@query("job_status_counts", "SELECT status, count(*) AS n FROM jobs GROUP BY status")
def _job_status_counts(fx: Fixture) -> DataFrame:
    return stats.status_counts(fx.jobs)


@query("suggestion_status_counts", "SELECT status, count(*) AS n FROM page_suggestions GROUP BY status")
def _suggestion_status_counts(fx: Fixture) -> DataFrame:
    return stats.status_counts(fx.page_suggestions)


@query("render_status_counts", "SELECT status, count(*) AS n FROM render_jobs GROUP BY status")
def _render_status_counts(fx: Fixture) -> DataFrame:
    return stats.status_counts(fx.render_jobs)


@query(
    "table_totals",
    """SELECT count(*) FILTER (what = 'point') AS price_points, count(*) FILTER (what = 'watch') AS watches,
 count(*) FILTER (what = 'channel' AND live) AS channels, count(*) FILTER (what = 'item') AS bistand,
 count(*) FILTER (what = 'site' AND live) AS sites_enabled, count(*) FILTER (what = 'site') AS sites_total
FROM (SELECT 'point' AS what, true AS live FROM price_history UNION ALL SELECT 'watch', true FROM price_watch
 UNION ALL SELECT 'item', true FROM bistand_items UNION ALL SELECT 'channel', enabled = 1 FROM alert_channels
 UNION ALL SELECT 'site', enabled = 1 FROM sites)""",
)
def _table_totals(fx: Fixture) -> DataFrame:
    return stats.table_totals(fx.price_history, fx.price_watch, fx.alert_channels, fx.bistand_items, fx.sites)


def daily_sql(table: str, col: str, now_ms: int, days: int) -> str:
    return f"""SELECT strftime(day, '%Y-%m-%d') AS d, count({col}) AS n
FROM (SELECT unnest(generate_series(make_timestamp({now_ms} * 1000)::date - {days - 1}, make_timestamp({now_ms} * 1000)::date, interval 1 day)) AS day)
LEFT JOIN {table} ON {col} IS NOT NULL AND make_timestamp({col} * 1000)::date = day::date GROUP BY day"""


@query("descriptions_daily", daily_sql("products", "description_updated_at", NOW_MS, 30))
def _descriptions_daily(fx: Fixture) -> DataFrame:
    return stats.daily_counts(fx.products, "description_updated_at", NOW_MS, 30)


@query("accounts_daily", daily_sql("accounts", "created_at", NOW_MS, 30))
def _accounts_daily(fx: Fixture) -> DataFrame:
    return stats.daily_counts(fx.accounts, "created_at", NOW_MS, 30)


@query("price_points_daily", daily_sql("price_history", "ts", NOW_PRICES_MS, 14))
def _price_points_daily(fx: Fixture) -> DataFrame:
    return stats.daily_counts(fx.price_history, "ts", NOW_PRICES_MS, 14)


ACTIVITY = """deeds AS (SELECT account_id, 'job' AS what FROM jobs UNION ALL SELECT account_id, 'watch' FROM price_watch
 UNION ALL SELECT account_id, 'item' FROM bistand_items UNION ALL SELECT account_id, 'suggestion' FROM page_suggestions),
newest AS (SELECT id, email, role, created_at FROM accounts QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) <= 500),
activity AS (SELECT id, email, role, created_at, count(*) FILTER (what = 'job') AS jobs, count(*) FILTER (what = 'watch') AS watches,
 count(*) FILTER (what = 'item') AS bistand, count(*) FILTER (what = 'suggestion') AS suggestions
 FROM newest LEFT JOIN deeds ON account_id = id GROUP BY ALL)"""


def activity(fx: Fixture) -> DataFrame:
    return stats.account_activity(fx.accounts, fx.jobs, fx.price_watch, fx.bistand_items, fx.page_suggestions)


@query("account_activity", f"WITH {ACTIVITY} SELECT * FROM activity")
def _account_activity(fx: Fixture) -> DataFrame:
    return activity(fx)


def line_sql(fields: tuple[str, ...]) -> str:
    return " || ',' || ".join(f"CSV({f})" for f in fields)


@query("export_accounts", f"WITH {ACTIVITY} SELECT *, {line_sql(exports.ACCOUNT_FIELDS)} AS line FROM activity")
def _export_accounts(fx: Fixture) -> DataFrame:
    return activity(fx).withColumn("line", csv_line([F.col(f) for f in exports.ACCOUNT_FIELDS]))


@query(
    "export_products",
    f"""WITH rows_out AS (SELECT id, url, title, current_price, category, cast(description IS NOT NULL AS int) AS has_description,
 first_seen, last_updated FROM products)
SELECT *, {line_sql(exports.PRODUCT_FIELDS)} AS line FROM rows_out""",
)
def _export_products(fx: Fixture) -> DataFrame:
    rows = exports.export_products(fx.products)
    return rows.withColumn("line", csv_line([F.col(f) for f in exports.PRODUCT_FIELDS]))


@query(
    "site_coverage",
    """WITH held AS (SELECT site_id, count(*) AS products, count(description) AS described, count(source_text) AS with_source
 FROM products GROUP BY site_id)
SELECT id, name, base_url, detail_selector, use_stealth, enabled, scrape_interval, last_crawled,
 coalesce(products, 0) AS products, coalesce(described, 0) AS described, coalesce(with_source, 0) AS with_source
FROM sites LEFT JOIN held ON site_id = id""",
)
def _site_coverage(fx: Fixture) -> DataFrame:
    return stats.site_coverage(fx.sites, fx.products)


TOKENS = "tokens AS (SELECT email AS name, created_at + 60 * 86400000::bigint AS expires_on FROM accounts)"
EXPIRING = f"""{TOKENS},
expiring AS (SELECT name, expires_on, cast(floor((expires_on - {{now}}) / 86400000.0::double + 0.5) AS bigint) AS days_left
 FROM tokens WHERE expires_on <= {{now}} + 30 * 86400000::bigint)"""


def tokens(fx: Fixture) -> DataFrame:
    return fx.accounts.selectExpr("email AS name", "created_at + 60 * 86400000L AS expires_on")


@query("expiring_tokens", f"WITH {EXPIRING} SELECT * FROM expiring")
def _expiring_tokens(fx: Fixture) -> DataFrame:
    return stats.expiring_tokens(tokens(fx), NOW_MS)


@query(
    "expiry_summary",
    f"""WITH {EXPIRING}
SELECT count(*) AS n, min(days_left) AS soonest, CASE WHEN count(*) = 1 THEN 'Token utgår om ' || min(days_left) || ' dagar'
 ELSE count(*) || ' tokens utgår, närmast om ' || min(days_left) || ' dagar' END AS subject FROM expiring HAVING count(*) > 0""",
)
def _expiry_summary(fx: Fixture) -> DataFrame:
    return stats.expiry_summary(stats.expiring_tokens(tokens(fx), NOW_MS))


@query(
    "reconcile_counts",
    """WITH p AS (SELECT id, CASE WHEN id % 7 = 0 THEN id + 10000000 ELSE id END AS tid, current_price,
   CASE WHEN id % 5 = 0 THEN current_price + 1 ELSE current_price END AS tprice FROM products),
h AS (SELECT product_id, price, ts, CASE WHEN product_id % 10 = 0 THEN 1 ELSE 0 END AS moved, count(*) AS n FROM price_history GROUP BY ALL)
SELECT 'products' AS table_name, count(*) AS source_rows, count(*) AS target_rows,
 count(*) FILTER (id % 7 = 0) AS missing_in_target, count(*) FILTER (id % 7 = 0) AS missing_in_source,
 count(*) FILTER (id % 7 <> 0 AND id % 5 = 0 AND current_price IS NOT NULL) AS changed FROM p
UNION ALL SELECT 'price_history', cast(sum(n) AS bigint), cast(sum(n) AS bigint), count(*) FILTER (moved = 1), count(*) FILTER (moved = 1), 0 FROM h
UNION ALL SELECT 'sites', count(*), count(*), 0, 0, 0 FROM sites""",
)
def _reconcile_counts(fx: Fixture) -> DataFrame:
    def moved(df: DataFrame, name: str) -> DataFrame:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return exports.from_ndjson(exports.to_ndjson(df), columns)

    products = fx.products.select(*[c.split()[0] for c in TABLES["products"].split(", ")])
    changed = products.withColumns({
        "current_price": F.expr("CASE WHEN id % 5 = 0 THEN current_price + 1 ELSE current_price END"),
        "id": F.expr("CASE WHEN id % 7 = 0 THEN id + 10000000 ELSE id END"),
    })
    points = fx.price_history.withColumn("ts", F.expr("CASE WHEN product_id % 10 = 0 THEN -ts ELSE ts END"))
    return (
        reconcile(products, moved(changed, "products"), ["id"], "products")
        .unionByName(reconcile(fx.price_history, moved(points, "price_history"), ["product_id", "price", "ts"], "price_history"))
        .unionByName(reconcile(fx.sites, moved(fx.sites, "sites"), ["id"], "sites"))
    )


@query(
    "error_groups",
    """WITH log AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'RangeError' ELSE 'Error' END AS name, text AS stack, doc_id AS ts FROM documents),
framed AS (SELECT name, ts, substr(sha256(name || '@' || CASE WHEN contains(stack, chr(10)) THEN TRIM(split_part(stack, chr(10), 2)) ELSE '?' END), 1, 10) AS fingerprint FROM log)
SELECT fingerprint, count(*) AS occurrences, min(name) AS name, min(ts) AS first_ts, max(ts) AS last_ts FROM framed GROUP BY fingerprint""",
)
def _error_groups(fx: Fixture) -> DataFrame:
    from varuvakt.functions.faults import error_groups

    log = fx.documents.selectExpr(
        "CASE doc_id % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'RangeError' ELSE 'Error' END AS name",
        "text AS stack",
        "doc_id AS ts",
    )
    return error_groups(log)
