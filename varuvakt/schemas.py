"""Table schemas. Times are unix milliseconds (LONG); flags are 0/1 integers."""

from __future__ import annotations

TABLES = {
    "accounts": "id long, email string, role string, describe_mode string, created_at long",
    "sites": (
        "id long, name string, base_url string, product_selector string, title_selector string, "
        "price_selector string, link_selector string, detail_selector string, pagination_type string, "
        "max_pages long, exclude_link_pattern string, url_scope string, use_stealth int, enabled int, "
        "scrape_interval long, last_crawled long"
    ),
    "products": (
        "id long, url string, site_id long, title string, current_price long, source_text string, "
        "category string, description string, description_why string, description_updated_at long, "
        "source_text_updated_at long, first_seen long, last_updated long"
    ),
    "price_history": "product_id long, price long, ts long",
    "render_jobs": (
        "id long, url string, site_id long, type string, status string, attempts int, lease_until long, "
        "last_error string, created_at long, updated_at long"
    ),
    "price_watch": "account_id long, product_id long, last_alert long, created_at long",
    "alert_channels": "id long, account_id long, kind string, target string, enabled int, created_at long",
    "bistand_items": "account_id long, product_id long, motivation string, created_at long",
    "page_suggestions": (
        "id long, account_id long, email string, title string, description string, status string, created_at long"
    ),
    "jobs": (
        "id long, account_id long, status string, filename string, output_key string, "
        "options struct<tone:string,length:string,audience:string>, custom_direction string, "
        "total long, succeeded long, error_message string, created_at long, updated_at long"
    ),
}

# A fetcher's answer to one job. ``ord`` is the arrival position in the batch.
CRAWL_RESULT = (
    "job_id long, ord long, error string, title string, price long, source_text string, category string, "
    "links array<string>, items array<struct<url:string,title:string,price:long,category:string>>"
)
INGEST_BODY = (
    "products array<struct<url:string,title:string,price:long,site_id:long,source_text:string>>"
)
