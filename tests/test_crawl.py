import random
import sqlite3

from pyspark.sql import functions as F

from conftest import NOW
from varuvakt.operators import catalogue, crawl, merge
from varuvakt.schemas import CRAWL_RESULT, TABLES
from varuvakt.streaming.crawl_results import changed_tables

JOB = TABLES["render_jobs"]


def job(i, status="pending", kind="detail", attempts=0, lease=None, url=None, site=1, error=None):
    return (i, url or f"u{i}", site, kind, status, attempts, lease, error, 0, 0)


def jobs_of(spark, *entries):
    return spark.createDataFrame(list(entries), JOB)


def test_lease_order_bounds_and_lengths(spark, rows):
    jobs = jobs_of(spark, job(1), job(2, kind="list"), job(3, "leased", lease=NOW), job(4, "leased", lease=NOW - 1, attempts=2), job(5, "done"), job(6))
    after = crawl.lease_batch(jobs, 3, NOW)
    got = rows(after, "id", "status", "attempts", "lease_until", "updated_at")
    assert got == [(1, "leased", 1, NOW + 120_000, NOW), (2, "leased", 1, NOW + 900_000, NOW), (3, "leased", 0, NOW, 0),
                   (4, "leased", 3, NOW + 120_000, NOW), (5, "done", 0, None, 0), (6, "pending", 0, None, 0)]
    assert [crawl.clamp_lease(n) for n in (None, 0, -4, 51, 7)] == [10, 1, 1, 50, 7]


def test_feed_gives_crawl_settings_to_list_jobs_only(spark):
    site = (1, "s", "https://s", ".p", ".t", ".k", "a", ".d", "query", 9, "/x", "https://s/", 1, 1, 60, None)
    sites = spark.createDataFrame([site], TABLES["sites"])
    feed = {r.id: r for r in crawl.lease_feed(jobs_of(spark, job(1), job(2, kind="list"), job(3, kind="list", site=None)), sites).collect()}
    assert (feed[1].detail_selector, feed[1].use_stealth, feed[1].base_url) == (".d", 1, None)
    assert (feed[2].base_url, feed[2].max_pages, feed[2].url_scope) == ("https://s", 9, "https://s/")
    assert (feed[3].detail_selector, feed[3].use_stealth, feed[3].base_url) == ("", 0, None)


def test_reclaim_is_strict_and_keeps_attempts(spark, rows):
    jobs = jobs_of(spark, job(1, "leased", lease=NOW, attempts=3), job(2, "leased", lease=NOW - 1, attempts=3), job(3, "done", lease=5))
    assert rows(crawl.reclaim_leases(jobs, NOW), "id", "status", "attempts") == [(1, "leased", 3), (2, "pending", 3), (3, "done", 0)]


def test_results_park_after_five_attempts(spark, rows):
    jobs = jobs_of(spark, job(1, "leased", attempts=4), job(2, "leased", attempts=5), job(3, "leased", attempts=9, error="gammalt"), job(4, "leased"))
    results = spark.createDataFrame([(1, 1, "e" * 600), (2, 1, "x"), (3, 1, ""), (9, 1, None), (4, 1, "först"), (4, 2, None)],
                                    "job_id long, ord long, error string")
    got = rows(crawl.apply_job_results(jobs, results, NOW), "id", "status", "last_error")
    assert got == [(1, "pending", "e" * 500), (2, "error", "x"), (3, "done", "gammalt"), (4, "done", "först")]


def test_detail_jobs_due(spark, rows):
    cols = "id long, url string, site_id long, source_text string, category string"
    products = spark.createDataFrame(
        [(1, "u1", 1, None, "c"), (2, "u2", 1, "s", None), (3, "u3", 1, "s", "c"), (4, "u4", 1, None, None), (5, "u5", 1, None, "c")], cols)
    jobs = jobs_of(spark, job(1, url="u1"), job(2, "error", url="u2"), job(3, "leased", url="u4"), job(4, kind="list", url="u5"))
    assert rows(crawl.detail_jobs_due(products, jobs), "id") == [(2,), (5,)]
    assert rows(crawl.detail_jobs_due(products, jobs, 1), "id") == [(2,)]
    fresh = crawl.schedule_detail_jobs(products, jobs, NOW)
    assert rows(fresh, "url", "status", "attempts") == [("u2", "pending", 0), ("u5", "pending", 0)]
    assert rows(fresh, "id") == [(5,), (6,)]


def test_crawls_due(spark, rows):
    base = spark.createDataFrame(
        [(1, "b1", 1, 60, None), (2, "b2", 1, 60, NOW - 60_000), (3, "b3", 1, 60, NOW - 60_001), (4, "b4", 0, 60, None), (5, "b5", 1, 60, None)],
        "id long, base_url string, enabled int, scrape_interval long, last_crawled long")
    jobs = jobs_of(spark, job(1, kind="list", site=5), job(2, site=1))
    fresh, after = crawl.schedule_crawls(base, jobs, NOW)
    assert rows(fresh, "url", "site_id", "type") == [("b1", 1, "list"), ("b3", 3, "list")]
    assert rows(after, "id", "last_crawled") == [(1, NOW), (2, NOW - 60_000), (3, NOW), (4, None), (5, None)]


def test_ids_are_dense_unique_and_stable(spark):
    base = spark.createDataFrame([(7,)], "id long")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "k string")
    once = {r.k: r.id for r in merge.with_new_ids(keys.repartition(7), base, "id", ["k"]).collect()}
    again = {r.k: r.id for r in merge.with_new_ids(keys.repartition(3), base, "id", ["k"]).collect()}
    assert once == again and sorted(once.values()) == list(range(8, 5008))


def test_hot_keys_are_the_largest(spark, rows):
    df = spark.createDataFrame([(k,) for k in [1] * 5 + [2] * 4 + [3] * 3 + [4]], "k int")
    assert rows(merge.hot_keys(df, ["k"], 2)) == [(1,), (2,), (3,)]
    assert rows(merge.hot_keys(df, ["k"], 2, at_most=2)) == [(1,), (2,)]


def test_upsert_twice_is_idempotent(spark, rows):
    products = spark.createDataFrame([(1, "a", 5, "t", 10, None, None, None, None, None, None, 1, 1)], TABLES["products"])
    changes = spark.createDataFrame([("a", 9, 1, None, 20, "s"), ("b", 9, 2, "n", None, None), ("", 9, 3, "x", 1, None), (None, 9, 4, "x", 1, None)],
                                    "url string, site_id long, ord long, title string, price long, source_text string")
    once = catalogue.ingest_products(products, changes, NOW)
    twice = catalogue.ingest_products(once, changes, NOW)
    assert rows(once) == rows(twice)
    cols = ("id", "url", "site_id", "title", "current_price", "source_text_updated_at", "first_seen", "last_updated")
    assert rows(once, *cols) == [(1, "a", 5, "t", 20, NOW, 1, NOW), (2, "b", 9, "n", None, None, NOW, NOW)]


class Simulation:
    """The same changes, one statement at a time, in SQLite."""

    def __init__(self, products, history, jobs):
        self.db = sqlite3.connect(":memory:")
        self.db.executescript("""
            CREATE TABLE p (id INTEGER PRIMARY KEY, url TEXT UNIQUE, site_id, title, price, source, category, source_at, first_seen, updated);
            CREATE TABLE h (pid, price, ts);
            CREATE TABLE j (id INTEGER PRIMARY KEY, url, site_id, type, status, attempts, error);""")
        self.db.executemany("INSERT INTO p VALUES (?,?,?,?,?,?,?,?,?,?)", products)
        self.db.executemany("INSERT INTO h VALUES (?,?,?)", history)
        self.db.executemany("INSERT INTO j VALUES (?,?,?,?,?,?,?)", jobs)

    def put(self, url, site, now, title=None, price=None, source=None, category=None):
        row = self.db.execute("SELECT id FROM p WHERE url = ?", (url,)).fetchone()
        if row is None:
            self.db.execute("INSERT INTO p (url, site_id, title, price, source, category, source_at, first_seen, updated) VALUES (?,?,?,?,?,?,?,?,?)",
                            (url, site, title, price, source, category, now if source is not None else None, now, now))
        else:
            self.db.execute("UPDATE p SET title = coalesce(?, title), price = coalesce(?, price), source = coalesce(?, source), category = coalesce(?, category), "
                            "source_at = CASE WHEN ? IS NULL THEN source_at ELSE ? END, updated = ? WHERE id = ?",
                            (title, price, source, category, source, now, now, row[0]))

    def want_job(self, url, site):
        busy = self.db.execute("SELECT 1 FROM j WHERE url = ? AND type = 'detail' AND status IN ('pending', 'leased')", (url,)).fetchone()
        if busy is None:
            self.db.execute("INSERT INTO j (url, site_id, type, status, attempts) VALUES (?, ?, 'detail', 'pending', 0)", (url, site))

    def report(self, result, now):
        job_id, _, error, title, price, source, category, links, items = result
        found = self.db.execute("SELECT url, site_id, attempts FROM j WHERE id = ?", (job_id,)).fetchone()
        if found is None:
            return
        url, site, attempts = found
        if error:
            self.db.execute("UPDATE j SET status = ?, error = ? WHERE id = ?", ("error" if attempts >= 5 else "pending", error[:500], job_id))
            return
        if any(v is not None for v in (title, price, source, category)):
            self.put(url, site, now, title, price, source, category)
        if price is not None:
            self.db.execute("INSERT INTO h SELECT id, ?, ? FROM p WHERE url = ?", (price, now, url))
        for link in links or []:
            if self.db.execute("SELECT 1 FROM p WHERE url = ?", (link,)).fetchone() is None:
                self.put(link, site, now)
            self.want_job(link, site)
        for item_url, item_title, item_price, item_category in items or []:
            if not item_url:
                continue
            self.put(item_url, site, now, item_title, item_price, None, item_category)
            if item_price is not None:
                pid = self.db.execute("SELECT id FROM p WHERE url = ?", (item_url,)).fetchone()[0]
                standing = self.db.execute("SELECT 1 FROM h WHERE pid = ? AND price = ? AND ts = (SELECT max(ts) FROM h WHERE pid = ?)",
                                           (pid, item_price, pid)).fetchone()
                if standing is None:
                    self.db.execute("INSERT INTO h VALUES (?, ?, ?)", (pid, item_price, now))
            if self.db.execute("SELECT 1 FROM p WHERE url = ? AND source IS NULL", (item_url,)).fetchone():
                self.want_job(item_url, site)
        self.db.execute("UPDATE j SET status = 'done' WHERE id = ?", (job_id,))


def random_world(rng):
    urls = [f"u{i}" for i in range(12)]

    def maybe(value, share=0.5):
        return value if rng.random() < share else None

    products = [(i + 1, u, rng.randrange(3), maybe("t"), maybe(rng.randrange(3)), maybe("s", 0.3), maybe("c"), None, 1, 1) for i, u in enumerate(urls[:7])]
    history = [(rng.randrange(1, 8), rng.randrange(3), rng.choice([10, 20])) for _ in range(12)]
    jobs = [(i + 1, rng.choice(urls), rng.randrange(3), rng.choice(["list", "detail"]), rng.choice(["pending", "leased", "done", "error"]), rng.randrange(7), None)
            for i in range(14)]
    results = []
    for place, job_id in enumerate(rng.sample([*range(1, 15), 999], 9)):
        error = maybe("fel", 0.25)
        links = maybe([rng.choice(urls) for _ in range(rng.randrange(4))], 0.4)
        items = maybe([(rng.choice([*urls, ""]), maybe(f"t{place}"), maybe(rng.randrange(3), 0.8), maybe("k")) for _ in range(rng.randrange(5))], 0.6)
        results.append((job_id, place, error, maybe(f"T{place}"), maybe(rng.randrange(3)), maybe(f"S{place}", 0.3), maybe("C"), links, items))
    return products, history, jobs, results


def test_crawl_batches_match_statement_by_statement_runs(spark, rows):
    rng = random.Random(11)
    # Several worlds side by side: their urls and ids do not meet, so one Spark run checks them all.
    everything = {"p": [], "h": [], "j": [], "r": []}
    want = {"p": [], "h": [], "j": []}
    for world in range(25):
        products, history, jobs, results = random_world(rng)
        sim = Simulation(products, history, jobs)
        for result in results:
            sim.report(result, NOW)
        shift = world * 1000

        def named(url, tag=world):
            return url if not url else f"w{tag}-{url}"

        everything["p"] += [(i + shift, named(u), s, t, pr, src, c, None, None, None, sa, fs, lu) for i, u, s, t, pr, src, c, sa, fs, lu in products]
        everything["h"] += [(pid + shift, price, ts) for pid, price, ts in history]
        everything["j"] += [(i + shift, named(u), s, ty, st, at, None, None, 0, 0) for i, u, s, ty, st, at, _ in jobs]
        everything["r"] += [
            (jid + shift, place, e, t, pr, src, c, [named(x) for x in links] if links is not None else None,
             [(named(u), a, b, d) for u, a, b, d in items] if items is not None else None)
            for jid, place, e, t, pr, src, c, links, items in results]
        want["p"] += [(named(r[0]), *r[1:]) for r in sim.db.execute("SELECT url, site_id, title, price, source, category, source_at, first_seen, updated FROM p")]
        want["h"] += [(named(u), pr, ts) for u, pr, ts in sim.db.execute("SELECT p.url, h.price, h.ts FROM h JOIN p ON p.id = h.pid")]
        want["j"] += [(named(u), s, ty, st, e) for u, s, ty, st, e in sim.db.execute("SELECT url, site_id, type, status, error FROM j")]

    products = spark.createDataFrame(everything["p"], TABLES["products"])
    history = spark.createDataFrame(everything["h"], TABLES["price_history"])
    jobs = spark.createDataFrame(everything["j"], JOB)
    results = spark.createDataFrame(everything["r"], CRAWL_RESULT)
    changes = changed_tables(products, history, jobs, results, NOW, lambda name, part: part.persist())
    after = merge.delete_keys(products, changes["products"], ["url"]).unionByName(changes["products"])
    points = history.unionByName(changes["price_history"])
    all_jobs = merge.delete_keys(jobs, changes["render_jobs"], ["id"]).unionByName(changes["render_jobs"])

    got = rows(after, "url", "site_id", "title", "current_price", "source_text", "category", "source_text_updated_at", "first_seen", "last_updated")
    assert got == sorted(want["p"], key=repr)
    named_points = points.join(after.select(F.col("id").alias("product_id"), "url"), "product_id")
    assert rows(named_points, "url", "price", "ts") == sorted(want["h"], key=repr)
    assert rows(all_jobs, "url", "site_id", "type", "status", "last_error") == sorted(want["j"], key=repr)
    ids = [r[0] for r in rows(after, "id")]
    assert len(set(ids)) == len(ids)


def test_crawl_batch_reads_history_of_listed_products_only(spark, rows):
    """A result's own price is written whatever the history says; only list prices are held against it."""
    products = spark.createDataFrame([(k, f"u{k}", 1, *[None] * 8, 0, 0) for k in (1, 2, 3)], TABLES["products"])
    history = spark.createDataFrame([(k, 10, 5) for k in (1, 2, 3)], TABLES["price_history"])
    jobs = jobs_of(spark, job(1, "leased"), job(2, "leased"), job(9, "leased", kind="list", url="list"), job(4, "leased"))
    listed = [("u2", None, 10, None), ("u2", None, 11, None), ("u3", None, None, None), ("u8", None, 7, None)]
    results = [(k, k, None, None, 10, None, None, None, None) for k in (1, 2)] + [(9, 9, None, None, None, None, None, None, listed)]
    whole, asked, kept = {"products": products, "price_history": history, "render_jobs": jobs}, {}, {}

    def lookup(name, keys):
        asked[name] = rows(keys)
        return whole[name]

    def keep(name, part):
        kept[name] = part.persist()
        return kept[name]

    changes = changed_tables(products, history, jobs, spark.createDataFrame(results, CRAWL_RESULT), NOW, keep, lookup)
    ids = dict(rows(changes["products"], "url", "id"))
    assert asked["price_history"] == sorted([(2,), (ids["u8"],)]) and rows(kept["history"], "product_id") == [(2,)]
    assert rows(changes["price_history"], "product_id", "price") == sorted([(1, 10), (2, 10), (2, 11), (ids["u8"], 7)])
    assert rows(changes["render_jobs"].where(f"created_at < {NOW}"), "id", "status") == [(1, "done"), (2, "done"), (9, "done")]
