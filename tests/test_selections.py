import random
import re

from pyspark.sql import functions as F

from conftest import NOW
from varuvakt.operators import channels, moderation, postings, search, selections, stats
from varuvakt.schemas import TABLES

PRODUCT = "id long, url string, title string, category string, current_price long, description string"


def products_of(spark):
    titles = [(1, "Röd ring", "A"), (2, "RING å", "B"), (3, None, "A"), (4, "bult", None), (5, "Bult", "")]
    return spark.createDataFrame([(i, f"u{i}", t, c, i * 10 if i != 3 else None, None) for i, t, c in titles], PRODUCT)


def test_search_order_and_paging(spark):
    products = products_of(spark)
    ids = lambda *args: [r.id for r in search.catalog_search(products, *args).collect()]
    assert ids() == [5, 4, 3, 2, 1]
    assert ids("  ring ") == [1, 2] and ids("", 0, " A ") == [1, 3] and ids("bult", 1) == [5]
    assert ids("RÖD") == [] and ids("", -5)[0] == 5
    many = spark.range(1, 101).selectExpr("id", "'u' url", "'t' title", "'c' category", "1L current_price", "'' description")
    assert [r.id for r in search.catalog_search(many, "", 95).collect()] == [5, 4, 3, 2, 1]
    assert search.catalog_search(many, "t").count() == 30


def test_categories_skip_null_and_empty(spark):
    assert [tuple(r) for r in search.category_counts(products_of(spark)).collect()] == [("A", 2), ("B", 1)]


def test_bulk_adds_nothing_twice(spark, rows):
    products = products_of(spark)
    watch = spark.createDataFrame([(1, 1, None, 5)], TABLES["price_watch"])
    requests = [(1, "ring", ""), (2, "", "A"), (1, "", "B")]
    added = selections.bulk_watch(watch, products, requests, NOW)
    assert rows(added, "account_id", "product_id") == [(1, 2), (2, 1), (2, 3)]
    assert selections.bulk_watch(watch.unionByName(added), products, requests, NOW).count() == 0
    items = spark.createDataFrame([], TABLES["bistand_items"])
    assert rows(selections.bulk_dossier(items, products, [(7, "", "")], NOW), "product_id", "motivation") == [(i, "") for i in range(1, 6)]


NEEDLES = ["ring", " RING ", "rö", "RÖD", "r", "%", "_", "_____", "%%r%t", "r_ng", "bu\\\\lt", "\\\\", "a%b", "50%", "a_b", "xyz", "ngr", "😀", "ring r", "", "ulta"]


def titled(spark):
    titles = ["Röd ring", "RING å", None, "bult", "Bu\\\\lt", "", "50% av", "a_b", "axxb", "ab", "ring ring ring", "r", "😀 ring", "multar", "bultar", "r%t"]
    return spark.createDataFrame([(i, f"u{i}", t, ["A", "B", None, ""][i % 4], i, None) for i, t in enumerate(titles)], PRODUCT)


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    products, root = titled(spark), str(tmp_path / "p")
    postings.write_postings(products, root)
    for needle in NEEDLES:
        for category in ("", " A "):
            want = [r.id for r in search.catalog_search(products, needle, 0, category).collect()]
            assert [r.id for r in postings.catalog_search(products, root, needle, 0, category).collect()] == want, needle
    assert postings.needle_grams("Ab%RING_xyz") == ["ing", "rin", "xyz"] and postings.candidates(spark, root, "ri") is None
    plan = postings.candidates(spark, root, "multar")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)
    postings.write_postings(products.limit(0), str(tmp_path / "empty"))
    assert postings.catalog_search(products.limit(0), str(tmp_path / "empty"), "ring").count() == 0


def test_bulk_of_a_table_equals_the_list(spark, rows):
    products = titled(spark)
    requests = [(account, needle, category) for account, (needle, category) in enumerate((n, c) for n in NEEDLES for c in ("", "A", " B ", "zz"))]
    requests += [(1, "ring", ""), (1, "RING", ""), (900, None, None), (900, "ring", None)]
    table = spark.createDataFrame(requests, "account_id long, q string, category string")
    listed = [(a, q or "", c or "") for a, q, c in requests]
    assert rows(selections.bulk_selection(products, table), "account_id", "product_id") == rows(selections.bulk_selection(products, listed), "account_id", "product_id")
    watch = spark.createDataFrame([(900, 0, None, 5)], TABLES["price_watch"])
    assert selections.bulk_watch(watch, products, table.where("account_id = 900"), NOW).count() == 15
    assert selections.bulk_selection(products, table.limit(0)).count() == 0 and selections.bulk_selection(products.limit(0), table).count() == 0


def test_bulk_of_a_table_is_unfolded_last(spark, rows, monkeypatch):
    """Accounts with the same filters share cells; no exchange, sort or join meets the pairs themselves (F1, F2)."""
    monkeypatch.setattr(postings, "BLOCK", 3)
    products = titled(spark).unionByName(titled(spark).where("id < 3"))
    requests = [(account, *[("r", ""), ("", "A"), ("ring", "B"), ("", "")][account % 4]) for account in range(40)]
    requests += [(5, "", "A"), (6, "r", "zz"), (6, "", "B"), (None, "bu", ""), (None, "bu", "")]
    table = spark.createDataFrame(requests, "account_id int, q string, category string")
    pairs = [(account, product) for account in range(0, 50, 3) for product in range(0, 20, 2)]
    watch = spark.createDataFrame([(a, p, None, 5) for a, p in [*pairs, *pairs[:9], (None, 3), (7, None), (None, None)]], TABLES["price_watch"])
    got = selections.bulk_watch(watch, products, table, NOW)
    named = [r for r in requests if r[0] is not None]
    want = [*rows(selections.bulk_watch(watch, products, named, NOW)), *[(None, p, None, NOW) for p in (3, 4, 14)]]
    assert rows(got) == sorted(set(want), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert above.count("Generate explode") == 2 and "Join" not in above and "Aggregate" not in above


def test_bulk_of_a_table_broadcasts_filters_not_products(spark, rows, monkeypatch, tmp_path):
    """Nothing that is sent through the driver holds the catalogue's titles, and many filters are merged, with the same rows (F1, F2)."""
    titled(spark).write.parquet(str(tmp_path / "products"))
    products = spark.read.parquet(str(tmp_path / "products"))
    filters = spark.createDataFrame([(f"{n}/{c}", n, c) for n in NEEDLES for c in ("", "A", "zz")], "filter string, q string, category string")
    found = {}
    for most in (50_000, 0):
        monkeypatch.setattr(postings, "BROADCAST_FILTERS", most, raising=False)
        matched = postings.match_filters(products, filters)
        sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: (\[.*\])", matched._sc._jvm.PythonSQLUtils.explainString(matched._jdf.queryExecution(), "formatted"))
        assert not [columns for columns in sent if "title" in columns] and any("pattern" in columns for columns in sent) == (most > 0)
        found[most] = rows(matched)
    assert found[50_000] == found[0] and len(found[0]) > 20


def test_single_watch_refuses_unknown_products(spark, rows):
    watch = spark.createDataFrame([(1, 1, 9, 5)], TABLES["price_watch"])
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 77)], "account_id long, product_id long")
    got = selections.add_watches(watch, asked, products_of(spark), NOW)
    assert rows(got) == [(1, 1, 9, 5), (1, 2, None, NOW)]


def test_motivation_upsert(spark, rows):
    items = spark.createDataFrame([(1, 1, "gammal", 5)], TABLES["bistand_items"])
    asked = spark.createDataFrame([(1, 1, " ny ", 1), (1, 1, " nyare ", 2), (1, 2, None, 1), (1, 99, "x", 1), (1, -1, "x", 1)],
                                  "account_id long, product_id long, motivation string, ord long")
    got = selections.upsert_motivation(items, asked, products_of(spark), NOW)
    assert rows(got) == [(1, 1, "nyare", 5), (1, 2, "", NOW)]


def test_dossier_pages_clamp_and_total(spark, rows):
    items = spark.createDataFrame([(1, i, "", 100 - i) for i in range(1, 6)] + [(1, 77, "", 0), (2, 1, "", 0)], TABLES["bistand_items"])
    page = selections.dossier_pages(items, products_of(spark), 2, 1)
    assert rows(page, "account_id", "position", "product_id", "total") == [(1, 2, 4, 6), (1, 3, 3, 6)]
    assert selections.dossier_pages(items, products_of(spark), 0, -3).count() == 2
    totals = selections.dossier_totals(items, products_of(spark))
    assert rows(totals) == [(1, 5, 120), (2, 1, 10)]


def test_pages_at_any_depth(spark, rows):
    rng = random.Random(3)
    made = {(a, i): rng.choice([5, 5, 90_000_000, 90_000_001, 10**9 + rng.randrange(50)]) for a in (1, 2, 3) for i in range(1, 401 if a < 3 else 40)}
    items = spark.createDataFrame([(a, i, at) for (a, i), at in made.items()], "account_id long, product_id long, created_at long")
    cuts = [F.floor(F.col("created_at") / 86_400_000), F.col("created_at"), F.floor(F.col("product_id") / 16)]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "20")
    try:
        for skip, size in ((0, 7), (15, 10), (150, 25), (390, 25), (500, 3)):
            want = []
            for account in (1, 2, 3):
                sequence = sorted((at, i) for (a, i), at in made.items() if a == account)
                want += [(account, i, p) for p, (_, i) in enumerate(sequence, 1) if skip < p <= skip + size]
            got = selections.page_at(items, "account_id", cuts, ["created_at", "product_id"], skip, size)
            assert rows(got, "account_id", "product_id", "position") == sorted(want, key=repr)
            assert got.columns == ["account_id", "product_id", "created_at", "position"]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_removal_needs_the_owner(spark, rows):
    mine = spark.createDataFrame([(1, 10, "ntfy", "t", 1, 0), (2, 10, "ntfy", "t", 1, 0)], TABLES["alert_channels"])
    doomed = spark.createDataFrame([(1, 10), (2, 11)], "id long, account_id long")
    assert rows(selections.remove_channels(mine, doomed), "id") == [(2,)]


def test_channel_requests(spark, rows):
    asked = spark.createDataFrame(
        [(1, "ntfy", " https://n.se/x "), (2, "telegram", "1:2"), (3, "slack", "http://s.se"), (4, "fax", "https://f.se"), (5, "webhook", " "), (6, "telegram", "")],
        "account_id long, kind string, target string")
    assert rows(channels.valid_channels(asked)) == [(1, "ntfy", "https://n.se/x"), (2, "telegram", "1:2")]


def test_site_patches(spark, rows):
    site = [(i, f"s{i}", "b", "", "", "", "", "gammal", "query", 1, "", "", 0, 1, 3600, None) for i in range(1, 7)]
    sites = spark.createDataFrame(site, TABLES["sites"])
    patches = spark.createDataFrame(
        [(1, 1, " .x ", None, None, None), (2, 1, "z" * 501, True, None, None), (3, 1, None, None, None, None), (4, 1, None, None, None, 1.0),
         (5, 1, None, True, False, 300.9), (5, 2, None, False, None, None), (99, 1, "a", None, None, None), (6, 1, None, None, None, float("nan"))],
        "id long, ord long, detail_selector string, use_stealth boolean, enabled boolean, scrape_interval double")
    after, judged = moderation.patch_sites(sites, patches)
    assert rows(after, "id", "detail_selector", "use_stealth", "enabled", "scrape_interval") == [
        (1, ".x", 0, 1, 3600), (2, "gammal", 0, 1, 3600), (3, "gammal", 0, 1, 3600), (4, "gammal", 0, 1, 300), (5, "gammal", 0, 0, 300), (6, "gammal", 0, 1, 3600)]
    assert rows(judged, "id", "outcome") == [(1, "ok"), (2, "selector_too_long"), (3, "nothing_to_update"), (4, "ok"), (5, "ok"), (5, "ok"),
                                             (6, "nothing_to_update"), (99, "unknown_site")]


def test_role_patches(spark, rows):
    accounts = spark.createDataFrame([(1, "a", "admin", "auto", 0), (2, "b", "user", "auto", 0)], TABLES["accounts"])
    asked = spark.createDataFrame([(1, 1, 1, "user"), (1, 2, 2, "admin"), (1, 2, 3, "root"), (1, 9, 4, "user"), (1, 2, 5, None)],
                                  "acting_id long, id long, ord long, role string")
    after, judged = moderation.patch_roles(accounts, asked)
    assert rows(after, "id", "role") == [(1, "admin"), (2, "admin")]
    assert rows(judged, "ord", "outcome") == [(1, "own_demotion"), (2, "ok"), (3, "invalid_role"), (4, "unknown_account"), (5, "invalid_role")]
    modes = spark.createDataFrame([(1, "auto", 1), (2, "hej", 1), (1, None, 2)], "id long, mode string, ord long")
    assert rows(moderation.patch_describe_mode(accounts, modes), "id", "describe_mode") == [(1, "on-demand"), (2, "on-demand")]


def test_suggestion_admission(spark, rows):
    stored = spark.createDataFrame([(i, 1, "e", "t", "", "pending", 0) for i in range(1, 4)] + [(9, 1, "e", "t", "", "coded", 0)], TABLES["page_suggestions"])
    asked = spark.createDataFrame([(i, 1, "e", "  " if i == 1 else f" {'x' * 300} ", "d" * 5000, i) for i in range(6)] + [(50 + i, 2, "e", "t", None, i) for i in range(7)],
                                  "request_id long, account_id long, email string, title string, description string, ord long")
    after, judged = moderation.admit_suggestions(stored, asked, NOW)
    outcome = {r.request_id: r.outcome for r in judged.collect()}
    assert [outcome[i] for i in range(6)] == ["ok", "title_required", "ok", "too_many_pending", "too_many_pending", "too_many_pending"]
    assert [outcome[50 + i] for i in range(7)] == ["ok"] * 5 + ["too_many_pending"] * 2
    fresh = after.filter("id > 9")
    assert rows(fresh.select("id")) == [(i,) for i in range(10, 17)]
    assert fresh.filter("account_id = 1 AND (length(title) != 200 OR length(description) != 4000)").count() == 0
    changed = spark.createDataFrame([(1, "approved", 1), (1, "coded", 2), (2, "nej", 1)], "id long, status string, ord long")
    assert rows(moderation.patch_suggestions(stored, changed), "id", "status") == [(1, "coded"), (2, "pending"), (3, "pending"), (9, "coded")]


def test_daily_axis_is_zero_filled(spark):
    day = 86_400_000
    events = spark.createDataFrame([(NOW - 2 * day,), (NOW - 1,), (NOW - 1,), (NOW + 5,), (NOW - 3 * day,), (NOW + day,), (None,)], "ts long")
    got = [tuple(r) for r in stats.daily_counts(events, "ts", NOW, 3).orderBy("d").collect()]
    assert got == [("2024-01-29", 1), ("2024-01-30", 2), ("2024-01-31", 1)]


def test_expiring_tokens(spark):
    day = 86_400_000
    tokens = spark.createDataFrame([("a", NOW + 30 * day), ("b", NOW + 30 * day + 1), ("c", None), ("d", NOW - day // 2), ("e", NOW + day // 2)], "name string, expires_on long")
    soon = stats.expiring_tokens(tokens, NOW)
    assert [(r.name, r.days_left) for r in soon.collect()] == [("d", 0), ("e", 1), ("a", 30)]
    assert stats.expiry_summary(soon).first().subject == "3 tokens utgår, närmast om 0 dagar"
    assert stats.expiry_summary(soon.filter("name = 'a'")).first().subject == "Token utgår om 30 dagar"
    assert stats.expiry_summary(soon.filter("name = 'x'")).count() == 0


def test_account_activity_limit_and_all(spark, rows):
    accounts = spark.createDataFrame([(i, f"e{i}", "user", "auto", i) for i in range(1, 5)], TABLES["accounts"])
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "account_id long")
    args = (accounts, one(4, 4), one(3), one(1), one(4, 99))
    assert rows(stats.account_activity(*args, limit=2), "id", "jobs", "watches", "bistand", "suggestions") == [(3, 0, 1, 0, 0), (4, 2, 0, 0, 1)]
    assert rows(stats.account_activity(*args, limit=None).filter(F.col("id") == 1), "bistand") == [(1,)]
