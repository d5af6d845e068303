import json
import re

import pytest
from pyspark.sql import functions as F

from conftest import NOW
from varuvakt.schemas import TABLES
from varuvakt.sources.snapshots import SnapshotStore
from varuvakt.streaming import crawl_results, price_drops, row_results
from varuvakt.streaming.intake import once, query_id
from varuvakt.streaming.throttle import throttle_stream
from varuvakt.streaming.tick import Tables, tick


def put(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages))


def test_snapshots(spark, tmp_path, rows):
    store = SnapshotStore(spark, str(tmp_path / "s"), {"t": "k long, v string", "log": "x long"}, {"t": ["k"], "log": None})
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    log = lambda *r: spark.createDataFrame([(x,) for x in r], "x long")
    store.create({"t": frame((1, "a"), (2, "b")), "log": log(1)})
    assert store.commit(0, {"t": frame((2, "c"), (3, "d")), "log": log(2)})
    assert not store.commit(0, {"t": frame((9, "z")), "log": log(9)})
    store.stage("t", frame((8, "halvskriven")))
    assert rows(store.read("t")) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.commit(1, {"t": frame((2, None))})
    assert rows(store.read("t")) == [(1, "a"), (2, None), (3, "d")] and rows(store.read("log")) == [(1,), (2,)]
    store.compact()
    assert store.pending_batches() == [] and store.is_committed(1) and not store.commit(1, {"t": frame((7, "x"))})
    assert rows(store.read("t")) == [(1, "a"), (2, None), (3, "d")] and rows(store.read("log")) == [(1,), (2,)]


def test_snapshots_of_several_writers(spark, tmp_path, rows):
    schemas = {"t": "k long, v string", "log": "x long"}
    store = SnapshotStore(spark, str(tmp_path / "s"), schemas, {"t": ["k"], "log": None})
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    store.create({})
    assert store.commit(0, {"t": frame((1, "a"))}, "p") and store.commit(1, {"t": frame((1, "b"))}, "p")
    store.compact(3)
    assert len(store.pending_batches()) == 2
    store.compact()
    # A stream with a new checkpoint starts at zero; its batches are not those of the first.
    assert store.commit(0, {"t": frame((1, "c"), (2, "d"))}, "q") and not store.commit(0, {"t": frame((1, "e"))}, "q")
    assert not store.commit(1, {"t": frame((1, "f"))}, "p") and rows(store.read("t")) == [(1, "c"), (2, "d")]
    # What a writer left behind when it died does not become part of another's version.
    store.stage("log", spark.createDataFrame([(5,)], "x long"))
    again = SnapshotStore(spark, str(tmp_path / "s"), schemas, {"t": ["k"], "log": None})
    assert again.commit(1, {"t": frame((3, "g"))}, "q")
    assert rows(again.read("log")) == [] and rows(again.read("t")) == [(1, "c"), (2, "d"), (3, "g")]


def test_lookups_read_the_folders_of_their_keys(spark, tmp_path, rows):
    store = SnapshotStore(spark, str(tmp_path / "s"), {"t": "k long, v string", "log": "x int, y long"}, {"t": ["k"], "log": None}, {"t": "k", "log": "x"}, buckets=32)
    store.create({"t": spark.range(500).selectExpr("id AS k", "concat('v', id) AS v"), "log": spark.range(900).selectExpr("cast(if(id < 600, 7, id) AS int) AS x", "id AS y")})
    store.commit(0, {"t": spark.createDataFrame([(3, "neu"), (900, "neu")], "k long, v string"), "log": spark.createDataFrame([(7, -1)], "x int, y long")})
    keys = spark.createDataFrame([(3,), (41,), (900,), (None,)], "k int")
    for _ in range(2):
        found = store.lookup("t", keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[(isnotnull\()?_bucket", plan) and found.count() < 150
        assert rows(found.join(keys, "k", "left_semi")) == [(3, "neu"), (41, "v41"), (900, "neu")]
        assert store.read("t").count() == 501 and store.lookup("t", keys.limit(0)).join(keys, "k").where("k = 41").count() == 0
        hot = store.lookup("log", spark.createDataFrame([(7,)], "x long")).where("x = 7")
        assert hot.count() == 601 and store.lookup("log", keys.selectExpr("k AS y")).count() == 901
        store.compact()


def test_streams_keep_unreadable_lines(spark, tmp_path, rows):
    store = row_results.open_store(spark, str(tmp_path / "store"))
    store.create({"jobs": spark.createDataFrame([(1, 7, "processing", "f.csv", None, None, "", 1, 0, None, 0, 0)], TABLES["jobs"])})
    headers = spark.createDataFrame([(1, ["P"])], "job_id long, fieldnames array<string>")
    cells = spark.createDataFrame([(1, 0, ["x"])], "job_id long, row_index long, cells array<string>")
    (tmp_path / "in").mkdir()
    good = json.dumps({"job_id": 1, "row_index": 0, "ord": 1, "beskrivning": "a", "varfor": "b"})
    (tmp_path / "in" / "1.json").write_text("\n".join(['{"job_id": 1, "row', good, '{"job_id": "one", "row_index": 0}']))

    def run(checkpoint):
        row_results.stream_row_results(spark, str(tmp_path / "in"), store, headers, cells, str(tmp_path / checkpoint), NOW, compact_after=1).awaitTermination()

    run("cp")
    assert rows(store.read("rejects")) == [('{"job_id": "one", "row_index": 0}',), ('{"job_id": 1, "row',)] and store.pending_batches() == []
    assert rows(store.read("results")) == [(1, 0, "a", "b")] and rows(store.read("jobs"), "status") == [("done",)]
    run("cp")
    assert len(rows(store.read("rejects"))) == 2
    run("another")
    assert len(rows(store.read("rejects"))) == 4 and rows(store.read("results")) == [(1, 0, "a", "b")]

    crawl = crawl_results.open_store(spark, str(tmp_path / "crawl"))
    crawl.create({"render_jobs": spark.createDataFrame([(1, "lista", 4, "list", "leased", 1, NOW, None, 0, 0)], TABLES["render_jobs"])})
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text("\n".join(["nonsense", json.dumps({"job_id": 1, "ord": 1, "items": [{"url": "p1", "price": 10}]})]))
    crawl_results.stream_crawl_results(spark, str(tmp_path / "pages"), crawl, str(tmp_path / "crawl-cp"), lambda: NOW + 5).awaitTermination()
    assert rows(crawl.read("rejects")) == [("nonsense",)] and rows(crawl.read("products"), "url", "first_seen") == [("p1", NOW + 5)]


def test_crawl_stream_resumes_and_redelivery_is_harmless(spark, tmp_path, rows):
    store = crawl_results.open_store(spark, str(tmp_path / "store"))
    jobs = [(1, "lista", 4, "list", "leased", 1, NOW, None, 0, 0), (2, "p1", 4, "detail", "leased", 1, NOW, None, 0, 0)]
    store.create({
        "products": spark.createDataFrame([], TABLES["products"]),
        "price_history": spark.createDataFrame([], TABLES["price_history"]),
        "render_jobs": spark.createDataFrame(jobs, TABLES["render_jobs"]),
    })

    def run():
        crawl_results.stream_crawl_results(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), NOW).awaitTermination()

    put(tmp_path / "in", "1.json", {"job_id": 1, "ord": 1, "items": [{"url": "p1", "title": "ett", "price": 10}, {"url": "p2", "price": 5}], "links": ["p3"]})
    run()
    put(tmp_path / "in", "2.json", {"job_id": 2, "ord": 2, "price": 10, "source_text": "om p1", "category": "k"}, {"job_id": 77, "ord": 3, "price": 1})
    run()
    products = store.read("products")
    assert rows(products, "url", "site_id", "title", "current_price", "source_text", "category") == [
        ("p1", 4, "ett", 10, "om p1", "k"), ("p2", 4, None, 5, None, None), ("p3", 4, None, None, None, None)]
    assert sorted(r[0] for r in rows(products, "id")) == [1, 2, 3]
    named = store.read("price_history").join(products.select(F.col("id").alias("product_id"), "url"), "product_id")
    assert rows(named, "url", "price") == [("p1", 10), ("p1", 10), ("p2", 5)]
    assert rows(store.read("render_jobs"), "url", "type", "status") == [
        ("lista", "list", "done"), ("p1", "detail", "done"), ("p2", "detail", "pending"), ("p3", "detail", "pending")]
    before = rows(store.read("render_jobs"))
    again = spark.createDataFrame([(1, 9, "fel", None, None, None, None, None, None)], crawl_results.CRAWL_RESULT)
    assert crawl_results.apply_results(store, again, 1, NOW, query_id(spark, str(tmp_path / "cp"))()) is False
    assert rows(store.read("render_jobs")) == before


def test_row_stream_finishes_each_job_once(spark, tmp_path, rows):
    store = row_results.open_store(spark, str(tmp_path / "store"))
    jobs = [(i, 7, "processing", "f.csv", None, None, "", 2, 0, None, 0, 0) for i in (1, 2)]
    store.create({"jobs": spark.createDataFrame(jobs, TABLES["jobs"]), "results": spark.createDataFrame([], row_results.RESULT_SCHEMA)})
    headers = spark.createDataFrame([(1, ["P"]), (2, ["P"])], "job_id long, fieldnames array<string>")
    cells = spark.createDataFrame([(j, i, ["x"]) for j in (1, 2) for i in (0, 1)], "job_id long, row_index long, cells array<string>")

    def message(job, row, text, order=1):
        return {"job_id": job, "row_index": row, "ord": order, "beskrivning": text, "varfor": text}

    for name, batch in {"1.json": [message(1, 0, "a"), message(2, 0, None)], "2.json": [message(1, 1, "b")], "3.json": [message(1, 1, None, 2), message(2, 1, "c")]}.items():
        put(tmp_path / "in", name, *batch)
        row_results.stream_row_results(spark, str(tmp_path / "in"), store, headers, cells, str(tmp_path / "cp"), NOW).awaitTermination()
    assert rows(store.read("jobs"), "id", "status", "succeeded") == [(1, "done", 2), (2, "done", 1)]
    assert rows(store.read("results")) == [(1, 0, "a", "a"), (1, 1, "", ""), (2, 0, "", ""), (2, 1, "c", "c")]


@pytest.mark.parametrize("describing", [True, False])
def test_tick_sends_each_message_once(spark, rows, tmp_path, describing):
    site = (1, "butik", "https://s", "", "", "", "", "", "query", 1, "", "", 0, 1, 60, None)
    products = [(1, "u1", 1, "t", 500, None, None, None, None, None, None, 0, 0), (2, "u2", 1, "t2", 5, "s", "c", None, None, None, None, 0, 0)]
    tables = Tables(
        spark.createDataFrame(products, TABLES["products"]),
        spark.createDataFrame([site], TABLES["sites"]),
        spark.createDataFrame([(1, "u1", 1, "detail", "leased", 1, NOW - 1, None, 0, 0), (2, "x", 1, "detail", "leased", 1, NOW + 1, None, 0, 0)], TABLES["render_jobs"]),
        spark.createDataFrame([(1, 1000, 1), (1, 500, 2)], TABLES["price_history"]),
        spark.createDataFrame([(9, 1, None, 0)], TABLES["price_watch"]),
        spark.createDataFrame([(1, 9, "slack", "https://s", 1, 0)], TABLES["alert_channels"]),
    )
    log = tmp_path / "sent"

    def deliver(kind, endpoint, headers, payload):
        with open(log, "a") as out:
            out.write(endpoint + "\n")
        return True

    def generate(system, message):
        return '{"beskrivning": "b", "varför": "v"}'

    after, summary = tick(tables, NOW, deliver, generate if describing else None)
    # The reclaimed job for u1 is active again, so no second one is made.
    want = {"reclaimed": 1, "crawls": 1, "scheduled": 0, "alerts": 1} | ({"described": 2} if describing else {})
    assert {r.step: r.n for r in summary.collect()} == want
    assert rows(after.render_jobs, "id", "type", "status") == [(1, "detail", "pending"), (2, "detail", "leased"), (3, "list", "pending")]
    assert rows(after.price_watch, "last_alert") == [(NOW,)]
    assert rows(after.sites, "last_crawled") == [(NOW,)]
    assert rows(after.products, "id", "description") == ([(1, "b"), (2, "b")] if describing else [(1, None), (2, None)])
    assert log.read_text() == "https://s\n"


HOUR = 3_600_000


class PriceStream:
    """Runs both queries of the price stream to their end at a given hour."""

    def __init__(self, spark, folder, watch, refuse=()):
        self.spark, self.root, self.refuse = spark, str(folder), folder / "refuse"
        self.log = folder / "sent"
        self.watch = spark.createDataFrame(watch, "account_id long, product_id long, last_alert long")
        self.products = spark.createDataFrame([(7, "t", "u"), (8, None, "v")], "id long, title string, url string")
        self.channels = spark.createDataFrame([(a, a, "slack", f"https://{a}", int(a != 9)) for a in range(1, 10)], "id long, account_id long, kind string, target string, enabled int")

    def run(self, hour, *points, refuse=(), retry_ms=300_000):
        rows = [(product, price, ts, NOW + hour * HOUR, message) for product, price, ts, message in points]
        if rows:
            self.spark.createDataFrame(rows, price_drops.POINT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        log = str(self.log)

        def deliver(kind, endpoint, headers, payload):
            with open(log, "a") as out:
                out.write(f"{hour} {endpoint}\n")
            return endpoint not in refuse

        price_drops.stream_pairs(self.spark, f"{self.root}/in", self.root).awaitTermination()
        run = price_drops.stream_alerts(self.spark, self.root, self.watch, self.products, self.channels, deliver, retry_ms=retry_ms)
        run.awaitTermination()
        return run

    def alerts(self):
        got = price_drops.raised_alerts(self.spark, self.root).collect()
        return sorted(((r["at"] - NOW) // HOUR, r["account_id"], r["product_id"], r["old_price"], r["new_price"], r["ok"]) for r in got)


def test_price_stream_cooldown_starts_with_an_accepted_delivery(spark, tmp_path):
    stream = PriceStream(spark, tmp_path, [(1, 7, None), (2, 7, NOW - HOUR), (3, 7, None), (9, 7, None), (1, 5, None)])
    stream.run(0, (7, 5000, 1, "a"), (7, 4000, 2, "b"), (5, 9, 1, "x"), refuse={"https://3"})
    assert stream.alerts() == [(0, 1, 7, 5000, 4000, True), (0, 3, 7, 5000, 4000, False)]
    # A refused alert is raised again, by a new point or, without one, when another message moves the time on; the accepted one rests for a day.
    stream.run(1, (7, 3000, 3, "c"), refuse={"https://3"})
    stream.run(2, (8, 2, 3, "d"), (8, 1, 4, "e"))
    assert stream.alerts()[2:] == [(1, 3, 7, 4000, 3000, False)]
    stream.run(3, (7, 3000, 2, "late"), (7, 2000, 4, "f"))
    assert stream.alerts()[3:] == [(3, 3, 7, 3000, 2000, True)]
    # The pair rises: nothing stands when the cooldowns of accounts 1 and 2 end.
    stream.run(26, (7, 2500, 5, "g"))
    stream.run(27, (7, 1500, 6, "h"))
    assert stream.alerts()[4:] == [(27, 1, 7, 2500, 1500, True), (27, 2, 7, 2500, 1500, True), (27, 3, 7, 2500, 1500, True)]
    assert len(stream.log.read_text().split("\n")) == 1 + len(stream.alerts())


def test_price_stream_asks_again_by_timer_and_forgets(spark, tmp_path):
    stream = PriceStream(spark, tmp_path, [(1, 7, None), (2, 7, None), (3, 8, None)])
    stream.run(0, (7, 5000, 1, "a"), (7, 4000, 2, "b"), refuse={"https://2"})
    # Product 8 moves the time on for the watches of product 7: the refused alert after its wait, the standing drop after the cooldown.
    stream.run(5, (8, 5000, 1, "c"), (8, 1, 2, "d"), refuse={"https://2"})
    stream.run(25, (8, 5000, 3, "e"))
    # Points that rise are passed on once, to end a drop.
    assert stream.alerts() == [(0, 1, 7, 5000, 4000, True), (0, 2, 7, 5000, 4000, False), (5, 2, 7, 5000, 4000, False), (5, 3, 8, 5000, 1, True), (25, 1, 7, 5000, 4000, True), (25, 2, 7, 5000, 4000, True)]
    stream.run(90, (7, 6000, 9, "f"), (8, 5100, 9, "g"))
    run = stream.run(200, (8, 6000, 10, "h"), (8, 5000, 11, "i"))
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_price_stream_counts_redelivered_points_once(spark, tmp_path):
    stream = PriceStream(spark, tmp_path, [(1, 7, None)])
    stream.run(0, (7, 5000, 1, "a"), (7, 5000, 1, "a"))
    stream.run(1, (7, 5000, 1, "a"), (7, 4000, 2, "b"))
    stream.run(2, (7, 4000, 2, "b"))
    # Counted again, the point of 4000 would hide the drop.
    assert stream.alerts() == [(1, 1, 7, 5000, 4000, True)]
    pairs = spark.read.schema(price_drops.PAIR_SCHEMA).parquet(f"{stream.root}/pairs")
    assert [tuple(r) for r in pairs.collect()] == [(7, NOW + HOUR, 5000, 4000)]


def test_price_stream_keeps_groups_of_products_and_watches(spark, tmp_path, monkeypatch):
    """Python runs once per group, not once per product or watch (F3)."""
    monkeypatch.setattr(price_drops, "GROUPS", 2)
    stream = PriceStream(spark, tmp_path, [(account, product, None) for account in (1, 2) for product in range(30)])
    stream.products = spark.createDataFrame([(i, "t", "u") for i in range(30)], "id long, title string, url string")
    run = stream.run(0, *[(i, price, ts, f"{i}-{ts}") for i in range(30) for ts, price in ((1, 5000), (2, 4000 + 2000 * (i % 2)))])
    assert stream.alerts() == sorted((0, account, i, 5000, 4000, True) for account in (1, 2) for i in range(0, 30, 2))
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    # Some products rise, some fall again; single points come in any order.
    stream.run(25, *[(i, 3000 if i % 3 else 9000, 3 if i % 4 else 0, f"{i}-x") for i in range(30)])
    late = {i: [p for _, p in sorted([(1, 5000), (2, 4000 + 2000 * (i % 2)), (3 if i % 4 else 0, 3000 if i % 3 else 9000)])[-2:]] for i in range(30)}
    want = sorted((25, account, i, old, new, True) for account in (1, 2) for i, (old, new) in late.items() if old - new >= 100)
    assert [a for a in stream.alerts() if a[0] == 25] == want


def test_price_stream_remembers_messages_in_groups(spark, tmp_path, monkeypatch):
    """No row of state per message (F3); messages without an id are known by their content, incomplete ones are left out."""
    monkeypatch.setattr(price_drops, "GROUPS", 2)
    monkeypatch.setattr(price_drops, "SEEN_GROUPS", 2, raising=False)
    source, kept = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    before, first = spark.conf.get(kept, None), [(i, price, ts, NOW, f"{i}-{ts}") for i in range(20) for ts, price in ((1, 5000), (2, 4000))]
    second = [*first, *[(0, 3000, 3, NOW + HOUR, None)] * 2, (None, 1, 4, NOW, "n"), (1, None, 4, NOW, "p"), (2, 1, None, NOW, "t"), (3, 1, 4, None, "a")]
    for points in (first, second):
        spark.createDataFrame(points, price_drops.POINT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run = price_drops.stream_pairs(spark, source, str(tmp_path))
        run.awaitTermination()
        assert spark.conf.get(kept, None) == before
        assert all(operator["numRowsTotal"] < 20 for progress in run.recentProgress for operator in progress["stateOperators"])
    pairs = spark.read.schema(price_drops.PAIR_SCHEMA).parquet(f"{tmp_path}/pairs")
    assert sorted(map(tuple, pairs.collect())) == sorted([(i, NOW, 5000, 4000) for i in range(20)] + [(0, NOW + HOUR, 4000, 3000)])


def test_price_stream_sends_a_stored_batch_once(spark, tmp_path):
    stream = PriceStream(spark, tmp_path, [(1, 7, None)])
    stream.run(0, (7, 5000, 1, "a"), (7, 4000, 2, "b"))
    commits = sorted((tmp_path / "alerts-checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    # The last batches run again, as after a failure behind the sending.
    for commit in commits:
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    stream.run(0)
    assert stream.log.read_text() == "0 https://1\n" and stream.alerts() == [(0, 1, 7, 5000, 4000, True)]


def test_redelivered_crawl_results_count_once(spark, tmp_path, rows):
    jobs = [(1, "p1", 4, "detail", "leased", 1, NOW, None, 0, 0)]
    message = {"job_id": 1, "ord": 1, "error": "fel", "message_id": "m", "sent_at": NOW}
    for name, within, rejected in (("once", "1 day", 1), ("each", None, 1)):
        folder = tmp_path / name
        folder.mkdir()
        store = crawl_results.open_store(spark, str(folder / "store"))
        store.create({"render_jobs": spark.createDataFrame(jobs, TABLES["render_jobs"])})
        for number in range(2):
            (folder / "in").mkdir(exist_ok=True)
            # The second delivery finds the job leased anew.
            later = {"job_id": 1, "ord": 2, "error": "fel", "sent_at": NOW + 1000 * number}
            (folder / "in" / f"{number}.json").write_text("\n".join([json.dumps(message), *(["nonsense"] if not number else []), *([json.dumps({**later, "job_id": 77})] * 2)]))
            crawl_results.stream_crawl_results(spark, str(folder / "in"), store, str(folder / "cp"), NOW, within=within).awaitTermination()
        assert len(rows(store.read("rejects"))) == rejected
        assert store.pending_batches() != []
    (tmp_path / "plain").mkdir()
    source = spark.readStream.schema("a long, t long, id string").json(str(tmp_path / "plain"))
    lines = [{"a": 1, "t": NOW, "id": "x"}, {"a": 1, "t": NOW, "id": "x"}, {"a": 2, "t": NOW}, {"a": 2, "t": NOW}, {"a": 3, "t": NOW}, {"a": 4, "id": "y"}]
    put(tmp_path / "plain", "1.json", *lines)
    told = once(source, F.timestamp_millis("t"), "id", "1 hour")
    out = str(tmp_path / "told")

    def go():
        told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["a"] for r in spark.read.parquet(out).collect())

    assert go() == [1, 2, 3, 4]
    # Again, late but within the hour, and too late.
    put(tmp_path / "plain", "2.json", {"a": 9, "t": NOW + 2 * HOUR, "id": "z"}, lines[0])
    assert go() == [1, 2, 3, 4, 9]
    put(tmp_path / "plain", "3.json", {"a": 10, "t": NOW + HOUR + 60_000, "id": "late"}, {"a": 11, "t": NOW - HOUR, "id": "too late"})
    assert go() == [1, 2, 3, 4, 9, 10]


def test_throttle_stream_forgets_quiet_keys(spark, tmp_path, rows):
    schema, minute = "bucket string, ip string, ts long, attempt_id long", 60_000

    def run(name, *attempts):
        spark.createDataFrame(attempts, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = throttle_stream(source, 2, 600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert run("a", ("login", "x", 3 * minute, 3), ("login", "x", minute, 1), ("login", "x", 2 * minute, 2), ("login", "y", minute, 4)) == 2
    # Eleven quiet minutes: x starts anew, y is forgotten.
    assert run("b", ("login", "x", 14 * minute, 5)) == 1
    assert run("c", ("other", "z", 100 * minute, 6), ("other", "z", 100 * minute, 7), ("other", "z", 100 * minute, 8)) == 1
    got = rows(spark.read.parquet(str(tmp_path / "out")), "attempt_id", "allowed")
    assert got == [(1, True), (2, True), (3, False), (4, True), (5, True), (6, True), (7, True), (8, False)]
