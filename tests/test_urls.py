from pyspark.sql import functions as F

from varuvakt.functions.replies import parse_product_arrays, product_rows
from varuvakt.functions.urls import absolute_link, hrefs, safe_target_url


def test_targets_as_clients_read_them(spark):
    good = ["https://räksmörgås.se/hook", "https://my_host.example.com/x", "https://a.example/a b", "https://a.example/{x}", "https://a.example/a|b",
            " https://a.example:8443/\t", "HTTPS://u:p@A.example", "https:\\\\a.example", "https://8.8.8.8/x", "https://100.128.0.1", "https://x.рф.se"]
    bad = ["http://a.example", "https://", "https://localhost/x", "https://a.local", "https://a.local./x", "https://10.0.0.1", "https://012.0.0.1", "https://0x7f.1",
           "https://2130706433", "https://300.1.1.1", "https://[::1]/", "https://u@127.0.0.1", "https://a.example@localhost", "https://127。0。0。1/",
           "https://x.ｌｏｃａｌ", "https://a%2elocal", "https://a b.example", "https://a.example:99999", "https://loc\talhost/", "ftp://a.example", "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", safe_target_url(F.col("u")).alias("ok"))
    assert {r.u: r.ok for r in df.collect()} == {u: u in good for u in good + bad}


def test_links(spark):
    html = """<a href="//cdn.example/x"><A HREF='/b?x=1&amp;y=2'><a href = "c/d"><a href="./e"><a href="?q"><a href="#f"><a href="mailto:x@y"><a href="https://z.example/">"""
    df = spark.createDataFrame([("https://shop.x/p/q?r#s", html)], "url string, html string").select("url", F.explode(hrefs(F.col("html"))).alias("h"))
    got = [r[0] for r in df.select(absolute_link(F.col("url"), F.col("h"))).collect()]
    assert got == ["https://cdn.example/x", "https://shop.x/b?x=1&y=2", "https://shop.x/p/c/d", "https://shop.x/p/e", "https://shop.x/p/q?q",
                   "https://shop.x/p/q?r#f", "mailto:x@y", "https://z.example/"]
    top = spark.createDataFrame([("https://shop.x", "a", 1)], "url string, h string, k int")
    assert top.select(absolute_link(F.col("url"), F.col("h"))).collect()[0][0] == "https://shop.x/a"


def test_round_numbers_of_replies(spark):
    reply = r'[{"Product": "a \"Price (SEK)\": 5.0, b", "Price (SEK)": 199.00}, {"Product": "b", "Price (SEK)": 19.25}, {"Product": 7.0, "Price (SEK)": "8.0"}]'
    rows = product_rows(parse_product_arrays(spark.createDataFrame([(1, [reply])], "k int, replies array<string>"), "replies"), ["k"])
    got = [(r["Product"], r["Price (SEK)"]) for r in rows.orderBy("row_index").collect()]
    assert got == [('a "Price (SEK)": 5.0, b', "199"), ("b", "19.25"), ("7", "8.0")]
