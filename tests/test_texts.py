import json
import re

import pytest
from pyspark.sql import functions as F

from conftest import NOW
from varuvakt.functions import faults, prompts, text
from varuvakt.functions.replies import parse_description, parse_product_arrays, product_rows
from varuvakt.functions.urls import absolute_link, in_scope, safe_target_url


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_trim_takes_unicode_blanks(spark):
    assert column(spark, ["﻿  a b  \n", "", None], text.trim_ws) == ["a b", "", None]


@pytest.mark.parametrize(
    ("needle", "matches"),
    [("år", ["Mittår"]), ("ÅR", ["ÅRE"]), ("50%", ["50 procent", "50%"]), ("a_b", ["aXb", "a_b"]), ("\\", ["c\\d"])],
)
def test_like_folds_ascii_only(spark, needle, matches):
    titles = ["ÅRE", "Mittår", "50 procent", "50%", "aXb", "a_b", "c\\d", None]
    hits = column(spark, titles, lambda c: text.like_ascii(c, needle))
    assert [t for t, hit in zip(titles, hits) if hit] == matches


def test_csv_cells(spark):
    got = column(spark, ["a", 'a"b', "a,b", "a\nb", "a\rb", "", None], text.csv_cell)
    assert got == ["a", '"a""b"', '"a,b"', '"a\nb"', '"a\rb"', "", ""]


def test_price_format(spark):
    got = column(spark, [0, 999, 1000, 1234567, -1500, None], text.format_price, "long")
    assert got == ["0 kr", "999 kr", "1 000 kr", "1 234 567 kr", "−1 500 kr", "—"]


def test_safe_filename(spark):
    got = column(spark, ["a.csv", 'å"b;c.x.csv', ".csv", "utan", "a b-c.txt"], text.safe_filename)
    assert got == ["a", "_b_c.x", "resultat", "utan", "a b-c"]


def test_redaction_order_and_secret_choice(spark):
    settings = {"A_KEY": "hemligt!", "PASS": "kort", "REGION": "nordligast"}
    raw = "hemligt! kort nordligast sk-ABCDEFGHIJKLMNOP a@b.se /home/eva/x Bearer abcdefghijk"
    got = column(spark, [raw], lambda c: text.redact(c, settings))[0]
    assert got == "[REDACTED] kort nordligast [REDACTED] [EMAIL REDACTED] /home/[user]/x [REDACTED]"


SAFE = {
    "https://hooks.example.com/a": True, "HTTPS://Hooks.Example.com": True, "http://hooks.example.com": False,
    "https://localhost/x": False, "https://a.local": False, "https://a.localhost": False, "https://a.internal/": False,
    "https://[::1]/": False, "https://10.1.2.3/": False, "https://127.0.0.1/": False, "https://0.1.2.3/": False,
    "https://169.254.169.254/": False, "https://169.253.0.1/": True, "https://172.15.0.1/": True,
    "https://172.16.0.1/": False, "https://172.31.0.1/": False, "https://172.32.0.1/": True, "https://192.168.0.1/": False,
    "https://192.169.0.1/": True, "https://100.63.0.1/": True, "https://100.64.0.1/": False, "https://100.127.0.1/": False,
    "https://100.128.0.1/": True, "not a url": False, "https://2130706433/": False, "https://0x7f.1/": False, "": False,
}


def test_safe_target_url(spark):
    assert dict(zip(SAFE, column(spark, list(SAFE), safe_target_url))) == SAFE


def test_links(spark):
    df = spark.createDataFrame(
        [("https://a.se/p?x=1", "/b"), ("https://a.se", "https://b.se/c"), ("https://a.se", "#top")], "page string, href string"
    )
    got = [r[0] for r in df.select(absolute_link(F.col("page"), F.col("href"))).collect()]
    assert got == ["https://a.se/b", "https://b.se/c", "https://a.se#top"]
    scope = [("https://a.se/p/1", "https://a.se/p/", "", True), ("https://a.se/q", "https://a.se/p/", "", False),
             ("https://a.se/p/cart", "", "cart", False), ("x", "", "", True)]
    df = spark.createDataFrame(scope, "link string, s string, e string, want boolean")
    assert all(r[0] == r[1] for r in df.select(in_scope(F.col("link"), F.col("s"), F.col("e")), "want").collect())


REPLIES = [
    '{"beskrivning": " a ", "varför": "b"}', 'svar: {"beskrivning": "a", "varfor": "c"} slut', '{"beskrivning": "a"} skräp }',
    "{bad}", "  fri text ", "", None, '{"beskrivning": 12, "varför": null}', '{"beskrivning": {"k": 1}}', "{'beskrivning': 'a'}",
    '{"a":1},{"beskrivning":"b"}', '{"beskrivning": "a", "varför": null, "varfor": "v"}', '{"beskrivning": "a\\nb"}', "{}", '{"beskrivning": NaN}',
]


def expected_reply(content):
    body = (content or "").strip()
    match = re.search(r"\{.*\}", body, re.S)
    if match:
        try:
            data = json.loads(match[0], parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return body, ""

        def get(*names):
            value = next((data[n] for n in names if data.get(n) is not None), "")
            return (value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))).strip()

        return get("beskrivning"), get("varför", "varfor")
    return body, ""


def test_reply_parsing_is_strict(spark):
    got = column(spark, REPLIES, parse_description)
    assert [tuple(g) for g in got] == [expected_reply(r) for r in REPLIES]


def test_product_arrays(spark, rows):
    replies = [
        (1, ['Här: [{"Product": " A ", "Price (SEK)": 5}, {"Site": "x"}, {"Product": "B", "Site": "s"}] slut']),
        (2, ["inget"]), (3, ['[{"Product": "A"}] skräp ]']), (4, ['[{"Site": "x"}]']), (5, ["[bad]", '[{"Product": "C"}]']), (6, []),
        (7, ["[]"]), (8, ['[{"Product": "A"}], [{"Product": "B"}]']),
    ]
    df = spark.createDataFrame(replies, "k int, replies array<string>")
    got = rows(product_rows(parse_product_arrays(df, "replies"), ["k"]))
    assert got == sorted([
        (1, 0, "", "A", "5", "", None), (1, 1, "s", "B", "", "", None), (2, None, None, None, None, None, "no_match"),
        (3, None, None, None, None, None, "bad_json"), (4, None, None, None, None, None, "no_products"),
        (5, 0, "", "C", "", "", None), (6, None, None, None, None, None, None), (7, None, None, None, None, None, "no_products"),
        (8, None, None, None, None, None, "bad_json"),
    ], key=repr)


def test_prompt_options(spark):
    df = spark.createDataFrame([("lyxig", "kort", " barn ", " x "), ("okänd", "", "  ", None), (None, None, None, "")],
                               "tone string, length string, audience string, custom string")
    got = [r[0] for r in df.select(prompts.system_prompt(*[F.col(c) for c in df.columns])).collect()]
    base = prompts.BASE_PROMPT
    assert got[0] == "\n".join([base, prompts.TONES["lyxig"], prompts.LENGTHS["kort"],
                                "Anpassa motiveringen för målgruppen: barn.", "Extra instruktion från användaren: x"])
    assert got[1] == got[2] == f"{base}\n{prompts.VARIED_TONE}"


def test_user_message(spark):
    df = spark.createDataFrame([("b", "p", 5, " k ", " "), (None, None, None, None, "t")],
                               "site string, product string, price long, category string, source string")
    got = [r[0] for r in df.select(prompts.user_message(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["Produkt: p\nKategori: k\nButik: b\nPris: 5 kr", "Produkt: \nProduktinfo: t\nButik: \nPris:  kr"]


def test_triage(spark):
    cases = [(429, "x", 30), (429, "x", 0), (429, "x", None), (400, "Your Credit Balance is low", None), (500, "boom", 9)]
    df = spark.createDataFrame(cases, "status int, body string, retry int")
    got = [tuple(r[0]) for r in df.select(faults.triage(F.col("status"), F.col("body"), F.col("retry"), F.lit(NOW + 5))).collect()]
    midnight = NOW + 86_400_000
    assert got == [("rate_limited", NOW + 30_005), ("rate_limited", midnight), ("rate_limited", midnight),
                   ("billing_exhausted", NOW + 5 + 21_600_000), ("fatal", None)]


def test_friendly_messages(spark):
    got = column(spark, [None, "", "API key xx not valid", "Rate-limit", "rad ett\nrad två", "z" * 161, "z" * 160, "fel 4290"], faults.friendly_message)
    assert got == [faults.TEXT_UNKNOWN] * 2 + [faults.TEXT_BAD_KEY, faults.TEXT_QUOTA, "rad ett", "z" * 157 + "…", "z" * 160, "fel 4290"]


def test_fingerprint_groups(spark, rows):
    log = [("E", "E: a\n  at f (x)\n at g", 1), ("E", "E: b\nat f (x)", 5), ("E", "E: b", 2), ("F", None, 3)]
    got = rows(faults.error_groups(spark.createDataFrame(log, "name string, stack string, ts long")), "occurrences", "name", "first_ts", "last_ts")
    assert got == [(1, "E", 2, 2), (1, "F", 3, 3), (2, "E", 1, 5)]
