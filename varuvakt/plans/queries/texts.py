"""Text expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.functions import faults, prompts, text
from varuvakt.functions.replies import parse_description, parse_product_arrays, product_rows
from varuvakt.operators.describe import extract_with
from varuvakt.plans.fixtures import NOW_MS, Fixture
from varuvakt.plans.registry import query


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cases(col: str, table: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {quoted(k)} THEN chr(10) || {quoted(v)}" for k, v in table.items())


@query(
    "build_prompt",
    f"""SELECT id, {quoted(prompts.BASE_PROMPT)} || {cases('tone', prompts.TONES)} ELSE chr(10) || {quoted(prompts.VARIED_TONE)} END
 || {cases('length', prompts.LENGTHS)} ELSE '' END
 || CASE WHEN TRIM(coalesce(audience, '')) = '' THEN '' ELSE chr(10) || {quoted(prompts.AUDIENCE_PREFIX)} || TRIM(audience) || '.' END
 || CASE WHEN TRIM(custom_direction) = '' THEN '' ELSE chr(10) || {quoted(prompts.CUSTOM_PREFIX)} || TRIM(custom_direction) END AS prompt
FROM jobs""",
)
def _build_prompt(fx: Fixture) -> DataFrame:
    options = [F.col(c) for c in ("tone", "length", "audience", "custom_direction")]
    return fx.jobs.select("id", prompts.system_prompt(*options).alias("prompt"))


# Replies of every shape the parsers meet, around a document's whole text (q: the text as a JSON string).
REPLY = """CASE doc_id % 8 WHEN 0 THEN concat('{"beskrivning": ', q, ', "varför": " därför "}')
 WHEN 1 THEN concat('Här: {"beskrivning": ', q, ', "varfor": "utan prickar"} hej')
 WHEN 2 THEN concat('{"beskrivning": ', q, '} skräp }') WHEN 3 THEN '{bad}' WHEN 4 THEN concat('  ', text, '  ')
 WHEN 5 THEN '{"beskrivning": 12, "varför": null}' WHEN 6 THEN '{"beskrivning": {"k": 1}, "varför": true}' ELSE NULL END AS reply"""
ARRAY_REPLY = """CASE doc_id % 6
 WHEN 0 THEN concat('Svar: [{"Product": ', q, ', "Site": " S ", "Price (SEK)": 10}, {"Site": "utan"}, {"Product": "två"}] slut')
 WHEN 1 THEN concat('[{"Product": ', q, '}') WHEN 2 THEN concat('[{"Product": ', q, '}] skräp ]') WHEN 3 THEN '[{"Site": "x"}, {"Product": " "}]'
 WHEN 4 THEN '[]' ELSE concat('[{"Product": "ett"},{"Product": null, "Site": ', q, '}]') END AS reply"""


def quoted_documents(fx: Fixture) -> DataFrame:
    wrapped = fx.documents.selectExpr("doc_id", "text", "to_json(named_struct('t', text)) AS j")
    return wrapped.selectExpr("doc_id", "text", "substring(j, 6, length(j) - 6) AS q")


@query(
    "parse_description",
    f"""WITH replies AS (SELECT doc_id, {REPLY} FROM (SELECT doc_id, text, to_json(text)::varchar AS q FROM documents)),
shaped AS (SELECT doc_id, TRIM(coalesce(reply, '')) AS reply, TRIM(text) AS text FROM replies JOIN documents USING (doc_id))
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text WHEN 5 THEN '12' WHEN 6 THEN '{{"k":1}}' ELSE reply END AS beskrivning,
 CASE doc_id % 8 WHEN 0 THEN 'därför' WHEN 1 THEN 'utan prickar' WHEN 6 THEN 'true' ELSE '' END AS varfor FROM shaped""",
)
def _parse_description(fx: Fixture) -> DataFrame:
    replies = quoted_documents(fx).selectExpr("doc_id", REPLY)
    return replies.select("doc_id", parse_description(F.col("reply")).alias("p")).select("doc_id", "p.*")


@query(
    "parse_product_array",
    """SELECT doc_id, 0::bigint AS row_index, 'S' AS site, TRIM(text) AS product, '10' AS price, '' AS link, NULL AS error FROM documents WHERE doc_id % 6 = 0 AND TRIM(text) <> ''
UNION ALL SELECT doc_id, CASE WHEN TRIM(text) <> '' THEN 1 ELSE 0 END, '', 'två', '', '', NULL FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, 0, '', 'ett', '', '', NULL FROM documents WHERE doc_id % 6 = 5
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, CASE doc_id % 6 WHEN 1 THEN 'no_match' WHEN 2 THEN 'bad_json' ELSE 'no_products' END
 FROM documents WHERE doc_id % 6 IN (1, 2, 3, 4)""",
)
def _parse_product_array(fx: Fixture) -> DataFrame:
    answers = quoted_documents(fx).selectExpr("doc_id", ARRAY_REPLY)
    parsed = parse_product_arrays(answers.select("doc_id", F.array("reply").alias("replies")), "replies")
    return renamed(product_rows(parsed, ["doc_id"]))


def renamed(rows: DataFrame) -> DataFrame:
    names = {"Site": "site", "Product": "product", "Price (SEK)": "price", "Link": "link"}
    return rows.withColumnsRenamed(names)


def quote_lines(system: str, piece: str) -> str:
    """A stand-in extractor: every line of the text is a product, its first word the shop; fails on every seventh length."""
    import json

    if len(piece) % 7 == 0:
        raise ValueError("no answer")
    lines = [line.strip() for line in piece.split("\n") if line.strip(" ")]
    items = [{"Product": line, "Site": line.split(" ")[0], "Price (SEK)": len(line) + 0.0} for line in lines]
    return "Produkter: " + json.dumps(items, ensure_ascii=False)


@query(
    "extract_with",
    """WITH trimmed AS (SELECT doc_id, TRIM(text) AS text FROM documents),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM trimmed WHERE length(text) % 7 <> 0),
listed AS (SELECT doc_id, generate_subscripts(lines, 1) AS line_no, TRIM(unnest(lines)) AS product FROM cut)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS row_index, split_part(product, ' ', 1) AS site, product,
 length(product)::varchar AS price, '' AS link, NULL::varchar AS error FROM listed WHERE product <> ''
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN text = '' THEN 'empty' ELSE 'failed' END FROM trimmed WHERE length(text) % 7 = 0""",
)
def _extract_with(fx: Fixture) -> DataFrame:
    docs, calls = fx.documents.select("doc_id", "text"), fx.spark.sparkContext.defaultParallelism
    return renamed(extract_with(docs, quote_lines, ["doc_id"], concurrency=calls).drop("resume_at"))


PROVIDER_ERRORS = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 400 ELSE 500 END AS status,
 CASE doc_id % 9 WHEN 0 THEN concat(text, ' Credit Balance too low') WHEN 1 THEN concat('insufficient_quota ', text) WHEN 2 THEN concat('api_key is not valid', text)
  WHEN 3 THEN concat('Rate-limit ', text) WHEN 4 THEN '' WHEN 5 THEN NULL ELSE text END AS body,
 CASE doc_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 0 ELSE NULL END AS retry_after FROM documents"""


@query(
    "error_triage",
    f"""WITH e AS ({PROVIDER_ERRORS}),
flagged AS (SELECT *, regexp_matches(lower(coalesce(body, '')), 'credit balance|insufficient_quota|insufficient quota|exceeded your current quota|billing') AS billing,
 TRIM(split_part(body, chr(10), 1)) AS first_line FROM e)
SELECT doc_id, CASE WHEN status = 429 THEN 'rate_limited' WHEN billing THEN 'billing_exhausted' ELSE 'fatal' END AS kind,
 CASE WHEN status = 429 THEN CASE WHEN coalesce(retry_after, 0) <> 0 THEN {{now}} + retry_after * 1000 ELSE ({{now}} // 86400000 + 1) * 86400000 END
  WHEN billing THEN {{now}} + 21600000 END AS resume_at,
 'gemini API-fel (' || status || '): ' || left(body, 300) AS message,
 CASE WHEN coalesce(body, '') = '' THEN 'okänt fel'
  WHEN regexp_matches(body, 'API[_ ]?key.*(not valid|invalid)|API_KEY_INVALID', 'i') THEN 'ogiltig API-nyckel — kontrollera din nyckel under Beskriv-verktyg.'
  WHEN regexp_matches(body, 'kvot|quota|rate.?limit|\\b429\\b', 'i') THEN 'AI-kvoten är slut — försök igen senare.'
  WHEN length(first_line) > 160 THEN left(first_line, 157) || '…' ELSE first_line END AS friendly FROM flagged""",
)
def _error_triage(fx: Fixture) -> DataFrame:
    errors = fx.spark.sql(PROVIDER_ERRORS.replace("FROM documents", "FROM {documents}"), documents=fx.documents)
    status, body = F.col("status"), F.col("body")
    return errors.select(
        "doc_id",
        faults.triage(status, body, F.col("retry_after"), F.lit(NOW_MS)).alias("t"),
        faults.fatal_message(F.lit("gemini"), status, body).alias("message"),
        faults.friendly_message(body).alias("friendly"),
    ).select("doc_id", "t.*", "message", "friendly")


SECRETS = {"MAIL_API_KEY": "eauenaux", "db_password": "öppna-dörren", "TOKEN": "kort", "REGION": "mentlevi"}
LEAKS = """SELECT doc_id, concat(text, ' sk-', repeat('A1', 10), ' Bearer abc.def-ghi_jkl /home/anna', cast(doc_id AS {s}), '/x ghp_', repeat('z', 22), ' öppna-dörren a.b+c@ex-ample.se') AS text FROM documents"""


@query(
    "redact_text",
    f"""WITH leaks AS ({LEAKS.replace('{s}', 'varchar')}),
masked AS (SELECT doc_id, replace(replace(text, 'eauenaux', '[REDACTED]'), 'öppna-dörren', '[REDACTED]') AS t FROM leaks),
keys AS (SELECT doc_id, regexp_replace(t, 'sk-[A-Za-z0-9]{{16,}}|ghp_[A-Za-z0-9]{{20,}}|gho_[A-Za-z0-9]{{20,}}|AKIA[A-Z0-9]{{12,}}|Bearer\\s+[A-Za-z0-9._-]{{10,}}', '[REDACTED]', 'g') AS t FROM masked),
mails AS (SELECT doc_id, regexp_replace(t, '[\\w.+-]{{1,64}}@[\\w.-]{{1,255}}\\.\\w{{2,24}}', '[EMAIL REDACTED]', 'g') AS t FROM keys)
SELECT doc_id, regexp_replace(t, '/home/[^/\\s]+', '/home/[user]', 'g') AS redacted FROM mails""",
)
def _redact_text(fx: Fixture) -> DataFrame:
    leaks = fx.spark.sql(LEAKS.replace("{s}", "string").replace("FROM documents", "FROM {documents}"), documents=fx.documents)
    return leaks.select("doc_id", text.redact("text", SECRETS).alias("redacted"))


@query(
    "format_price",
    """SELECT id, kr, CASE WHEN kr IS NULL THEN '—' ELSE CASE WHEN kr < 0 THEN chr(8722) ELSE '' END || replace(format('{:,}', abs(kr)), ',', chr(160)) || ' kr' END AS price
FROM (SELECT id, current_price * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN -1 ELSE 1234567 END AS kr FROM products)""",
)
def _format_price(fx: Fixture) -> DataFrame:
    kr = F.expr("current_price * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN -1 ELSE 1234567 END")
    return fx.products.select("id", kr.alias("kr"), text.format_price(kr).alias("price"))


@query(
    "normalise_email",
    "SELECT id, lower(TRIM(chr(160) || ' ' || upper(email) || 'ÅÄ' || chr(9))) AS email FROM accounts",
)
def _normalise_email(fx: Fixture) -> DataFrame:
    raw = F.concat(F.lit("  "), F.upper("email"), F.lit("ÅÄ\t"))
    return fx.accounts.select("id", text.normalise_email(raw).alias("email"))


NAMES = """SELECT id, CASE id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN concat('å"b;', filename) WHEN 2 THEN 'a.b.c' WHEN 3 THEN 'utan ändelse' ELSE filename END AS filename FROM jobs"""


@query(
    "safe_filename",
    f"""SELECT id, coalesce(nullif(regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '[^\\w.\\- ]+', '_', 'g'), ''), 'resultat') AS stem FROM ({NAMES})""",
)
def _safe_filename(fx: Fixture) -> DataFrame:
    named = fx.spark.sql(NAMES.replace("FROM jobs", "FROM {jobs}"), jobs=fx.jobs)
    return named.select("id", text.safe_filename("filename").alias("stem"))
