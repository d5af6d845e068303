"""Classification of provider errors and grouping of error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.text import trim_ws

DAY_MS = 86_400_000

# Phrases that mean "out of credit", the wait that follows, and
# the user-facing texts.
BILLING_PHRASES = (
    "credit balance",
    "insufficient_quota",
    "insufficient quota",
    "exceeded your current quota",
    "billing",
)
BILLING_WAIT_MS = 6 * 3600 * 1000
BAD_KEY_PATTERN = r"(?i)API[_ ]?key.*(not valid|invalid)|API_KEY_INVALID"
QUOTA_PATTERN = r"(?i)kvot|quota|rate.?limit|\b429\b"
TEXT_UNKNOWN = "okänt fel"
TEXT_BAD_KEY = "ogiltig API-nyckel — kontrollera din nyckel under Beskriv-verktyg."
TEXT_QUOTA = "AI-kvoten är slut — försök igen senare."
MESSAGE_CUT = 300
FRIENDLY_CUT = 160


def next_utc_midnight(now_ms: Column) -> Column:
    return (F.floor(now_ms / F.lit(DAY_MS)) + 1) * F.lit(DAY_MS)


def triage(status: Column, body: Column, retry_after_s: Column, now_ms: Column) -> Column:
    """``struct(kind, resume_at)`` for a failed provider call.

    A retry hint of zero counts as no hint. ``resume_at`` is NULL for fatal errors.
    """
    lowered = F.lower(F.coalesce(body, F.lit("")))
    billing = F.lit(False)
    for phrase in BILLING_PHRASES:
        billing = billing | lowered.contains(phrase)
    hinted = F.when(F.coalesce(retry_after_s, F.lit(0)) != 0, now_ms + retry_after_s * 1000)
    kind = (
        F.when(status == 429, "rate_limited").when(billing, "billing_exhausted").otherwise("fatal")
    )
    resume = (
        F.when(status == 429, F.coalesce(hinted, next_utc_midnight(now_ms)))
        .when(billing, now_ms + F.lit(BILLING_WAIT_MS))
        .cast("long")
    )
    return F.struct(kind.alias("kind"), resume.alias("resume_at"))


def fatal_message(provider: Column, status: Column, body: Column) -> Column:
    return F.concat(
        provider, F.lit(" API-fel ("), status.cast("string"), F.lit("): "), F.substring(body, 1, MESSAGE_CUT)
    )


def friendly_message(message: Column) -> Column:
    """Short user-facing text for a raw error message."""
    first = trim_ws(F.split_part(message, F.lit("\n"), F.lit(1)))
    cut = F.concat(F.substring(first, 1, FRIENDLY_CUT - 3), F.lit("…"))
    return (
        F.when(F.coalesce(message, F.lit("")) == "", TEXT_UNKNOWN)
        .when(message.rlike(BAD_KEY_PATTERN), TEXT_BAD_KEY)
        .when(message.rlike(QUOTA_PATTERN), TEXT_QUOTA)
        .when(F.char_length(first) > FRIENDLY_CUT, cut)
        .otherwise(first)
    )


def fingerprint(name: Column, stack: Column) -> Column:
    """First ten hex digits of the SHA-256 of ``name@first stack frame``.

    The first frame is the second line of the stack; a stack without one counts as ``?``.
    """
    frame = trim_ws(F.get(F.split(F.coalesce(stack, F.lit("")), "\n", 3), F.lit(1)))
    return F.substring(F.sha2(F.concat(name, F.lit("@"), F.coalesce(frame, F.lit("?"))), 256), 1, 10)


def error_groups(errors: DataFrame) -> DataFrame:
    """Occurrences per fingerprint over an error log (name, stack, ts)."""
    return (
        errors.withColumn("fingerprint", fingerprint(F.col("name"), F.col("stack")))
        .groupBy("fingerprint")
        .agg(
            F.count("*").alias("occurrences"),
            F.min("name").alias("name"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
