"""Alert channels of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.text import trim_ws
from varuvakt.functions.urls import safe_target_url

# Channel kinds, and those whose target is a URL.
KINDS = ("ntfy", "slack", "telegram", "webhook")
URL_KINDS = ("ntfy", "slack", "webhook")


def valid_channels(requests: DataFrame) -> DataFrame:
    """Channel requests that may be stored, with the target trimmed."""
    trimmed = requests.withColumn("target", trim_ws("target"))
    return trimmed.filter(
        F.col("kind").isin(*KINDS)
        & (F.col("target") != "")
        & (~F.col("kind").isin(*URL_KINDS) | safe_target_url(F.col("target")))
    )


def enabled_channels(channels: DataFrame) -> DataFrame:
    """Channels alerts go to, per account in the order they were added."""
    return (
        channels.filter("enabled = 1")
        .select("account_id", "id", "kind", "target", "created_at")
        .orderBy("account_id", "created_at", "id")
    )
