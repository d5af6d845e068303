"""Operator patches of sites, roles and suggestions, and admission of suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.functions.text import trim_ws
from varuvakt.operators.merge import fold, prefixed, update_existing, with_new_ids

# Limits and allowed states.
SELECTOR_MAX = 500
INTERVAL_MIN_S = 300
ROLES = ("user", "admin")
SUGGESTION_STATES = ("pending", "coded", "approved", "rejected")
TITLE_CUT = 200
DESCRIPTION_CUT = 4000
PENDING_MAX = 5


def judge_site_patches(patches: DataFrame, sites: DataFrame) -> DataFrame:
    """Patches (id, ord, detail_selector, use_stealth, enabled, scrape_interval) with an outcome.

    NULL fields are not set. Flags are booleans; the interval is a double.
    """
    known = sites.select("id", F.lit(True).alias("_known"))
    finite = F.when(
        ~F.isnan("scrape_interval") & (F.abs("scrape_interval") != F.lit(float("inf"))), F.col("scrape_interval")
    )
    empty = F.coalesce(
        F.col("detail_selector"), F.col("use_stealth").cast("string"), F.col("enabled").cast("string"), finite.cast("string")
    ).isNull()
    return (
        patches.withColumn("scrape_interval", finite)
        .join(known, "id", "left")
        .withColumn(
            "outcome",
            F.when(F.char_length("detail_selector") > SELECTOR_MAX, "selector_too_long")
            .when(empty, "nothing_to_update")
            .when(F.col("_known").isNull(), "unknown_site")
            .otherwise("ok"),
        )
        .drop("_known")
    )


def patch_sites(sites: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sites after the accepted patches, patches with outcome)``."""
    judged = judge_site_patches(patches, sites)
    accepted = judged.filter("outcome = 'ok'").select(
        "id",
        "ord",
        trim_ws("detail_selector").alias("detail_selector"),
        F.col("use_stealth").cast("int").alias("use_stealth"),
        F.col("enabled").cast("int").alias("enabled"),
        F.when(
            F.col("scrape_interval").isNotNull(),
            F.greatest(F.lit(INTERVAL_MIN_S).cast("long"), F.floor("scrape_interval")),
        ).alias("scrape_interval"),
    )
    cols = ["detail_selector", "use_stealth", "enabled", "scrape_interval"]
    folded = prefixed(fold(accepted, ["id"], "ord", coalesce_cols=cols), ["id"])
    after = update_existing(sites, folded, ["id"], {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in cols})
    return after, judged


def judge_role_patches(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Role requests (acting_id, id, role, ord) with an outcome; no one may drop their own admin role."""
    known = accounts.select("id", F.lit(True).alias("_known"))
    return (
        requests.join(known, "id", "left")
        .withColumn(
            "outcome",
            F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "invalid_role")
            .when((F.col("id") == F.col("acting_id")) & (F.col("role") != "admin"), "own_demotion")
            .when(F.col("_known").isNull(), "unknown_account")
            .otherwise("ok"),
        )
        .drop("_known")
    )


def patch_roles(accounts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accounts after the accepted role requests, requests with outcome)``."""
    judged = judge_role_patches(requests, accounts)
    folded = prefixed(fold(judged.filter("outcome = 'ok'"), ["id"], "ord", coalesce_cols=["role"]), ["id"])
    return update_existing(accounts, folded, ["id"], {"role": F.col("new_role")}), judged


def patch_describe_mode(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Accounts after mode requests (id, mode, ord): anything but 'auto' means 'on-demand'."""
    mode = F.when(F.col("mode") == "auto", "auto").otherwise("on-demand")
    folded = prefixed(fold(requests.withColumn("mode", mode), ["id"], "ord", coalesce_cols=["mode"]), ["id"])
    return update_existing(accounts, folded, ["id"], {"describe_mode": F.col("new_mode")})


def patch_suggestions(suggestions: DataFrame, requests: DataFrame) -> DataFrame:
    """Suggestions after status requests (id, status, ord); unknown states are ignored."""
    allowed = requests.filter(F.col("status").isin(*SUGGESTION_STATES))
    folded = prefixed(fold(allowed, ["id"], "ord", coalesce_cols=["status"]), ["id"])
    return update_existing(suggestions, folded, ["id"], {"status": F.col("new_status")})


def judge_suggestions(requests: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Submissions (request_id, account_id, email, title, description, ord) with an outcome.

    A title must remain after trimming, and an account may have five pending
    suggestions. Only the first five titled requests of an account can get in,
    so the rank is a group limit and the rest need no ranking.
    """
    cleaned = requests.withColumns({
        "title": trim_ws(F.coalesce("title", F.lit(""))),
        "description": trim_ws(F.coalesce("description", F.lit(""))),
    })
    waiting = (
        suggestions.filter("status = 'pending'").groupBy("account_id").agg(F.count("*").alias("_pending"))
    )
    arrival = Window.partitionBy("account_id").orderBy("ord", "request_id")
    admitted = (
        cleaned.filter("title != ''")
        .select("request_id", "account_id", "ord")
        .withColumn("_rank", F.row_number().over(arrival))
        .filter(F.col("_rank") <= PENDING_MAX)
        .join(waiting, "account_id", "left")
        .filter(F.col("_rank") + F.coalesce("_pending", F.lit(0)) <= PENDING_MAX)
        .select("request_id", F.lit(True).alias("_in"))
    )
    return (
        cleaned.join(admitted, "request_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("title") == "", "title_required")
            .when(F.col("_in"), "ok")
            .otherwise("too_many_pending"),
        )
        .withColumns({
            "title": F.substring("title", 1, TITLE_CUT),
            "description": F.substring("description", 1, DESCRIPTION_CUT),
        })
        .drop("_in")
    )


def admit_suggestions(
    suggestions: DataFrame, requests: DataFrame, now_ms: int
) -> tuple[DataFrame, DataFrame]:
    """``(suggestions with the admitted ones added as pending, requests with outcome)``."""
    judged = judge_suggestions(requests, suggestions)
    fresh = judged.filter("outcome = 'ok'").select(
        "request_id", "account_id", "email", "title", "description",
        F.lit("pending").alias("status"),
        F.lit(now_ms).cast("long").alias("created_at"),
    )
    numbered = with_new_ids(fresh, suggestions, "id", ["request_id"]).drop("request_id")
    return suggestions.unionByName(numbered, allowMissingColumns=True), judged


def suggestion_list(suggestions: DataFrame, limit: int = 200) -> DataFrame:
    return (
        suggestions.select("id", "email", "title", "description", "status", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
    )
