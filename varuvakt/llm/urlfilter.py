"""URL verdicts: fixed rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs. A URL whose host holds a listed word is labelled "block", any
other that no rule blocks "allow"; rules that block are policy and say nothing about a URL's look, so what they
block is left out. The words label, but are no feature. Features: lengths, path
depth, digit ratio, character entropy, parameter and separator counts, labels of the host, and statistics
of the host's suffix (its share among all pages and its smoothed block rate among the other labelled URLs).

Cases: a null URL or one without "://" has empty host and path, and no rule fits.
Without labelled URLs of both verdicts there is no model: all others get the only verdict seen, or
"allow". Repeated rows come back one by one, empty tables give no rows, other columns
are left behind.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import ascii_lower, smallest, stored

#: Fixed rules: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Fixed words: parts of host names that label a URL as unwanted.
WORDS = ("adult", "porn", "xxx", "casino", "poker", "bets", "betting", "pills", "viagra", "spam", "ads", "adserver", "malware", "phish", "warez")
#: Distinct labelled URLs of each label that the trees learn from, at most, by smallest hash.
SAMPLE = 5_000
TREES, DEPTH, STEP = 20, 4, 0.2
#: Weight of the mean block rate in a suffix's rate.
SMOOTHING = 20.0
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#&=%+:@"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*[F.when(fits(host, path, r), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))) for r in longest])


def label_of(host: Column, ruled: Column) -> Column:
    """1.0 to block, 0.0 to allow, null for what a rule blocks."""
    listed = F.regexp_like(host, F.lit(rf"(^|[.-])({'|'.join(WORDS)})([.-]|$)"))
    return F.when(listed, 1.0).when(ruled.isNull() | (ruled["verdict"] == "allow"), 0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))
    lower = ascii_lower(url)
    counts = F.transform(F.array(*map(F.lit, COUNTED)), lambda c: (F.length(lower) - F.length(F.replace(lower, c, F.lit("")))).cast("double"))
    rest = n - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    entropy = F.log2(n) - F.aggregate(F.array_append(counts, rest), F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n

    def count(text: Column, sign: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("double")

    return {
        "x_length": n, "x_host_length": F.length(host).cast("double"), "x_path_length": F.length(path).cast("double"),
        "x_depth": count(path, "/"), "x_digit_ratio": digits / n, "x_entropy": entropy,
        "x_parameters": count(url, "=") , "x_joined": count(url, "&") + count(url, "?"), "x_labels": count(host, "."),
        "x_dashes": count(url, "-"), "x_escapes": count(url, "%"), "x_fragment": F.contains(url, F.lit("#")).cast("double"),
        "x_secure": url.startswith("https").cast("double"), "x_file": F.regexp_like(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
        "x_first_step": F.length(F.regexp_extract(path, "^/([^/]*)", 1)).cast("double"),
    }


def described(rows: DataFrame, rules) -> DataFrame:
    """rows with host, path, suffix, ruled and label of their url."""
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -2)).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    return rows.withColumn("label", label_of(F.col("host"), F.col("ruled")))


def verdicts(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability (null where a rule decides)."""
    url = F.coalesce("url", F.lit(""))
    rows = described(pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")), rules)
    labelled = rows.where("label IS NOT NULL").select("label", "url").distinct()
    # One row per suffix; the mean and the number of rows go with it. Labels count once per URL.
    each = rows.groupBy("suffix", "url").agg(F.count("*").cast("double").alias("seen"), F.max("label").alias("label"))
    suffixes = each.groupBy("suffix").agg(F.sum("seen").alias("seen"), F.count("label").cast("double").alias("labelled"), F.sum("label").alias("blocked"))
    suffixes = stored(suffixes.withColumn("blocked", F.coalesce("blocked", F.lit(0.0))), "url-suffixes")
    total = suffixes.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("seen", "labelled", "blocked")]).first()
    mean = total[2] / total[1] if total[1] else 0.0
    known = suffixes.select("suffix", (F.col("seen") / max(total[0], 1.0)).alias("x_suffix_share"), "labelled", "blocked")
    # A labelled URL's own label is left out of its suffix's rate, in learning and in scoring.
    others = F.col("labelled") - F.col("label").isNotNull().cast("double")
    rate = (F.col("blocked") - F.coalesce("label", F.lit(0.0)) + SMOOTHING * mean) / (others + SMOOTHING)

    def featured(rows: DataFrame) -> DataFrame:
        joined = rows.join(known, "suffix", "left").withColumn("x_suffix_rate", rate).drop("labelled", "blocked")
        return joined.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))

    rows = featured(rows)
    columns = [c for c in rows.columns if c.startswith("x_")]
    if not 0 < total[2] < total[1]:
        only = "block" if total[1] and total[2] else "allow"
        return rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    # Each label weighs as much as all its distinct URLs, so that the cut is alike at every size.
    distinct = stored(labelled, "url-labelled")
    sizes = dict(map(tuple, distinct.groupBy("label").count().collect()))
    picked = smallest(distinct, "url", sample, "label").select("url")
    weight = F.coalesce(*[F.when(F.col("label") == label, n / min(n, sample)) for label, n in sorted(sizes.items())])
    learnt = stored(featured(described(picked, rules)).select("label", weight.alias("weight"), *columns), "url-sample")
    gather = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, checkpointInterval=-1, weightCol="weight")
    model = trees.fit(gather.transform(learnt).select("label", "weight", "features"))
    scored = model.transform(gather.transform(rows)).withColumn("block_probability", vector_to_array("probability")[1])
    judged = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", judged).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("block_probability")).alias("block_probability"),
    )
