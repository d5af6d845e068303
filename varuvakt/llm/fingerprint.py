"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs.

A document's fingerprint is the sum of its paragraphs' vectors, so it does not depend on their order, and paragraphs can be
added or taken away without the rest. Two vectors are summed: eight lanes of hashes of the whole paragraph
modulo 2^32, which tell whether two documents have the same paragraphs, and 64 lanes of signed counts of
the paragraph's word pairs modulo 2^16, whose cosine is the likeness of two documents.

Only Column expressions and joins. Documents are dealt to buckets of consecutive ids; the text
after a bucket's last one comes as a guest from the next bucket, so texts are shuffled once. An edited
document is fingerprinted from the parts: the paragraphs before the cut count for both.

Cases: a null text is an empty one, whose only paragraph is empty. Rows without doc_id take no part. Rows with the same doc_id are ordered
by their texts and come back one by one. A single document is its own next. An empty table gives no rows; other columns are left behind.
A pair that occurs over 32,767 times more with one sign than the other wraps its lane; equality is not touched by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.llm.common import stored, texts_of
from varuvakt.llm.spans import bound

#: Consecutive ids of a bucket.
BUCKET = 512
#: Words of signed counters; each holds two lanes of 32 bits while it is summed.
COUNTERS = 32
SEEDS = (11, 23, 37, 53)
LOW = 0xFFFFFFFF


def successors(tops: DataFrame, width: int = 1024) -> DataFrame:
    """(bucket) of distinct longs -> (bucket, next): the next lower one, null for the lowest. No window holds more than ``width`` rows."""
    level = tops.select("bucket").withColumn("over", F.floor(F.col("bucket") / width))
    within = level.withColumn("next", F.lead("bucket").over(Window.partitionBy("over").orderBy(F.desc("bucket"))))
    uppers = level.groupBy("over").agg(F.max("bucket").alias("top"))
    uppers = stored(uppers, "fingerprint-buckets")
    if uppers.limit(width + 1).count() > width:
        above = successors(uppers.select(F.col("over").alias("bucket")), width).select(F.col("bucket").alias("over"), F.col("next").alias("next_over"))
    else:
        above = uppers.select("over", F.lead("over").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("over"))).alias("next_over"))
    first = above.join(uppers.select(F.col("over").alias("next_over"), "top"), "next_over").select("over", "top")
    return within.join(first, "over", "left").select("bucket", F.coalesce("next", "top").alias("next"))


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strict_lanes(parts: Column) -> list[Column]:
    """Sums of the paragraphs' hashes, one for each half of each seed's hash, modulo 2^32."""

    def total(seed: int, high: bool) -> Column:
        def half(p: Column) -> Column:
            h = F.xxhash64(F.lit(seed), p)
            return F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(LOW))

        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: (acc + half(p)).bitwiseAND(F.lit(LOW)))

    return [total(seed, high) for seed in SEEDS for high in (False, True)]


def pair_hashes(parts: Column, part: int) -> Column:
    """struct(h, part) for each pair of neighbouring words of each paragraph; the first word also alone."""

    def of(paragraph: Column) -> Column:
        split = F.filter(F.split(paragraph, "[ \\t\\r\\f\\x0B]+", -1), lambda w: w != "")
        return bound(split, lambda words: F.zip_with(F.concat(F.array(F.lit(None).cast("string")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))), words, pair))

    def pair(before: Column, word: Column) -> Column:
        return F.struct(F.xxhash64(before, word).alias("h"), F.lit(part).alias("part"), F.lit(1).alias("unit"))

    return F.flatten(F.transform(parts, of))


def inserted(fingerprint: Column, parts: Column) -> Column:
    """The fingerprint after the paragraphs of ``parts`` (array of strings, in any order, repeats counted) have been added.

    The text is not needed. Null parts or an empty array change nothing; a null fingerprint stays null. Each word pair of
    ``parts`` is looked at once a lane, so this is for edits, not for whole corpora.
    """
    return _moved(fingerprint, parts, 1)


def deleted(fingerprint: Column, parts: Column) -> Column:
    """The fingerprint after the paragraphs of ``parts`` have been taken away: the inverse of ``inserted``.

    Whether the text holds them is not known here: taking away others gives the fingerprint that adding them leads back from.
    """
    return _moved(fingerprint, parts, -1)


def _moved(fingerprint: Column, parts: Column, sign: int) -> Column:
    def number(start: int, digits: int) -> Column:
        return F.conv(F.substring(fingerprint, start + 1, digits), 16, 10).cast("long")

    given = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p.isNotNull())
    width = 8 * 2 * len(SEEDS)
    strict = [
        F.lpad(F.hex((number(8 * k, 8) + sign * lane).bitwiseAND(F.lit(LOW))), 8, "0") for k, lane in enumerate(strict_lanes(given))
    ]

    def counted(pairs: Column) -> Column:
        def of(lane: Column) -> Column:
            here = F.filter(pairs, lambda e: e["h"].bitwiseAND(F.lit(63)) == lane)
            return F.aggregate(here, F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["h"] < 0, -1).otherwise(1))

        return F.transform(F.sequence(F.lit(0), F.lit(2 * COUNTERS - 1)), of)

    def lanes(moves: Column) -> Column:
        sums = [(number(width + 4 * lane, 4) + sign * F.get(moves, F.lit(lane))).bitwiseAND(F.lit(0xFFFF)) for lane in range(2 * COUNTERS)]
        return F.concat(*[F.lpad(F.hex(v), 4, "0") for v in sums])

    counts = bound(bound(pair_hashes(given, 0), counted), lanes)
    return F.lower(F.concat(*strict, counts))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = texts_of(docs).where("doc_id IS NOT NULL").withColumn("bucket", F.floor(F.col("doc_id") / BUCKET))
    tops = stored(texts.groupBy("bucket").agg(F.max("doc_id").alias("top")), "fingerprint-tops")
    following = successors(tops)
    highest = tops.agg(F.max("bucket").alias("highest"))
    # After the last document comes the first.
    following = following.crossJoin(F.broadcast(highest)).select("bucket", F.coalesce("next", "highest").alias("next"))
    wanted = following.join(tops.withColumnRenamed("bucket", "next"), "next").select(F.col("bucket").alias("for_bucket"), "top")
    wanted = stored(wanted, "fingerprint-guests")
    guests = texts.join(wanted, F.col("doc_id") == F.col("top")).groupBy("for_bucket", "doc_id").agg(F.min("text").alias("text"))
    both = texts.select("bucket", "doc_id", "text", F.lit(0).alias("guest")).union(guests.select("for_bucket", "doc_id", "text", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), "text")
    rows = both.repartition("bucket").withColumn("following", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("place", F.row_number().over(order))

    n = F.length("text")
    cut = n - F.floor(n / 3).cast("int")
    # What lies before the last line end ahead of the cut is common; "rest" follows in the text, "turned" in the edited text.
    ahead = F.substring(F.col("text"), F.lit(1), F.col("cut"))
    rows = rows.withColumns({"n_chars": n.cast("long"), "cut": cut})
    rows = rows.withColumn("common_chars", F.col("cut") - F.length(F.substring_index(ahead, "\n", -1)))
    tail = F.substring(F.col("following"), F.lit(1), n - F.col("cut"))
    rows = rows.withColumns(
        {
            "edited_sha": F.unhex(F.sha2(F.concat(ahead, tail).cast("binary"), 256)),
            "common": F.substring(F.col("text"), F.lit(1), F.greatest(F.col("common_chars") - 1, F.lit(0))),
            "rest": F.substring(F.col("text"), F.col("common_chars") + 1, n),
            "turned": F.concat(F.substring(F.col("text"), F.col("common_chars") + 1, F.col("cut") - F.col("common_chars")), tail),
        }
    )
    parts = [F.when(F.col("common_chars") > 0, paragraphs(F.col("common"))).otherwise(F.array().cast("array<string>")).alias("common")]
    parts += [paragraphs(F.col(c)).alias(c) for c in ("rest", "turned")]
    rows = rows.select("bucket", "place", "guest", "doc_id", "n_chars", "edited_sha", *parts)
    common = strict_lanes(F.col("common"))

    def strict(other: str) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex((c + o).bitwiseAND(F.lit(LOW))), 8, "0") for c, o in zip(common, strict_lanes(F.col(other)), strict=True)]))

    # Every text also gets an entry of no amount for each counter of each part, so that all counters are there.
    blank = F.transform(F.sequence(F.lit(0), F.lit(3 * COUNTERS - 1)), lambda s: F.struct((s % COUNTERS * 2).cast("long").alias("h"), (s / COUNTERS).cast("int").alias("part"), F.lit(0).alias("unit")))
    pairs = F.concat(pair_hashes(F.col("common"), 0), pair_hashes(F.col("rest"), 1), pair_hashes(F.col("turned"), 2), blank)
    kept = ["bucket", "place", "guest", "doc_id", "n_chars", "carried"]
    # In steps, so that what is carried is computed before the entries are laid out.
    keyed = rows.select(*kept[:-1], F.concat("edited_sha", strict("rest"), strict("turned")).alias("carried"), pairs.alias("pairs"))
    keyed = keyed.select(*kept, F.explode("pairs").alias("e"))
    lane = F.col("e.h").bitwiseAND(F.lit(63))
    amount = F.when(F.col("e.h") < 0, -F.col("e.unit")).otherwise(F.col("e.unit")).cast("long") * F.when(lane.bitwiseAND(F.lit(1)) == 1, F.lit(1 << 32)).otherwise(F.lit(1))
    entries = keyed.select(*kept, (F.col("e.part") * COUNTERS + F.shiftright(lane, 1).cast("int")).alias("slot"), amount.alias("amount"))
    # Both groupings stay in the bucket's partition.
    counters = entries.groupBy(*kept, "slot").agg(F.sum("amount").alias("amount"))
    summed = counters.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("slot", "amount"))).alias("counters"))

    def total(part: int) -> Column:
        """Counters of the common part and of one other."""
        return F.zip_with(F.slice("counters", 1, COUNTERS), F.slice("counters", part * COUNTERS + 1, COUNTERS), lambda x, y: x["amount"] + y["amount"])

    def wrapped(v: Column) -> Column:
        return F.shiftright(F.shiftleft(v, 48), 48)

    def lanes(packed: Column) -> Column:
        def low(v: Column) -> Column:
            return F.shiftright(F.shiftleft(v, 32), 32)

        return F.flatten(F.transform(packed, lambda v: F.array(wrapped(low(v)), wrapped(F.shiftright(v - low(v), 32)))))

    vectors = summed.select(*kept, lanes(total(1)).alias("own"), lanes(total(2)).alias("edited"))
    after = Window.partitionBy("bucket").orderBy("place")
    carried = {"strict": F.substring("carried", 33, 32), "edited_strict": F.substring("carried", 65, 32)}
    vectors = vectors.withColumns(carried).withColumns({"next": F.lead("own").over(after), "next_strict": F.lead("strict").over(after)}).where("guest = 0")

    def written(strict_part: str, counts: str) -> Column:
        signs = F.transform(counts, lambda c: F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFF))), 4, "0"))
        return F.lower(F.concat(F.hex(strict_part), F.array_join(signs, "")))

    return vectors.select(
        "doc_id", "n_chars", F.lower(F.hex(F.substring("carried", 1, 32))).alias("edited_sha256"),
        written("strict", "own").alias("fingerprint"), written("edited_strict", "edited").alias("edited_fingerprint"),
        likeness("own", "edited", F.col("strict") == F.col("edited_strict")).alias("near_edited"),
        likeness("own", "next", F.col("strict") == F.col("next_strict")).alias("near_next"),
    )


def likeness(a: str, b: str, same: Column) -> Column:
    """Cosine of two vectors of counts, not below zero; one for equal fingerprints."""

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(same & (F.col(a) == F.col(b)), F.lit(1.0)).when(size > 0, F.least(F.greatest(dot(a, b) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
