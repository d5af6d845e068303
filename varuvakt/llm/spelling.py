"""Spelling variants: words that differ in one code point, found by walking a relational trie level by level.

The trie of all words is a table: one row a node with the letters of its edges, written by depth. A node is named by a rolling hash of
its letters, so the end of an edge needs no look-up. A state (word, position, node, edits) stands for all words below a prefix at a time: it holds the
prefix, whose depth is the position, and the node that one edit leads to. States without an edit are the trie's own nodes; from
them every level starts a replaced letter (two edges of a node, in order) and an inserted one (a node and its child, which may not go on
with the inserted letter, so a run of letters is entered once). All states of a level are then joined with the nodes of both sides and
move along the letters that both have. Where words end on both sides they are neighbours. A node
keeps 128 bits of hashes of the word ends below it; sides without a common bit share no end, and their state is dropped.

Words of over DEEPEST code points would need a level each; these few are paired by the hashes of all their
one-deletion forms instead, which is linear in their letters. Every pair found is checked by its edit distance.

At scale: counts are combined before the shuffle, states are rows of three numbers, and no group is larger than the alphabet (90 letters) times a word's length.

Cases: null and empty texts have no words; without doc_id the hash is that of ``:`` and the run. Repeated rows count each; ties of n go to the
smaller word in code-point order. A table without words gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import ascii_lower, stored
from varuvakt.session import shared_dir

#: Runs of letters; × and ÷ lie in the range and count as letters.
LETTERS = "[A-Za-zÀ-ÿ]"
ALTERED_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form has at least so many times the word's occurrences.
OUTWEIGHS = 2
DEEPEST = 32
MASKS = ("m0", "m1")


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters, one in ALTERED_EVERY with a code point left out, with their occurrences."""
    # Runs only get shorter, so shorter ones need not be made.
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    lowered = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), ascii_lower(F.col("run"))).otherwise(F.col("run")))
    hashed = lowered.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % ALTERED_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def step(node: Column, letter: Column) -> Column:
    return F.xxhash64(node, letter)


def chain(word: Column) -> Column:
    """Names of the nodes of all prefixes, the empty one first."""
    grow = lambda ids, i: F.concat(ids, F.array(step(F.element_at(ids, -1), F.substring(word, i, F.lit(1)))))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), F.array(F.lit(0).cast("long")), grow)


def trie(short: DataFrame) -> DataFrame:
    """depth, node, letters (of its edges), last (whether a word ends here), and MASKS: bits of the word ends below."""
    placed = short.select("word", F.posexplode(chain(F.col("word"))).alias("depth", "node"))
    rest = F.substring(F.col("word"), F.col("depth") + 1, F.char_length("word"))
    cut = placed.select("depth", "node", F.substring(rest, 1, 1).alias("letter"), F.pmod(F.xxhash64(rest), F.lit(64 * len(MASKS))).cast("int").alias("bit"))
    bits = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(m) for k, m in enumerate(MASKS)]
    return cut.groupBy("depth", "node").agg(F.array_join(F.sort_array(F.collect_set("letter")), "").alias("letters"), F.max(F.col("letter") == "").alias("last"), *bits)


def listed(letters: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(letters)), lambda i: F.substring(letters, i, F.lit(1)))


def begun(nodes: DataFrame, depth: int) -> DataFrame:
    """New states of a depth: (a, b, barred) with one edit."""
    edges = lambda d: nodes.where((F.col("depth") == d) & (F.col("letters") != "")).select("node", listed(F.col("letters")).alias("edge"))
    one = edges(depth).select("node", F.explode("edge").alias("x"))
    inserted = one.select(F.col("node").alias("a"), step(F.col("node"), F.col("x")).alias("b"), F.col("x").alias("barred"))
    if not depth:
        return inserted
    two = edges(depth - 1).select("node", F.explode("edge").alias("x"), "edge").select("node", "x", F.explode(F.filter("edge", lambda y: y > F.col("x"))).alias("y"))
    return inserted.union(two.select(step(F.col("node"), F.col("x")), step(F.col("node"), F.col("y")), F.lit(None).cast("string")))


def moved(states: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """States one level on, and with ``found`` the pairs of nodes where words end on both sides."""
    side = lambda rows, own: rows.select(F.col("node").alias(own), *[F.col(c).alias(f"{own}_{c}") for c in ("letters", "last", *MASKS)])
    met = states.join(side(nodes.where(F.col("depth") == depth), "a"), "a").join(side(nodes.where(F.col("depth").isin(depth, depth + 1)), "b"), "b")
    common = reduce(lambda x, y: x | y, [F.col(f"a_{m}").bitwiseAND(F.col(f"b_{m}")) != 0 for m in MASKS])
    both = F.filter(listed(F.col("a_letters")), lambda c: F.col("b_letters").contains(c) & ~c.eqNullSafe(F.col("barred")))
    both = F.when(F.col("a_letters") != "", both).otherwise(F.array().cast("array<string>"))
    on = F.transform(both, lambda c: F.struct(step(F.col("a"), c).alias("a"), step(F.col("b"), c).alias("b"), F.lit(False).alias("found")))
    here = F.filter(F.array(F.struct("a", "b", (F.col("a_last") & F.col("b_last")).alias("found"))), lambda x: x["found"])
    return met.where(common).select(F.explode(F.concat(on, here)).alias("s")).select("s.*")


def trie_pairs(short: DataFrame) -> DataFrame:
    """Pairs (word, other) of words of at most DEEPEST code points, each in one order."""
    spark, folder = short.sparkSession, shared_dir(short.sparkSession, "trie")
    made = trie(short)
    made.write.partitionBy("depth").parquet(folder)
    deepest = short.agg(F.max(F.char_length("word"))).first()[0]
    if deepest is None:
        return short.select("word", F.col("word").alias("other"))
    nodes = spark.read.schema(made.schema).parquet(folder)
    states, found = None, []
    for depth in range(deepest + 1):
        new = begun(nodes, depth)
        if states is not None:
            new = new.union(states.select("a", "b", F.lit(None).cast("string")))
        level = stored(moved(new, nodes, depth), f"trie-level-{depth}")
        found.append(level.where("found").select("a", "b"))
        states = level.where("NOT found")
    ends = stored(short.select(F.element_at(chain(F.col("word")), -1).alias("node"), "word"), "trie-ends")
    pairs = reduce(DataFrame.union, found)
    a, b = ends.select(F.col("node").alias("a"), "word"), ends.select(F.col("node").alias("b"), F.col("word").alias("other"))
    return pairs.join(a, "a").join(b, "b").select("word", "other")


PRIME = (1 << 61) - 1
BASE = 1_099_511_628_211


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, word -> id, size, at, h: the hash of the word (at = -1) and of each of its one-deletion forms."""
    for batch in batches:
        for name, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, before, power = [ord(c) + 1 for c in word], [0], [1]
            for c in codes:
                before.append((before[-1] * BASE + c) % PRIME)
                power.append(power[-1] * BASE % PRIME)
            size, after, out = len(codes), 0, [(-1, before[-1])]
            for at in range(size - 1, -1, -1):
                out.append((at, (before[at] * power[size - 1 - at] + after) % PRIME))
                after = (after + codes[at] * power[size - 1 - at]) % PRIME
            columns = [pa.array([name] * len(out), pa.int64()), pa.array([size] * len(out), pa.int64()), pa.array([x for x, _ in out], pa.int64()), pa.array([h for _, h in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "at", "h"])


def long_pairs(long: DataFrame) -> DataFrame:
    """Pairs (word, other) of which the longer has over DEEPEST code points, each in one order; ``long``: words of DEEPEST or more."""
    named = stored(long.select(F.xxhash64("word").alias("id"), "word"), "long-words")
    forms = stored(named.mapInArrow(shortened, "id long, size long, at long, h long"), "long-forms")
    x, y = forms.where("at >= 0").alias("x"), forms.alias("y")
    replaced = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    inserted = x.join(y.where("at = -1"), (F.col("x.h") == F.col("y.h")) & (F.col("x.size") == F.col("y.size") + 1))
    pairs = replaced.select("x.id", F.col("y.id").alias("with")).union(inserted.select("x.id", "y.id")).distinct()
    other = named.select(F.col("id").alias("with"), F.col("word").alias("other"))
    return pairs.join(named, "id").join(other, "with").select("word", "other").where(F.greatest(F.char_length("word"), F.char_length("other")) > DEEPEST)


def near(counted: DataFrame) -> DataFrame:
    """word, other: all words one inserted, deleted or replaced code point away, in both orders."""
    size = F.char_length("word")
    pairs = trie_pairs(counted.where(size <= DEEPEST)).union(long_pairs(counted.where(size >= DEEPEST)))
    # Names of nodes are hashes: what two equal ones may have brought in goes here.
    sure = stored(pairs.where(F.levenshtein("word", "other", 1) == 1).distinct(), "spelling-pairs")
    return sure.union(sure.select("other", "word"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, by joins that double the way each time."""
    ways = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-ways")
    while ways.where("open").limit(1).count():
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = ways.join(on, "root", "left")
        ways = stored(far.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-ways")
    return ways.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    counted = stored(words(docs), "spelling-words")
    rated = near(counted).join(counted.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    grouped = rated.groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.less") >= OUTWEIGHS * F.col("n")
    joined = counted.join(grouped, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    joined = stored(joined, "spelling-forms")
    roots = followed(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
