"""Quality of documents from a weak-label model and a hashed linear scorer.

Heuristic labellers vote bad, good or nothing on each text; most know one defect only and stay silent otherwise. How often each pattern of votes occurs is counted over all
documents; expectation-maximisation on those counts estimates the labellers' accuracies and
the share of good documents, and so gives each pattern a posterior.
The posteriors are the labels of a logistic scorer on hashed words and signs, which decides. Where only silent texts are good, they are
its good side; where one side has no texts with a doc_id, there is no scorer and the posteriors are the scores.

Counts and posteriors cover all documents. The scorer learns from at most SAMPLE different rows (doc_id and text) of each side, those
with the smallest hash; whole texts are read everywhere.

Cases: null and empty texts get no vote and no features, hence the scorer's bias, which is held at "keep".
A corpus where no pattern is bad is kept as a whole. Repeated rows and rows without doc_id come
back one by one; an empty table gives no rows; other columns are left behind by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import sliced, smallest, split_long, stored, texts_of

LABELLERS = ("shouting", "signs", "repeats", "marked_words", "columns", "sentences", "word_length", "letters")
GOOD, BAD, NONE = 2, 1, 0
ROUNDS = 200
#: Share of good documents that a labeller may call bad, at most.
MOST_FALSE = 0.02
SAMPLE = 2_000
SLOTS = 1 << 14
EPOCHS = 12
#: Shorter texts get no vote.
LEAST_WORDS = 12
#: The scorer's fixed bias towards keeping, and the number of words at which what a text's words say weighs half.
BIAS, HALF_WORDS = 1.0, 10
#: Remembered words of one Python worker.
REMEMBERED = 400_000
#: A document is rejected at a probability of being good below this.
KEEP_AT = 0.5

SENTENCE_END = re.compile(rb"[.!?]")
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + UPPER.lower() + bytes(range(0x80, 0x100))
SIGNS = b"#$%&*|!<>{}[]=~^@_\\"
MARKED = SIGNS.replace(b"!", b"")


def votes(text: bytes) -> int:
    """Votes of all labellers as a number of base 3, the first labeller in the lowest digit."""
    words = text.split()
    n = len(words)
    if n < LEAST_WORDS:
        return 0
    size = len(text) - n + 1
    upper = size - len(text.translate(None, UPPER)) + n - 1
    signs = len(text) - len(text.translate(None, SIGNS))
    letters = len(text) - len(text.translate(None, LETTERS))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(1 for w in words if w[-1] in MARKED)
    alone = sum(1 for w in words if len(w) == 1 and w[0] in SIGNS)
    ends = len(SENTENCE_END.findall(text))
    mean = size / n

    cast = (
        BAD * (upper > 0.15 * size),
        BAD * (signs > 0.03 * size),
        BAD * (repeats > 0.08 * n),
        BAD * (marked > 0.08 * n),
        BAD * (alone > 0.08 * n),
        GOOD if 0 < ends < 0.25 * n else BAD * (ends > 0.5 * n),
        BAD * (mean > 16 or mean < 2.5),
        BAD * (letters < 0.7 * size),
    )
    return sum(v * 3**k for k, v in enumerate(cast))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (rows of 0, 1, 2) with their counts -> posterior of good per pattern, share of good, accuracies.

    Bad documents are of several kinds, one for each labeller to begin with, as defects rarely come together; inside a kind,
    as among the good ones, votes are independent. table holds P(vote | kind), kind 0 being the good documents, among
    which a labeller is never taken to call more than MOST_FALSE bad.
    """
    labellers = patterns.shape[1]
    each = np.arange(labellers)
    share = np.r_[0.8, np.full(labellers, 0.2 / labellers)]
    table = np.tile(np.array([0.6, 0.2, 0.2]), (labellers, labellers + 1, 1))
    table[:, 0] = [0.49, 0.01, 0.5]
    table[each, each + 1] = [0.05, 0.9, 0.05]
    posterior = np.zeros((len(patterns), labellers + 1))
    for _ in range(rounds):
        logs = np.log(share) + sum(np.log(table[k])[:, patterns[:, k]].T for k in each)
        before, posterior = posterior, np.exp(logs - logs.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
        weight = posterior * counts[:, None]
        total = weight.sum(0)
        for v in range(3):
            table[:, :, v] = ((patterns == v).T @ weight + 0.1) / (total + 0.3)
        table[:, 0, BAD] = np.minimum(table[:, 0, BAD], MOST_FALSE)
        table /= table.sum(2, keepdims=True)
        share = (total + 1e-3) / (total + 1e-3).sum()
        if np.abs(posterior - before).max() < 1e-9:
            break
    kinds = share[1:] / max(share[1:].sum(), 1e-300)
    bad_votes = (table[:, 1:] * kinds[None, :, None]).sum(1)
    right = table[:, 0, GOOD] * share[0] + bad_votes[:, BAD] * (1 - share[0])
    cast = table[:, 0, 1:].sum(1) * share[0] + bad_votes[:, 1:].sum(1) * (1 - share[0])
    return posterior[:, 0], float(share[0]), right / np.maximum(cast, 1e-300)


def features(words: list[bytes], known: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Hashed slots of a text: each word's shape, its signs and its ends, and whether it repeats the one before."""
    slots: list[int] = []
    before = None
    for word in words:
        own = known.get(word)
        if own is None:
            if len(known) >= REMEMBERED:
                known.clear()
            shape = re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[0-9]+", b"0", word[:64])))
            parts = [b"s" + shape, b"e" + word[-2:], b"l%d" % min(len(word), 20), b"w" + word[:64].lower()]
            own = known[word[:64]] = tuple(zlib.crc32(p) % (SLOTS - 2) + 2 for p in parts)
        slots.extend(own)
        slots.append(word == before)
        before = word
    return np.array(slots, np.int32)


def counted(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their weights: roots of the shares, less for short texts."""
    ids, n = np.unique(slots, return_counts=True)
    words = len(slots) / 5
    return ids, np.sqrt(n / max(1, n.sum())) * (words / (words + HALF_WORDS))


def fit_scorer(ids: list[list[int]], values: list[list[float]], labels: list[float], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the logistic scorer by AdaGrad; both sides weigh the same."""
    data = [(np.array(i, np.int64), np.array(x, np.float64), y) for i, x, y in zip(ids, values, labels, strict=True) if i]
    weights, seen = np.zeros(SLOTS), np.full(SLOTS, 1e-3)
    order = np.random.default_rng(5)
    share = float(np.clip(np.mean([y for *_, y in data]), 0.05, 0.95)) if data else 0.5
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            own, x, y = data[k]
            slope = (1 / (1 + np.exp(-np.clip(BIAS + weights[own] @ x, -50, 50))) - y) * x * (0.5 / share if y >= 0.5 else 0.5 / (1 - share))
            seen[own] += slope * slope
            weights[own] -= 0.5 * slope / np.sqrt(seen[own])
    return weights


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id, row (see ``row_of``), pattern."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([votes(t) for t in texts], pa.int32())], names=["doc_id", "row", "pattern"])

    texts = texts_of(docs).withColumn("row", row_of(F.col("doc_id"), F.col("text")))
    return texts.mapInArrow(sliced(work), "doc_id long, row long, pattern int")


def posteriors(patterns: DataFrame) -> tuple[dict[int, float], float, np.ndarray]:
    """Posterior of good per pattern (3 ** labellers at most), share of good, accuracies."""
    rows = patterns.groupBy("pattern").count().collect()
    if not rows:
        return {}, 1.0, np.ones(len(LABELLERS))
    numbers, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    digits = numbers[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior, good, accuracy = fit_labels(digits, counts)
    return dict(zip(numbers.tolist(), posterior.tolist(), strict=True)), good, accuracy


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior (of the votes), score (the scorer's probability of good), keep."""
    rate = rater(docs, sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, scores = rate(batch.column(1))
        columns = [batch.column(0), pa.array(labels), pa.array(scores), pa.array([s >= KEEP_AT for s in scores])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "posterior", "score", "keep"])

    return texts_of(docs).mapInArrow(sliced(work), "doc_id long, posterior double, score double, keep boolean")


def row_of(doc_id: Column, text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(doc_id, text)


def rater(docs: DataFrame, sample: int) -> Callable[[pa.Array], tuple[list[float], list[float]]]:
    """Learns from ``docs``; what it gives runs where texts are and tells their posteriors and scores."""
    texts = texts_of(docs).withColumn("row", row_of(F.col("doc_id"), F.col("text")))
    voted = stored(vote_patterns(docs), "votes")
    posterior, _, _ = posteriors(voted)
    weights = None
    bad, good = ([p for p, y in posterior.items() if (y >= 0.5) == side and p] for side in (False, True))
    if not good and posterior.get(0, 0.0) >= 0.5:
        good = [0]
    if bad and good:
        sided = voted.where(F.col("pattern").isin(bad + good) & F.col("doc_id").isNotNull()).withColumn("good", F.col("pattern").isin(good))
        picked = stored(smallest(sided.distinct(), "row", sample, "good"), "quality-sample")
        weights = _trained(texts, picked, posterior)
    trained = weights is not None
    worker_weights = weights.astype(np.float32) if trained else np.zeros(SLOTS, np.float32)
    table = np.full(3 ** len(LABELLERS), np.nan)
    table[list(posterior)] = list(posterior.values())

    def rate(own: pa.Array) -> tuple[list[float], list[float]]:
        scores, labels = [], []
        for text in own.cast(pa.binary()).to_pylist():
            ids, x = counted(features(text.split(), KNOWN))
            labels.append(float(table[votes(text)]))
            if trained or not len(ids):
                scores.append(float(1 / (1 + np.exp(-np.clip(BIAS + worker_weights[ids] @ x, -50, 50)))))
            else:
                scores.append(labels[-1])
        return labels, scores

    return rate


#: Slots of words a worker has met.
KNOWN: dict[bytes, tuple[int, ...]] = {}


def _trained(texts: DataFrame, picked: DataFrame, posterior: dict[int, float]) -> np.ndarray | None:
    """Slots of the sampled documents, made where the texts are; the bounded sample of slots comes to the driver. None if one side has none."""
    wanted = F.broadcast(picked.select(F.col("row").alias("__row"), "pattern"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, weights = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            i, x = counted(features(text.split(), KNOWN))
            ids.append(i.tolist())
            weights.append(x.astype(np.float32).tolist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["doc_id", "pattern", "ids", "x"]
        )

    # Copies of a sampled row are one, so what comes to the driver is the sample.
    rows = texts.join(wanted, F.col("row") == F.col("__row")).dropDuplicates(["row"]).select("doc_id", "text", "pattern")
    data = rows.mapInArrow(sliced(work), "doc_id long, pattern int, ids array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("pattern", "ascending")])
    labels = [posterior[p] for p in data.column("pattern").to_pylist()]
    if len({y >= 0.5 for y in labels}) < 2:
        return None
    return fit_scorer(data.column("ids").to_pylist(), data.column("x").to_pylist(), labels)


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that the scorer keeps, each by its own text, also where rows share a doc_id. Rows without doc_id stay.

    Texts are judged where they are read; no row is shuffled for the verdict, however many are rejected.
    """
    rate = rater(docs, sample)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        pieces = split_long(pa.RecordBatch.from_arrays([text], names=["text"]))
        return pa.array([s >= KEEP_AT for piece in pieces for s in rate(piece.column(0))[1]], pa.bool_())

    return docs.where(F.col("doc_id").cast("long").isNull() | good(F.coalesce("text", F.lit(""))))
