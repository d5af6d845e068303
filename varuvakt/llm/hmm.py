"""Scores of texts by a hidden Markov language model and by a smoothed unigram base.

Words are counted over all training documents. The most frequent words are observations of their own; every other word
is observed as the class of its last bytes and drawn inside the class by its own count. Baum-Welch starts from the counts of all
training words with seeded noise and runs over windows of all training texts: each task adds up its expected counts, the sums over tasks re-estimate
the states. A text's first window begins with the start probabilities, every other one with the states' long-run shares, so the
move into a window (one in WINDOW) is left out of the counts. A text's score is
exact: the scaled forward recursion is carried out as products of transfer matrices, window after window, and the in-class
probabilities of its words come on top.

Counts of the most frequent words (at most DICTIONARY, of at most LONGEST bytes each) travel with the tasks; those of all others are joined.

Cases: a null or empty text is one end token. Rows without doc_id are held out. Repeated rows count and come back one by one.
Without training documents all words are unknown and the states uniform. An empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import split_long, stored, texts_of

STATES = 6
OWN = 2048  # words that are observations of their own
ENDINGS = 1024  # classes of all other words
DICTIONARY = 65_536  # words whose counts travel with the tasks, at most
LONGEST = 64  # bytes of such a word, at most
WINDOW = 64
PASSES = 4
#: Tokens whose windows are made at a time, or those of one text.
STEP_TOKENS = 1 << 20
ADDED = 0.1
#: Distinct words after which a counting task hands on what it has; words a worker remembers.
HELD, REMEMBERED = 200_000, 400_000
END = DICTIONARY + ENDINGS  # code of the end token
CLASSES = OWN + ENDINGS + 1


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in split_long(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if not held_out(doc_id):
                        counts.update(text.lower().split())
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    return texts_of(docs).mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])


class Codes(dict):
    """Word -> its place in the dictionary, or DICTIONARY plus the class of its ending."""

    def __init__(self, words: list[bytes]):
        super().__init__({word: k for k, word in enumerate(words)})
        self.first = len(self)

    def __missing__(self, word: bytes) -> int:
        code = DICTIONARY + ending(word)
        if len(self) - self.first < REMEMBERED and len(word) <= 64:
            self[word] = code
        return code


@dataclass
class Lexicon:
    """Everything of bounded size that a task needs: words by falling count, and per code its class and log10 terms."""

    words: list[bytes]
    total: int
    distinct: int
    base: np.ndarray  # of the unigram base; without log10(c + ADDED) for words outside the dictionary
    inside: np.ndarray  # of a word inside its class; likewise
    known: np.ndarray
    classes: np.ndarray
    seen: np.ndarray  # occurrences of each class in all training texts

    def codes(self) -> Codes:
        found = _CODES.get(self.total, self.distinct, self.words)
        return found


class _CodeCache:
    """The dictionary of the corpus a Python worker is busy with."""

    def __init__(self):
        self.key, self.codes = None, None

    def get(self, total: int, distinct: int, words: list[bytes]) -> Codes:
        key = (total, distinct, len(words), words[:1], words[-1:])
        if key != self.key:
            self.key, self.codes = key, Codes(words)
        return self.codes


_CODES = _CodeCache()


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` at most: counts that agree in their first eight bits come together or not at all.

    Numbers of words by those bits (some thousands) give the least count, so no task ranks the words of all others.
    """
    low = "greatest(length(bin(c)) - 8, 0)"
    sizes = counts.groupBy(F.expr(f"shiftleft(shiftright(c, {low}), {low})").alias("least")).count().collect()
    held, least = 0, None
    for at, size in sorted(map(tuple, sizes), reverse=True):
        held += size
        if held > most:
            break
        least = at
    return counts.where(F.col("c") >= F.lit(least))


def lexicon(counts: DataFrame, documents: int) -> Lexicon:
    """counts: (word, c) of all training words; documents: training documents, each with one end."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + documents, distinct + (documents > 0)
    top = sorted(frequent(counts.where(F.octet_length("word") <= LONGEST), DICTIONARY).collect(), key=lambda r: (-r[1], r[0]))
    words, c = [bytes(r[0]) for r in top], np.array([r[1] for r in top], np.float64)
    own = counts.sparkSession.createDataFrame([(w,) for w in words[:OWN]], "word binary")
    rest = counts.join(F.broadcast(own), "word", "left_anti")
    sizes = rest.groupBy(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int").alias("class")).agg(F.sum("c"), F.count("*")).collect()
    inside_total, inside_distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, n, v in sizes:
        inside_total[k], inside_distinct[k] = n, v
    denominator = np.log10(total + ADDED * (distinct + 1))
    inner = np.log10(inside_total + ADDED * (inside_distinct + 1))
    base, inside, known = np.full(END + 1, -denominator), np.zeros(END + 1), np.zeros(END + 1, bool)
    classes = np.zeros(END + 1, np.int64)
    n = len(words)
    base[:n] += np.log10(c + ADDED)
    known[:n] = True
    classes[: min(n, OWN)] = np.arange(min(n, OWN))
    ends = np.array([ending(w) for w in words[OWN:]], np.int64)
    if len(ends):
        classes[OWN:n] = OWN + ends
        inside[OWN:n] = np.log10(c[OWN:] + ADDED) - inner[ends]
    classes[DICTIONARY:END] = OWN + np.arange(ENDINGS)
    inside[DICTIONARY:END] = -inner
    classes[END] = CLASSES - 1
    base[END] += np.log10(documents + ADDED)
    known[END] = documents > 0
    seen = np.r_[np.zeros(OWN), inside_total, documents]
    seen[: min(n, OWN)] = c[:OWN]
    return Lexicon(words, int(total), int(distinct), base, inside, known, classes, seen)


@dataclass
class States:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K


def normalised(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> States:
    """Expected counts to probabilities, with a little of everything; move and emit as counted."""
    start, move, emit = start + 0.1, move + 0.1, emit + 1e-3
    return States(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def windows_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows x WINDOW classes (-1 behind the end), the sequence of each window, and its place in it."""
    sizes = np.array([-(-len(s) // WINDOW) for s in sequences])
    owner = np.repeat(np.arange(len(sequences)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(owner), WINDOW), -1, np.int64)
    flat = out.reshape(-1)
    for s, at in zip(sequences, (np.cumsum(sizes) - sizes) * WINDOW, strict=True):
        flat[at : at + len(s)] = s
    return out, owner, place


def shares(move: np.ndarray) -> np.ndarray:
    """Long-run shares of the states."""
    return np.linalg.matrix_power(move, 1 << 20).mean(0)


def expected_counts(windows: np.ndarray, first: np.ndarray, states: States) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One E step of Baum-Welch over windows, of which ``first`` begin a text."""
    k = len(states.start)
    n, length = windows.shape
    here = np.ascontiguousarray(windows.T >= 0)
    # Single precision: every step is scaled, and sums over windows are kept in double.
    forth = states.move.astype(np.float32)
    emit = states.emit.astype(np.float32)[np.maximum(windows.T, 0)]
    emit[~here] = 1
    whole = here.all(1)
    alpha, scale = np.empty((length, n, k), np.float32), np.empty((length, n, 1), np.float32)
    now = np.where(first[:, None], states.start, shares(states.move)).astype(np.float32) * emit[0]
    for t in range(length):
        if t:
            moved = (now @ forth) * emit[t]
            now = moved if whole[t] else np.where(here[t, :, None], moved, now)
        scale[t] = now.sum(1, keepdims=True)
        now /= scale[t]
        alpha[t] = now
    beta, move, back = np.ones((n, k), np.float32), np.zeros((k, k)), np.ascontiguousarray(forth.T)
    gamma = np.empty((length, n, k), np.float32)
    for t in range(length - 1, -1, -1):
        np.multiply(alpha[t], beta, out=gamma[t])
        if t:
            ahead = emit[t] * beta / scale[t]
            if whole[t]:
                move += alpha[t - 1].T @ ahead
                beta = ahead @ back
            else:
                live = here[t, :, None]
                move += (alpha[t - 1] * live).T @ ahead
                beta = np.where(live, ahead @ back, beta)
    move *= states.move
    seen, weights = windows.T[here], gamma[here]
    emitted = np.stack([np.bincount(seen, weights[:, j], CLASSES) for j in range(k)], 1)
    return gamma[0][first].sum(0, dtype=np.float64), move, emitted


def log_likelihoods(sequences: list[np.ndarray], states: States) -> np.ndarray:
    """log10 probability of each sequence, exactly, by scaled transfer matrices of its windows."""
    k = len(states.start)
    windows, owner, place = windows_of(sequences)
    product = np.broadcast_to(np.eye(k), (len(windows), k, k)).copy()
    logs = np.zeros(len(windows))
    for t in range(WINDOW):
        here = windows[:, t] >= 0
        if not here.any():
            break
        moved = product @ states.move
        if t == 0:
            moved[place == 0] = product[place == 0]  # the start has its own probabilities
        moved *= states.emit[np.maximum(windows[:, t], 0)][:, None, :]
        product = np.where(here[:, None, None], moved, product)
        if t % 4 == 3 or t == WINDOW - 1:
            top = product.max((1, 2))
            product /= top[:, None, None]
            logs += np.log10(top)
    top = product.max((1, 2))
    product, logs = product / top[:, None, None], logs + np.log10(top)
    state, result = np.tile(states.start, (len(sequences), 1)), np.zeros(len(sequences))
    order = np.argsort(place, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
        who = owner[at]
        now = np.einsum("nk,nkj->nj", state[who], product[at])
        total = now.sum(1)
        state[who] = now / total[:, None]
        result[who] += np.log10(total) + logs[at]
    return result


def sequence(codes: Codes, words: list[bytes]) -> np.ndarray:
    return np.fromiter((*map(codes.__getitem__, words), END), np.int64, len(words) + 1)


def starting_states(known: Lexicon, states: int) -> States:
    """Every state emits the classes as often as all training texts hold them, but for seeded noise; states tend to stay."""
    rng = np.random.default_rng(11)
    emit = (known.seen + 0.05)[:, None] * rng.lognormal(0, 1, (CLASSES, states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    return normalised(np.ones(states), move * 1e3, emit)


def coded(docs: DataFrame, known: Lexicon) -> DataFrame:
    """seq: the classes of each training document's tokens, which all passes read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, small = known.codes(), known.classes.astype(np.int16)
        for batch in batches:
            for part in split_long(batch):
                pairs = zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)
                sequences = [small[sequence(codes, text.lower().split())] for doc_id, text in pairs if not held_out(doc_id)]
                ends = np.cumsum([0, *map(len, sequences)]).astype(np.int32)
                flat = np.concatenate(sequences) if sequences else np.empty(0, np.int16)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["seq"])

    return texts_of(docs).mapInArrow(work, "seq array<smallint>")


def baum_welch_pass(rows: DataFrame, model: States) -> States:
    """One pass over the sequences of all training documents; expected counts are added up by slot."""
    k = len(model.start)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = 0
            while at < len(lists):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_TOKENS, side="right")) - 1)
                windows, _, place = windows_of([flat[a:b] for a, b in zip(ends[at:upto], ends[at + 1 : upto + 1], strict=True)])
                for first in range(0, len(windows), 4096):
                    some = slice(first, first + 4096)
                    for total, more in zip((start, move, emit), expected_counts(windows[some], place[some] == 0, model), strict=True):
                        total += more
                at = upto
        sums = np.concatenate([start, move.ravel(), emit.ravel()])
        slots = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(sums[slots])], names=["slot", "n"])

    sums = rows.mapInArrow(work, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(k + k * k + CLASSES * k)
    flat[sums["slot"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return normalised(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(CLASSES, k))


def score(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = texts_of(docs)
    counts = stored(count_words(docs), "word-counts")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    training = texts.where(F.col("doc_id").isNotNull() & (remainder != 0))
    documents = training.select("doc_id").count()
    known = lexicon(counts, documents)
    model = starting_states(known, states)
    rows = stored(coded(docs, known), "sequences")
    for _ in range(passes if documents else 0):
        model = baum_welch_pass(rows, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = known.codes()
        for batch in batches:
            for part in split_long(batch):
                sequences, rare_words, rare_counts, rare_sizes = [], [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    words = text.lower().split()
                    coded = sequence(codes, words)
                    sequences.append(coded)
                    rare = Counter([words[i] for i in np.flatnonzero(coded[:-1] >= DICTIONARY).tolist()])
                    rare_words.extend(rare)
                    rare_counts.extend(rare.values())
                    rare_sizes.append(len(rare))
                sums = np.array([[len(s), known.known[s].sum(), known.base[s].sum(), known.inside[s].sum()] for s in sequences])
                likelihood = log_likelihoods([known.classes[s] for s in sequences], model)
                offsets = pa.array(np.r_[0, np.cumsum(rare_sizes)].astype(np.int32))
                columns = [
                    part.column(2), part.column(0), pa.array([held_out(d) for d in part.column(0).to_pylist()]),
                    pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2]), pa.array(likelihood + sums[:, 3]),
                    pa.ListArray.from_arrays(offsets, pa.array(rare_words, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(rare_counts, pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "words", "times"])

    fields = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, words array<binary>, times array<int>"
    scored = stored(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(work, fields), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    added = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + ADDED)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("words", "times").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log).alias("base_score"), (F.col("own") + rare_log).alias("score"),
    )
