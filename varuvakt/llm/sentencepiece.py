"""SentencePiece encoding and decoding of texts by a shared-prefix Viterbi pass.

A text is cut into marked words (blanks become marks), and a word between letters that no piece holds side by side. The distinct segments of a
batch are sorted, which lays them out as a depth-first walk of their trie: a word
keeps the forward scores of the prefix it shares with the one before and
computes only the rest. The forward score of a prefix is the best sum of piece scores over its
admissible segmentations; a back pointer names the last piece.

Admissible, for models that merge pairs: of two neighbours in a segmentation no merge may cross the
border, which is so where the two alone, merged by rank, stay as they are. One segmentation of each
prefix is left then, that of the library. For unigram models every segmentation is admissible. What no piece
covers falls back to bytes.

Cases: a null or empty text has no ids and decodes to the empty text. A text that holds the mark itself decodes
to a blank there, as in the library. Repeated rows and rows without doc_id come back one by one; an empty table gives no
rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from varuvakt.llm.common import sliced, texts_of

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Remembered words, segments and pairs of pieces of one Python worker, of each; some 250 bytes each.
REMEMBERED = 300_000
#: Longer words are encoded each time.
LONGEST = 64
#: Texts worked on at a time, by number and bytes: the more, the more prefixes their words share.
SLICE_ROWS = 2048
SLICE_BYTES = 4 << 20


class Model:
    """Pieces, their scores and the admissible pairs of a SentencePiece file."""

    def __init__(self, path: str, merges: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in ids}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.merges, self.pairs, self.known, self.parts = merges, {}, {}, {}
        # Words are cut at marks only if no piece goes on after a mark that follows something else.
        self.cuttable = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.pieces = {piece: piece for piece in self.ids if not merges or len(piece) == 1 or self.merged(piece) == [piece]}
        self.endings = {piece[at:] for piece in self.pieces for at in range(len(piece))}
        self.codes = {piece: i.to_bytes(4, "little") for piece, i in self.ids.items()}
        self.neighbours = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        written = [model.id_to_piece(i).replace(MARK, " ").encode() if i not in self.bytes else b"" for i in range(model.vocab_size())]
        for b, i in enumerate(self.bytes):
            written[i] = bytes([b])
        for i in range(model.vocab_size()):
            if model.is_control(i):
                written[i] = b""
        self.written = pa.array(written, pa.large_binary())

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, the best score first and the leftmost of equals."""
        parts, scores, none = list(text), self.scores.get, -np.inf
        pairs = [scores(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = scores(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = scores(parts[k] + parts[k + 1], none)
        return parts

    def admissible(self, left: str, right: str) -> bool:
        if not self.merges:
            return True
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def learn(self, words: set[str]) -> None:
        """Ids of words not yet known. A word is given without its first mark."""
        cut = {rest: self.segments(MARK + rest) for rest in words}
        fresh = set().union(*cut.values()).difference(self.parts)
        if len(self.parts) + len(fresh) > REMEMBERED:
            self.parts.clear()
            fresh = set().union(*cut.values())
        self.walk(sorted(fresh))
        parts = self.parts
        for rest, segments in cut.items():
            self.known[rest] = b"".join([parts[segment] for segment in segments])
        for segment in fresh:
            if len(segment) > LONGEST:
                del parts[segment]

    def segments(self, word: str) -> list[str]:
        """A word cut between neighbours that no piece holds side by side: nothing crosses there, so each segment has its own best pieces."""
        neighbours = self.neighbours
        cuts = [at for at, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in neighbours]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def walk(self, words: list[str]) -> None:
        """Ids of sorted segments, along their trie."""
        pieces, endings, pairs, piece_scores, merges = self.pieces, self.endings, self.pairs, self.scores, self.merges
        last, lasts, scores = "", [""], [0.0]
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            del lasts[shared + 1 :], scores[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, piece, found, start = -np.inf, None, [], end - 1
                while start >= 0 and (part := word[start:end]) in endings:
                    if part in pieces:
                        found.append((start, part))
                    start -= 1
                for start, part in reversed(found):
                    if start and merges:
                        fits = pairs.get((lasts[start], part))
                        if fits is None:
                            fits = self.admissible(lasts[start], part)
                        if not fits:
                            continue
                    score = scores[start] + piece_scores[part]
                    if score > best or piece is None:
                        best, piece = score, part
                    if merges:
                        break  # no other segmentation is admissible
                if piece is None:  # a character that no piece covers stands alone
                    piece, best = word[end - 1], scores[end - 1]
                lasts.append(piece)
                scores.append(best)
            last = word
            self.parts[word] = self.path(word, lasts)

    def path(self, word: str, lasts: list[str]) -> bytes:
        end, back = len(word), []
        while end:
            piece = lasts[end]
            back.append(piece)
            end -= len(piece)
        back.reverse()
        try:
            return b"".join([self.codes[piece] for piece in back])
        except KeyError:  # a character that no piece covers: its bytes
            return b"".join([self.codes.get(piece) or np.array([self.bytes[b] for b in piece.encode()], "<u4").tobytes() for piece in back])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        odd = pc.equal(texts, "")
        for test, what in ((pc.match_substring, "  "), (pc.match_substring, MARK), (pc.starts_with, " "), (pc.ends_with, " ")):
            odd = pc.or_(odd, test(texts, what))
        odd = odd.to_numpy(zero_copy_only=False) | (not self.cuttable)
        # Most texts are cut and looked up as columns; those with other blanks than single ones inside need the expression.
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        others = pa.array([self.words(text) for text in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        place = np.empty(len(texts), np.int64)
        place[np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]] = np.arange(len(texts))
        return pa.concat_arrays([self.coded(plain), self.coded(others)]).take(pa.array(place))

    def coded(self, cut: pa.ListArray) -> pa.ListArray:
        """Ids of lists of words: every distinct word of them is looked up or learnt once."""
        named = cut.flatten().dictionary_encode()
        distinct = named.dictionary.to_pylist()
        fresh = set(distinct).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = set(distinct)
        self.learn(fresh)
        ids, ends = joined(pa.array([self.known[word] for word in distinct], pa.large_binary()).take(named.indices))
        for word in fresh:
            if len(word) > LONGEST:
                del self.known[word]
        starts = cut.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array((ends[starts - starts[0]] // 4).astype(np.int32)), pa.array(np.frombuffer(ids, np.int32)))

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without its first mark."""
        if not text:
            return []
        if not self.cuttable:
            return [text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
            return [word[1:] for word in WORDS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """Texts of lists of ids, as bytes."""
        text, ends = joined(self.written.take(ids.flatten()))
        starts, view = ids.offsets.to_numpy(), memoryview(text)
        bounds = ends[starts - starts[0]].tolist()
        texts = [bytes(view[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return [text[1:] if text.startswith(b" ") else text for text in texts]


def joined(parts: pa.Array) -> tuple[pa.Buffer | bytes, np.ndarray]:
    """The bytes of a column of binaries in a row, and where each begins, with the end of the last."""
    _, ends, data = parts.buffers()
    ends = np.frombuffer(ends, np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    return (data.slice(int(ends[0]), int(ends[-1] - ends[0])) if data is not None else b""), ends - ends[0]


@lru_cache(maxsize=4)
def model(path: str, merges: bool = True) -> Model:
    return Model(path, merges)


def encode(docs: DataFrame, path: str, merges: bool = True) -> DataFrame:
    """doc_id, ids (array of int), n_ids. ``path``: a model file that every executor can read."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = model(path, merges).encode(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, sizes(ids)], names=["doc_id", "ids", "n_ids"])

    return texts_of(docs).mapInArrow(sliced(work, rows=SLICE_ROWS, most=SLICE_BYTES), "doc_id long, ids array<int>, n_ids long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); bytes that are no UTF-8 become replacement characters. Null ids give a null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                given = rows.column(1).is_valid().to_numpy(zero_copy_only=False)
                lists = pc.fill_null(rows.column(1), pa.scalar([], rows.column(1).type))
                texts = [text.decode("utf-8", "replace") if there else None for text, there in zip(own.decode(lists), given, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_ids, decoded_sha256 (of the decoded ids, as UTF-8), restored: whether they give the text again."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = model(path), batch.column(1)
        ids = own.encode(texts)
        decoded = own.decode(ids)
        columns = [
            batch.column(0), ids, sizes(ids), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            pa.array([d == t for d, t in zip(decoded, texts.cast(pa.binary()).to_pylist(), strict=True)], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_ids", "decoded_sha256", "restored"])

    wanted = "doc_id long, ids array<int>, n_ids long, decoded_sha256 string, restored boolean"
    return texts_of(docs).mapInArrow(sliced(work, rows=SLICE_ROWS, most=SLICE_BYTES), wanted)


def sizes(lists: pa.ListArray) -> pa.Array:
    return pc.list_value_length(lists).cast(pa.int64())
