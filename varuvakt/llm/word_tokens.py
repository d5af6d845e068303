"""Token ids of whole texts with a tokenizers file, remembered word by word.

Holds for byte-level tokenizers that lower-case, drop white space and merge only
inside runs of letters, single digits or runs of other signs: a text's ids are
those of its blank-separated parts, one after the other. Parts of Latin letters
and ASCII signs are cut here and handed to the merge model; any other part
goes through the library's whole chain.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Remembered parts, and runs in them, of one Python worker; 150 to 250 bytes each.
REMEMBERED = 500_000
#: Longer parts are not remembered.
LONGEST = 64

# Latin letters that stay one composed letter when lower-cased; special tokens begin with "<|".
PLAIN = re.compile("(?!.*<\\|)[!-~À-ÖØ-öø-įı-ſ]+", re.S)
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RunIds(dict):
    """Run of letters, digit or signs -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        shown = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        ids = np.array([token.id for token in self.model.tokenize(shown)], "<u4").tobytes()
        if len(run) <= LONGEST:
            self[run] = ids
        return ids


class PartIds(dict):
    """Blank-separated part of a text (UTF-8) -> its ids, likewise."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs = RunIds(self.tokenizer.model)

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = part.decode("utf-8", "replace")
        if PLAIN.fullmatch(text):
            ids = b"".join(map(self.runs.__getitem__, RUNS.findall(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= LONGEST:
            self[part] = ids
        return ids


@lru_cache(maxsize=4)
def _parts(path: str) -> PartIds:
    return PartIds(path)


def encoder(path: str) -> Callable[[bytes], bytes]:
    parts = _parts(path)

    def encode(text: bytes) -> bytes:
        return b"".join(map(parts.__getitem__, text.split()))

    return encode
