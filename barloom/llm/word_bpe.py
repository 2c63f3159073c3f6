"""Encoding with a word-level BPE file: every blank is a safe boundary, so words are encoded once.

The tokenizer drops white space before merging and none of its special strings holds a blank. A
text's tokens are therefore those of its words in order, and so is the place between an ASCII letter
and another ASCII character that is none. Parts of a batch not met before go to the library together,
in calls of about equal bytes; words of letters share a text, whose word ends tell them apart. A
worker remembers a bounded number of parts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers

VOCABULARY = "word_bpe_49k.json"
CALL_BYTES = 1 << 16
REMEMBERED = 800_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def _merger(path: str):
    """The same vocabulary and merges for words that are lower-case letters already."""
    from tokenizers import Tokenizer, pre_tokenizers

    bare = Tokenizer(tokenizer(path).model)
    bare.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return bare


@lru_cache(maxsize=2)
def _closing(path: str) -> np.ndarray:
    """For each identifier, whether it ends a word."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
    return out


# A run of letters ends before any other ASCII character.
_EDGE = re.compile(rb"(?<=[a-z])(?=[\x21-\x40\x5b-\x60\x7b-\x7e])")


def parts_of(text: str | None) -> list[bytes]:
    """A text's parts: cut at blanks and, where no special string can be, lower-cased and cut after ASCII letters."""
    b = (text or "").encode()
    return b.split() if b"<|" in b else _EDGE.sub(b" ", b.lower()).split()


class Words:
    """Words' token counts, or their identifiers packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, packed: bool, remembered: int = REMEMBERED, call_bytes: int = CALL_BYTES):
        self.path, self.packed, self.remembered, self.call_bytes = path, packed, remembered, call_bytes
        self.known: dict[bytes, object] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.remembered:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = words - self.known.keys()
        self._call([w for w in new if w.isalpha() or self._letters(w)], self._together)
        self._call([w for w in new if w not in self.known], self._apart)

    @staticmethod
    def _letters(part: bytes) -> bool:
        """Whether a part is letters that neither composition nor case changes further, apart from single letters' case."""
        text = part.decode()
        low = text.lower()
        return text.isalpha() and low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)

    def _call(self, parts: list[bytes], encode) -> None:
        """The library's calls get about equal bytes."""
        call, held = [], 0
        for p in parts:
            call.append(p)
            held += len(p) + 1
            if held >= self.call_bytes:
                encode(call)
                call, held = [], 0
        if call:
            encode(call)

    def _together(self, parts: list[bytes]) -> None:
        """Words of letters as one text; each gives one run of identifiers up to a word's end."""
        text = b" ".join(parts).decode().lower()
        ids = np.array(_merger(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(_closing(self.path)[ids]) + 1
        if len(ends) != len(parts):
            return
        if self.packed:
            data, at = ids.tobytes(), 0
            for p, end in zip(parts, (4 * ends).tolist(), strict=True):
                self.known[p] = data[at:end]
                at = end
        else:
            self.known.update(zip(parts, np.diff(ends, prepend=0).tolist(), strict=True))

    def _apart(self, parts: list[bytes]) -> None:
        found = tokenizer(self.path).encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        for p, e in zip(parts, found, strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes() if self.packed else len(e)

    def split(self, texts, step: int = 1 << 20):
        """Texts' words, some texts at a time so that words to remember stay bounded."""
        group: list[list[bytes]] = []
        size = 0
        for t in texts:
            group.append(parts_of(t))
            size += len(t or "")
            if size >= step:
                self.learn(set().union(*group))
                yield from group
                group, size = [], 0
        self.learn(set().union(*group))
        yield from group

    def counts(self, texts) -> list[int]:
        return [sum(map(self.known.__getitem__, w)) for w in self.split(texts)]

    def ids(self, texts) -> list[bytes]:
        return [b"".join(map(self.known.__getitem__, w)) for w in self.split(texts)]


@lru_cache(maxsize=2)
def words(path: str, packed: bool) -> Words:
    return Words(path, packed)


class Numbered(dict):
    """Numbers parts as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        k = self[part] = len(self)
        self.new.append(part)
        return k


class FlatWords(Words):
    """Identifiers of texts as slices of one array: each part is looked up once, and known parts' identifiers lie in one array."""

    def __init__(self, path: str, remembered: int = REMEMBERED, call_bytes: int = CALL_BYTES):
        super().__init__(path, True, remembered, call_bytes)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.store = np.empty(1 << 20, "<u4")
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def _keep(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.empty_like(self.store)))
        while len(self.known) > len(self.size):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        self.store[self.used : self.used + len(ids)] = ids
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used += len(ids)

    def _together(self, parts: list[bytes]) -> None:
        text = b" ".join(parts).decode().lower()
        ids = np.array(_merger(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(_closing(self.path)[ids]) + 1
        if len(ends) == len(parts):
            self._keep(parts, ids, np.diff(ends, prepend=0))
        else:
            self._apart(parts)

    def _apart(self, parts: list[bytes]) -> None:
        found = [e.ids for e in tokenizer(self.path).encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        self._keep(parts, np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64))

    def flat(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' identifiers one after another, and where each text ends."""
        if len(self.known) > self.remembered:
            self._forget()
        split = [parts_of(t) for t in texts]
        n = np.array([len(p) for p in split], np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        new, self.known.new = self.known.new, []
        letters = [p.isalpha() or self._letters(p) for p in new]
        self._call([p for p, yes in zip(new, letters, strict=True) if yes], self._together)
        self._call([p for p, yes in zip(new, letters, strict=True) if not yes], self._apart)
        sizes = self.size[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        spot = np.repeat(self.first[codes] - ends[:-1], sizes)
        spot += np.arange(len(spot))
        return self.store[spot], ends[np.cumsum(n)]


@lru_cache(maxsize=2)
def flat_words(path: str, remembered: int = REMEMBERED) -> FlatWords:
    return FlatWords(path, remembered)
