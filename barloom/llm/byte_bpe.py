"""Byte-level BPE with ranks from a local file: encoding to and decoding from packed identifiers."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.llm.common import ship

RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16
# No match of the pattern runs from a letter or digit over a following blank or line end.
_SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of at least ``size`` characters, cut only where every match of the pattern ends."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode(text: str | None, path: str, size: int = PIECE) -> bytes:
    """Identifiers as little-endian unsigned 32-bit integers; null gives none."""
    enc = encoding(path)
    return b"".join(np.asarray(enc.encode_ordinary(p), "<u4").tobytes() for p in pieces(text or "", size))


def encoded(text: Column, path: str | None = None, size: int = PIECE) -> Column:
    """Column of packed identifiers of whole texts, four bytes each; null and empty texts have none."""
    path = path or public_tokenizers.path(RANKS)
    ship()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([encode(t, path, size) for t in b], dtype=object)

    return run(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Column of the raw bytes that packed identifiers stand for; null gives no bytes."""
    path = path or public_tokenizers.path(RANKS)
    ship()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for b in batches:
            yield pd.Series([enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b], dtype=object)

    return run(ids)
