"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.llm.common import ship
from barloom.llm.word_bpe import default_path, words


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of each whole text as the library gives them; null and empty texts have none.

    Only lengths leave the workers. Texts are cut at blanks, each batch's new words are encoded in
    calls of equal bytes, so a very long text costs no larger call than short ones.
    """
    path = path or default_path()
    ship()

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(words(path, False).counts(b), dtype="int64")

    return run(text)
