"""Inputs of a reranker as token ids within a budget: a prefix and a suffix that always stay, the pair cut at a token between them, and padding on the left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Framer:
    """encode: a text to its token ids, without special ones. budget: tokens in all."""

    encode: Callable[[str], list[int]]
    budget: int
    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()
    pad: int = 0

    def __post_init__(self):
        if self.budget < len(self.prefix) + len(self.suffix):
            raise ValueError("the budget has no room for the prefix and the suffix")

    def frame(self, pair: str | None) -> list[int]:
        """The ids of a framed pair; of the pair what goes beyond the budget is left off at its end."""
        room = self.budget - len(self.prefix) - len(self.suffix)
        return [*self.prefix, *list(self.encode(pair or ""))[:room], *self.suffix]

    def padded(self, pairs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask): a row a pair, as wide as the longest, with padding on the left and a mask of 0 there."""
        rows = [self.frame(p) for p in pairs]
        width = max(map(len, rows), default=0)
        ids, mask = np.full((len(rows), width), self.pad, np.int64), np.zeros((len(rows), width), np.int64)
        for i, row in enumerate(rows):
            if row:
                ids[i, width - len(row) :], mask[i, width - len(row) :] = row, 1
        return ids, mask

    def framed(self, pair: Column) -> Column:
        """A column of pairs to a column of the ids of their frames, without padding."""

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for pairs in batches:
                yield pd.Series([self.frame(p) for p in pairs])

        return run(pair)


def tokenizer_file(path: str) -> Callable[[str], list[int]]:
    """The encoder of a tokenizer file (tokenizers' JSON), opened once in each process that uses it."""
    opened: list = []

    def encode(text: str) -> list[int]:
        if not opened:
            from tokenizers import Tokenizer

            opened.append(Tokenizer.from_file(path))
        return opened[0].encode(text, add_special_tokens=False).ids

    return encode
