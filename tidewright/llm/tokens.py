"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, functions as F

#: The public pattern that splits text before the merges of this vocabulary, and the place of the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_EXACT = regex.compile(PATTERN)
#: The same splits for texts of these characters only, on which the classes of both modules agree.
_COMMON = re.compile("[\t\n\r\x0b\x0c -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ſ‐-‧‰-⁞€]*")
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
KEPT, LONGEST = 300_000, 40


class Tokenizer:
    """Counts tokens; the counts of short stretches between split points are kept, up to a fixed number of them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._kept: dict[str, int] = {}

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    @staticmethod
    def stretches(text: str) -> list[str]:
        """What the pattern splits the text into; joined they are the text, and their counts add up to its count."""
        return (_FAST if _COMMON.fullmatch(text) else _EXACT).findall(text)

    def counts(self, stretches: list[str]) -> list[int]:
        kept, out = self._kept, []
        for s in stretches:
            n = kept.get(s)
            if n is None:
                n = len(self.encoding.encode_ordinary(s))
                if len(s) <= LONGEST:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[s] = n
            out.append(n)
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One per Python worker and file. The file must be at this path on every node."""
    return Tokenizer(path)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null and empty texts have 0."""

    def count(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([t.count(x) if isinstance(x, str) and x else 0 for x in texts], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)
