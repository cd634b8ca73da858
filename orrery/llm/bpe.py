"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern; the bytes of a piece are a doubly linked list of symbols, and a priority
queue holds the ranks of the pairs that may merge.  The lowest rank (leftmost of equals) is taken first; entries whose symbols
have merged meanwhile are stale and skipped.  That takes n log n steps for a piece of n bytes, however long it is.  Decoding
concatenates the vocabulary's strings.  Pieces seen before come from a bounded memo.

No special tokens: strings that look like one are plain text.  Null and empty texts have no ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.tables import table

#: Where the vocabulary files are; a parameter of everything below.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The pattern that goes with the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces the memo of a worker holds, and the longest that goes into it.
MEMO, MEMO_CHARS = 1 << 18, 64


class BytePairs:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        rank, n, longest = self.ranks.get, len(piece), self.longest
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue  # stale: one of the two has merged with another
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                far = after[end]
                if far - i <= longest and (r := rank(piece[i:far])) is not None:
                    heapq.heappush(queue, (r, i, far))
            k = before[i]
            if k >= 0 and end - k <= longest and (r := rank(piece[k:end])) is not None:
                heapq.heappush(queue, (r, k, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode(errors="replace")


@lru_cache(maxsize=4)
def coder(path: str) -> BytePairs:
    """One per worker process."""
    return BytePairs(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or FOLDER}/{name}.tiktoken"


def token_ids(text: Column, path: str | None = None) -> Column:
    """array<int> of a string column, empty for null and empty texts."""
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path).encode
        for batch in batches:
            yield pd.Series([own(t) if t else [] for t in batch])

    return encode(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of ids of a string column, 0 for null and empty texts."""
    path = path or vocabulary()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path).encode
        for batch in batches:
            yield pd.Series([len(own(t)) if t else 0 for t in batch], dtype="int64")

    return count(text)


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_ids."""
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; null for null."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path).decode
        for batch in batches:
            yield pd.Series([None if x is None else own(map(int, x)) for x in batch], dtype=object)

    return decode(ids)
