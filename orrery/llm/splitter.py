"""Splitting oversized texts at natural boundaries.

Each position between two characters of a text has a boundary strength (see ``STRENGTHS``).  A sparse table over the strengths
answers range-maximum queries: for a piece that begins at ``a`` the permissible cuts are those after more than ``overlap``
characters (so that the next piece begins later) and at most ``max_chars``; the strongest one is taken, the rightmost of equals.
The next piece begins ``overlap`` characters before the cut.  No piece but the last is shorter than ``LEAST`` of the limit, so a strong
boundary right behind the last cut doesn't make a crumb.  Strengths take a byte for each character; the table, with eight bytes for
each character and level, is built over a stretch of the text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.tables import table

#: Boundary kinds from the strongest on: the cut is at the end of the match.
STRENGTHS = (
    (9, r"\n[^\S\n]*(?:\r?\n)+"),  # an empty line
    (8, r"(?:\r\n|\n|\r| | )"),  # the end of a line
    (7, r"[;{}](?=\s)|[;}](?=.)"),  # the end of a statement or block
    (6, r"[.!?](?=\s)"),  # the end of a sentence
    (5, r"[,:)](?=\s)"),  # part of a sentence or a list
    (4, r",|\)"),
    (3, r"\s+"),  # between words
    (2, r"::|[<>(\[\]*&/\\|=+-]"),  # between parts of a name or type
    (1, r"_+|(?<=[a-z0-9])(?=[A-Z])"),  # between parts of an identifier
)
_PATTERNS = [(s, re.compile(p, re.S)) for s, p in STRENGTHS]
#: Characters for which one table is built.
STRETCH = 1 << 16
#: The part of the limit that a piece has at least, unless it is the last.
LEAST = 0.25


def strengths(text: str) -> np.ndarray:
    """The strength of the cut before each position 0..len(text); 0 inside of words."""
    out = np.zeros(len(text) + 1, dtype=np.uint8)
    for strength, pattern in reversed(_PATTERNS):
        for m in pattern.finditer(text):
            out[m.end()] = strength
    return out


class RangeMax:
    """A sparse table: the position of the greatest value of any range, the rightmost of equals."""

    def __init__(self, values: np.ndarray):
        # One number orders by value, then position; level k has the greatest of each 2^k in a row.
        self.levels = [values.astype(np.int64) << 40 | np.arange(len(values), dtype=np.int64)]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def argmax(self, low: int, high: int) -> int:
        """Of low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[low], row[high - (1 << k) + 1]) & ((1 << 40) - 1))


def pieces(text: str, max_chars: int, overlap: int, least: float = LEAST) -> list[tuple[int, int, int]]:
    """(begin, end, strength of the cut at the end) of the pieces of a text; one piece if it fits, none if it is empty.

    ``overlap`` counts as at most ``max_chars - 1``; the strength at the end of the text is 0.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    overlap, n = max(0, min(overlap, max_chars - 1)), len(text)
    if n <= max_chars:
        return [(0, n, 0)] if n else []
    out, begin, known, index, base = [], 0, strengths(text), None, 0
    while n - begin > max_chars:
        low, high = begin + max(overlap + 1, min(int(least * max_chars), max_chars)), begin + max_chars
        if index is None or high >= base + STRETCH + max_chars:
            base = begin
            index = RangeMax(known[base : base + STRETCH + max_chars])
        cut = base + index.argmax(low - base, high - base)
        out.append((begin, cut, int(known[cut])))
        begin = cut - overlap
    return [*out, (begin, n, 0)]


_PIECE = "struct<piece_no: int, begin: int, end: int, strength: int, text: string>"


def split_column(text: Column, max_chars: int, overlap: int) -> Column:
    """The pieces of a string column as an array of structs; an empty array for null and empty texts."""

    @F.pandas_udf(f"array<{_PIECE}>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("piece_no", "begin", "end", "strength", "text")
        for batch in batches:
            yield pd.Series([[dict(zip(names, (k, a, b, s, t[a:b]))) for k, (a, b, s) in enumerate(pieces(t, max_chars, overlap))] if t else [] for t in batch])

    # Texts that fit are one piece as they are; only the others are sent to Python.
    long = F.length(text) > max_chars
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("begin"), F.length(text).alias("end"), F.lit(0).alias("strength"), text.alias("text")))
    return F.when(long, split(F.when(long, text))).when(F.length(text) > 0, whole).otherwise(F.array().cast(f"array<{_PIECE}>"))


def split_texts(df: DataFrame, ident: str, text: str, max_chars: int, overlap: int) -> DataFrame:
    """row_id, piece_no, begin, end, strength, text of every piece of every row.

    Null and empty texts have no pieces.  Repeated rows give repeated pieces (see :func:`one_per_record`); columns other than
    ``ident`` and ``text`` are left out, so their names don't matter.
    """
    rows = df.select(F.col(ident).alias("row_id"), F.col(text).alias("_text"))
    return rows.select("row_id", F.explode(split_column(F.col("_text"), max_chars, overlap)).alias("p")).select("row_id", "p.*")


def one_per_record(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident`` and ``text``, one row for all that share an id: the greatest text of them."""
    return df.groupBy(ident).agg(F.max(text).alias(text))


def rejoined(pieces: DataFrame) -> DataFrame:
    """table_name, row_id, text, longest: the texts that pieces (see :func:`all_pieces`) were cut from, and the length of the longest piece."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "begin", "end", "text"))), lambda p: p)
    rows = pieces.groupBy("table_name", "row_id").agg(own.alias("l"), F.max(F.length("text")).alias("longest"))
    new = F.transform("l", lambda p, k: F.when(k == 0, p["text"]).otherwise(F.substring(p["text"], F.element_at("l", k)["end"] - p["begin"] + 1, F.length(p["text"]))))
    return rows.select("table_name", "row_id", F.array_join(new, "").alias("text"), "longest")


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, digest of the text its pieces make up again, fits: whether all are within the limit."""
    most = spark.createDataFrame([(t, m) for t, _, m, _ in limits(spark, sf_dir)], "table_name string, most int")
    whole = rejoined(all_pieces(spark, sf_dir)).join(F.broadcast(most), "table_name")  # one row per field
    return whole.select("table_name", "row_id", F.md5(F.col("text").cast("binary")).alias("digest"), (F.col("longest") <= F.col("most")).alias("fits"))


def limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, int, int]]:
    """table_name, field_name, max_chars, overlap_chars: a small table of settings, a row per field."""
    rows = table(spark, sf_dir, "split_limits").where("max_chars > 0").select("table_name", "field_name", "max_chars", F.coalesce("overlap_chars", F.lit(0))).distinct()
    return [tuple(r) for r in rows.orderBy("table_name", "field_name").collect()]


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: table_name, row_id of each record that has to be cut, which is what has a second piece."""
    found = [split_texts(table(spark, sf_dir, t), "id", f, m, o).where("piece_no = 1").select(F.lit(t).alias("table_name"), "row_id") for t, f, m, o in limits(spark, sf_dir)]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "table_name string, row_id int")).distinct()


def all_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, piece_no, begin, end, strength, text of every piece of every record."""
    cut = [split_texts(one_per_record(table(spark, sf_dir, t), "id", f), "id", f, m, o).select(F.lit(t).alias("table_name"), "*") for t, f, m, o in limits(spark, sf_dir)]
    return reduce(DataFrame.unionByName, cut, spark.createDataFrame([], f"table_name string, row_id int, {_PIECE[7:-1]}"))
