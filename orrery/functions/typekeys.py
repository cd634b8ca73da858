"""Keys that are equal when two type strings are the same written type.

Two strings are the same written type if they differ in nothing but white space, letter case, punctuation other
than ``* & < > [ ] ( ) _``, and the order of the words before the first ``*``, ``&`` or ``[`` that qualify the type
or make up a primitive name.  Template arguments and parameter lists count as a whole: what is inside keeps its
order, and a ``*`` in there isn't the "first" one.

Everything here is a Catalyst expression.  Strings without ``<`` or ``(`` need only string functions; the others
run through one fold over their tokens, which carries positions only and is linear in the length of the string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that qualify a type.
QUALIFIERS = ("const", "volatile")
#: Words that make up names of primitive types of more than one word.
PRIMITIVE_WORDS = (
    "unsigned", "signed", "char", "short", "int", "long", "float", "double", "bool", "wchar_t",
    "__int8", "__int16", "__int32", "__int64",
)

_WORD = r"[\p{L}\p{M}\p{N}_]+"
_TOKEN = _WORD + r"|[*&<>\[\]()]"
_IGNORED = r"[^\p{L}\p{M}\p{N}_*&<>\[\]()]+"
_MOVED = QUALIFIERS + PRIMITIVE_WORDS


def is_value(c: Column) -> Column:
    """Neither null nor blank, whatever the kind of white space."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _key(moved: Column, rest: Column) -> Column:
    return F.concat(F.array_join(F.array_sort(moved), " "), F.lit("|"), rest)


def _flat(low: Column, base: bool) -> Column:
    """For strings without ``<`` and ``(``."""
    head = F.regexp_replace(low, r"\[[^\]]*\]?|[*&]", " ") if base else F.regexp_extract(low, r"^[^*&\[]*", 0)
    words = _all(head, _WORD)
    moved = F.filter(words, lambda w: w.isin(*(PRIMITIVE_WORDS if base else _MOVED)))
    rest = F.array_join(F.filter(words, lambda w: ~w.isin(*_MOVED)), "")
    if not base:
        rest = F.concat(rest, F.regexp_replace(F.regexp_extract(low, r"(?s)^[^*&\[]*(.*)$", 1), _IGNORED, ""))
    return _key(moved, rest)


def _nested(low: Column, base: bool) -> Column:
    """For any string: finds the tokens to move to the front and those to leave out by their depth of nesting."""
    tokens = _all(low, _TOKEN)
    none = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("after"), F.lit(False).alias("dim"),
        none.alias("moved"), none.alias("out"),
    )

    def step(s: Column, t: Column) -> Column:
        top = s["depth"] == 0
        opens, closes, mark = t.isin("<", "("), t.isin(">", ")"), t.isin("*", "&", "[")
        here = F.array(s["i"])
        if base:
            moves = top & ~s["dim"] & t.isin(*PRIMITIVE_WORDS)
            goes = top & (s["dim"] | mark | (t == "]") | t.isin(*QUALIFIERS))
        else:
            moves = top & ~s["after"] & t.isin(*_MOVED)
            goes = F.lit(False)
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
            (s["after"] | (top & (mark | (t == "(")))).alias("after"),
            F.when(top & (t == "["), True).when(top & (t == "]"), False).otherwise(s["dim"]).alias("dim"),
            F.when(moves, F.concat(s["moved"], here)).otherwise(s["moved"]).alias("moved"),
            F.when(goes, F.concat(s["out"], here)).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        kept = F.filter(tokens, lambda t, i: ~F.array_contains(s["moved"], i) & ~F.array_contains(s["out"], i))
        return _key(F.transform(s["moved"], lambda i: F.element_at(tokens, i + 1)), F.array_join(kept, ""))

    return F.aggregate(tokens, start, step, finish)


def _of(c: Column, base: bool) -> Column:
    low = F.lower(c)
    return F.when(is_value(c), F.when(low.rlike(r"[<(]"), _nested(low, base)).otherwise(_flat(low, base)))


def written_key(c: Column) -> Column:
    """The key of a written type; null for null and blank strings."""
    return _of(c, False)


def base_key(c: Column) -> Column:
    """The key of what a type string refers to: without qualifiers, ``*``, ``&`` and array sizes outside of brackets.

    It equals ``written_key`` of a name of the same written type; null for null and blank strings.
    """
    return _of(c, True)


def type_name(stored: str = "stored_fully_qualified_name", namespace: str = "namespace", base_name: str = "base_name") -> Column:
    """The name of a type row: the stored one or, where that is no value, ``namespace::base_name``; null if there is none."""
    plain = F.when(is_value(F.col(base_name)), F.when(is_value(F.col(namespace)), F.concat_ws("::", namespace, base_name)).otherwise(F.col(base_name)))
    return F.when(is_value(F.col(stored)), F.col(stored)).otherwise(plain)
