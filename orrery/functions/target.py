"""C++ types in the target language.  Plain Python, as types nest without limit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import cpp
from orrery.functions.fixed import TARGET_TYPES

_TARGETS = {k.lower(): v for k, v in TARGET_TYPES.items()}
_QUALIFIER = re.compile(r"(?:const|volatile|struct|enum|union) | (?:const|volatile)\b")


def _identifier(name: str, space: str) -> str:
    name = name.removeprefix(space) if space and name.startswith(f"{space}.") else name
    stars = len(name) - len(name.rstrip("*"))
    name = name.rstrip("*") + "_ptr" * stars
    for old, new in (("[", "_Array"), ("]", "_"), ("::", "_"), (".", "_"), ("<", "__"), (">", ""), (",", "__"), (" ", "_")):
        name = name.replace(old, new)
    return "void_ptr" if name == "System_IntPtr" else name


def map_type(text: str | None, space: str = "Bindings", known: bool | None = None) -> str:
    """The target's type.  ``known``: for a pointer, whether what it points to is in the catalog (None: not asked)."""
    if not text or not text.strip():
        return "void"
    if cpp.is_function_pointer(text):
        return "System.IntPtr"
    text = cpp.normalize(text)
    if text.endswith("*"):
        if text == "void*":
            return "System.IntPtr"
        inner = text[:-1]
        if known is False:
            depth = len(inner) - len(inner.rstrip("*"))
            own = _TARGETS.get(_QUALIFIER.sub("", inner.rstrip("*")).strip().lower(), "System.")
            return "System.IntPtr" if own.startswith("System.") else own + "*" * (depth + 1)
        return map_type(inner, space) + "*"
    if text.endswith("&"):
        return "void*"
    bare = _QUALIFIER.sub("", text).strip()
    if own := _TARGETS.get(bare.lower()):
        return own
    if bare.startswith("_STL::vector<") or bare.lower() == "_stl::vector":
        return "long"
    start, end = bare.find("<"), bare.rfind(">")
    if 0 <= start < end:
        arguments = [a.strip() for a in cpp.split_top(bare[start + 1 : end], ",", "<>()")]
        names = [_identifier(map_type(a, space), space) for a in arguments if not re.match(r"-?\d", a)]
        return "__".join([map_type(bare[:start], space), *names]) + bare[end + 1 :].replace("::", ".")
    return f"{space}." + cpp.strip_comments(bare.replace("::", ".")).strip().replace("$", "_")


def map_static_pointer(text: str | None, space: str = "Bindings", known: bool | None = None) -> str:
    """The target's type of a pointer to a static variable."""
    if not text or not text.strip():
        return "void*"
    text = cpp.normalize(text)
    if known is False and text.endswith("*"):
        return "System.IntPtr"
    own = map_type(text.rstrip("* "), space)
    return own if own == "void*" else own + "*"


def mapped(text: Column, known: Column | None = None, space: str = "Bindings") -> Column:
    @F.pandas_udf("string")
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, knowns in batches:
            yield pd.Series([map_type(t, space, None if k is None or k != k else bool(k)) for t, k in zip(texts, knowns)], dtype=object)

    return each(text, known if known is not None else F.lit(None).cast("boolean"))
