import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import splitter as S
from tests.conftest import rows


def plain(text, most, overlap):
    """The same by looking at every permissible cut."""
    out, begin, known = [], 0, S.strengths(text)
    while len(text) - begin > most:
        cut = max(range(begin + overlap + 1, begin + most + 1), key=lambda c: (known[c], c))
        out.append((begin, cut, int(known[cut])))
        begin = cut - overlap
    return [*out, (begin, len(text), 0)] if text else []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab C_:;{}\n\r.,<é日", max_size=300), st.integers(1, 40), st.integers(0, 60))
def test_any_text(text, most, overlap):
    got = S.pieces(text, most, overlap)
    assert got == plain(text, most, min(overlap, most - 1))
    assert all(0 < e - b <= most for b, e, _ in got)
    assert not text or (got[0][0], got[-1][1]) == (0, len(text))
    assert all(b2 == e1 - min(overlap, most - 1) for (_, e1, _), (b2, _, _) in zip(got, got[1:]))


def test_range_maximum():
    r = random.Random(3)
    import numpy as np

    v = np.array([r.randrange(5) for _ in range(200)])
    index = S.RangeMax(v)
    for _ in range(500):
        a = r.randrange(200)
        b = r.randrange(a, 200)
        assert index.argmax(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


def test_stretches_do_not_show(monkeypatch):
    text = " ".join(random.Random(1).choices(["foo", "bar;", "x\n", "long_word"], k=4000))
    whole = S.pieces(text, 200, 20)
    monkeypatch.setattr(S, "STRETCH", 50)
    assert S.pieces(text, 200, 20) == whole


def test_cuts_at_boundaries():
    text = "int a;\nint b;\n\nint c;\nint d;\n"
    assert [text[a:b] for a, b, _ in S.pieces(text, 20, 0)] == ["int a;\nint b;\n\n", "int c;\nint d;\n"]


def test_limits():
    with pytest.raises(ValueError):
        S.pieces("x", 0, 0)
    assert S.pieces("x" * 10, 4, 9) == [(i, i + 4, 0) for i in range(6)] + [(6, 10, 0)]
    assert S.pieces("", 5, 1) == [] and S.pieces("abc", 3, 1) == [(0, 3, 0)]


def test_query(spark, catalog):
    long = {"id": 3, "fully_qualified_name": "é" * 31}
    d = catalog(
        split_limits=[{"table_name": "types", "field_name": "source", "max_chars": 30, "overlap_chars": 5}, {"table_name": "function_bodies", "field_name": "fully_qualified_name", "max_chars": 30}],
        types=[{"id": 1, "source": "a b " * 50}, {"id": 2, "source": None}, {"id": 3, "source": ""}, {"id": 4, "source": "x" * 30}],
        function_bodies=[long, long, {"id": 4, "fully_qualified_name": "日" * 30}, {"id": None}],
    )
    assert rows(S.oversized(spark, d)) == [("function_bodies", 3), ("types", 1)]
    pieces = [r for r in S.all_pieces(spark, d).collect()]
    assert sum(r.row_id == 3 and r.table_name == "function_bodies" for r in pieces) == 2
    one = sorted((r for r in pieces if r.row_id == 1), key=lambda r: r.piece_no)
    text = "a b " * 50
    assert one[0].text + "".join(r.text[5:] for r in one[1:]) == text and all(r.text == text[r.begin : r.end] for r in one)
    assert rows(S.oversized(spark, catalog())) == [] and rows(S.all_pieces(spark, catalog())) == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, 1)], "id int, t string, piece_no int")
    got = S.split_texts(df, "id", "t", 2000, 200)
    assert got.count() == len(S.pieces("word " * 400_000, 2000, 200))
