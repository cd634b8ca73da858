import pytest
from pyspark.sql import functions as F

from orrery.functions.typekeys import base_key, type_name, written_key


def keys(spark, texts, key=written_key):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(key(F.col("s"))).collect()]


@pytest.mark.parametrize(
    "same",
    [
        ["const A::B *", "CONST a.b*", "A/B const\t*", "'a::b const *'", "::A::B const *;", "const\xa0A :: B *"],
        ["unsigned int", "int  unsigned", "UNSIGNED\nINT"],
        ["Foo<int*, A::B> volatile const", "const volatile foo<int*; a.b>", "volatile  Foo< int *, A::B > const"],
        ["void (__cdecl *)(A *, int)", "VOID(__cdecl*)(a*;int)"],
        ["Énd::X", "énd.x"],
    ],
)
def test_same(spark, same):
    assert len(set(keys(spark, same))) == 1


def test_different(spark):
    texts = ["A", "A*", "A**", "A*&", "A&", "A* const", "const A*", "A[2]", "A[3]", "A*[2]", "F<A,B>", "F<B,A>", "F<const A>", "F<A const>", "Énd", "End", "A_B", "AB", "A(B)", "int", "unsigned int"]
    assert len(set(keys(spark, texts))) == len(texts)


def test_base(spark):
    names = keys(spark, ["A::B<int*>"])
    assert set(keys(spark, ["const A::B<int*> *const", "A.B<int *>&", "volatile a/b<int*>[4]", "A::B<int*>** const volatile", "A::B<int*>"], base_key)) == set(names)


def test_nothing(spark):
    assert keys(spark, [None, "", "  ", "\t\xa0"]) == [None] * 4


def test_odd(spark):
    assert all(k is not None for k in keys(spark, ["(", ">>><<", "[[[", "*", "a" * 200_000, "<" * 3000, "const " * 3000 + "x<"]))


def test_name(spark):
    df = spark.createDataFrame([("A::B", "N", "C"), ("  ", "N", "C"), (None, "", "C"), (None, None, None), ("", " ", "")], "stored_fully_qualified_name string, namespace string, base_name string")
    assert [r[0] for r in df.select(type_name()).collect()] == ["A::B", "N::C", "C", None, None]
