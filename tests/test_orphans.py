from orrery.operators.orphans import orphans, type_orphans
from tests.conftest import day, rows

TYPES = [
    {"id": 1, "stored_fully_qualified_name": "A::B", "loaded_at": day(10)},
    {"id": 1, "stored_fully_qualified_name": "a.b", "loaded_at": day(5)},
    {"id": 2, "base_name": "C", "namespace": "N", "loaded_at": day(20)},
    {"id": 3, "loaded_at": day(1)},
]
REMOVED = [{"type_id": 9, "fully_qualified_name": "Gone"}, {"type_id": 8}, {"type_id": 1, "fully_qualified_name": "A::B"}]
PRIMITIVE = [{"name": "unsigned int"}, {"name": None}]


def found(spark, catalog, refs, bases=(), **more):
    d = catalog(types=TYPES, type_removals=REMOVED, primitive_types=PRIMITIVE, type_references=refs, type_inheritances=bases, **more)
    return [r[1:] for r in rows(type_orphans(spark, d)) if r[0]]


def test_by_id(spark, catalog):
    refs = [(1, day(7)), (1, day(4)), (9, day(1, 2)), (8, day(1)), (77, day(1)), (1, None)]
    got = found(spark, catalog, [{"id": i, "referenced_type_id": r, "type_string": "Gone", "loaded_at": t} for i, (r, t) in enumerate(refs)])
    assert got == [(1, "2025-01", "late"), (2, "2025-02", "deleted"), (3, "2025-01", "deleted"), (4, "2025-01", "missing")]


def test_by_name(spark, catalog):
    texts = ["const a.B *", "N/C[3]", "gone&", "Nowhere", "int unsigned *", "void (*)(Nowhere)", " ", None]
    got = found(spark, catalog, [{"id": i, "type_string": t, "loaded_at": day(12)} for i, t in enumerate(texts)])
    assert got == [(1, "2025-01", "late"), (2, "2025-01", "deleted"), (3, "2025-01", "missing")]


def test_repeated_bases_count_once(spark, catalog):
    base = {"id": 5, "parent_type_id": 1, "related_type_id": 77, "loaded_at": day(1)}
    assert found(spark, catalog, [], [base, base]) == [(5, "2025-01", "missing")]


def test_empty(spark, catalog):
    assert rows(type_orphans(spark, catalog())) == []
    assert found(spark, catalog, []) == []


def test_hot_key_and_clashing_names(spark):
    refs = spark.createDataFrame([("hot", i, day(1), 0, 0, 0) for i in range(3000)] + [(f"k{i}", 3000 + i, day(1), 0, 0, 0) for i in range(100)] + [(None, -1, None, 0, 0, 0)], "_key string, row_id int, at timestamp_ntz, since int, state int, _salt int")
    parents = spark.createDataFrame([("hot", day(2), 1)], "_key string, since timestamp_ntz, at int")
    gone = spark.createDataFrame([("k0", 1), ("k0", 1), (None, 1)], "_key string, here int")
    got = orphans(refs, parents, gone, keep=()).groupBy("state").count()
    assert rows(got) == [("deleted", 1), ("late", 3000), ("missing", 99)]
