import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.functions.typekeys import written_key
from orrery.llm.ledger import Ledger, copies, written_type_copies, written_types
from tests.conftest import day, rows

SPELLINGS = ["A::B *", "a.b*", "const A", "A const", "C", "c;", "D<int,E>", None, " "]


def batch(spark, records):
    return spark.createDataFrame(records, "id int, v string, key string, copies int").withColumn("copies", F.lit(7))


def test_batches_give_what_one_gives(spark, tmp_path):
    r = random.Random(1)
    records = [(i, r.choice(SPELLINGS), "x", 0) for i in range(400)]
    r.shuffle(records)
    key = written_key(F.col("v"))
    ledger = Ledger(spark, f"{tmp_path}/l", 4)
    for k in range(0, 400, 90):
        ledger.add(batch(spark, records[k : k + 90]), "id", "v", key)
    ledger.add(batch(spark, []), "id", "v", key)
    canon = dict(zip(SPELLINGS, ["ab*", "ab*", "ac", "ac", "c", "c", "d", None, None]))
    groups = defaultdict(list)
    for i, v, *_ in records:
        if canon[v]:
            groups[canon[v]].append((i, v))
    want = sorted((len(g), *min(g)) for g in groups.values())
    got = lambda led: sorted((x.copies, x.first_id, x.first_value) for x in led.records().collect())
    assert got(ledger) == want
    assert got(Ledger(spark, f"{tmp_path}/l", 4)) == want  # opened again
    assert rows(copies(batch(spark, records), "id", key, ledger)) == sorted((min(g)[0], i) for g in groups.values() for i, _ in g if i != min(g)[0])


def test_a_batch_counts_once_and_only_when_it_is_in(spark, tmp_path):
    key = F.col("v")
    Ledger(spark, f"{tmp_path}/l", 2).add(batch(spark, [(2, "a", "", 0)]), "id", "v", key, "one").add(batch(spark, [(1, "a", "", 0)]), "id", "v", key, "two")
    again = Ledger(spark, f"{tmp_path}/l", 2).add(batch(spark, [(1, "a", "", 0)]), "id", "v", key, "two")
    assert [tuple(r) for r in again.records().collect()] == [("a", 2, 1, "a")]
    (tmp_path / "l" / f"manifest={again.version + 1}").write_text("{")  # a writer died here
    other = Ledger(spark, f"{tmp_path}/l", 2)
    assert [tuple(r) for r in other.records().collect()] == [("a", 2, 1, "a")] and other.batches == ["one", "two"]
    with pytest.raises(Exception, match="exist"):
        other.add(batch(spark, [(7, "b", "", 0)]), "id", "v", key, "three")


def test_small_batches_leave_large_runs_alone(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l", 4).add(batch(spark, [(i, f"v{i}", "", 0) for i in range(200)]), "id", "v", F.col("v"))
    first = ledger.runs[0]
    for k in range(6):
        ledger.add(batch(spark, [(500 + k, f"v{k % 2}", "", 0)]), "id", "v", F.col("v"))
    assert ledger.runs[0] == first and len(ledger.runs) <= 3
    assert len(list((tmp_path / "l").glob("run_*"))) == len(ledger.runs) and len(list((tmp_path / "l").glob("manifest=*"))) == 1
    got = {r.key: r.copies for r in ledger.records().collect()}
    assert len(got) == 200 and sum(got.values()) == 206 and got["v0"] == 4


def test_the_larger_run_is_not_shuffled(spark, tmp_path):
    key = F.col("v")
    ledger = Ledger(spark, f"{tmp_path}/l", 4).add(batch(spark, [(i, f"v{i}", "", 0) for i in range(200)]), "id", "v", key).add(batch(spark, [(500, "v1", "", 0)]), "id", "v", key)
    plan = ledger.records()._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and plan.count("Exchange hashpartitioning") == 0  # both are bucketed alike


def test_hot_key_ties_and_long_texts(spark, tmp_path):
    long = "x" * 300_000
    records = [(i, "Hot", "", 0) for i in range(3000)] + [(9000, long, "", 0), (9000, long, "", 0), (None, "Hot", "", 0)]
    ledger = Ledger(spark, f"{tmp_path}/l").add(batch(spark, records), "id", "v", F.col("v"))
    assert {r.copies for r in ledger.records().collect()} == {3001, 2}
    assert copies(batch(spark, records), "id", F.col("v"), ledger).count() == 2999


def test_query(spark, catalog):
    refs = [{"id": i, "type_string": t, "loaded_at": when} for i, (t, when) in enumerate([("A *", day(1, 12)), ("a*", day(1)), (None, day(1)), ("A**", None), ("a * *", day(1, 5)), ("", None)])]
    d = catalog(type_references=refs)
    assert rows(written_type_copies(spark, d)) == [(0, 1), (3, 4)]
    assert rows(written_types(spark, d)) == [(0, "A *", 2), (3, "A**", 2)]
    assert rows(written_type_copies(spark, catalog())) == []
    assert rows(written_types(spark, catalog())) == []
