import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing as M
from orrery.plans.shared import running_sum


def docs(spark, sizes):
    return spark.createDataFrame([(i, s, n, 1, 1.0) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, tokens long, copy_no int, position double")


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 2.0)], [(0.0, 2.0), (1.0, 0.0)], [(0.0, 0.5), (0.2, 3.0), (0.5, 0.0), (0.7, 0.0), (1.0, 1.0)]])
def test_inverse_of_the_integral(spark, knots):
    def part(t):
        steps = 20_000
        weight = lambda x: next(w0 + (w1 - w0) * (x - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if x <= t1)
        whole = sum(weight((k + 0.5) / steps) for k in range(steps)) / steps
        return sum(weight((k + 0.5) / steps) for k in range(int(t * steps))) / steps / whole

    df = spark.range(11).select((F.col("id") / 10).alias("u"))
    for u, t in df.select("u", M.when_delivered(F.col("u"), knots)).collect():
        assert abs(part(t) - u) < 1e-3 and 0 <= t <= 1


def test_schedules_are_checked():
    for bad in ([(0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.1, 1.0), (1.0, 1.0)], [(0.0, -1.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            M.when_delivered(None, bad)


def test_running_sum(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.randrange(1000), i, r.randrange(50)) for i in range(3000)]
    got = running_sum(spark.createDataFrame(rows, "g string, o int, i int, v long").repartition(7), "g", ["o", "i"], "v", "s")
    want, at = {}, {}
    for g, o, i, v in sorted(rows):
        want[i] = at.get(g, 0)
        at[g] = want[i] + v
    assert {x.i: x.s for x in got.collect()} == want


def test_shares_and_repeats(spark):
    r = random.Random(2)
    sizes = [("big", r.randint(1, 40)) for _ in range(3000)] + [("mid", r.randint(1, 40)) for _ in range(400)] + [("small", r.randint(1, 40)) for _ in range(60)] + [(None, 5), ("other", 5), ("big", 0), ("small", 0)]
    targets = [M.Target("big", 0.6, 1), M.Target("mid", 0.3, 2, ((0.0, 2.0), (1.0, 0.0))), M.Target("small", 0.09, 4), M.Target("absent", 0.01, 3)]
    mixed = M.mix(docs(spark, sizes), targets).collect()
    total, by = sum(x.tokens for x in mixed), {}
    for x in mixed:
        by.setdefault(x.source, []).append(x)
    assert set(by) == {"big", "mid", "small"}
    for t in targets[:3]:
        assert abs(sum(x.tokens for x in by[t.source]) / total - t.share / 0.99) < 0.004
        assert len({(x.doc_id, x.copy_no) for x in by[t.source]}) == len(by[t.source]) and max(x.copy_no for x in by[t.source]) < t.repeats
    assert [x.position for x in mixed] == sorted(x.position for x in mixed)
    early = lambda s: sum(x.tokens for x in by[s] if x.position < 0.5) / sum(x.tokens for x in by[s])
    assert abs(early("big") - 0.5) < 0.02 and abs(early("mid") - 0.75) < 0.03
    shares = {x.source: x for x in M.shares(M.mix(docs(spark, sizes), targets), targets).collect()}
    assert shares["absent"].copies == 0 and shares["absent"].reached_share == 0 and abs(sum(x.reached_share for x in shares.values()) - 1) < 1e-9


def test_one_limiting_source_uses_all_repeats(spark):
    mixed = M.mix(docs(spark, [("a", 10)] * 100 + [("b", 10)] * 5), [M.Target("a", 0.5, 1), M.Target("b", 0.5, 3)]).collect()
    assert sum(x.source == "b" for x in mixed) == 15 and sum(x.source == "a" for x in mixed) == 15


def test_query(spark, catalog, data):
    shares = {x.source: x for x in M.reached_shares(spark, data).collect()}
    assert all(x.copies <= x.documents * x.max_repeats for x in shares.values())
    empty = catalog()
    assert M.training_order(spark, empty).collect() == [] and M.reached_shares(spark, empty).collect() == []
    d = catalog(extra="tokens int", documents=[{"doc_id": 1, "text": None, "source": "a"}, {"doc_id": 2, "text": "", "source": "a"}, {"doc_id": 3, "text": "hello world", "source": "a"}, {"doc_id": 4, "text": "x", "source": None}], mix_targets=[{"source": "a", "target_share": 1.0, "max_repeats": 2}, {"source": None, "target_share": 0.5}])
    assert [(x.doc_id, x.copy_no) for x in M.training_order(spark, d).collect()] == [(3, 0), (3, 1)]
