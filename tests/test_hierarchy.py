import random

import pytest

from orrery.operators import hierarchy as H
from tests.conftest import rows


def brute(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    reach = {}
    for c in up:
        dist, todo = {}, [(p, 1) for p in up[c]]
        while todo:
            nxt = []
            for p, d in todo:
                if p not in dist:
                    dist[p] = d
                    nxt += [(q, d + 1) for q in up.get(p, ())]
            todo = nxt
        reach[c] = dist
    on = {c for c in up if c in reach[c]}
    bad = {c for c in up if c in on or on & set(reach[c])}
    roots = {(c, p, d) for c in up if c not in bad for p, d in reach[c].items() if p not in up}
    circles = {(c, p) for c, p in links if c == p or c in reach.get(p, ())}
    pairs = {(p, c, d) for c in up if c not in bad for p, d in reach[c].items()}
    return roots, bad, circles, pairs


def graph(kind, seed):
    r = random.Random(seed)
    if kind == "tree":
        return [(i, r.randrange(i)) for i in range(1, 120)]
    if kind == "chain":
        return [(i, i - 1) for i in range(1, 150)]
    if kind == "dag":
        return [(i, r.randrange(i)) for i in range(1, 80) for _ in range(r.randint(1, 3))]
    if kind == "star":
        return [(i, 0) for i in range(1, 400)] + [(0, 1000), (0, 1001)]
    if kind == "rings":
        return [(i, i // 7 * 7 + (i + 1) % 7) for i in range(70)] + [(100 + i, i) for i in range(30)] + [(200 + i, 100 + i) for i in range(20)] + [(500, 500), (600, 601)]
    return [(r.randrange(60), r.randrange(60)) for _ in range(70)]


@pytest.mark.parametrize("kind,seed,every,local", [("tree", 1, 4, 0), ("chain", 1, 4, 0), ("chain", 1, 2, 10**6), ("dag", 2, 3, 0), ("dag", 2, 3, 10**6), ("star", 1, 4, 0), ("rings", 1, 4, 10**6), ("rings", 1, 10**9, 0), ("mixed", 3, 4, 0), ("mixed", 4, 2, 10**6), ("mixed", 5, 1, 0)])
def test_against_brute_force(spark, kind, seed, every, local):
    links = sorted(set(graph(kind, seed)))
    roots, bad, circles, pairs = brute(links)
    h = H.resolve(spark.createDataFrame(links, "child long, parent long"), every, paths=True, local=local)
    assert {(r.node, r.root, r.depth) for r in h.roots.collect()} == roots
    assert {r.node for r in h.circular.collect()} == bad
    known = set(links)
    for r in h.roots.collect():
        assert len(r.path) == r.depth and r.path[-1] == r.root and all(s in known for s in zip([r.node, *r.path], r.path))
    assert {tuple(r) for r in H.circle_links(h, local).collect()} == circles
    if kind in ("dag", "rings", "mixed"):
        assert {(r.ancestor, r.node, r.depth) for r in H.ancestors(h).collect()} == pairs


def test_types(spark, catalog):
    d = catalog(
        extra="node int, root int",
        types=[{"id": i, "parent_type_id": p} for i, p in [(1, None), (2, 1), (3, 2), (4, 99), (5, 5), (6, 5)]],
        type_inheritances=[{"id": k, "parent_type_id": c, "related_type_id": p} for k, (c, p) in enumerate([(2, 1), (2, 1), (3, 2), (3, 1), (4, None), (None, 1), (7, 1), (5, 77)])],
    )
    assert rows(H.type_roots(spark, d)) == [("inheritance", 2, 1, 1), ("inheritance", 3, 1, 1), ("nesting", 2, 1, 1), ("nesting", 3, 1, 2), ("nesting", 5, -1, -1), ("nesting", 6, -1, -1)]


def test_empty(spark, catalog):
    d = catalog()
    assert rows(H.type_roots(spark, d)) == rows(H.type_paths(spark, d)) == rows(H.type_descendants(spark, d)) == rows(H.type_circles(spark, d)) == []


def test_circles_take_no_descendants_away(spark, catalog):
    # 3 derives from 2 and from 5, which lies on a circle with 6; 4 derives from 3, 7 from itself.
    links = [(2, 1), (3, 2), (3, 5), (5, 6), (6, 5), (4, 3), (7, 7)]
    d = catalog(types=[{"id": i} for i in range(1, 8)], type_inheritances=[{"id": k, "parent_type_id": c, "related_type_id": p} for k, (c, p) in enumerate(links)])
    found = [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 4, 2), (3, 4, 1), (5, 3, 1), (5, 4, 2), (5, 5, 2), (5, 6, 1), (6, 3, 2), (6, 4, 3), (6, 5, 1), (6, 6, 2), (7, 7, 1)]
    assert rows(H.type_descendants(spark, d)) == [("inheritance", *f) for f in found]


def test_all_ancestors_by_brute_force(spark):
    for seed in (3, 4):
        links = sorted(set(graph("mixed", seed)))
        up = {}
        for c, p in links:
            up.setdefault(c, set()).add(p)
        want = set()
        for c in up:
            seen, now, d = set(), up[c], 1
            while now:
                seen |= now
                want |= {(p, c, d) for p in now}
                now, d = {q for p in now for q in up.get(p, ())} - seen, d + 1
        assert {(r.ancestor, r.node, r.depth) for r in H.all_ancestors(spark.createDataFrame(links, "child long, parent long")).collect()} == want


def test_a_hot_node_and_a_long_circle(spark):
    # 100,000 links in one circle, 90,000 children of one node that is two below a root, and a tail of 50 into the circle.
    ring = spark.range(100_000).selectExpr("id AS child", "(id + 1) % 100000 AS parent")
    hot = spark.range(90_000).selectExpr("id + 1000000 AS child", "200000 AS parent")
    rest = spark.createDataFrame([(200_000, 200_001), (200_001, 200_002)] + [(300_000 + k, 300_000 + k + 1 if k < 49 else 7) for k in range(50)], "child long, parent long")
    links = ring.union(hot).union(rest)
    h = H.resolve(links)
    assert h.circular.count() == 100_050
    assert rows(h.roots.groupBy("root", "depth").count()) == [(200_002, 1, 1), (200_002, 2, 1), (200_002, 3, 90_000)]
    assert H.circle_links(h).count() == 100_000
