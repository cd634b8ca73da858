import random

from pyspark.sql import functions as F

from orrery.llm import survivors as M
from tests.conftest import day, rows

WHOLE, BROKEN = "struct A\n{\n int x;\n};", "struct A\n{\n int x;"


def test_vote():
    assert M.vote([("A::B <int>", 1.0), ("A::B<int>", 1.0), ("a::B<int>", 1.0)]) == "A::B<int>"
    assert M.vote([("x", 1.0), ("y", 2.0)]) == "y"
    assert M.vote([("b", 1.0), ("a", 1.0)]) == "a"
    assert M.vote([("", 1.0), ("a b", 1.0), ("a  b", 1.0)]) in ("a b", "a  b")


def test_alignment_keeps_all_tokens():
    r = random.Random(1)
    values = [" ".join(r.choices("abcd", k=r.randint(0, 7))) for _ in range(20)]
    profile = M.progressive([M.profile_of(v, 1.0) for v in values])
    assert all(abs(sum(c.values()) - (20 if any(values) else 0)) < 20 for c in profile)
    assert sum(w for c in profile for t, w in c.items() if t) == sum(len(M.tokens(v)) for v in values)


def test_is_whole(spark):
    texts = [WHOLE, BROKEN, "struct A;", None, "", "{", "}", "{}", "}{}", "{{}", "{{}}", "a{b{c}d", "x{y}z{", "{" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(M.is_whole(F.col("s"))).collect()]
    assert got == [True, False, False, False, False, False, False, True, True, False, True, False, True, False]


def ballots(spark, *groups):
    """Votes of (group, values and weights); ids follow the order."""
    rows = [(g, "f", v, w, k, 9) for g, pairs in groups for k, (v, w) in enumerate(pairs)]
    return spark.createDataFrame(rows, "group string, field string, value string, weight double, id int, n int")


def test_chunks_make_no_difference(spark):
    r = random.Random(5)
    groups = []
    for g in range(12):
        base = [r.choice(["A", "::", "B", "<", "int", ">", " ", "*", "const"]) for _ in range(8)]
        values = {}
        while len(values) < 40 + g:
            v = list(base)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = r.choice(["A", "a", "::", ".", "int", "INT", "  ", f"v{r.randint(0, 9)}"])
            values["".join(v)] = float(r.randint(1, 3))
        groups.append((f"g{g}", list(values.items())))
    votes = ballots(spark, *groups)
    want = {g: M.vote(pairs) for g, pairs in groups}
    for chunk in (2, 8, 32, 1024):
        assert {x.group: x.value for x in M.consensus(votes, chunk).collect()} == want, chunk


def test_consensus_of_rows(spark):
    votes = ballots(spark, ("h", [("one", 1.0), ("one", 1.0), ("two", 1.0)]), ("n", [(None, 1.0)]), (None, [("x", 1.0)]), ("t", [("a b c", 1.0), ("a b d", 1.0), ("a x d", 1.0)]), ("e", [("", 0.0), ("q", 0.0)]))
    got = {x.group: (x.value, x.id) for x in M.consensus(votes).collect()}
    assert got["h"] == ("one", 0) and set(got) == {"h", "t", "e"} and got["t"] == ("a b d", 1)


def test_alignment_is_the_same_cut_in_two(monkeypatch):
    r = random.Random(3)
    for _ in range(30):
        a, b = ([{t: 1.0} for t in r.choices("abcde", k=r.randint(0, 30))] for _ in range(2))
        common = lambda p: sum(1 for c in p if len(c) == 1 and "" not in c)
        monkeypatch.setattr(M, "CELLS", 1 << 22)
        whole = M.align(a, b)
        monkeypatch.setattr(M, "CELLS", 8)
        halved = M.align(a, b)
        assert abs(common(whole) - common(halved)) <= 1 and all([t for c in p for t in c if t in "abcde"] for p in (whole, halved) if p)


def test_edits():
    def brute(a, b):
        now = list(range(len(b) + 1))
        for i, x in enumerate(a):
            now, old = [i + 1], now
            for j, y in enumerate(b):
                now.append(min(old[j + 1] + 1, now[j] + 1, old[j] + (x != y)))
        return now[-1]

    r = random.Random(4)
    for _ in range(200):
        a, b = (r.choices("abc", k=r.randint(0, 9)) for _ in range(2))
        assert M.edits(a, b) == brute(a, b)


def test_query(spark, catalog):
    types = [
        {"id": 1, "stored_fully_qualified_name": "A::B", "source": WHOLE, "loaded_at": day(1)},
        {"id": 2, "stored_fully_qualified_name": "a.b", "source": BROKEN, "loaded_at": day(9)},
        {"id": 3, "base_name": "B", "namespace": "A", "source": WHOLE, "loaded_at": day(3)},
        {"id": 4, "stored_fully_qualified_name": "A/B;", "source": WHOLE, "loaded_at": day(3)},
        {"id": 5, "stored_fully_qualified_name": "Other"},
        {"id": 6, "stored_fully_qualified_name": "OTHER", "loaded_at": day(2)},
        {"id": 7, "stored_fully_qualified_name": "Alone", "source": WHOLE},
        {"id": 8},
    ]
    members = [{"id": k, "struct_id": s} for k, s in enumerate([1, 2, 2, 3, 3, 7])] + [{"id": 0, "struct_id": 1}, {"id": 0, "struct_id": 1}, {"id": 99}]
    d = catalog(types=types, struct_members=members)
    assert rows(M.best_rows(spark, d)) == [(1, 2, 3), (5, 6, None)]
    one = {r.first_id: r for r in M.type_survivors(spark, d).collect()}
    assert set(one) == {1, 5, 7} and one[1].name == "A::B" and one[1].source == WHOLE and one[1].members == 2 and one[5].source is None
    assert rows(M.best_rows(spark, catalog())) == rows(M.type_survivors(spark, catalog())) == []


def test_hot_group(spark, catalog):
    types = [{"id": i, "stored_fully_qualified_name": "Hot" + " " * (i % 90) + ";" * (i % 7), "source": WHOLE, "loaded_at": day(1)} for i in range(700)]
    assert rows(M.best_rows(spark, catalog(types=types))) == [(0, 0, 0)]
    one = M.type_survivors(spark, catalog(types=types)).collect()
    assert len(one) == 1 and one[0].n_rows == 700 and one[0].name.strip(" ;") == "Hot"


def test_what_rows_have_is_kept(spark, catalog):
    types = [{"id": 1, "stored_fully_qualified_name": "A", "kind": "Struct", "is_vtable": False, "source": "struct A;", "loaded_at": day(1)}, {"id": 2, "stored_fully_qualified_name": "A", "source": " ", "loaded_at": day(2)}]
    types += [{"id": 3, "stored_fully_qualified_name": "B", "kind": "Class", "loaded_at": day(1)}, {"id": 4, "stored_fully_qualified_name": "B", "source": WHOLE, "loaded_at": day(2)}]
    members = [{"id": k, "struct_id": 1, "name": f"m{k}", "type_string": "int", "decl_order": -k} for k in (1, 2)]
    got = {r.first_id: r for r in M.type_survivors(spark, catalog(types=types, struct_members=members)).collect()}
    assert (got[1].kind, got[1].is_vtable, got[1].source, got[1].source_from_id, got[1].members) == ("Struct", False, "struct A;", None, 2)
    assert [m.name for m in got[1].member_rows] == ["m2", "m1"]
    assert (got[3].kind, got[3].source, got[3].source_from_id) == ("Class", WHOLE, 4)


def test_the_consensus_is_asked_only_where_it_decides(spark, catalog, monkeypatch):
    types = [{"id": k, "stored_fully_qualified_name": "A::B", "kind": "Struct" if k == 4 else "Class", "source": WHOLE if k > 2 else BROKEN, "loaded_at": day(k)} for k in (1, 2, 3, 4)]
    types += [{"id": k, "stored_fully_qualified_name": "C", "source": "struct C; // " + t, "loaded_at": day(k)} for k, t in ((5, "a b c"), (6, "a b c d"), (7, "x"))]
    members = [{"id": k, "struct_id": s} for k, s in enumerate([1, 1, 2, 5])]
    d = catalog(types=types, struct_members=members)
    asked, consensus = [], M.consensus
    monkeypatch.setattr(M, "consensus", lambda votes: asked.append({r.field for r in votes.select("field").distinct().collect()}) or consensus(votes))
    assert rows(M.best_rows(spark, d)) == [(1, 1, 4), (5, 5, None)] and not asked
    got = {r.first_id: r for r in M.type_survivors(spark, d).collect()}
    assert asked == [{"name", "kind", "broken"}]
    # Rows 3 and 4 weigh double: Class has 4 of 6, although row 4 is the one that source is from.
    assert (got[1].kind, got[1].source, got[1].source_from_id, got[1].members_from_id, got[1].members) == ("Class", WHOLE, 4, 1, 2)
    assert got[5].source == "struct C; // a b c" and (got[5].source_from_id, got[5].members_from_id) == (None, 5)
