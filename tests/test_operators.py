import random
import time

import pytest
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.operators import catalog as K
from orrery.operators import graph, layout, pipeline, render, resolution, rules
from orrery.plans.shared import row_numbers
from orrery.sources import listings
from orrery.sources.tables import table
from tests.conftest import rows


def values(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("s"))).collect()]


def test_remap(spark):
    texts = ["_BYTE", "unsigned int", "_BYTE*", "Array<unsigned int>", "Map<_DWORD, unsigned int>", "_BYTES_RECEIVED", None]
    assert values(spark, S.remap, texts) == ["byte", "uint32_t", "byte*", "Array<uint32_t>", "Map<uint32_t, uint32_t>", "_BYTES_RECEIVED", None]


def test_ignore(spark):
    assert values(spark, S.should_ignore, ["_SomeStruct", "SomeStruct_", "_IDClass", "_STL::_SomeStruct", "NS::SomeStruct_tag", "ValidStruct", "", None]) == [True, True, False, True, True, False, False, False]


def test_enum_values(spark):
    assert values(spark, S.enum_value, ["10", "-3", "0x1F", "0X1fUL", "-0x10", "7LL", "abc", "", None, "0x", "1 + 2"]) == [10, -3, 31, 31, -16, 7, None, None, None, None, None]


def test_addresses(spark):
    assert values(spark, S.address, ["0000000140BA96E0", "1f", "0x1F", "zz", None]) == ["0x140BA96E0", "0x0000001F", "0x0000001F", "zz", None]


def test_verdict(spark):
    got = values(spark, S.verdict, ['x {"valid": true, "reason": "r"} y', '{"valid": false}', "none", "{broken", None])
    assert [(g["valid"], g["reason"]) if g else None for g in got] == [(True, "r"), (False, None), None, None, None]


def test_typedef_chains(spark):
    types = spark.createDataFrame([(1, "N::T"), (2, "U")], "id int, stored_fully_qualified_name string")
    defs = [(1, "A", "", "B *"), (2, "B", "", "const C"), (3, "C", "", "N::T"), (4, "X", "", "Y"), (5, "Y", "", "X"), (6, "Z", "", "nowhere"), (7, "S", "", "S"), (8, "U2", "ns", "A"), (9, "U2", "", "U"), (10, "C", "other", "U")]
    got = resolution.typedef_targets(spark.createDataFrame(defs, "id int, name string, namespace string, type_string string"), types)
    assert {r.name: r.type_id for r in got.collect()} == {"A": 1, "B": 1, "C": 1, "X": None, "Y": None, "Z": None, "S": None, "U2": 2}


def test_resolution_order(spark):
    types = spark.createDataFrame([(1, "N::T"), (2, "T"), (3, "Only")], "id int, stored_fully_qualified_name string")
    names = spark.createDataFrame([("const N::T *", "N::T"), ("M::T&", "M::T"), ("int", "int"), ("Alias", "Alias"), ("Nothing", "Nothing")], "text string, full string")
    chains = spark.createDataFrame([("Alias", 3)], "name string, type_id int")
    got = {r.text: (r.type_id, r.step) for r in resolution.resolve_names(names, types, chains).collect()}
    assert got == {"const N::T *": (1, 1), "M::T&": (2, 3), "Alias": (3, 2), "Nothing": (None, None)}


def test_hot_reference_is_resolved_everywhere(spark):
    types = spark.createDataFrame([(1, "Hot")], "id int, stored_fully_qualified_name string")
    refs = spark.createDataFrame([(i, "Hot *", "Hot", None) for i in range(2000)] + [(3000, None, None, None), (3001, "", "", None), (3002, "Gone", "Gone", 9)], "id int, type_string string, fully_qualified_type string, referenced_type_id int")
    got = {r.id: r.referenced_type_id for r in resolution.resolve_references(refs, types).collect()}
    assert len(got) == 2003 and all(got[i] == 1 for i in range(2000)) and (got[3000], got[3001], got[3002]) == (None, None, 9)


def test_scopes(spark):
    types = spark.createDataFrame([(1, "A::X", "X", "A"), (2, "A::B::X", "X", "A::B"), (3, "Y", "Y", "")], "id int, stored_fully_qualified_name string, base_name string, namespace string")
    names = spark.createDataFrame([("X", "A::B::C"), ("X", "A"), ("X", ""), ("Y", "A::B"), ("Q", "A"), ("X", None)], "name string, scope string")
    assert {(r.name, r.scope): r.type_id for r in resolution.in_scope(names, types).collect()} == {("X", "A::B::C"): 2, ("X", "A"): 1, ("X", ""): 1, ("Y", "A::B"): 3, ("Q", "A"): None}


def test_statics(spark):
    lines = spark.createDataFrame([("a.c", 1, "float Render::s_rate = 1;"), ("a.c", 2, "  int indented = 2;"), ("b.c", 1, "float Render::s_rate = 3;"), ("b.c", 2, "Other::s_rate = 3;"), ("b.c", 3, "s_plain= 4;")], "file string, line int, text string")
    statics = spark.createDataFrame([("Render::s_rate",), ("s_plain",), ("indented",)], "name string")
    assert {(r.name, r.file, r.line) for r in resolution.static_definitions(statics, lines).collect()} == {("Render::s_rate", "a.c", 1), ("s_plain", "b.c", 3)}
    types = spark.createDataFrame([(5, "Render")], "id int, stored_fully_qualified_name string")
    assert rows(resolution.static_owners(statics, types).select("name", "parent_id")) == [("indented", None), ("s_plain", None), ("s_rate", 5)]


def test_arguments_get_references(spark):
    refs = spark.createDataFrame([(1, "A"), (7, "B")], "id int, type_string string")
    args = spark.createDataFrame([(1, "A"), (2, "C *"), (3, "C  *"), (4, "int"), (5, None)], "id int, type_string string")
    done, added = resolution.register_arguments(args, refs)
    assert rows(added) == [(8, "C*")] and {r.id: r.type_reference_id for r in done.collect()} == {1: 1, 2: 8, 3: 8, 4: None, 5: None}


def test_base_paths(spark):
    types = [(1, "A", "", "A"), (2, "A_vtbl", "", "A_vtbl"), (3, "In", "A", "A::In"), (4, "Deep", "A::In", "A::In::Deep"), (5, "Free", "ns", "ns::Free"), (6, "B_vtbl", "ns", "ns::B_vtbl")]
    got = resolution.base_paths(spark.createDataFrame(types, "id int, base_name string, namespace string, stored_fully_qualified_name string"))
    assert dict(tuple(r) for r in got.collect()) == {1: "A", 2: "A", 3: "A", 4: "A", 5: "ns::Free", 6: "ns::B_vtbl"}


def test_grouping_roots(spark):
    types = [(1, "A", "", "A", ""), (2, "B", "", "B", "A"), (3, "C", "", "C", "B"), (4, "X", "", "X", "Y"), (5, "Y", "", "Y", "X"), (6, "Z", "", "Z", "nowhere"), (7, "S", "", "S", "S")]
    got = resolution.grouping_roots(spark.createDataFrame(types, "id int, base_name string, namespace string, stored_fully_qualified_name string, base_type_path string"))
    found = dict(tuple(r) for r in got.collect())
    assert found[2] == 1 and found[3] == 1 and found[4] is None and found[5] is None and found[6] is None and found[1] is None


def test_long_chains_have_ends(spark):
    types = [(0, "T0", "", "T0", "")] + [(k, f"T{k}", "", f"T{k}", f"T{k - 1}") for k in range(1, 150)] + [(200, "R0", "", "R0", "R2"), (201, "R1", "", "R1", "R0"), (202, "R2", "", "R2", "R1"), (203, "L", "", "L", "R0")]
    got = dict(tuple(r) for r in resolution.grouping_roots(spark.createDataFrame(types, "id int, base_name string, namespace string, stored_fully_qualified_name string, base_type_path string")).collect())
    assert got == {0: None} | dict.fromkeys(range(1, 150), 0) | dict.fromkeys(range(200, 204))
    defs = [(k, f"D{k}", "", f"D{k - 1} *" if k else "End") for k in range(1200)] + [(2000, "X", "", "Y"), (2001, "Y", "", "Z"), (2002, "Z", "", "X"), (2003, "W", "", "X")]
    ends = resolution.typedef_targets(spark.createDataFrame(defs, "id int, name string, namespace string, type_string string"), spark.createDataFrame([(7, "End")], "id int, stored_fully_qualified_name string"))
    assert {r.name: (r.type_id, r.depth) for r in ends.collect()} == {f"D{k}": (7, k + 1) for k in range(1200)} | dict.fromkeys("XYZW", (None, None))


def test_graph(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (3, 9), (5, 6), (6, 5)], "child long, parent long")
    types = spark.createDataFrame([(1, "Root", False), (6, "Ring", False), (2, "Hidden", True)], "id int, stored_fully_qualified_name string, is_ignored boolean")
    names = spark.createDataFrame([("Root",), ("Ring",), ("Hidden",)], "name string")
    assert rows(graph.derived_from(links, types, names)) == [(1, "Root"), (2, "Root"), (3, "Root"), (4, "Root"), (5, "Ring"), (6, "Ring")]
    assert rows(graph.bases_of(links, spark.createDataFrame([(4,), (5,)], "id int"))) == [(1,), (2,), (3,), (4,), (5,), (6,), (9,)]
    assert rows(graph.with_destructor(links, spark.createDataFrame([(2,)], "id int"))) == [(2,), (3,), (4,)]


def test_reached_takes_no_round_per_step(spark):
    chain = [(k + 1, k) for k in range(80)] + [(200 + k, 5) for k in range(40)] + [(301, 300), (302, 301), (300, 302)]
    links = spark.createDataFrame(chain, "child long, parent long")
    seeds = spark.createDataFrame([(0, "a"), (40, "a"), (40, "b"), (301, "c"), (999, "d"), (999, "a"), (77, "")], "node long, name string")
    to = {}
    for child, parent in chain:
        to.setdefault(parent, []).append(child)

    def all_under(node):
        found = [node]
        for x in found:
            found += [y for y in to.get(x, ()) if y not in found]
        return found

    want = sorted({(y, s.name) for s in seeds.collect() for y in all_under(s.node)})
    spark.sparkContext.setJobGroup("reached", "reached")
    got = rows(graph.reached(links, seeds, "parent", "child", "name"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("reached"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs < 40
    short = links.where("child < 10 OR child > 100")
    assert rows(graph.reached(short, seeds, "parent", "child", "name", local=0)) == rows(graph.reached(short, seeds, "parent", "child", "name"))
    assert rows(graph.reached(links, seeds.limit(0), "parent", "child", "name")) == rows(graph.reached(links.limit(0), seeds.limit(0), "parent", "child")) == []


MEMBERS = "id int, struct_id int, name string, type_string string, type_reference_id int, decl_order int, bit_width int, alignment int, is_function_pointer boolean"


def layouts(spark, types, members, refs=(), bases=()):
    t = spark.createDataFrame(types, "id int, base_name string, kind string, alignment int, stored_fully_qualified_name string")
    m = spark.createDataFrame([(k, *x) for k, x in enumerate(members)], MEMBERS)
    r = spark.createDataFrame(list(refs), "id int, type_string string, referenced_type_id int, is_pointer boolean, is_array boolean, array_size int")
    b = spark.createDataFrame([(k, *x) for k, x in enumerate(bases)], "id int, parent_type_id int, related_type_id int, ord int")
    sizes = layout.type_sizes(t, m, r, b)
    return {x.id: x.size for x in sizes.collect()}, {x.id: x.member_offset for x in layout.member_offsets(t, m, r, b, sizes).collect()}


def member(struct, name, kind, order, ref=None, bits=None, alignment=None, pointer=False):
    return (struct, name, kind, ref, order, bits, alignment, pointer)


def test_bit_fields(spark):
    region = [member(1, f"f{k}", "unsigned __int32", k, bits=1) for k in range(3)]
    mixed = [member(2, "Data", "int", 0), member(2, "Flag1", "int", 1, bits=1), member(2, "Flag2", "int", 2, bits=1)]
    full = [member(3, "a", "char", 0, bits=5), member(3, "b", "char", 1, bits=4), member(3, "c", "int", 2, bits=4), member(3, "d", "char", 3)]
    types = [(k, f"S{k}", "Struct", None, f"S{k}") for k in (1, 2, 3)]
    _, at = layouts(spark, types, region + mixed + full)
    assert [at[k] for k in range(10)] == [0, 0, 0, 0, 4, 4, 0, 1, 4, 8]


def test_inheritance_and_nesting(spark):
    types = [(1, "Base", "Struct", None, "Base"), (2, "Derived", "Struct", None, "Derived"), (3, "Holder", "Struct", 16, "Holder"), (4, "U", "Union", None, "U"), (5, "E", "Enum", None, "E")]
    members = [member(1, "c", "char", 0), member(1, "i", "int", 1), member(2, "s", "short", 0), member(3, "d", "Derived", 0, ref=1), member(3, "a", "Base", 1, ref=2), member(3, "p", "Base *", 2), member(3, "u", "U", 3), member(3, "f", "void", 4, pointer=True), member(3, "x", "double", 5)]
    refs = [(1, "Derived", 2, False, False, None), (2, "Base", 1, False, True, 3)]
    sizes, at = layouts(spark, types, members, refs, [(2, 1, 0)])
    assert sizes == {1: 8, 2: 12, 3: 64, 4: 4, 5: 4}
    assert [at[k] for k in range(9)] == [0, 4, 8, 0, 12, 36, 40, 44, 48]


def test_circle_counts_four(spark):
    types = [(1, "A", "Struct", None, "A"), (2, "B", "Struct", None, "B"), (3, "C", "Struct", None, "C")]
    sizes, _ = layouts(spark, types, [member(1, "b", "B", 0), member(2, "a", "A", 0), member(3, "c", "char", 0)])
    assert sizes == {1: 4, 2: 4, 3: 1}


def test_what_contains_a_circle_takes_its_real_size(spark):
    # 1 and 2 lie on a circle and count four bytes for each other only; 3 contains one of them, 4 derives from 3, 5 contains itself, 6 contains 5 and 4, 7 lies below.
    types = [(k, n, "Struct", None, n) for k, n in enumerate("ABCDEFG", 1)] + [(8, "H", None, None, "H")]
    members = [member(1, "b", "B", 0), member(1, "x", "int", 1), member(1, "g", "G", 2), member(2, "y", "double", 0), member(2, "a", "A", 1), member(3, "a", "A", 0), member(3, "n", "int", 1)]
    members += [member(4, "z", "int", 0), member(5, "e", "E", 0), member(5, "v", "double", 1), member(6, "e", "E", 0), member(6, "d", "D", 1), member(6, "w", "int", 2), member(7, "p", "double", 0), member(7, "q", "double", 1), member(8, "h", "H", 0)]
    sizes, at = layouts(spark, types, members, bases=[(4, 3, 0)])
    assert sizes == {1: 4 + 4 + 16, 2: 8 + 4, 3: 24 + 4, 4: 28 + 4, 5: 4 + 8, 6: 12 + 32 + 4, 7: 16, 8: 4}
    assert [at[k] for k in (1, 4, 6, 7, 11, 12)] == [12, 8, 24, 28, 12, 44]


def test_sizes_of_more_than_two_gigabytes(spark):
    # Arrays of arrays, a plain array, a base and a circle above them; the last has 100,000^3 times 8 bytes.
    types = [(k, n, "Struct", None, n) for k, n in enumerate("ABCDEFG", 1)]
    refs = [(k, n, k, False, True, 100_000) for k, n in enumerate("ABCDEF", 1)] + [(9, "int", None, False, True, 1 << 30)]
    members = [member(1, "d", "double", 0), member(2, "a", "A", 0, ref=1), member(2, "c", "char", 1), member(3, "b", "B", 0, ref=2), member(3, "i", "int", 1), member(4, "c", "C", 0, ref=3), member(4, "z", "char", 1)]
    members += [member(5, "n", "int", 0, ref=9), member(5, "i", "int", 1), member(6, "i", "int", 0), member(7, "c", "C", 0), member(7, "g", "G", 1), member(7, "i", "int", 2)]
    b = 800_000 + 4
    c = 100_000 * b + 4
    d = 100_000 * c + 4
    want = {1: 8, 2: b, 3: c, 4: d, 5: (1 << 32) + 4, 6: d + 4, 7: c + 4 + 4}
    sizes, at = layouts(spark, types, members, refs, [(6, 4, 0)])
    assert sizes == want
    assert [at[k] for k in (2, 4, 6, 8, 9, 11, 12)] == [800_000, c - 4, d - 4, 1 << 32, d, c, 2 * c + 8]
    t = spark.createDataFrame(types, "id int, base_name string, kind string, alignment int, stored_fully_qualified_name string")
    m = spark.createDataFrame([(k, *x) for k, x in enumerate(members)], MEMBERS)
    r = spark.createDataFrame(refs, "id int, type_string string, referenced_type_id int, is_pointer boolean, is_array boolean, array_size int")
    bases = spark.createDataFrame([(0, 6, 4, 0)], "id int, parent_type_id int, related_type_id int, ord int")
    assert {x.id: x.size for x in layout.type_sizes(t, m, r, bases, local=0).collect()} == want


def test_sizes_take_no_round_per_level(spark, monkeypatch):
    # 1,400 towers of 200 structs, one upon the other with an int on top of each: more than 2^18 parts wait, one of each tower for the one below.
    t = spark.range(280_000).selectExpr("cast(id AS int) AS id", "concat('T', id) AS base_name", "'Struct' AS kind", "cast(null AS int) AS alignment", "concat('T', id) AS stored_fully_qualified_name")
    below = spark.range(280_000).where("id % 200 > 0").selectExpr("cast(id AS int) AS id", "cast(id AS int) AS struct_id", "'b' AS name", "concat('T', id - 1) AS type_string", "cast(null AS int) AS type_reference_id", "0 AS decl_order")
    top = spark.range(280_000).selectExpr("cast(id + 300000 AS int) AS id", "cast(id AS int) AS struct_id", "'i' AS name", "'int' AS type_string", "cast(null AS int) AS type_reference_id", "1 AS decl_order")
    m = below.unionByName(top).selectExpr("*", "cast(null AS int) AS bit_width", "cast(null AS int) AS alignment", "false AS is_function_pointer")
    r = spark.createDataFrame([], "id int, type_string string, referenced_type_id int, is_pointer boolean, is_array boolean, array_size int")
    bases = spark.createDataFrame([], "id int, parent_type_id int, related_type_id int, ord int")
    levels, filled = [], layout._filled
    monkeypatch.setattr(layout, "_filled", lambda *a: levels.append(1) or filled(*a))
    assert layout.type_sizes(t, m, r, bases).where("size <> 4 * (id % 200 + 1)").count() == 0
    assert len(levels) == 1


def test_quirks_of_sizes(spark):
    assert values(spark, S.primitive_size, ["unsigned char", "unsigned __int16", "long long", "double", "DOUBLE", "void"]) == [4, 4, 4, 8, 8, 0]


def test_rules(spark):
    types = spark.createDataFrame([(1, "Struct", "N::A", "N::A::Camera", "struct Camera\n{\n int GetIt;\n};"), (2, "Struct", "P::Q::R", "P::Q::R::Kid", ""), (3, "Enum", "", "Plain", None), (4, "Struct", "NET", "NET::x", "int GetIt;")], "id int, kind string, namespace string, stored_fully_qualified_name string, source string")
    own = (rules.Rule("member", "^getit$", "M/"), rules.Rule("name", "camera", "Never/"), rules.Rule("base", "Top", "Kids/", "StripNLevels", 1), rules.Rule("namespace", "net", "Net", "StripAll", 0, "one"))
    tops = spark.createDataFrame([(9, "Struct", "", "Top", None)], "id int, kind string, namespace string, stored_fully_qualified_name string, source string")
    every = types.union(tops).withColumn("is_ignored", F.lit(False))
    got = rules.locations(every, spark.createDataFrame([(2, 9)], "child long, parent long"), own)
    assert {r.id: (r.rule, r.path, r.file_name) for r in got.collect()} == {1: (0, "M/N/A", None), 2: (2, "Kids/Q/R", None), 3: (None, "", None), 4: (0, "M/NET", None), 9: (2, "Kids", None)}


def test_path_tree(spark):
    paths = spark.createDataFrame([("Lib",), ("Lib/Dats",), ("Lib/Dats/DBObjs",), ("Other",), ("",), ("Global",), (None,)], "path string")
    got = {r.full_path: (r.parent, r.name, r.n_items) for r in rules.path_tree(paths).collect()}
    assert got == {"": (None, "Root", 3), "Lib": ("", "Lib", 1), "Lib/Dats": ("Lib", "Dats", 1), "Lib/Dats/DBObjs": ("Lib/Dats", "DBObjs", 1), "Other": ("", "Other", 1)}


def test_groups_take_no_notice_of_case(spark):
    types = spark.createDataFrame([(1, "A", "", "A", ""), (2, "a", "", "a", ""), (3, "A_vtbl", "", "A_vtbl", "A")], "id int, base_name string, namespace string, stored_fully_qualified_name string, base_type_path string")
    places = spark.createDataFrame([(1, "X", None), (2, "x", None), (3, "Y", None)], "id int, path string, file_name string")
    assert rows(rules.grouped(types, places)) == [("A", "X", 1), ("A", "X", 2), ("A", "X", 3)]


def test_functions_that_mention_an_enum(spark, catalog):
    from orrery.reference_queries import QUERIES

    source = lambda name, *values: f"/* 1 */\nenum {name}\n{{\n" + ",\n".join(f"  {v} = 0x{k}" for k, v in enumerate(values)) + "\n};\n"
    enums = {1: ("Color", ("RED_C", "BLUE_C")), 2: ("Shape", ("ROUND_S",)), 3: ("Unused", ("NONE_U",))}
    bodies = {10: "x = RED_C;", 11: "Color c = blue_c; c = RED_C; c = RED_C;", 12: "f(ROUND_S);", 13: "", 14: None, 15: "Shape s;"} | {k: "Color" for k in range(20, 45)}
    d = catalog(
        types=[{"id": k, "base_name": n, "kind": "Enum", "is_ignored": False, "source": source(n, *v)} for k, (n, v) in enums.items()] + [{"id": 4, "base_name": "S", "kind": "Struct", "is_ignored": False, "source": source("S", "ROUND_S")}],
        function_bodies=[{"id": k, "fully_qualified_name": "void Unused::f()", "body_text": t} for k, t in bodies.items()],
    )
    want = set()
    for e, (name, values_) in enums.items():
        hits = [(b, sum(w.lower() in (t or "").lower() for w in (name, *values_))) for b, t in bodies.items()]
        want |= {(e, b, n) for b, n in sorted((h for h in hits if h[1]), key=lambda h: (-h[1], h[0]))[:20]}
    assert {(r.owner_id, r.body_id, r.hits) for r in QUERIES["j28_texts_by_terms"](spark, d).collect()} == want and (1, 11, 3) in want


def test_headers_have_enums_arrays_and_parameters(spark, catalog):
    from orrery.reference_queries import QUERIES

    pointer, nested = "char (__stdcall *)(N::A *, unsigned char)", "int (__cdecl *(__thiscall *)(A *))(float)"
    refs = ["int[4]", pointer, "N::A *[8]", nested]
    d = catalog(
        types=[{"id": 1, "base_name": "A", "namespace": "", "stored_fully_qualified_name": "A", "kind": "Struct", "source": "struct A", "is_ignored": False, "is_vtable": False, "is_bitmask": False}]
        + [{"id": 2, "base_name": "E", "namespace": "", "stored_fully_qualified_name": "E", "kind": "Enum", "source": "/* 1 */\nenum E\n{\n  X = 0x1,\n};\n", "is_ignored": False, "is_vtable": False, "is_bitmask": False}],
        type_references=[{"id": k, "type_string": t, "is_array": t.endswith("]"), "array_size": {0: 4, 2: 8}.get(k)} for k, t in enumerate(refs)],
        struct_members=[{"id": k, "struct_id": 1, "name": f"m{k}", "type_string": t, "type_reference_id": k, "decl_order": k, "is_function_pointer": "(" in t} for k, t in enumerate(refs)],
    )
    files = {r.file: r.content for r in QUERIES["c1_headers"](spark, d).collect()}
    assert set(files) == {"A.h", "E.h"} and "enum E\n{\n    X = 0x1,\n};" in files["E.h"]
    for line in ("int32_t m0[4];", "byte (__stdcall *m1)(N::A *, unsigned char);", "N::A * m2[8];", "(__thiscall *m3)(A*);"):
        assert line in files["A.h"], files["A.h"]
    assert "public fixed int m0[4];" in {r.id: r.content for r in QUERIES["c7_bindings"](spark, d).collect()}[1]


def test_texts(spark, tmp_path):
    values_ = spark.createDataFrame([(1, 0, "A", "0x0"), (1, 1, "B", ""), (2, 0, "class", "-1")], "enum_id int, position int, name string, value string")
    enums = spark.createDataFrame([(1, "N::E", True), (2, "F", False)], "id int, full_name string, is_bitmask boolean")
    texts = render.enum_texts(enums, values_)
    assert {r.id: r.content for r in texts.collect()}[1] == "enum __bitmask N::E\n{\n    A = 0x0,\n    B,\n};"
    assert rows(render.enum_widths(values_)) == [(1, "byte"), (2, "sbyte")]
    groups = spark.createDataFrame([("N::E", "Lib", 1), ("N::E", "Lib", 2)], "output_file string, path string, type_id int")
    files = render.headers(groups, texts)
    render.write_files(files, f"{tmp_path}/out")
    assert (tmp_path / "out" / "Lib" / "E.h").read_text().startswith("#pragma once\n\nenum __bitmask N::E")
    helped = render.with_helpers(files, spark.createDataFrame([("E", "mine"), ("a::b", "left")], "name string, content string"))
    assert rows(helped) == [("Lib", "E.h", "mine"), ("Manual", "a__b.cs", "left")]


def test_term_hits(spark):
    terms = spark.createDataFrame([(1, "Alpha"), (1, "beta"), (2, "gamma"), (2, None), (2, " ")], "owner_id long, term string")
    bodies = spark.createDataFrame([(1, "xALPHAy beta"), (2, "alpha"), (3, None), (4, "delta")], "id long, t string")
    for block in (1, 50_000):
        assert rows(render.term_hits(terms, bodies, "t", 20, block)) == [(1, 1, 2), (1, 2, 1)]


def test_pipeline_resumes_and_retries(spark):
    items = spark.createDataFrame([("Enum", "A", "A"), ("Enum", "B", "B")], "entity_type string, full_name string, target string")
    stage = pipeline.Stage("s", "sys", pipeline.stub_checker, pipeline.stub_writer)
    first = pipeline.merged(spark.createDataFrame([], pipeline.RESULTS), pipeline.run_stage(items, spark.createDataFrame([], pipeline.RESULTS), stage)[0])
    assert {r.status for r in first.collect()} == {"Success"} and first.count() == 2
    assert pipeline.run_stage(items, first, stage)[0].count() == 0  # nothing is asked again
    assert pipeline.run_stage(items, first, stage, pipeline.Options(force=True))[0].count() == 2
    got = pipeline.statistics(first).first()
    assert (got.total, got.succeeded, got.failed, got.retries) == (2, 2, 0, 0)
    assert pipeline.statistics(first.limit(0)).first().hit_rate == 0


def test_one_item():
    answers = iter([("no tag", 1, 1), ("```xml\n<summary>x</summary>\n```", 1, 1), ("<summary>y</summary>", 1, 1)])
    checks = iter([("not json", 1, 1), ('{"valid": false, "reason": "bad"}', 1, 1), ('{"valid": true}', 1, 1)])
    stage = pipeline.Stage("s", "sys", lambda p, o: next(checks), lambda p, o: next(answers))
    got, calls = pipeline.process("t", stage, pipeline.Options(retries=5))
    assert (got["status"], got["content"], got["retries"], got["cache_hit"], len(calls)) == ("Success", "<summary>y</summary>", 2, False, 6)
    again, asked = pipeline.process("t", stage, pipeline.Options(retries=5), {c[0]: c[2:] for c in calls})  # retries and checks are known, too
    assert again["cache_hit"] and not asked and {k: again[k] for k in got if k not in ("cache_hit", "llm_ms")} == {k: got[k] for k in got if k not in ("cache_hit", "llm_ms")}
    never = pipeline.Stage("s", "sys", pipeline.stub_checker, lambda p, o: ("<summary>", 1, 1))
    assert pipeline.process("t", never, pipeline.Options(retries=2))[0]["status"] == "Failed"
    seen = []
    limits = pipeline.Stage("s", "sys", pipeline.stub_checker, lambda p, o: (seen.append((o.max_tokens, o.temperature)), ("<summary>a</summary>", 1, 1))[1])
    pipeline.process("t", limits, pipeline.Options(max_tokens=7, temperature="0.1"))
    assert seen == [(7, "0.1")]


def test_nothing_is_asked_twice(spark, tmp_path):
    log = str(tmp_path / "log")

    def writer(prompt, options):
        with open(log, "a") as f:
            f.write("w\n")
        time.sleep(0.01)
        return "<summary>" + prompt.splitlines()[-1] + "</summary>", 1, 1

    items = spark.createDataFrame([("Enum", f"N{k}", f"N{k}") for k in range(10)], "entity_type string, full_name string, target string")
    stages = [(pipeline.Stage(n, f"system of {n}", pipeline.stub_checker, writer), items) for n in "abc"]
    results, cache = pipeline.run(spark, stages)
    for _ in range(2):
        assert results.where("status = 'Success'").count() == 30 and cache.count() == 60
    assert len(open(log).readlines()) == 30 and pipeline.statistics(results).first().mean_ms >= 10
    forced, more = pipeline.run(spark, stages, results, pipeline.Options(force=True), cache)
    assert forced.where("cache_hit").count() == 30 and more.count() == 60 and len(open(log).readlines()) == 30


def test_stage_order():
    a, b = pipeline.Stage("a", "", None, None), pipeline.Stage("b", "", None, None, ("a",))
    pipeline.validate([a, b])
    with pytest.raises(ValueError):
        pipeline.validate([b, a])


def test_summaries():
    assert [pipeline.has_summary(x) for x in ("<summary>a</summary>", "<a><summary/></a>", "<summary>", "", None, "text <summary/> more", "a & b <summary/>")] == [True, False, False, False, False, True, False]


def test_changes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, note string")
    assert rows(K.insert(old, spark.createDataFrame([(3, "b"), (4, "c")], "id int, name string"), "name")) == [(1, "a", None), (2, "b", "x"), (4, "c", None)]
    for wrong in ([(3, "c"), (4, "c")], [(3, None)], [(3, "")]):
        with pytest.raises(K.DuplicateNames):
            K.insert(old, spark.createDataFrame(wrong, "id int, name string"), "name")
    assert rows(K.update(old, spark.createDataFrame([(1, "n"), (9, "q")], "id int, note string"))) == [(1, "a", "n"), (2, "b", "x")]
    assert rows(K.delete(old, spark.createDataFrame([(1,), (7,)], "id int"))) == [(2, "b", "x")]
    up = K.upsert(old, spark.createDataFrame([(2, "B", None), (5, "e", "z")], "id int, name string, note string"), ["id"], F.lit(0), ("note",))
    assert rows(up) == [(1, "a", None), (2, "B", "x"), (5, "e", "z")]
    K.save(old, str(tmp_path), "t")
    first = table(spark, str(tmp_path), "t")
    K.save(K.delete(first, spark.createDataFrame([(1,)], "id int")), str(tmp_path), "t")
    assert rows(table(spark, str(tmp_path), "t")) == [(2, "b", "x")] and len(rows(first)) == 2  # who reads the old version still has it
    K.save(old, str(tmp_path), "t")
    assert len(rows(table(spark, str(tmp_path), "t"))) == 2 and len(list(tmp_path.glob("t.*.version"))) == 2


def test_row_numbers(spark):
    r = random.Random(1)
    data = [(r.randrange(100), i) for i in range(500)]
    got = row_numbers(spark.createDataFrame(data, "a int, b int").repartition(5), ["a", "b"], "n").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.n)] == sorted(data) and sorted(x.n for x in got) == list(range(1, 501))
    assert row_numbers(spark.createDataFrame([], "a int"), ["a"], "n").collect() == []


def test_catalog_from_files(spark, tmp_path):
    (tmp_path / "a.h").write_text("/* 1 */\nstruct A;\n/* 2 */\nenum E\n{\n X = 1,\n};\n/* 3 */\nstruct T_vtbl<int>\n{\n A *a;\n};\n")
    (tmp_path / "b.h").write_text("/* 1 */\r\nstruct A : B\r\n{\r\n int x;\r\n};\r\n/* 2 */\r\nstruct E\r\n{\r\n int y;\r\n};\r\n/* 3 */\r\ntypedef A *PA;\r\n//----- (1F) ----\r\nint __cdecl A::go(int q)\r\n{\r\n}\r\n")
    made = listings.catalog_tables(listings.read_files(spark, str(tmp_path)))
    assert rows(made["types"].select("id", "stored_fully_qualified_name", "kind", "is_vtable")) == [(1, "T_vtbl<int>", "Struct", True), (2, "E", "Enum", False), (3, "A", "Struct", False)]
    assert rows(made["struct_members"].select("struct_id", "name", "type_string")) == [(1, "a", "A*"), (3, "x", "int")]
    assert rows(made["type_inheritances"].select("parent_type_id", "related_type_string")) == [(3, "B")]
    assert rows(made["typedefs"].select("name", "type_string")) == [("PA", "A *")]
    assert rows(made["function_bodies"].select("name", "owner", "offset")) == [("A::go", "A", 31)]


def test_text_to_layout(spark, tmp_path):
    (tmp_path / "a.h").write_text("/* 1 */\nstruct A\n{\n  char c;\n  int i;\n};\n/* 2 */\nstruct B : A\n{\n  A many[3];\n  A *p;\n  int (__cdecl *go)(A *self, const B *);\n  char z;\n};\n//----- (1F) ----\nvoid __thiscall B::run(B *this, A q)\n{\n}\n")
    (tmp_path / "s.txt").write_text("0000000140BA96E0 public: static A B::s_a 8 bytes [statics]\nnothing\n")
    made = listings.catalog_tables(listings.read_files(spark, str(tmp_path)))
    refs = resolution.resolve_references(made["type_references"], made["types"])
    bases = resolution.resolve_bases(made["type_inheritances"], made["types"])
    assert {(r.type_string, r.is_array, r.array_size): r.referenced_type_id for r in refs.collect() if "A" in r.type_string} == {("A", False, None): 1, ("A", True, 3): 1, ("A*", False, None): 1, **{(t, False, None): 1 for t in {r.type_string for r in refs.collect()} & {"A *"}}}
    assert rows(made["function_signatures"].select("origin", "name", "convention")) == [("Body", "B::run", "__thiscall"), ("Member", "go", "__cdecl")]
    assert {(r.name, r.position) for r in made["function_parameters"].collect()} == {("this", 0), ("q", 1), ("self", 0), ("__param2", 1)}
    assert all(r.type_reference_id is not None for r in made["function_parameters"].collect())
    assert rows(made["static_variables"].select("name", "parent_id")) == [("s_a", 2)]
    sizes = layout.type_sizes(made["types"], made["struct_members"], refs, bases)
    assert rows(sizes) == [(1, 8), (2, 8 + 24 + 4 + 4 + 4)]


def test_stream(spark, tmp_path):
    from orrery.streaming.results import arriving, keep_latest, loads_per_window

    source, kept = f"{tmp_path}/in", f"{tmp_path}/kept"
    for batch in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 3), (1, "old", 2), (3, None, 1)]):
        spark.createDataFrame(batch, "id int, v string, at int").write.mode("append").parquet(source)
        keep_latest(arriving(spark, source, "id int, v string, at int"), kept, "t", ["id"], "at", f"{tmp_path}/cp").awaitTermination()
    assert rows(table(spark, kept, "t")) == [(1, "c", 3), (2, "b", 1), (3, None, 1)]
    for f in (tmp_path / "kept").glob("t.*.version/*.parquet"):
        f.write_bytes(b"broken")
    spark.createDataFrame([(9, "z", 9)], "id int, v string, at int").write.mode("append").parquet(source)
    with pytest.raises(Exception):  # a table that can't be read is not taken for none
        keep_latest(arriving(spark, source, "id int, v string, at int"), kept, "t", ["id"], "at", f"{tmp_path}/cp").awaitTermination()
    timed = f"{tmp_path}/timed"
    spark.sql("SELECT timestamp_ntz'2025-01-01 03:00:00' AS at UNION ALL SELECT timestamp_ntz'2025-01-01 05:00:00' UNION ALL SELECT timestamp_ntz'2025-01-09 05:00:00'").write.parquet(timed)
    q = loads_per_window(arriving(spark, timed, "at timestamp_ntz"), "at").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]


def test_layout_is_the_same_in_one_task_and_in_levels(spark):
    # A chain of 300 structs, one long struct with many alignments, circles with what contains them, and structs of size 0.
    r = random.Random(2)
    types = [(k, f"T{k}", "Struct", r.choice([None, None, 8, 128]), f"T{k}") for k in range(340)]
    members = [member(k, "p", f"T{k - 1}", 0) for k in range(1, 300)] + [member(k, "c", r.choice(["char", "short", "double"]), 1) for k in range(1, 300, 2)]
    members += [member(300, f"m{k}", r.choice(["char", "short", "int", "double", "T7", "T9"]), k, alignment=r.choice([None, 2, 3, 128])) for k in range(80)]
    members += [member(a, f"e{k}", f"T{b}", k) for k, (a, b) in enumerate([(310, 311), (311, 312), (312, 310), (312, 313), (313, 314), (314, 313), (315, 310), (316, 315), (317, 317), (316, 330)])]
    t = spark.createDataFrame(types, "id int, base_name string, kind string, alignment int, stored_fully_qualified_name string")
    m = spark.createDataFrame([(k, *x) for k, x in enumerate(members)], MEMBERS)
    refs = spark.createDataFrame([], "id int, type_string string, referenced_type_id int, is_pointer boolean, is_array boolean, array_size int")
    bases = spark.createDataFrame([(0, 316, 300, 0)], "id int, parent_type_id int, related_type_id int, ord int")
    short = t.where("id >= 280"), m.where("struct_id >= 285")
    at_once = {x.id: x.size for x in layout.type_sizes(*short, refs, bases).collect()}
    assert at_once == {x.id: x.size for x in layout.type_sizes(*short, refs, bases, local=0).collect()}
    whole = {x.id: x.size for x in layout.type_sizes(t, m, refs, bases).collect()}

    def size(k, on=frozenset()):  # plain recursion
        at, most = 0, types[k][3] or 1
        for _, _, base, o in [(0, 316, 300, 0)] if k == 316 else []:
            align = types[base][3] or 4
            at, most = at + -at % align + size(base), max(most, align)
        for s, _, kind, _, _, _, align, _ in members:
            if s == k:
                n = {"char": 1, "short": 2, "int": 4, "double": 8}.get(kind)
                if n is None:
                    other = int(kind[1:])
                    ring = [c for c in ({310, 311, 312}, {313, 314}, {317}) if k in c and other in c]
                    n = 4 if ring else size(other)
                align = align or (1 if n <= 1 else 2 if n <= 2 else 4)
                at = (at + -at % align if align > 1 else at) + n
                most = max(most, align)
        return at + -at % most

    import sys

    sys.setrecursionlimit(10_000)
    assert all(whole[k] == size(k) for k in range(340))
