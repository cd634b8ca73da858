"""Operators whose inputs the test tables don't have, on small inputs written here; the SQL states the results they have to give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.functions.target import mapped
from orrery.operators import layout, pipeline, render, resolution, rules
from orrery.sources import listings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture(name: str, columns: str, *expected: tuple):
    """A query and the rows it has to give."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    def add(f: Callable[[SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, _: f(spark)
        ORACLES[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in expected)}) AS t({', '.join(f'"{c}"' for c in columns.split(', '))})"
        return f

    return add


def _texts(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "file string, text string")


_STRUCT = "/* 5565 */\nstruct __cppobj UIElement_Scrollable\n{\n int m_iScrollableWidth;\n  int m_iScrollableHeight;\n};\n"
_VTABLE = "/* 2641 */\nstruct /*VFT*/ Archive_vtbl\n{\nvoid (__thiscall *InitForPacking)(Archive *this, const Initializer *, const SmartBuffer *);\nvoid (__thiscall *InitForPacking)(Archive *this, const SmartBuffer *);\n};\n"
_members = lambda spark, *t: listings.definitions(_texts(spark, *t)).select("full_name", F.explode("members").alias("m"))

fixture("fx_parse3_members", "full_name, name, decl_order", ("UIElement_Scrollable", "m_iScrollableWidth", 0), ("UIElement_Scrollable", "m_iScrollableHeight", 1))(lambda s: _members(s, _STRUCT).select("full_name", "m.name", "m.decl_order"))
fixture("fx_w1_overloads", "name, overload_index, parameters", ("InitForPacking", 0, 3), ("InitForPacking", 1, 2))(lambda s: _members(s, _VTABLE).select("m.name", "m.overload_index", F.size("m.parameters").alias("parameters")))
fixture("fx_parse4_padding", "name, type_string, is_array, array_size", ("__padding0", "_BYTE", True, 4))(lambda s: _members(s, "/* 1 */\nstruct A\n{\n_BYTE[4];\n};\n").select("m.name", "m.type_string", "m.is_array", "m.array_size"))
fixture("fx_parse2_bases", "bases, members", ("CUnknown,IBaseFilter", 0))(
    lambda s: listings.definitions(_texts(s, "/* 1 */\nstruct TestStruct\n{\n CUnknown baseclass_0;\n IBaseFilter baseclass_c;\n};\n")).select(F.array_join("bases", ",").alias("bases"), F.size("members").alias("members"))
)
fixture("fx_parse7_enums", "full_name, is_bitmask, n", ("MyBitmask", True, 2), ("Plain", False, 3))(
    lambda s: listings.definitions(_texts(s, "/* 1 */\nenum __bitmask MyBitmask\n{\n Flag1 = 1,\n Flag2 = 2\n};\n/* 2 */\nenum Plain\n{\n A, B = 3,\n C\n};\n/* 3 */\nenum Gone;\n")).select("full_name", "is_bitmask", F.size("values").alias("n"))
)
fixture("fx_parse9_typedefs", "name, refers_to", ("flowqueueInterval_t", "unsigned __int16"), ("RPC_IF_HANDLE", "void *"), ("PHKEY", "HKEY__ **"), ("FARPROC", "int (__stdcall *)()"))(
    lambda s: listings.definitions(_texts(s, "".join(f"/* 1 */\n{t}\n" for t in ("typedef unsigned __int16 flowqueueInterval_t;", "typedef void *RPC_IF_HANDLE;", "typedef HKEY__ **PHKEY;", "typedef int (__stdcall *FARPROC)();")))).select("name", "refers_to")
)
fixture("fx_w7_first_definitions", "full_name, members", ("ClientMain", 1), ("AMesh", 1), ("E", 0))(
    lambda s: listings.first_definitions(
        listings.definitions(_texts(s, "/* 1 */\nstruct ClientMain;\n/* 2 */\nstruct AMesh\n{\n int a;\n};\n/* 3 */\nenum E\n{\n X\n};\n", "/* 1 */\nstruct ClientMain\n{\n int b;\n};\n/* 2 */\nstruct AMesh;\n/* 3 */\nstruct E\n{\n int c;\n};\n"))
    ).select("full_name", F.size("members").alias("members"))
)
fixture("fx_parse10_functions", "name, convention, parameters, offset", ("_E1281_0", "", 0, 0x6CF720), ("A::Handle", "__thiscall", 3, 0x559090))(
    lambda s: _texts(s, "//----- (006CF720) ----\nint _E1281_0()\n{\n}\n//----- (00559090) ----\nint __thiscall A::Handle(\n A *this,\n unsigned char w,\n IDClass<_tagDataID,32,0> val)\n{\n}\n")
    .select(F.explode(listings.functions_of(F.col("text"))).alias("f"))
    .select("f.name", "f.convention", F.size("f.parameters").alias("parameters"), "f.offset")
)
fixture("fx_parse13_parameters", "list, names", ("int x, float x, double x", "x_1,x_2,x_3"), ("int a, float b, double a", "a_1,b,a_2"), ("const F *, const F *", "__param1,__param2"), ("void (__cdecl *cb)(int), Map<int,int> m", "cb,m"))(
    lambda s: s.createDataFrame([("int x, float x, double x",), ("int a, float b, double a",), ("const F *, const F *",), ("void (__cdecl *cb)(int), Map<int,int> m",)], "list string").select("list", F.array_join(F.transform(listings.parameters_of(F.col("list")), lambda p: p["name"]), ",").alias("names"))
)
fixture("fx_x26_references", "type_string, fully_qualified_type, is_const, is_pointer", ("N::T<int, double>", "N::T<int,double>", False, False), ("const N::T<int>*", "N::T<int>", True, True))(
    lambda s: s.createDataFrame([("N::T<int,  double>",), ("const N::T<int> *",)], "t string").select(listings.references_of(F.col("t")).alias("r")).select("r.type_string", "r.fully_qualified_type", "r.is_const", "r.is_pointer")
)
fixture("fx_parse11_statics", "name, type_string", ("Base::m_cObjects", "int"), ("Render::m_vec", "std::vector<int>"), ("GlobalName", "char*"))(
    lambda s: s.createDataFrame(
        [(f"0000000140BA96E0 public: static {t} 8 bytes [statics]",) for t in ("int Base::m_cObjects", "const S::`vftable' S::vftable", "std::vector<int> Render::m_vec", "char * GlobalName")], "line string"
    ).select(F.explode(listings.statics_of(F.col("line"))).alias("v")).select("v.name", "v.type_string")
)
fixture("fx_j22_static_definitions", "name, file, line", ("Render::s_rate", "a.c", 1), ("s_plain", "b.c", 2))(
    lambda s: resolution.static_definitions(
        s.createDataFrame([("Render::s_rate",), ("s_plain",), ("inner",)], "name string"),
        s.createDataFrame([("a.c", 1, "float Render::s_rate = 1;"), ("a.c", 2, " int inner = 1;"), ("b.c", 1, "float Render::s_rate = 2;"), ("b.c", 2, "int s_plain=3;")], "file string, line int, text string"),
    ).select("name", "file", "line")
)
fixture("fx_j13_static_owners", "name, parent_id", ("s_rate", 5), ("Free::x", None), ("plain", None))(
    lambda s: resolution.static_owners(s.createDataFrame([("Render::s_rate",), ("Free::x",), ("plain",)], "name string"), s.createDataFrame([(5, "Render")], "id int, stored_fully_qualified_name string")).select("name", "parent_id")
)
_TYPEDEFS = [(1, "A", "", "B *"), (2, "B", "", "const N::T"), (3, "X", "", "Y"), (4, "Y", "", "X"), (5, "U", "ns", "A"), (6, "U", "", "N::T")]
fixture("fx_g1_typedef_chains", "name, type_id, depth", ("A", 1, 2), ("B", 1, 1), ("X", None, None), ("Y", None, None), ("U", 1, 1))(
    lambda s: resolution.typedef_targets(s.createDataFrame(_TYPEDEFS, "id int, name string, namespace string, type_string string"), s.createDataFrame([(1, "N::T")], "id int, stored_fully_qualified_name string"))
)
fixture("fx_j19_typedef_by_name", "text, id", ("U", 6), ("ns::U", 5), ("A", 1))(
    lambda s: resolution.typedef_by_name(s.createDataFrame(_TYPEDEFS, "id int, name string, namespace string, type_string string"), s.createDataFrame([("U",), ("ns::U",), ("A",), ("none",)], "text string"))
)
fixture("fx_j16_arguments", "id, type_reference_id", (1, 1), (2, 8), (3, 8), (4, None))(
    lambda s: resolution.register_arguments(s.createDataFrame([(1, "A"), (2, "C *"), (3, "C  *"), (4, "int")], "id int, type_string string"), s.createDataFrame([(1, "A"), (7, "B")], "id int, type_string string"))[0].select("id", "type_reference_id")
)
fixture("fx_y2_layout", "struct_id, id, member_offset", (1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 3, 0), (2, 4, 4), (2, 5, 4), (3, 6, 8))(
    lambda s: layout.fold_offsets(
        s.createDataFrame([(1, 0, 0, 4, 4, 1, 0), (1, 1, 1, 4, 4, 1, 0), (1, 2, 2, 4, 4, 1, 0), (2, 3, 0, 4, 4, None, 0), (2, 4, 1, 4, 4, 1, 0), (2, 5, 2, 4, 4, 1, 0), (3, 6, 0, 2, 2, None, 8)], "struct_id int, id int, decl_order int, size int, align int, bit_width int, base_size int")
    ).select("struct_id", "id", F.col("member_offset").cast("int").alias("member_offset"))
)
fixture(
    "fx_f14_default_lists", "name, ignored", ("CMsgBox", True), ("IXMLHttp", True), ("ResourceBag", True), ("SerializationBehaviorX", True), ("CHid", True), ("Value_", True), ("x_tag", True), ("_com_error", True), ("LIST_ENTRY32", True),
    ("CEmoteTable", False), ("IObjectFactory", False), ("_ULARGE_INTEGER", False), ("D3DPolyRender", False), ("tWAVEFORMATEX", False), ("tWAVEFORMATEXTENSIBLE", True), ("Player", False), ("cmsg", False), ("", False),
)(lambda s: s.createDataFrame([(n,) for n in ("CMsgBox", "IXMLHttp", "ResourceBag", "SerializationBehaviorX", "CHid", "Value_", "x_tag", "_com_error", "LIST_ENTRY32", "CEmoteTable", "IObjectFactory", "_ULARGE_INTEGER", "D3DPolyRender", "tWAVEFORMATEX", "tWAVEFORMATEXTENSIBLE", "Player", "cmsg", "")], "name string").select("name", S.should_ignore(F.col("name")).alias("ignored")))
_FILED = [(1, "Struct", "", "DArray<int>", ""), (2, "Struct", "N", "N::Child", "struct Child : DBObj {};"), (3, "Struct", "A::B", "A::B::Plain", "/* 1 */\nstruct Plain\n{\n  int GetSubDataIDs;\n};\n"), (4, "Class", "", "CameraSet", ""), (5, "Struct", "X::Y", "X::Y::Own", None), (6, "Struct", "", "DBObj", None), (7, "Enum", "", "DBUpdateType", None), (8, "Struct", "P::Q", "P::Q::PropertyBag", None)]
fixture("fx_j31_default_rules", "id, path, file_name", (1, "Lib/Templates", None), (2, "Dats/DBObjs/N", None), (3, "Dats/Types/A/B", None), (4, "Rendering/Camera", None), (5, "X/Y", None), (6, "Dats/DBObjs", None), (7, "Dats", "DBUpdateType"), (8, "Game/Properties/P/Q", None))(
    lambda s: rules.locations(s.createDataFrame([(*r, False) for r in _FILED], "id int, kind string, namespace string, stored_fully_qualified_name string, source string, is_ignored boolean"), s.createDataFrame([(2, 6)], "child long, parent long")).select("id", "path", "file_name")
)
fixture("fx_x37_located", "path", ("Lib/a/b",), ("Lib",), ("Lib/b",), ("a/b",))(
    lambda s: s.createDataFrame([("Lib/", "a::b", "KeepAll", 0), ("Lib/", "a::b", "StripAll", 0), ("Lib", "a::b", "StripNLevels", 1), ("", "a::b", "KeepAll", 0)], "p string, n string, b string, s int").select(S.located(F.col("p"), F.col("n"), F.col("b"), F.col("s")).alias("path"))
)
fixture("fx_j31_first_rule", "id, rule, path", (1, 0, "M/N"), (2, 1, "Cam"), (3, None, "P/Q"))(
    lambda s: rules.locations(
        s.createDataFrame([(1, "Struct", "N", "N::Camera", "int GetIt;"), (2, "Struct", "", "Camera", "int x;"), (3, "Enum", "P::Q", "P::Q::E", None)], "id int, kind string, namespace string, stored_fully_qualified_name string, source string"),
        None, (rules.Rule("member", "getit", "M/"), rules.Rule("name", "camera", "Cam/", "StripAll")),
    ).select("id", "rule", "path")
)
fixture("fx_x35_remap", "t, text", ("_BYTE*", "byte*"), ("Array<unsigned int>", "Array<uint32_t>"), ("_BYTES_RECEIVED", "_BYTES_RECEIVED"))(lambda s: s.createDataFrame([("_BYTE*",), ("Array<unsigned int>",), ("_BYTES_RECEIVED",)], "t string").select("t", S.remap(F.col("t")).alias("text")))
fixture("fx_x29_targets", "t, target", ("int", "int"), ("void*", "System.IntPtr"), ("Array<int,10,4>", "Bindings.Array__int"), ("Foo<Bar<int, 5>, 10>", "Bindings.Foo___Bar__int"), ("T$x", "Bindings.T_x"), ("H<void*, int, 0>", "Bindings.H__void_ptr__int"))(
    lambda s: s.createDataFrame([("int",), ("void*",), ("Array<int,10,4>",), ("Foo<Bar<int, 5>, 10>",), ("T$x",), ("H<void*, int, 0>",)], "t string").select("t", mapped(F.col("t")).alias("target"))
)
_VALUES = [(1, 0, "A", "0x0"), (1, 1, "B", "300"), (2, 0, "C", "-1"), (3, 0, "D", "0x7FFFFFFF"), (4, 0, "E", "text")]
fixture("fx_a7_widths", "enum_id, width", (1, "ushort"), (2, "sbyte"), (3, "uint"), (4, "byte"))(lambda s: render.enum_widths(s.createDataFrame(_VALUES, "enum_id int, position int, name string, value string")))
fixture("fx_c2_enum_text", "id, content", (1, "enum __bitmask N::E\n{\n    A = 0x0,\n    B = 300,\n};"))(
    lambda s: render.enum_texts(s.createDataFrame([(1, "N::E", True)], "id int, full_name string, is_bitmask boolean"), s.createDataFrame(_VALUES[:2], "enum_id int, position int, name string, value string"))
)
fixture("fx_c3_struct_text", "id, content", (1, "struct A : B, C\n{\n    /* 0x000 */ int32_t x[3];\n    uint32_t y : 2;\n    void (__thiscall *go)(A *);\n};"))(
    lambda s: render.struct_texts(
        s.createDataFrame([(1, "A", "struct A", None)], "id int, full_name string, source string, alignment int"),
        s.createDataFrame([(1, 1, 0, "x", "int", True, 3, None, False, "", "", 0), (1, 2, 1, "y", "unsigned int", False, None, 2, False, "", "", None), (1, 3, 2, "go", "void", False, None, None, True, "A *", "__thiscall", None)], "struct_id int, id int, decl_order int, name string, type_string string, is_array boolean, array_size int, bit_width int, is_function_pointer boolean, parameters string, convention string, member_offset int"),
        s.createDataFrame([(1, 1, 1, "C"), (2, 1, 0, "B")], "id int, parent_type_id int, ord int, related_type_string string"),
    )
)
fixture("fx_j30_comments", "full_name, content", ("A", "/// one\n/// two\nstruct A;"), ("B", "struct B;"))(
    lambda s: render.with_comments(s.createDataFrame([(1, "A", "struct A;"), (2, "B", "struct B;")], "id int, full_name string, content string"), s.createDataFrame([("A", "one\ntwo")], "full_name string, comment string")).select("full_name", "content")
)
fixture("fx_j34_helpers", "path, file, content", ("Lib", "E.cs", "mine"), ("Lib", "F.cs", "made"), ("Manual", "a__b.cs", "left"))(
    lambda s: render.with_helpers(s.createDataFrame([("Lib", "E.cs", "made"), ("Lib", "F.cs", "made")], "path string, file string, content string"), s.createDataFrame([("E", "mine"), ("a::b", "left")], "name string, content string"))
)


def _pipeline(s: SparkSession) -> tuple[DataFrame, DataFrame, pipeline.Stage]:
    items = s.createDataFrame([("Enum", "A", "A"), ("Enum", "B", "B")], "entity_type string, full_name string, target string")
    done = s.createDataFrame([("s", "Enum", "A", "Success", "<summary>old</summary>", 0, 1, 1, 5, False), ("s", "Enum", "B", "Failed", None, 4, 1, 1, 5, False)], pipeline.RESULTS)
    return items, done, pipeline.Stage("s", "sys", pipeline.stub_checker, pipeline.stub_writer)


fixture("fx_j17_pending", "full_name", ("B",))(lambda s: pipeline.pending(_pipeline(s)[0], _pipeline(s)[1], "s").select("full_name"))
fixture("fx_k5_resumed", "full_name, status, content", ("A", "Success", "<summary>old</summary>"), ("B", "Success", "<summary>B</summary>"))(
    lambda s: pipeline.merged(_pipeline(s)[1], pipeline.run_stage(_pipeline(s)[0], _pipeline(s)[1], _pipeline(s)[2])[0]).select("full_name", "status", "content")
)
fixture("fx_x41_summaries", "t, ok", ("<summary>a</summary>", True), ("<a><summary/></a>", False), ("<summary>", False), ("", False))(
    lambda s: s.createDataFrame([("<summary>a</summary>",), ("<a><summary/></a>",), ("<summary>",), ("",)], "t string").select("t", F.udf(pipeline.has_summary, "boolean", useArrow=True)("t").alias("ok"))
)
fixture("fx_x40_verdicts", "t, valid", ('x {"valid": true, "reason": "r"} y', True), ('{"valid": false}', False), ("none", None), ("{broken", None))(
    lambda s: s.createDataFrame([('x {"valid": true, "reason": "r"} y',), ('{"valid": false}',), ("none",), ("{broken",)], "t string").select("t", S.verdict(F.col("t"))["valid"].alias("valid"))
)
