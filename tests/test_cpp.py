import pytest

from orrery.functions import cpp
from orrery.functions.target import map_static_pointer, map_type


def one(text):
    return cpp.parse_definitions(text)[0]


def test_struct():
    d = one("/* 5565 */\nstruct __cppobj UIElement_Scrollable\n{\n int m_iScrollableWidth;\n  int m_iScrollableHeight;\n};")
    assert (d.kind, d.name, [(m.name, m.order) for m in d.members]) == ("Struct", "UIElement_Scrollable", [("m_iScrollableWidth", 0), ("m_iScrollableHeight", 1)])


def test_enums():
    d = one("/* 139 */\nenum URLZONEREG\n{\n  URLZONEREG_DEFAULT = 0x0,\n  URLZONEREG_HKLM = 0x1,\n  URLZONEREG_HKCU = 0x2,\n};")
    assert d.values == [("URLZONEREG_DEFAULT", "0x0", 3), ("URLZONEREG_HKLM", "0x1", 4), ("URLZONEREG_HKCU", "0x2", 5)] and not d.bitmask
    d = one("/* 1 */\nenum __bitmask MyBitmask\n{\n Flag1 = 1,\n Flag2 = 2\n};")
    assert d.name == "MyBitmask" and d.bitmask and len(d.values) == 2
    assert cpp.parse_definitions("/* 1 */\nenum Forward;") == cpp.parse_definitions("/* 1 */\n  enum Indented\n{ A };") == []


@pytest.mark.parametrize(
    "texts,member",
    [
        (["struct ClientMain;", "struct ClientMain\n{\n int adjectives;\n};"], "adjectives"),
        (["struct AMesh\n{\n int dispCatchObj;\n};", "struct AMesh;"], "dispCatchObj"),
        (["struct ClientMain\n{\n int adjectives;\n};", "struct ClientMain\n{\n int other_field;\n};"], "adjectives"),
    ],
)
def test_forward_declarations(texts, member):
    kept = cpp.first_definitions([("a.h", "".join(f"/* {k} */\n{t}\n" for k, t in enumerate(texts)))])
    assert [[m.name for m in d.members] for _, d in kept] == [[member]]


def test_overloads():
    d = one("/* 2641 */\nstruct /*VFT*/ AutoStoreVersionArchive_vtbl\n{\nvoid (__thiscall *InitForPacking)(Archive *this, const ArchiveInitializer *, const SmartBuffer *);\nvoid (__thiscall *InitForPacking)(AutoStoreVersionArchive *this, const SmartBuffer *);\n};")
    assert [(m.name, m.overload, len(m.signature.parameters)) for m in d.members] == [("InitForPacking", 0, 3), ("InitForPacking", 1, 2)]


def test_bases():
    d = one("/* 1 */\nstruct TestStruct\n{\nCUnknown baseclass_0;\n IBaseFilter baseclass_c;\n int x;\n};")
    assert d.bases == ["CUnknown", "IBaseFilter"] and [(m.name, m.order) for m in d.members] == [("x", 2)]
    d = one("/* 1 */\nstruct __declspec(align(8)) N::A<B<int>, 3> : N::B<int, C *>, D\n{\n};")
    assert (d.full_name, d.bases, d.alignment) == ("N::A<B<int>,3>", ["B", "D"], 8)


def test_padding_and_offsets():
    m = cpp.parse_member("_BYTE[4];", 3)
    assert (m.name, m.type_string, m.array, m.array_size) == ("__padding3", "_BYTE", True, 4)
    assert cpp.parse_member("/* 0x1C */ int x;").offset == 28 and cpp.parse_member("/* 12 */ int x;").offset == 12


@pytest.mark.parametrize(
    "line,name,kind,pointers,bits,array",
    [
        ("unsigned __int32 x : 3;", "x", "unsigned __int32", 0, 3, None),
        ("const Foo<int, Bar *> **p[3]; // note", "p", "const Foo<int, Bar*>**", 2, None, 3),
        ("struct Vec v;", "v", "Vec", 0, None, None),
        ("A * const q;", "q", "A*", 1, None, None),
        ("__declspec(align(16)) float m;", "m", "float", 0, None, None),
    ],
)
def test_members(line, name, kind, pointers, bits, array):
    m = cpp.parse_member(line)
    assert (m.name, m.type_string, m.pointers, m.bits, m.array_size) == (name, kind, pointers, bits, array)


def test_not_members():
    assert [cpp.parse_member(x) for x in ("int x", "int x = 3;", "};", "", "// int x;")] == [None] * 5


def test_function_pointer_that_returns_one():
    s = cpp.parse_function_pointer("int (__cdecl *(__thiscall *get)(A *this, int n))(char, float q)")
    assert (s.name, s.convention, len(s.parameters)) == ("get", "__thiscall", 2)
    assert (s.returned.name, s.returned.convention, s.returned.returns, [p.type for p in s.returned.parameters]) == ("__return_sig_get", "__cdecl", "int", ["char", "float"])


@pytest.mark.parametrize("text,name", [("operator<<=", "operator<<"), ("operator==", "operator=="), ("operator()", "operator()"), ("operator new", "operatornew"), ("operator-", "operator-")])
def test_operators(text, name):
    assert cpp.operator_name(text) == name


@pytest.mark.parametrize(
    "line,name,refers,convention",
    [
        ("typedef unsigned __int16 flowqueueInterval_t;", "flowqueueInterval_t", "unsigned __int16", None),
        ("typedef void *RPC_IF_HANDLE;", "RPC_IF_HANDLE", "void *", None),
        ("typedef HKEY__ **PHKEY;", "PHKEY", "HKEY__ **", None),
        ("typedef int (__stdcall *FARPROC)();", "FARPROC", "int (__stdcall *)()", "__stdcall"),
        ("typedef void __cdecl HANDLER(int a, char *b);", "HANDLER", "void __cdecl (int a, char *b)", "__cdecl"),
    ],
)
def test_typedefs(line, name, refers, convention):
    d = cpp.parse_typedef(line)
    assert (d.name, d.refers_to, d.signature.convention if d.signature else None) == (name, refers, convention)


def test_functions():
    text = "//----- (006CF720) ----\nint _E1281_0()\n{\n  return 1;\n}\n//----- (00559090) ----\n\nint __thiscall A::B(\n  A *this,\n  unsigned char w,\n  IDClass<_tagDataID,32,0> val)\n{\n  if ( w ) { }\n}\n//----- (1) ----\n#error gone\n//----- (2) ----\nvoid `deleting destructor'()\n{\n}\n//----- (3) ----\nvoid open()\n{"
    a, b = cpp.parse_functions(text)
    assert (a.signature.name, a.signature.returns, a.signature.convention, a.signature.parameters, a.offset, a.line) == ("_E1281_0", "int", "", [], 0x6CF720, 1)
    assert (b.signature.normalized, b.owner, b.signature.parameters[0].name, b.signature.parameters[2].name) == ("int __thiscall A::B(A*,unsigned char,IDClass<_tagDataID,32,0>)", "A", "this", "val")


@pytest.mark.parametrize(
    "text,names",
    [
        ("const _FILETIME *, const _FILETIME *, const _FILETIME *", ["__param1", "__param2", "__param3"]),
        ("int x, float x, double x", ["x_1", "x_2", "x_3"]),
        ("int x, float y, double z", ["x", "y", "z"]),
        ("int a, float b, double a", ["a_1", "b", "a_2"]),
        ("void (__cdecl *cb)(int, char), Map<int,int> m, A *const", ["cb", "m", "__param3"]),
        ("", []),
    ],
)
def test_parameters(text, names):
    assert [p.name for p in cpp.parse_parameters(text)] == names


@pytest.mark.parametrize(
    "text,full,const,pointer",
    [
        ("MyNamespace::MyTemplate<int, double>", "MyNamespace::MyTemplate<int,double>", False, False),
        ("const MyNamespace::MyTemplate<int>*", "MyNamespace::MyTemplate<int>", True, True),
        ("std::vector<std::pair<int, std::string>>", "std::vector<std::pair<int,std::string>>", False, False),
    ],
)
def test_references(text, full, const, pointer):
    r = cpp.reference(text)
    assert (r["fully_qualified_type"], r["is_const"], r["is_pointer"]) == (full, const, pointer)


@pytest.mark.parametrize(
    "line,name,kind",
    [
        ("0000000140BA96E0 public: static int CBaseObject::m_cObjects 4 bytes [statics]", "CBaseObject::m_cObjects", "int"),
        ("0000000140BA96E0 public: static std::vector<int> Render::m_vec 24 bytes [statics]", "Render::m_vec", "std::vector<int>"),
        ("0000000140BA96E0 public: static char * GlobalName 8 bytes [statics]", "GlobalName", "char*"),
        ("0000000140BA96E0 alone 8 bytes [statics]", "alone", "int"),
    ],
)
def test_statics(line, name, kind):
    assert cpp.parse_static(line)[1:3] == (name, kind)


def test_no_statics():
    assert [cpp.parse_static(x) for x in ("0000000140BA96E0 public: static const S::`vftable' S::vftable 8 bytes [statics]", "", "text")] == [None] * 3


def test_static_values():
    assert cpp.static_value(["float Render::s_rDegradeDistance = 50.0;"], 0, 34) == "50.0"
    assert cpp.static_value(["Vector3 Render::object_scale_vec = {", "  1.0,", "  1.0,", "  1.0", "};"], 0, 34) == "{ 1.0, 1.0, 1.0 }"
    assert cpp.static_value(["Position p = { &Position::`vftable', 0 };"], 0, 12).startswith("{ nullptr /*")
    assert cpp.static_value(["void* thing = &off_79F0E8;"], 0, 13) == "nullptr /* &off_79F0E8 */"
    assert cpp.static_value(['char *s = "a;b\\";c"; // d;'], 0, 9) == '"a;b\\";c"'


@pytest.mark.parametrize(
    "text,target",
    [
        ("int", "int"), ("void*", "System.IntPtr"), ("PrimitiveInplaceArray<int,10,4>", "Bindings.PrimitiveInplaceArray__int"), ("Foo<Bar<int, 5>, 10>", "Bindings.Foo___Bar__int"),
        ("Type$With$Dollars", "Bindings.Type_With_Dollars"), ("HashTable<void*, int, 0>", "Bindings.HashTable__void_ptr__int"), ("const A::B *", "Bindings.A.B*"), ("unsigned char **", "byte**"), ("A&", "void*"),
        ("int (__cdecl *)(char)", "System.IntPtr"), ("", "void"), (None, "void"), ("Q<8,unsigned long>::ctx", "Bindings.Q__uint.ctx"),
    ],
)
def test_targets(text, target):
    assert map_type(text) == target


def test_unknown_pointers():
    assert map_type("Unknown*", known=False) == "System.IntPtr" and map_type("const int*", known=False) == "int*" and map_type("A*", known=True) == "Bindings.A*"
    assert map_static_pointer("int") == "int*" and map_static_pointer("") == "void*" and map_static_pointer("A*", known=False) == "System.IntPtr"


def test_member_names():
    assert cpp.member_names("int a;\nFoo* b[3];\nvoid go(int x);\nint (__thiscall *cb)(A *);\nint a;") == ["a", "b", "go", "cb"]


def test_odd_texts():
    for text in ("", "/* 1 */", "/* 1 */\nstruct", "/* 1 */\nstruct {", "}" * 1000, "/* 1 */\nunion\n{\n", "/* 1 */\ntypedef ", "(" * 500, "/* 1 */\nstruct A\n{\n" + "int x;\n" * 5000 + "};"):
        cpp.parse_definitions(text), cpp.parse_functions(text), cpp.parse_type(text), cpp.parse_parameters(text), cpp.parse_signature(text), cpp.member_names(text)
