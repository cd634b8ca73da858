"""Reading C++ declarations as a decompiler prints them.

Plain Python without Spark: a bracket-aware text is cut at its top level, and everything else follows from that.  The classes
carry what a catalog stores.  See ``sources.listings`` for how whole files are read in parallel.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from orrery.functions.fixed import DEFINITION_MARK, FUNCTION_MARK, STATIC_LINE, TYPE_WORDS

_PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}
_CONVENTION = re.compile(r"\b__(?:thiscall|stdcall|cdecl|fastcall)\b")
_OPERATOR = re.compile(r"\boperator\s*(\(\)|\[\]|->\*?|<<=?|>>=?|<=|>=|[-+*/%^&|=!<>]=?|\+\+|--|,)")
_WORDS = frozenset(TYPE_WORDS)


def strip_comments(text: str) -> str:
    return re.sub(r"//[^\r\n]*", "", re.sub(r"/\*.*?\*/", "", text, flags=re.S))


def normalize(text: str) -> str:
    """One space between words, none before ``*``, ``&`` and ``>``."""
    return re.sub(r" (?=[*&>])", "", re.sub(r"\s+", " ", text)).strip()


def depths(text: str, brackets: str = "<>()[]{}") -> list[int]:
    """The depth of nesting of each character; brackets belong to what they enclose.  Names of operators don't nest."""
    masked = _OPERATOR.sub(lambda m: "_" * len(m.group()), text)
    out, depth = [], 0
    for c in masked:
        if c in brackets and c not in _PAIRS:
            depth += 1
        out.append(depth)
        if c in brackets and c in _PAIRS:
            depth -= 1
    return out


def split_top(text: str, separator: str = ",", brackets: str = "<>()[]") -> list[str]:
    """The parts of a text between separators outside of brackets; nothing for an empty last part."""
    at = depths(text, brackets)
    cuts = [i for i, c in enumerate(text) if c == separator and at[i] <= 0]
    parts = [text[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)])]
    return parts if parts[-1] else parts[:-1]


def opening(text: str, close: int) -> int:
    """The position of the parenthesis that the one at ``close`` closes; -1 if there is none."""
    masked = _OPERATOR.sub(lambda m: "_" * len(m.group()), text)
    depth = 0
    for i in range(close, -1, -1):
        depth += (masked[i] == ")") - (masked[i] == "(")
        if not depth and masked[i] == "(":
            return i
    return -1


def last_scope(name: str) -> int:
    """The position of the last ``::`` outside of template arguments; -1 if there is none."""
    at = depths(name, "<>")
    return max((m.start() for m in re.finditer("::", name) if at[m.start()] == 0), default=-1)


def base_type_name(text: str) -> str:
    """The bare name of a type: no ``*`` and ``&`` at the end, no leading const, no template arguments, no namespace."""
    text = re.sub(r"[*&\s]+$", "", text.strip()).removeprefix("const ").strip()
    if (at := text.find("<")) > 0:
        text = text[:at].strip()
    at = text.rfind("::")
    return text[at + 2 :] if 0 <= at < len(text) - 2 else text


@dataclass
class Type:
    text: str
    base: str = ""
    namespace: str = ""
    arguments: list[Type] = field(default_factory=list)
    const: bool = False
    volatile: bool = False
    pointers: int = 0
    reference: bool = False

    @property
    def name(self) -> str:
        """With template arguments and namespace."""
        arguments = ",".join(re.sub(r"\s*,\s*", ",", a.text) for a in self.arguments)
        own = f"{self.base}<{arguments}>" if arguments else self.base
        return f"{self.namespace}::{own}" if self.namespace else own

    def nodes(self, path: str = "0") -> list[tuple[str, str, str, int]]:
        """(path, text, base, pointers) of this type and all its arguments, however deep."""
        return [(path, self.text, self.base, self.pointers), *[n for k, a in enumerate(self.arguments) for n in a.nodes(f"{path}.{k}")]]


_LAST_QUALIFIER = re.compile(r"\s*\b(const|volatile)\s*$", re.I)


def parse_type(text: str) -> Type:
    text = strip_comments(text)
    out = Type(text if text.strip() else "")
    rest = text

    def qualifiers(rest: str) -> str:
        while m := _LAST_QUALIFIER.search(rest):
            out.const |= m[1].lower() == "const"
            out.volatile |= m[1].lower() == "volatile"
            rest = rest[: m.start()].strip()
        return rest

    if m := re.match(r"(const|volatile) ", rest, re.I):
        out.const, out.volatile = m[1].lower() == "const", m[1].lower() == "volatile"
        rest = rest[m.end() :].strip()
    rest = qualifiers(rest)
    stars = re.search(r"[\s*]*\*\s*$", rest)
    if stars:
        out.pointers = stars.group().count("*")
        rest = rest[: stars.start()].strip()
    elif rest.endswith("&"):
        out.reference, rest = True, rest[:-1].strip()
    rest = qualifiers(rest)
    scope = last_scope(rest)
    space, own = (rest[:scope], rest[scope + 2 :]) if scope > 0 else ("", rest)
    at = own.find("<")
    if at > 0:
        inside = depths(own, "<>")
        end = next((i for i in range(at + 1, len(own)) if own[i] == ">" and inside[i] == 1), -1)
        if end > 0:
            out.arguments = [parse_type(a.strip()) for a in split_top(own[at + 1 : end], ",", "<>")]
            own = own[:at] + own[end + 1 :]
        else:
            own = own[:at]
    out.base, out.namespace = own, space
    return out


def reference(text: str) -> dict:
    """The columns of a type reference."""
    text = normalize(text)
    t = parse_type(text)
    return {"type_string": text, "fully_qualified_type": t.name, "is_const": t.const, "is_pointer": t.pointers > 0, "is_reference": t.reference, "pointer_depth": t.pointers}


def eat_type(line: str) -> tuple[str, str]:
    """The type that a line begins with, and what follows it."""
    m = re.match(r"\s*((?:const |volatile )?)", line)
    at, inside = m.end(), depths(line, "<>")
    while at < len(line):
        c = line[at]
        if inside[at] > 0 or c.isalnum() or c in "_:$":
            at += 1
        elif m2 := re.match(r"\s*[*&](?:\s*[*&])*", line[at:]):
            at += m2.end()
            break
        else:
            break
    return re.sub(r" (?=[*>])", "", re.sub(r"\s+", " ", line[m.start(1) : at].rstrip())), line[at:].lstrip()


# Function pointers and parameters.


@dataclass
class Signature:
    name: str
    returns: str
    convention: str
    parameters: list[Parameter]
    returned: Signature | None = None

    @property
    def normalized(self) -> str:
        convention = f"{self.convention} " if self.convention else ""
        return f"{normalize(self.returns)} {convention}{self.name}({','.join(normalize(p.type) for p in self.parameters)})"


@dataclass
class Parameter:
    type: str
    name: str
    position: int
    pointers: int = 0
    const: bool = False
    signature: Signature | None = None


_POINTER_PARAMETER = re.compile(r"^(.+?)\s*\(\s*(__thiscall|__stdcall|__cdecl|__fastcall)?\s*(\*+)\s*(\w*)\s*\)\s*\((.*?)?\)$", re.S)


def is_function_pointer(parameter: str) -> bool:
    return bool(_POINTER_PARAMETER.match(parameter.strip()))


def _name_at_end(parameter: str) -> tuple[str, str]:
    """(type, name) of a parameter; the name is empty if the last word belongs to the type."""
    parameter = parameter.strip()
    core = re.sub(r"(?:\s|[*&]|\b(?:const|volatile)\b)+$", "", parameter, flags=re.I)
    m = re.search(r"(?:[\w~]|(?<=\w)::(?=[\w~]))+$", core)
    if not m:
        return parameter, ""
    word, before = m.group(), core[: m.start()].rstrip()
    own = word in _WORDS or word.startswith("__") or "::" in word or before.endswith("::")
    if own or all(p.lower() in ("const", "volatile", "struct", "enum", "union", "*", "&", "**") for p in before.split()):
        return parameter, ""
    return re.sub(r"\s+", " ", f"{before} {parameter[len(core):].strip()}".strip()).removeprefix("struct ").strip(), word


def parse_parameters(text: str, unique: bool = True) -> list[Parameter]:
    """The parameters of a list.  ``unique``: names that occur more than once get a running number."""
    out = []
    for k, part in enumerate(split_top(text)):
        part = re.sub(r"\bstruct\s+", "", part.strip())
        if not part:
            continue
        if m := _POINTER_PARAMETER.match(part):
            name = m[4] or (f"__param{k + 1}" if unique else f"__nested_funcptr{k + 1}")
            own = Signature(name, normalize(m[1]), m[2] or "", parse_parameters(m[5] or "", False))
            out.append(Parameter(part, name, k, len(m[3]), False, own))
            continue
        kind, name = _name_at_end(part)
        kind = normalize(kind)
        stars = re.search(r"[*\s]*$", kind).group().count("*")
        out.append(Parameter(kind, name or f"__param{k + 1}", k, stars, kind.lower().startswith("const ")))
    if unique:
        names = [p.name for p in out]
        for p_name in {n for n in names if names.count(n) > 1}:
            for number, p in enumerate([p for p in out if p.name == p_name], 1):
                p.name = f"{p_name}_{number}"
    return out


def operator_name(text: str) -> str:
    """``operator`` and its sign; signs of three characters are cut to two."""
    m = re.match(r"operator\s*(\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|<=|>=|==|!=|\+\+|--|\[\]|\(\)|->|[-+*/%&|^~!<>=]|\w+)", text)
    return f"operator{m[1]}" if m else text


def parse_function_pointer(text: str) -> Signature | None:
    """``R (cc *name)(params)`` or ``R (cc *(cc *name)(params))(params)``; None for anything else."""
    text = text.strip()
    if not text.endswith(")"):
        return None
    start = opening(text, len(text) - 1)
    if start < 0:
        return None
    parameters, before = text[start + 1 : -1].strip(), text[:start].rstrip()
    if not before.endswith(")"):
        return None
    inner_start = opening(before, len(before) - 1)
    if inner_start < 0:
        return None
    returns, inner = before[:inner_start].strip(), before[inner_start + 1 : -1].strip()
    if "*" not in inner:
        return None
    m = _CONVENTION.search(inner)
    convention = m.group() if m and inner.find("*") > m.start() else ""
    if convention:
        inner = (inner[: m.start()] + inner[m.end() :]).strip()
    inner = inner.removeprefix("*").strip()
    if inner.endswith(")") and "(" in inner and not inner.startswith("operator"):  # a pointer to a function that returns a pointer to a function
        own = parse_function_pointer(f"void {inner}")
        if own is None:
            return None
        outer = Signature(f"__return_sig_{own.name}", normalize(returns), convention, parse_parameters(parameters, False))
        return Signature(own.name, f"{returns} ({convention} *)({parameters})", own.convention, own.parameters, outer)
    name = operator_name(inner) if inner.startswith("operator") else (re.search(r"~?\w+$", inner.lstrip("* ")) or [""])[0]
    return Signature(name, normalize(returns), convention, parse_parameters(parameters)) if name else None


# Members, types, enums, typedefs.


@dataclass
class Member:
    name: str
    type_string: str
    order: int = 0
    overload: int = 0
    offset: int | None = None
    alignment: int | None = None
    bits: int | None = None
    array: bool = False
    array_size: int | None = None
    pointers: int = 0
    signature: Signature | None = None
    line: int | None = None


@dataclass
class Definition:
    kind: str
    name: str
    namespace: str
    source: str
    line: int
    arguments: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    members: list[Member] = field(default_factory=list)
    values: list[tuple[str, str, int]] = field(default_factory=list)
    alignment: int | None = None
    volatile: bool = False
    bitmask: bool = False
    signature: Signature | None = None
    refers_to: str = ""

    @property
    def full_name(self) -> str:
        own = f"{self.name}<{','.join(self.arguments)}>" if self.arguments else self.name
        return f"{self.namespace}::{own}" if self.namespace else own


_OFFSET = re.compile(r"/\*\s*(0[xX][0-9a-fA-F]+|[0-9]+)\s*\*/\s*")
_ALIGN = re.compile(r"__declspec\s*\(\s*align\s*\(\s*(\d+)\s*\)\s*\)")
_DECLSPEC = re.compile(r"__declspec\s*\((?:[^()]|\([^()]*\))*\)")
_BITS = re.compile(r"(\w+)\s*:\s*(\d+)\s*;?\s*$")
_PADDING = re.compile(r"^_BYTE\s*\[(\d+)\]\s*;")


def _number(text: str) -> int:
    return int(text, 16 if text[:2].lower() == "0x" else 10)


def parse_member(line: str, padding: int = 0) -> Member | None:
    """One member from its line, or None.  ``padding`` numbers members without a name."""
    line = line.strip()
    offset = _number(m[1]) if (m := _OFFSET.search(line)) else None
    if m := _PADDING.match(line):
        return Member(f"__padding{padding}", "_BYTE", offset=offset, array=True, array_size=int(m[1]))
    line = re.sub(r"\bstruct\s+", "", line)
    text = strip_comments(_OFFSET.sub("", line)).strip()
    if " *operator" not in line and (not text.endswith(";") or re.search(r"[={}]", text)):
        return None
    text = text.rstrip("; \t")
    alignment = int(m[1]) if (m := _ALIGN.search(text)) else None
    text = _ALIGN.sub("", text).strip()
    if own := parse_function_pointer(text):
        kind = own.returns if own.returned else re.sub(r"[*\s]+$", "", own.returns)
        return Member(own.name, kind, offset=offset, alignment=alignment, signature=own)
    bits = int(m[2]) if (m := _BITS.search(text)) else None
    if bits is not None:
        text = _BITS.sub(r"\1", text)
    array = re.search(r"\[(\d*)\]", text)
    plain = re.sub(r"[\s*]+$", "", re.sub(r"\[.*?\]", "", text))
    if not (m := re.search(r"\w+$", plain)):
        return None
    before = text[: text.rfind(m.group())].strip().removeprefix("struct ").strip()
    kind = before
    while q := _LAST_QUALIFIER.search(kind):
        kind = kind[: q.start()].strip()
    stars = re.search(r"[*\s]*$", kind).group().count("*")
    return Member(
        m.group(), normalize(kind), offset=offset, alignment=alignment, bits=bits, pointers=stars,
        array=array is not None, array_size=int(array[1]) if array and array[1] else None,
    )


def _body(lines: list[str], at: int) -> tuple[str, int]:
    """The source of the definition that begins at a line, and the number of lines it takes."""
    if ";" in lines[at]:
        return lines[at], 1
    depth = 0
    for k, line in enumerate(lines[at:]):
        depth += line.count("{") - line.count("}")
        if depth <= 0 and "}" in line:
            return "\n".join(lines[at : at + k + 1]), k + 1
    return "\n".join(lines[at:]), len(lines) - at


def _heading(line: str, keyword: str) -> str:
    for gone in (f"{keyword} ", "__cppobj", "/*VFT*/"):
        line = line.replace(gone, "")
    return _DECLSPEC.sub("", line).replace("__unaligned", "").replace("volatile ", "").strip()


def _members(out: Definition, lines: list[str], first: int) -> None:
    """Fills in the members of a struct or union; ``baseclass_<hex>`` members are bases."""
    start = next((i for i, line in enumerate(lines) if "{" in line), None)
    if start is None:
        return
    depth, end = 0, None
    for i in range(start, len(lines)):
        clean = strip_comments(lines[i]) if out.kind != "Union" else lines[i]
        depth += clean.count("{") - clean.count("}")
        if depth <= 0 and "}" in clean:
            end = i
            break
    if end is None:
        return
    seen: dict[str, int] = {}
    order = padding = 0
    for i in range(start + 1, end):
        line = lines[i].strip()
        if not line or "}" in line or line.startswith("//") or (line.startswith("/*") and line.endswith("*/") and ";" not in line):
            continue
        member = parse_member(line, padding)
        if member is None:
            continue
        padding += member.name == f"__padding{padding}"
        member.order, order = order, order + 1
        member.overload = seen.get(member.name, 0)
        seen[member.name] = member.overload + 1
        member.line = first + i
        if out.kind != "Union" and re.match(r"^baseclass_[0-9a-fA-F]+$", member.name):
            out.bases.append(member.type_string)
        else:
            out.members.append(member)


def _record(kind: str, source: str, line: int) -> Definition | None:
    word = "union" if kind == "Union" else "struct"
    lines = source.split("\n")
    heading = next((x for x in lines if re.search(rf"\b{word}\b", x)), "").strip()
    volatile = heading.startswith(f"volatile {word}")
    heading = heading.removeprefix("const ").removeprefix("volatile ")
    alignment = int(m[1]) if (m := _ALIGN.search(heading)) else None
    text, rest = eat_type(_heading(heading, word))
    t = parse_type(text)
    if not t.base:
        return None
    out = Definition(kind, t.base, t.namespace, source, line, [a.text for a in t.arguments], alignment=alignment if kind != "Union" else None, volatile=volatile)
    if rest.startswith(":"):
        rest = rest[1:].strip()
        while rest:
            base, rest = eat_type(rest)
            out.bases.append(parse_type(base).base)
            if not rest.startswith(","):
                break
            rest = rest[1:].strip()
    if "{" in source:
        _members(out, lines, line)
    return out


def _enum(source: str, line: int) -> Definition | None:
    if "{" not in source:
        return None
    heading = _heading(next((x for x in source.split("\n") if x.lstrip().startswith("enum")), ""), "enum")
    bitmask = "__bitmask" in heading
    t = parse_type(eat_type(heading.replace("__bitmask", "").strip())[0])
    if not t.base:
        return None
    out = Definition("Enum", t.base, t.namespace, source, line, bitmask=bitmask)
    start, end = source.find("{"), source.rfind("}")
    if end > start:
        at = start + 1
        for part in split_top(source[start + 1 : end], ",", "{}"):
            if m := re.match(r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=\s*(.*?))?\s*$", part, re.S):
                out.values.append((m[1], m[2] or "", line + source.count("\n", 0, at)))
            at += len(part) + 1
    return out


def parse_typedef(source: str, line: int = 0) -> Definition | None:
    """A simple typedef, one of a pointer to a function, or one of a function."""
    text = strip_comments(source).strip()
    if not text.startswith("typedef "):
        return None
    text = text.removeprefix("typedef ").strip().rstrip("; \t\r\n")
    if m := re.match(r"^(.+?)\s*\(\s*(__\w+)?\s*\*\s*(\w+)\s*\)\s*\((.*?)\)\s*$", text, re.S):
        own = Signature(m[3], m[1].strip(), m[2] or "", parse_parameters(m[4].strip(), False))
        return Definition("Typedef", m[3], "", source, line, signature=own, refers_to=f"{m[1].strip()} ({m[2] or ''} *)({m[4].strip()})")
    if m := re.match(r"^(.+?)\s+(__(?:cdecl|stdcall|thiscall|fastcall))\s+(\w+)\s*\(([^)]*)\)", text):
        own = Signature(m[3], m[1].strip(), m[2], parse_parameters(m[4].strip(), False))
        return Definition("Typedef", m[3], "", source, line, signature=own, refers_to=f"{m[1].strip()} {m[2]} ({m[4].strip()})")
    m = re.search(r"(\w+)$", text.rstrip("*& \t"))
    name = m.group() if m else text
    return Definition("Typedef", name, "", source, line, refers_to=text[: text.rfind(name)].strip())


def parse_definitions(text: str) -> list[Definition]:
    """Every struct, enum, union and typedef of a file, in this order of kinds, as the first of a name is the one that counts."""
    lines = re.split(r"\r?\n", text)
    found: dict[str, list[Definition]] = {"Struct": [], "Enum": [], "Union": [], "Typedef": []}
    at = 0
    while at < len(lines) - 1:
        if not re.search(DEFINITION_MARK, lines[at]):
            at += 1
            continue
        at += 1
        line = lines[at]
        source, _ = _body(lines, at)
        kind = made = None
        if line.lstrip().startswith("typedef "):
            end = next((k for k in range(at, len(lines)) if ";" in lines[k]), len(lines) - 1)
            kind, made = "Typedef", parse_typedef("\n".join(lines[at : end + 1]), at + 1)
        elif line.startswith("enum"):
            kind, made = "Enum", _enum(source, at + 1)
        elif re.search(r"\bstruct\b", line):
            kind, made = "Struct", _record("Struct", source, at + 1)
        elif re.search(r"\bunion\b", line):
            kind, made = "Union", _record("Union", source, at + 1)
        if made:
            found[kind].append(made)
        at += 1
    return [d for ds in found.values() for d in ds]


def first_definitions(files: list[tuple[str, str]]) -> list[tuple[str, Definition]]:
    """Of several files in order, the first definition of each name; a struct that was only declared gives way to one with members."""
    kept: dict[str, tuple[str, Definition]] = {}
    for file, text in files:
        for d in parse_definitions(text):
            old = kept.get(d.full_name)
            if old is None or (old[1].kind == d.kind == "Struct" and not old[1].members and d.members):
                kept[d.full_name] = (file, d)
    return list(kept.values())


# Functions and static variables.


@dataclass
class Function:
    signature: Signature
    offset: int | None
    line: int
    body: str

    @property
    def owner(self) -> str:
        return self.signature.name.rpartition("::")[0]


def parse_signature(text: str) -> Signature | None:
    text = text.strip().rstrip("{").strip()
    close = text.rfind(")")
    start = opening(text, close) if close >= 0 else -1
    if start < 0:
        return None
    before = text[:start].strip()
    m = re.search(r"[\w:~<>]*$", before)
    name, returns = m.group(), before[: m.start()].strip()
    convention = (re.search(r"__(?:thiscall|cdecl|stdcall|fastcall)$", returns) or [""])[0]
    return Signature(name, returns.removesuffix(convention).strip() if convention else returns, convention, parse_parameters(text[start + 1 : close]))


def parse_functions(text: str) -> list[Function]:
    """Every function body behind its ``//----- (ADDRESS) ----`` line."""
    lines = re.split(r"\r?\n", text)
    out, at = [], 0
    while at < len(lines):
        mark = re.match(FUNCTION_MARK, lines[at].strip())
        if not mark:
            at += 1
            continue
        first = at + 1
        while first < len(lines) and not lines[first].strip():
            first += 1
        if first >= len(lines):
            break
        if lines[first].strip().startswith("#") or "deleting destructor" in lines[first]:
            at = first + 1
            continue
        heading, depth, end = [], 0, None
        opened = False
        for k in range(first, len(lines)):
            if not opened:
                part, brace, _ = lines[k].partition("{")
                if clean := strip_comments(part).strip():
                    heading.append(clean)
                opened = bool(brace)
            for c in lines[k]:
                depth = depth + 1 if c == "{" else max(depth - 1, 0) if c == "}" else depth
            if opened and not depth:
                end = k
                break
        if end is None:
            at += 1
            continue
        if own := parse_signature(re.sub(r"\s+", " ", " ".join(heading))):
            out.append(Function(own, int(mark[1], 16), at + 1, "\n".join(lines[first : end + 1])))
        at = end + 1
    return out


def parse_static(line: str) -> tuple[str, str, str, str] | None:
    """(address, name, type, signature) of a line of a listing of static variables; None for tables of virtual functions."""
    m = re.match(STATIC_LINE, line.strip()) if "vftable" not in line else None
    if not m:
        return None
    text = m[2].strip()
    for word in ("public", "protected", "private"):
        text = re.sub(rf"{word}:\s*", "", text, flags=re.I)
    text = re.sub(r"\s+", " ", re.sub(r"\b(?:static|const|near|far)\b", "", text, flags=re.I)).strip()
    at = depths(text, "<>")
    cut = max((i for i, c in enumerate(text) if c == " " and at[i] == 0), default=-1)
    kind, name = (normalize(text[:cut]), text[cut + 1 :].strip()) if cut >= 0 else ("int", text)
    return m[1], name, kind, m[2].strip()


def static_value(lines: list[str], at: int, start: int) -> str:
    """The initial value that begins in a line after ``start``: up to the ``;`` outside of braces, quotes and comments."""
    out, depth, quote, comment = [], 0, "", False
    for k in range(at, len(lines)):
        text = lines[k][start:].lstrip() if k == at else lines[k].strip()
        i = 0
        while i < len(text):
            c, two = text[i], text[i : i + 2]
            if comment:
                comment = two != "*/"
                out.append(c if comment else "*/")
                i += 1 if comment else 2
                continue
            if quote:
                if c == "\\" and i + 1 < len(text):
                    out.append(two)
                    i += 2
                    continue
                quote = "" if c == quote else quote
            elif two == "/*":
                comment = True
                out.append("/*")
                i += 2
                continue
            elif two == "//":
                break
            elif c == '"' or (c == "'" and not (i and (text[i - 1].isalnum() or text[i - 1] in "_`"))):
                quote = c
            elif c == ";" and not depth:
                return clean_value("".join(out))
            else:
                depth += (c == "{") - (c == "}")
            out.append(c)
            i += 1
        out.append(" ")
    return clean_value("".join(out))


def clean_value(text: str) -> str:
    """Addresses that can't be kept become null pointers with the address as a comment."""
    return re.sub(r"&(?:[\w:]+::`vftable'|off_[0-9a-fA-F]+)", lambda m: f"nullptr /* {m.group()} */", text.strip()).strip()


_MEMBER_NAMES = (
    re.compile(r"\b[a-zA-Z_][\w*&<>:]*\s+([a-zA-Z_]\w*)\s*(?:\[.*?\])?\s*;"),
    re.compile(r"\b[a-zA-Z_][\w*&<>:]*\s+(~?[a-zA-Z_]\w*)\s*\([^)]*\)\s*;"),
    re.compile(r"\(\s*(?:[a-zA-Z_]\w*\s+)*\*\s*(~?[a-zA-Z_]\w*)\s*\)\s*\([^)]*\)"),
)


def member_names(source: str) -> list[str]:
    """The names of members that the lines of a source declare, each once."""
    return list(dict.fromkeys(m[1] for line in source.split("\n") for p in _MEMBER_NAMES if (m := p.search(line))))
