"""Column expressions on declarations, names and answers; what needs no state stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.fixed import CALLING_CONVENTIONS, FUNCTION_MARK, IGNORED_PREFIXES, IGNORED_SUFFIXES, KEPT_NAMES, PRIMITIVE_COMBINATIONS, PRIMITIVE_NAMES, PRIMITIVE_SIZES, REMAPS, RESERVED, STATIC_LINE, TYPE_WORDS

_PRIMITIVE = tuple(dict.fromkeys(x.lower() for x in (*PRIMITIVE_NAMES, *PRIMITIVE_COMBINATIONS)))


def _escape(text: str) -> str:
    return "".join(f"\\{c}" if not (c.isalnum() or c in "_ ") else c for c in text)


_SPACE = r"[\s\p{Z}]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"//[^\r\n]*", "")


def normalize_type(c: Column) -> Column:
    """One space between words, none before ``*``, ``&`` and ``>``; blank gives an empty string."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"{_SPACE}+", " "), " (?=[*&>])", ""))


def base_type_name(c: Column) -> Column:
    """No ``*`` and ``&`` at the end, no leading const, no template arguments, no namespace."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), r"[*&\s\p{Z}]+$", ""), r"^const ", ""))
    bare = trimmed(F.regexp_replace(bare, r"(?s)(?<=.)<.*$", ""))
    return F.regexp_replace(bare, r"(?s)^.*::(?=.)", "")


def definition_line(source: Column, keyword: str) -> Column:
    """The first line that begins with a keyword, cleaned of it and of decorations."""
    line = F.filter(F.split(source, r"[\r\n]+"), lambda x: F.ltrim(x).startswith(keyword))
    clean = F.regexp_replace(F.get(line, 0), rf"{keyword} |__cppobj|/\*VFT\*/|__unaligned|volatile ", "")
    return F.trim(F.regexp_replace(clean, r"__declspec\s*\((?:[^()]|\([^()]*\))*\)", ""))


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$"), F.lit(False))


def is_type_word(c: Column) -> Column:
    return F.coalesce(c.isin(*TYPE_WORDS), F.lit(False))


def is_primitive(c: Column) -> Column:
    """A primitive type, alone or with modifiers, without regard to case; false for null and blank strings."""
    whole = F.lower(normalize_type(c))
    return F.coalesce(whole.isin(*_PRIMITIVE) | F.lower(base_type_name(normalize_type(c))).isin(*_PRIMITIVE), F.lit(False))


def is_primitive_shown(c: Column) -> Column:
    """The stricter test of generated text: a name or combination, or one followed by a single ``*`` or ``&``."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(c), r"[*&]$", "")))
    return F.coalesce(bare.isin(*[x.lower() for x in PRIMITIVE_NAMES]) | F.regexp_replace(bare, r"\s+", " ").isin(*[x.lower() for x in PRIMITIVE_COMBINATIONS]), F.lit(False))


def is_sized_primitive(c: Column) -> Column:
    """A primitive type as the layout knows it: by size or by name."""
    return F.coalesce(F.lower(c).isin(*dict.fromkeys(x.lower() for x in (*PRIMITIVE_SIZES, *PRIMITIVE_NAMES))), F.lit(False))


def primitive_size(c: Column) -> Column:
    """Bytes of a primitive type; 4 where the table has none."""
    table = F.create_map(*[F.lit(x) for k, v in {k.lower(): v for k, v in PRIMITIVE_SIZES.items()}.items() for x in (k, v)])
    return F.coalesce(F.element_at(table, F.lower(c)), F.lit(4))


def bit_width(declaration: Column) -> Column:
    return F.regexp_extract(strip_comments(declaration), r"\w+\s*:\s*(\d+)\s*;?\s*$", 1).try_cast("int")


def without_bit_width(declaration: Column) -> Column:
    return F.regexp_replace(declaration, r"(\w+)\s*:\s*\d+(\s*;?)$", "$1$2")


def alignment(declaration: Column) -> Column:
    return F.regexp_extract(declaration, r"__declspec\s*\(\s*align\s*\(\s*(\d+)\s*\)\s*\)", 1).try_cast("int")


def without_alignment(declaration: Column) -> Column:
    return F.trim(F.regexp_replace(declaration, r"\s*__declspec\s*\(\s*align\s*\(\s*\d+\s*\)\s*\)", ""))


def is_array(declaration: Column) -> Column:
    return F.coalesce(strip_comments(declaration).rlike(r"\[\d*\]"), F.lit(False))


def array_size(declaration: Column) -> Column:
    """The first size; null for ``[]``."""
    return F.regexp_extract(strip_comments(declaration), r"\[(\d*)\]", 1).try_cast("int")


def is_function_pointer(parameter: Column) -> Column:
    return F.coalesce(F.trim(parameter).rlike(r"^(.+?)\s*\(\s*(__thiscall|__stdcall|__cdecl|__fastcall)?\s*(\*+)\s*(\w*)\s*\)\s*\((.*?)?\)$"), F.lit(False))


def typedef_kind(declaration: Column) -> Column:
    """``pointer`` to a function, ``signature`` of one, or ``simple``."""
    return F.when(declaration.rlike(r"\(\s*(__\w+\s+)?\*\s*\w+\s*\)"), "pointer").when(declaration.rlike(r"__(cdecl|stdcall|thiscall|fastcall)\s+\w+\s*\("), "signature").otherwise("simple")


def signature_text(returns: Column, convention: Column, name: Column, parameter_types: Column) -> Column:
    """The normalized signature of a function; ``parameter_types`` is an array in order."""
    cc = F.when(F.length(convention) > 0, F.concat(convention, F.lit(" "))).otherwise("")
    return F.concat(normalize_type(returns), F.lit(" "), cc, name, F.lit("("), F.array_join(F.transform(parameter_types, normalize_type), ","), F.lit(")"))


def should_ignore(name: Column, prefixes: tuple[str, ...] = IGNORED_PREFIXES, suffixes: tuple[str, ...] = IGNORED_SUFFIXES, kept: tuple[str, ...] = KEPT_NAMES) -> Column:
    """Whether a type is left out by its full name: kept names win, then prefixes and suffixes count; the lists are parameters."""
    pattern = "^(?:" + "|".join(map(_escape, prefixes)) + ")|(?:" + "|".join(map(_escape, suffixes)) + ")$"
    return F.coalesce((F.length(name) > 0) & ~name.isin(*kept) & name.rlike(pattern), F.lit(False))


def is_table_pointer(name: Column, type_string: Column) -> Column:
    """Whether a member points to a table of virtual functions, by its name or type."""
    return F.coalesce(name.rlike("vftable|vtbl|__vfptr"), F.lit(False)) | F.coalesce(F.contains(type_string, F.lit("_vtbl")) | F.contains(type_string, F.lit("Vtbl")), F.lit(False))


def is_suppressed(signature: Column) -> Column:
    """Whether a function is written as a comment only."""
    return signature.rlike(r"__userpurge|operator\*")


def is_static_line(line: Column) -> Column:
    """Whether a line of a listing declares a static variable; tables of virtual functions aren't any."""
    return F.coalesce(~F.contains(line, F.lit("vftable")) & F.trim(line).rlike(STATIC_LINE), F.lit(False))


def is_function_mark(line: Column) -> Column:
    return F.coalesce(F.trim(line).rlike(FUNCTION_MARK), F.lit(False))


def full_name(namespace: Column, base_name: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) == "", base_name).otherwise(F.concat_ws("::", namespace, base_name))


def type_path(namespace: Column, base_name: Column) -> Column:
    return F.concat_ws("/", namespace, base_name)


def type_link(namespace: Column, base_name: Column) -> Column:
    """Where a type's page is."""
    return F.concat(F.lit("/type/"), F.when(F.coalesce(namespace, F.lit("")) == "", "").otherwise(F.concat(F.replace(namespace, F.lit("::"), F.lit("/")), F.lit("/"))), base_name)


def remap(c: Column) -> Column:
    """Display names of primitive types inside of a type string; longer names first."""
    keys = sorted(REMAPS, key=lambda k: (-len(k), k))
    words = F.regexp_extract_all(c, F.lit(r"\b(?:" + "|".join(map(_escape, keys)) + r")\b|(?s:.)"), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in REMAPS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), "")


def calling_convention(c: Column) -> Column:
    """The target's name of a calling convention, Cdecl for none or any other."""
    out = F.lit("Cdecl")
    for key, value in CALLING_CONVENTIONS.items():
        out = F.when(F.lower(c).isin(key, key.removeprefix("__")), value).otherwise(out)
    return out


def enum_value(c: Column) -> Column:
    """A literal as a number: decimal or hexadecimal, with a sign and suffixes; null for anything else."""
    bare = F.regexp_replace(F.trim(c), r"[LlUu]+$", "")
    digits = F.lower(F.regexp_extract(bare, r"^-?0[xX]([0-9a-fA-F]{1,15})$", 1))
    hexadecimal = F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint"))
    return F.when(digits != "", F.when(bare.startswith("-"), -hexadecimal).otherwise(hexadecimal)).otherwise(F.when(bare.rlike(r"^[-+]?\d+$"), bare.try_cast("bigint")))


def sanitize(name: Column) -> Column:
    """A name that the target language accepts."""
    clean = F.replace(name, F.lit("~"), F.lit("Destructor"))
    return (
        F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, "_param")
        .when(clean.isin(*RESERVED), F.concat(clean, F.lit("_")))
        .when(~clean.rlike(r"^[\p{L}_]"), F.concat(F.lit("_"), clean))
        .otherwise(clean)
    )


def clean_type_name(name: Column) -> Column:
    return F.replace(F.trim(strip_comments(name)), F.lit("$"), F.lit("_"))


def address(c: Column) -> Column:
    """A hexadecimal address as ``0x%08X``; what isn't one passes."""
    digits = F.regexp_replace(F.trim(c), "^0[xX]", "")
    short = F.regexp_replace(F.upper(digits), "^0+(?=.)", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.concat(F.lit("0x"), F.when(F.length(short) < 8, F.lpad(short, 8, "0")).otherwise(short))).otherwise(c)


def clean_base_name(c: Column) -> Column:
    return F.regexp_replace(base_type_name(c), "_vtbl$", "")


def type_tokens(c: Column) -> Column:
    """Identifiers, numbers, white space and punctuation of a type string after remapping, in order."""
    return F.regexp_extract_all(remap(c), F.lit(r"[a-zA-Z_]\w*|\d+|\s+|[^\w\s]"), F.lit(0))


def scopes(namespace: Column) -> Column:
    """``a::b::c``, ``a::b``, ``a``: a namespace and all around it, innermost first."""
    parts = F.split(namespace, "::")
    return F.when(F.length(namespace) > 0, F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))).otherwise(F.array().cast("array<string>"))


def prefixes_of(path: Column) -> Column:
    """``a``, ``a/b``, ``a/b/c`` of a path; nothing for an empty one."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def located(prefix: Column, namespace: Column, behavior: Column, strip: Column) -> Column:
    """The folder of a type: a prefix and its namespace, kept, dropped, or without its outer levels."""
    levels = F.filter(F.split(namespace, "::"), lambda p: p != "")
    rest = F.array_join(F.slice(levels, strip + 1, F.greatest(F.size(levels) - strip, F.lit(0))), "/")
    space = F.when(behavior == "KeepAll", F.replace(namespace, F.lit("::"), F.lit("/"))).when(behavior == "StripNLevels", rest).otherwise("")
    joined = F.when(space == "", prefix).when(prefix == "", space).otherwise(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(space, "^/+", "")))
    return F.regexp_replace(F.replace(joined, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def cache_key(model: Column, temperature: Column, prompt: Column) -> Column:
    return F.upper(F.sha2(F.concat_ws("|", model, temperature, prompt), 256))


def without_fences(answer: Column) -> Column:
    """An answer without the lines that open or close a block of code."""
    return trimmed(F.array_join(F.filter(F.split(answer, "\n"), lambda x: ~F.ltrim(x).startswith("```")), "\n"))


def verdict(answer: Column) -> Column:
    """valid, reason of the JSON between the first and the last brace; null if there is none or it can't be read."""
    inside = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(inside != "", F.from_json(inside, "valid boolean, reason string"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def with_address(comment: Column, offset: Column) -> Column:
    """A summary with an address put in before its end."""
    return F.regexp_replace(comment, "</summary>", F.concat(F.lit("\n(0x"), F.lpad(F.hex(offset), 8, "0"), F.lit(")</summary>")))


def prompt(**sections: Column) -> Column:
    """The sections that aren't null or empty, each under its name, in the order of the keywords."""
    shown = [F.when(F.length(c) > 0, F.concat(F.lit(f"<{name}>\n"), c, F.lit(f"\n</{name}>"))) for name, c in sections.items()]
    return F.concat_ws("\n\n", *shown)
