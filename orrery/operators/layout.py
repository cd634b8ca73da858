"""Sizes and offsets of structs on x86.

Sizes depend on sizes: structs contain structs by value.  They are computed level by level, those first whose parts are all known.
Where that stops, circles are in the way: a part on the same circle as its struct counts four bytes, and the levels go on above with
the sizes this gives.  Known quirks are kept: a union or enum by value counts four bytes, the size of a struct takes no notice of
packed bit fields, and members align to four bytes at most.  Sizes and offsets are longs: arrays of structs of arrays multiply, and
soon have more than 2^31 bytes.

Before the levels begin, runs of members whose sizes are known become one *shift* each: by how much a run moves an offset depends on
nothing but the offset's remainder, so a run of any length is a table of a few numbers, and tables of tasks that share a struct are
applied one after the other.  What goes through the levels is therefore a few numbers per part that is still open.  A level joins only
the sizes that are new with the parts that wait for them.  When no more than ``LOCAL`` parts are open, one task settles the rest, by
the same function; results are the same wherever that happens.
"""

from __future__ import annotations

import marshal
from collections import defaultdict
from collections.abc import Callable, Iterator
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import strings as S
from orrery.operators import graph
from orrery.operators.graph import components, tarjan
from orrery.plans.shared import cut, hot_keys, join_to_keys, written

#: Open parts that one task settles by itself, packed; beyond it, each level takes a round that writes all that waits anew.
LOCAL = 1 << 21
#: Remainders a shift tells apart at most; what aligns to more stands by itself.
REMAINDERS = 64


def align_up(offset: Column, to: Column) -> Column:
    return F.when(to <= 1, offset).otherwise(offset + F.pmod(-offset, F.greatest(to, F.lit(1))))


def _alignment_of_size(size: Column) -> Column:
    return F.when(size <= 1, 1).when(size <= 2, 2).otherwise(4)


def type_alignment(alignment: Column, base_name: Column) -> Column:
    size = S.primitive_size(base_name)
    own = F.when(size <= 1, 1).when(size <= 2, 2).when(size <= 4, 4).otherwise(8)
    return F.coalesce(alignment, F.when(S.is_sized_primitive(base_name), own).otherwise(4))


def _by_string(text: Column, named: Column) -> Column:
    """The size a type string has by itself; null if it names a type of the catalog."""
    base = S.base_type_name(text)
    star = F.coalesce(S.trimmed(text).endswith("*"), F.lit(False))
    return F.when((F.coalesce(F.length(text), F.lit(0)) == 0) | star, 4).when(S.is_sized_primitive(base), S.primitive_size(base)).when(named.isNull(), 4)


def member_parts(members: DataFrame, references: DataFrame, types: DataFrame) -> DataFrame:
    """Members with what their size depends on: fixed (bytes, if known by itself) or part_id (a type), and count.

    An id without a type has no bytes.  What has no bytes aligns as its type string says: alt_fixed or alt_id.
    """
    members = written(members.select("id", "struct_id", "name", "type_string", "type_reference_id", "decl_order", "bit_width", "alignment", "is_function_pointer"))
    refs = references.select(F.col("id").alias("type_reference_id"), "referenced_type_id", F.col("is_pointer").alias("_p"), F.col("is_array").alias("_a"), F.col("array_size").alias("_n"), F.col("type_string").alias("_s"))
    named = types.where(F.length("stored_fully_qualified_name") > 0).groupBy(F.col("stored_fully_qualified_name").alias("_text")).agg(F.min("id").alias("_named"))
    there = types.select(F.col("id").alias("referenced_type_id")).distinct().withColumn("_there", F.lit(True))
    array, pointer, called = F.coalesce(F.col("_a"), F.lit(False)), F.coalesce(F.col("_p"), F.lit(False)), F.coalesce(F.col("is_function_pointer"), F.lit(False))
    rows = members.join(refs, "type_reference_id", "left").join(there, "referenced_type_id", "left")
    rows = rows.withColumn("_text", F.when(F.col("referenced_type_id").isNull(), F.when(array, F.col("_s")).otherwise(F.col("type_string"))))
    hot = hot_keys(members.groupBy("type_string").agg(F.count(F.lit(1)).alias("n")), "type_string", "n")
    rows = join_to_keys(rows, named, "_text", "id", hot, "left")
    rows = join_to_keys(rows, named.select(F.col("_text").alias("type_string"), F.col("_named").alias("_own")), "type_string", "id", hot, "left")
    by_id = F.when(F.col("referenced_type_id").isNotNull() & F.col("_there").isNull(), 0)
    fixed = F.when(called | pointer, 4).when(F.col("referenced_type_id").isNull(), _by_string(F.col("_text"), F.col("_named"))).otherwise(by_id)
    return rows.select(
        "struct_id", "id", "name", "decl_order", "bit_width", "alignment", fixed.alias("fixed"), F.when(fixed.isNull(), F.coalesce("referenced_type_id", "_named")).alias("part_id"),
        F.when(called | ~array, 1).otherwise(F.coalesce("_n", F.lit(1))).alias("count"), (array & ~called).alias("array"), (~called & pointer & ~array).alias("plain_pointer"),
        _by_string(F.col("type_string"), F.col("_own")).alias("alt_fixed"), F.col("_own").alias("alt_id"),
    )


def _sized(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``parts`` with size and align, where the sizes of their types are known; null where they aren't."""
    joined = parts.join(sizes.select(F.col("id").alias("part_id"), F.col("size").alias("_size")), "part_id", "left")
    alt = F.when(F.coalesce("fixed", "_size") == 0, F.col("alt_id"))
    joined = joined.withColumn("_alt", alt).join(sizes.select(F.col("id").alias("_alt"), F.col("size").alias("_alt_size")), "_alt", "left")
    element = F.coalesce("fixed", "_size")
    counted = F.when(F.col("array") & (element == 0), 1).otherwise(element).cast("long") * F.col("count")
    shown = F.when(element == 0, F.coalesce("alt_fixed", "_alt_size", F.lit(4))).otherwise(element)
    align = F.coalesce("alignment", F.when(F.col("plain_pointer"), 4).otherwise(_alignment_of_size(shown)))
    return joined.withColumn("size", counted).withColumn("align", F.when(element.isNotNull(), align)).drop("_size", "_alt", "_alt_size")


def _aligned(at: int, to: int) -> int:
    return at + -at % to if to > 1 else at


_ELEMENT = "fixed int, part_id int, count int, array boolean, align int, alt_fixed int, alt_id int"
_OPEN = ("fixed", "part_id", "count", "align", "alt_fixed", "alt_id")
_ITEM = f"struct_id int, g int, o int, i int, shift array<long>, most int, {_ELEMENT}"


def _shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted elements to items: runs of known ones as one shift, open ones as they are.  A run ends with its struct, partition or batch."""
    names = [c.split()[0] for c in _ITEM.split(", ")]
    nothing = (None,) * 7
    for rows in batches:
        out, at, table, most = [], None, [0], 1

        def close() -> None:
            nonlocal at, table, most
            if at is not None:
                out.append((*at, table, most, *nothing))
            at, table, most = None, [0], 1

        for struct, g, o, i, size, align, *element in zip(rows.struct_id, rows.g, rows.o, rows.i, rows.known_size, rows.known_align, *(rows[c.split()[0]] for c in _ELEMENT.split(", "))):
            key = (struct, g, _whole(o), _whole(i))
            if at is not None and at[0] != struct:
                close()
            if size != size or max(1, align) > REMAINDERS:
                close()
                many = bool(element[3]) if element[3] is not None else False
                out.append((*key, None, None, *map(_whole, element[:3]), many, *map(_whole, element[4:])))
                continue
            size, align = int(size), max(1, int(align))
            width = lcm(len(table), align)
            if width > REMAINDERS:
                close()
                width = align
            at, most = at or key, max(most, align)
            table = [_aligned(r + table[r % len(table)], align) + size - r for r in range(width)]
        close()
        yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("o", "i", "most", "fixed", "part_id", "count", "align", "alt_fixed", "alt_id")})


def _whole(x) -> int | None:
    """A number of a pandas column, in which nulls may stand as NaN."""
    return None if x is None or x != x else int(x)


def _read(items) -> list[dict]:
    return [{k: v if k in ("shift", "array") else _whole(v) for k, v in e.items()} | {"shift": None if e["shift"] is None else [int(x) for x in e["shift"]]} for e in items]


def _settle(alignment: int | None, items: list[dict], size_of: Callable[[int], int | None]) -> tuple[int | None, list[int]]:
    """The size of a struct, or the types whose sizes it waits for."""
    at, most, needs = 0, alignment or 1, []
    for e in items:
        if (shift := e["shift"]) is not None:
            if not needs:
                at += shift[at % len(shift)]
                most = max(most, e["most"])
            continue
        element = e["fixed"] if e["fixed"] is not None else size_of(e["part_id"])
        if element is None:
            needs.append(e["part_id"])
            continue
        align, shown = e["align"], element
        if align is None:
            if element == 0:
                shown = e["alt_fixed"] if e["alt_fixed"] is not None else 4 if e["alt_id"] is None else size_of(e["alt_id"])
                if shown is None:
                    needs.append(e["alt_id"])
                    continue
            align = 1 if shown <= 1 else 2 if shown <= 2 else 4
        if not needs:
            at = _aligned(at, align) + (1 if e["array"] and element == 0 else element) * e["count"]
            most = max(most, align)
    return (None, needs) if needs else (_aligned(at, most), [])


@F.pandas_udf(T.StructType().add("size", T.LongType()).add("needs", T.ArrayType(T.IntegerType())))
def _settled(structs: pd.Series, alignments: pd.Series, items: pd.Series, have: pd.Series) -> pd.DataFrame:
    """Null items (structs that nothing new has come for) give nulls."""
    got = [(None, None) if x is None else _settle(_whole(a), _read(x), dict(h).get) for a, x, h in zip(alignments, items, have)]
    return pd.DataFrame({"size": pd.Series([g[0] for g in got], dtype="Int64"), "needs": [g[1] for g in got]})


def _packed(alignment: int | None, items, have) -> bytes:
    """What :func:`_settle` needs of a struct, in few bytes: millions of items have to fit a task."""
    items = [([int(x) for x in e["shift"]], int(e["most"])) if e["shift"] is not None else (*(_whole(e[c]) for c in _OPEN), bool(e["array"])) for e in items]
    return marshal.dumps((alignment, items, [(int(k), int(v)) for k, v in have]))


def _unpacked(struct: bytes) -> tuple[int | None, list[dict], dict[int, int]]:
    alignment, items, have = marshal.loads(struct)
    return alignment, [{"shift": e[0], "most": e[1]} if len(e) == 2 else {"shift": None, **dict(zip(_OPEN, e)), "array": e[-1]} for e in items], dict(have)


def settle_all(waiting: dict[int, bytes]) -> dict[int, int]:
    """Sizes of packed structs (alignment, items, sizes of parts known before) in one go: levels, then circles, then levels again."""
    sizes: dict[int, int] = {}
    users: dict[int, list[int]] = defaultdict(list)
    needs: dict[int, tuple[int, ...]] = {}
    fours: dict[int, list[int]] = {}
    todo = sorted(waiting)
    while True:
        while todo:
            one = todo.pop()
            if one not in waiting:
                continue
            alignment, items, have = _unpacked(waiting[one])
            have.update(dict.fromkeys(fours.get(one, ()), 4))
            size, open_ = _settle(alignment, items, lambda p: have[p] if p in have else sizes.get(p))
            if size is None:
                needs[one] = tuple(set(open_))
                for p in needs[one]:
                    users[p].append(one)
                continue
            sizes[one] = size
            del waiting[one]
            needs.pop(one, None)
            todo += [user for user in users.pop(one, ()) if user in waiting and all(p in sizes for p in needs[user])]
        if not waiting:
            return sizes
        circle = tarjan((s, p) for s, parts in needs.items() for p in parts if p in needs)
        for s, parts in needs.items():
            if inner := [p for p in parts if s in circle and circle[s] == circle.get(p)]:
                fours[s] = fours.get(s, []) + inner
                todo.append(s)
        if not todo:
            raise ValueError("structs wait for parts that are not types")


def _settle_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting = {}
    for rows in batches:
        for one, alignment, items, have in zip(rows["id"], rows["alignment"], rows["items"], rows["have"]):
            waiting[int(one)] = _packed(_whole(alignment), items, dict(have).items())
    sizes = settle_all(waiting)
    yield pd.DataFrame({"id": list(sizes), "size": list(sizes.values())})


def type_sizes(types: DataFrame, members: DataFrame, references: DataFrame, bases: DataFrame, parts: DataFrame | None = None, local: int = LOCAL) -> DataFrame:
    """id, size of every type.  ``parts`` are those of :func:`member_parts`, if they are at hand."""
    rows = cut(types.select("id", "base_name", "kind", "alignment").dropDuplicates(["id"]))
    primitive, struct = S.is_sized_primitive(F.col("base_name")), F.coalesce(F.col("kind") == "Struct", F.lit(False))
    plain = rows.where(primitive | ~struct).select("id", F.when(primitive, S.primitive_size(F.col("base_name"))).otherwise(4).cast("long").alias("size"))
    structs = rows.where(~primitive & struct).select("id", "alignment")
    parts = (member_parts(members, references, types) if parts is None else parts).join(structs.select(F.col("id").alias("struct_id")), "struct_id", "left_semi")
    parts = parts.join(plain.select(F.col("id").alias("part_id"), F.col("size").alias("_p")), "part_id", "left").join(plain.select(F.col("id").alias("alt_id"), F.col("size").alias("_a")), "alt_id", "left")
    align = F.coalesce("alignment", F.when(F.col("plain_pointer"), 4))
    own = parts.select("struct_id", F.lit(1).alias("g"), F.col("decl_order").alias("o"), F.col("id").alias("i"), F.coalesce("fixed", F.col("_p").cast("int")).alias("fixed"), "part_id", "count", "array", align.alias("align"), F.coalesce("alt_fixed", F.col("_a").cast("int")).alias("alt_fixed"), "alt_id")
    heads = bases.where("related_type_id IS NOT NULL").join(rows.select(F.col("id").alias("related_type_id"), type_alignment(F.col("alignment"), F.col("base_name")).alias("align")), "related_type_id")
    heads = heads.join(structs.select(F.col("id").alias("parent_type_id")), "parent_type_id", "left_semi").join(plain.withColumnRenamed("id", "related_type_id"), "related_type_id", "left")
    none = F.lit(None).cast("int")
    above = heads.select(F.col("parent_type_id").alias("struct_id"), F.lit(0).alias("g"), F.col("ord").alias("o"), F.col("id").alias("i"), F.col("size").cast("int").alias("fixed"), F.col("related_type_id").alias("part_id"), F.lit(1).alias("count"), F.lit(False).alias("array"), "align", none.alias("alt_fixed"), none.alias("alt_id"))
    shown = F.when(F.col("fixed") == 0, F.coalesce("alt_fixed", F.when(F.col("alt_id").isNull(), 4))).otherwise(F.col("fixed"))
    known_align = F.coalesce("align", _alignment_of_size(shown))
    known = F.col("fixed").isNotNull() & (F.col("align").isNotNull() | shown.isNotNull())
    counted = F.when(F.col("array") & (F.col("fixed") == 0), 1).otherwise(F.col("fixed")).cast("long") * F.col("count")
    elements = above.unionByName(own).select("*", F.when(known, counted).alias("known_size"), F.when(known, known_align).alias("known_align"))
    laid = elements.repartitionByRange("struct_id", "g", "o", "i").sortWithinPartitions("struct_id", "g", "o", "i")
    items = written(laid.mapInPandas(_shifts, _ITEM))
    listed = items.groupBy("struct_id").agg(F.array_sort(F.collect_list(F.struct("g", "o", "i", "shift", "most", *[c.split()[0] for c in _ELEMENT.split(", ")]))).alias("items")).withColumnRenamed("struct_id", "id")
    empty = F.array().cast(dict(listed.dtypes)["items"])
    state = structs.join(listed, "id", "left").select("id", "alignment", F.coalesce("items", empty).alias("items"), F.create_map().cast("map<int,bigint>").alias("have"))
    judged = cut(state.withColumn("r", _settled("id", "alignment", "items", "have")))
    sized = [plain, _done(judged)]
    waiting = judged.where("r.size IS NULL")
    slots = items.where("shift IS NULL").select("struct_id", F.explode(F.array("part_id", "alt_id")).alias("part_id")).where("part_id IS NOT NULL").distinct()
    slots = cut(slots.join(waiting.select(F.col("id").alias("struct_id")), "struct_id", "left_semi"))
    # Sizes of level 0 go to all that wait for them.
    waiting = cut(_filled(waiting, slots, sized[-1]))
    while (left := waiting.agg(F.sum(F.size("items"))).first()[0]) and left > local:
        judged = cut(waiting.withColumn("r", _settled("id", "alignment", F.when(F.col("touched"), F.col("items")), "have")).withColumn("r", F.when(F.col("touched"), F.col("r")).otherwise(F.col("old"))))
        new, waiting = _done(judged), judged.where("r.size IS NULL")
        if new.take(1):
            sized.append(new)
            waiting = cut(_filled(waiting, slots, new))
            continue
        # All that is left lies on a circle or above one.  Without the links inside circles, no circle is left.
        open_ = waiting.select(F.col("id").alias("child"), F.explode("r.needs").alias("parent")).distinct()
        circle = components(open_, min(local, graph.LOCAL))
        inner = open_.join(circle.select(F.col("node").alias("child"), F.col("component").alias("c")), "child").join(circle.select(F.col("node").alias("parent"), F.col("component").alias("p")), "parent").where("c = p")
        fours = inner.groupBy(F.col("child").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("parent").cast("int").alias("parent"), F.lit(4).cast("long").alias("size")))).alias("new"))
        waiting = cut(_taken(waiting, fours))
        if not waiting.where("touched").take(1):
            raise ValueError("structs wait for parts that are not types")
    if left:
        sized.append(waiting.select("id", "alignment", "items", "have").coalesce(1).mapInPandas(_settle_rest, "id int, size long"))
    out = sized[0]
    for more in sized[1:]:
        out = out.unionByName(more)
    return written(out)


def _done(judged: DataFrame) -> DataFrame:
    return judged.where("r.size IS NOT NULL").select("id", F.col("r.size").alias("size"))


def _filled(waiting: DataFrame, slots: DataFrame, new: DataFrame) -> DataFrame:
    """``waiting`` with the sizes in ``new`` where they are waited for."""
    fills = slots.join(new.withColumnRenamed("id", "part_id"), "part_id")
    return _taken(waiting, fills.groupBy(F.col("struct_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("part_id", "size"))).alias("new")))


def _taken(waiting: DataFrame, new: DataFrame) -> DataFrame:
    joined = waiting.join(new, "id", "left")
    more = F.map_filter(F.coalesce("new", F.create_map().cast("map<int,bigint>")), lambda k, _: ~F.map_contains_key("have", k))
    return joined.select("id", "alignment", "items", F.map_concat("have", more).alias("have"), F.col("new").isNotNull().alias("touched"), F.col("r").alias("old"))


def base_sizes(bases: DataFrame, types: DataFrame, sizes: DataFrame) -> DataFrame:
    """struct_id, base_size: where the members of a type begin, without padding at the end."""
    rows = bases.where("related_type_id IS NOT NULL").join(types.select(F.col("id").alias("related_type_id"), type_alignment(F.col("alignment"), F.col("base_name")).alias("align")).dropDuplicates(["related_type_id"]), "related_type_id")
    rows = rows.join(sizes.select(F.col("id").alias("related_type_id"), "size"), "related_type_id")
    listed = rows.groupBy(F.col("parent_type_id").alias("struct_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "size", "align"))).alias("b"))
    return listed.select("struct_id", F.aggregate("b", F.lit(0).cast("long"), lambda s, p: align_up(s, p["align"]) + p["size"]).alias("base_size"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members sorted by struct and order; the state of a struct goes on from one batch to the next."""
    struct = at = unit = unit_size = bits = None
    for rows in batches:
        out = []
        for own, size, align, width, base in zip(rows.struct_id, rows["size"], rows["align"], rows.bit_width, rows.base_size):
            if own != struct:
                struct, at, unit, unit_size, bits = own, base, -1, 0, 0
            if width >= 0 and unit != -1 and size == unit_size and bits + width <= size * 8:
                bits += width
                out.append(unit)
                continue
            if unit != -1:
                at, unit = unit + unit_size, -1
            if align > 1:
                at += -at % align
            out.append(at)
            if width >= 0:
                unit, unit_size, bits = at, size, width
            else:
                at += size
        yield pd.DataFrame({"struct_id": rows.struct_id, "id": rows.id, "member_offset": out})


def fold_offsets(sized: DataFrame) -> DataFrame:
    """struct_id, id, member_offset of members (struct_id, id, decl_order, size, align, bit_width, base_size).

    A bit field joins the open unit if that has its size and room; anything else closes the unit.  Members stream through sorted, so
    a struct of any length takes a few numbers of memory.
    """
    plain = [F.coalesce(c, F.lit(d)).cast(kind).alias(c) for c, d, kind in (("size", 4, "long"), ("align", 4, "int"), ("bit_width", -1, "int"), ("base_size", 0, "long"))]
    laid = sized.select("struct_id", "id", "decl_order", *plain).repartition("struct_id").sortWithinPartitions("struct_id", "decl_order", "id")
    kinds = dict(sized.dtypes)
    return laid.mapInPandas(_fold, f"struct_id {kinds['struct_id']}, id {kinds['id']}, member_offset long")


def member_offsets(types: DataFrame, members: DataFrame, references: DataFrame, bases: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """struct_id, id, member_offset of all members of structs."""
    parts = written(member_parts(members, references, types))
    sizes = sizes if sizes is not None else type_sizes(types, members, references, bases, parts)
    structs = types.where("kind = 'Struct'").select(F.col("id").alias("struct_id")).distinct()
    parts = parts.join(structs, "struct_id", "left_semi")
    sized = _sized(parts, sizes).join(base_sizes(bases, types, sizes), "struct_id", "left")
    return fold_offsets(sized)
