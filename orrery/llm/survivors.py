"""Best representative of each duplicate group, field by field, by token-level consensus.

Every field of a group that no rule settles is put to the vote.  Equal values are one voter with the sum of their weights.  Values are aligned
progressively along one guide tree, the same for groups of any size: voters stand in order of weight, and neighbours are
aligned two by two, then the results, and so on.  An alignment of two profiles (columns of weighted tokens) is the one with the
greatest weight of common tokens, by dynamic programming; each column is won by its heaviest token or gap; and the existing value
with the fewest tokens to edit into that consensus survives (of equals the heavier, then the smaller).  A voter with more than half
of a group's weight wins every column, so it survives without any alignment.

A rule that names the row a field has to come from leaves nothing to vote on: such a field (members, a whole source) is that row's.
Up to ``CHUNK`` neighbours of the tree are aligned in one call; larger groups take several rounds of such calls, with the same tree, so
``CHUNK`` makes no difference to the result and no task sees a whole group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.typekeys import is_value, type_name, written_key
from orrery.plans.shared import hot_keys, join_to_keys, row_numbers, written
from orrery.sources.tables import table

#: Neighbours aligned in one call, a power of two.
CHUNK = 32
#: Cells of an alignment held at once; larger ones are cut in two where their best path runs.
CELLS = 1 << 22
#: What aligning two different tokens is worth, beside 1 for equal ones.
UNEQUAL = 0.125
_TOKENS = re.compile(r"\s+|\w+|[^\w\s]")

#: A column of an alignment: the weight of each token; the empty token is a gap.
Profile = list[dict[str, float]]


def tokens(value: str) -> list[str]:
    return _TOKENS.findall(value)


def profile_of(value: str, weight: float) -> Profile:
    return [{t: weight} for t in tokens(value)]


def winners(profile: Profile) -> list[str]:
    """The heaviest token of each column, of equals the smallest; gaps are empty."""
    return [min(c, key=lambda t: (-c[t], t)) for c in profile]


def _worth(a: Profile, b: Profile):
    """A function from a column of ``a`` to what aligning it with each column of ``b`` is worth."""
    where: dict[str, tuple[list[int], list[float]]] = {}
    for j, column in enumerate(b):
        total = sum(column.values()) or 1.0
        for t, w in column.items():
            if t:
                at, share = where.setdefault(t, ([], []))
                at.append(j)
                share.append(w / total)
    found = {t: (np.array(at), np.array(share)) for t, (at, share) in where.items()}

    def row(i: int) -> np.ndarray:
        out, column = np.full(len(b), UNEQUAL), a[i]
        total = sum(column.values()) or 1.0
        for t, w in column.items():
            if t in found:
                at, share = found[t]
                out[at] += w / total * share
        return out

    return row


def _last_row(row, rows: range, low: int, high: int, back: bool) -> np.ndarray:
    """The greatest worth of aligning ``rows`` with the first 0, 1, ... columns of low..high (the last ones, if ``back``)."""
    now = np.zeros(high - low + 1)
    for i in rows:
        worth = row(i)[low:high]
        new = now.copy()
        np.maximum(new[1:], now[:-1] + (worth[::-1] if back else worth), out=new[1:])
        now = np.maximum.accumulate(new)
    return now


def _pairs(row, top: int, bottom: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """The aligned columns of top..bottom and low..high, in order."""
    n, m = bottom - top, high - low
    if not n or not m:
        return
    if n > 1 and n * m > CELLS:
        middle = (top + bottom) // 2
        both = _last_row(row, range(top, middle), low, high, False) + _last_row(row, range(bottom - 1, middle - 1, -1), low, high, True)[::-1]
        cut = low + int(both.argmax())
        yield from _pairs(row, top, middle, low, cut)
        yield from _pairs(row, middle, bottom, cut, high)
        return
    table = np.zeros((n + 1, m + 1))
    for i in range(n):
        new = table[i].copy()
        np.maximum(new[1:], table[i, :-1] + row(top + i)[low:high], out=new[1:])
        table[i + 1] = np.maximum.accumulate(new)
    out, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((top + i, low + j))
    yield from reversed(out)


def align(a: Profile, b: Profile) -> Profile:
    """Two profiles as one."""
    wa, wb = (sum(p[0].values()) if p else 0.0 for p in (a, b))
    out: Profile = []

    def put(x: dict[str, float] | None, y: dict[str, float] | None) -> None:
        column = dict(x if x is not None else {"": wa})
        for t, w in (y if y is not None else {"": wb}).items():
            column[t] = column.get(t, 0.0) + w
        out.append(column)

    same = 0  # what is the same at both ends needs no table
    while same < min(len(a), len(b)) and a[same].keys() == b[same].keys() and len(a[same]) == 1:
        same += 1
    end = 0
    while end < min(len(a), len(b)) - same and a[-1 - end].keys() == b[-1 - end].keys() and len(a[-1 - end]) == 1:
        end += 1
    i = j = same
    for x, y in zip(a[:same], b[:same]):
        put(x, y)
    for p, q in _pairs(_worth(a, b), same, len(a) - end, same, len(b) - end):
        for x in a[i:p]:
            put(x, None)
        for y in b[j:q]:
            put(None, y)
        put(a[p], b[q])
        i, j = p + 1, q + 1
    for x in a[i : len(a) - end]:
        put(x, None)
    for y in b[j : len(b) - end]:
        put(None, y)
    for x, y in zip(a[len(a) - end :], b[len(b) - end :]):
        put(x, y)
    return out


def progressive(profiles: list[Profile]) -> Profile:
    """Neighbours two by two, then the results, until one is left."""
    while len(profiles) > 1:
        profiles = [align(*profiles[k : k + 2]) if k + 1 < len(profiles) else profiles[k] for k in range(0, len(profiles), 2)]
    return profiles[0]


def edits(a: list[str], b: list[str]) -> int:
    """Tokens to insert, delete or replace to turn ``a`` into ``b``."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s], dtype=np.int64) for s in (a, b))
    steps = np.arange(len(y) + 1)
    now = steps.copy()
    for i, t in enumerate(x):
        new = now + 1
        np.minimum(new[1:], now[:-1] + (y != t), out=new[1:])
        now = np.minimum.accumulate(new - steps) + steps
    return int(now[-1])


def _heaviest_first(pairs: list[tuple[str, float]]) -> list[tuple[str, float]]:
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def vote(pairs: list[tuple[str, float]]) -> str:
    """The surviving value of (value, weight) pairs of different values."""
    order = _heaviest_first(pairs)
    consensus = [t for t in winners(progressive([profile_of(v, w) for v, w in order])) if t]
    return min(order, key=lambda p: (edits(tokens(p[0]), consensus), -p[1], p[0]))[0]


@F.pandas_udf(T.StringType())
def _vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([vote([(p["value"], p["weight"]) for p in pairs]) for pairs in batch], dtype=object)


@F.pandas_udf(T.StringType())
def _chunk_profile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([json.dumps(progressive([profile_of(v, w) for v, w in _heaviest_first([(p["value"], p["weight"]) for p in pairs])])) for pairs in batch])


@F.pandas_udf(T.StringType())
def _merge_profiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([json.dumps(progressive([json.loads(p["profile"]) for p in profiles])) for profiles in batch])


@F.pandas_udf(T.StringType())
def _won(profiles: pd.Series) -> pd.Series:
    return pd.Series([json.dumps([t for t in winners(json.loads(p)) if t]) for p in profiles], dtype=object)


@F.pandas_udf(T.IntegerType())
def _distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, won in batches:
        own = {w: json.loads(w) for w in set(won)}
        yield pd.Series([edits(tokens(v), own[w]) for v, w in zip(values, won)])


#: Voters are those of a group and a field.
_KEYS = ("group", "field")


def consensus(votes: DataFrame, chunk: int | None = None) -> DataFrame:
    """group, field, value, id: the survivor of each field of each group, and the row it is from: of those with that value the heaviest,
    then the one with the smallest id.

    ``votes`` has group, field, value (strings), weight (a double, 0 or more) and id.  Null groups and values don't vote; a field without
    values gives no row; rows of equal values add up.
    """
    chunk = chunk or CHUNK
    first = F.max(F.struct("weight", (-F.col("id")).alias("id")))["id"]
    voters = written(votes.where("group IS NOT NULL AND value IS NOT NULL").groupBy(*_KEYS, "value").agg(F.sum("weight").cast("double").alias("weight"), (-first).alias("id")))
    heaviest = F.max_by(F.struct("value", "id", "weight"), F.struct("weight", (-F.col("id")).alias("i"))).alias("h")
    fields = voters.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("all"), heaviest)
    clear = (F.col("n") == 1) | (2 * F.col("h.weight") > F.col("all"))
    fields = written(fields.select(*_KEYS, "n", clear.alias("clear"), F.when(clear, F.col("h.value")).alias("value"), F.when(clear, F.col("h.id")).alias("id")))
    decided = fields.where("clear").select(*_KEYS, "value", "id")
    open_fields = fields.where("NOT clear").select(*_KEYS, "n")
    pair = F.collect_list(F.struct("value", "weight")).alias("pairs")
    won = voters.join(open_fields.where(F.col("n") <= chunk), [*_KEYS]).groupBy(*_KEYS).agg(pair).select(*_KEYS, _vote("pairs").alias("value"))
    most = open_fields.agg(F.max("n")).first()[0] or 0
    if most > chunk:
        won = won.unionByName(_large(voters, open_fields.where(F.col("n") > chunk), most, chunk))
    # The ids of the survivors; each value of a field is one voter.
    return decided.unionByName(won.join(voters.select(*_KEYS, "value", "id"), [*_KEYS, "value"])) if most else decided


def _large(voters: DataFrame, fields: DataFrame, most: int, chunk: int) -> DataFrame:
    """The same for fields of more than ``chunk`` values, of which the largest has ``most``: the same tree, some levels at a time."""
    key = F.to_json(F.struct(*_KEYS))
    hot = hot_keys(fields.select(key.alias("k"), "n"), "k", "n")
    keyed = fields.select(key.alias("k"), *_KEYS)
    own = join_to_keys(voters.withColumn("k", key).drop(*_KEYS, "id"), keyed.select("k"), "k", "value", hot, "left_semi").withColumn("lighter", -F.col("weight"))
    own = written(row_numbers(own, ["k", "lighter", "value"], "place"))
    first = own.groupBy("k").agg(F.min("place").alias("first"))
    own = written(join_to_keys(own, first, "k", "value", hot).select("k", "value", "weight", (F.col("place") - F.col("first")).alias("place")))
    at = F.floor(F.col("place") / chunk).cast("int").alias("place")
    profiles = own.groupBy("k", at).agg(F.collect_list(F.struct("value", "weight")).alias("pairs")).select("k", "place", _chunk_profile("pairs").alias("profile"))
    left = -(-most // chunk)
    while left > 1:
        profiles = profiles.groupBy("k", at).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), "profile"))).alias("p")).select("k", "place", _merge_profiles("p").alias("profile"))
        left = -(-left // chunk)
    judged = join_to_keys(own, written(profiles.select("k", _won("profile").alias("won"))), "k", "value", hot)
    best = F.min(F.struct(_distance("value", "won").alias("d"), (-F.col("weight")).alias("w"), F.col("value")))
    return judged.groupBy("k").agg(best["value"].alias("value")).join(keyed, "k").select(*_KEYS, "value")


def is_whole(source: Column) -> Column:
    """Whether a definition's opening brace is closed again; false for null."""
    braces = F.regexp_replace(source, "[^{}]+", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "{", s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), (s["closed"] | ((c == "}") & (s["depth"] == 1))).alias("closed"))

    folded = F.aggregate(F.split(braces, "(?<=.)(?=.)"), start, step, lambda s: s["closed"])
    return F.coalesce(F.when(braces == "{}", True).when(braces == "", False).otherwise(folded), F.lit(False))


def ranked(*order: Column) -> Column:
    """The id of the first row by ``order`` (greatest first), then by the smallest id."""
    return -F.max(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)], (-F.col("id")).alias("id")))["id"]


def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, loaded_at, source, kind, is_vtable, name, group, whole and the number of members of all types that have a name.

    Rows sharing an id in struct_members are one member.
    """
    listed = table(spark, sf_dir, "struct_members").where("struct_id IS NOT NULL").select("struct_id", "id").distinct().groupBy(F.col("struct_id").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    name = type_name()
    types = table(spark, sf_dir, "types").select("id", "loaded_at", "source", "kind", "is_vtable", name.alias("name"), written_key(name).alias("group"), is_whole(F.col("source")).alias("whole"))
    return types.where("group IS NOT NULL").join(listed, "id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def type_groups(rows: DataFrame) -> DataFrame:
    """group, rows, first_id, by_members, by_source of :func:`named_rows`: the row each of the two fields has to come from; by_source is null where
    no row has a whole definition.  A null loaded_at counts as the earliest."""
    by_source = -F.max(F.when(F.col("whole"), F.struct("loaded_at", (-F.col("id")).alias("id"))))["id"]
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), ranked(F.col("members"), F.col("loaded_at")).alias("by_members"), by_source.alias("by_source"))


def _ballot(field: str, value: Column, weight: Column, rows: DataFrame) -> DataFrame:
    return rows.where(value.isNotNull()).select("group", F.lit(field).alias("field"), value.alias("value"), weight.alias("weight"), "id")


def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: first_id, members_from_id, source_from_id of all types with two or more rows.

    Its rule names the rows, so it is a ranking; the consensus would have nothing to decide.
    """
    return type_groups(named_rows(spark, sf_dir)).where("rows >= 2").select("first_id", F.col("by_members").alias("members_from_id"), F.col("by_source").alias("source_from_id"))


def type_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per type: first_id, n_rows, name, kind, is_vtable, source_from_id, source, members_from_id, members and member_rows.

    Members and whole sources are from the rows that the rule of p5_found names.  Name, kind and is_vtable are the values of the group that are
    closest to the consensus; rows with a whole definition weigh double.  Where no definition is whole, source is the consensus of those that
    aren't blank, and source_from_id is null.
    """
    named = written(named_rows(spark, sf_dir))
    groups = written(type_groups(named))
    rows = written(join_to_keys(named, groups, "group", "id", hot_keys(groups, "group", "rows")))
    double = F.when(F.col("whole"), 2.0).otherwise(1.0)
    ballots = _ballot("name", F.col("name"), double, rows)
    for field, value in (("kind", F.col("kind")), ("is_vtable", F.col("is_vtable").cast("string"))):
        ballots = ballots.unionByName(_ballot(field, value, double, rows))
    ballots = ballots.unionByName(_ballot("broken", F.when(is_value(F.col("source")), F.col("source")), F.lit(1.0), rows.where("by_source IS NULL")))
    won = consensus(ballots)
    value = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    fields = won.groupBy("group").agg(
        value("name", "value").alias("name"), value("kind", "value").alias("kind"), value("is_vtable", "value").cast("boolean").alias("is_vtable"),
        value("broken", "value").alias("broken"),
    )
    whole = rows.where("whole AND id = by_source").groupBy("group").agg(F.max("source").alias("whole"))
    chosen = groups.select("group", "first_id", F.col("rows").alias("n_rows"), F.col("by_source").alias("source_from_id"), F.col("by_members").alias("members_from_id"))
    listed = F.array_sort(F.collect_set(F.struct("decl_order", "id", "name", "type_string")))
    members = table(spark, sf_dir, "struct_members").where("struct_id IS NOT NULL").groupBy(F.col("struct_id").alias("members_from_id")).agg(F.count_distinct("id").alias("members"), listed.alias("member_rows"))
    return (
        chosen.join(fields, "group").join(whole, "group", "left").join(members, "members_from_id", "left")
        .select("first_id", "n_rows", "name", "kind", "is_vtable", "source_from_id", F.coalesce("whole", "broken").alias("source"), "members_from_id", F.coalesce("members", F.lit(0)).alias("members"), "member_rows")
    )
