"""Parent-child links of unknown depth to full hierarchies: roots, depths, paths, descendants and circles.

Method.  About one node in ``EVERY`` is a splitter, chosen by a hash of its key, so the choice is the same in any run.

1. *Walk*: every node with links is walked up until each walk stands on a splitter or a root.  Walks that stand elsewhere go on by the
   walks of where they stand, so a stretch without splitters takes as many rounds as its length has bits.
2. *Splitterless circles*, separately: when every node that still walks has a walk to such a node, all of them walk without end.
   They lie on a circle without a splitter, or lead to one.
3. *Reduced graph*: the walks of splitters are links between splitters (or to roots).  Up to ``LOCAL`` of them are solved in one task,
   more are followed in the same way.  Walks that end on nodes of step 2, and those that never end, are circular.
4. *Expansion*: the walk of a node and the way of the splitter it stands on, joined.

A node may have several parents: every root above it counts, each with the fewest steps (and, of paths as short, the smallest).
Each round moves distinct (origin, position) pairs, so what a round holds never exceeds the pairs of origins and ancestors.
Joins on positions that hold many walks are spread over many tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.graph import LEAST_HOT, LOCAL, all_ancestors, clean_links, components
from orrery.plans.shared import cut, cut_and_count, hot_keys, join_to_keys
from orrery.sources.tables import table

EVERY = 3


def _is_splitter(node: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(every)) == 0


@dataclass
class Hierarchy:
    """``roots``: node, root, depth (and path: the nodes after ``node``, root last) of all nodes with links that don't meet a circle.
    ``circular``: node of those that lie on a circle or below one.  ``links``: child, parent, distinct."""

    links: DataFrame
    roots: DataFrame
    circular: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _best() -> Column:
    return F.min(F.struct("steps", "path")).alias("b")


def _follow(walks: DataFrame, left: int, paths: bool) -> tuple[DataFrame, DataFrame]:
    """Walks (origin, at, root, stop, steps, path) followed by each other until they stop, and the origins (node) of those that never do.

    A walk that doesn't stop (of which there are ``left``) stands on an origin.  Each round doubles the walks that go on.  Once each origin of
    those has one that stands on such an origin again, all of them go on without end; that is asked when they don't get much fewer.
    """
    active, done, before = walks.where("NOT stop"), [walks.where("stop")], 0
    while left:
        if 2 * left > before > 0:
            origins = active.select(F.col("origin").alias("at"), F.lit(1).alias("_o")).distinct()
            again = active.join(origins, "at", "left").groupBy("origin").agg(F.max("_o").alias("_o"))
            if not again.where("_o IS NULL").take(1):
                break
        hot = hot_keys(active.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "at", "n", least=LEAST_HOT) if left >= LEAST_HOT else []
        on = _union([*done, active]).select(F.col("origin").alias("at"), F.col("at").alias("_at"), F.col("root").alias("_root"), F.col("stop").alias("_stop"), F.col("steps").alias("_steps"), F.col("path").alias("_path"))
        grown = F.concat("path", "_path") if paths else F.col("path")
        moved = join_to_keys(active, on, "at", "origin", hot, merge=False).select("origin", F.col("_at").alias("at"), F.col("_root").alias("root"), F.col("_stop").alias("stop"), (F.col("steps") + F.col("_steps")).alias("steps"), grown.alias("path"))
        before = left
        moved, left = cut_and_count(moved.groupBy("origin", "at", "root", "stop").agg(_best()).select("origin", "at", "root", "stop", "b.steps", "b.path"), "NOT stop")
        done.append(moved.where("stop"))
        active = moved.where("NOT stop")
    return _union(done), active.select(F.col("origin").alias("node")).distinct()


_WALK = "origin long, at long, root boolean, stop boolean, steps int, path array<long>"


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same in one task: origins from the end backwards; those never come to walk without end (and don't stop).  Should the ways be too many
    to hold, one row without an origin says so."""
    to: dict[int, list[tuple]] = defaultdict(list)
    users: dict[int, list[int]] = defaultdict(list)
    open_: dict[int, int] = defaultdict(int)
    for rows in batches:
        for origin, at, root, stop, steps, path in zip(rows.origin.tolist(), rows["at"].tolist(), rows["root"], rows["stop"], rows["steps"].tolist(), rows["path"]):
            to[origin].append((at, bool(root), bool(stop), steps, None if path is None else list(path)))
            if not stop:
                users[at].append(origin)
                open_[origin] += 1
    ready, held, out = [o for o in to if not open_[o]], 0, []
    ways: dict[int, dict[tuple[int, bool], tuple]] = {}
    while ready:
        origin = ready.pop()
        mine: dict[tuple[int, bool], tuple] = {}
        for at, root, stop, steps, path in to.pop(origin):
            on = [((at, root), (0, [] if path is not None else None))] if stop else ways[at].items()
            for end, (more, rest) in on:
                way = (steps + more, None if path is None else path + rest)
                if end not in mine or way < mine[end]:
                    mine[end] = way
        ways[origin] = mine
        held += len(mine)
        if held > 16 * LOCAL:
            yield pd.DataFrame([(pd.NA, -1, False, True, 0, None)], columns=["origin", "at", "root", "stop", "steps", "path"]).astype({"origin": "Int64"})
            return
        for user in users.pop(origin, ()):
            open_[user] -= 1
            if not open_[user]:
                ready.append(user)
    for origin, mine in ways.items():
        out += [(origin, at, root, True, steps, path) for (at, root), (steps, path) in mine.items()]
    out += [(origin, -1, False, False, 0, None) for origin in to]
    for k in range(0, len(out), 100_000):
        yield pd.DataFrame(out[k : k + 100_000], columns=["origin", "at", "root", "stop", "steps", "path"])


def _solved(way: DataFrame, paths: bool, local: int) -> tuple[DataFrame, DataFrame]:
    """:func:`_follow` of the reduced graph, in one task if it has no more than ``local`` links."""
    way, n = cut_and_count(way, "true")
    if n <= local:
        found, too_many = cut_and_count(way.coalesce(1).mapInPandas(_solve, _WALK), "origin IS NULL")
        if not too_many:
            return found.where("stop"), found.where("NOT stop").select(F.col("origin").alias("node"))
    return _follow(way, way.where("NOT stop").count(), paths)


def resolve(links: DataFrame, every: int = EVERY, paths: bool = False, local: int = LOCAL) -> Hierarchy:
    """Roots, depths and circles of ``links`` (child, parent: distinct, without nulls; see :func:`clean_links`)."""
    links = cut(links)
    hot = hot_keys(links.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n", least=LEAST_HOT)
    linked = links.select(F.col("child").alias("parent")).distinct().withColumn("_linked", F.lit(True))
    root = F.col("_linked").isNull()
    path = F.array("parent") if paths else F.lit(None).cast("array<bigint>")
    first = join_to_keys(links, linked, "parent", "child", hot, "left", merge=False).select(F.col("child").alias("origin"), F.col("parent").alias("at"), root.alias("root"), (root | _is_splitter(F.col("parent"), every)).alias("stop"), F.lit(1).alias("steps"), path.alias("path"))
    settled, endless = _follow(*cut_and_count(first, "NOT stop"), paths)
    endless = cut(endless)
    walks = cut(settled.groupBy("origin", "at", "root").agg(_best()).select("origin", "at", "root", "b.steps", "b.path"))
    # The reduced graph: links from splitters to splitters or roots.  Those on or below splitterless circles are ends, too.
    bad = endless.where(_is_splitter(F.col("node"), every)).select(F.col("node").alias("at"), F.lit(True).alias("_bad"))
    way = walks.where(_is_splitter(F.col("origin"), every)).join(endless.withColumnRenamed("node", "origin"), "origin", "left_anti")
    way = way.join(bad, "at", "left").select("origin", "at", "root", (F.col("root") | F.col("_bad").isNotNull()).alias("stop"), "steps", "path")
    ways, turning = _solved(way, paths, local)
    circular_splitters = cut(turning.union(ways.where("NOT root").select(F.col("origin").alias("node"))).union(bad.select(F.col("at").alias("node"))).distinct())
    on_splitter = walks.where("NOT root")
    hot = hot_keys(on_splitter.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "at", "n", least=LEAST_HOT)
    lost = join_to_keys(on_splitter, circular_splitters.withColumnRenamed("node", "at"), "at", "origin", hot, "left_semi", merge=False).select(F.col("origin").alias("node"))
    circular = cut(lost.union(endless).union(circular_splitters).distinct())
    straight = walks.join(circular.withColumnRenamed("node", "origin"), "origin", "left_anti")
    solved = ways.where("root").groupBy("origin", "at").agg(_best()).select(F.col("origin").alias("at"), F.col("at").alias("_at"), F.col("b.steps").alias("_steps"), F.col("b.path").alias("_path"))
    grown = F.concat("path", "_path") if paths else F.col("path")
    expanded = join_to_keys(straight.where("NOT root"), solved, "at", "origin", hot, merge=False).select("origin", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), grown.alias("path"))
    every_way = straight.where("root").select("origin", "at", "steps", "path").unionByName(expanded)
    roots = every_way.groupBy("origin", "at").agg(_best()).select(F.col("origin").alias("node"), F.col("at").alias("root"), F.col("b.steps").alias("depth"), *([F.col("b.path").alias("path")] if paths else []))
    return Hierarchy(links.select("child", "parent"), roots, circular)


def ancestors(h: Hierarchy) -> DataFrame:
    """ancestor, node, depth: every node under each of its ancestors, with the fewest steps; nodes that meet a circle are left out."""
    return all_ancestors(h.links.join(h.circular.withColumnRenamed("node", "child"), "child", "left_anti"))


def circle_links(h: Hierarchy, local: int = LOCAL) -> DataFrame:
    """child, parent of the links that run in circles: those whose ends are in one component."""
    inside = h.links.join(h.circular.withColumnRenamed("node", "child"), "child", "left_semi").join(h.circular.withColumnRenamed("node", "parent"), "parent", "left_semi")
    circle = components(inside, local)
    ends = inside.join(circle.select(F.col("node").alias("child"), F.col("component").alias("_c")), "child").join(circle.select(F.col("node").alias("parent"), F.col("component").alias("_p")), "parent")
    return ends.where("_c = _p").select("child", "parent")


#: The two relations between types are resolved in one pass: nodes are type ids plus the relation times 2^32.
RELATIONS = ("inheritance", "nesting")


def type_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of both relations between existing types, as child, parent."""
    types, bases = table(spark, sf_dir, "types"), table(spark, sf_dir, "type_inheritances")
    shift = F.lit(1 << 32)
    links = bases.select(F.col("parent_type_id").cast("long").alias("child"), F.col("related_type_id").cast("long").alias("parent")).unionByName(
        types.select((F.col("id") + shift).alias("child"), (F.col("parent_type_id") + shift).alias("parent"))
    )
    nodes = types.select(F.explode(F.array(F.col("id").cast("long"), F.col("id") + shift)).alias("node"))
    return clean_links(links, nodes)


def relation(node: str) -> Column:
    return F.when(F.col(node) >= F.lit(1 << 32), RELATIONS[1]).otherwise(RELATIONS[0])


def type_id(node: str) -> Column:
    return F.pmod(F.col(node), F.lit(1 << 32)).cast("int")


def type_roots(spark: SparkSession, sf_dir: str, every: int = EVERY) -> DataFrame:
    """relation, type_id, root_id, depth; -1 and -1 for types on a circle or below one."""
    h = resolve(type_links(spark, sf_dir), every)
    straight = h.roots.select(relation("node").alias("relation"), type_id("node").alias("type_id"), type_id("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))
    return straight.unionByName(h.circular.select(relation("node").alias("relation"), type_id("node").alias("type_id"), F.lit(-1).alias("root_id"), F.lit(-1).alias("depth")))


def type_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, type_id, root_id, depth, path: from the type up to the root, the smallest of the shortest."""
    h = resolve(type_links(spark, sf_dir), paths=True)
    path = F.array_join(F.transform(F.concat(F.array("node"), "path"), lambda x: F.pmod(x, F.lit(1 << 32)).cast("string")), "/")
    return h.roots.select(relation("node").alias("relation"), type_id("node").alias("type_id"), type_id("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), path.alias("path"))


def type_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, type_id, descendant_id, depth of all types; a type on a circle is under itself (see :func:`type_circles`)."""
    pairs = all_ancestors(type_links(spark, sf_dir))
    return pairs.select(relation("node").alias("relation"), type_id("ancestor").alias("type_id"), type_id("node").alias("descendant_id"), F.col("depth").cast("int").alias("depth"))


def type_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, child_id, parent_id of the links that run in circles."""
    links = circle_links(resolve(type_links(spark, sf_dir)))
    return links.select(relation("child").alias("relation"), type_id("child").alias("child_id"), type_id("parent").alias("parent_id"))
