"""Questions to the inheritance graph, on the hierarchies of :mod:`orrery.operators.hierarchy`.

A type derives from itself.  Circles do no harm: what lies on one reaches all of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.shared import cut, cut_and_count, hot_keys, join_to_keys

#: Links that one task settles by itself.
LOCAL = 1 << 19
#: Links that each of ``WAYS`` tasks follows by itself, for its share of tags.
FOLLOWED = 1 << 21
WAYS = 8
#: Rows a key has at least before its rows are spread.
LEAST_HOT = 1 << 16


def clean_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct links between nodes that exist; ``links`` has child and parent, ``nodes`` has node."""
    known = nodes.where(F.col("node").isNotNull()).distinct()
    whole = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent").distinct()
    return whole.join(known.withColumnRenamed("node", "parent"), "parent", "left_semi").join(known.withColumnRenamed("node", "child"), "child", "left_semi").select("child", "parent")


def tarjan(links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Node to component (its smallest node) of the nodes on circles."""
    to: dict[int, list[int]] = {}
    loops = set()
    for a, b in links:
        to.setdefault(a, []).append(b)
        if a == b:
            loops.add(a)
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    found: dict[int, int] = {}
    for start in to:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        work, stack, held = [(start, iter(to[start]))], [start], {start}
        while work:
            at, rest = work[-1]
            for n in rest:
                if n not in seen:
                    seen[n] = low[n] = len(seen)
                    stack.append(n)
                    held.add(n)
                    work.append((n, iter(to.get(n, ()))))
                    break
                if n in held:
                    low[at] = min(low[at], seen[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == seen[at]:
                    own = []
                    while not own or own[-1] != at:
                        own.append(stack.pop())
                    held.difference_update(own)
                    if len(own) > 1 or at in loops:
                        found |= dict.fromkeys(own, min(own))
    return found


def _components_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = tarjan(pair for rows in batches for pair in zip(rows.child.tolist(), rows.parent.tolist()))
    yield pd.DataFrame({"node": list(found), "component": list(found.values())})


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """node, component of the nodes on circles of ``links`` (child, parent: distinct): of two that reach each other the same.

    Up to ``local`` links are settled in one task.  Beyond that, each node takes the greatest node that reaches it; of the nodes that
    took a node's name, those that reach it make up its component; what is left of links between equal names goes on.
    """
    links = cut(links.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")))
    found = []
    while (n := links.count()) > local:
        names = cut(links.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("name", F.col("node")))
        new = names
        while new.take(1):
            offered = links.join(new.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(F.max("name").alias("offer"))
            new = cut(offered.join(names, "node").where("offer > name").select("node", F.col("offer").alias("name")))
            names = cut(names.join(new.withColumnRenamed("name", "offer"), "node", "left").select("node", F.coalesce("offer", "name").alias("name")))
        inner = links.join(names.select(F.col("node").alias("child"), F.col("name").alias("_c")), "child").join(names.select(F.col("node").alias("parent"), F.col("name").alias("_p")), "parent")
        inner = cut(inner.where("_c = _p").select("child", "parent", F.col("_c").alias("name")))
        # A node with its own name makes up a component with those that reach it by links inside; it is on a circle if there is any.
        core = reached(inner, inner.where("child = name").select(F.col("child").alias("node"), "name"), "parent", "child", "name")
        found.append(cut(core.join(inner.select(F.col("parent").alias("name")).distinct(), "name", "left_semi").select("node", F.col("name").alias("component"))))
        links = inner.join(core.select(F.col("node").alias("child")), "child", "left_anti").join(core.select(F.col("node").alias("parent")), "parent", "left_anti")
        # What nothing leads to, or what leads nowhere, is on no circle.
        links = links.join(inner.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(inner.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        links = cut(links.select("child", "parent"))
    if n:
        found.append(links.coalesce(1).mapInPandas(_components_of, "node long, component long"))
    if not found:
        return links.select(F.col("child").alias("node"), F.col("parent").alias("component")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out)


def inheritance_links(bases: DataFrame, types: DataFrame) -> DataFrame:
    """child, parent of bases that exist."""
    return clean_links(bases.select(F.col("parent_type_id").cast("long").alias("child"), F.col("related_type_id").cast("long").alias("parent")), types.select(F.col("id").cast("long").alias("node")))


def all_ancestors(links: DataFrame) -> DataFrame:
    """ancestor, node, depth: every node under each node that its links (child, parent: distinct) lead to, with the fewest steps.

    Circles do no harm: what lies on one is under all of it, itself included.  Each round doubles the distance: pairs exactly as far apart
    as the rounds have come go on by all pairs so far, and only pairs not seen before are written.
    """
    parts = [cut(links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))]
    reach = 1
    while True:
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        edge = parts[-1].where(F.col("depth") == reach).select("node", "ancestor")
        hot = hot_keys(edge.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n")), "ancestor", "n", least=LEAST_HOT)
        further = join_to_keys(edge, every.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("depth").alias("_d")), "ancestor", "node", hot, merge=False)
        far = further.groupBy("node", F.col("_up").alias("ancestor")).agg((F.min("_d") + reach).alias("depth"))
        new = cut(far.join(every.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if not new.take(1):
            return every
        parts.append(new)
        reach *= 2


def closure(links: DataFrame) -> DataFrame:
    """child, parent, over any number of links, circles included."""
    return all_ancestors(links.select("child", "parent").distinct()).select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _at, _to and tags), first links (_k 0), then seeds (_k 1, in ``_at``) sorted by tags: node and tags of all that seeds lead to.

    One tag is followed at a time; in memory are the links and what that tag has reached.
    """
    at, to = [], []
    nodes = start = targets = seen = None
    tag, own, lone = None, [], []

    def follow() -> Iterator[pa.RecordBatch]:
        found = []
        for x in own:
            if not seen[x]:
                seen[x] = 1
                found.append(x)
        for x in found:  # grows as it is read
            for y in targets[start[x] : start[x + 1]]:
                if not seen[y]:
                    seen[y] = 1
                    found.append(y)
        for x in found:
            seen[x] = 0
        ids = np.concatenate([nodes[found], np.array(lone, dtype=np.int64)])
        for k in range(0, len(ids), 100_000):
            part = ids[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([t.as_py()] * len(part), t.type) for t in tag]], names=["node", *names])

    def joined(small: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(small).combine_chunks().to_batches()[0]

    out, held = [], 0
    for batch in batches:
        names = batch.schema.names[3:]
        n = batch.num_rows - int(np.count_nonzero(batch.column("_k").to_numpy()))
        at.append(batch.column("_at").slice(0, n).to_numpy())
        to.append(batch.column("_to").slice(0, n).to_numpy(zero_copy_only=False).astype(np.int64))
        seeds = batch.slice(n)
        if not seeds.num_rows:
            continue
        if nodes is None:
            ends = np.concatenate([*at, *to])
            nodes, ids = np.unique(ends, return_inverse=True)
            order = np.argsort(ids[: len(ends) // 2], kind="stable")
            targets = ids[len(ends) // 2 :][order].tolist()
            start = np.concatenate([[0], np.cumsum(np.bincount(ids[: len(ends) // 2], minlength=len(nodes)))]).tolist()
            seen = bytearray(len(nodes))
        ids = seeds.column("_at").to_numpy()
        place = np.searchsorted(nodes, ids)
        there = place < len(nodes)
        there[there] = nodes[place[there]] == ids[there]
        columns = [seeds.column(c) for c in names]
        for i, (node, x, linked) in enumerate(zip(ids.tolist(), place.tolist(), there.tolist())):
            new = [c[i] for c in columns]
            if tag != new:
                if own or lone:
                    for more in follow():
                        out.append(more)
                        held += more.num_rows
                        if held > 50_000:
                            yield joined(out)
                            out, held = [], 0
                tag, own, lone = new, [], []
            own.append(x) if linked else lone.append(node)
    if own or lone:
        out.extend(follow())
    if out:
        yield joined(out)


def reached(links: DataFrame, seeds: DataFrame, at: str, to: str, *tags: str, local: int = FOLLOWED) -> DataFrame:
    """The seeds (node and ``tags``) and all nodes that links lead to from ``at`` to ``to``, each under its seed's tags.

    Up to ``local`` links go to ``WAYS`` tasks, each of which follows them for its share of tags, however long the way.  Beyond that, a round takes
    the links of the nodes newly found; those of nodes with very many links are spread.
    """
    step_of, n = cut_and_count(links.select(F.col(at).cast("long").alias("node"), F.col(to).cast("long").alias("_to")), "true")
    seeds = seeds.select(F.col("node").cast("long").alias("node"), *tags).where("node IS NOT NULL").distinct()
    if n <= local:
        ways = WAYS if tags else 1
        kinds = {f.name: f.dataType for f in seeds.schema}
        whole = step_of.where("node IS NOT NULL AND _to IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("_w"), F.lit(0).alias("_k"), F.col("node").alias("_at"), "_to", *[F.lit(None).cast(kinds[t]).alias(t) for t in tags])
        way = F.pmod(F.xxhash64(*tags), F.lit(ways)).cast("int") if tags else F.lit(0)
        begun = seeds.select(way.alias("_w"), F.lit(1).alias("_k"), F.col("node").alias("_at"), F.lit(None).cast("long").alias("_to"), *tags)
        laid = whole.unionByName(begun).repartitionById(ways, F.col("_w")).sortWithinPartitions("_k", *tags).drop("_w")
        return cut(laid.mapInArrow(_followed, ", ".join(["node long", *[f"{t} {kinds[t].simpleString()}" for t in tags]])))
    hot = hot_keys(step_of.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "n", least=LEAST_HOT)
    parts = [cut(seeds)]
    while parts[-1].take(1):
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        step = join_to_keys(step_of, parts[-1], "node", "_to", hot, merge=False).select(F.col("_to").alias("node"), *tags).distinct()
        parts.append(cut(step.join(found, ["node", *tags], "left_anti")))
    return found if len(parts) > 1 else parts[0]


def derived_from(links: DataFrame, types: DataFrame, names: DataFrame) -> DataFrame:
    """id, name: the types that derive from a named one (``names``: name), which itself is among them; ignored types have no name."""
    named = types.where(~F.col("is_ignored")).join(names.select(F.col("name").alias("stored_fully_qualified_name")).distinct(), "stored_fully_qualified_name")
    seeds = named.select(F.col("id").cast("long").alias("node"), F.col("stored_fully_qualified_name").alias("name"))
    return reached(links, seeds, "parent", "child", "name").select(F.col("node").alias("id"), "name")


def bases_of(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """id: the seeds (id) and all above them."""
    return reached(links, seeds.select(F.col("id").cast("long").alias("node")), "child", "parent").select(F.col("node").alias("id"))


def with_destructor(links: DataFrame, own: DataFrame) -> DataFrame:
    """id: types that have a destructor (``own``: id) or a base that has one."""
    return reached(links, own.select(F.col("id").cast("long").alias("node")), "parent", "child").select(F.col("node").alias("id"))
