"""Where a type is filed: rules of which the first that matches counts, groups of types per file, and the tree of folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.operators.graph import derived_from
from orrery.operators.resolution import grouping_roots
from orrery.sources.listings import member_names_of


@dataclass(frozen=True)
class Rule:
    """``kind``: ``name`` (pattern over the full name), ``base`` (derives from a type), ``member`` (pattern over members of structs) or
    ``namespace`` (prefix).  Patterns and prefixes take no notice of case."""

    kind: str
    pattern: str
    prefix: str
    behavior: str = "KeepAll"
    strip: int = 0
    file_name: str | None = None


# The rules a catalog is filed by unless others are given, in order; the first that matches counts.
DEFAULT_RULES = (
    Rule("name", "^(LongHash|InterfacePtr|PS|NILI|UI64|SmartArray|DArray|SimpleDArray|List|Hash|SmartBuffer|Intrusive|AutoGrow|LongNI|PackableL|DLList|PackableHa|RefCountIUnknown)", "Lib/Templates/", "StripAll", 1),
    Rule("name", "^InterfaceInfo", "Lib/Templates", "KeepAll", 1),
    Rule("name", "Types?::", "Lib/Types/", "KeepAll", 1),
    Rule("name", "^_(GUID|tag)", "Lib/Types/", "KeepAll", 1),
    Rule("name", "QualityType", "Lib/Types/QualityTypes/", "KeepAll", 1),
    Rule("name", "StringTableMetaLanguage", "Dats/", "KeepAll", 0),
    Rule("name", "^(Turbine|You_Need)", "Lib/Turbine/", "KeepAll", 0),
    Rule("name", "^AC1(Legacy|Modern)", "Lib/", "KeepAll", 0),
    Rule("name", "^Logger", "Lib/", "KeepAll", 0),
    Rule("name", "^(PlatformString|InputStream)", "Lib/", "KeepAll", 0),
    Rule("name", "^(Profiler|PerfMon|BudgetStat)", "Lib/Profiler", "KeepAll", 0),
    Rule("name", "(DbgHelp|DbgReport|Debug)", "Lib/Debug", "KeepAll", 0),
    Rule("name", "^(Logger|IRpc|IStream|IStor|ISeq|INon|Class)", "Lib/", "KeepAll", 0),
    Rule("base", "SerializeUsingPackDBObj", "Dats/DBObjs/", "KeepAll", 1),
    Rule("base", "DBObj", "Dats/DBObjs/", "KeepAll", 1),
    Rule("base", "PackObj", "Net/Types/", "KeepAll", 1),
    Rule("base", "COptionalHeader", "Net/Headers/", "KeepAll", 1),
    Rule("name", "OptionalHeader|CServerSwitchStruct", "Net/Headers/", "KeepAll", 1),
    Rule("name", "(PackHeader|accountID|ActionNode)", "Net/Types/", "KeepAll", 1),
    Rule("name", "^(DDD_)", "Net/Messages/", "KeepAll", 1),
    Rule("name", "Connection|Packet|^Blob|^(?!.*Scene).*Net.*$|CLink", "Net/", "KeepAll", 1),
    Rule("name", "(Crypto|Isaaq)", "Net/Crypto/", "KeepAll", 1),
    Rule("name", "^(C?Physics|COLLISION|AtkCollisionProfile)", "Physics/", "KeepAll", 1),
    Rule("name", "^(CObjCell|EtherealWeenie)", "Physics/", "KeepAll", 1),
    Rule("name", "^BSP", "Physics/BSP", "KeepAll", 1),
    Rule("name", "System$", "Game/Systems", "KeepAll", 1),
    Rule("name", "(Chat|TextTag)", "Game/Chat/", "KeepAll", 1),
    Rule("name", "SmartBox", "Game/SmartBox", "KeepAll", 1),
    Rule("name", "^Ambient(Sound)?$", "Game/SmartBox", "KeepAll", 1),
    Rule("name", "(CharGen|_CG$)", "Game/CharGen", "KeepAll", 1),
    Rule("name", "Allegiance", "Game/Allegiance", "KeepAll", 1),
    Rule("name", "Fellow", "Game/Fellowship", "KeepAll", 1),
    Rule("name", "(Piece|Chess|MiniGame)", "Game/Chess", "KeepAll", 1),
    Rule("name", "(Attack|Combat|Damage|PowerBar)", "Game/Combat", "KeepAll", 1),
    Rule("name", "(Weenie|AlreadyRunning|APIManager)", "Game/", "KeepAll", 1),
    Rule("name", "^(ACC(Factory|Object|md))", "Game/", "KeepAll", 1),
    Rule("name", "Plugin", "Game/Plugins", "KeepAll", 1),
    Rule("name", "Trade", "Game/Trade", "KeepAll", 1),
    Rule("name", "(Spell|Enchant)", "Game/Spells", "KeepAll", 1),
    Rule("name", "^(C?Input|Device|CommandInterp|I?Keystone|ActionState|ArgumentParser|ATTNAMESSTRUCT|CommandLineArg)", "Input/", "KeepAll", 1),
    Rule("name", "^(CScene|CSound|CTerrain)", "Dats/Types/", "KeepAll", 1),
    Rule("name", "^(CAnimHook|ActionMapValue|AFrame)", "Dats/Types/", "KeepAll", 1),
    Rule("name", "(Ambient(STB|Sound)Desc|SoundType)", "Dats/Types/", "KeepAll", 1),
    Rule("name", "BuildInfo", "Dats/Types/", "KeepAll", 1),
    Rule("base", "CAnimHook", "Dats/Types/AnimHooks/", "KeepAll", 1),
    Rule("member", "GetSubDataIDs", "Dats/Types/", "KeepAll", 1),
    Rule("name", "^(MD_|C?Media)", "UI/Media/", "KeepAll", 1),
    Rule("name", "D3D", "Rendering/D3D", "KeepAll", 1),
    Rule("name", "Camera", "Rendering/Camera", "KeepAll", 1),
    Rule("name", "(Render|DepthTest|Vertex|Blit|Blend|Graphics|CullMode)", "Rendering/", "KeepAll", 1),
    Rule("name", "^(view_|Alpha)", "Rendering/", "KeepAll", 1),
    Rule("name", "^(?!.*Hook$)Anim", "Rendering/Animation", "KeepAll", 1),
    Rule("base", "UIElement", "UI/Elements/", "KeepAll", 1),
    Rule("name", "^((gm)?UI|Dialog)", "UI/", "KeepAll", 1),
    Rule("name", "(UI|InfoRegion)$", "UI/", "KeepAll", 1),
    Rule("name", "^DB(O?Cache|Level|TypeDef)", "Dats/", "StripAll", 0),
    Rule("name", "^DBUpdateType|(CL(Cache|Block))", "Dats/", "StripAll", 0, "DBUpdateType"),
    Rule("name", "^PropertyDatFileType", "Dats/", "StripAll", 0, "PropertyDatFileType"),
    Rule("name", "^(DBObjGrabber|DATFILE_|Archive|DBObj|TransientArchive)", "Dats/", "StripAll", 0),
    Rule("name", "^(cache_)", "Dats/", "StripAll", 0),
    Rule("name", "(TransactInfo)", "Dats/Transactions/", "StripAll", 0),
    Rule("name", "^Disk", "Dats/Disk/", "StripAll", 0),
    Rule("name", "^BT", "Dats/BTree", "StripAll", 0),
    Rule("name", "Async", "Lib/Async/", "KeepAll", 0),
    Rule("name", "Client", "Game/", "KeepAll", 1),
    Rule("name", "Property", "Game/Properties/", "KeepAll", 1),
)


def locations(types: DataFrame, links: DataFrame | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """id, rule (its number from 0, null if none), path, file_name of every type; without a rule the path is the namespace.

    Rules are a small list, so they become one expression, of which the first match wins; only rules on bases need a join, and only
    with the types derived from those they name.
    """
    space = F.coalesce("namespace", F.lit(""))
    full = F.coalesce("stored_fully_qualified_name", F.lit(""))
    rows = types.select("id", "kind", space.alias("namespace"), full.alias("full"), "source").dropDuplicates(["id"])
    bases = sorted({r.pattern for r in rules if r.kind == "base"})
    if bases and links is not None:
        spark = types.sparkSession
        found = derived_from(links, types, spark.createDataFrame([(b,) for b in bases], "name string"))
        held = found.groupBy("id").agg(F.collect_set("name").alias("_bases"))
        rows = rows.join(held.withColumn("id", F.col("id").cast("int")), "id", "left")
    else:
        rows = rows.withColumn("_bases", F.lit(None).cast("array<string>"))
    if any(r.kind == "member" for r in rules):
        rows = rows.withColumn("_names", member_names_of(F.when(F.col("kind") == "Struct", F.col("source"))))

    def matches(r: Rule) -> Column:
        if r.kind == "name":
            return F.col("full").rlike(f"(?i){r.pattern}")
        if r.kind == "base":
            return F.coalesce(F.array_contains("_bases", r.pattern), F.lit(False))
        if r.kind == "member":
            return F.exists("_names", lambda n: n.rlike(f"(?i){r.pattern}"))
        return F.lower("namespace").startswith(r.pattern.lower())

    hit = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        hit = F.when(matches(rules[k]), k).otherwise(hit)
    rows = rows.withColumn("rule", hit)
    table = types.sparkSession.createDataFrame([(k, r.prefix, r.behavior, r.strip, r.file_name) for k, r in enumerate(rules)], "rule int, prefix string, behavior string, strip int, file_name string")
    joined = rows.join(F.broadcast(table), "rule", "left")  # as many rows as there are rules
    path = F.when(F.col("rule").isNull(), F.replace("namespace", F.lit("::"), F.lit("/"))).otherwise(S.located(F.col("prefix"), F.col("namespace"), F.col("behavior"), F.col("strip")))
    return joined.select("id", "rule", path.alias("path"), "file_name")


def grouped(types: DataFrame, places: DataFrame) -> DataFrame:
    """output_file, path, type_id: each type in the file of the root it is filed under; names differing in case are one file.

    Of the spellings the one of the smallest id is shown.
    """
    roots = grouping_roots(types)
    rows = types.select("id", "base_name", F.coalesce("base_type_path", F.lit("")).alias("_p")).dropDuplicates(["id"])
    other = (F.col("_p") != "") & (S.base_type_name(F.col("_p")) != F.col("base_name"))
    of = rows.join(roots.dropDuplicates(["id"]), "id", "left").select(F.col("id").alias("type_id"), F.when(other, F.coalesce("root_id", "id")).otherwise(F.col("id")).alias("id"))
    named = of.join(rows.select("id", "base_name"), "id").join(places, "id").select("type_id", F.coalesce("file_name", "base_name").alias("f"), F.col("path").alias("p"))
    shown = named.groupBy(F.lower("f").alias("_f"), F.lower("p").alias("_p")).agg(F.min(F.struct("type_id", "f", "p")).alias("s"))
    joined = named.withColumn("_f", F.lower("f")).withColumn("_p", F.lower("p")).join(shown, ["_f", "_p"])
    return joined.select(F.col("s.f").alias("output_file"), F.col("s.p").alias("path"), "type_id")


def path_tree(paths: DataFrame) -> DataFrame:
    """full_path, parent, name, n_items of all folders of paths (path, one row per item); empty and ``Global`` ones are at the root."""
    where = F.when(F.coalesce("path", F.lit("")).isin("", "Global"), "").otherwise(F.col("path"))
    rows = paths.select(where.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    clean = F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), "/")
    every = rows.select(F.explode(F.concat(F.array(F.lit("")), S.prefixes_of(F.col("path")))).alias("full_path"), clean.alias("_own"), "n")
    nodes = every.groupBy("full_path").agg(F.sum(F.when(F.col("full_path") == F.col("_own"), F.col("n")).otherwise(0)).alias("n_items"))
    parent = F.when(F.contains("full_path", F.lit("/")), F.regexp_replace("full_path", "/[^/]*$", "")).when(F.col("full_path") != "", "")
    return nodes.select("full_path", parent.alias("parent"), F.when(F.col("full_path") == "", "Root").otherwise(F.substring_index("full_path", "/", -1)).alias("name"), "n_items")
