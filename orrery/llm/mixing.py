"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training time 0..1: knots (time, weight) with straight lines between them.  Its
integral up to a time, scaled to the source's demand of tokens, is what the source has to have delivered by then.  The documents
of a source, in an order made by a hash and repeated pass by pass, deliver their tokens one after the other; inverting the integral at the
middle of a document's tokens gives the time at which it belongs.  Range-sorting by that time gives the training order.

The total is the greatest at which every source can meet its share within its repeats, unless it is given.  A pass that isn't whole
takes documents in order as long as they fit and then the one whose size is nearest to what is still lacking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe import token_count
from orrery.plans.shared import running_sum, written
from orrery.sources.tables import table

Knots = list[tuple[float, float]]


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int
    schedule: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))


def when_delivered(u: Column, knots: Knots) -> Column:
    """The time by which the part ``u`` (0..1) of the integral of a schedule is reached."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots) or sorted(knots) != list(knots):
        raise ValueError("a schedule needs knots of rising times from 0 to 1 and weights of 0 or more")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total = sum(areas)
    if not total:
        raise ValueError("a schedule needs a weight above 0")
    done, out = 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        if area:
            slope, rest = (w1 - w0) / (t1 - t0), u * total - done
            # w0 x + slope x^2 / 2 = rest, in a form that holds for a slope of 0, too
            root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
            at = t0 + F.least(F.greatest(2 * rest / F.greatest(w0 + root, F.lit(1e-300)), F.lit(0.0)), F.lit(t1 - t0))
            out = F.when(u * total <= done + area, at) if out is None else out.when(u * total <= done + area, at)
        done += area
    return out.otherwise(F.lit(1.0))


def demands(available: dict[str, int], targets: list[Target], total: float | None = None) -> dict[str, float]:
    """Tokens to draw of each source.  Sources without tokens or share can deliver nothing and don't limit the others."""
    able = [t for t in targets if available.get(t.source) and t.share > 0 and t.repeats > 0]
    most = min((available[t.source] * t.repeats / t.share for t in able), default=0.0)
    total = most if total is None else min(total, most)
    return {t.source: min(t.share * total, available[t.source] * t.repeats) for t in able}


def mix(documents: DataFrame, targets: list[Target], total: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, tokens, copy_no (from 0), position: every copy of every chosen document, in training order.

    ``documents`` has doc_id (unique), source and tokens (a long).  Documents without tokens, without a source or of a source
    without a target aren't drawn; ``targets`` is a small list of settings.
    """
    wanted = [t.source for t in targets]
    able = documents.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")).where((F.col("tokens") > 0) & F.col("source").isin(*wanted))
    able = able.withColumn("_order", F.xxhash64("doc_id", F.lit(seed)))
    laid = running_sum(able, "source", ["_order", "doc_id"], "tokens", "_before")
    available = {r[0]: r[1] for r in able.groupBy("source").agg(F.sum("tokens")).collect()}
    need = demands(available, targets, total)
    of = lambda d, default: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("source")], F.lit(default)) if d else F.lit(default)
    whole = {s: int(need[s] // available[s]) for s in need}
    rest = {s: float(need[s] - whole[s] * available[s]) for s in need}
    inside = F.col("_before") + F.col("tokens") <= of(rest, -1.0)
    filled = {r[0]: r[1] for r in laid.where(inside).groupBy("source").agg(F.max(F.col("_before") + F.col("tokens"))).collect()}
    lack = {s: r - filled.get(s, 0) for s, r in rest.items()}
    off = F.abs(F.col("tokens") - of(lack, 0.0))
    last = {r[0]: r[1] for r in laid.where(~inside & (off < of(lack, 0.0))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id"))["doc_id"]).collect()}
    partly = inside | F.coalesce(F.col("doc_id") == of(last, None), F.lit(False))
    copies = of(whole, 0) + F.when(partly, 1).otherwise(0)
    drawn = laid.withColumn("_copies", copies).where("_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    middle = F.when(inside | (F.col("copy_no") < of(whole, 0)), F.col("_before")).otherwise(of({s: float(x) for s, x in filled.items()}, 0.0)) + F.col("tokens") / 2
    part = (F.col("copy_no") * of(available, 0) + middle) / of({s: float(x) for s, x in need.items()}, 1.0)
    position = F.lit(None).cast("double")
    for t in targets:
        position = F.when(F.col("source") == t.source, when_delivered(F.least(part, F.lit(1.0)), list(t.schedule))).otherwise(position)
    placed = drawn.select("doc_id", "source", "tokens", F.col("copy_no").cast("int").alias("copy_no"), position.alias("position"))
    return placed.orderBy("position", "source", "doc_id", "copy_no")


def targets_of(spark: SparkSession, sf_dir: str, tilt: float = 0.25) -> list[Target]:
    """The targets of mix_targets.  Sources that may be repeated rise by ``tilt`` over the time, so that copies come late, and
    the others fall; 0 gives the same mix at all times."""
    rows = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").collect()
    turn = lambda r: tilt if r > 1 else -tilt
    return [Target(s, w, r or 0, ((0.0, 1 - turn(r or 0)), (1.0, 1 + turn(r or 0)))) for s, w, r in rows]


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return written(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_mix: doc_id, source, tokens, copy_no, position."""
    return mix(sized_documents(spark, sf_dir), targets_of(spark, sf_dir))


def shares(mixed: DataFrame, targets: list[Target]) -> DataFrame:
    """source, target_share, max_repeats, documents, copies, tokens, reached_share of every target, reached or not."""
    spark = mixed.sparkSession
    goal = spark.createDataFrame([(t.source, float(t.share), t.repeats) for t in targets], "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(F.sum(F.when(F.col("copy_no") == 0, 1).otherwise(0)).alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("tokens"))
    all_tokens = got.agg(F.sum("tokens").alias("_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return goal.join(got, "source", "left").join(F.broadcast(all_tokens)).select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"))


def reached_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(training_order(spark, sf_dir), targets_of(spark, sf_dir))
