"""A resumable pipeline of stages that have texts written and checked, with a cache of answers and statistics.

A stage is a DataFrame of work items.  What is done already falls away by an anti-join; the rest is processed in parallel by a
function of one item; results are upserted.  The model is any callable from a prompt and the options (which hold the limits of a
request) to (text, tokens in, tokens out).  All calls made for an item are kept in the cache under the key of its first prompt, which
is joined before anything is called, so a retry or a check that was answered before isn't asked again, either.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.strings import cache_key
from orrery.operators.catalog import upsert
from orrery.plans.shared import written

Answer = tuple[str, int, int]
Model = Callable[[str, "Options"], Answer]
RESULTS = "stage string, entity_type string, full_name string, status string, content string, retries int, prompt_tokens bigint, completion_tokens bigint, llm_ms bigint, cache_hit boolean"
#: ``item_key`` is the key of the first prompt of the item a call was made for.
CACHE = "item_key string, cache_key string, prompt string, answer string, prompt_tokens bigint, completion_tokens bigint"


@dataclass(frozen=True)
class Options:
    """Defaults of a run."""

    model: str = "local"
    retries: int = 5
    max_tokens: int = 2048
    temperature: str = "0.7"
    force: bool = False


@dataclass(frozen=True)
class Stage:
    name: str
    system: str
    check: Model
    write: Model
    after: tuple[str, ...] = field(default=())


def validate(stages: list[Stage]) -> None:
    """Every stage that another depends on must come before it."""
    seen: set[str] = set()
    for s in stages:
        if missing := [d for d in s.after if d not in seen]:
            raise ValueError(f"stage {s.name} depends on {missing}, which come later or not at all")
        seen.add(s.name)


def has_summary(text: str | None) -> bool:
    """Whether a text is well-formed and has a ``<summary>`` that isn't inside of another element."""
    try:
        return ElementTree.fromstring(f"<root>{text or ''}</root>").find("summary") is not None
    except ElementTree.ParseError:
        return False


def sanitize(text: str) -> str:
    """An answer without the lines that open or close a block of code."""
    return "\n".join(x for x in text.split("\n") if not x.lstrip().startswith("```")).strip()


def read_verdict(text: str) -> tuple[bool, str] | None:
    """(valid, reason) of the JSON in an answer, None if there is none or it can't be read."""
    m = re.search(r"\{.*\}", text, re.S)
    try:
        found = json.loads(m.group()) if m else None
        return (bool(found["valid"]), str(found.get("reason", ""))) if isinstance(found, dict) and "valid" in found else None
    except ValueError:
        return None


def stub_writer(prompt: str, options: Options) -> Answer:
    """A writer without a network: a summary that names the last line of its prompt."""
    last = prompt.strip().rsplit("\n", 1)[-1]
    safe = re.sub(r"[<>&]", "", last)
    return f"<summary>{safe}</summary>", len(prompt.split()), len(safe.split())


def stub_checker(prompt: str, options: Options) -> Answer:
    return '{"valid": true, "reason": ""}', len(prompt.split()), 3


def build_prompt(system: str, target: str, failures: list[str], previous: str | None) -> str:
    parts = [("system", system), ("attempts", "\n".join(failures)), ("previous_output", previous or ""), ("input", target)]
    return "\n\n".join(f"<{k}>\n{v}\n</{k}>" for k, v in parts if v) + f"\n{target}"


class Calls:
    """The calls of one item: answers known before are taken, the others are asked for, timed and kept."""

    def __init__(self, options: Options, known: dict[str, Answer]):
        self.options, self.known, self.made, self.tokens, self.ms = options, known, [], [0, 0], 0.0

    def __call__(self, model: Model, prompt: str) -> str:
        key = hashlib.sha256(f"{self.options.model}|{self.options.temperature}|{prompt}".encode()).hexdigest().upper()
        if key not in self.known:
            began = time.perf_counter()
            self.known[key] = model(prompt, self.options)
            self.ms += 1000 * (time.perf_counter() - began)
            self.made.append((key, prompt, *self.known[key]))
        text, a, b = self.known[key]
        self.tokens = [self.tokens[0] + a, self.tokens[1] + b]
        return text


def process(target: str, stage: Stage, options: Options, known: dict[str, Answer] | None = None) -> tuple[dict, list[tuple]]:
    """(result, calls made) of one item: write, check the form, check the content, and again with what was wrong, as often as allowed."""
    failures: list[str] = []
    content, call, status = None, Calls(options, dict(known or {})), "Failed"
    attempt = 0
    for attempt in range(options.retries):
        content = sanitize(call(stage.write, build_prompt(stage.system, target, failures, content)))
        if not has_summary(content):
            failures.append("no well-formed <summary>")
            continue
        verdict = None
        for again in range(options.retries):
            asked = f"{content}\n{target}" + f"\n(answer {again + 1})" * bool(again)  # the same question has the same answer
            if (verdict := read_verdict(call(stage.check, asked))) is not None:
                break
        if verdict and verdict[0]:
            status = "Success"
            break
        failures.append(verdict[1] if verdict else "no readable verdict")
    return {"status": status, "content": content, "retries": attempt, "prompt_tokens": call.tokens[0], "completion_tokens": call.tokens[1], "llm_ms": round(call.ms), "cache_hit": not call.made}, call.made


def pending(items: DataFrame, results: DataFrame, stage: str, force: bool = False) -> DataFrame:
    """Work items without a successful result of this stage; all of them if forced."""
    done = results.where((F.col("stage") == stage) & (F.col("status") == "Success")).select("entity_type", "full_name").distinct()
    return items if force else items.join(done, ["entity_type", "full_name"], "left_anti")


def run_stage(items: DataFrame, results: DataFrame, stage: Stage, options: Options = Options(), cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new results, new cache rows) of the pending items (entity_type, full_name, and target: what to write about), written down."""
    todo = pending(items, results, stage.name, options.force)
    first = F.concat(F.lit(f"<system>\n{stage.system}\n</system>\n\n<input>\n"), F.col("target"), F.lit("\n</input>\n"), F.col("target"))
    todo = todo.withColumn("item_key", cache_key(F.lit(options.model), F.lit(options.temperature), first))
    call = F.struct("cache_key", "answer", "prompt_tokens", "completion_tokens")
    if cache is not None:
        kept = cache.groupBy("item_key").agg(F.collect_set(call).alias("known"))  # the calls of an item: a few for each retry
        todo = todo.join(kept, "item_key", "left")
    else:
        todo = todo.withColumn("known", F.lit(None).cast("array<struct<cache_key: string, answer: string, prompt_tokens: bigint, completion_tokens: bigint>>"))
    columns = [c.split()[0] for c in RESULTS.split(", ")]
    names = [c.split()[0] for c in CACHE.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made, calls = [], []
            for target, key, known in zip(rows.target, rows.item_key, rows.known):
                before = {} if known is None else {k["cache_key"]: (k["answer"], int(k["prompt_tokens"]), int(k["completion_tokens"])) for k in known}
                result, asked = process(target, stage, options, before)
                made.append(result)
                calls.append([dict(zip(names, (key, *c))) for c in asked])
            out = pd.DataFrame(made, columns=["status", "content", "retries", "prompt_tokens", "completion_tokens", "llm_ms", "cache_hit"])
            yield pd.DataFrame({"stage": stage.name, "entity_type": rows.entity_type, "full_name": rows.full_name}).join(out)[columns].assign(calls=calls)

    done = written(todo.mapInPandas(work, f"{RESULTS}, calls array<struct<{CACHE.replace(' ', ': ').replace(',:', ',')}>>"))
    return done.drop("calls"), done.select(F.explode("calls").alias("c")).select("c.*").dropDuplicates(["item_key", "cache_key"])


def merged(results: DataFrame, new: DataFrame) -> DataFrame:
    """One row per stage and entity, the newest; token counts stay as they were first."""
    return upsert(results, new, ["stage", "entity_type", "full_name"], F.lit(0), ("prompt_tokens", "completion_tokens"))


def run(spark: SparkSession, stages: list[tuple[Stage, DataFrame]], results: DataFrame | None = None, options: Options = Options(), cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, cache) after all stages in order.  What a stage found is written down before the next begins, so nothing is asked twice."""
    validate([s for s, _ in stages])
    results = results if results is not None else spark.createDataFrame([], RESULTS)
    cache = cache if cache is not None else spark.createDataFrame([], CACHE)
    for stage, items in stages:
        new, calls = run_stage(items, results, stage, options, cache)
        results, cache = written(merged(results, new)), cache.unionByName(calls)
    return results, cache


def statistics(results: DataFrame) -> DataFrame:
    """One row: counts by status, retries, cache hits and their rate, time of calls that weren't hits and its mean, tokens."""
    hits, n = F.count_if("cache_hit"), F.count(F.lit(1))
    ms = F.coalesce(F.sum(F.when(~F.col("cache_hit"), F.col("llm_ms"))), F.lit(0))
    return results.agg(
        n.alias("total"), F.count_if(F.col("status") == "Success").alias("succeeded"), F.count_if(F.col("status") == "Failed").alias("failed"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"), hits.alias("cache_hits"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"),
        ms.cast("bigint").alias("llm_ms"), F.when(n > hits, ms / (n - hits)).otherwise(0.0).alias("mean_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("bigint").alias("completion_tokens"),
    )
