"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization, with calibrated posteriors.

A text is cut into segments (lines and sentences), and a segment is the set of its letter n-grams, taken over its letters alone, so
that ``trade offer``, ``tradeOffer``, ``TRADE_OFFER`` and slips of the pen share most of them.  Names of types are taken out.
Classes are the subjects, ``none``, and ``aside``: what speaks of a subject that the document isn't about.

1. Complement naive Bayes weights are counted over the labelled documents, whose segments go to the document's labels.
2. Each subject gets a posterior of its own, independent of the others: a logistic function of what the segments of a document add up
   to for this subject, fitted to the labelled documents.
3. EM over all documents: the expectation gives each document its likely subjects (labelled ones keep theirs); segments that
   clearly speak of another are asides; the maximization counts anew over all documents, unlabelled ones at ``UNLABELLED`` weight.
4. The posteriors are fitted again; subjects above one half are the result.

Size: the model is ``classes x 2^BITS`` numbers, whatever the corpus; tasks add up counts in an array of that size and hand it on in
blocks, which are summed in rounds of ``FAN_IN``.  Labels are taken from at most ``MAX_LABELLED`` documents (by a hash of their id, so
the choice is the same each time); counts and results cover all documents and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.typekeys import is_value
from orrery.plans.shared import written
from orrery.sources.tables import table

BITS, NGRAM = 18, 5
MAX_LABELLED = 50_000
UNLABELLED = 0.3
SHARPNESS, SMOOTHING, ASIDE_SHARE, CLEARLY = 0.3, 0.3, 0.2, 0.9
BLOCK, FAN_IN = 4096, 64
_CUTS = re.compile(r"[\n\r]+|(?<=[.!?])\s+")
_QUALIFIER = re.compile(r"\b\w++(?:<[^<>\n]*>)?::")
_ARGUMENTS = re.compile(r"<.*", re.S)


def segments(text: str, about: str | None) -> list[str]:
    """The lines and sentences of a text, in lower case, without the name of the type it is about and without qualifiers."""
    text = text.lower()
    if about and about.strip():
        about = about.lower()
        base = _ARGUMENTS.sub("", about).rsplit("::", 1)[-1]
        text = text.replace(about, " ")
        if len(base) > 3:
            text = text.replace(base, " ")
    return [s for s in map(str.strip, _CUTS.split(_QUALIFIER.sub(" ", text))) if s]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, hashed n-gram) pairs, distinct and sorted by segment.  Segments of fewer letters than n have none."""
    codes = np.frombuffer("\n".join(parts).encode("utf-32-le"), dtype=np.uint32)
    ends = codes == 10
    owner = np.cumsum(ends)
    letter = _letters()[codes]
    codes, owner = codes[letter].astype(np.uint64), owner[letter]
    n = len(codes) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    value = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(NGRAM):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    inside = owner[:n] == owner[NGRAM - 1 :]
    pairs = np.sort(owner[:n][inside].astype(np.int64) << BITS | (value[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Batch:
    """Segments of some documents: owner gives the document of each segment, seg and gram the pairs."""

    documents: int
    owner: np.ndarray
    seg: np.ndarray
    gram: np.ndarray

    @staticmethod
    def of(texts: list[str | None], about: list[str | None]) -> Batch:
        parts, owner = [], []
        for k, (text, name) in enumerate(zip(texts, about)):
            own = segments(text, name) if text else []
            parts += own
            owner += [k] * len(own)
        seg, gram = grams([p.replace("\n", " ") for p in parts])
        return Batch(len(texts), np.array(owner, dtype=np.int64), seg, gram)

    def by_document(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.owner, weights=values[:, k], minlength=self.documents) for k in range(values.shape[1])], 1)


def weights(counts: np.ndarray) -> np.ndarray:
    """Complement weights by n-gram and class (a row per n-gram, so that one look finds all classes), from counts by class and n-gram."""
    rest = counts.sum(0) - counts
    size = max(int((counts.sum(0) > 0).sum()), 1)
    return np.ascontiguousarray(-np.log((rest + SMOOTHING) / (rest.sum(1, keepdims=True) + SMOOTHING * size)).T.astype(np.float32))


def scored(batch: Batch, w: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """The sum of the weights of each segment's n-grams, by class; segments are taken ``at_once``."""
    out = np.zeros((len(batch.owner), w.shape[1]))
    cuts = np.searchsorted(batch.seg, np.arange(0, len(batch.owner) + at_once, at_once))
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            own, first = np.unique(batch.seg[a:b], return_index=True)
            out[own] = np.add.reduceat(w[batch.gram[a:b]], first, axis=0)
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def posteriors(batch: Batch, w: np.ndarray, asides: bool) -> np.ndarray:
    """The class posteriors of each segment, given the mix of classes in its document."""
    classes = w.shape[1]
    scores = scored(batch, w) * SHARPNESS
    if not asides:
        scores[:, -1] = -1e9
    free = _soft(scores) if len(scores) else scores
    for _ in range(2):
        mix = batch.by_document(free)
        if asides:
            mix[:, -1] = mix.sum(1) * ASIDE_SHARE
        mix = (mix + 0.3) / (mix.sum(1, keepdims=True) + 0.3 * classes)
        free = _soft(scores + np.log(mix)[batch.owner]) if len(scores) else scores
    return free


def evidence(batch: Batch, free: np.ndarray) -> np.ndarray:
    """For each document and subject, what the segments add up to."""
    own = free[:, :-2]
    total = batch.by_document(own)
    most = np.zeros_like(total)
    np.maximum.at(most, batch.owner, own)
    clear, likely = batch.by_document((own > 0.9) * 1.0), batch.by_document((own > 0.5) * 1.0)
    several = (clear >= 1).sum(1, keepdims=True) >= 2
    every = total.sum(1, keepdims=True)
    n = np.bincount(batch.owner, minlength=batch.documents)[:, None]
    return np.stack(
        [clear >= 1, clear >= 2, clear >= 3, likely >= 1, likely >= 2, several & (clear == 1), several & (clear > 1), np.log(np.clip(1 - most, 1e-6, 1)), np.log1p(total), most,
         total / np.maximum(every, 1e-9), np.log1p(every) + 0 * total, total / np.maximum(n, 1), total / np.maximum(total.max(1, keepdims=True), 1e-9)], -1
    ).astype(np.float64)


@dataclass
class Calibration:
    """A logistic function of the evidence; one slope per kind of evidence, one intercept per subject."""

    mean: np.ndarray
    scale: np.ndarray
    slope: np.ndarray

    def _design(self, x: np.ndarray) -> np.ndarray:
        documents, subjects, _ = x.shape
        return np.concatenate([(x - self.mean) / self.scale, np.broadcast_to(np.eye(subjects), (documents, subjects, subjects))], -1)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.slope, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, truth: np.ndarray, ridge: float = 1.0) -> Calibration:
        flat = x.reshape(-1, x.shape[-1])
        own = Calibration(flat.mean(0), flat.std(0) + 1e-9, np.zeros(x.shape[-1] + x.shape[1]))
        design, y = own._design(x).reshape(-1, len(own.slope)), truth.reshape(-1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ own.slope, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(own.slope))
            own.slope = own.slope - np.linalg.solve(hessian, design.T @ (p - y) + ridge * own.slope)
        return own


def assign(batch: Batch, mask: np.ndarray, subjects: int, free: np.ndarray | None, posterior: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Class shares and weight of each segment for counting.  ``mask``: labels as bits, -1 for documents without labels."""
    labelled = mask >= 0
    share = ((mask[:, None] >> np.arange(subjects)) & 1) * labelled[:, None].astype(float)
    if posterior is not None:
        likely = posterior.max(1) > 0.5
        share = np.where(labelled[:, None], share, np.where(posterior > 0.1, posterior, 0) * likely[:, None])
    full = np.zeros((batch.documents, subjects + 2))
    some = share.sum(1) > 0
    full[:, :subjects] = share / np.maximum(share.sum(1, keepdims=True), 1e-9)
    full[:, subjects] = ~some
    out = full[batch.owner]
    if free is not None and len(out):
        aside = np.where(out[:, :subjects] > 0, 0, free[:, :subjects]).max(1) > CLEARLY
        out[aside] = 0
        out[aside, -1] = 1
    weight = np.where(labelled, 1.0, UNLABELLED if posterior is not None else 0.0)[batch.owner]
    return out, weight


def count(batch: Batch, share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Counts by class and n-gram.  Most segments belong to one class or two, so each class takes its own only."""
    weighted, out = share * weight[:, None], np.zeros((share.shape[1], 1 << BITS))
    for k in range(share.shape[1]):
        own = weighted[batch.seg, k]
        used = own > 0
        out[k] = np.bincount(batch.gram[used], weights=own[used], minlength=1 << BITS)
    return out


# The passes over a table of documents (doc_id, text, type_fqn, mask), in Spark.


@dataclass
class Model:
    subjects: list[str]
    w: np.ndarray
    asides: bool
    calibration: Calibration | None = None


def _batch(rows: pd.DataFrame) -> tuple[Batch, np.ndarray]:
    return Batch.of(list(rows.text), list(rows.type_fqn)), rows["mask"].fillna(-1).to_numpy(dtype=np.int64)


def counted(docs: DataFrame, subjects: list[str], model: Model | None) -> np.ndarray:
    """Counts by class and n-gram over ``docs``: by the labels alone without a model, else by labels, posteriors and asides."""
    n = len(subjects)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, own = np.zeros((n + 2, 1 << BITS)), shared.value
        for rows in batches:
            batch, mask = _batch(rows)
            free = posterior = None
            if own is not None:
                free = posteriors(batch, own.w, own.asides)
                posterior = own.calibration.posterior(evidence(batch, free))
            total += count(batch, *assign(batch, mask, n, free, posterior))
        blocks = total.astype(np.float32).reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pd.DataFrame({"block": used.astype(np.int32), "data": [blocks[b].tobytes() for b in used]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(d, dtype=np.float32).astype(np.float64) for d in rows["data"])
        return pd.DataFrame({"block": [rows.block.iloc[0]], "part": [rows.part.iloc[0] // FAN_IN], "data": [whole.astype(np.float32).tobytes()]})

    sums = written(docs.mapInPandas(add, "block int, data binary").withColumn("part", F.spark_partition_id()))
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        sums = sums.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("_round")).applyInPandas(merge, "block int, part int, data binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros(((n + 2) << BITS) // BLOCK * BLOCK).reshape(-1, BLOCK)
    for block, _, data in sums.collect():  # as many numbers as the model has, at any size of the corpus
        out[block] = np.frombuffer(data, dtype=np.float32)
    return out.reshape(n + 2, 1 << BITS)


def calibrated(docs: DataFrame, model: Model) -> Model:
    """The model with posteriors fitted to the labelled documents ``docs``."""
    n = len(model.subjects)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            batch, mask = _batch(rows)
            x = evidence(batch, posteriors(batch, shared.value.w, shared.value.asides)).astype(np.float32)
            yield pd.DataFrame({"mask": mask, "x": [v.tobytes() for v in x]})

    rows = docs.mapInPandas(look, "mask bigint, x binary").collect()  # MAX_LABELLED at most
    if not rows:
        return model
    x = np.stack([np.frombuffer(r[1], dtype=np.float32).reshape(n, -1) for r in rows]).astype(np.float64)
    truth = (np.array([r[0] for r in rows])[:, None] >> np.arange(n)) & 1
    return Model(model.subjects, model.w, model.asides, Calibration.fit(x, truth.astype(float)))


def labelled_masks(labels: DataFrame, subjects: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, mask of at most ``most`` labelled documents: bits of their subjects, 0 for ``none`` and labels that aren't subjects."""
    bit = F.lit(0).cast("long")
    for k, s in enumerate(subjects):
        bit = F.when(F.col("subject") == s, F.lit(1 << k)).otherwise(bit)
    masks = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", bit.alias("b")).groupBy("doc_id").agg(F.bit_or("b").alias("mask"))
    return masks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_masks(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, text, type_fqn, mask.  The labels are bounded by MAX_LABELLED, so they may be broadcast."""
    masks = labelled_masks(labels, subjects)
    return documents.select("doc_id", "text", "type_fqn").join(F.broadcast(masks), "doc_id", "left")


def train(docs: DataFrame, subjects: list[str], rounds: int = 1) -> Model:
    """The model after ``rounds`` of EM over ``docs`` (see :func:`with_masks`)."""
    labelled = written(docs.where("mask IS NOT NULL").select("doc_id", "text", "type_fqn", "mask"))
    model = calibrated(labelled, Model(subjects, weights(counted(labelled, subjects, None)), False))
    for _ in range(rounds if model.calibration else 0):
        model = calibrated(labelled, Model(subjects, weights(counted(docs, subjects, model)), True))
    return model


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, posterior for every subject of every document that is likelier than not.

    Null, empty and blank texts have none, and without labelled documents nothing has.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)["doc_id"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for rows in batches:
            if own.calibration is None:
                continue
            batch = Batch.of(list(rows.text), list(rows.type_fqn))
            p = own.calibration.posterior(evidence(batch, posteriors(batch, own.w, own.asides)))
            p[np.bincount(batch.owner, minlength=batch.documents) == 0] = 0
            at, subject = np.nonzero(p > 0.5)
            yield pd.DataFrame({"doc_id": rows.doc_id.to_numpy()[at], "subject": np.array(own.subjects, dtype=object)[subject], "posterior": p[at, subject]})

    known = documents.select("doc_id", "text", "type_fqn").where(is_value(F.col("text")))
    return known.mapInPandas(judge, f"doc_id {kind}, subject string, posterior double")


def subject_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The subjects: a small fixed table (62 at most, as masks are 64 bits)."""
    return sorted(r[0] for r in table(spark, sf_dir, "subjects").where("subject IS NOT NULL AND subject <> 'none'").select("subject").distinct().collect())


def document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, names = table(spark, sf_dir, "documents"), subject_names(spark, sf_dir)
    if not names:
        return spark.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, subject string, posterior double")
    return predicted(documents, train(with_masks(documents, table(spark, sf_dir, "doc_labels"), names), names))


def subjects_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found."""
    return document_subjects(spark, sf_dir).select("doc_id", "subject")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, documents, share of all documents; ``none`` for those without a subject."""
    found = written(document_subjects(spark, sf_dir).select("doc_id", "subject"))
    documents = table(spark, sf_dir, "documents").select("doc_id")
    named = documents.join(found, "doc_id", "left").select("doc_id", F.coalesce("subject", F.lit("none")).alias("subject"))
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    counts = named.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))
