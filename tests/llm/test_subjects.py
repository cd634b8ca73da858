import numpy as np
from pyspark.sql import functions as F

from orrery.llm import subjects as M
from tests.conftest import day, rows


def test_segments_and_grams():
    parts = M.segments("One Two. three\nFour::five(A::Bcde *x)\r\n\r\nBcde", "A::Bcde")
    assert parts == ["one two.", "three", "five(  *x)"]
    same = [set(M.grams([t.lower()])[1]) for t in ("trade offer", "TRADE_OFFER", "tradeOffer", "trade-offer 12")]
    assert all(s == same[0] and len(s) == 6 for s in same)
    seg, gram = M.grams(["abcdef", "xyz", "", "abcdefabcdef"])
    assert set(seg) == {0, 3} and len(gram) == 2 + 6
    assert len(M.grams([])[0]) == 0


def test_counts_do_not_depend_on_partitions(spark, data, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 2)
    names = M.subject_names(spark, data)
    docs = M.with_masks(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/doc_labels.parquet"), names)
    a, b = (M.counted(docs.repartition(n), names, None) for n in (1, 7))
    assert a.sum() > 0 and np.allclose(a, b)


def test_masks(spark):
    labels = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "b", 0), (2, "none", 0), (3, "unheard", 0), (None, "a", 0), (4, None, 0)], "doc_id long, subject string, mask int")
    assert rows(M.labelled_masks(labels, ["a", "b"])) == [(1, 3), (2, 0), (3, 0)]
    assert M.labelled_masks(labels, ["a", "b"], 2).count() == 2


def test_held_out_accuracy(spark):
    """Three of ten labelled documents are kept from training; the labels have some errors of their own."""
    d = "/root/testdata/sf0.1"
    docs, labels, names = M.table(spark, d, "documents"), M.table(spark, d, "doc_labels"), M.subject_names(spark, d)
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)) < 3
    model = M.train(M.with_masks(docs, labels.where(~held), names), names)
    truth, got = {}, {}
    for i, s in labels.where(held).select("doc_id", "subject").distinct().collect():
        truth.setdefault(i, set()).update({s} - {"none"})
    for i, s, _ in M.predicted(docs.join(labels.where(held).select("doc_id").distinct(), "doc_id", "left_semi"), model).collect():
        got.setdefault(i, set()).add(s)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    f1 = 2 * hit / (sum(map(len, truth.values())) + sum(len(got.get(i, set())) for i in truth))
    assert f1 > 0.9, f1


def test_query(spark, catalog):
    subjects = [{"subject": s} for s in ("sound", "light", None, "sound")]
    texts = {"sound": "The mixer bus plays every voice of the reverb zone.", "light": "The shadow pass draws a lamp into the frame buffer."}
    docs = [{"doc_id": i, "text": texts["sound" if i % 2 else "light"] + f" Number {i}.", "type_fqn": None if i % 3 else "A::B"} for i in range(60)]
    docs += [{"doc_id": 100, "text": None}, {"doc_id": 101, "text": ""}, {"doc_id": 102, "text": " \n"}, {"doc_id": 103, "text": texts["sound"] * 3000}]
    labels = [{"doc_id": i, "subject": "sound" if i % 2 else "light", "labelled_at": day(1)} for i in range(40)] * 2 + [{"doc_id": None}, {"doc_id": 9999, "subject": "light"}]
    d = catalog(extra="mask int", documents=docs, doc_labels=labels, subjects=subjects)
    got = set(rows(M.subjects_found(spark, d)))
    assert {(i, "sound" if i % 2 else "light") for i in range(40, 60)} <= got and (103, "sound") in got
    assert not {i for i, _ in got} & {100, 101, 102}
    share = {r.subject: r for r in M.composition(spark, d).collect()}
    assert share["none"].documents == 3 and abs(sum(r.share for r in share.values()) - 1) < 1e-9


def test_empty(spark, catalog):
    assert rows(M.subjects_found(spark, catalog())) == []
    assert rows(M.subjects_found(spark, catalog(subjects=[{"subject": "a"}]))) == []
    assert rows(M.subjects_found(spark, catalog(subjects=[{"subject": "a"}], documents=[{"doc_id": 1, "text": "some text"}]))) == []
