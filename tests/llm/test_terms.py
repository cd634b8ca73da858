import random
import re
from collections import Counter

from orrery.llm import terms as M
from tests.conftest import rows

FIELDS = [{"table_name": "type_references", "field_name": "type_string", "min_records": 3, "max_record_share": 0.4}, {"table_name": "struct_members", "field_name": "type_string", "min_records": 2, "max_record_share": 0.5}]


def brute(records):
    """records: (id, text)."""
    occ, rec, one = Counter(), Counter(), {}
    for k, (i, t) in enumerate(records):
        key = i if i is not None else f"none{k}"
        one[key] = max(one.get(key) or "", t or "") or None
    for t in one.values():
        found = [x.lower() for x in re.findall(r"\w+", t or "")]
        occ.update(found)
        rec.update(set(found))
    return occ, rec, len(one)


def test_counts(spark, catalog, monkeypatch):
    monkeypatch.setattr(M, "WIDTH", 8)
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["const", "Énd", "a_b", "X", "x"]
    refs = [(i, " ".join(r.choices(words, k=r.randint(0, 6))) + " CONST*" * (i % 2)) for i in range(300)] + [(5000, None), (5001, ""), (5002, " :: "), (None, "w1"), (None, "w1")]
    members = [(i // 2, "int q" if i // 2 % 3 else "int") for i in range(100)]  # all delivered twice
    d = catalog(term_limits=FIELDS, type_references=[{"id": i, "type_string": t} for i, t in refs], struct_members=[{"id": i, "type_string": t} for i, t in members])
    want = set()
    for name, records, least, share in (("type_references", refs, 3, 0.4), ("struct_members", members, 2, 0.5)):
        occ, rec, n = brute(records)
        want |= {(name, t, occ[t], rec[t], "rare" if rec[t] < least else "common" if rec[t] > share * n else None) for t in occ}
    assert set(rows(M.marked_terms(spark, d))) == want
    assert set(rows(M.terms_found(spark, d))) == {(a, b, m) for a, b, _, _, m in want if m}


def test_blocks_flush(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(M, "BLOCK_TERMS", 10)
    batches = [pa.RecordBatch.from_pydict({"part": pa.array([0, 1], pa.int32()), "terms": [[f"t{k}", "a", "a"], ["b"]], "once": [[f"t{k}", "a"], ["b"]]}) for k in range(30)]
    out = pa.Table.from_batches(M._block_counts(iter(batches))).to_pandas().groupby(["part", "term"]).sum()
    assert tuple(out.loc[(0, "a")]) == (60, 30) and tuple(out.loc[(1, "b")]) == (30, 30) and len(out) == 32


def test_empty_and_long(spark, catalog):
    assert rows(M.marked_terms(spark, catalog())) == []
    assert rows(M.marked_terms(spark, catalog(term_limits=FIELDS))) == []
    d = catalog(term_limits=FIELDS, type_references=[{"id": 1, "type_string": "ab " * 200_000}])
    assert rows(M.marked_terms(spark, d)) == [("type_references", "ab", 200_000, 1, "rare")]
