import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ferrule.llm import filter_audit
from ferrule.llm.filter_audit import audit_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(docs):
    """The filters that each row fails, straight from the definitions."""
    out = []
    for i, t, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs) else set()
        out.append(f)
    return out


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails, out = failing(docs), set()
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        removed_by, rows = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed_by[x] += len(gone)
                redundant = sum(x in f and bool(f & set(order[: step - 1])) for _, f in own)
                rows.append((x, "".join(order), step, len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out |= {(part, *r[1:], removed_by[r[0]]) for r in rows}
    return out


def result(df):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, None, "en"), (2, "", "en"), (3, "", "fr"), (4, LONG, "en"), (5, LONG, "en"), (5, LONG, "fr"), (4, LONG, "en"), (6, LONG + " #", None), (7, LONG + " AAAAAAAA" * 20, ""), (8, "a " * 300, "en"),
    (None, LONG, "en"), (None, LONG, "en"), (9, "É 日本" * 100, "fr"), (10, "a\x0bb\x0cc\x1cd\xa0e " * 100, "fr"), (-3, "$ $", "fr"), (12, "$ $", "en"), (13, LONG + " x" * 250, "en"), (14, "Aa " + LONG * 90, "de"), (15, "$ $", "de"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (5, None, 1), (5, 1, None), (5, 0, 0), (8, 1, 0), (None, 1, 1), (99, 1, 1), (12, 0, 1)]


def tables(spark, docs):
    rows = spark.createDataFrame([(i, t, g, None, "x", 3) for i, t, g in docs], "doc_id long, text string, lang string, first string, part string, good int")
    return rows, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_whole_result(spark, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    docs, labels = tables(spark, DOCS)
    assert result(audit_filters(docs, labels)) == brute(DOCS, LABELS)


def test_a_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert result(audit_filters(docs, labels)) == want


def test_no_rows(spark):
    docs, labels = tables(spark, DOCS)
    assert audit_filters(docs.where(F.lit(False)), labels).count() == 0
    assert result(audit_filters(docs, labels.where(F.lit(False)))) == brute(DOCS, [])
