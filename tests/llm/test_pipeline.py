import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm.toxicity import score_toxicity, train

pipeline = pytest.importorskip("corpus_pipeline")


def sets_of(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    scores = {r.doc_id: r.score for r in score_toxicity(docs, train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.7}
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == rows
    kept = stages["exact_dedup"](spark, kept, sf)
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    rows = {i: rows[i] for i in first.values()}
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == rows
    kept = stages["near_dedup"](spark, kept, sf)
    sets = {i: sets_of(t) for i, t in rows.items()}
    comp = {i: i for i in rows}
    for a in sorted(rows):
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if v == y else v for k, v in comp.items()}
    rows = {i: t for i, t in rows.items() if comp[i] == i}
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == rows
    kept = stages["pii"](spark, kept, sf)
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and got.keys() == rows.keys() and all(r.n_chars == len(r.text) for r in got.values())
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", r.text) for r in got.values())
    total = {}
    for p in stages["packing"](spark, kept, sf).collect():
        assert len(np.frombuffer(bytes(p.ids), "<u4")) == p.length
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total.keys() == got.keys()


def test_odd_rows_through_all_stages(spark, docs_of, odd, sample):
    """Missing and repeated ids, null texts and columns with clashing names: each stage's effect is defined."""
    sf = "/root/testdata/sf0.001"
    extra = ["score", "_score", "id", "_id", "sha", "_sha", "kept", "_kept", "pii", "_text", "_email", "h", "n", "slot"]
    rows = docs_of([*odd, "x", "x", "y", "y", "w me@x.org"], [*range(10**9, 10**9 + len(odd)), None, 10**9 + 3, None, None, None])
    docs = sample.unionByName(rows).select("*", *[F.lit(k).alias(n) for k, n in enumerate(extra)])
    columns = docs.columns
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    kept = docs.where("doc_id is null or doc_id >= 1000000000").collect()
    assert all(tuple(r[n] for n in extra) == tuple(range(len(extra))) for r in kept)
    got = sorted((str(r.doc_id), str(r.text)) for r in kept)
    # of equal texts the smallest id stays, of "y" the one row without an id; white space alone is no duplicate of nothing
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in [*odd, "x", "y", "w <email>"]}
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", "" if t == "None" else t) for _, t in got} == texts and len(got) == len(texts)
    assert ("None", "y") in got and ("None", "w <email>") in got and (str(10**9 + 3), "x") in got
    total = sum(p.length for p in pipeline.STAGES[4][1](spark, docs, sf).collect())
    assert total > docs.count()
    empty = docs_of([])
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_toxicity_judges_rows_not_ids(spark, docs_of, sample):
    sf = "/root/testdata/sf0.001"
    scores = {r.doc_id: r.score for r in score_toxicity(sample, train(sample, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    texts = {r.doc_id: r.text for r in sample.collect()}
    bad, good = (texts[f(scores, key=scores.get)] for f in (max, min))
    assert max(scores.values()) >= 0.7 > min(scores.values())
    # identifiers without labels, so the model stays the same
    odd = docs_of([bad, good, good + " x", bad, good, "", None], [None, None, None, 10**9, 10**9, None, 10**9])
    kept = dict(pipeline.STAGES)["toxicity"](spark, sample.unionByName(odd), sf)
    added = [(r.doc_id, r.text) for r in kept.where("doc_id is null or doc_id = 1000000000").collect()]
    want = [(None, good), (None, good + " x"), (10**9, good), (None, ""), (10**9, None)]
    assert sorted(added, key=str) == sorted(want, key=str) and kept.columns == sample.columns
    assert {r.doc_id for r in kept.where("doc_id < 1000000000").collect()} == {i for i, s in scores.items() if s < 0.7}
