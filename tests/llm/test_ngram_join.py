import random
import re

import numpy as np
import pytest

from ferrule.llm.ngram_join import divide_skip, near_duplicates


def sets_of(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows):
    rows = [(d, sets_of(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(s), find(d)) for d, s in rows}


def family(rng, words, n, edits):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"v{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("block", "least"), [(250_000, 64), (300, 64), (100, 2)])
def test_against_brute_force(docs_of, odd, block, least):
    rng = random.Random(5)
    texts = odd + ["A b", "a  B", "one two three four five", "One two three four five six"]
    for words, n, edits in ((30, 12, 2), (120, 25, 8), (60, 10, 4), (6, 6, 1)):
        texts += family(rng, words, n, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{t} {passage}" for t in family(rng, 40, 10, 40)]
    rng.shuffle(texts)
    got = {tuple(r) for r in near_duplicates(docs_of(texts), block_shingles=block, pilots=3, least=least).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(list(enumerate(texts)))


def test_real_documents(sample):
    got = {tuple(r) for r in near_duplicates(sample).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute([(r.doc_id, r.text) for r in sample.collect()])


def test_search_finds_every_component():
    rng = random.Random(1)
    for _ in range(60):
        universe = list(range(1, 60))
        sets = [set(rng.sample(universe, rng.randrange(3, 40))) for _ in range(8)]
        for _ in range(25):
            s = set(rng.choice(sets))
            for _ in range(rng.randrange(4)):
                s ^= {rng.choice(universe)}
            sets.append(s or {1})
        links = divide_skip(list(range(len(sets))), [len(s) for s in sets], [np.array(sorted(s)) for s in sets])
        comp = list(range(len(sets)))
        want = list(range(len(sets)))

        def merge(c, a, b):
            x, y = sorted((c[a], c[b]))
            for i, v in enumerate(c):
                if v == y:
                    c[i] = x

        for a, b in links:
            assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            merge(comp, a, b)
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    merge(want, a, b)
        assert comp == want


def test_no_rows(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_large_arrow_batches(spark):
    """More rows in an Arrow batch than 16 bits number."""
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200_000)
    try:
        docs = spark.range(0, 90_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six n"), (F.col("id") % 7).cast("string")).alias("text"))
        got = near_duplicates(docs.coalesce(1)).groupBy("component_id").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.component_id, r["count"]) for r in got) == [(k, len(range(k, 90_000, 7))) for k in range(7)]


def test_chains_across_blocks(docs_of):
    """Neighbours link, documents further apart do not; no block holds the chain."""
    words = [f"c{k}" for k in range(600)]
    texts = [" ".join(words[4 * k : 4 * k + 80]) for k in range(60)] + [" ".join(words[300 + 30 * k : 330 + 30 * k]) for k in range(8)]
    got = {tuple(r) for r in near_duplicates(docs_of(texts), block_shingles=200, pilots=2).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(list(enumerate(texts))) and len({c for *_, c in got}) < 20


def passages(n, seed, pool=60, of=5, words=30):
    rng = random.Random(seed)
    parts = [" ".join(f"p{k}x{i}" for i in range(words)) for k in range(pool)]
    return [" ".join(rng.sample(parts, of)) for _ in range(n)]


def test_texts_of_shared_passages(docs_of):
    """A family that passages hold together: hardly anyone is in its largest component, some link."""
    texts = passages(160, 1, pool=14)
    texts += [t + " and more" for t in texts[::7]] + [" ".join(reversed(t.split())) for t in texts[:5]]
    got = {tuple(r) for r in near_duplicates(docs_of(texts), block_shingles=2000, pilots=3).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(list(enumerate(texts)))
    assert len({c for *_, c in got}) > 50
