import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ferrule.llm import katz
from ferrule.llm.katz import FLOOR, K, discounts, fit, katz_scores, score
from ferrule.llm.routing import unpack


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Brute:
    """Katz's model from its definition: grams[k] counts n-grams of k words."""

    def __init__(self, texts, order):
        self.order, self.grams, self.after = order, [None] + [Counter() for _ in range(order)], defaultdict(list)
        for t in texts:
            w = tokens(t)
            for k in range(1, order + 1):
                padded = ["<s>"] * (k - 1) + w
                self.grams[k].update(tuple(padded[i : i + k]) for i in range(len(w)))
        self.uni = Counter({g[0]: c for g, c in self.grams[1].items()})
        self.n = sum(self.uni.values())
        rates = [None] + [[sum(x == r for x in c.values()) for r in range(K + 2)] for c in self.grams[1:]]
        self.d = [None] + [discounts(r) for r in rates[1:]]
        self.unseen = (FLOOR + sum((1 - self.d[1][r]) * r * rates[1][r] for r in range(1, K + 1))) / (self.n + FLOOR)
        for c in self.grams[2:]:
            for g, n in c.items():
                self.after[g[:-1]].append((g[-1], n))
        self.weight = {}

    def p(self, w, context):
        k = len(context) + 1
        c = self.grams[k][*context, w]
        cut = lambda c: self.d[k][c] if c <= K else 1
        if k == 1:
            return cut(c) * c / (self.n + FLOOR) if c else self.unseen
        whole = sum(n for _, n in self.after[context])
        if c:
            return cut(c) * c / (whole + FLOOR)
        if not whole:
            return self.p(w, context[1:])
        if context not in self.weight:
            left = 1 - sum(cut(n) * n for _, n in self.after[context]) / (whole + FLOOR)
            self.weight[context] = left / (1 - sum(self.p(b, context[1:]) for b, _ in self.after[context]))
        return self.weight[context] * self.p(w, context[1:])

    def score(self, text):
        w = tokens(text)
        padded = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(x, tuple(padded[i : i + self.order - 1]))) for i, x in enumerate(w))


def compare(rows, got, order):
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    model = Brute([t for i, t in rows if learns(i)], order)
    v = len(model.uni)
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = tokens(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(i), len(w), sum(model.uni[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.uni[x] + 0.5) / (model.n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-9)
    return model


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_and_normalisation(docs_of, odd, order):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = odd + [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts))
    model = compare(rows, katz_scores(docs_of(texts), order=order), order)
    for k in range(order):
        contexts = [c for c in model.after if len(c) == k][:40] + [("never",) * k]
        for v in contexts:
            assert sum(model.p(w, v) for w in model.uni) + model.p("?", v) == pytest.approx(1)


def test_real_documents(sample):
    compare([(r.doc_id, r.text) for r in sample.collect()], katz_scores(sample, order=2), 2)


def test_a_stored_model_scores_another_table(docs_of, spark):
    """Tables are read from the shared folder; rows come in any order, null and repeated ids each."""
    train = ["a b c d", "a b c e", "b c d", "x y"] * 3
    model = fit(docs_of(train), order=3)
    brute = Brute(train, 3)
    texts = ["a b c d", "b c e z", None, "a b c d", "q", "y x"]
    other = docs_of(texts, [None, 7, 7, 7, None, 1])
    for rows in (score(other, model), score(other.orderBy("text").repartition(3), model)):
        got = sorted((str(r.doc_id), round(r.score, 8), r.n_known) for r in rows.collect())
        want = sorted((str(i), round(brute.score(t), 8), sum(brute.uni[w] > 0 for w in tokens(t))) for i, t in zip([None, 7, 7, 7, None, 1], texts, strict=True))
        assert got == want
    assert model.grams[3].count() and model.backoff[3].count() and set(model.grams) == {2, 3}


def test_large_arrow_batches(spark):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200_000)
    try:
        docs = spark.range(0, 90_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b n"), (F.col("id") % 7).cast("string")).alias("text"))
        got = katz_scores(docs.coalesce(1), order=2).groupBy(F.col("doc_id") % 7).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 7 and all(r.hi - r.lo < 1e-9 and r.lo < 0 for r in got)


def test_no_rows(docs_of):
    assert katz_scores(docs_of([])).count() == 0
    assert katz_scores(docs_of(["a", "b"]), mod=1, held=0).count() == 2


def test_query_takes_the_operators_order(monkeypatch):
    from ferrule.llm import katz, queries

    seen = {}
    monkeypatch.setattr(queries, "_table", lambda *_: None)
    monkeypatch.setattr(katz, "katz_scores", lambda docs, **more: seen.update(more))
    queries.op10_katz(None, "")
    assert seen.get("order", 3) == 3


def test_what_travels(sample, monkeypatch):
    """Texts are read once; of an n-gram few bytes travel, and few stay with its batch."""
    from ferrule.llm import katz

    reads, sent, kept = [], [], []
    from_docs, exchange, saved_at = katz.from_docs, katz.exchange, katz.saved_at
    size = lambda df: sum(len(r.body) for r in df.where("slot >= 0").select("body").collect())

    def seen(name, into, df, f):
        into.append(size(df))
        return f(df)

    monkeypatch.setattr(katz, "from_docs", lambda *a, **k: reads.append(1) or from_docs(*a, **k))
    monkeypatch.setattr(katz, "exchange", lambda rows, f: seen("sent", sent, rows, lambda r: exchange(r, f)))
    monkeypatch.setattr(katz, "saved_at", lambda df: seen("kept", kept, df, saved_at))
    n = sum(r.n_tokens for r in katz_scores(sample, order=3).collect())
    assert len(reads) == 1 and max(sent) < 8 * n and max(kept) < 5 * n


def test_a_turn_sorts_its_own_ngrams_only():
    """Turns have the n-grams of the whole between them, in its order, and none sorts those of another."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 500) for _ in range(20)]
    facts = unpack(next(iter(katz._sequences(0, list(range(20)), texts, [True] * 20)))[2])
    own = np.arange(len(facts["own"]))
    facts |= {"own": np.diff(own, prepend=0), "level": 1, "c1": np.bincount(facts["inv"])}
    state = katz.Batch(facts, katz.Unigrams(int(facts["n"].sum()), len(own), katz._rates(facts["c1"])), 20, {})
    whole, turns = state.grams(12, 50), [state.grams(12, 50, 2, t) for t in range(2)]
    pairs = lambda g: {s: (g.v[p].tolist(), g.w[p].tolist()) for s, p, _ in g.parts()}
    assert sum(len(t.order) for t in turns) == len(whole.order) and pairs(turns[0]) | pairs(turns[1]) == pairs(whole)
    # each n-gram once, however few bits contexts share, and its tokens counted
    assert len(set(zip(whole.v.tolist(), whole.w.tolist(), strict=True))) == len(whole.v) and whole.counts(np.ones(len(whole.order), bool)).sum() == len(whole.order)
    gram = rng.integers(0, 50, 2000).astype(np.uint64)
    order, start = katz._sorted(gram % np.uint64(5), gram)
    assert len(start) == len(set(gram.tolist())) and np.array_equal(gram[order][start], np.array(sorted(set(gram.tolist()), key=lambda x: (x % 5, x)), np.uint64))
