import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ferrule.llm import divergence
from ferrule.llm.divergence import audit_divergence, select_top

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    docs, counts, langs = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in TERM.findall(text or "")]
        langs[lang].add(source)
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang, sources in langs.items():
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, rows_ in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(rows_, 1)}
    return out


def result(df):
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "日本", "Zz", "zZ"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s", "t", "ü", None])) for _ in range(n)]
    return rows + [(None, "en", "none"), ("", "xx", "a"), ("ab1ab_ab`ab", "en", "s"), ("a " * 40_000, "en", "s")] + rows[:20]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, 2, "x") for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, value long, term string")


@pytest.mark.parametrize(("least", "top", "block"), [(3, 5, 256), (1, 50, 2), (10**9, 5, 256)])
def test_whole_result(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TERMS", 16)
    rows = made(least)
    assert result(audit_divergence(table(spark, rows), least, top)) == brute(rows, least, top)


def test_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 10)
    rows = made(7, 60)
    assert result(audit_divergence(table(spark, rows), 3, 5)) == brute(rows, 3, 5)


def test_no_rows(spark):
    assert audit_divergence(table(spark, made(1)).where(F.lit(False))).count() == 0


def test_ties_are_told_apart_by_bytes(spark):
    """Values of 31 bits, many of them equal, and items of which one begins with another."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        items = {"".join(rng.choices("ab\x00é😀z", k=rng.randrange(1, 12))) for _ in range(400)} | {"p" * n for n in range(1, 60)}
        rows += [(g, item, rng.choice([7, 7, 7, 7 << 11, 2**31 - 1, 2**31 - 1 - g, 1])) for item in items]
    df = spark.createDataFrame(rows, "g int, item string, v long")
    for k in (1, 50, 300, 10_000):
        got = {(r.g, r["item"], r.v, r["rank"]) for r in select_top(df, ["g"], "v", "item", k).collect()}
        want = set()
        for g in range(4):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            want |= {(*r, i) for i, r in enumerate(own, 1)}
        assert got == want
