from collections import Counter
from math import exp, log

import numpy as np
import pytest

from ferrule.llm.segments import Decoder, Sampler, decode_segmentations, default_path, sample_segmentations


def every(s, text):
    """All segmentations of a text with their log chances, by trying all cuts of each word."""
    import re

    def cuts(word):
        if not word:
            return [(0.0, b"")]
        heads = [(i, w, n) for n in range(1, len(word) + 1) for i, w in [s.vocabulary.get(word[:n], (-1, 0.0))] if i >= 0]
        own = [(w, i.to_bytes(4, "little"), n) for i, w, n in heads]
        if word[0] not in s.vocabulary:
            raw = word[0].encode()
            own.append((sum(s.bytes[b][1] for b in raw), b"".join(s.bytes[b][0].to_bytes(4, "little") for b in raw), 1))
        return [(w + p, x + y) for w, x, n in own for p, y in cuts(word[n:])]

    out = [(0.0, b"")]
    for w in re.findall("▁*[^▁]+|▁+", s.sp.normalize(text)):
        grown = cuts(w)
        whole = log(sum(exp(p) for p, _ in grown))
        out = [(a + b - whole, x + y) for a, x in out for b, y in grown]
    return {ids: p for p, ids in out}


def test_samples_follow_the_lattice():
    s = Sampler(default_path())
    truth = every(s, "ab ca")
    assert sum(map(exp, truth.values())) == pytest.approx(1)
    first, both = Counter(), Counter()
    n = 6000
    for got in s.sample(["ab ca"] * n, 2, [str(i).encode() for i in range(n)]):
        assert len({g[0] for g in got}) == 2 and got[0][3] >= got[1][3]
        assert all(g[2] == pytest.approx(truth[g[0]]) for g in got)
        first[got[0][0]] += 1
        both.update(g[0] for g in got)
    p = {k: exp(v) for k, v in truth.items()}
    for k, x in p.items():
        assert abs(first[k] / n - x) < 4 * (x * (1 - x) / n) ** 0.5 + 1e-3
        second = sum(y * x / (1 - y) for j, y in p.items() if j != k)
        assert abs(both[k] / n - x - second) < 0.03


def test_all_segmentations_of_a_short_text():
    s = Sampler(default_path())
    truth = every(s, "ab")
    got = s.sample(["ab"], 500, [b"1"])[0]
    assert {g[0] for g in got} == set(truth) and {g[4] for g in got} == {0.0}


def test_bytes_and_the_drawn_rest(monkeypatch):
    """With a short search nearly all is drawn word by word; the chances stay those of the lattice."""
    from ferrule.llm import segments

    s = Sampler(default_path())
    for beyond in (40.0, 1.0, -1.0):
        monkeypatch.setattr(segments, "BEYOND", beyond)
        for text in ("a\u0001b \U0001f9ffx c", "the cat ab", "\u4e00\u0002 no"):
            truth, n = every(s, text), 3000
            runs = s.sample([text] * n, 1, [f"{beyond}{i}".encode() for i in range(n)])
            seen = Counter(g[0] for r in runs for g in r)
            assert all(g[2] == pytest.approx(truth[g[0]]) and g[1] == len(g[0]) // 4 for r in runs for g in r)
            if beyond > 0:
                for ids, p in truth.items():
                    x = exp(p)
                    assert abs(seen[ids] / n - x) < 4.5 * (x * (1 - x) / n) ** 0.5 + 2e-3


def test_round_trip_and_seeds(docs_of, odd, sample):
    docs = docs_of(odd, range(-1, -50, -1)).unionByName(sample.limit(40))
    s = Sampler(default_path())
    rows = sample_segmentations(docs, 2, 7)
    got = {(r.doc_id, r.sample): r for r in rows.collect()}
    again = {(r.doc_id, r.sample): r for r in sample_segmentations(docs.repartition(3), 2, 7).collect()}
    assert got == again and got != {(r.doc_id, r.sample): r for r in sample_segmentations(docs, 2, 8).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in decode_segmentations(rows).collect():
        assert r.text == s.sp.decode(s.sp.encode(texts[r.doc_id]))
    for r in sample_segmentations(docs, 2, 7, decoded=True).collect():
        assert r.ids == got[r.doc_id, r.sample].ids and r.text == s.sp.decode(s.sp.encode(texts[r.doc_id]))
    for i in texts:
        assert len({bytes(x.ids) for k, x in got.items() if k[0] == i}) == sum(k[0] == i for k in got) >= 1
    assert all(len(np.frombuffer(bytes(r.ids), "<u4")) == r.n_pieces for r in got.values())
    assert sample_segmentations(docs_of([])).count() == 0


def test_decoding_is_the_library_s():
    s, d = Sampler(default_path()), Decoder(default_path())
    texts = ["", " ", "  a", "a  b ", "\n\n x", "\u4e00\u0002 no", "\U0001f9ff", "\u2581\u2581x", "a\u0000b", "word " * 40_000]
    ids = [s.sp.encode(t) for t in texts]
    assert d.decode([np.array(x, "<u4").tobytes() for x in ids]) == s.sp.decode(ids)
    blank, word = s.sp.piece_to_id("\u2581"), s.sp.encode("word")
    odd = [[], [0], [1, 2], [blank], [blank] * 3, word[:1], [0, *word, 2], [*word, 0, *word], [1, *word]]
    assert d.decode([np.array(x, "<u4").tobytes() for x in odd]) == [s.sp.decode(x) for x in odd]
    assert d.decode([]) == []


def test_null_ids_are_decoded_to_null(spark):
    rows = spark.createDataFrame([(1, 1, None), (None, 1, b"")], "doc_id long, sample int, ids binary")
    assert {(r.doc_id, r.text) for r in decode_segmentations(rows).collect()} == {(1, None), (None, "")}
