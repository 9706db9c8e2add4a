import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from ferrule.llm.fingerprints import STEPS, WIDTH, edited, entropies, fingerprint_documents, fingerprints, from_string, histogram, likeness, ranks


def test_entropies_of_every_window():
    rng = np.random.default_rng(1)
    for n in (10, 64, 65, 300):
        data = rng.choice(np.frombuffer(b"aabbccdefgh ", np.uint8), n)
        want = [-sum(c / WIDTH * math.log2(c / WIDTH) for c in Counter(data[i : i + WIDTH].tolist()).values()) for i in range(n - WIDTH + 1)]
        assert np.abs(entropies(data) - np.array(want) * STEPS / 6).max(initial=0) <= 0.51


def test_joined_texts_and_single_ones_agree():
    rng = np.random.default_rng(2)
    rank = ranks(rng.integers(0, 9, STEPS + 1))
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefghij klm", np.uint8), n)) for n in (0, 5, 64, 700, 3000, 30_000)] + [b"a" * 500]
    together = fingerprints(texts, rank)
    for t, f in zip(texts, together, strict=True):
        alone = fingerprints([t], rank)[0]
        assert alone.shape == f.shape and (alone == f).all()
    assert likeness(together[3], together[4]) < 0.2 and likeness(together[4], together[4]) == 1
    assert len(together[0]) == 0 and len(together[5]) > 1


@pytest.mark.parametrize("parts", [1, 3])
def test_every_document_meets_its_next(spark, docs_of, odd, sample, parts):
    docs = docs_of(odd, range(-1, -50, -1)).unionByName(sample).repartition(parts)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for (i, t), (j, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 2
        changed = t[: len(t) - k] + following[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        f = from_string(r.fingerprint)
        assert r.near_edited == likeness(f, from_string(r.edited_fingerprint)) and r.near_next == likeness(f, from_string(got[j].fingerprint))
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    long = [i for i, t in rows if len(t) > 2000]
    near = lambda c: sorted(getattr(got[i], c) for i in long)[len(long) // 2]
    assert near("near_edited") > near("near_next") + 0.2


def test_ties_nulls_and_no_rows(docs_of):
    got = fingerprint_documents(docs_of(["x", None, "x", "y" * 200, "z"], [7, None, 7, None, 8])).collect()
    assert len(got) == 5
    assert len(fingerprint_documents(docs_of(["only " * 50])).collect()) == 1
    assert fingerprint_documents(docs_of([])).count() == 0


def test_short_texts_stay_near_when_half_is_kept(spark, sample):
    """Prose cut to every length from 2 bytes on: half of a text is kept, so some likeness is left, and little to other texts."""
    prose = [r.text.encode() for r in sample.orderBy("doc_id").collect() if r.text and r.text.isascii() and len(r.text) > 600]
    cut = [prose[k % len(prose)][7 * k % 40 :][: 2 + k] for k in range(600)]
    rank = ranks(histogram(prose))
    changed = [edited(t.decode(), cut[k - 200].decode()).encode() for k, t in enumerate(cut)]
    own, other = fingerprints(cut, rank), fingerprints(changed, rank)
    near = np.array([likeness(a, b) for a, b in zip(own, other, strict=True)])
    far = np.array([likeness(own[k], own[k - 200]) for k in range(600)])
    for low in (0, 14, 30, 62, 125, 198, 298, 400):
        assert np.median(near[low : low + 100]) > 0.15
    assert (near == 0).mean() < 0.02 and np.quantile(far, 0.95) < 0.1
    alone = [fingerprints([t], rank)[0] for t in cut[::40]]
    assert all((a == b).all() for a, b in zip(alone, own[::40], strict=True))


def plain_fingerprint(data, rank):
    """Selection and filters with sets and loops: the windows that are the rarest of enough runs of windows."""
    import ferrule.llm.fingerprints as f

    n = len(data) - WIDTH + 1
    features = []
    if n > 0:
        step = [round(-sum(c / WIDTH * math.log2(c / WIDTH) for c in Counter(data[i : i + WIDTH]).values()) * STEPS / 6) for i in range(n)]
        size = next((r for r in f.RIVALS if n >= f.SHARE * r), f.RIVALS[-1])
        # runs go on beyond the text's end, where windows are worse than all
        wins = Counter(min(range(i, min(i + size, n)), key=lambda j: (rank[step[j]], j)) for i in range(n))
        features = [data[i : i + WIDTH] for i in sorted(wins) if wins[i] >= size // 4]
    return features


def test_selection_by_brute_force():
    """Features are the same set whichever way they are found; equal features set equal bits, and bits overlap as sets do."""
    from ferrule.llm.fingerprints import BITS, FILL, HASHES, _chunks, _select

    rng = np.random.default_rng(9)
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefgh ijklm\n", np.uint8), n)) for n in (40, 95, 130, 200, 300, 700, 2500)]
    texts += [texts[-1][:1500] + texts[-2]]
    rank = ranks(histogram(texts))
    near_half = 0
    for t in texts:
        (data, starts), = _chunks([t])
        at = _select(data, starts, rank[0])
        got, want = [t[i : i + WIDTH] for i in at], plain_fingerprint(t, rank[0])
        # entropies on the edge between two steps may be told apart either way
        assert len(set(got) ^ set(want)) <= max(2, len(want) // 50)
        if len(t) >= 128:
            f = fingerprints([t], rank)[0]
            assert f.shape == (-(-len(at) // FILL), BITS // 8)
            assert np.bitwise_count(f).sum() <= HASHES * len(at) and np.bitwise_count(f).sum() > 0.8 * HASHES * min(len(at), FILL * len(f)) * 0.85
    a, b = fingerprints(texts[-2:], rank)
    common = set(plain_fingerprint(texts[-2], rank[0])) & set(plain_fingerprint(texts[-1], rank[0]))
    share = len(common) / len(set(plain_fingerprint(texts[-1], rank[0])))
    assert 0.3 < share < 0.9 and abs(likeness(a, b) - share) < 0.35


def test_short_windows_by_brute_force():
    """Windows up to each byte, the rarest of each four in a row, whole texts apart from each other."""
    from ferrule.llm.fingerprints import SHORT, _short_features

    rng = np.random.default_rng(4)
    rank = rng.permutation(STEPS + 1)
    texts = [bytes(rng.choice(np.frombuffer(b"abcde f\x00", np.uint8), n)) for n in (1, 2, 3, 4, 5, 8, 20, 60, 127)] + [b"a" * 50]
    whose, h = _short_features(texts, rank)
    for k, t in enumerate(texts):
        padded = bytes(SHORT - 1) + t
        windows = [padded[i : i + SHORT] for i in range(len(t))]
        step = [round((3 + sum(-c / SHORT * math.log2(c / SHORT) - 0 for c in Counter(w).values()) - 3) * STEPS / 6) for w in windows]
        won = {min(range(i, min(i + 4, len(t))), key=lambda j: (rank[step[j]], j)) for i in range(len(t))}
        mine = h[whose == k]
        assert len(mine) == len(won) and len(set(mine.tolist())) == len({windows[j] for j in won})
