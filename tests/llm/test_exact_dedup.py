import hashlib
import random
import re

import pytest

from ferrule.llm.exact_dedup import Trie, exact_groups


def brute(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(g := groups[norm(t)]), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("limit", [2000, 48 << 20])
def test_against_brute_force(docs_of, odd, sample, limit):
    rng = random.Random(4)
    texts = odd + ["".join(rng.choices("ab \t\n", k=rng.randrange(8))) for _ in range(400)] + ["long " * 999 + c for c in "aabbb"]
    docs = docs_of(texts, range(-1, -len(texts) - 1, -1)).unionByName(sample)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in exact_groups(docs, limit).collect()) == brute(rows)


def test_trie_holds_what_it_was_given():
    rng, trie, want = random.Random(1), Trie(), {}
    for i in range(3000):
        body = bytes(rng.choices(b"ab", k=rng.randrange(9)))
        trie.add(body, -i, 1, None)
        o, c = want.get(body, (1, 0))
        want[body] = (min(o, -i), c + 1)
    spilled = list(trie.spill())
    assert {b: (o, c) for _, b, o, c in [*spilled, *trie.drain()]} == want and len(spilled) + len(list(trie.drain())) == len(want)


def test_null_ids_repeats_and_no_rows(docs_of):
    rows = exact_groups(docs_of(["x", "x ", "x", "y"], [None, 5, 5, None])).collect()
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows)
    assert got == [("5", "5", 1, True), ("5", "5", 2, True), ("None", "5", 2, False), ("None", "None", 1, True)]
    assert exact_groups(docs_of([])).count() == 0
