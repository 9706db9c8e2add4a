import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ferrule.llm.packing import assign, capacities, pack_documents
from ferrule.llm.token_files import read_token_files, token_folder, write_token_files
from ferrule.llm.tokens import ChunkEncoder, default_path

TEXTS = ["it's we'll DON'T 'S", "İstanbul ÅÄ ﬁ ½ x²", "a<|endoftext|>b <|startoftext|>", "tab\there\x0bx y z", "日本語 text, mixed.,. 12,345.", "é ́x क़ \U0001f600,", "word. word, word.x ,. ,", "ªº µß.", "\x00 \x1c\x85"]


def plain(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_chunks_encode_as_whole_texts(sample, odd):
    library, ours = Tokenizer.from_file(default_path()), ChunkEncoder(default_path(), most=500)
    texts = TEXTS + [t or "" for t in odd] + [r.text for r in sample.collect()]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(part)] == [plain(library, t) for t in part]


def test_assign_fills_every_sequence():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 300, rng.integers(1, 60))
        doc, start, n, seq, offset, _ = assign(lengths, 64, 1.0, 0.01)
        caps = capacities(int(lengths.sum()), 64)
        assert all(c == 64 or c & (c - 1) == 0 for c in caps.tolist())
        for parts, size, a in ((seq, caps, offset), (doc, lengths, start)):
            for k in range(len(size)):
                at = 0
                for i in sorted(np.flatnonzero(parts == k), key=lambda i: a[i]):
                    assert a[i] == at
                    at += n[i]
                assert at == size[k]


def plainly(lengths, caps, linear, quadratic):
    """The rule as it is said: dearest first, to the cheapest sequence with room for all of it; cut only where none has."""
    room, cost, out = list(caps), [0.0] * len(caps), []
    price = lambda n: linear * n + quadratic * float(n) * n
    for d in sorted(range(len(lengths)), key=lambda d: -price(lengths[d])):
        start, left = 0, lengths[d]
        while left:
            whole = [s for s in range(len(caps)) if room[s] >= left]
            s = min(whole or [s for s in range(len(caps)) if room[s] == max(room)], key=lambda s: (cost[s], s))
            n = min(left, room[s])
            out.append((d, start, n, s, caps[s] - room[s], price(n)))
            room[s], cost[s], start, left = room[s] - n, cost[s] + price(n), start + n, left - n
    return out, cost


@pytest.mark.parametrize(("linear", "quadratic"), [(1.0, 1 / 2048), (0.0, 1.0), (1.0, 0.0)])
def test_assign_follows_the_cost_rule(linear, quadratic):
    rng = np.random.default_rng(5)
    spread = []
    for k in range(30):
        lengths = rng.integers(1, 900 if k % 2 else 60, rng.integers(1, 80))
        caps = capacities(int(lengths.sum()), 256).tolist()
        want, cost = plainly(lengths.tolist(), caps, linear, quadratic)
        got = list(zip(*(x.tolist() for x in assign(lengths, 256, linear, quadratic)), strict=True))
        assert got == want
        full = [c for c, cap in zip(cost, caps, strict=True) if cap == 256]
        # next to sequences filled in the order of the documents
        ends, pieces = np.cumsum(lengths), np.zeros(len(caps))
        for s in range(len(full)):
            inside = np.diff(np.clip(np.concatenate(([0], ends)), 256 * s, 256 * (s + 1)))
            pieces[s] = (linear * inside + quadratic * inside.astype(float) ** 2).sum()
        if k % 2 == 0 and len(full) > 2:
            spread.append((np.std(full), np.std(pieces[: len(full)])))
    if quadratic:
        assert np.mean([a for a, _ in spread]) < np.mean([b for _, b in spread])


@pytest.mark.parametrize("window", [500, 2_000_000])
def test_packing_keeps_every_id(docs_of, odd, sample, window):
    docs = docs_of(odd + TEXTS, range(-1, -100, -1)).unionByName(sample).repartition(3)
    library = Tokenizer.from_file(default_path())
    want = {r.doc_id: plain(library, r.text) for r in docs.collect()}
    pieces = pack_documents(docs, 256, window).collect()
    got, used = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert p.start == len(got.setdefault(p.doc_id, [])) and p.length == len(ids) and p.doc_tokens == len(want[p.doc_id])
        got[p.doc_id] += ids
        used.setdefault(p.sequence_id, []).append(p)
    assert got == want
    for ps in used.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].sequence_tokens and (at == 256 or math.log2(at) % 1 == 0)


def test_files_hold_every_id(spark, docs_of, odd, sample):
    docs = docs_of(odd + TEXTS, range(-1, -100, -1)).unionByName(sample).repartition(3)
    library = Tokenizer.from_file(default_path())
    folder = token_folder(spark)
    got = sorted(read_token_files(write_token_files(docs, folder), folder, batch_tokens=1000).collect())
    at = 0
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got, strict=True):
        want = plain(library, text)
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (doc, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_null_ids_and_no_rows(spark, docs_of):
    folder = token_folder(spark)
    rows = read_token_files(write_token_files(docs_of(["b", "a", "c"], [None, None, 1]), folder), folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1]
    assert len(pack_documents(docs_of(["x", None], [None, None])).collect()) == 2
    none = docs_of([])
    folder = token_folder(spark)
    assert read_token_files(write_token_files(none, folder), folder).count() == 0 and pack_documents(none).count() == 0


def test_long_chunks_are_not_kept():
    library, ours = Tokenizer.from_file(default_path()), ChunkEncoder(default_path())
    texts = ["日本語" * 400, "a" * 500 + ",", "b" * 200 + " short", "x" * 65]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == [plain(library, t) for t in texts]
    assert all(len(c) <= 65 for c in ours.now) and "short" in ours.now
