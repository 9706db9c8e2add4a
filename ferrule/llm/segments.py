"""Sampled SentencePiece segmentations: Gumbel top-k, without replacement.

Each text is searched best first over parts of its lattice.  A part is all
completions of a path's beginning; its value is the largest perturbed log chance
among them.  The best part is opened: its best completion is drawn, and what is
left of it falls into the parts that leave this completion piece by piece.  A
batch of texts is worked on at once, as arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from math import exp, expm1, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, small_batches, text_of

SCHEMA = "doc_id long, sample int, ids binary, n_pieces long, log_prob double, perturbed double, inclusion_log double"
#: Parts that leave a completion behind this many nats have less than 1e-17 of the mass of those before, less than a random number resolves.
BEYOND = 40.0
NONE = float("-inf")
#: How pieces write a blank.
BLANK = "▁"
Sample = tuple[bytes, int, float, float, float]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers, one for each of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(key: np.ndarray, n) -> np.ndarray:
    """The n-th random 64-bit number of each key."""
    return _mixed(key + (np.atleast_1d(n).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _before(x: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of what stands before each element of ``x`` in its group.

    In units of 2**-36, so that it does not depend on the batch."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(np.round(x * 2.0**36).astype(np.int64), out=total[1:])
    return (total[:-1] - np.repeat(total[first], lengths)) * 2.0**-36


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _placed(place: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(sum(map(len, parts)), np.result_type(*parts))
    for at, x in zip(place, parts, strict=True):
        out[at] = x
    return out


def _stretches(share: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares end to end in units of 2**-36; where each group (from ``off`` on) begins, and its length."""
    upto = np.zeros(len(share) + 1, np.int64)
    np.cumsum(np.round(share * 2.0**36).astype(np.int64), out=upto[1:])
    return upto[1:], upto[off[:-1]], np.diff(upto[off])


def _chosen(upto: np.ndarray, low: np.ndarray, span: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The elements of groups whose shares the numbers ``u`` in [0, 1) fall into."""
    return np.searchsorted(upto, low + np.minimum((u * span).astype(np.int64), span - 1), "right")


class Pieces:
    """A vocabulary as a tree of its pieces' characters: the child of a node by a character stands in a hash table."""

    def __init__(self, weights: dict[str, tuple[int, float]]):
        number = {"": 0}
        for piece in weights:
            for n in range(1, len(piece) + 1):
                number.setdefault(piece[:n], len(number))
        self.longest = max(map(len, weights))
        keys = np.array([(number[x[:-1]] << 21) + ord(x[-1]) for x in number if x], np.int64)
        bits = len(keys).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            done = self.keys[slot] == keys[left]
            self.child[slot[done]] = left[done] + 1
            slot, left = (slot[~done] + 1) & self.mask, left[~done]
        self.first = np.zeros(0x110000, np.int64)
        self.first[keys[keys < 1 << 21]] = np.flatnonzero(keys < 1 << 21) + 1
        self.piece, self.weight = (np.array(x) for x in zip(*(weights.get(x, (-1, NONE)) for x in number), strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Children of nodes by characters, 0 where there is none."""
        key = (node << 21) + code
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.child[slot], 0)
        at = np.flatnonzero((there != key) & (there >= 0))
        while len(at):  # the slot is another's: look into the next one
            slot[at] = (slot[at] + 1) & self.mask
            there = self.keys[slot[at]]
            same = there == key[at]
            out[at[same]] = self.child[slot[at[same]]]
            at = at[~same & (there >= 0)]
        return out


class Lattices:
    """The segmentations of many words.

    Nodes are positions in words, those nearest to a word's end first; edges are
    pieces, in the order of their nodes (``off``: a node's first).  ``step`` is the log chance of an edge given that
    the path got to its node, ``to`` the next node (-1: the word's end).  A
    character outside the vocabulary is a chain of bytes.
    """

    def __init__(self, words: list[str], pieces: Pieces, byte_ids: list[tuple[int, float]]):
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = len(codes)
        self.start = np.cumsum(lengths) - lengths
        left = np.repeat(self.start + lengths, lengths) - np.arange(n)
        # nodes by their distance from the end, so that those that may follow come before
        order = np.argsort(left.astype(np.uint16) if n and lengths.max() < 1 << 16 else left, kind="stable")
        number = np.empty(n + 1, np.int64)
        number[order], number[n] = np.arange(n), n
        self.start = number[self.start]
        source, size, piece, weight, rank = [], [], [], [], []
        state, at = pieces.first[codes], np.arange(n)
        single, degree = pieces.piece[state] >= 0, np.zeros(n, np.int64)
        for length in range(1, pieces.longest + 1):
            on = np.flatnonzero(state)
            at, state = at[on], state[on]
            if not len(at):
                break
            hit = np.flatnonzero(pieces.piece[state] >= 0)
            p, q = at[hit], state[hit]
            source.append(p)
            rank.append(degree[p])
            degree[p] += 1
            size.append(length)
            piece.append(pieces.piece[q])
            weight.append(pieces.weight[q])
            on = np.flatnonzero(left[at] > length)
            at, state = at[on], state[on]
            state = pieces.next(state, codes[at + length])
        lone = np.flatnonzero(~single)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[lone].tolist()]
        source.append(lone)
        rank.append(degree[lone])
        degree[lone] += 1
        size.append(1)
        piece.append(np.array([byte_ids[r[0]][0] for r in raw], np.int64))
        weight.append(np.array([sum(byte_ids[b][1] for b in r) for r in raw], np.float64))
        degree, off = degree[order], np.zeros(n + 1, np.int64)
        np.cumsum(degree, out=off[1:])
        place = [off[number[x]] + r for x, r in zip(source, rank, strict=True)]
        # a word's end counts as node n here
        follow = [np.where(left[x] == k, n, number[np.minimum(x + k, n)]) for x, k in zip(source, size, strict=True)]
        to, piece, weight = (_placed(place, x) for x in (follow, piece, weight))

        # log mass of all that may follow a node, from the words' ends on
        mass, step, top_one = np.zeros(n + 1), np.empty(len(to)), np.empty(len(to), bool)
        cuts = np.flatnonzero(np.diff(left[order], prepend=0)).tolist()
        for x, y in zip(cuts, [*cuts[1:], n], strict=True):
            a, b = int(off[x]), int(off[y])
            t, first, many = weight[a:b] + mass[to[a:b]], off[x:y] - a, degree[x:y]
            top = np.maximum.reduceat(t, first)
            t -= np.repeat(top, many)
            top_one[a:b] = t == 0
            rest = np.log(np.add.reduceat(np.exp(t), first))
            mass[x:y] = top + rest
            step[a:b] = t - np.repeat(rest, many)
        to[to == n] = -1
        source, best, e = np.repeat(np.arange(n), degree), np.zeros(n, np.int64), np.flatnonzero(top_one)[::-1]
        best[source[e]] = e
        # bytes after the first of a character: nodes with one edge each
        more = [(e, r) for e, r in zip(off[number[lone] + 1].tolist(), raw, strict=True) if len(r) > 1]
        extra_id, extra_to, node = [], [], n
        for end, r in more:
            e = end - 1  # found last, so it may stand anywhere among the node's edges
            while piece[e] != byte_ids[r[0]][0]:
                e -= 1
            then, to[e] = int(to[e]), node
            for b in r[1:]:
                node += 1
                extra_id.append(byte_ids[b][0])
                extra_to.append(node)
            extra_to[-1] = then
        extra = node - n
        self.off = np.concatenate([off, off[-1] + np.arange(1, extra + 1)])
        self.piece = np.concatenate([piece, np.array(extra_id, np.int64)]).astype("<u4")
        self.to = np.concatenate([to, np.array(extra_to, np.int64)])
        self.step = np.concatenate([step, np.zeros(extra)])
        self.node = np.concatenate([source, np.arange(n, n + extra)])
        self._likely(np.concatenate([best, len(step) + np.arange(extra)]))

    def _likely(self, best: np.ndarray) -> None:
        """One likely segmentation of each word (the ``best`` edge of each node), and all pieces that leave it, with their chances."""
        self.main, self.count, self.chance = self._walk(self.start, lambda who, node, i: best[node])
        self.at = np.cumsum(self.count) - self.count
        lp = _before(self.step[self.main], self.at, self.count)
        edge, self.parent = self.leaving(self.main)
        word = np.repeat(np.arange(len(self.count)), self.count)[self.parent]
        self.leave, self.leave_lp = edge, lp[self.parent] + self.step[edge]
        mass = np.exp(self.leave_lp)
        total = np.bincount(word, mass, len(self.count))
        ends = np.searchsorted(word, np.arange(len(self.count) + 1))
        self.leave_upto, self.leave_low, self.leave_span = _stretches(mass / np.where(total > 0, total, 1.0)[word], ends)
        self.likely = np.where(self.leave_span > 0, 1 - total, 1.0)

    def leaving(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other edges of the nodes of ``edges``, and which of these each belongs to."""
        x = self.node[edges]
        degree = self.off[x + 1] - self.off[x]
        other, parent = _spans(self.off[x], degree), np.repeat(np.arange(len(edges)), degree)
        kept = other != edges[parent]
        return other[kept], parent[kept]

    def _walk(self, node: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths from ``node`` to the words' ends: edges (one path after another), number and log chance of each."""
        count, chance, found, who = np.zeros(len(node), np.int64), np.zeros(len(node)), [], np.arange(len(node))
        while len(who):
            e = choose(who, node, len(found))
            found.append((who, e))
            count[who] += 1
            chance[who] += self.step[e]
            node = self.to[e]
            on = np.flatnonzero(node >= 0)
            node, who = node[on], who[on]
        at, edges = np.cumsum(count) - count, np.empty(int(count.sum()), np.int64)
        for i, (who, e) in enumerate(found):
            edges[at[who] + i] = e
        return edges, count, chance

    def rests(self, node: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Random rests of words from ``node`` on."""

        def choose(who, at, i):
            low, degree = self.off[at], self.off[at + 1] - self.off[at]
            off = np.zeros(len(at) + 1, np.int64)
            np.cumsum(degree, out=off[1:])
            upto, start, span = _stretches(np.exp(self.step[_spans(low, degree)]), off)
            return low - off[:-1] + _chosen(upto, start, span, _uniform(_numbered(random[who], i + 1)))

        return self._walk(node, choose)

    def draw(self, word: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Random segmentations of words: the likely one, or one that leaves it somewhere and goes on at random."""
        u, q = _uniform(_numbered(random, 0)), self.likely[word]
        count, chance = self.count[word], self.chance[word]
        own = u < q
        left = np.flatnonzero(~own)
        w = word[left]
        x = _chosen(self.leave_upto, self.leave_low[w], self.leave_span[w], (u[left] - q[left]) / (1 - q[left]))
        e, kept = self.leave[x], self.parent[x] - self.at[w]
        on = np.flatnonzero(self.to[e] >= 0)
        edges, more, lp = self.rests(self.to[e[on]], random[left[on]])
        count[left], chance[left] = kept + 1, self.leave_lp[x]
        count[left[on]] += more
        chance[left[on]] += lp
        at, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int64)
        n = count[own]
        out[_spans(at[own], n)] = self.main[_spans(self.at[word[own]], n)]
        out[_spans(at[left], kept)] = self.main[_spans(self.at[w], kept)]
        out[at[left] + kept] = e
        out[_spans(at[left[on]] + kept[on] + 1, more)] = edges
        return out, count, chance


class Sampler:
    """Pieces get log chances that fall with the logarithm of their merge rank, as word frequencies do."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i))]
        norm = log(sum(1 / (r + 2) for r in range(len(ids))))
        weight = {i: -log(r + 2) - norm for r, i in enumerate(ids)}
        self.vocabulary = {self.sp.id_to_piece(i): (i, weight[i]) for i in ids if not self.sp.is_byte(i)}
        at = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [(i, weight.get(i, -20.0)) for i in at]
        self.pieces = Pieces(self.vocabulary)
        # pieces do not cross from one word into the next, nor over a line break unless they have one
        stops = "".join(c for c in "\n\r\t" if not any(c in x for x in self.vocabulary))
        self.unit = re.compile(f"▁*[^▁{stops}]+|▁+" + f"|[{stops}]+" * bool(stops))

    def sample(self, texts: list[str], k: int, keys: list[bytes]) -> list[list[Sample]]:
        """For each text up to ``k`` distinct segmentations: ids, pieces, log chance, perturbed log chance, log inclusion chance."""
        units = [self.unit.findall(self.sp.normalize(t)) for t in texts]
        out: list[list[Sample]] = [[(b"", 0, 0.0, 0.0, 0.0)] for _ in texts]
        full = [i for i, u in enumerate(units) if u]
        if not full:
            return out
        units = [units[i] for i in full]
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__  # a new word gets the next number
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        words = np.fromiter(map(index.__getitem__, chain.from_iterable(units)), np.int64, int(lengths.sum()))
        lattices = Lattices(list(index), self.pieces, self.bytes)
        random = np.array([int.from_bytes(hashlib.blake2b(keys[i], digest_size=8).digest(), "little") for i in full], np.uint64)
        for i, got in zip(full, self._sampled(lattices, words, lengths, random, k), strict=True):
            out[i] = got
        return out

    def _drawn(self, lattices: Lattices, node: np.ndarray, words: np.ndarray, rest: np.ndarray, keys: np.ndarray):
        """Random completions, one a text: of a begun word (``node``, -1 if none), then of ``rest`` whole words.

        Gives edges, pieces and log chance of each word, begun ones included, text by text."""
        begun = node >= 0
        n = rest + begun
        at, drawn = np.cumsum(n) - n, []
        whole = np.ones(int(n.sum()), bool)
        whole[at[begun]] = False
        own = keys[whole]
        for a in range(0, len(words), 1 << 18):  # as many as fit in the caches
            drawn.append(lattices.draw(words[a : a + (1 << 18)], own[a : a + (1 << 18)]))
        edges, count, chance = (np.concatenate(x) for x in zip(*drawn, strict=True)) if drawn else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if not begun.any():
            return n, edges, count, chance
        first, few, lp = lattices.rests(node[begun], keys[~whole])
        counts, chances = np.empty(len(whole), np.int64), np.empty(len(whole))
        counts[whole], counts[~whole], chances[whole], chances[~whole] = count, few, chance, lp
        out, start = np.empty(len(edges) + len(first), np.int64), np.cumsum(counts) - counts
        out[_spans(start[whole], count)] = edges
        out[_spans(start[~whole], few)] = first
        return n, out, counts, chances

    def _sampled(self, lattices: Lattices, words: np.ndarray, lengths: np.ndarray, random: np.ndarray, k: int) -> list[list[Sample]]:
        """Open the best part of each text, ``k`` times.

        The largest value of the whole is a Gumbel number; those of parts that
        leave a completion of value z are independent Gumbel numbers about
        their log mass, given that they are below z."""
        first = np.cumsum(lengths) - lengths
        out: list[list[Sample]] = [[] for _ in lengths]
        parts: list[list[tuple]] = [[] for _ in lengths]  # -value, sample left, its pieces kept, edge taken, its word, log chance
        docs, value = np.arange(len(lengths)), -np.log(-np.log(_uniform(_numbered(random, 0))))
        base, word, node = np.zeros(len(docs)), np.zeros(len(docs), np.int64), np.full(len(docs), -1)
        heads = [b""] * len(docs)
        for s in range(k):
            # complete each opened part at random
            rest = lengths[docs] - word
            begun = node >= 0
            whole = rest - begun
            keys = _numbered(np.repeat(_numbered(random[docs], (1 << 40) + s), rest), _spans(word, rest))
            n, edges, count, chance = self._drawn(lattices, node, words[_spans(first[docs] + word + begun, whole)], whole, keys)
            token = np.cumsum(n) - n
            ends = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=ends[1:])
            lo, hi = ends[token], ends[token + n]
            lp = base + np.bincount(np.repeat(np.arange(len(docs)), n), chance, len(docs))
            tail = lattices.piece[edges].tobytes()
            kept = np.fromiter((len(h) // 4 for h in heads), np.int64, len(heads))
            for doc, h, a, b, p, v in zip(docs.tolist(), heads, lo.tolist(), hi.tolist(), lp.tolist(), value.tolist(), strict=True):
                ids = h + tail[4 * a : 4 * b]
                out[doc].append((ids, len(ids) // 4, p, v, 0.0))
            # the parts that leave the completions
            before = _before(chance, token, n)
            ahead = np.bincount(np.repeat(np.arange(len(docs)), n), before >= -BEYOND, len(docs)).astype(np.int64)
            size = ends[token + ahead] - lo
            e = edges[_spans(lo, size)]
            at = np.cumsum(size) - size
            lp_before = np.repeat(base, size) + _before(lattices.step[e], at, size)
            owner = np.repeat(np.arange(len(docs)), size)
            in_word = np.repeat(_spans(word, ahead), count[_spans(token, ahead)])
            index = _spans(kept, size)
            other, parent = lattices.leaving(e)
            mass = lp_before[parent] + lattices.step[other]
            text = owner[parent]
            many = np.bincount(text, minlength=len(docs))
            bits = _numbered(np.repeat(_numbered(random[docs], (1 << 41) + s), many), _spans(np.zeros(len(docs), np.int64), many))
            values = -np.logaddexp(-value[text], np.log(-np.log(_uniform(bits))) - mass)
            stop, most = np.cumsum(many).tolist(), k - s
            for i, (doc, b) in enumerate(zip(docs.tolist(), stop, strict=True)):
                a = b - int(many[i])
                if a == b:
                    continue
                v = values[a:b]
                top = np.argpartition(-v, most - 1)[:most] if len(v) > most else np.arange(len(v))
                for x in (top + a).tolist():
                    y = parent[x]
                    heapq.heappush(parts[doc], (-float(values[x]), s, int(index[y]), int(other[x]), int(in_word[y]), float(mass[x])))
            # open the best part of each text that has one
            docs_, opened = [], []
            for doc in docs.tolist():
                if parts[doc] and s + 1 < k:
                    docs_.append(doc)
                    opened.append(heapq.heappop(parts[doc]))
            if not docs_:
                break
            negative, left, cut, e, word, base = zip(*opened, strict=True)
            docs, value, base, e, word = np.array(docs_), -np.array(negative), np.array(base), np.array(e), np.array(word)
            node = lattices.to[e]
            word = word + (node < 0)
            heads = [out[doc][j][0][: 4 * c] + int(i).to_bytes(4, "little") for doc, j, c, i in zip(docs_, left, cut, lattices.piece[e], strict=True)]
        for doc, own in enumerate(out):
            if parts[doc]:
                bar = -parts[doc][0][0]
                out[doc] = [(ids, n, p, v, _inclusion(p - bar)) for ids, n, p, v, _ in own]
        return out


def _inclusion(x: float) -> float:
    """Log of the chance of a Gumbel number about ``x`` to be above 0."""
    return 0.0 if x > 4 else log(-expm1(-exp(x))) if x > -30 else x


@lru_cache(2)
def sampler(path: str) -> Sampler:
    return Sampler(path)


class Decoder:
    """The texts of piece ids: the bytes of all pieces stand end to end and are gathered by id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def raw(i: int) -> bytes:
            if sp.is_control(i) or sp.is_unused(i):
                return b""
            if sp.is_byte(i):
                return bytes([int(sp.id_to_piece(i)[3:5], 16)])
            return (sp.decode([i]) if sp.is_unknown(i) else sp.id_to_piece(i).replace(BLANK, " ")).encode()

        pieces = [raw(i) for i in range(sp.get_piece_size())]
        self.length = np.array([len(x) for x in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.marked = np.array([sp.id_to_piece(i).startswith(BLANK) for i in range(len(pieces))])
        blank = sp.piece_to_id(BLANK)
        #: whether the model takes one blank off a first piece that begins with it, or all of them
        self.one, self.all = (not sp.decode([blank] * n) for n in (1, 2))

    def decode(self, samples: list[bytes]) -> list[str]:
        """Bytes that are not UTF-8 become U+FFFD."""
        ids = np.frombuffer(b"".join(samples), "<u4")
        cut = (ids[at : at + (1 << 16)] for at in range(0, len(ids), 1 << 16))
        whole = b"".join(self.flat[_spans(self.start[x], self.length[x])].tobytes() for x in cut)
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[ids], out=upto[1:])
        ends = [0, *upto[np.cumsum([len(x) // 4 for x in samples], dtype=np.int64)].tolist()]
        # the first piece of each text that has any bytes
        first = np.searchsorted(upto, ends[:-1], "right") - 1
        marked = [k < len(ids) and bool(self.marked[ids[k]]) for k in first.tolist()]
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in pairwise(ends)]
        return [t if not m else t.lstrip(" ") if self.all else t.removeprefix(" ") if self.one else t for t, m in zip(texts, marked, strict=True)]


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sample_segmentations(docs: DataFrame, k: int = 2, seed: int = 0, model: str | None = None, decoded: bool = False) -> DataFrame:
    """``k`` distinct segmentations of every text of ``docs`` (doc_id, text),
    sampled without replacement in proportion to their probability.

    ids are little-endian unsigned 32 bit; perturbed is the Gumbel-perturbed log
    probability, in whose order samples are numbered from 1; inclusion_log is
    the log of the chance to be among the sample given its threshold (0 where
    all segmentations are returned).  The random numbers depend on ``seed`` and
    doc_id alone, so the same row gives the same samples anywhere.  Pieces are
    drawn by chances in units of 2**-36.  With ``decoded`` each sample also has
    text, what its ids stand for; it is made in the same step, so that a task
    keeps one Python worker.

    A text without pieces (null, empty) gives one empty segmentation; texts with
    fewer than ``k`` segmentations give all of them.  Rows of a null doc_id
    share one key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    columns, path = SCHEMA + ", text string" * decoded, model or default_path()
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sampler(path)
        for b in small_batches(batches, "text", 1 << 20):
            ids = b.column("doc_id").to_pylist()
            got = one.sample(b.column("text").to_pylist(), k, [f"{seed}:{doc}".encode() for doc in ids])
            rows = [(doc, n, *x) for doc, samples in zip(ids, got, strict=True) for n, x in enumerate(samples, 1)]
            if rows:
                made = list(zip(*rows, strict=True))
                yield as_batch(schema, made + ([decoder(path).decode(made[2])] if decoded else []))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, columns)


def decode_segmentations(samples: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, sample and the text that the ids of each sample stand for.

    No ids give an empty text; null ids and null doc_ids stay null."""
    path = model or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = decoder(path)
        for b in small_batches(batches, "ids", 1 << 20):
            ids = b.column("ids").to_pylist()
            texts = one.decode([x or b"" for x in ids])
            yield as_batch(schema, [b.column("doc_id"), b.column("sample"), [None if x is None else t for x, t in zip(ids, texts, strict=True)]])

    return samples.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
