"""An n-gram language model with Katz backoff, trained, stored and applied by Spark jobs.

A batch is the words of some documents as numbers.  Each order is one exchange:
a batch sends its distinct n-grams to slots by their context, and a slot counts
them and answers with what it has counted.  Texts that are scored, but not
trained on, send theirs along, so each n-gram travels once.  For a model that
scores other tables, counts and backoff weights are tables of such slots in the
shared folder, in which a slot looks up what is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, discard, learns, parallelism, saved, saved_at, text_of, tidy
from ferrule.llm.routing import PACKED, SPREAD, deal, emit, exchange, from_docs, groups, pack, unpack
from ferrule.llm.words import mix, word_hashes

SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Stand for the end of a text (a token) and its start (a context only).
END, START = np.uint64(0xE4D), np.uint64(0x57A87)
#: Good-Turing discounts apply to counts up to this.
K = 5
#: Added to each context's count, so that some mass for unseen words is always left.
FLOOR = 0.01
#: Bytes of text of a batch, and parts in which n-grams of three words or more travel, so that fewer are on disk at once.
BATCH, TURNS = 3 << 20, 2
_JOIN = np.uint64(0xD6E8FEB86659FD93)
#: Slots of statistics, and kinds of rows (in the place of a batch's number).
STATS, HOT = -1, -2
FACTS, WORDS, GRAMS, CONTEXTS, BACKOFF = -1, -2, -3, -4, -5


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K from the counts of counts n[r], r = 0..K+1.

    Katz's form: (r*/r - A) / (1 - A) with r* = (r+1) n[r+1] / n[r] and
    A = (K+1) n[K+1] / n[1].  Where that is no number in (0, 1] (few data), the
    count is lowered by a half instead.
    """
    d = np.ones(K + 1)
    a = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        x = (star / r - a) / (1 - a) if a < 1 else 0.0
        d[r] = x if 0 < x <= 1 else (r - 0.5) / r
    return d


def _kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discount of each count; d[0] is 1, as for counts beyond K."""
    return np.append(d, d[0])[np.minimum(c, K + 1)]


class Unigrams:
    """Discounted probabilities of words by their count; those of count 0 are one event."""

    def __init__(self, n: int, v: int, counts: np.ndarray):
        self.n, self.v, self.d = n, v, discounts(counts)
        left = FLOOR + sum((1 - self.d[r]) * r * counts[r] for r in range(1, K + 1))
        self.unseen = left / (n + FLOOR)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _kept(c, self.d) * c / (self.n + FLOOR), self.unseen)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, the end of each text included, and how many each text has."""
    h, n = word_hashes(texts)
    at = np.cumsum(n)
    return np.insert(h, at, END), n + 1


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * _JOIN + word)


def _sorted(key: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key``, in which equal n-grams stand together, and where each of these begins."""
    order = np.argsort(key)
    k, g = key[order], gram[order]
    new = g[1:] != g[:-1]
    if (new & (k[1:] == k[:-1])).any():
        # n-grams with one key: whichever others are sorted along, these have an order
        order = np.lexsort((gram, key))
        g = gram[order]
        new = g[1:] != g[:-1]
    return order, np.concatenate((np.zeros(1, np.int64), np.flatnonzero(new) + 1))


def _grouped(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of ``v``, then ``w`` (below 2^40), of fewer than 2^24 pairs."""
    order = np.argsort(v)
    x = v[order]
    at = np.empty(len(v), np.uint64)
    at[order] = np.cumsum(np.concatenate(([False], x[1:] != x[:-1]))).astype(np.uint64)
    if len(v) >= 1 << 24 or int(w.max()) >= 1 << 40:
        return np.lexsort((w, v))
    return np.argsort((at << np.uint64(40)) | w)


def _keys(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's k - 1 words before it, and of these with it; texts start with START as often as needed."""
    start, gram, context = np.full(1, START), h, h
    for j in range(2, k + 1):
        context = np.concatenate((gram[:1], gram[:-1]))
        context[first] = start
        gram = _joined(context, h)
        start = _joined(start, np.full(1, START))
    return context, gram


def _chance(c: np.ndarray, before: np.ndarray, d: np.ndarray, a: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 chances of n-grams of count ``c``: a discounted share of the context's count, or what a shorter context gives."""
    seen = np.log10(_share(np.maximum(c, 1), before, d))
    return np.where(c > 0, seen, np.where(before > 0, a + low, low))


def _share(c: np.ndarray, before: np.ndarray, d: np.ndarray) -> np.ndarray:
    return _kept(c, d) * c / (before + FLOOR)


class Batch:
    """A batch's state: what is known of its n-grams of up to ``level`` words.

    Facts are counts of each token's n-gram, and weights where there is no count; chances follow from them,
    and are worked out only where they are asked for."""

    def __init__(self, facts: dict, uni: Unigrams, ends: int, d: dict[int, np.ndarray]):
        self.facts, self.level, n, self.ends = facts, facts["level"], facts["n"], ends
        own = np.cumsum(facts["own"]).astype(np.uint64)
        self.w, self.h, self.first = own[facts["inv"]], mix(own + _JOIN)[facts["inv"]], np.cumsum(n) - n
        self.c = facts["c1"][facts["inv"]].astype(np.int64)
        # under: how often the words before each token occur at this level, before: at the next
        self.under, self.before, self._uni, self._d, self._levels = None, self._preceding(), uni, d, [(self.c, None)]
        for k in range(2, self.level + 1):
            self.c = facts[f"c{k}"].astype(np.int64)
            self._levels.append((self.c, self.before))
            self.under, self.before = self.before, self._preceding()

    def chances(self) -> np.ndarray:
        """log10 chances of all tokens at this level."""
        p = np.log10(self._uni(self._levels[0][0]))
        for k, (c, before) in enumerate(self._levels[1:], 2):
            a = np.zeros(len(c))
            a[c == 0] = self.facts[f"a{k}"]
            p = _chance(c, before, self._d[k], a, p)
        return p

    def _preceding(self) -> np.ndarray:
        out = np.concatenate((self.c[:1], self.c[:-1]))
        out[self.first] = self.ends
        return out

    def grams(self, slots: int, share: int, turns: int = 1, turn: int = 0) -> Grams:
        return Grams(self, self.level + 1, slots, share, turns, turn)


class Grams:
    """The distinct n-grams of a batch, by slot, then context; a frequent context has several slots, by the word after it.

    They are sorted once, by slot and some bits of the context and the n-gram: where contexts share these bits, one
    may come in several stretches, which the slots add up. Of several ``turns``, only the slots of one are sorted."""

    def __init__(self, of: Batch, k: int, slots: int, share: int, turns: int = 1, turn: int = 0):
        context, gram = _keys(of.h, of.first, k)
        wide, spread = of.before // share + 1, mix(context)
        slot, hot = _slot(spread, slots), wide > 1
        far = np.flatnonzero(hot)
        slot[far] = (slot[far] + (mix(of.w[far]) % wide[far].astype(np.uint64)).astype(np.int64)) % slots
        bits = int(slots).bit_length()
        key = (slot.astype(np.uint64) << np.uint64(64 - bits)) | ((spread & np.uint64((1 << 22) - 1)) << np.uint64(42 - bits)) | (gram >> np.uint64(22 + bits))
        if turns > 1:
            here = np.flatnonzero(slot % turns == turn)
            self.order, self.start = _sorted(key[here], gram[here]) if len(here) else (here, here)
            self.order = here[self.order]
        else:
            self.order, self.start = _sorted(key, gram)
        self.at = at = self.order[self.start]
        self.cut = np.searchsorted(slot[at], np.arange(slots + 1))
        self.v, self.w, self.hot, self.low_c = context[at], of.w[at], hot[at], of.c[at]
        self.under = None if of.under is None else of.under[at]

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """How many of each n-gram's tokens are ``counted``."""
        return np.add.reduceat(counted[self.order].astype(np.int64), self.start) if len(self.start) else np.zeros(0, np.int64)

    def of_tokens(self, x: np.ndarray) -> np.ndarray:
        """A value of each n-gram for each of its tokens."""
        out = np.empty(len(self.order), x.dtype)
        out[self.order] = np.repeat(x, np.diff(np.append(self.start, len(self.order))))
        return out

    def parts(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(slot, its n-grams, where a context starts among them)."""
        for s in np.flatnonzero(np.diff(self.cut)).tolist():
            part = slice(self.cut[s], self.cut[s + 1])
            v = self.v[part]
            yield s, part, np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))

    def named(self, part: slice, edge: np.ndarray) -> dict:
        return {"v": self.v[part][edge], "n": _small(np.diff(np.append(edge, part.stop - part.start))), "w": _small(self.w[part])}


def _sequences(batch: int, ids: list, texts: list, trains: list) -> Iterable[tuple[int, int, bytes]]:
    h, n = _tokens(texts)
    own, inv = np.unique(h, return_inverse=True)
    yield batch, FACTS, pack(ids=ids, n=n, own=own, inv=inv.astype(np.uint32), trains=np.array(trains, bool))


def _trained_on(facts: dict) -> np.ndarray:
    """For each token, whether its text counts."""
    return np.repeat(facts["trains"], facts["n"])


def _each(rows: DataFrame, f: Callable[[int, dict], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """Packed rows from ``f(slot, body)`` of each packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(r for b in batches for slot, body in zip(b.column("slot").to_pylist(), b.column("body").to_pylist(), strict=True) for r in f(slot, unpack(body)))

    return rows.mapInArrow(run, PACKED)


def _by_word(slots: int, counts: bool):
    """A batch's words, which are sorted, and so are their slots."""

    def run(batch: int, x: dict) -> Iterable[tuple[int, int, bytes]]:
        cut = np.searchsorted(_slot(x["own"], slots), np.arange(slots + 1))
        c = np.bincount(x["inv"], _trained_on(x), len(x["own"])).astype(np.int64) if counts else None
        for s in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[s], cut[s + 1])
            yield s, batch, pack(h=x["own"][part], **({"c": _small(c[part])} if counts else {}))

    return run


def _rates(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]


def _word_totals(slots: int):
    """Counts of a slot's words, and their numbers, by which they go from then on; words not trained on all have number 0."""

    def run(slot: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
        own, inv = np.unique(np.concatenate([x["h"] for _, x in rows]), return_inverse=True)
        total = np.bincount(inv, np.concatenate([x["c"] for _, x in rows]), len(own)).astype(np.int64)
        known = total > 0
        yield STATS, slot, pack(n=int(total.sum()), v=int(known.sum()), r=_rates(total))
        yield slot, WORDS, pack(h=own[known], c=_small(total[known]))
        number, at = np.where(known, _number(np.cumsum(known) - 1, slot, slots), 0), 0
        for batch, x in rows:
            mine = inv[at : at + len(x["h"])]
            at += len(mine)
            yield batch, slot, pack(c=_small(total[mine]), w=_small(number[mine]))

    return run


def _number(at: np.ndarray, slot: int, slots: int) -> np.ndarray:
    return at * slots + slot + 1


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """The values of ``wanted`` among sorted ``keys``."""
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.array(missing, values.dtype))


def _word_answers(slots: int):
    def run(slot: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
        table = next((x for kind, x in rows if kind == WORDS), {"h": np.zeros(0, np.uint64), "c": np.zeros(0, np.uint8)})
        number = _number(np.arange(len(table["h"])), slot, slots)
        for batch, x in rows:
            if batch >= 0:
                yield batch, slot, pack(c=_small(_found(table["h"], table["c"].astype(np.int64), x["h"], 0)), w=_small(_found(table["h"], number, x["h"], 0)))

    return run


def _with_words(batch: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
    facts = next(x for kind, x in rows if kind == FACTS)
    # in the order of slots, which is that of the words' hashes; numbers ascend in a slot, so their steps are small
    c, w = (np.concatenate([x[name] for kind, x in rows if kind >= 0]) for name in ("c", "w"))
    steps = np.diff(w.astype(np.int64), prepend=0)
    yield batch, FACTS, pack(**(facts | {"own": steps.astype(np.int32) if len(w) and w.max() < 1 << 31 else steps}), level=1, c1=_small(c))


def _counted(places: Places, turns: int, turn: int):
    """A batch's n-grams one word longer than its state, with their counts and what a shorter context's chance follows from; those of one turn."""

    def run(batch: int, facts: dict) -> Iterable[tuple[int, int, bytes]]:
        grams = Batch(facts, places.uni, places.ends, places.d).grams(places.slots, places.share, turns, turn)
        c = grams.counts(_trained_on(facts))
        for s, part, edge in grams.parts():
            under = {} if grams.under is None else {"under": _small(grams.under[part][edge])}
            yield s, batch, pack(**grams.named(part, edge), hot=grams.hot[part][edge], c=_small(c[part]), low=_small(grams.low_c[part]), **under)

    return run


def _totals(places: Places, level: int, tables: bool):
    """Counts of a slot's n-grams; for each context, how many words after it have count 1..K, and their chances by a shorter context.

    Each batch gets the counts of its n-grams, and of a context before one without a count what its weight will follow from."""

    def run(slot: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
        cat = lambda f: np.concatenate([f(x) for _, x in rows])
        v, w, c, low = cat(lambda x: np.repeat(x["v"], x["n"])), cat(lambda x: x["w"]).astype(np.uint64), cat(lambda x: x["c"]), cat(lambda x: x["low"])
        hot = cat(lambda x: np.repeat(x["hot"], x["n"]))
        order = _grouped(v, w)
        v, w = v[order], w[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        edge = np.flatnonzero(new)
        total = np.add.reduceat(c[order].astype(np.int64), edge)
        one, v, w = order[edge], v[edge], w[edge]
        yield STATS, slot, pack(r=_rates(total))
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        n = np.diff(np.append(starts, len(v)))
        at = np.repeat(np.arange(len(n)), n)
        few = (total > 0) & (total <= K)
        m = np.bincount(at[few] * (K + 1) + total[few], minlength=len(n) * (K + 1)).reshape(-1, K + 1)
        low = low[one].astype(np.int64)
        if level == 2:
            chance = places.uni(low)
        else:
            chance = _share(low, cat(lambda x: np.repeat(x["under"], x["n"]))[one].astype(np.int64), places.d[level - 1])
        taken = np.bincount(at, np.where(total > 0, chance, 0.0), len(n))
        whole, is_hot = np.add.reduceat(total, starts), hot[one][starts]
        if tables:
            yield slot, GRAMS, pack(v=v[starts], n=_small(n), w=_small(w), c=_small(total))
            yield slot, CONTEXTS, pack(m=m.astype(np.uint32), taken=taken, total=whole, hot=is_hot)
        if is_hot.any():
            yield HOT, slot, pack(v=v[starts][is_hot], m=m[is_hot], taken=taken[is_hot], total=whole[is_hot])
        rest = _log_rest(np.where(is_hot, 0.5, taken), whole)
        place, i = np.empty(len(order), np.int64), 0
        place[order] = np.cumsum(new) - 1
        for batch, x in rows:
            n = x["n"].astype(np.int64)
            first = np.cumsum(n) - n
            mine = place[i : i + int(n.sum())]
            i += len(mine)
            c, context = total[mine], at[mine[first]]
            asked = (np.add.reduceat(c == 0, first) > 0) & (whole[context] > 0) & ~is_hot[context]
            few = context[asked]
            yield batch, slot, pack(c=_small(c), asked=np.packbits(asked), m=_small(m[few, 1:]), rest=rest[few])

    return run


def _log_backoff(m: np.ndarray, rest: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What the discounts leave, over the mass of the words not seen after a context; the last columns of ``m`` do."""
    left = ((1 - d) * np.arange(K + 1))[-m.shape[-1] :]
    return np.log10(FLOOR + m @ left) - rest


def _log_rest(taken: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log10(total + FLOOR) + np.log10(1 - taken)


def _weights(d: np.ndarray):
    def run(slot: int, x: dict) -> Iterable[tuple[int, int, bytes]]:
        # a context with several slots has its weight with the model's statistics
        whole = np.where(x["hot"], 0.5, x["taken"])
        yield slot, BACKOFF, pack(a=_log_backoff(x["m"], _log_rest(whole, x["total"]), d))

    return run


def _asked(places: Places):
    def run(batch: int, facts: dict) -> Iterable[tuple[int, int, bytes]]:
        grams = Batch(facts, places.uni, places.ends, places.d).grams(places.slots, places.share)
        for s, part, edge in grams.parts():
            yield s, batch, pack(**grams.named(part, edge))

    return run


def _answers(slot: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
    """Counts of the n-grams asked for, and the backoff weight of each context that needs it."""
    table = dict(r for r in rows if r[0] in (GRAMS, BACKOFF))
    if table:
        g = table[GRAMS]
        key = _joined(np.repeat(g["v"], g["n"]), g["w"].astype(np.uint64))
        order = np.argsort(key)
        key, count, v, weight = key[order], g["c"].astype(np.int64)[order], g["v"], table[BACKOFF]["a"]
    else:
        key, count, v, weight = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    for batch, x in rows:
        if batch >= 0:
            c = _found(key, count, _joined(np.repeat(x["v"], x["n"]), x["w"].astype(np.uint64)), 0)
            n = x["n"].astype(np.int64)
            new = np.add.reduceat(c == 0, np.cumsum(n) - n) > 0
            yield batch, slot, pack(c=_small(c), a=np.where(new, _found(v, weight, x["v"], 0.0), 0.0))


def _evaluated(places: Places, k: int, hot: tuple[np.ndarray, np.ndarray]):
    """For each token of the state, its n-gram of ``k`` words: a count, and the context's weight where there is none."""

    def run(batch: int, rows: list[tuple[int, dict]]) -> tuple[dict, Batch, np.ndarray, np.ndarray]:
        facts = next(x for kind, x in rows if kind == FACTS)
        answers = {kind: x for kind, x in rows if kind >= 0}
        state = Batch(facts, places.uni, places.ends, places.d)
        grams = state.grams(places.slots, places.share)
        c, a = np.zeros(len(grams.v), np.int64), np.zeros(len(grams.v))
        for s, part, edge in grams.parts():
            x = answers[s]
            c[part] = x["c"]
            if "a" in x:
                weights = x["a"]
            else:
                weights = np.zeros(len(edge))
                weights[np.unpackbits(x["asked"], count=len(edge)) > 0] = _log_backoff(x["m"], x["rest"], places.d[k])
            a[part] = np.repeat(weights, np.diff(np.append(edge, part.stop - part.start)))
        far = np.flatnonzero(grams.hot)
        a[far] = _found(*hot, grams.v[far], 0.0)
        return facts, state, grams.of_tokens(c), grams.of_tokens(a)

    return run


def _next_state(evaluate):
    def run(batch: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
        facts, state, c, a = evaluate(batch, rows)
        k = state.level + 1
        yield batch, FACTS, pack(**(facts | {"level": k, f"c{k}": _small(c), f"a{k}": a[c == 0]}))

    return run


def _sums(places: Places, evaluate, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = places.uni
        for batch, rows in groups(batches):
            if evaluate:
                facts, state, c, a = evaluate(batch, rows)
                p = _chance(c, state.before, places.d[state.level + 1], a, state.chances())
            else:
                facts = next(x for kind, x in rows if kind == FACTS)
                state = Batch(facts, uni, places.ends, places.d)
                p = state.chances()
            c1 = facts["c1"][facts["inv"]].astype(np.int64)
            total = lambda x: np.add.reduceat(x, state.first)  # noqa: B023, E731
            base = total(np.log10((c1 + 0.5) / (uni.n + 0.5 * (uni.v + 1))))
            yield as_batch(schema, [facts["ids"], facts["n"], total((c1 > 0).astype(np.int64)), np.full(len(base), uni.n), base, total(p)])

    return run


def _collected(table: DataFrame, kind: int) -> list[dict]:
    """The rows of one kind; there is at most one a slot, and a slot's size does not depend on the corpus."""
    return [unpack(bytes(r.body)) for r in table.where(F.col("slot") == kind).select("body").toLocalIterator()]


@dataclass
class Places:
    """What tasks need to know of a model: it decides where an n-gram is (a context's
    count beyond a share of all is spread over slots), and chances by counts."""

    uni: Unigrams
    ends: int
    slots: int
    share: int
    d: dict[int, np.ndarray]


@dataclass
class Model:
    """A trained model: tables of counts and backoff weights in the shared
    folder, in slots by context, and the statistics that go with them."""

    order: int
    slots: int
    uni: Unigrams
    ends: int
    words: DataFrame | None
    grams: dict[int, DataFrame] = field(default_factory=dict)
    backoff: dict[int, DataFrame] = field(default_factory=dict)
    d: dict[int, np.ndarray] = field(default_factory=dict)
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def places(self) -> Places:
        return Places(self.uni, self.ends, self.slots, max(1, self.uni.n // (2 * self.slots)), self.d)


def _batches(docs: DataFrame) -> tuple[DataFrame, str]:
    """The words of ``docs`` (doc_id, text, trains) as written batches, so that all later steps see the same ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), "trains")
    return saved_at(from_docs(rows, _sequences, BATCH, ["trains"]))


def _with_answers(state: DataFrame, path: str, tables: list[tuple[DataFrame, str]], f) -> tuple[DataFrame, str]:
    """The next state of each batch by ``f``, from what ``tables`` answer; they and the state before go."""
    after, now = saved_at(exchange(_and_answers(state, tables), f))
    for p in (path, *[p for _, p in tables]):
        discard(state.sparkSession, p)
    return after, now


def _and_answers(state: DataFrame, tables: list[tuple[DataFrame, str]]) -> DataFrame:
    for t, _ in tables:
        state = state.unionByName(t.where("slot >= 0 and batch >= 0"))
    return state


def _train(docs: DataFrame, order: int, tables: bool) -> tuple[Model, DataFrame, list[tuple[DataFrame, str]]]:
    """A model of the texts of ``docs`` that are marked as ``trains``; the state of all
    of them, but for the last order, whose answers come with it (none for order 1)."""
    slots = parallelism(docs) * SPREAD
    batches, path = _batches(docs)
    table, there = saved_at(exchange(_each(batches, _by_word(slots, True)), _word_totals(slots)))
    stats = _collected(table, STATS)
    uni = Unigrams(sum(s["n"] for s in stats), sum(s["v"] for s in stats), sum((s["r"] for s in stats), np.zeros(K + 2)))
    words = saved(table.where(F.col("batch") == WORDS)) if tables else None
    model = Model(order, slots, uni, docs.where("trains").count(), words)
    state, now = _with_answers(batches, path, [(table, there)], _with_words)
    found: list[tuple[DataFrame, str]] = []
    for k in range(2, order + 1):
        turns = 1 if k == 2 else TURNS
        found = [saved_at(exchange(_each(state, _counted(model.places, turns, t)), _totals(model.places, k, tables))) for t in range(turns)]
        d = discounts(sum((s["r"] for t, _ in found for s in _collected(t, STATS)), np.zeros(K + 2)))
        sums: dict[int, list] = {}
        for x in (x for t, _ in found for x in _collected(t, HOT)):
            for v, *parts in zip(x["v"].tolist(), x["m"], x["taken"], x["total"], strict=True):
                sums[v] = [a + b for a, b in zip(sums.get(v, (0, 0.0, 0)), parts, strict=True)]
        hot = sorted(sums)
        m, taken, total = (np.array([sums[v][i] for v in hot]) for i in range(3))
        model.d[k], model.hot[k] = d, (np.array(hot, np.uint64), _log_backoff(m, _log_rest(taken, total), d) if hot else np.zeros(0))
        if tables:
            kind = lambda x: reduce(DataFrame.unionByName, [t.where(F.col("batch") == x) for t, _ in found])  # noqa: B023, E731
            model.grams[k], model.backoff[k] = saved(kind(GRAMS)), saved(_each(kind(CONTEXTS), _weights(d)))
        if k < order:
            state, now = _with_answers(state, now, found, _next_state(_evaluated(model.places, k, model.hot[k])))
    return model, state, found


def _known_words(batches: DataFrame, path: str, model: Model) -> tuple[DataFrame, str]:
    answers = saved_at(exchange(_each(batches, _by_word(model.slots, False)).unionByName(model.words), _word_answers(model.slots)))
    return _with_answers(batches, path, [answers], _with_words)


def _asked_and_answered(state: DataFrame, model: Model, k: int) -> list[tuple[DataFrame, str]]:
    return [saved_at(exchange(_each(state, _asked(model.places)).unionByName(model.grams[k]).unionByName(model.backoff[k]), _answers))]


def fit(docs: DataFrame, order: int = 3) -> Model:
    """Train a model of ``order`` words on every text of ``docs`` (doc_id, text).

    Counts are discounted after Good and Turing, each order by its own counts of
    counts.  A context's backoff weight is what the discounts leave over the
    mass of the words not seen after it, so each context's chances sum to one.
    All counts stay in tables of slots in the shared folder; the driver gets
    counts of counts, and the weights of the contexts that are spread over
    several slots, of which there are fewer than twice as many as slots.
    """
    return _train(docs.withColumn("trains", F.lit(True)), order, True)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of ``docs``.

    Orders are evaluated one after another, each from the one before: an n-gram
    with a count has its discounted share of its context; one without has the
    shorter one's chance, times the context's weight if the context is known."""
    state, now = _known_words(*_batches(docs.withColumn("trains", F.lit(False))), model)
    for k in range(2, model.order):
        state, now = _with_answers(state, now, _asked_and_answered(state, model, k), _next_state(_evaluated(model.places, k, model.hot[k])))
    return _scored(model, state, _asked_and_answered(state, model, model.order) if model.order > 1 else [])


def _scored(model: Model, state: DataFrame, answers: list[tuple[DataFrame, str]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCORES))
    evaluate = _evaluated(model.places, model.order, model.hot[model.order]) if model.order > 1 else None
    return deal(_and_answers(state, answers)).mapInArrow(_sums(model.places, evaluate, schema), SCORES)


@tidy
def katz_scores(docs: DataFrame, mod: int = 5, held: int = 1, order: int = 3) -> DataFrame:
    """What ``score`` gives for every text of ``docs`` (doc_id, text) under a model of those
    whose crc32(doc_id as text) mod ``mod`` is not ``held``, with held_out.  Counting
    and looking up are one exchange an order, and no table of counts is kept.

    Tokens are the words (split at white space, A-Z lower-cased) and one end.
    Null or empty texts are an end alone; a long text is scored whole.  Repeated
    rows count and are scored each; a null doc_id counts as the text ''.  No
    rows give no rows; other columns of ``docs`` play no part.
    """
    scored = _scored(*_train(docs.withColumn("trains", learns("doc_id", mod, held)), order, False))
    return scored.select("doc_id", (~learns("doc_id", mod, held)).alias("held_out"), *[c.split()[0] for c in SCORES.split(", ")[1:]])
