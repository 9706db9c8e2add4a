"""Document fingerprints of improbable features in chained Bloom filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, parallelism, small_batches, text_of

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of a window; windows that compete in a long text and in ever shorter ones (a quarter of them is the wins that select a feature).
WIDTH, RIVALS = 32, (64, 32, 16, 8)
#: A text has at least so many windows for each that competes, down to the least of RIVALS.
SHARE = 8
#: Texts under TINY bytes are also looked at by shorter windows, one up to each of their bytes, of which so many compete.
TINY, SHORT, SHORT_RIVALS = 128, 8, 4
#: Bits of a filter, bits a feature sets, features a filter takes before the next is chained.
BITS, HASHES, FILL = 2048, 5, 160
#: Filters with fewer bits are compared without the dead zone of fuller ones.
SPARSE = 256
#: Entropies are told apart in this many steps.
STEPS = 1000


def entropies(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The entropy step (0..STEPS) of every window of ``width`` bytes.

    A window's sum of c * log2(c) follows from the one before: one byte leaves
    and one comes in, and how often each is among the ``width`` - 1 bytes between
    is counted by comparing the data with itself at each distance.
    """
    n = len(data)
    if n < width:
        return np.zeros(0, np.int64)
    # c * log2(c) for counts, as integers, so that running sums are exact
    c = np.arange(width + 1)
    clogc = np.round(c * np.log2(np.maximum(c, 1)) * (1 << 16)).astype(np.int64)
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, width):
        same = (data[k:] == data[:-k]).view(np.uint8)
        behind[k:] += same
        ahead[:-k] += same
    gain = np.diff(clogc)
    total = np.cumsum(gain[behind])
    # ``ahead`` of the byte that leaves is what it has left in the window without it
    total[width:] -= np.cumsum(gain[ahead[: n - width]])
    bits = np.log2(width) - total[width - 1 :] / (width << 16)
    return np.round(bits * (STEPS / 6)).astype(np.int64)


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy step: a row for windows of WIDTH bytes, one for those of SHORT."""
    out = np.zeros((2, STEPS + 1), np.int64)
    for data, starts in _chunks(texts):
        for k, width in enumerate((WIDTH, SHORT)):
            step = entropies(data, width)
            out[k] += np.bincount(step[_inside(starts, len(step), width)], minlength=STEPS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Precedence of each entropy step: 0 for the rarest in the corpus, ties to the higher entropy; row by row of ``counts``.

    Steps below a tenth of the range are runs of a few bytes, which say little; they come last."""
    if counts.ndim > 1:
        return np.stack([ranks(c) for c in counts])
    order = sorted(range(STEPS + 1), key=lambda e: (e < STEPS // 10, counts[e], -e))
    rank = np.empty(STEPS + 1, np.int64)
    rank[order] = np.arange(STEPS + 1)
    return rank


def _chunks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts joined up to ``most`` bytes (a longer one stands alone) and where each starts, and the end."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


def _inside(starts: np.ndarray, n: int, width: int = WIDTH) -> np.ndarray:
    """Which windows lie in one text."""
    ok = np.ones(n, bool)
    for s in starts[1:-1].tolist():
        ok[max(s - width + 1, 0) : s] = False
    return ok


def _select(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Window positions that are the rarest of enough neighbourhoods of windows.

    A neighbourhood has as many windows as RIVALS gives for the text's length,
    and a quarter of them is enough.  What is selected among more is nearly
    always selected among fewer too, so texts of unlike length can be compared."""
    step = entropies(data)
    if not len(step):
        return np.zeros(0, np.int64)
    inside = _inside(starts, len(step))
    owner = np.searchsorted(starts, np.arange(len(step)), "right") - 1
    # texts are set apart by windows that are worse than all, so no neighbourhood reaches another text's
    slot = np.arange(len(step)) + owner * RIVALS[0]
    padded = np.full(int(slot[-1]) + RIVALS[0], (STEPS + 1) * (len(step) + 1))
    padded[slot[inside]] = (rank[step] * (len(step) + 1) + np.arange(len(step)))[inside]
    windows = np.diff(starts) - WIDTH + 1
    size = np.full(len(windows), RIVALS[-1])
    for r in RIVALS[::-1]:
        size[windows >= SHARE * r] = r
    chosen = np.zeros(len(step), bool)
    span = 1
    while span < RIVALS[0]:
        padded = np.minimum(padded[:-span], padded[span:])
        span *= 2
        if not (size == span).any():
            continue
        some = np.flatnonzero(inside & (size[owner] == span))
        best = padded[slot[some]] % (len(step) + 1)
        chosen |= np.bincount(best, minlength=len(step)) >= span // 4
    return np.flatnonzero(chosen)


def _feature_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[at]
    words = np.ascontiguousarray(words).view("<u8")
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(WIDTH // 8):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xC4CEB9FE1A85EC53) ^ h >> np.uint64(29)


def _short_features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the windows of SHORT bytes that are the rarest of some SHORT_RIVALS in a row.

    A window goes up to each byte of a text, so that a text of any length has
    some; what it reaches back beyond the start is zero bytes."""
    data = np.frombuffer(b"".join(bytes(SHORT - 1) + t for t in texts) + bytes(SHORT_RIVALS), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), length)
    first = np.cumsum(length) - length
    at = np.arange(len(owner)) + (SHORT - 1) * owner
    order = np.full(len(data), (STEPS + 1) * (len(data) + 1))
    order[at] = rank[entropies(data, SHORT)[at]] * (len(data) + 1) + at
    best = np.lib.stride_tricks.sliding_window_view(order, SHORT_RIVALS)[at].copy()
    # a row of windows ends with its text
    beyond = np.arange(len(owner))[:, None] + np.arange(SHORT_RIVALS) >= (first + length)[owner][:, None]
    best[beyond] = (STEPS + 1) * (len(data) + 1)
    won = np.unique(best.min(1) % (len(data) + 1))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SHORT)[won]).view("<u8")[:, 0]
    h = (words ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
    return owner[np.searchsorted(at, won)], h ^ h >> np.uint64(29)


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chained filters, as an array of (filters, BITS / 8) bytes.

    Short texts have windows of SHORT bytes as features as well, ranked by their own rarity.
    A longer one without a rare window is one feature, the whole of it; an empty
    one has no filter."""
    out: list[np.ndarray] = []
    long_rank, short_rank = rank if rank.ndim > 1 else (rank, rank)
    for data, starts in _chunks(texts):
        at = _select(data, starts, long_rank)
        owner = np.searchsorted(starts, at, "right") - 1
        h = _feature_hashes(data, at) if len(at) else np.zeros(0, np.uint64)
        length = np.diff(starts)
        tiny = np.flatnonzero((length < TINY) & (length > 0))
        if len(tiny):
            whose, more = _short_features([data[starts[k] : starts[k + 1]].tobytes() for k in tiny.tolist()], short_rank)
            h, owner = np.append(h, more), np.append(owner, tiny[whose])
        found = np.bincount(owner, minlength=len(length))
        for k in np.flatnonzero((found == 0) & (length > 0)):  # every byte alike
            whole = hashlib.blake2b(data[starts[k] : starts[k + 1]].tobytes(), digest_size=8).digest()
            h, owner = np.append(h, np.frombuffer(whole, "<u8")), np.append(owner, k)
            found[k] = 1
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        filters = -(-found // FILL)
        base, first = np.cumsum(filters) - filters, np.cumsum(found) - found
        row = base[owner] + (np.arange(len(owner)) - first[owner]) // FILL
        bits = np.zeros((int(filters.sum()), BITS), bool)
        for k in range(HASHES):
            bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[b : b + f] for b, f in zip(base.tolist(), filters.tolist(), strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best match in the other, on average.

    Two filters' common bits count from what chance gives (and three tenths of
    the way beyond) up to all bits of the sparser one.  Where that one has few
    bits, they count from three standard deviations beyond chance, if that is less."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for f, n in zip(a, na.tolist(), strict=True):
        common = np.bitwise_count(f & b).sum(1, dtype=np.int64)
        most = np.minimum(n, nb)
        chance = n * nb / BITS
        zone = 0.3 * (most - chance)
        sparse = np.minimum(zone, 3 * np.sqrt(chance * (1 - n / BITS) * (1 - nb / BITS)))
        floor = chance + np.where(most < SPARSE, sparse, zone)
        total += max(0.0, float(((common - floor) / np.maximum(most - floor, 1e-9)).max()))
    return min(1.0, total / len(a))


def as_string(f: np.ndarray) -> str:
    return f"{len(f)}:{f.tobytes().hex()}"


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s.split(":")[1]), np.uint8).reshape(-1, BITS // 8)


def fit_ranks(docs: DataFrame) -> np.ndarray:
    """Precedence by rarity over all windows of all texts; what reaches the
    driver is one row of counts a partition, at most 2 * (STEPS + 1) of them in sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STEPS + 1), np.int64)
        for b in small_batches(batches, "text", 2 << 20):
            total += histogram([t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()])
        total = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["step", "n"])

    counts = np.zeros(2 * (STEPS + 1), np.int64)
    for r in docs.select(text_of().alias("text")).mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r.step] = r.n
    return ranks(counts.reshape(2, -1))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _pairs(rank: np.ndarray, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in small_batches(batches, "text", 1 << 20):
            yield from zip(*(b.column(c).to_pylist() for c in ("part", "halo", "doc_id", "text")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            """All but the last document of ``held``, each with the one after it."""
            raw = [t.encode("utf-8", "surrogatepass") for *_, t in held]
            own = fingerprints(raw, rank)
            pairs = [(i, i + 1) for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][1]]
            changed = [edited(held[i][3], held[j][3]).encode("utf-8", "surrogatepass") for i, j in pairs]
            out = []
            for (i, j), text, f in zip(pairs, changed, fingerprints(changed, rank), strict=True):
                out.append((held[i][2], len(held[i][3]), hashlib.sha256(text).hexdigest(), as_string(own[i]), as_string(f), likeness(own[i], f), likeness(own[i], own[j])))
            if out:
                yield as_batch(schema, zip(*out, strict=True))

        for r in rows(batches):
            held.append(r)
            size += len(r[3])
            if size > 1 << 20 and len(held) > 1:
                yield from done()
                held, size = held[-1:], 0
        if held:
            yield from done()

    return run


def fingerprint_documents(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited
    text, with their likeness, and the likeness to the next document.

    The next document is the one of the next lower doc_id (equal ids by text,
    null ids last); the last one's is the first.  Rows are range-partitioned by
    descending doc_id, by bounds from all ids, and each part also gets a copy of
    the row that follows it.  Texts thus move once, and no task looks beyond its
    part.  Equal texts have equal fingerprints.  A null text counts as empty; a
    single document is its own next one; no rows give none.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rank = fit_ranks(docs) if rank is None else rank
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), text_of().alias("text"))
    parts = parallelism(docs) * 2
    # a few bounds a partition: their number follows the cluster's settings, not the rows
    cut = rows.select("key").agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = np.unique(np.array(cut, np.int64))

    def number(key: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, key, "left")

    @pandas_udf("int")
    def part_of(key):
        import pandas as pd

        return pd.Series(number(key.to_numpy()).astype(np.int32))

    # a number for each part that has rows: the largest key of each
    heads = {r.part: r.key for r in rows.select("key").withColumn("part", part_of("key")).groupBy("part").agg(F.max("key").alias("key")).collect()}
    if not heads:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    order = sorted(heads)
    first = np.array([heads[p] for p in order], np.int64)
    before = np.array([order[-1], *order[:-1]], np.int32)

    @pandas_udf("int")
    def follows(key):
        """The part that a head row comes behind, -1 for other rows."""
        import pandas as pd

        k = key.to_numpy()
        at = np.minimum(np.searchsorted(order, number(k)), len(order) - 1)
        return pd.Series(np.where(first[at] == k, before[at], -1).astype(np.int32))

    # rows at the head of a part go to the part before it as well, behind its own rows
    own = rows.withColumns({"part": part_of("key"), "halo": F.lit(False)})
    halo = rows.withColumns({"part": follows("key"), "halo": F.lit(True)}).where("part >= 0")
    dealt = own.unionByName(halo).repartitionById(parts, "part").sortWithinPartitions("part", "halo", F.desc("key"), "text")
    return dealt.select("part", "halo", "doc_id", "text").mapInArrow(_pairs(rank, to_arrow_schema(StructType.fromDDL(SCHEMA))), SCHEMA)
