"""Exact near-duplicate groups: a T-occurrence search over word shingles."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, parallelism, saved, text_of, tidy
from ferrule.llm.components import connected_components
from ferrule.llm.routing import SPREAD, deal, exchange, from_docs, groups, pack
from ferrule.llm.words import shingles, word_hashes

SETS = "doc_id long, n long, sig string, shared array<long>"
LINKS = "a long, b long"
#: Bytes of text in a batch.
BATCH = 6 << 20


def _need(n: int, percent: int) -> int:
    """The least overlap that a set of ``n`` has with any set that it links with."""
    return -(-percent * n // 100)


def _slots(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _named(low: np.ndarray, slot: np.ndarray | int) -> np.ndarray:
    """48 bits of a shingle's hash and up to 15 of its slot."""
    return (low & np.uint64((1 << 48) - 1) | (np.asarray(slot).astype(np.uint64) & np.uint64(0x7FFF)) << np.uint64(48)).astype(np.int64)


def _common(width: int, least: int):
    def run(batch: int, ids: list, texts: list) -> Iterable[tuple[int, int, bytes]]:
        h, n = np.unique(np.concatenate(list(shingles(*word_hashes(texts), width))), return_counts=True)
        often = n >= least
        for x, c in zip(h[often].astype(np.int64).tolist(), n[often].tolist(), strict=True):
            yield x, c, b""

    return run


def common_shingles(rows: DataFrame, width: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that ``least`` documents of one batch have, sorted, with how
    often those batches have them: at most ``most``, the most frequent first."""
    # rows of a shingle and a count; a second Python step here would keep a second worker for each task
    counts = from_docs(rows, _common(width, least), BATCH).select(F.col("slot").alias("h"), F.col("batch").alias("n"))
    top = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r.h for r in top], np.int64).astype(np.uint64), np.array([r.n for r in top], np.uint32)
    order = np.argsort(h)
    return h[order], n[order]


def _requests(width: int, slots: int, common: np.ndarray, often: np.ndarray):
    """A batch's shingle hashes, dealt by their leading bits; one row of facts about its documents.

    Common shingles are known to be shared, so they stay with the facts."""

    def run(batch: int, ids: list, texts: list) -> Iterable[tuple[int, int, bytes]]:
        sets = list(shingles(*word_hashes(texts), width))
        sizes = np.array([len(s) for s in sets], np.int64)
        sig = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
        h, d = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        slot = _slots(h, slots)
        known = {"h": np.zeros(0, np.int64), "d": np.zeros(0, np.uint16), "df": np.zeros(0, np.uint32)}
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            is_common = common[at] == h
            known = {"h": _named(h[is_common], slot[is_common]), "d": d[is_common], "df": often[at[is_common]]}
            h, d, slot = h[~is_common], d[~is_common], slot[~is_common]
        yield -1 - batch % slots, batch, pack(ids=ids, sizes=sizes, sig=sig, **known)
        order = np.argsort(slot, kind="stable")
        cut = np.searchsorted(slot[order], np.arange(slots + 1))
        low = np.ascontiguousarray(h[order]).view(np.uint8).reshape(-1, 8)[:, :6]
        d = d[order]
        for s in range(slots):
            if cut[s] < cut[s + 1]:
                yield s, batch, pack(h=low[cut[s] : cut[s + 1]].copy(), d=d[cut[s] : cut[s + 1]])

    return run


def _frequencies(slot: int, rows: list[tuple[int, dict]]) -> Iterable[tuple[int, int, bytes]]:
    """Count, for each shingle of a slot, the documents that have it; send back those that two or more have."""
    if slot < 0:
        for batch, x in rows:
            yield batch, -1, pack(**x)
        return
    all_h = np.zeros((sum(len(x["h"]) for _, x in rows), 8), np.uint8)
    all_h[:, :6] = np.concatenate([x["h"] for _, x in rows])
    h = all_h.view(np.uint64).ravel()
    order = np.argsort(h)
    s = h[order]
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    n = np.diff(edge)
    df = np.empty(len(h), np.uint32)
    df[order] = np.repeat(n, n).astype(np.uint32)
    h = _named(h, slot)
    at = 0
    for batch, x in rows:
        part = slice(at, at + len(x["d"]))
        at = part.stop
        keep = df[part] > 1
        if keep.any():
            yield batch, slot, pack(h=h[part][keep], d=x["d"][keep], df=df[part][keep])


def _sets(percent: int, schema: pa.Schema):
    """Documents of a batch, each with its shared shingles, rarest first, if it has enough of them to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            facts = next(x for n, x in rows if n == -1)
            h, d, df = (np.concatenate([x[k] for _, x in rows]) for k in ("h", "d", "df"))
            order = np.lexsort((h, df, d))
            h, counts = h[order], np.bincount(d, minlength=len(facts["ids"]))
            ends = np.cumsum(counts)
            out = []
            for doc, n, sig, end, c in zip(facts["ids"], facts["sizes"].tolist(), facts["sig"], ends.tolist(), counts.tolist(), strict=True):
                on = n and c >= _need(n, percent)
                out.append((doc, n, sig if on else None, h[end - c : end] if on else None))
                if len(out) >= 2000:
                    yield as_batch(schema, zip(*out, strict=True))
                    out = []
            if out:
                yield as_batch(schema, zip(*out, strict=True))

    return run


def shingle_sets(docs: DataFrame, width: int = 5, percent: int = 80, least: int = 64, most: int = 100_000) -> DataFrame:
    """doc_id, n (size of the shingle set) and, for documents that can have a
    partner at all, sig (a digest of the set) and the shingles that some other
    document has too, rarest first.

    A shingle in one document alone is in no intersection.  A document whose
    other shingles are fewer than ``percent`` of its set has no partner, which
    leaves out, exactly, whatever only shares passages with others.

    How often a shingle occurs is counted by slots of a hash.  Those that
    ``least`` documents of one batch share are counted beforehand, the ``most``
    frequent of them, and are not sent to a slot: a line that a tenth of all
    documents have would be one task's memory.  Any order of the shingles that
    is the same everywhere gives the same links.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    slots = parallelism(docs) * SPREAD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    asked = from_docs(rows, _requests(width, slots, *common_shingles(rows, width, least, most)), BATCH)
    answered = exchange(asked, _frequencies)
    return deal(answered).mapInArrow(_sets(percent, to_arrow_schema(StructType.fromDDL(SETS))), SETS)


def divide_skip(ids: list[int], sizes: list[int], sets: list[np.ndarray], percent: int = 80, mu: float = 0.05, apart: np.ndarray | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among a group of documents, as (document, root) pairs of a spanning forest.

    For each document the inverted lists of its shingles hold the earlier ones
    (in order of size).  T is the least overlap it needs.  The longest lists are
    set aside; the rest are heap-merged, and whoever is there often enough is
    looked up in the long lists by binary search.  Documents that are connected
    already are left out of the lists: their link would add nothing; ``known``
    names the component that each is in from the start.  ``apart`` marks two
    sides, of which only links across are wanted.
    """
    rank = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    ids, sizes, sets = [ids[i] for i in rank], np.array([sizes[i] for i in rank], np.int64), [np.sort(sets[i]) for i in rank]
    side = None if apart is None else apart[rank]
    flat = np.concatenate(sets)
    _, inv = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(inv, kind="stable")
    lists, first = owner[order], np.zeros(inv.max() + 2, np.int64)
    np.cumsum(np.bincount(inv), out=first[1:])
    place = np.empty(len(flat), np.int64)
    place[order] = np.arange(len(flat))
    comp = np.arange(len(ids)) if known is None else np.unique(np.array(known)[rank], return_inverse=True)[1]
    by_comp = np.argsort(comp, kind="stable")
    members = {int(comp[p[0]]): p.tolist() for p in np.split(by_comp, np.flatnonzero(np.diff(comp[by_comp])) + 1)}
    links: list[tuple[int, int]] = []

    def join(x: int, y: int) -> None:
        a, b = int(comp[x]), int(comp[y])
        if a != b:
            if len(members[a]) < len(members[b]):
                a, b = b, a
            comp[members[b]] = a
            members[a] += members.pop(b)
            links.append((ids[x], ids[y]))

    ends = np.cumsum([len(s) for s in sets])
    for x in range(1, len(ids)):
        mine = slice(ends[x] - len(sets[x]), ends[x])
        lo, hi = first[inv[mine]], place[mine]
        fits = int(np.searchsorted(sizes, _need(int(sizes[x]), percent)))
        t = _need(int(sizes[x]), percent)
        near = [lists[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
        if len(near) < t:
            continue
        near.sort(key=len)
        enough = lambda got, y: (100 + percent) * got >= percent * (sizes[x] + sizes[y])  # noqa: B023, E731
        # the latest partner in a few rare lists is often a copy: joining it first empties the lists
        for y in {int(n[-1]) for n in near[: len(near) - t + 1][:8]}:
            if y >= fits and comp[y] != comp[x] and (side is None or side[y] != side[x]) and enough(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), y):
                join(x, y)
        n_long = min(t - 1, int(t / (mu * log2(max(len(near[-1]), 2)) + 1)))
        cut = len(near) - n_long
        open_ = lambda n: n[(comp[n] != comp[x]) & (n >= fits) if side is None else (comp[n] != comp[x]) & (n >= fits) & (side[n] != side[x])]  # noqa: B023, E731
        short = [m.tolist() for m in map(open_, near[:cut]) if len(m)]
        if not short:
            continue
        found, seen, last = [], 0, -1
        for y in heapq.merge(*short):
            if y != last:
                if seen >= t - n_long and last >= 0:
                    found.append((last, seen))
                last, seen = y, 0
            seen += 1
        if seen >= t - n_long:
            found.append((last, seen))
        if not found:
            continue
        who, got = np.array([y for y, _ in found]), np.array([c for _, c in found])
        for far in near[cut:]:
            at = np.minimum(np.searchsorted(far, who), len(far) - 1)
            got += far[at] == who
        for y in who[(100 + percent) * got >= percent * (sizes[x] + sizes[who])].tolist():
            join(x, y)
    return links


def _search(percent: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, sizes, sets, comps, sides = zip(*held, strict=True)
                links = divide_skip(ids, sizes, sets, percent, apart=np.array(sides) if len(set(sides)) > 1 else None, known=comps)
                if links:
                    yield as_batch(schema, zip(*links, strict=True))

        for b in batches:
            shared = b.column("shared")
            cols = [b.column(c).to_pylist() for c in ("family", "i", "j", "doc_id", "n", "comp", "side")]
            for k, (family, i, j, doc, n, comp, side) in enumerate(zip(*cols, strict=True)):
                if (family, i, j) != key:
                    yield from done()
                    key, held = (family, i, j), []
                held.append((doc, n, shared[k].values.to_numpy(), comp, side))
        yield from done()

    return run


def _searched(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within each (family, i, j) of ``rows``, which get their sets only here."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    key = ["family", "i", "j"]
    dealt = rows.select(*key, "doc_id", "comp", "side").join(sets, "doc_id").repartition(parallelism(rows), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_search(percent, to_arrow_schema(StructType.fromDDL(LINKS))), LINKS)


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _part(seed: int, n: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")


def _components(members: DataFrame, sets: DataFrame, percent: int, block_shingles: int, pilots: int) -> DataFrame:
    """(node, component) of linked documents, from members (family, doc_id, w) and
    their ``sets`` (doc_id, n, shared); w is the number of shared shingles.

    A family is cut into blocks of ``block_shingles``, and each is searched by
    itself together with the family's pilots, a few of its documents.  So the
    copies of one text come into one component, in work that grows with the
    family.  Then whoever is not in the family's largest component is searched
    for in every block: links within that component would add nothing.
    """
    blocks = members.groupBy("family").agg(F.ceil(F.sum("w") / block_shingles).cast("int").alias("m"))
    placed = members.join(blocks, "family").withColumns({"j": _part(0, "m"), "comp": F.col("doc_id"), "side": F.lit(0)})
    large = placed.where("m > 1")
    chosen = large.groupBy("family", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(pilots)).alias("_p")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    everywhere = large.join(chosen, "doc_id", "left_semi").withColumn("to", _upto("m")).where("to <> j").withColumn("j", F.col("to")).drop("to")
    own = placed.unionByName(everywhere).withColumn("i", F.lit(0))
    links = saved(_searched(own, sets, percent))
    first = connected_components(links)
    if large.isEmpty():
        return first
    named = large.drop("comp").join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    named = saved(named)
    largest = named.groupBy("family", "comp").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"))
    others = named.join(largest, "family").where("comp <> largest").drop("largest")
    chunks = others.groupBy("family").agg(F.ceil(F.sum("w") / block_shingles).cast("int").alias("q"))
    asking = others.join(chunks, "family").withColumns({"i": _part(2, "q"), "side": F.lit(1)}).withColumn("j", _upto("m")).drop("q")
    asked = named.join(chunks, "family").withColumn("i", _upto("q")).drop("q")
    across = saved(_searched(asking.unionByName(asked), sets, percent))
    if across.isEmpty():
        return first
    return connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across))


@tidy
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block_shingles: int = 250_000, pilots: int = 8, least: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links).

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``width``-word shingles (hashes of 48 bits and up to 15 of a slot).
    Equal sets are one class, and only one member of a class is searched with.
    Classes that share a rare shingle, of those that any partner must share one
    of, form a family; a family is searched in blocks (``_components``), so no
    task holds more than two of them.  Every link between different sets is
    found; ones that join what is joined already are not looked up.

    A text without words (null or empty too) links with nothing.  Repeated
    doc_ids share a component; a row with a null doc_id gets a null component.
    A very long text is one set, whatever its length.
    """
    sets = saved(shingle_sets(docs, width, percent, least))
    able = sets.where("sig is not null and doc_id is not null")
    classes = saved(able.groupBy("n", "sig").agg(F.min("doc_id").alias("rep"), F.min_by("shared", "doc_id").alias("shared")))
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "shared")
    needed = F.ceil(F.col("n") * percent / 100).cast("int")
    words = reps.select("doc_id", F.explode(F.slice("shared", F.lit(1), F.size("shared") - needed + 1)).alias("h"))
    hubs = words.groupBy("h").agg(F.min("doc_id").alias("hub"), F.count("*").alias("k")).where("k > 1")
    family = connected_components(words.join(hubs, "h").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
    members = reps.select("doc_id", F.size("shared").alias("w")).join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    joined = _components(saved(members), reps, percent, block_shingles, pilots).select(F.col("node").alias("rep"), F.col("component"))
    named = able.select("doc_id", "n", "sig").join(classes.select("n", "sig", "rep"), ["n", "sig"]).join(joined, "rep", "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return named.unionByName(sets.where("sig is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
