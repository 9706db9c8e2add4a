"""How filters act on each other: packed bitmaps of failures, labels and parts.

Each partition packs its rows' marks into bitsets.  What a set of filters
leaves is the AND-NOT of their bitsets, and its size a popcount; sizes add up
over partitions, and all orders of the filters follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, saved, small_batches, tidy

FILTERS = "ABCDE"
#: Fixed values of the filters: words, distinct words and capitals a hundred, and marks.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
MEASURED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("sha", pa.binary())])
COUNTED = pa.schema([("part", pa.string()), ("removed_by", pa.int32()), ("alive", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])
#: Rows of a bitset; a multiple of 8.
BLOCK = 1 << 16


def fails(text: bytes) -> int:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    words = text.split()
    n = len(words)
    # a code point is what is not an inner byte
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (n < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | any(c in text for c in MARKS) << 3


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, sha) of each row: filters A to D, and the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 4 << 20):
            yield as_batch(MEASURED, [b.column("doc_id"), b.column("part"), [fails(x.as_py()) for x in b.column("text")], b.column("sha")])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    return rows.mapInArrow(run, "doc_id long, part string, fails int, sha binary")


def popcount(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def prefix_counts(parts: list[str], failing: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[str, int, int, int, int]]:
    """(part, set of filters, rows that it leaves, good ones, toxic ones) of some
    rows, by their bitsets: part AND NOT each filter of the set."""
    pack = np.packbits
    not_failed = [~pack(failing >> i & 1) for i in range(len(FILTERS))]
    bits_good, bits_toxic = pack(good), pack(toxic)
    names, at = np.unique(np.asarray(parts, object), return_inverse=True)
    for k, part in enumerate(names):
        left = {0: pack(at == k)}
        for s in range(1 << len(FILTERS)):
            if s:
                last = s.bit_length() - 1
                left[s] = left[s & ~(1 << last)] & not_failed[last]
            b = left[s]
            yield part, s, popcount(b), popcount(b & bits_good), popcount(b & bits_toxic)


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                one = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                for part, s, *n in prefix_counts(b.column("part").to_pylist(), one("fails"), one("good").astype(bool), one("toxic").astype(bool)):
                    sums[part, s] = sums.get((part, s), 0) + np.array(n)
            if len(sums) > 1 << 16:
                yield _rows(sums)
                sums = {}
        if sums:
            yield _rows(sums)

    out = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, removed_by int, alive long, good long, toxic long")
    return out.groupBy("part", "removed_by").agg(*[F.sum(c).alias(c) for c in ("alive", "good", "toxic")])


def _rows(sums: dict) -> pa.RecordBatch:
    return as_batch(COUNTED, zip(*[(part, s, *n.tolist()) for (part, s), n in sums.items()], strict=True))


def orders(alive: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """All steps of all orders of the filters, from what each set of them leaves."""
    n, every = len(FILTERS), (1 << len(FILTERS)) - 1
    steps = []
    for order in permutations(range(n)):
        done = 0
        for step, f in enumerate(order, 1):
            after = done | 1 << f
            steps.append((order, step, f, done, after))
            done = after
    shapley = [0] * n
    for _, _, f, done, after in steps:
        shapley[f] += alive[done] - alive[after]
    for order, step, f, done, after in steps:
        removed = alive[done] - alive[after]
        yield (
            "".join(FILTERS[i] for i in order), step, alive[after], removed, alive[0] - alive[1 << f] - removed, alive[every & ~(1 << f)] - alive[every],
            good[done] - good[after], toxic[done] - toxic[after], shapley[f],
        )


AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


@tidy
def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley): for each part (lang) of ``docs`` and each
    order of the five filters, what each step does.

    Filters of a text: A few words, B few distinct ones, C many capitals, D a
    mark of ``MARKS``, E identical to a text of a smaller doc_id.  ``labels``
    (doc_id, quality, toxic) need not cover all documents; of several rows for
    one, any with quality or toxic 1 counts.

    Null texts are empty, a null lang is the part ''.  A row without a doc_id has
    no labels, is never a copy and makes no other row one; rows that repeat doc_id
    and text are no copies of each other.  An empty table gives no rows.  Texts
    are read whole; other columns do not matter.
    """
    rows = saved(_measured(docs))
    # a text's smallest doc_id, for texts that come more than once; copies are collapsed before they are shuffled
    first = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).where("first < _last").drop("_last")
    known = labels.groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    # written, so that a text with very many copies is a busy key of a plain join, which Spark splits
    copies = rows.where("doc_id is not null").join(saved(first), "sha", "left")
    marked = copies.select("doc_id", "part", F.col("fails").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("fails")).join(known, "doc_id", "left")
    nobody = rows.where("doc_id is null").select("doc_id", "part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    marked = marked.select("doc_id", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).unionByName(nobody)
    sets = _counts(marked)
    per_part = sets.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("removed_by", "alive", "good", "toxic"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, s in zip(b.column("part").to_pylist(), b.column("s").to_pylist(), strict=True):
                out = list(orders(*[[x[c] for x in s] for c in ("alive", "good", "toxic")]))
                yield as_batch(AUDIT, [[part] * len(out), *zip(*out, strict=True)])

    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return per_part.mapInArrow(run, kinds)
