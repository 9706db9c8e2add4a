"""Rows of packed arrays that Spark deals out by a key.

Some operators move one small number for each word of a corpus.  A row of its
own for each would be several times larger than the number, so a task gathers
what it has for one key range (a slot) into arrays, and Spark shuffles those.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, parallelism, release_memory, small_batches

PACKED = "slot long, batch long, body binary"
ARROW = pa.schema([("slot", pa.int64()), ("batch", pa.int64()), ("body", pa.binary())])
#: Slots for each shuffle partition, so that the hash of the slot spreads them.
SPREAD = 4
#: Documents of a batch, which are numbered by 16 bits.
MOST_DOCS = 1 << 16


def _split(a):
    """A short-integer array as its bytes by significance, which compress better apart."""
    if isinstance(a, np.ndarray) and a.ndim == 1 and a.dtype.kind in "iu" and a.dtype.itemsize in (2, 4) and len(a) > 64:
        return ("planes", a.dtype.str, b"".join((a >> (8 * i)).astype(np.uint8).tobytes() for i in range(a.dtype.itemsize)))
    return a


def _whole(a):
    if isinstance(a, tuple) and len(a) == 3 and a[0] == "planes":
        kind = np.dtype(a[1])
        planes = np.frombuffer(a[2], np.uint8).reshape(kind.itemsize, -1)
        out = np.empty((planes.shape[1], kind.itemsize), np.uint8)
        for i, plane in enumerate(planes):
            out[:, i] = plane
        return out.view(kind).ravel()
    return a


def pack(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps({k: _split(a) for k, a in arrays.items()}, protocol=5))


def unpack(body: bytes) -> dict:
    return {k: _whole(a) for k, a in pickle.loads(zstandard.ZstdDecompressor().decompress(body)).items()}


def emit(rows: Iterable[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > most or len(held) >= 5000:
            yield as_batch(ARROW, zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield as_batch(ARROW, zip(*held, strict=True))


def from_docs(docs: DataFrame, f: Callable[..., Iterable[tuple[int, int, bytes]]], text_bytes: int = 10 << 20, more: Sequence[str] = ()) -> DataFrame:
    """Packed rows from ``f(batch number, ids, texts)`` over batches of ``docs``
    (doc_id, text); values of the columns ``more`` follow the texts.  The number is made of the partition's and a count, so the
    same scan gives the same numbers again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ids, texts, size, others = None, [], [], 0, [[] for _ in more]
        # slices of few rows, so that a batch stays below MOST_DOCS however many rows Arrow hands over
        for whole in small_batches(batches, "text", 2 << 20):
            for b in (whole.slice(at, 8192) for at in range(0, whole.num_rows, 8192)):
                n = (b.column("scan")[0].as_py() << 24) if n is None else n
                ids += b.column("doc_id").to_pylist()
                texts += b.column("text").to_pylist()
                size += b.column("text").nbytes
                for held, c in zip(others, more, strict=True):
                    held += b.column(c).to_pylist()
                if size > text_bytes or len(ids) > MOST_DOCS - 8192:
                    yield from emit(f(n, ids, texts, *others))
                    n, ids, texts, size, others = n + 1, [], [], 0, [[] for _ in more]
        if ids:
            yield from emit(f(n, ids, texts, *others))

    # the number of the scan's own partition, which stays the same below a union
    return docs.select("doc_id", "text", *more, F.spark_partition_id().cast("long").alias("scan")).mapInArrow(run, PACKED)


def deal(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    return rows.repartition(partitions or parallelism(rows), "slot").sortWithinPartitions("slot", "batch")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, dict]]]]:
    """(slot, its rows unpacked) of dealt rows, one slot at a time in memory."""
    release_memory()
    slot, held = None, []
    for b in batches:
        for s, n, body in zip(b.column("slot").to_pylist(), b.column("batch").to_pylist(), b.column("body").to_pylist(), strict=True):
            if s != slot:
                if held:
                    yield slot, held
                slot, held = s, []
            held.append((n, unpack(body)))
    if held:
        yield slot, held


def exchange(rows: DataFrame, f: Callable[[int, list[tuple[int, dict]]], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """Deal packed rows by slot and apply ``f(slot, rows)``, which gives packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(r for slot, held in groups(batches) for r in f(slot, held))

    return deal(rows).mapInArrow(run, PACKED)
