"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, small_batches, text_of
from ferrule.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


def capacities(total: int, most: int) -> np.ndarray:
    """Sequence sizes that hold ``total`` tokens exactly: full ones, then powers of two."""
    rest = total % most
    return np.array([most] * (total // most) + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1], np.int64)


def assign(lengths: np.ndarray, most: int, linear: float, quadratic: float) -> tuple[np.ndarray, ...]:
    """Pieces as arrays (document, start, length, sequence, offset, cost).

    Documents come in descending estimated cost (linear * n + quadratic * n^2).
    Each goes to the cheapest sequence that still has room for all of it; where
    none has, it is cut to fill the roomiest one and the rest is placed anew.
    """
    caps = capacities(int(lengths.sum()), most)
    room, cost = caps.copy(), np.zeros(len(caps))
    out: list[tuple] = []
    for d in np.argsort(-(linear * lengths + quadratic * lengths.astype(float) ** 2), kind="stable"):
        start, left = 0, int(lengths[d])
        while left:
            s = int(np.argmin(np.where(room >= left, cost, np.inf)))
            if room[s] < left:
                widest = room == room.max()
                s = int(np.argmin(np.where(widest, cost, np.inf)))
            n = min(left, int(room[s]))
            price = linear * n + quadratic * float(n) * n
            out.append((d, start, n, s, caps[s] - room[s], price))
            room[s] -= n
            cost[s] += price
            start, left = start + n, left - n
    return tuple(np.array(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def packer(path: str, most: int, window: int, linear: float, quadratic: float, schema: pa.Schema):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        base = None
        ids: list[bytes] = []
        docs: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, held, base
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            doc, start, n, seq, offset, cost = assign(lengths, most, linear, quadratic)
            caps = capacities(held, most)
            out = as_batch(schema, [
                [docs[d] for d in doc], start, n, [ids[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc, start, n, strict=True)],
                lengths[doc], seq + base, offset, caps[seq], cost,
            ])
            ids, docs, held, base = [], [], 0, base + len(caps)
            return out

        for b in small_batches(batches, "text", 8 << 20, keep=one):
            if not b.num_rows:
                continue
            base = (b.column("scan")[0].as_py() << 32) if base is None else base
            got = one.encode(b.column("text").to_pylist())
            ids += got
            docs += b.column("doc_id").to_pylist()
            held += sum(map(len, got)) // 4
            if held >= window:
                yield flush()
        if held:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame, max_tokens: int = 4096, window_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1 / 2048, tokenizer: str | None = None
) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack them into sequences of ``max_tokens``.

    One row per piece with its ids (little-endian unsigned 32 bit), the sequence
    and the offset there.  Every sequence comes out exactly full: those of a
    window hold ``max_tokens`` each, and what is left over goes to sequences
    whose sizes are powers of two, so nothing is padded.  ``quadratic`` is the
    attention term of the cost, in units of the linear one per token.

    Packing needs no key, so there is no shuffle: each task packs the rows it
    scans, ``window_tokens`` at a time, which bounds its memory.  Ids and
    numbers come from the partition's number and order alone, so a task that is
    run again gives the same pieces.

    A null or empty text is a document of the end id alone.  Null ids are kept
    as they are; repeated rows are packed once each; no rows, no pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    if max_tokens < 1 or window_tokens < 1:
        raise ValueError("max_tokens and window_tokens must be positive")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.spark_partition_id().cast("long").alias("scan"))
    return rows.mapInArrow(packer(tokenizer or default_path(), max_tokens, window_tokens, linear, quadratic, schema), SCHEMA)
