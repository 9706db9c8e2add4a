"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, parallelism, saved, shared_dir, small_batches, text_of
from ferrule.llm.tokens import END_ID, default_path, encoder

MANIFEST = "shard long, file string, dtype string, docs long, tokens long, first_id long, first_null boolean"
READ = "doc_id long, start long, n_tokens long, ids binary"
#: A document's identifier, which may be null.
ID = np.dtype([("id", "<i8"), ("null", "u1")])


def _open(path: str):
    """(file system, path there) of a folder in any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _writer(folder: str, path: str, dtype: str, end_id: int | None, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, files, sink = encoder(path), None, None
        offsets, ids = [np.zeros(1, "<u8")], []
        total = 0
        for b in small_batches(batches, "text", 8 << 20, keep=one):
            if sink is None:
                # a name of its own for each attempt: a task that is run twice never writes into the other's file
                files, where = _open(folder)
                name = f"{where}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                files.create_dir(where, recursive=True)
                sink = files.open_output_stream(f"{name}.bin")
            got = one.encode(b.column("text").to_pylist(), end_id)
            flat = np.frombuffer(b"".join(got), "<u4")
            if len(flat) and flat.max() > np.iinfo(dtype).max:
                raise ValueError(f"a token id exceeds {dtype}")
            sink.write(flat.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
            ends = total + np.cumsum([len(x) // 4 for x in got]).astype("<u8")
            total = int(ends[-1])
            offsets.append(ends)
            own = np.zeros(b.num_rows, ID)
            own["null"] = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            own["id"] = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            ids.append(own)
        if sink is None:
            return
        sink.close()
        all_ids = np.concatenate(ids)
        for end, data in (("off", np.concatenate(offsets)), ("ids", all_ids)):
            with files.open_output_stream(f"{name}.{end}") as f:
                f.write(data.tobytes())
        shard = TaskContext.get().partitionId()
        yield as_batch(schema, [[shard], [name.rsplit("/", 1)[1]], [dtype], [len(all_ids)], [total], [int(all_ids[0]["id"])], [bool(all_ids[0]["null"])]])

    return write


def write_token_files(docs: DataFrame, folder: str, dtype: str = "uint16", end_id: int | None = END_ID, tokenizer: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``folder``; returns the manifest.

    The rows are range-partitioned by doc_id and sorted, so that shard after
    shard is in ascending order (nulls first, rows of equal id by text).  A
    shard is three files: ``.bin`` has ids of the fixed unsigned ``dtype``,
    ``.off`` n + 1 unsigned 64-bit offsets into it, ``.ids`` the identifiers.
    The manifest names the files of the attempts that Spark committed, with
    ``base_tokens`` and ``base_docs``: prefix sums over the shards, which turn a
    shard's offsets into those of the whole corpus.  It has one row a shard.

    A null or empty text is the end id alone; no rows give an empty manifest.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(MANIFEST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(partitions or parallelism(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = saved(rows.mapInArrow(_writer(folder, tokenizer or default_path(), dtype, end_id, schema), MANIFEST))
    # one row a shard, so a window without a key is small; range partitions are numbered in order
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumns({"base_tokens": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "base_docs": F.coalesce(F.sum("docs").over(before), F.lit(0))})


def _reader(folder: str, most: int, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                files, where = _open(folder)
                whole = lambda end: files.open_input_stream(f"{where}/{row['file']}.{end}").read()  # noqa: B023, E731
                offsets, ids = np.frombuffer(whole("off"), "<u8").astype(np.int64), np.frombuffer(whole("ids"), ID)
                kind = np.dtype(row["dtype"]).newbyteorder("<")
                local = files.type_name == "local"
                tokens = np.memmap(f"{where}/{row['file']}.bin", kind, "r") if local else None
                stream = None if local else files.open_input_file(f"{where}/{row['file']}.bin")
                cut = 0
                while cut < len(ids):
                    end = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + most, "right")) - 1)
                    lo, hi = int(offsets[cut]), int(offsets[end])
                    part = tokens[lo:hi] if local else np.frombuffer(stream.read_at((hi - lo) * kind.itemsize, lo * kind.itemsize), kind)
                    part = part.astype("<u4").tobytes()
                    rel = (offsets[cut : end + 1] - lo) * 4
                    yield as_batch(schema, [
                        pa.array(ids["id"][cut:end], pa.int64(), mask=ids["null"][cut:end].astype(bool)),
                        offsets[cut:end] + row["base_tokens"], np.diff(offsets[cut : end + 1]), [part[x:y] for x, y in zip(rel[:-1], rel[1:], strict=True)],
                    ])
                    cut = end

    return read


def read_token_files(manifest: DataFrame, folder: str, batch_tokens: int = 1_000_000) -> DataFrame:
    """The documents of a manifest, read from the memory-mapped files: doc_id,
    start (tokens of all documents before it), n_tokens, ids (unsigned 32 bit)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(READ))
    return manifest.repartition(parallelism(manifest)).mapInArrow(_reader(folder, batch_tokens, schema), READ)


def token_folder(spark: SparkSession) -> str:
    return shared_dir(spark)

