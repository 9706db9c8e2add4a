"""Exact deduplication: owners found by Patricia tries over whole byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, parallelism, small_batches, text_of

PARTS = "n_bytes long, text_sha256 string, body binary, owner long, copies long"
OWNERS = "n_bytes long, text_sha256 string, keep_id long, group_size long"
#: A missing doc_id ranks after every other, so it is kept only among its like.
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Runs of white space as one blank; a run that is one blank already is left alone."""
    return F.regexp_replace(text, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


class Node:
    """``edge`` leads here; ``children`` by the first byte of their edge."""

    __slots__ = ("children", "copies", "edge", "key", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner, self.copies, self.key = edge, {}, None, 0, None


def _shared(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of ``b`` stand in ``a`` from ``at`` on; by halving, so that comparing is done in C."""
    if a.startswith(b, at):
        return len(b)
    lo, hi = 0, min(len(b), len(a) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.startswith(b[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed radix trie; its terminal nodes have the smallest identifier and a count."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def add(self, body: bytes, owner: int, copies: int, key: tuple) -> None:
        node, at = self.root, 0
        while at < len(body):
            child = node.children.get(body[at])
            if child is None:
                child = Node(body[at:])
                node.children[body[at]] = child
                self.held += len(child.edge) + 400
                node = child
                break
            n = _shared(body, at, child.edge)
            if n < len(child.edge):
                middle = Node(child.edge[:n])
                middle.children[child.edge[n]] = child
                child.edge = child.edge[n:]
                node.children[body[at]] = child = middle
                self.held += 400
            node, at = child, at + n
        node.owner = owner if node.copies == 0 else min(node.owner, owner)
        node.copies += copies
        node.key = key

    def drain(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple]:
        """(key, body, owner, copies) of all terminals at or below ``top``."""
        stack = [(top or self.root, before)]
        while stack:
            node, path = stack.pop()
            path += node.edge
            if node.copies:
                yield node.key, path, node.owner, node.copies
            stack += [(c, path) for c in node.children.values()]

    def spill(self) -> Iterator[tuple]:
        """Give up the heaviest subtree below the root."""
        if not self.root.children:
            return
        size = {b: sum(len(x[1]) for x in self.drain(c)) + 1 for b, c in self.root.children.items()}
        most = max(size, key=size.get)
        yield from self.drain(self.root.children.pop(most))
        self.held = sum(s + 400 for b, s in size.items() if b != most)


def _collapse(limit: int, schema: pa.Schema, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket, out, size = Trie(), None, [], 0

        def ready(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            if out and (everything or size > 4 << 20 or len(out) >= 10_000):
                cols = [[k[0] for k, *_ in out], [k[1] for k, *_ in out], *([] if final else [[x[1] for x in out]]), [None if x[2] == LAST else x[2] for x in out], [x[3] for x in out]]
                yield as_batch(schema, cols)
                out, size = [], 0

        def take(rows: Iterator[tuple]) -> None:
            nonlocal size
            for x in rows:
                out.append(x)
                size += len(x[1])

        for b in small_batches(batches, "body", 8 << 20):
            for n, sha, body, owner, copies in zip(*(b.column(c).to_pylist() for c in ("n_bytes", "text_sha256", "body", "owner", "copies")), strict=True):
                if final and bucket != (n, sha):
                    take(trie.drain())
                    trie, bucket = Trie(), (n, sha)
                trie.add(body, LAST if owner is None else owner, copies, (n, sha))
                while not final and trie.held > limit and trie.root.children:
                    take(trie.spill())
                    yield from ready(False)
            yield from ready(False)
        take(trie.drain())
        yield from ready(True)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    body = normalised(text_of())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).select("doc_id", "body", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))


def exact_owners(docs: DataFrame, trie_bytes: int = 48 << 20) -> DataFrame:
    """(n_bytes, text_sha256, keep_id, group_size) of each distinct normalised text.

    Each scanning task first inserts its texts into a trie and passes on one row
    for each distinct one, so that a text with millions of copies sends at most
    one row from each task.  A trie beyond ``trie_bytes`` gives up its heaviest
    subtree: those rows go to the shuffle as they are and meet again there.
    Then rows are partitioned by length and content hash, sorted by them, and
    each bucket's byte strings go through a trie of their own, which is dropped
    as soon as the bucket ends: equal means equal in every byte.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    of = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    rows = keyed(docs).select("n_bytes", "text_sha256", F.col("body").cast("binary").alias("body"), F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("copies"))
    parts = rows.mapInArrow(_collapse(trie_bytes, of(PARTS), False), PARTS)
    parts = parts.repartition(parallelism(docs), "n_bytes", "text_sha256").sortWithinPartitions("n_bytes", "text_sha256")
    return parts.mapInArrow(_collapse(trie_bytes, of(OWNERS), True), OWNERS)


def exact_groups(docs: DataFrame, trie_bytes: int = 48 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same bytes once runs of white space are one
    blank; a null text counts as empty.  The smallest doc_id of a group stays.
    A null doc_id ranks last: it stays only where no other id is in its group.
    Rows of a group that repeat its smallest id (or all lack one) are all marked
    kept.  The tries compare whole byte strings; a row then finds its group by
    length and SHA-256, so two texts of one length whose hashes agree would be
    two groups of which a row may find either.  An empty table gives no rows,
    and other columns of ``docs`` play no part, whatever their names.
    """
    ids = keyed(docs).select("doc_id", "n_bytes", "text_sha256")
    owners = exact_owners(docs, trie_bytes)
    return ids.join(owners, ["n_bytes", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
