"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, discard, learns, release_memory, saved_at, small_batches, text_of

SCHEMA = "doc_id long, score double"
WORD = re.compile(r"[^\W\d_]+")
#: Gains are counted up to this many bytes.
MOST = 8


def windows(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _bytes(word: str) -> bytes:
    """A word between blanks; repeated to 32 bytes, as the compressor stores very short inputs as they are."""
    b = f" {word} ".encode()
    return b * (32 // len(b) + 1)


class Model:
    """Two dictionaries and the calibration of what windows gain from them."""

    def __init__(self, toxic: bytes, ordinary: bytes, full: int, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, level: int):
        self.parts = (toxic, ordinary, full, mean, spread, weights, level)

    def __reduce__(self):
        return Model, self.parts

    @property
    def compressors(self):
        toxic, ordinary, *_, level = self.parts
        form = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        load = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=form)
        return load(toxic), load(ordinary)

    def features(self, texts: list[str], cache: dict[str, int], most: int = 150_000) -> np.ndarray:
        """Per text, how many windows gain at least 1..MOST bytes from the toxic
        dictionary over the other, apart by whether it covers them wholly."""
        toxic, ordinary = self.compressors
        full = self.parts[2]
        if len(cache) > most:
            cache.clear()
        out = np.zeros((len(texts), 4 * MOST - 2))
        for k, t in enumerate(texts):
            ws = windows(t)
            for w in set(ws):
                if w not in cache:
                    b = _bytes(w)
                    n = len(toxic.compress(b))
                    cache[w] = 2 * max(0, min(MOST, len(ordinary.compress(b)) - n)) + (n <= full)
            h = np.bincount(np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws)), minlength=2 * MOST + 2).reshape(-1, 2)
            least = h[::-1].cumsum(0)[::-1][1:]
            out[k] = np.concatenate((np.log1p(least.ravel()), least[1:].ravel() * 50 / max(20, len(ws))))
        return out

    def score(self, texts: list[str], cache: dict[str, int]) -> np.ndarray:
        *_, mean, spread, weights, _ = self.parts
        x = (self.features(texts, cache) - mean) / spread
        return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def dictionary(samples: Iterable[str], size: int, k: int, d: int) -> bytes:
    """What zstandard's trainer makes of ``samples``; too few for it are a dictionary as they are."""
    body = [f" {x} ".encode() for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, body, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        # the last bytes of such a dictionary are not searched, hence the padding
        return b"".join(dict.fromkeys(body))[-size:] + bytes(32)


def fit(texts: list[str], toxic: list[int], share: float, ordinary_bytes: int = 16384, level: int = 9, least_g2: float = 12.0, penalty: float = 1.0) -> Model | None:
    """Fit on labelled texts; ``share`` is the share of toxic rows among all labels.

    Both dictionaries come from zstandard's trainer.  The ordinary one is trained
    on the windows of ordinary texts, ``ordinary_bytes`` large.  Toxic texts are
    ordinary but for a few windows, and a dictionary trained on all of theirs is
    one of common words; so it is trained on those that toxic texts have
    significantly more often (log-likelihood ratio of ``least_g2``), each text
    once, is as large as these need, and gets those that the trainer left out.  What windows gain is calibrated by a
    penalised logistic fit over thresholds of 1 to MOST bytes.
    """
    seen = (Counter(), Counter())
    for t, y in zip(texts, toxic, strict=True):
        seen[y].update(set(windows(t)))
    n = (len(toxic) - sum(toxic), sum(toxic))
    if not all(n):
        return None
    part = lambda o, e: o * log(o / e) if o else 0.0

    def g2(w: str) -> float:
        a, b = seen[1][w], seen[0][w]
        q = (a + b) / sum(n)
        return 2 * (part(a, n[1] * q) + part(b, n[0] * q))

    ratio = lambda w: ((seen[1][w] + 0.5) / (n[1] + 1)) / ((seen[0][w] + 0.5) / (n[0] + 1))
    telling = {w for w in seen[1] if ratio(w) >= 4 and g2(w) >= least_g2}
    if not telling:
        return None
    del seen
    plain = (" ".join(windows(t)) for t, y in zip(texts, toxic, strict=True) if not y)
    marked = (" ".join(sorted(telling.intersection(windows(t)))) for t, y in zip(texts, toxic, strict=True) if y)
    room = 4096 + 4 * sum(len(w.encode()) + 1 for w in telling)
    bare = lambda *d: Model(*d, 0, np.zeros(1), np.ones(1), np.zeros(1), level)
    dicts = dictionary(marked, room, 32, 6), dictionary(plain, ordinary_bytes, 16, 8)
    # the trainer may leave some out; a dictionary ends with its content, and its last bytes are not searched
    small, other = bare(*dicts).compressors
    missed = [w for w in sorted(telling) if len(small.compress(_bytes(w))) >= len(other.compress(_bytes(w)))]
    dicts = dicts[0] + b"".join(f" {w} ".encode() for w in missed) + bytes(32), dicts[1]
    compressor = bare(*dicts).compressors[0]
    lengths = sorted(len(compressor.compress(_bytes(w))) for w in telling)
    full = lengths[len(lengths) * 3 // 4]
    x = Model(*dicts, full, *[np.zeros(1)] * 3, level).features(texts, {}, 1 << 60)
    y, mean, spread = np.array(toxic, float), x.mean(0), x.std(0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / spread))
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty * np.eye(len(w)), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    share = min(max(share, 1e-6), 1 - 1e-6)
    w[0] += log(share / (1 - share)) - log(n[1] / n[0])
    return Model(*dicts, full, mean, spread, w, level)


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, rows: int = 3000, label: str = "toxic", most_bytes: int = 64 << 20) -> Model | None:
    """Fit on a bounded sample of the labelled documents whose crc32(doc_id as
    text) mod ``mod`` is not ``held``: of each class at most ``rows``, those
    first by a hash of doc_id, and of these as many as have ``most_bytes`` of
    text together (a text that alone has more is passed over).  The two bounds
    keep what the driver holds independent of the corpus.

    Of an id labelled twice the larger label counts, of one with several rows
    the smallest text; null labels or ids do not count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learns("doc_id", mod, held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = first(0).unionByName(first(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where(F.octet_length("text") <= most_bytes)
    # at most 2 * rows identifiers are broadcast
    one, path = saved_at(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    room, ids = most_bytes, []
    for r in one.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        if r.n <= room:
            room -= r.n
            ids.append(r.doc_id)
    got = one.where(F.col("doc_id").isin(ids)).orderBy("doc_id").collect() if ids else []
    discard(docs.sparkSession, path)
    return fit([r.text for r in got], [r.y for r in got], sizes[1] / sum(sizes.values())) if got else None


def _scorer(model: Model | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in small_batches(batches, "text", 4 << 20):
            texts = b.column("text").to_pylist()
            yield as_batch(schema, [b.column("doc_id"), model.score(texts, cache) if model else np.zeros(len(texts))])

    return run


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Every row of ``docs`` as it is, with ``name``, which is ``score_toxicity``'s
    of that row's text.  Texts alone go to Python, and scores alone come back."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, int] = {}
        release_memory()
        for texts in batches:
            step = max(1, int(len(texts) * (4 << 20) / max(texts.nbytes, 1)))
            parts = (texts.slice(at, step).to_pylist() for at in range(0, len(texts), step))
            got = [model.score(part, cache) if model else np.zeros(len(part)) for part in parts]
            yield pa.array(np.concatenate(got) if got else np.zeros(0))

    return docs.withColumn(name, scores(text_of()))


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text).

    Windows are the words of the whole text, however long; each row is scored by
    itself, so repeated rows get equal scores.  A null or empty text has no
    window and gets the model's score for that; a null doc_id stays null.  Without a model (a class without labels,
    or nothing that sets toxic texts apart) every score is 0.  Only the text
    enters a score.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scorer(model, to_arrow_schema(StructType.fromDDL(SCHEMA))), SCHEMA)
