import math
import random
import re
import zlib

import pytest
import zstandard

from ferrule.llm.toxicity import score_toxicity, train, with_score


def made(spark, docs_of, n=600):
    rng = random.Random(3)
    plain, bad = [f"{a}{b}" for a in ("ban", "lor", "mit", "sed") for b in ("ark", "ome", "ust", "iel")], ["wretch", "grubling"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 80))
        y = int(i % 6 == 0)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, 0, y))
    return docs_of(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark, docs_of):
    docs, labels = made(spark, docs_of)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scores = {r.doc_id: r.score for r in score_toxicity(docs, train(docs, labels)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((scores[i] >= 0.7) == bool(truth[i]) for i in held) and all(0 <= s <= 1 for s in scores.values())


def test_the_held_out_rows_labels_do_not_matter(spark, docs_of):
    from pyspark.sql import functions as F

    docs, labels = made(spark, docs_of, 200)
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in score_toxicity(docs, train(docs, x)).collect()) for x in (labels, other))
    assert a == b


def test_odd_texts_and_missing_classes(spark, docs_of, odd):
    docs, labels = made(spark, docs_of, 120)
    model = train(docs, labels)
    rows = score_toxicity(docs_of(odd), model).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert train(docs, labels.where("toxic = 0")) is None and train(docs, labels.limit(0)) is None
    assert {r.score for r in score_toxicity(docs, None).collect()} == {0.0}
    assert score_toxicity(docs_of([]), model).count() == 0


def plain_score(model, text):
    """A text's score from the two dictionaries, window by window."""
    toxic, ordinary, full, mean, spread, weights, level = model.parts
    form = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda d, b: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=form).compress(b))
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    gains = []
    for w in words:
        b = f" {w} ".encode()
        b *= 32 // len(b) + 1
        n = size(toxic, b)
        gains.append((size(ordinary, b) - n, n <= full))
    counts = [sum(g >= k and c == covered for g, c in gains) if k else None for k in range(1, 9) for covered in (False, True)]
    x = [math.log1p(c) for c in counts] + [c * 50 / max(20, len(words)) for c in counts[2:]]
    z = weights[0] + sum((a - m) / s * w for a, m, s, w in zip(x, mean, spread, weights[1:], strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_against_brute_force(spark, sample, docs_of, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    docs = sample.unionByName(docs_of([*odd[:8], *odd[9:], "x", "x"], [*range(-1, -10, -1), None, None, None][: len(odd) + 1]))
    rows = [r for r in docs.collect() if r.text is None or len(r.text) < 3000]
    got = {r.text: r.score for r in with_score(docs, model).collect()}
    assert len(rows) > 100
    for r in rows:
        assert got[r.text] == pytest.approx(plain_score(model, r.text), abs=1e-9)


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in score_toxicity(docs.join(labels, "doc_id", "left_semi"), train(docs, labels)).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hits = [truth[r.doc_id] for r in held if r.score >= 0.7]
    assert sum(hits) >= 0.95 * len(hits) and sum(hits) >= 0.8 * sum(truth[r.doc_id] for r in held)


def test_fit_is_bounded_and_takes_one_row_an_id(spark, docs_of):
    docs, labels = made(spark, docs_of, 300)
    twice = docs.unionByName(docs).unionByName(docs_of(["z" * 5000] * 2, [None, None]))
    assert train(twice, labels.unionByName(labels)).parts[:2] == train(docs, labels).parts[:2]
    assert train(docs, labels, most_bytes=20_000) is not None and train(docs, labels, most_bytes=1) is None
