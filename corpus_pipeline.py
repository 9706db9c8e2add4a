"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.  Stages are written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import discard, fresh, text_of, tidy_at
from ferrule.llm.exact_dedup import exact_groups, normalised
from ferrule.llm.ngram_join import near_duplicates
from ferrule.llm.packing import pack_documents
from ferrule.llm.pii import redact
from ferrule.llm.toxicity import train, with_score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Drop rows whose score reaches ``threshold``.

    Each row is judged by its own text, whatever rows share its doc_id or lack one.
    The model learns from labelled rows of its input, held-out ones excepted; a
    null or empty text is scored like any other, and whole texts are, however
    long.  Repeated rows stay or go together; other columns stay as they are."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return with_score(docs, model, score).where(F.col(score) < threshold).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, keep the one of the smallest doc_id.

    Rows that repeat both id and text become one; a missing id ranks last.  A
    null text counts as empty.  Other columns stay as they are."""
    id_, sha = fresh(docs, "id"), fresh(docs, "sha")
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_)
    kept = exact_groups(docs).where("kept").select(id_key, F.col("text_sha256").alias(sha))
    own = docs.withColumns({id_: id_key, sha: F.sha2(normalised(text_of()).cast("binary"), 256)})
    return own.join(kept, [id_, sha], "left_semi").dropDuplicates([id_, sha]).drop(id_, sha)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the document of the smallest doc_id.

    A row without an id stays, as none can be named in its stead; so does one
    without words, which is like no other.  Rows that repeat the id that stays
    all stay.  Other columns stay as they are."""
    kept = fresh(docs, "kept")
    ids = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.join(ids, F.col("doc_id").cast("long") == F.col(kept), "left_semi")
    return named.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every row stays, and a null text stays null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: The tokenizer and the trained model have no SQL form; tests hold the result against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's rows go when the next one's are written; the last one's stay, as the pieces are read from them."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = tidy_at(stage)(spark, docs, sf_dir)
        if old:
            discard(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
