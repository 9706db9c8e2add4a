"""Operators remove what they have saved on the way."""

import os

import pytest

from ferrule.llm import queries
from ferrule.llm.common import saved, tidy

SF = "/root/testdata/sf0.001"
#: Folders that a result is read from: its table, or the token files and their manifest.
LEFT = {"op8_token_files": 2, "op9_ngram_join": 1, "op10_katz": 1, "op12_source_divergence": 1, "op13_filter_audit": 1}


def folders(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")
    return {x for x in os.listdir(base) if x.startswith("ferrule-")}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_folder_but_what_the_result_reads(spark, name):
    before = folders(spark)
    n = queries.queries()[name](spark, SF).count()
    assert n and len(folders(spark) - before) == LEFT.get(name, 0)


def test_what_an_operator_saves_goes_though_it_fails(spark, sample):
    before = folders(spark)

    @tidy
    def inner(docs):
        return saved(docs.select("doc_id")).limit(3)

    @tidy
    def outer(docs, fail):
        out = inner(docs).unionByName(saved(docs.select("doc_id")).limit(2))
        if fail:
            raise ValueError("no")
        return out

    with pytest.raises(ValueError, match="no"):
        outer(sample, fail=True)
    assert folders(spark) == before
    assert outer(sample, fail=False).count() == 5 and len(folders(spark) - before) == 1
