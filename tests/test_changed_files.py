"""Paths of a commit: the first 50, and '' where there are none."""

from ferrule.jobs import bindings
from ferrule.operators.changes import changed_files


def test_first_fifty_and_commits_without_changes(spark):
    rows = [("p", c, f"{k:03}.c") for c, n in ((1, 50), (2, 51), (3, 4)) for k in reversed(range(n))]
    changes = spark.createDataFrame(rows + rows[:9], "project string, commit_id long, path string")
    commits = spark.createDataFrame([("p", c) for c in (1, 2, 3, 4)], "project string, commit_id long")
    got = {r.commit_id: r.files for r in changed_files(changes, commits=commits).collect()}
    fifty = ";".join(f"{k:03}.c" for k in range(50))
    assert got == {1: fifty, 2: fifty, 3: "000.c;001.c;002.c;003.c", 4: ""}
    assert {r.commit_id for r in changed_files(changes).collect()} == {1, 2, 3}
    assert {r.files for r in changed_files(changes.where("commit_id = 3"), 2, commits=commits).collect()} == {"000.c;001.c", ""}


def test_query_keeps_every_path_of_every_order(spark):
    sf = "/root/testdata/sf0.001"
    parts = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        parts.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    orders = {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    got = {r.commit_id: len(r.files.split(";")) if r.files else 0 for r in bindings.queries()["changed_files_of_commits"](spark, sf).collect()}
    assert got == {k: len(parts.get(k, ())) for k in orders} and max(got.values()) > 3
