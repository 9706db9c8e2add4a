from pyspark.sql import functions as F

from ferrule.functions import paths
from ferrule.operators import changes
from ferrule.sources import logs

A, B = "a" * 40, "b" * 40


def write(tmp_path, name, text):
    (tmp_path / "proj").mkdir(exist_ok=True)
    p = tmp_path / "proj" / name
    p.write_text(text)
    return str(p)


def test_commit_log(spark, tmp_path):
    head = "commit: {}\nparent: {}\nauthor: Ann\nauthor email: a@x\ntime stamp: {}\ncommitter: Bob\ncommitter email: b@x\n{}\n"
    p = write(tmp_path, "meta.log", head.format(A, "", 10, "first\ncommit: not a hash") + "\n" + head.format(B, f"{A} {'c' * 40}", 20, "") + "\n")
    a, b = logs.read_commit_log(spark, p).orderBy("time_stamp").collect()
    assert (a.project, a.parents, a.author_name, a.committer_email, a.time_stamp, a.message, a.is_merge) == ("proj", [], "Ann", "b@x", 10, "first", False)
    assert (b.commit_id, b.parents, b.message, b.is_merge) == (B, [A, "c" * 40], "", True)
    assert logs.rejected_records(spark, p).count() == 1
    edges = changes.commit_edges(logs.read_commit_log(spark, p))
    assert edges.count() == 2 and changes.roots(logs.read_commit_log(spark, p)).count() == 1


def test_stats(spark, tmp_path):
    p = write(tmp_path, "num.log", f"commit: {A}\n1\t2\ta/{{b => c}}/d.c\n-\t-\tlogo.png\n3\t0\ta/{{ => c}}/d.c\n0\t0\told.c => new.c\n\ncommit: {B}\n\n")
    rows = {(r.modified_path, r.current_path, r.added, r.deleted, r.is_rename) for r in logs.read_numstat(spark, p).collect()}
    assert rows == {("a/b/d.c", "a/c/d.c", 1, 2, True), ("logo.png", None, 0, 0, False), ("a/d.c", "a/c/d.c", 3, 0, True), ("old.c", "new.c", 0, 0, True)}
    q = write(tmp_path, "name.log", f"commit: {A}\nA\tx.c\nT\ty.c\nD\tz.c\nR100\told.c\tnew.c\n")
    assert {(r.modified_path, r.change_type, r.current_path) for r in logs.read_namestat(spark, q).collect()} == {("x.c", "add", None), ("y.c", "modify", None), ("z.c", "delete", None), ("old.c", "rename", "new.c")}
    both = changes.file_changes(logs.read_numstat(spark, p), logs.read_namestat(spark, q))
    assert [(r.modified_path, r.change_type) for r in both.collect()] == [("old.c", "rename")]
    m = write(tmp_path, "merge.log", f"{A} (from {B}) merge\n1\t1\tx.c\n\n{A} (from {'c' * 40}) merge\n2\t2\tx.c\n")
    assert sorted(r.added for r in logs.read_merge_stats(spark, m).collect()) == [1, 2]
    assert [r.added for r in logs.read_merge_stats(spark, m, all_parents=False).collect()] == [2]


def test_hunks_and_blame(spark, tmp_path):
    diff = "diff --git a/x y.c b/x y.c\n--- a/x y.c\n+++ b/x y.c\n@@ -3,2 +3 @@ f()\n-old();\n-  // note\n+*p = 1;\n@@ -9 +8,0 @@\n-\n"
    rows = logs.parse_hunks(spark.createDataFrame([("p", A, diff)], "project string, commit_id string, diff_text string")).collect()
    assert sorted((r.side, r.path, r.line_no, r.text, r.is_noise) for r in rows) == [("+", "x y.c", 3, "*p = 1;", True), ("-", "x y.c", 3, "old();", False), ("-", "x y.c", 4, "  // note", True), ("-", "x y.c", 9, "", True)]
    p = write(tmp_path, "blame.txt", f"{A} src/a.c 12 (Ann 2020-01-01 10:00:00 +0000 7) x = 1;\n^{'b' * 39} src/a.c 1 (Bob 2020-01-01 10:00:00 +0000 8) y\n")
    rows = logs.read_blame(spark, p, B).orderBy("line_no").collect()
    assert [(r.line_no, r.origin_commit, r.origin_line, r.is_boundary) for r in rows] == [(7, A, 12, False), (8, "b" * 39, 1, True)]


def test_path_functions(spark):
    rows = spark.createDataFrame([("a/b.C",), (".c",), ("x",), ("d/.c.h",)], "p string")
    got = rows.select("p", paths.in_extensions(F.col("p"), [".c", ".h"]).alias("e"), paths.subsystem_of(F.col("p")).alias("s"), paths.directory_of(F.col("p")).alias("d")).collect()
    assert {r.p: (r.e, r.s, r.d) for r in got} == {"a/b.C": (True, "a", "a"), ".c": (False, "", ""), "x": (False, "", ""), "d/.c.h": (True, "d", "d")}
    text = spark.createDataFrame([("prefix it", False), ("docs", False), ("x", True), ("zzz", False)], "m string, g boolean")
    kinds = [r[0] for r in text.select(paths.classify_message(F.col("m"), F.col("g"), [("Corrective", ["fix"]), ("Non Functional", ["doc"])])).collect()]
    assert kinds == ["Corrective", "Non Functional", "Merge", "None"]


def test_merge_dumps_in_many_splits(spark, tmp_path):
    """Headers carry over to lines of later splits; whole files give the same."""
    import random

    rng = random.Random(1)
    want, kinds, text, names = [], [], "noise\n1\t1\tnot a block\n", ""
    for k in range(200):
        head = f"{k // 2:040x} (from {k + 1000:040x}) merge\tof {k}\n"
        paths = [f"d{rng.randrange(9)}/f{j}.c" for j in range(rng.randrange(30))]
        text += head + "".join(f"{j}\t1\t{p}\n" for j, p in enumerate(paths)) + "\n"
        names += head + "".join(f"{'AMD'[j % 3]}\t{p}\n" for j, p in enumerate(paths)) + "\n"
        want += [(f"{k // 2:040x}", f"{k + 1000:040x}", p, j) for j, p in enumerate(paths)]
        kinds += [(f"{k // 2:040x}", f"{k + 1000:040x}", p, ("add", "modify", "delete")[j % 3]) for j, p in enumerate(paths)]
    m, n = write(tmp_path, "merge.log", text), write(tmp_path, "kinds.log", names)
    last = {}
    for c, b, *_ in want:
        last[c] = b
    for size in ("700b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert size == "128m" or spark.read.text(m).rdd.getNumPartitions() > 50
            got = sorted((r.commit_id, r.base_commit, r.modified_path, r.added) for r in logs.read_merge_stats(spark, m).collect())
            assert got == sorted(want)
            got = sorted((r.commit_id, r.base_commit, r.modified_path, r.change_type) for r in logs.read_merge_kinds(spark, n).collect())
            assert got == sorted(kinds)
            got = sorted((r.commit_id, r.base_commit, r.modified_path, r.change_type) for r in logs.read_merge_kinds(spark, n, all_parents=False).collect())
            assert got == sorted(r for r in kinds if last[r[0]] == r[1])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_violations_of_xml(spark, tmp_path):
    x = write(tmp_path, "pmd.xml", """<?xml version="1.0"?>
<pmd version="6"><file name="a &lt;b&gt;.java">
<violation beginline="3" endline="9" priority="2" rule="R1">says "no" &amp; more</violation>
<violation beginline=" 4 " endline="4" priority="5" rule="R2"/>
<violation endline="4" priority="1" rule="R3"/><violation beginline="x" endline="4" priority="1" rule="R3"/>
</file><file name="none.java"></file><file name="one.java"><violation beginline="1" endline="1" priority="1" rule="R1"/></file></pmd>""")
    rows = logs.read_violations_xml(spark, x, "p", "c")
    assert sorted((r.project, r.commit_id, r.path, r.line_no, r.priority, r.rule) for r in rows.collect()) == [("p", "c", "a <b>.java", 3, 2, "R1"), ("p", "c", "a <b>.java", 4, 5, "R2"), ("p", "c", "one.java", 1, 1, "R1")]
    from ferrule.operators.warnings import warning_counts

    assert {r.path: (r.block, r.critical, r.major) for r in warning_counts(rows, ["path"], at_least_major=True).collect()} == {"a <b>.java": (0, 1, 1), "one.java": (1, 0, 0)}


def test_a_line_of_blame_is_matched_once(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "b.txt").write_text(f"^{'a' * 39} a b.c 7 (Ann (x) 2020-01-01 3) f(1);\nnothing\n{'b' * 40} c\td.c 2 (B 99999999999)\n\n", encoding="utf-8")
    rows = logs.read_blame(spark, str(tmp_path / "proj"), "h")
    assert sorted((r.path, r.line_no, r.origin_commit, r.origin_line, r.is_boundary) for r in rows.collect()) == [("a b.c", 3, "a" * 39, 7, True), ("c\td.c", None, "b" * 40, 2, False)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9a-f]") == 1, plan
