"""Operators on small tables made by hand, against results worked out by hand or by brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions.c_code import metrics
from ferrule.functions.paths import classify_message, in_scope_change
from ferrule.operators import changes, effort, stats
from ferrule.sources import logs

# text: memory taken, given back, changed; pointers of one star, of more, deepest; gotos, brackets, ++ and --
C_TEXT = [
    ("goto end;", (0, 0, 0, 0, 0, 0, 1, 0, 0)),
    ("goto\t end ;goto 2x;gotox;", (0, 0, 0, 0, 0, 0, 2, 0, 0)),
    ("malloc calloc realloc", (3, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("mallocalloc", (2, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("free(p); freeze", (0, 2, 0, 0, 0, 0, 0, 0, 0)),
    ("a[i] b[] c[1][x] d[é]", (0, 0, 0, 0, 0, 0, 0, 4, 0)),
    ("i++; --i; +++x; ----", (0, 0, 0, 0, 0, 0, 0, 0, 5)),
    ("*p = **pp; a * b; ***q", (0, 0, 0, 2, 2, 3, 0, 0, 0)),
    ("x // a*b free\ny /* ** \n malloc */ z", (0, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("// no line end a*b", (0, 0, 0, 1, 0, 1, 0, 0, 0)),
    ("", (0, 0, 0, 0, 0, 0, 0, 0, 0)),
]


def test_c_counts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(C_TEXT)], "i int, t string")
    got = {r[0]: tuple(r[1:]) for r in df.select("i", *[c.alias(n) for n, c in metrics(F.col("t")).items()]).collect()}
    assert got == {i: want for i, (_, want) in enumerate(C_TEXT)}


def test_hunks_give_c_counts(spark):
    diff = "diff --git a/x y.c b/x y.c\n--- a/x y.c\n+++ b/x y.c\n@@ -1,3 +1,3 @@ f(int *p)\n a[0]\n-free(p);\n+malloc(1);\n b[1]\n+i++;\ndiff --git a/gone.h b/gone.h\n--- a/gone.h\n+++ /dev/null\n@@ -5 +0,0 @@\n-goto x;\n"
    df = spark.createDataFrame([("p", "c", diff), ("p", "d", "diff --git a/r.md b/r.md\n--- a/r.md\n+++ b/r.md\n@@ -1 +1 @@\n-free\n+free\n")], "project string, commit_id string, diff_text string")
    assert sorted((r.path, r.hunk_no) for r in logs.hunk_bodies(df).collect()) == [("gone.h", 1), ("r.md", 1), ("x y.c", 1)]
    names = ("meminc", "memdec", "singlepointer", "gotostm", "indexused", "autoincredecre")
    whole, body = ({r.commit_id: tuple(r[n] for n in names) for r in changes.c_features(logs.hunk_bodies(df), only).collect()} for only in (False, True))
    assert whole == {"c": (1, 1, 1, 1, 2, 1), "d": (0,) * 6} and body == {"c": (1, 0, 0, 0, 2, 1), "d": (0,) * 6}
    lines = {(r.side, r.path, r.line_no, r.text) for r in logs.parse_hunks(df).where("commit_id = 'c'").collect()}
    assert lines == {("-", "x y.c", 2, "free(p);"), ("+", "x y.c", 2, "malloc(1);"), ("+", "x y.c", 4, "i++;"), ("-", "gone.h", 5, "goto x;")}


def test_blame_with_blanks_and_rejects(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "b.txt").write_text(f"{'a' * 40} my file.c  12 (Ann B (x) 2020-01-01 10:00:00 +0000 7) f(1);\nnothing\n\n")
    rows = logs.read_blame(spark, str(tmp_path / "proj"), "h").collect()
    assert [(r.project, r.path, r.origin_line, r.line_no) for r in rows] == [("proj", "my file.c", 12, 7)]
    assert [r.value for r in logs.rejected_blame(spark, str(tmp_path / "proj")).collect()] == ["nothing"]


def test_keywords(spark, tmp_path):
    (tmp_path / "corrective.csv").write_text("Fix, bug\n,crash")
    (tmp_path / "feature_addition.csv").write_text("add")
    order = ["Corrective", "Feature Addition", "Perfective"]
    lists = logs.keyword_lists(logs.read_keywords(spark, str(tmp_path)), order)
    assert lists == [("Corrective", ["fix", "bug", "crash"]), ("Feature Addition", ["add"])]
    df = spark.createDataFrame([("prefix",), ("Added",), ("x",)], "m string")
    assert [r[0] for r in df.select(classify_message(F.col("m"), F.lit(False), lists)).collect()] == ["Corrective", "Feature Addition", "None"]


def test_scope(spark):
    df = spark.createDataFrame([(False, "a.c", None, None), (True, "a.c", None, None), (False, "a.x", "b.h", True), (False, "a.x", "b.h", False), (False, "d/.c", None, None)], "m boolean, o string, n string, r boolean")
    got = [r[0] for r in df.select(in_scope_change(F.col("m"), F.col("o"), F.col("n"), F.col("r"), [".c", ".h"])).collect()]
    assert got == [True, False, True, False, False]


def test_tables_of_a_database(spark, tmp_path):
    """With the database that comes with Spark, where its driver is there."""
    import pyspark

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    if not any(j.startswith("derby-") for j in os.listdir(jars)):
        pytest.skip("no database at hand")
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([("a", 1), ("b", 2), ("o'c", 3)], "project string, n long")
    logs.write_table(df, url, "t", driver=driver, createTableColumnTypes="project VARCHAR(100)")
    rows = lambda **k: sorted((tuple(r) for r in logs.read_table(spark, url, "t", driver=driver, **k).collect()), key=str)
    assert rows(projects=[None]) == [] and rows(projects=[]) == [] and rows(projects=["a", None, "a"]) == [("a", 1)]
    # one scan with a task for each project, however many
    many = logs.read_table(spark, url, "t", projects=[f"p{k}" for k in range(40)] + ["o'c"], driver=driver)
    assert many.rdd.getNumPartitions() == 41 and many._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and [r.n for r in many.collect()] == [3]
    assert rows() == [("a", 1), ("b", 2), ("o'c", 3)] and rows(projects=["b", "o'c"]) == [("b", 2), ("o'c", 3)]


def test_missing_projects_are_projects(spark):
    rows = [(None, 1, 0.9, 5.0, 1), (None, 2, 0.2, 3.0, 0), ("b", 3, 0.7, 2.0, 0)]
    df = spark.createDataFrame(rows, "project string, id long, score double, effort double, label int")
    args = (df, ["project"], "id", "score", "effort", "label")
    assert {r.project: r.recall20p for r in effort.effort_measures(*args).collect()} == {None: 1.0, "b": None}
    popt = {r.project: r.popt for r in effort.popt_normalized(*args).collect()}
    assert popt.keys() == {None, "b"} and popt["b"] is None and popt[None] is not None
    assert effort.lift_curve(*args).count() == 3 and effort.undersample(df, ["project"], "id", "label").count() == 3
    assert {r.project for r in effort.time_series_folds(df, ["project"], "id", "id", 1, 1).collect()} == {None, "b"}


def lineages(touches):
    """One after another: who carries which name."""
    live, ends, starts, out = {}, {}, {}, {}

    def fresh(path):
        return f"{path}#{starts.get(path, 0) + ends.get(path, 0)}"

    for c, path, new, kind in touches:
        if kind == "add":
            starts[path] = starts.get(path, 0) + 1
            live[path] = fresh(path)
        name = live.setdefault(path, fresh(path))
        out[c] = name
        if kind in ("delete", "rename"):
            del live[path]
            ends[path] = ends.get(path, 0) + 1
        if kind == "rename":
            starts[new] = starts.get(new, 0) + 1
            live[new] = name
    return out


def test_lineage_through_renames(spark):
    rng = np.random.default_rng(4)
    fixed = [(0, "a", None, "add"), (1, "a", "b", "rename"), (2, "b", "a", "rename"), (3, "a", None, "modify"), (4, "a", None, "delete"), (5, "a", None, "add"), (6, "b", None, "modify"), (7, "a", "c", "rename"), (8, "c", "d", "rename"), (9, "d", None, "modify")]
    for touches in (fixed, [(c, f"f{rng.integers(6)}", f"g{rng.integers(6)}" if rng.random() < 0.5 else f"f{rng.integers(6)}", rng.choice(["add", "rename", "delete", "modify"])) for c in range(150)]):
        touches = [(c, p, n if k == "rename" and n != p else None, "modify" if k == "rename" and n == p else str(k)) for c, p, n, k in touches]
        df = spark.createDataFrame([("p", c, c // 3, c, p, n, k) for c, p, n, k in touches], "project string, commit_id long, time_stamp long, pos long, path string, new_path string, change_type string")
        got = {r.commit_id: r.lineage for r in changes.file_lineage(df.repartition(3)).collect()}
        assert got == lineages(touches)


def test_ancestors_of_merges(spark):
    rng = np.random.default_rng(1)
    parents = {c: sorted(set(rng.integers(0, c, 2).tolist())) if c else [] for c in range(40)}
    df = spark.createDataFrame([("p", c, p) for c, p in parents.items()], "project string, commit_id long, parents array<long>")
    above = {c: set() for c in parents}
    for c in sorted(parents):
        above[c] = set(parents[c]).union(*[above[p] for p in parents[c]])
    got = {(r.commit_id, r.ancestor) for r in changes.ancestors(changes.commit_edges(df), df.where("commit_id % 7 = 4")).collect()}
    assert got == {(c, a) for c in parents if c % 7 == 4 for a in above[c]}


def test_history_with_one_and_several_files(spark):
    rng = np.random.default_rng(2)
    rows = [("p", c, f"f{f}", f"d{rng.integers(3)}", int(rng.integers(0, 15)), c, 5, 2) for c in range(60) for f in set(rng.integers(0, 5, 1 + c % 3).tolist())]
    rows = [(p, c, f, f"d{c % 3}", c // 4, c, a, b) for p, c, f, _, _, _, a, b in rows]
    df = spark.createDataFrame(rows, "project string, commit_id long, lineage string, author string, time_stamp long, pos long, added long, deleted long")
    got = {r.commit_id: (r.ndev, r.nuc) for r in changes.history(df).collect()}
    for c in {r[1] for r in rows}:
        files = {r[2] for r in rows if r[1] == c}
        before = [r for r in rows if r[2] in files and (r[4], r[5]) < (c // 4, c)]
        assert got[c] == (len({r[3] for r in before}), pytest.approx(len({(r[3], r[4]) for r in before}) / len(files)))


def test_fit_settles_at_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, (300, 2)).astype(float)
    y = (x[:, 0] + rng.normal(0, 10, 300) > 40).astype(int)
    rows = [(None if g else "p", *map(float, a), int(b)) for a, b, g in zip(x, y, np.arange(300) % 2, strict=True)]
    df = spark.createDataFrame(rows, "project string, a double, b double, y int")
    fits = {r.project: np.array(r.weights) for r in stats.fit_logistic(df, ["project"], ["a", "b"], "y").collect()}
    for g, project in enumerate(("p", None)):
        own = np.arange(300) % 2 == g
        z = np.column_stack((np.ones(own.sum()), np.log2(x[own] + 1)))
        p = 1 / (1 + np.exp(-z @ fits[project]))
        assert np.abs(z.T @ (y[own] - p) - fits[project]).max() < 1e-6


def test_permutation_importance(spark):
    import hashlib

    rng = np.random.default_rng(6)
    rows = [(k, float(rng.integers(0, 50)), float(rng.integers(0, 50))) for k in range(60)]
    rows = [(k, a, b, int(a + rng.normal(0, 8) > 30), a + b + 1) for k, a, b in rows]
    df = spark.createDataFrame([("p", *r) for r in rows], "project string, id long, a double, b double, label int, effort double")
    weights = spark.createDataFrame([("p", [-8.0, 1.5, 0.1])], "project string, weights array<double>")
    got = {r.feature: r["drop"] for r in stats.permutation_importance(df, weights, ["project"], "id", ["a", "b"], "label", "effort").collect()}

    def measured(values):
        scored = [(k, 1 / (1 + np.exp(8 - 1.5 * np.log2(a + 1) - 0.1 * np.log2(b + 1))), y, e) for k, a, b, y, e in values]
        order = sorted(scored, key=lambda r: (r[1] < 0.5, -r[1] / (r[3] + 1e-5), r[0]))
        total, spent, within = sum(r[3] for r in order), 0.0, []
        for r in order:
            spent += r[3]
            if spent <= 0.2 * total:
                within.append(r)
        hit = sum(r[2] for r in within)
        return 2 * hit / (len(within) + sum(r[2] for r in scored))

    place = lambda texts: sorted(texts, key=lambda t: hashlib.md5(f"{t}:1".encode()).hexdigest())
    for col, name in ((1, "a"), (2, "b")):
        to = [int(t) for t in place([str(r[0]) for r in rows])]
        values = [rows[int(t.split(":")[1])][col] for t in place([f"{name}:{r[0]}" for r in rows])]
        new = dict(zip(to, values, strict=True))
        mixed = [tuple(new[r[0]] if k == col else v for k, v in enumerate(r)) for r in rows]
        assert got[name] == pytest.approx(measured(rows) - measured(mixed), abs=1e-9)
