"""Running values over slices of a group, and missing keys, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import changes, running, szz, warnings
from ferrule.operators.running import running as run


def plain(rows, down):
    out, rank, total, most, last = {}, 0, 0, None, object()
    for g, key, tie, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, 0 if r[1] is None else -r[1] if down else r[1], r[2])):
        if g != last:
            rank, total, most, last = 0, 0, None, g
        rank, total = rank + 1, total + (v or 0)
        most = v if most is None or (v is not None and v > most) else most
        out[g, tie] = (rank, total, most)
    return out


@pytest.mark.parametrize("kind", ["mixed", "one key", "falling"])
@pytest.mark.parametrize("spread", [False, True])
def test_running(spark, monkeypatch, kind, spread):
    monkeypatch.setattr(running, "LEAST_ROWS", 1)
    rng, down = random.Random(2), kind == "falling"
    keys = {"mixed": lambda: rng.choice([None, 5.0, 5.0, float(rng.randrange(9))]), "one key": lambda: 3.0, "falling": lambda: float(rng.randrange(40))}[kind]
    rows = [(rng.choice([None, "a", "b", "a"]), keys(), i, rng.choice([None, 1, 2, 7])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k double, t long, v long").repartition(5)
    if down:
        rows = [r for r in rows if r[1] is not None]
    out = run(df, ["g"], F.col("k"), [F.col("t")], {"s": F.coalesce("v", F.lit(0))}, descending=down, spread=F.col("t") if spread else None, most={"m": F.col("v")})
    assert {(r.g, r.t): (r["rank"], r.s, r.m) for r in out.collect()} == plain(rows, down)


def test_one_key_is_cut(spark):
    """A third of all rows of one time stamp, and a group of nothing but one: no task orders all of them."""
    df = spark.range(30_000).selectExpr("0 g", "if(id % 3 = 0, 5, id) k", "id t").unionByName(spark.range(20_000).selectExpr("1 g", "7L k", "id t"))
    seen = {0: [], 1: []}
    for r in running.sliced(df, ["g"], F.col("k"), spread=F.col("t")).groupBy("g", "_slice").count().collect():
        seen[r.g].append(r["count"])
    assert max(seen[0]) < 6000 and max(seen[1]) < 3000 and len(seen[1]) > 10


def test_missing_projects(spark):
    """Null projects join each other in every operator that joins by project."""
    make = lambda rows, schema: spark.createDataFrame(rows, "project string, " + schema)
    commits = make([(None, 1, "a", 100, 1, [], False), (None, 2, "b", 100 + 86400 * 365, 2, [1], False), (None, 3, "a", 100 + 2 * 86400 * 365, 3, [2], True)], "commit_id long, author string, time_stamp long, pos long, parents array<long>, is_merge boolean")
    by = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    touched = make([(None, 1, "x"), (None, 2, "x"), (None, 3, "x")], "commit_id long, subsystem string")
    assert by(changes.experience(commits), "commit_id", "exp") == [(1, 0), (2, 0), (3, 1)]
    assert by(changes.recent_experience(commits), "commit_id", "rexp") == [(1, 0), (2, 0), (3, pytest.approx(1 / 3))]
    assert by(changes.subsystem_experience(commits, touched), "commit_id", "sexp") == [(1, 0), (2, 0), (3, 1)]
    files = commits.select("project", "commit_id", F.lit("f").alias("lineage"), "author", "time_stamp", "pos", F.lit(3).alias("added"), F.lit(1).alias("deleted"))
    assert by(changes.history(files), "commit_id", "ndev", "nuc", "age", "lt") == [(1, 0, 0, 0, 0), (2, 1, 1, 365, 2), (3, 2, 2, 365, 4)]
    edges = changes.commit_edges(commits)
    for mode in ("first", "all"):
        assert by(changes.history(files, commits, edges, mode), "commit_id", "ndev", "lt") == [(1, 0, 0), (2, 1, 2), (3, 2, 4)]
    assert by(changes.ancestors(edges, commits), "commit_id", "ancestor") == [(2, 1), (3, 1), (3, 2)]
    assert by(changes.dedupe_identical(commits.withColumnRenamed("author", "committer_email")), "commit_id") == [(1,), (2,), (3,)]
    part = make([(None, 1, 7)], "commit_id long, la long")
    assert by(changes.combine_features(commits, part).where("la is not null"), "commit_id", "la") == [(1, 7)]
    assert by(changes.merge_c_features(commits, part), "commit_id", "la") == [(1, 7), (2, 0), (3, 0)]
    assert changes.complete_until_last_fix(commits.withColumn("is_fix", F.col("pos") == 2), ["author"]).count() == 2
    paths = make([(None, 1, "p", 4), (None, 2, "p", 4)], "commit_id long, path string, line_no int")
    assert by(changes.file_level_features(paths, part, paths.where("commit_id = 1")), "commit_id", "contains_bug") == [(1, True)]
    assert by(changes.changed_files(paths, commits=commits), "commit_id", "files") == [(1, "p"), (2, "p"), (3, "")]
    blame = make([(None, 2, "p", 4, 1, "p", 9, False)], "at_commit long, path string, line_no int, origin_commit long, origin_path string, origin_line int, is_boundary boolean")
    links = szz.szz_link(paths.where("commit_id = 2"), blame, commits)
    assert by(links, "fix", "origin", "origin_line") == [(2, 1, 9)]
    fixes = szz.fix_summary(links, paths.where("commit_id = 2")).collect()
    assert [(r.fix, r.fixes, r.fix_file_num, r.bug_fix_files) for r in fixes] == [(2, [1], 1, {"p": [4]})]
    assert by(szz.clean_files(paths, paths.where("commit_id = 1")), "commit_id") == [(2,)]
    lines = paths.withColumn("is_noise", F.lit(False))
    assert by(szz.clean_lines(lines, paths.where("commit_id = 1"), commits), "commit_id") == [(2,)]
    violations = paths.select("*", F.lit(1).alias("priority"), F.lit("r").alias("rule"))
    assert warnings.warnings_on_added_lines(violations, paths).count() == 2
    stats = make([(None, 1, None, "f", None, 1, 0)], "commit_id long, base_commit long, modified_path string, current_path string, added long, deleted long")
    kinds = make([(None, 1, None, "f", "add")], "commit_id long, base_commit long, modified_path string, change_type string")
    assert by(changes.file_changes(stats, kinds), "modified_path", "change_type") == [("f", "add")]
    moves = make([(None, 1, 1, 1, "a", None, "add"), (None, 2, 2, 2, "a", "b", "rename"), (None, 3, 3, 3, "b", None, "modify")], "commit_id long, time_stamp long, pos long, path string, new_path string, change_type string")
    assert len({r.lineage for r in changes.file_lineage(moves).collect()}) == 1


def test_busy_author(spark):
    """Sums that are carried from block to block, against every pair."""
    rng = random.Random(4)
    rows = [("p", i, "a" if i % 3 else None, 10**9 + rng.randrange(40 * 365) * 86400, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "project string, commit_id long, author string, time_stamp long, pos long")
    got = {r.commit_id: r.rexp for r in changes.recent_experience(df, block=64).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[4]))
    for k, (_, i, a, t, _) in enumerate(order):
        if k % 7 == 0:
            want = sum(1 / ((t - s) / (86400 * 365) + 1) for _, _, b, s, _ in order[:k] if b == a)
            assert got[i] == pytest.approx(want, rel=1e-9)
    assert len(got) == 1500
