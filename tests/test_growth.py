"""What keeps jobs in proportion to their input: rows shuffled once, shuffle files dropped, few rows ordered."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferrule.jobs import bindings, dumps
from ferrule.operators import effort, running, stats
from ferrule.operators.shared import Tables
from ferrule.sources import logs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unaided(spark):
    """Without Spark's own choice of small tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("measure", ["running", "effort", "folds"])
def test_rows_are_shuffled_once(unaided, measure):
    """Slices' totals go to the rows, not the rows to them."""
    df = unaided.range(50_000).selectExpr("id % 3 g", "id k", "id % 7 v", "rand(1) p", "cast(id % 2 as int) y")
    out = {
        "running": lambda: running.running(df, ["g"], F.col("k"), [], {"s": F.col("v")}),
        "effort": lambda: effort.effort_measures(df, ["g"], "k", "p", "v", "y"),
        "folds": lambda: effort.time_series_folds(df, ["g"], "k", "k"),
    }[measure]()
    assert "SortMergeJoin" not in plan_of(out)


def test_group_totals(spark, monkeypatch):
    """Totals of groups of one slice and of many, with missing keys."""
    monkeypatch.setattr(running, "LEAST_ROWS", 100)
    df = spark.range(700).selectExpr("if(id < 50, null, id % 2) g", "if(id % 5 = 0, null, id) k", "id t")
    rows = df.collect()
    got = running.running(df, ["g"], F.col("k"), [F.col("t")], {"s": F.col("t")}, whole={"n": F.lit(1), "all": F.col("t")}).collect()
    for g in (None, 0, 1):
        mine = [r.t for r in sorted((r for r in rows if r.g == g), key=lambda r: (r.k is not None, r.k or 0, r.t))]
        assert sorted((r["rank"], r.t, r.s, r.n, r["all"]) for r in got if r.g == g) == [(i + 1, t, sum(mine[: i + 1]), len(mine), sum(mine)) for i, t in enumerate(mine)]


def test_shuffle_files_go(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    with Tables(spark) as tables:
        tables.put(spark.range(1000).groupBy(F.col("id") % 10).count())
        before = files()
        for _ in range(5):
            tables.put(spark.range(1000).groupBy(F.col("id") % 10).count())
        assert files() == before


def test_first_by_hash(spark):
    """The rows of the smallest hashes, as a plain ranking gives them; a null group is one."""
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randrange(2)) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, id long, y int")
    groups = defaultdict(list)
    for g, i, y in rows:
        groups[g, y].append((hashlib.md5(f"{i}:1".encode()).hexdigest(), i))
    want = set()
    for (g, _), ids in groups.items():
        want |= {(g, i) for _, i in sorted(ids)[: min(len(groups[g, y]) for y in (0, 1))]}
    assert {(r.g, r.id) for r in effort.undersample(df, ["g"], "id", "y").collect()} == want
    limits = spark.createDataFrame([(None, 0), ("a", 1), ("b", 10_000)], "g string, _least long")
    with Tables(spark) as tables:
        got = [(r.g, r.id) for r in effort.first_by_hash(tables, df, ["g"], "id", limits, 1).collect()]
    of = lambda g: [i for _, i in sorted(groups[g, 0] + groups[g, 1])]
    assert sorted(got) == sorted([("a", of("a")[0])] + [("b", i) for i in of("b")])


def test_rounds_of_a_fit(spark):
    """With next to no penalty the likelihood's rounding is no reason to halve a step."""
    df = spark.range(0, 240_000, 1, 4).selectExpr("if(id % 61 = 0, null, id % 61) grp", "floor(60 * rand(3)) a", "floor(20 * rand(1)) b", "cast(60 * rand(3) + (4 + id % 61 / 2) * randn(2) > 30 as int) y")
    # sums in whole tasks or in rounds
    whole, parts = ({r.grp: r for r in stats.fit_logistic(df, ["grp"], ["a", "b"], "y", c=1e6, rounds=14, most_rows=n).collect()} for n in (10**9, 0))
    assert len(whole) == 61 and whole.keys() == parts.keys()
    for g in whole:
        assert whole[g].settled and parts[g].settled and parts[g].weights == pytest.approx(whole[g].weights, abs=1e-7)


@pytest.mark.parametrize("all_parents", [True, False])
def test_blocks_of_merges(spark, tmp_path, monkeypatch, all_parents):
    """A merge's lines may lie in many blocks of lines, none of which one window holds whole."""
    (tmp_path / "p").mkdir()
    merges = [(f"{k:040x}", f"{k + b:040x}", b) for k in (1, 5) for b in (1, 2)]
    text = "".join(f"{m} (from {base}) merge\n\n" + "".join(f"M\tf{b}-{i}\n" for i in range(50)) for m, base, b in merges)
    (tmp_path / "p" / "dump").write_text(text)
    monkeypatch.setattr(logs, "BLOCK", 7)
    got = sorted((r.commit_id, r.base_commit, r.modified_path) for r in logs.read_merge_kinds(spark, str(tmp_path / "p"), all_parents).collect())
    assert got == sorted((m, base, f"f{b}-{i}") for m, base, b in merges if all_parents or b == 2 for i in range(50))


def test_parts_follow_rows(spark, monkeypatch):
    """A task's share of the changes does not grow with the table."""
    assert bindings._changes(spark, SF).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(bindings, "TASK_ROWS", 500)
    items = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert bindings._changes(spark, SF).rdd.getNumPartitions() == -(-items // 500) > 4


def test_diffs_are_dealt_before_they_are_text(unaided, monkeypatch):
    """Line items are shuffled once, as they are, and the dump is compressed."""
    plans, dump = [], dumps._dump

    def seen(rows, value, *compression):
        plans.append(plan_of(rows))
        out = dump(rows, value, *compression)
        plans.append(unaided.read.text(out).inputFiles())
        return out

    monkeypatch.setattr(dumps, "_dump", seen)
    dumps._diffs(unaided, SF)
    assert plans[0].count("Exchange") == 1 and plans[1] and all(f.endswith(".gz") for f in plans[1])
    dumps._numbers(unaided, SF), dumps._kinds(unaided, SF)
    assert all(f.endswith(".gz") for f in plans[3] + plans[5])


def test_rows_take_their_ranks_as_they_are(spark, monkeypatch):
    """No row for each feature is shuffled; null and equal values, and a null group, are as before."""
    plans, put = [], Tables.put
    monkeypatch.setattr(Tables, "put", lambda self, df, *more: plans.append(plan_of(df)) or put(self, df, *more))
    rows = [("g", k, float(k % 5), None if k % 4 == 0 else float(k % 3), None) for k in range(60)] + [(None, 99, 1.0, 2.0, None), ("none", 98, None, None, None)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double, c double")
    got = {(r.g, r.a, r.b): r.rho for r in stats.spearman_matrix(df, ["g"], "id", ["a", "b", "c"]).collect()}
    mean = lambda v: {x: sum(y < x for y in v) + (v.count(x) + 1) / 2 for x in v}
    of_a, of_b = mean([r[2] for r in rows[:60]]), mean([r[3] for r in rows[:60] if r[3] is not None])
    x, y = zip(*[(of_a[r[2]], of_b[r[3]]) for r in rows[:60] if r[3] is not None])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    rho = sum((p - mx) * (q - my) for p, q in zip(x, y)) / (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
    assert got == {("g", "a", "b"): pytest.approx(rho), ("g", "a", "c"): None, ("g", "b", "c"): None}
    assert plans and "id#" not in plans[-1] and plans[-1].count("Expand [") == 1


def test_xml_documents_follow_rows(spark, monkeypatch):
    """A document's share of the line items does not grow with the table."""
    monkeypatch.setattr(dumps, "TASK_ROWS", 200)
    folders, dump = [], dumps._dump
    monkeypatch.setattr(dumps, "_dump", lambda *a: folders.append(dump(*a)) or folders[-1])
    items = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert dumps.read_violations_xml(spark, SF).count() > 0 and dumps.warning_counts_xml(spark, SF).count() > 0
    for folder in folders:
        assert spark.read.text(folder).where("value = '<pmd>'").count() == -(-items // 200) > 16


def test_merges_are_shuffled_in_blocks(unaided, monkeypatch):
    """Lines of merges go to their commit once, not to blocks, headers and commits; the dump is compressed, a folder's name no search."""
    folders, dump = [], dumps._dump
    monkeypatch.setattr(dumps, "_dump", lambda *a: folders.append(dump(*a)) or folders[-1])
    plan = plan_of(dumps.read_merge_kinds(unaided, SF))
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(project") == 1 and "regexp_extract(input_file_name" not in plan
    assert all(f.endswith(".gz") for f in unaided.read.text(folders[0]).inputFiles())


def test_changes_of_a_commit_meet_in_one_exchange(unaided):
    """Numbers and kinds are dealt by commit, not each row by its whole name; repeated rows and missing names match as in a join."""
    from ferrule.operators import changes

    numbers = unaided.createDataFrame([(None, "c", None, "f", 1), (None, "c", None, "f", 2), ("p", "c", "b", "f", 3), ("p", "d", None, None, 4), ("p", "d", None, "g", 5)], "project string, commit_id string, base_commit string, modified_path string, added long")
    kinds = unaided.createDataFrame([(None, "c", None, "f", "add"), (None, "c", None, "f", None), ("p", "c", None, "f", "add"), ("p", "d", None, None, "delete")], "project string, commit_id string, base_commit string, modified_path string, change_type string")
    out = changes.file_changes(numbers, kinds)
    plan = plan_of(out)
    assert sorted((r.added, str(r.change_type)) for r in out.collect()) == [(1, "None"), (1, "add"), (2, "None"), (2, "add"), (4, "delete")]
    assert out.columns == [*numbers.columns, "change_type"] and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    commits = unaided.createDataFrame([("p", c, parents, "a", 1, "m") for c, parents in (("d", ["c"]), ("c", []), ("e", ["d", "c"]))], "project string, commit_id string, parents array<string>, author_email string, time_stamp long, message string")
    head, _ = changes.export_code_repo(commits, numbers.selectExpr("*", "added deleted", "cast(null as string) current_path"), kinds)
    assert sorted(r.value for r in head.collect()) == ["c;;d,e;p;a;1;m", "d;c;e;p;a;1;m", "e;d,c;;p;a;1;m"] and "Exchange" not in plan_of(head)


def test_hashes_need_no_quantiles(spark, monkeypatch):
    """Large groups are ranked by hash in slices that are known beforehand; a missing group is one."""
    monkeypatch.setattr(running, "LEAST_ROWS", 100)
    monkeypatch.setattr(running, "SLICE_ROWS", 10)
    df = spark.createDataFrame([(g, t) for g in ("a", None, "b") for t in range(40 if g == "b" else 900)], "g string, t long")
    ranked = effort._hash_rank(df, ["g"], "t", 1)
    assert "percentile_approx" not in plan_of(ranked) and ranked.columns == ["g", "t", "rank"]
    order = sorted(range(900), key=lambda t: hashlib.md5(f"{t}:1".encode()).hexdigest())
    want = {(g, t): k + 1 for g in ("a", None) for k, t in enumerate(order)} | {("b", t): k + 1 for k, t in enumerate(t for t in order if t < 40)}
    assert {(r.g, r.t): r["rank"] for r in ranked.collect()} == want
