"""Commit graphs and what precedes a commit, against plain walks over small random graphs."""

import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferrule.operators import graph as graphs
from ferrule.operators.graph import ancestors, forest, lines_above, numbered, paths_of, with_bases
from ferrule.operators.history import history
from ferrule.operators.shared import Tables


def graph(seed, n=40, project="p", merges=0.35, roots=0.05, near=6):
    """Commits with parents among the earlier ones."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        pool = list(range(max(0, i - near), i)) if rng.random() < 0.8 else list(range(i))
        k = 0 if not pool or rng.random() < roots else 1 + (rng.random() < merges) + (rng.random() < merges / 4)
        out[i] = rng.sample(pool, min(k, len(pool)))
    return {(project, i): [(project, p) for p in ps] for i, ps in out.items()}


def before(parents, first=False):
    """All ancestors of each commit; of a graph whose parents have smaller numbers."""
    seen = {}
    for c in sorted(parents, key=lambda c: c[1]):
        seen[c] = set()
        for p in parents[c][:1] if first else parents[c]:
            seen[c] |= {p} | seen[p]
    return seen


def tables_of(spark, parents):
    commits = spark.createDataFrame([(p, i) for p, i in parents], "project string, commit_id long")
    edges = spark.createDataFrame([(c[0], q[1], c[1], k) for c, ps in parents.items() for k, q in enumerate(ps)], "project string, parent_id long, child_id long, parent_no int")
    return commits, edges


GRAPHS = {
    "random": graph(1) | graph(2, project=None) | graph(3, 60, "q", merges=0.6, near=3),
    # two branches that merge each other over and over, and one that is merged into both again and again
    "ladder": {("p", i): [("p", p) for p in ps] for i, ps in enumerate([[], [0], [0]] + [[i - 2, i - 1] if i % 4 else [i - 2] for i in range(3, 40)])},
    "octopus": {("p", i): [("p", p) for p in ps] for i, ps in enumerate([[], [0], [0], [0], [1, 2, 3], [4], [3], [5, 6, 2], [7], [8, 4]])},
    "apart": {("p", i): [] for i in range(4)} | {("q", 0): [], ("q", 1): [("q", 0)]},
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_forest(spark, name):
    parents = GRAPHS[name]
    commits, edges = tables_of(spark, parents)
    with Tables(spark) as tables:
        nodes, links = numbered(tables, commits, edges)
        trees = forest(tables, nodes, links)
        ids = {r.node: (r.project, r.commit_id) for r in nodes.collect()}
        rows = {ids[r.node]: r for r in trees.collect()}
        above = defaultdict(set)
        for r in paths_of(trees, lines_above(tables, trees)).collect():
            above[ids[r.node]] |= {c for c, t in rows.items() if t.chain == r.chain and t.at <= r.upto}
    assert set(rows) == set(parents)
    want = before(parents, first=True)
    assert {c: above[c] for c in parents} == want
    for c, r in rows.items():
        inside = {d for d, t in rows.items() if t.root == r.root and r.tin <= t.tin < r.tin + r.size}
        assert inside == {c} | {d for d in parents if c in want[d]}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_ancestors(spark, name):
    parents = GRAPHS[name]
    commits, edges = tables_of(spark, parents)
    rows = [(r.project, r.commit_id, r.ancestor) for r in ancestors(edges.unionByName(edges), commits).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(*c, a[1]) for c, seen in before(parents).items() for a in seen}


def test_a_long_history(spark):
    """Three thousand commits in a row, with a branch at every tenth: no round for each generation."""
    n = 3000
    parents = {("p", i): [("p", i - 1)] if i else [] for i in range(n)} | {("p", n + i): [("p", i * 10)] for i in range(n // 10)}
    commits, edges = tables_of(spark, parents)
    began = time.time()
    rows = ancestors(edges, commits.where(f"commit_id in ({n - 1}, {n + 5})")).groupBy("commit_id").count().collect()
    assert {r.commit_id: r["count"] for r in rows} == {n - 1: n - 1, n + 5: 51} and time.time() - began < 120


def test_a_merge_follows_its_base(spark):
    """Lines go along the parent against which a merge's changes were counted, its own changes on top."""
    parents = {("p", 0): [], ("p", 1): [("p", 0)], ("p", 2): [("p", 0)], ("p", 3): [("p", 1), ("p", 2)], ("p", 4): [("p", 3)]}
    commits, edges = tables_of(spark, parents)
    rows = [("p", i, 7, "a", 100 * i, i, n, 0) for i, n in ((0, 10), (1, 100), (2, 1000), (3, 5), (4, 1))]
    touches = spark.createDataFrame(rows, SCHEMA)
    blocks = spark.createDataFrame([("p", 3, 2), (None, 3, 1)], "project string, commit_id long, base_commit long")
    lines = lambda e: {r.commit_id: r["lt"] for r in history(touches, commits, e, "first").collect()}
    assert lines(edges) == {0: 0, 1: 10, 2: 10, 3: 110, 4: 115}
    assert lines(with_bases(edges, blocks)) == {0: 0, 1: 10, 2: 10, 3: 1010, 4: 1015}


def test_a_circle_is_told(spark):
    edges = spark.createDataFrame([("p", 1, 2), ("p", 2, 1)], "project string, parent_id long, child_id long")
    with pytest.raises(ValueError, match="circle"):
        ancestors(edges, edges.selectExpr("project", "child_id as commit_id"))


def touches_of(parents, seed, files=5):
    """(project, commit, file, author, time, pos, added, deleted): times tie and run back, authors and files may be missing."""
    rng = random.Random(seed)
    rows = []
    for project, i in parents:
        author, t = rng.choice(["a", "b", "c", None]), 1000 + 86400 * (i // 3) - rng.choice([0, 0, 5000])
        rows += [(project, i, f, author, t, i, rng.randrange(9), rng.randrange(4)) for f in rng.sample([None, *range(files)], rng.choice([0, 1, 1, 2, 3]))]
    return rows + rows[:3]


def brute(rows, seen, tree):
    """``seen``: a commit's predecessors; ``tree``: those whose lines add up."""
    of = defaultdict(lambda: defaultdict(list))
    for p, i, f, a, t, _, x, y in rows:
        of[p, i][f].append((a, t, x - y))
    out = {}
    for c, own in of.items():
        devs, uses, days, lines = set(), set(), 0.0, 0
        for f, mine in own.items():
            past = [(b, x) for b in seen[c] if f in of.get(b, ()) for x in of[b][f]]
            devs |= {a for _, (a, _, _) in past}
            uses |= {(a, t) for _, (a, t, _) in past}
            days += (mine[0][1] - max(t for _, (_, t, _) in past)) / 86400.0 if past else 0.0
            lines += sum(n for b, (_, _, n) in past if b in tree[c])
        out[c] = (len(devs), round(len(uses) / len(own), 9), round(days / len(own), 9), round(lines / len(own), 9))
    return out


SCHEMA = "project string, commit_id long, lineage long, author string, time_stamp long, pos long, added long, deleted long"


@pytest.mark.parametrize(("name", "mode", "hot"), [("random", "line", 0), ("random", "line", 3), ("random", "first", 3), ("random", "all", 0), ("random", "all", 3), ("ladder", "all", 3), ("octopus", "all", 256)])
def test_history(spark, name, mode, hot):
    parents = GRAPHS[name]
    rows = touches_of(parents, hot)
    commits, edges = tables_of(spark, parents)
    if mode == "line":
        when = {(r[0], r[1]): (r[4], r[5]) for r in rows}
        seen = tree = {c: {b for b in when if b[0] == c[0] and when[b] < when[c]} for c in when}
    else:
        seen, tree = before(parents, mode == "first"), before(parents, True)
    got = history(spark.createDataFrame(rows, SCHEMA), commits, edges, mode, hot).collect()
    assert {(r.project, r.commit_id): (r.ndev, round(r.nuc, 9), round(r.age, 9), round(r["lt"], 9)) for r in got} == brute(rows, seen, tree)


def test_history_without_rows_leaves_nothing_behind(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")
    commits, edges = tables_of(spark, GRAPHS["octopus"])
    here = set(os.listdir(base))
    for mode in ("line", "first", "all"):
        assert history(spark.createDataFrame([], SCHEMA), commits, edges, mode).count() == 0
    ancestors(edges, commits).count()
    # what a result reads, and nothing else
    assert len(set(os.listdir(base)) - here) == 4


def test_a_file_that_all_touch(spark):
    """Twice the commits of several files on one path take about twice the time, not four times."""
    took = []
    for n in (20_000, 40_000):
        rows = spark.range(n).selectExpr("'p' project", "id commit_id", "explode(array(-1L, -2L, id)) lineage", "cast(id % 50 as string) author", "1000 + id * 60 time_stamp", "id pos", "2L added", "1L deleted")
        began = time.time()
        last = history(rows).orderBy("commit_id", ascending=False).first()
        took.append(time.time() - began)
        assert (last.ndev, round(last.nuc * 3)) == (50, n - 1)
    assert took[1] < 3 * took[0] + 5


def test_a_run_of_commits_is_one_step_of_the_tour(spark, monkeypatch):
    """Only branching commits are gone down and up; a round looks for ends of those that have none yet."""
    seen, plain = [], graphs.ranked
    monkeypatch.setattr(graphs, "ranked", lambda tables, links: seen.append(links.count()) or plain(tables, links))
    # one line of 100 commits, on which two more begin at commit 50
    edges = spark.createDataFrame([("p", x - 1, x) for x in range(2, 101)] + [("p", 50, 200), ("p", 200, 201)], "project string, parent_id long, child_id long")
    rows = ancestors(edges, edges.selectExpr("project", "child_id as commit_id").where("commit_id in (100, 201)"))
    assert {(r.commit_id, r.n) for r in rows.groupBy("commit_id").agg(F.count("*").alias("n")).collect()} == {(100, 99), (201, 51)}
    assert seen == [102, 6, 3]


def test_few_touches_on_a_chain_are_listed(spark, monkeypatch):
    """A file of many touches, but of few on each chain, needs no running totals along chains."""
    from ferrule.operators import history as module

    def none(*_, **__):
        raise AssertionError("counted along chains")

    monkeypatch.setattr(module, "latest", none)
    n = 12
    commits = spark.createDataFrame([("p", 3 * k + i) for k in range(n) for i in range(3)], "project string, commit_id long")
    edges = spark.createDataFrame([("p", 3 * k + i, 3 * k + i + 1, 0) for k in range(n) for i in range(2)], "project string, parent_id long, child_id long, parent_no int")
    touches = spark.createDataFrame([("p", 3 * k + i, "f", None if i else "a", 86400 * i, i, 5, 3) for k in range(n) for i in range(3)], "project string, commit_id long, lineage string, author string, time_stamp long, pos long, added long, deleted long")
    got = {r.commit_id: tuple(r)[2:] for r in history(touches, commits, edges, "first", hot=4).select("project", "commit_id", "ndev", "nuc", "age", "lt").collect()}
    assert got == {3 * k + i: (min(i, 2), float(i), float(i > 0), 2.0 * i) for k in range(n) for i in range(3)}
