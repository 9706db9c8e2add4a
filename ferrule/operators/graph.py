"""The graph of commits as tables from which ancestry is read without walking it.

Each commit's first parent makes a forest.  Its sizes come from ranking the tour
that goes down and up every tree (pointers that double: a number of joins
logarithmic in the history's length, whatever its shape), on which commits with
one child each are one step.  Each commit continues
the chain of its heaviest child, so the way from a commit to its root crosses few
chains (at most log2 of the tree's size), and "all up to a place of a chain" stands for all
commits of it that come before.  What merges bring in is found chain by chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.running import running, same_group
from ferrule.operators.shared import Tables

#: Links doubled so often reach 2^60 steps: what has no end by then is a circle.
MOST_ROUNDS = 60


def ranked(tables: Tables, links: DataFrame) -> DataFrame:
    """(x, last, total) of ``links`` (x, next, weight): where following ``next``
    ends, and the weights on the way, x's own and the end's too.  Other columns stay with x.

    A round looks for the ends of those that have none yet, and writes these only."""
    more = [c for c in links.columns if c not in ("x", "next", "weight")]
    end = F.when(F.col("next").isNull(), F.col("x"))
    with Tables(tables.spark) as own:
        now = own.put(links.select("x", "next", F.col("weight").cast("long").alias("total"), end.alias("last"), *more))
        done, left = now.where("next is null"), now.where("next is not null")
        for _ in range(MOST_ROUNDS):
            if left.isEmpty():
                return tables.put(done.select("x", "last", "total", *more))
            far = done.unionByName(left).select(F.col("x").alias("_x"), F.col("next").alias("_next"), F.col("total").alias("_total"), F.col("last").alias("_last"))
            step = left.join(far, F.col("next") == F.col("_x"), "left")
            now = own.put(step.select("x", F.col("_next").alias("next"), (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total"), F.col("_last").alias("last"), *more))
            done, left = done.unionByName(now.where("next is null")), now.where("next is not null")
    raise ValueError("the parents of some commits form a circle")


def with_bases(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """``edges`` in which a merge's base counts as its first parent: the parent
    against which ``blocks`` (project, commit_id, base_commit) have its changes, as
    ``read_merge_stats(..., all_parents=False)`` gives them.  Merges without a block stay as they are."""
    base = blocks.select("project", F.col("commit_id").alias("child_id"), F.col("base_commit").alias("parent_id")).distinct().withColumn("_base", F.lit(-1))
    rows = same_group(edges, base, ["project", "child_id", "parent_id"], "left")
    return rows.withColumn("parent_no", F.coalesce("_base", "parent_no")).drop("_base")


def numbered(tables: Tables, commits: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, commit_id, node) of ``commits`` and (node, parent, first) of
    ``edges`` (project, parent_id, child_id, and parent_no where known) between them.

    A commit's first parent is the one of the smallest number, or of the smallest
    id; parents that ``commits`` lacks do not count."""
    nodes = tables.put(commits.select("project", "commit_id").distinct().withColumn("node", F.monotonically_increasing_id()))
    no = F.col("parent_no") if "parent_no" in edges.columns else F.lit(0)
    rows = edges.select("project", F.col("child_id").alias("commit_id"), "parent_id", no.alias("_no"))
    rows = same_group(rows, nodes, ["project", "commit_id"])
    rows = same_group(rows.select("project", "node", "_no", F.col("parent_id").alias("commit_id")), nodes.withColumnRenamed("node", "parent"), ["project", "commit_id"])
    # dealt by commit, which has few parents: nothing is shuffled again
    pairs = rows.repartition("node").groupBy("node", "parent").agg(F.min(F.struct("_no", "commit_id")).alias("_at"))
    return nodes, tables.put(pairs.select("node", "parent", (F.col("_at") == F.min("_at").over(Window.partitionBy("node"))).alias("first")))


def forest(tables: Tables, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, parent, root, tin, size, chain, at) of the forest of first parents.

    A commit's descendants are the ``size`` commits from ``tin`` on of its root's
    tree.  ``chain`` is the first commit of its chain, ``at`` its place there, from 0."""
    tree = parents.where("first").select("node", "parent")
    # a run goes down from a commit as long as each has one child; it then counts as one, as long as it is
    lone = tree.groupBy("parent").agg(F.count("*").alias("_n"), F.min("node").alias("node")).where("_n = 1").select("node", F.col("parent").alias("next"))
    steps = nodes.select("node").join(tree, "node", "left").join(lone, "node", "left")
    rows = ranked(tables, steps.select(F.col("node").alias("x"), "next", F.lit(1).alias("weight"), "parent"))
    long = rows.groupBy(F.col("last").alias("run")).agg(F.max("total").alias("length"))
    tops = rows.where("x = last and parent is not null").select(F.col("x").alias("run"), "parent")
    up = tops.join(rows.select(F.col("x").alias("parent"), F.col("last").alias("up")), "parent").select("run", "up")
    runs = tables.put(long.join(up, "run", "left"))
    below = runs.where("up is not null").select("run", "up")
    # children of one run by number; a run's children are few beside the commits
    beside = below.select("run", F.lead("run").over(Window.partitionBy("up").orderBy("run")).alias("beside"))
    child = below.groupBy(F.col("up").alias("run")).agg(F.min("run").alias("child"))
    down, back = F.col("run") * 2, F.col("run") * 2 + 1
    tour = F.array(
        F.struct(down.alias("x"), F.coalesce(F.col("child") * 2, back).alias("next"), F.col("length").alias("weight")),
        F.struct(back.alias("x"), F.coalesce(F.col("beside") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("weight")),
    )
    way = ranked(tables, runs.join(beside, "run", "left").join(child, "run", "left").select(F.inline(tour)))
    # weights from a run on: what is left below it and after it
    half = lambda odd, name: way.where(F.col("x") % 2 == odd).select(F.shiftright("x", 1).alias("run"), F.shiftright("last", 1).alias("root"), F.col("total").alias(name))
    sized = half(0, "_in").join(half(1, "_out").drop("root"), "run")
    top = sized.where("run = root").select("root", F.col("_in").alias("_all"))
    sized = sized.join(top, "root").select("run", "root", (F.col("_all") - F.col("_in")).alias("tin"), (F.col("_in") - F.col("_out")).alias("size"))
    sized = tables.put(runs.join(sized, "run"), way)
    tables.drop(runs)
    heavy = sized.where("up is not null").groupBy("up").agg(F.max(F.struct("size", (-F.col("run")).alias("_n"))).alias("_h")).select((-F.col("_h._n")).alias("run"), F.col("up").alias("next"))
    chains = ranked(tables, sized.select("run", "length").join(heavy, "run", "left").select(F.col("run").alias("x"), "next", F.col("length").alias("weight")))
    place = sized.join(chains.select(F.col("x").alias("run"), F.col("last").alias("chain"), "total"), "run").select(F.col("run").alias("last"), "root", "tin", "size", "chain", (F.col("total") - F.col("length")).alias("at"))
    here = F.col("total") - 1
    out = rows.join(place, "last").select(F.col("x").alias("node"), "parent", "root", (F.col("tin") + here).alias("tin"), (F.col("size") - here).alias("size"), "chain", (F.col("at") + here).alias("at"))
    out = tables.put(out, sized)
    tables.drop(chains)
    tables.drop(rows)
    return out


def lines_above(tables: Tables, trees: DataFrame) -> DataFrame:
    """(chain, above, upto): the chains that the way from a chain's start to the root crosses, and up to which place."""
    heads = trees.where("node = chain and parent is not null").select("chain", "parent")
    base = tables.put(heads.join(trees.select(F.col("node").alias("parent"), F.col("chain").alias("above"), F.col("at").alias("upto")), "parent").select("chain", "above", "upto"))
    found = now = base
    while not now.isEmpty():
        # a hop at least doubles the tree below, so there are few rounds
        step = now.join(base.select(F.col("chain").alias("above"), F.col("above").alias("_a"), F.col("upto").alias("_u")), "above")
        now = tables.put(step.select("chain", F.col("_a").alias("above"), F.col("_u").alias("upto")))
        found = found.unionByName(now)
    return tables.put(found)


def hops(trees: DataFrame, parents: DataFrame) -> DataFrame:
    """(chain, at, to_chain, to_at): from a place of a chain to that of a parent on another one."""
    place = trees.select("node", "chain", "at")
    far = place.withColumnsRenamed({"node": "parent", "chain": "to_chain", "at": "to_at"})
    # a commit's first parent is on its own chain but where that begins
    heads = trees.where("at = 0 and parent is not null").select("chain", "at", "parent")
    rows = heads.unionByName(parents.where("not first").join(place, "node").select("chain", "at", "parent")).join(far, "parent")
    return rows.where("chain <> to_chain").select("chain", "at", "to_chain", "to_at")


def reach(tables: Tables, known: DataFrame | None, start: DataFrame, jumps: DataFrame) -> DataFrame:
    """(source, chain, at): up to which place of each chain a source reaches, from
    ``start`` (the same columns) over ``jumps``, beyond what is ``known`` of it.

    A round follows, from what the last one added, the jumps of whole chains; the
    rounds are as many as chains in a row that must be crossed, not generations."""
    add = start.groupBy("source", "chain").agg(F.max("at").alias("at"))
    known = known if known is not None else start.limit(0)
    while True:
        low = known.withColumnRenamed("at", "low")
        add = add.join(low, ["source", "chain"], "left").withColumn("low", F.coalesce("low", F.lit(-1).cast("long"))).where(F.col("at") > F.col("low"))
        fresh = tables.put(add)
        if fresh.isEmpty():
            tables.drop(fresh)
            return known
        both = known.unionByName(fresh.select("source", "chain", "at"))
        old, known = known, tables.put(both.groupBy("source", "chain").agg(F.max("at").alias("at")))
        tables.drop(old)
        step = fresh.join(jumps.withColumnRenamed("at", "_from"), "chain").where("_from > low and _from <= at")
        add = step.groupBy("source", F.col("to_chain").alias("chain")).agg(F.max("to_at").alias("at"))


def ancestors(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(project, commit_id, ancestor) of the given ``commits``: all that their
    parents lead to by ``edges`` (project, parent_id, child_id).

    Chains are numbered once, which takes joins in a number logarithmic in the
    longest history; a commit's ancestors are then whole beginnings of chains.
    Null projects are one project, repeated edges and commits count once, a
    commit without parents gives no row."""
    with Tables(edges.sparkSession) as tables:
        ids = [edges.select("project", F.col(c).alias("commit_id")) for c in ("child_id", "parent_id")]
        nodes, parents = numbered(tables, ids[0].unionByName(ids[1]).where("commit_id is not null"), edges)
        trees = forest(tables, nodes, parents)
        wanted = tables.put(same_group(commits.select("project", "commit_id").distinct(), nodes, ["project", "commit_id"]).select("project", "commit_id", "node"))
        start = wanted.join(trees, "node").select(F.col("node").alias("source"), "chain", "at")
        found = reach(tables, None, start, tables.put(hops(trees, parents)))
        rows = found.join(trees.select("node", "chain", F.col("at").alias("_at")), "chain").where("_at <= at and source <> node").select("source", "node")
        rows = rows.join(nodes.select("node", F.col("commit_id").alias("ancestor")), "node").select(F.col("source").alias("node"), "ancestor")
        return tables.keep(tables.put(wanted.join(rows, "node").select("project", "commit_id", "ancestor")))


def paths_of(trees: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, chain, upto): all that comes before a commit on the way to its root, as beginnings of chains."""
    own = trees.where("at > 0").select("node", "chain", (F.col("at") - 1).alias("upto"))
    above = trees.select("node", "chain").join(lines, "chain").select("node", F.col("above").alias("chain"), "upto")
    return own.unionByName(above)


def merged_in(tables: Tables, trees: DataFrame, lines: DataFrame, parents: DataFrame) -> DataFrame:
    """(chain, at, from_chain, low, high): at its place a merge brings in the
    commits of ``from_chain`` after ``low`` up to ``high``, none of which its first parent has.

    A commit comes to a chain once: the way from any commit to its root meets
    each of its ancestors on the way itself or at one merge."""
    merges = parents.where("not first").select("node").distinct().join(trees.select("node", "chain", "at"), "node")
    sides = parents.where("not first").join(trees.select(F.col("node").alias("parent"), "chain", "at"), "parent")
    start = sides.select(F.col("node").alias("source"), "chain", "at")
    floor = tables.put(paths_of(trees.join(merges.select("node"), "node", "left_semi"), lines).select(F.col("node").alias("source"), "chain", F.col("upto").alias("at")))
    # the floor is read again below, so reach works on a copy
    found = reach(tables, floor.select("*"), start, tables.put(hops(trees, parents)))
    beyond = found.withColumnRenamed("at", "high").join(floor.withColumnRenamed("at", "low"), ["source", "chain"], "left")
    beyond = beyond.withColumn("low", F.coalesce("low", F.lit(-1).cast("long"))).where("high > low")
    place = merges.select(F.col("node").alias("source"), F.col("chain").alias("by"), F.col("at").alias("place"))
    rows = tables.put(beyond.join(place, "source"))
    # what earlier merges on the way have brought in: the most of the same chain before this place
    ask = rows.select("source", "chain", "by", (F.col("place") - 1).alias("place")).unionByName(rows.join(lines.withColumnRenamed("chain", "by"), "by").select("source", "chain", F.col("above").alias("by"), F.col("upto").alias("place")))
    ask = tables.put(ask)
    before = latest(rows.select("by", "chain", "place", F.col("high").alias("value")), ask, ["by", "chain"], "place")
    before = before.groupBy("source", "chain").agg(F.max("value").alias("_had"))
    rows = rows.join(before, ["source", "chain"], "left").withColumn("low", F.greatest("low", F.col("_had"))).where("high > low")
    return tables.put(rows.select(F.col("by").alias("chain"), F.col("place").alias("at"), F.col("chain").alias("from_chain"), "low", "high"))


def latest(data: DataFrame, ask: DataFrame, by: list[str], place: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``ask`` with what ``data`` has for the same ``by`` up to its ``place``,
    that place too: the largest ``value``, or the sums of ``sums``.  Both tables are
    gone through once, side by side, and a busy group in slices."""
    asking = [c for c in ask.columns if c not in (*by, place)]
    given = {c: t for c, t in data.dtypes if c not in (*by, place)}
    kinds = dict(ask.dtypes)
    one = data.select(*by, place, *given, *[F.lit(None).cast(kinds[c]).alias(c) for c in asking], F.lit(0).alias("_ask"))
    two = ask.select(*by, place, *[F.lit(None).cast(t).alias(c) for c, t in given.items()], *asking, F.lit(1).alias("_ask"))
    most = {} if sums else {"_value": F.col("value")}
    out = running(one.unionByName(two), by, F.col(place), [F.col("_ask")], {f"_{n}": F.coalesce(c, F.lit(0)) for n, c in (sums or {}).items()}, most=most, spread=F.col("_ask"))
    names = list(sums or {"value": 0})
    return out.where("_ask = 1").select(*by, place, *asking, *[F.col(f"_{n}").alias(n) for n in names])
