"""What a commit's files have gone through before it: developers, changes, age and lines.

A touch of a file stands at a place of a chain (``graph``); an unbranched history
is one chain.  What comes before a commit is the beginnings of a few chains.  Most
files have few touches on a chain, so each touch lists those before it; of commits
with a file of more, running totals along each chain answer.  Under
``parents="all"`` a merge puts the touches that it brings in at its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.graph import forest, latest, lines_above, merged_in, numbered, paths_of
from ferrule.operators.running import running, same_group
from ferrule.operators.shared import Tables

KEY = ["project", "commit_id"]
#: Places of a chain that one key of a join stands for.
STEP = 1024
#: Files of a commit whose earlier changes are gathered in one row.
MANY = 1024


def history(touches: DataFrame, commits: DataFrame | None = None, edges: DataFrame | None = None, parents: str = "line", hot: int = 256) -> DataFrame:
    """ndev, nuc, age, lt by commit from ``touches`` (project, commit_id, lineage,
    author, time_stamp, pos, added, deleted).

    ndev: developers who touched any of the commit's files before; nuc: distinct
    earlier changes (author, time) of its files over their number; age: mean days
    since a file's latest touch; lt: mean lines of its files before.

    Before means, for ``parents``,
    "line": earlier in time, then pos; the history counts as unbranched;
    "first": on the way from the commit over first parents to its root;
    "all": among the commit's ancestors by any parents; lines, which a merge does
    not add up, still follow first parents.
    The latter two need ``commits`` (project, commit_id) and ``edges``
    (project, parent_id, child_id, parent_no); commits that these lack are left out.

    A file is hot for a commit if it has more than ``hot`` touches on the chains that
    lie before.  Commits without a hot file gather, for each file, the changes
    before: at most ``hot``.  Of the others (and those of very many files) one of one
    file takes its file's running number of changes; of one with
    several files, the hot ones are counted together, once
    for each such set of files, and only the others' changes are listed for each
    commit, so a file that very many commits of
    several files touch is no square of them.  The result does not depend on
    ``hot``.  Rows that repeat a commit and file are one touch; a null project, file or author is
    one like any other.
    """
    if parents not in ("line", "first", "all"):
        raise ValueError(f"parents: {parents}")
    with Tables(touches.sparkSession) as tables:
        one = touches.groupBy(*KEY, "lineage").agg(F.min(F.struct("time_stamp", "pos", "author")).alias("t"), F.sum(F.col("added") - F.col("deleted")).alias("net"))
        one = tables.put(one.select(*KEY, "lineage", "t.author", "t.time_stamp", "t.pos", "net"))
        lines = arrive = None
        if parents == "line":
            places = _in_line(tables, one)
        else:
            nodes, links = numbered(tables, commits, edges)
            trees = forest(tables, nodes, links)
            lines = lines_above(tables, trees)
            arrive = merged_in(tables, trees, lines, links) if parents == "all" else None
            # where every tree is one chain, nothing is above, and such a merge brings in nothing
            arrive = None if arrive is None or arrive.isEmpty() else arrive
            lines = None if lines.isEmpty() else lines.withColumn("upto", F.col("upto") * 2 + 1)
            places = tables.put(nodes.join(trees.select("node", "chain", "at"), "node"))
        named = _named(tables, one, places)
        # a commit's own touches are at odd places, right after what it brings in as a merge
        placed = same_group(one, named, [*KEY, "author", "time_stamp"]).withColumns({"at": F.col("at") * 2 + 1, "time": F.col("time_stamp").cast("double")})
        placed = tables.put(placed.select("project", "lineage", "node", "chain", "at", "change", "dev", "time", "net"), one)
        names = named.select("node", *KEY).distinct()
        key = ["project", "lineage", "chain"]
        of_more = lambda by, n: tables.put(placed.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > n).select(*by))
        large = of_more(["node"], MANY)
        if lines is None and arrive is None and large.isEmpty() and of_more(key, hot).isEmpty():
            out = tables.put(_by_commit(_before(placed, key)), placed)
        else:
            out = tables.put(_over_chains(tables, placed, large, lines, arrive, hot))
        zero = F.lit(0).cast("long")
        out = out.select("node", F.coalesce("ndev", zero).alias("ndev"), (F.coalesce("uses", zero) / F.col("nf")).alias("nuc"), (F.coalesce("days", F.lit(0.0)) / F.col("nf")).alias("age"), (F.coalesce("lines", zero) / F.col("nf")).alias("lt"))
        return tables.keep(tables.put(names.join(out, "node").drop("node")))


def _named(tables: Tables, one: DataFrame, places: DataFrame) -> DataFrame:
    """(project, commit_id, author, time_stamp, node, chain, at, change, dev) of
    commits that have a place: the last two are numbers for each (author, time) and author, null ones too."""
    who = tables.put(one.select(*KEY, "author", "time_stamp").distinct())
    number = lambda c, *by: tables.put(who.select(*by).distinct().withColumn(c, F.monotonically_increasing_id()))
    rows = same_group(who, number("change", "author", "time_stamp"), ["author", "time_stamp"])
    rows = same_group(rows, number("dev", "author"), ["author"])
    return tables.put(same_group(rows, places, KEY), who)


def _before(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each touch what lies before it on its chain, all of the same ``key``, which has few: changes, devs, last, lines."""
    w = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", F.collect_list("change").over(w).alias("changes"), F.collect_set("dev").over(w).alias("devs"), F.max("time").over(w).alias("last"), F.sum("net").over(w).alias("lines"))


def _by_commit(rows: DataFrame) -> DataFrame:
    """(node, nf, ndev, uses, days, lines) of a row for each of a commit's files (node, time, changes, devs, last, lines)."""
    days = F.sum((F.col("time") - F.col("last")) / 86400.0).alias("days")
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("changes", "devs")]
    # dealt once; lists are not gathered before that
    out = rows.select("node", "time", "changes", "devs", "last", "lines").repartition("node").groupBy("node").agg(F.count("*").alias("nf"), F.sum("lines").alias("lines"), days, *lists)
    number = lambda c: F.size(F.array_distinct(c)).cast("long")
    return out.select("node", "nf", number("devs").alias("ndev"), number("changes").alias("uses"), "days", "lines")


def _over_chains(tables: Tables, placed: DataFrame, large: DataFrame, lines: DataFrame | None, arrive: DataFrame | None, hot: int) -> DataFrame:
    """(node, nf, ndev, uses, days, lines) where chains have others above them, merges bring something in, files are hot, or commits are ``large``."""
    # a number for each (project, file), so that what follows joins by it
    files = tables.put(placed.select("project", "lineage").distinct().withColumn("file", F.monotonically_increasing_id()))
    own = tables.put(same_group(placed, files, ["project", "lineage"]).select("node", "file", "chain", "at", "change", "dev", "time", "net"), placed)
    asked = tables.put(_asked(own, lines))
    all_ = own
    if arrive is not None:
        all_ = tables.put(own.unionByName(_arrived(own, asked, arrive)))
    # of what lies before a commit, only chains on which the file was touched
    there = tables.put(all_.groupBy("file", "chain").agg(F.count("*").alias("_n")))
    sizes = there
    if lines is not None:
        asked = tables.put(asked.join(there.select("file", "chain"), ["file", "chain"], "left_semi"), asked)
        above = own.select("file", "chain").distinct().join(lines.select("chain", "above"), "chain").join(there.withColumnsRenamed({"chain": "above"}), ["file", "above"])
        sizes = there.unionByName(above.select("file", "chain", "_n")).groupBy("file", "chain").agg(F.sum("_n").alias("_n"))
    heavy = tables.put(sizes.where(F.col("_n") > hot).select("file", "chain"))
    busy = tables.put(own.join(heavy, ["file", "chain"], "left_semi").select("node").unionByName(large).distinct())
    plain = own.join(busy, "node", "left_anti")
    few = all_.join(there.where(F.col("_n") <= hot), ["file", "chain"], "left_semi")
    rows = _before(few, ["file", "chain"]).where("node is not null").join(busy, "node", "left_anti").select("node", "file", "time", "changes", "devs", "last", "lines")
    if lines is not None:
        entry = F.struct("at", "change", "dev", "time", "net")
        lists = few.join(lines.select(F.col("above").alias("chain")).distinct(), "chain", "left_semi").groupBy("file", "chain").agg(F.collect_list(entry).alias("_all"))
        ask = asked.join(plain.select("node", "file", F.col("chain").alias("_own")), ["node", "file"]).where("chain <> _own").join(lists, ["file", "chain"])
        seen = F.filter("_all", lambda x: x["at"] <= F.col("at"))
        far = ask.select("node", "file", F.lit(None).cast("double").alias("time"), seen.alias("_seen"))
        part = lambda n: F.transform("_seen", lambda x: x[n])
        kind = dict(few.dtypes)["net"]
        total = F.aggregate(part("net"), F.lit(0).cast(kind), lambda s, x: (s + F.coalesce(x, F.lit(0).cast(kind))).cast(kind))
        rows = rows.unionByName(far.select("node", "file", "time", part("change").alias("changes"), F.array_distinct(part("dev")).alias("devs"), F.array_max(part("time")).alias("last"), total.alias("lines")))
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("changes", "devs")]
        rows = rows.repartition("node").groupBy("node", "file").agg(F.max("time").alias("time"), F.max("last").alias("last"), F.sum("lines").alias("lines"), *lists)
    out = tables.put(_by_commit(rows))
    if busy.isEmpty():
        return out
    own = tables.put(own.join(busy, "node", "left_semi").join(heavy.withColumn("heavy", F.lit(True)), ["file", "chain"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))))
    asked = tables.put(asked.join(busy, "node", "left_semi"), asked)
    all_ = tables.put(all_.join(asked.select("file", "chain").distinct(), ["file", "chain"], "left_semi"))
    more = own.groupBy("node").agg(F.count("*").alias("nf"))
    # one by one, so that what is shuffled for a part is gone before the next
    for part in (lambda: _lines_before(all_, asked), lambda: _age(all_, asked, own), lambda: _developers(all_, asked, lines), lambda: _changes(tables, own, all_, asked, lines)):
        more = more.join(tables.put(part()), "node", "left")
    return out.unionByName(more.select(*out.columns))


def _in_line(tables: Tables, one: DataFrame) -> DataFrame:
    """Commits with a number and their place in the project's only chain."""
    commits = tables.put(one.groupBy(*KEY).agg(F.min(F.struct("time_stamp", "pos")).alias("t")).select(*KEY, "t.time_stamp", "t.pos"))
    order = running(commits, ["project"], F.col("time_stamp"), [F.col("pos"), F.col("commit_id")], {}, spread=F.col("pos"))
    return tables.put(order.select(*KEY, F.lit(0).cast("long").alias("chain"), F.col("rank").alias("at"), F.monotonically_increasing_id().alias("node")), commits)


def _asked(own: DataFrame, lines: DataFrame | None) -> DataFrame:
    """(node, file, chain, at): up to which places a commit's file is looked for."""
    before = own.select("node", "file", "chain", (F.col("at") - 1).alias("at"))
    if lines is None:
        return before
    above = own.select("node", "file", "chain").join(lines, "chain").select("node", "file", F.col("above").alias("chain"), F.col("upto").alias("at"))
    return before.unionByName(above)


def _arrived(own: DataFrame, asked: DataFrame, arrive: DataFrame) -> DataFrame:
    """Touches at the places of the merges that bring them in, where someone asks for them."""
    cut = lambda c: F.floor(F.col(c) / STEP)
    ranges = arrive.select("from_chain", (F.col("low") * 2 + 1).alias("low"), (F.col("high") * 2 + 1).alias("high"), F.col("chain").alias("_by"), (F.col("at") * 2).alias("_place"))
    ranges = ranges.withColumn("_step", F.explode(F.sequence(F.floor((F.col("low") + 1) / STEP), cut("high"))))
    rows = own.withColumn("_step", cut("at")).join(ranges.withColumnRenamed("from_chain", "chain"), ["chain", "_step"]).where("at > low and at <= high")
    # its lines are not added up, and it is no touch of the commit that merges
    rows = rows.select(F.lit(None).cast("long").alias("node"), "file", F.col("_by").alias("chain"), F.col("_place").alias("at"), "change", "dev", "time", F.lit(0).cast("long").alias("net"))
    return rows.join(asked.select("file", "chain").distinct(), ["file", "chain"], "left_semi")


def _first_on_the_way(rows: DataFrame, by: list[str], lines: DataFrame | None) -> DataFrame:
    """(by, chain, at) of those of ``rows`` that nothing of the same ``by`` comes before on the way to the root."""
    first = rows.groupBy(*by, "chain").agg(F.min("at").alias("at"))
    if lines is None:
        return first
    # only what is on several chains can be on one above
    again = first.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    many = same_group(first, again, by)
    above = many.join(lines, "chain").select(*by, F.col("chain").alias("_own"), F.col("above").alias("chain"), "upto")
    late = same_group(above, many, [*by, "chain"]).where("at <= upto").select(*by, F.col("_own").alias("chain")).distinct()
    return same_group(first, late, [*by, "chain"], "left_anti")


def _lines_before(all_: DataFrame, asked: DataFrame) -> DataFrame:
    found = latest(all_.select("file", "chain", "at", "net"), asked, ["file", "chain"], "at", {"lines": F.col("net")})
    return found.groupBy("node").agg(F.sum("lines").alias("lines"))


def _age(all_: DataFrame, asked: DataFrame, own: DataFrame) -> DataFrame:
    found = latest(all_.select("file", "chain", "at", F.col("time").alias("value")), asked, ["file", "chain"], "at")
    last = found.groupBy("node", "file").agg(F.max("value").alias("value"))
    rows = own.select("node", "file", F.col("time").alias("_t")).join(last, ["node", "file"])
    return rows.groupBy("node").agg(F.sum((F.col("_t") - F.col("value")) / 86400.0).alias("days"))


def _developers(all_: DataFrame, asked: DataFrame, lines: DataFrame | None) -> DataFrame:
    first = _first_on_the_way(all_.select("file", "dev", "chain", "at"), ["file", "dev"], lines)
    rows = asked.withColumnRenamed("at", "_upto").join(first, ["file", "chain"]).where("at <= _upto")
    return rows.groupBy("node").agg(F.count_distinct("dev").alias("ndev"))


def _changes(tables: Tables, own: DataFrame, all_: DataFrame, asked: DataFrame, lines: DataFrame | None) -> DataFrame:
    """(node, uses): the distinct earlier changes of all of a commit's files."""
    # a commit's hot files, or its only one, are a set that is counted along the chains
    sets = own.groupBy("node").agg(F.array_sort(F.collect_list(F.when(F.col("heavy"), F.col("file")))).alias("_hot"), F.min("file").alias("_one"), F.count("*").alias("_n"))
    sets = sets.select("node", F.when(F.col("_n") == 1, F.array("_one")).otherwise(F.col("_hot")).alias("files"), "_n").where("size(files) > 0")
    name = F.when(F.size("files") == 1, F.col("files")[0].cast("string")).otherwise(F.sha2(F.array_join(F.transform("files", lambda f: f.cast("string")), ","), 256))
    sets = tables.put(sets.select("node", name.alias("set"), "files", "_n"))
    # a set's files, on the chains where one of its commits looks for them
    members = sets.select("node", "set", F.explode("files").alias("file")).join(asked, ["node", "file"]).select("set", "file", "chain").distinct()
    events = all_.join(members, ["file", "chain"]).select("set", "change", "chain", "at")
    first = tables.put(_first_on_the_way(events, ["set", "change"], lines))
    way = asked.select("node", "chain", "at").distinct()
    ask = tables.put(way.join(sets.select("node", "set"), "node"))
    counted = latest(first.select("set", "chain", "at", F.lit(1).cast("long").alias("n")), ask, ["set", "chain"], "at", {"n": F.col("n")}).groupBy("node").agg(F.sum("n").alias("_together"))
    counted = tables.put(counted, ask)
    # the other files' changes, one by one, without those that the set has, too
    single = sets.where("_n = 1").select("node")
    cold = own.where("not heavy").select("node", "file").join(single, "node", "left_anti")
    cold = asked.join(cold, ["node", "file"]).withColumnRenamed("at", "_upto")
    listed = cold.join(all_.select("file", "chain", "at", "change"), ["file", "chain"]).where("at <= _upto").select("node", "change")
    # of most commits no file is hot, and theirs need no more than counting
    plain = listed.join(sets.select("node"), "node", "left_anti").groupBy("node").agg(F.size(F.collect_set("change")).cast("long").alias("_listed"))
    listed = tables.put(listed.join(sets.select("node", "set"), "node").distinct())
    theirs = listed.join(first, ["set", "change"]).join(way.withColumnRenamed("at", "_upto"), ["node", "chain"]).where("at <= _upto").select("node", "change").distinct()
    left = listed.join(theirs, ["node", "change"], "left_anti").groupBy("node").agg(F.count("*").alias("_listed"))
    left = tables.put(left, listed).unionByName(tables.put(plain))
    both = own.select("node").distinct().join(counted, "node", "left").join(left, "node", "left")
    return both.select("node", (F.coalesce("_together", F.lit(0)) + F.coalesce("_listed", F.lit(0))).alias("uses"))
