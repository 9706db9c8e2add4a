"""Per-commit change metrics: spread, size, history and author experience."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.c_code import is_c_file, metrics
from ferrule.functions.paths import directory_of, subsystem_of
from ferrule.operators.graph import ancestors  # noqa: F401  (these two are among a commit's changes, too)
from ferrule.operators.history import history  # noqa: F401
from ferrule.operators.running import running, same_group
from ferrule.operators.shared import Tables, kept

KEY = ["project", "commit_id"]


def commit_edges(commits: DataFrame) -> DataFrame:
    """(project, parent_id, child_id, parent_no) of commits with ``parents`` arrays; the first parent has number 0."""
    return commits.select("project", F.posexplode("parents").alias("parent_no", "parent_id"), F.col("commit_id").alias("child_id")).select("project", "parent_id", "child_id", "parent_no")


def roots(commits: DataFrame) -> DataFrame:
    return commits.where(F.size(F.coalesce("parents", F.array())) == 0)


def son_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project", "parent_id").agg(F.count("*").alias("sons"))


def dedupe_identical(commits: DataFrame) -> DataFrame:
    """Of commits with the same committer and second, the first in the log."""
    keys = ["project", "committer_email", "time_stamp"]
    first = commits.groupBy(*keys).agg(F.min("pos").alias("pos"))
    return same_group(commits, first, [*keys, "pos"], "left_semi")


def file_changes(numstat: DataFrame, namestat: DataFrame) -> DataFrame:
    """Numbers and kinds of the changes matched by path; those without a kind are left out.

    Both are dealt by commit, in one exchange, so what a commit's rows have in common is next to each other there."""
    key = [*KEY, "base_commit", "modified_path"]
    kind = F.struct("change_type").alias("_kind")
    numbers = numstat.withColumn("_kind", F.lit(None).cast(namestat.select(kind).schema["_kind"].dataType))
    kinds = namestat.select(*[F.col(c) if c in key else F.lit(None).cast(t).alias(c) for c, t in numstat.dtypes], kind)
    # a missing key is a key like any other
    both = numbers.unionByName(kinds).repartition(*KEY).withColumn("_kinds", F.collect_list("_kind").over(Window.partitionBy(*key)))
    return both.where("_kind is null").select(*numstat.columns, F.explode("_kinds").alias("_kind")).select(*numstat.columns, "_kind.change_type")


def diffusion(changes: DataFrame) -> DataFrame:
    """ns, nd, nf, entropy, la, ld by commit of changes (path, added, deleted, in_scope; new_path where renamed).

    Entropy: of in-scope churn shares, over |log2| of the smallest share unless that is 0."""
    if "new_path" not in changes.columns:
        changes = changes.withColumn("new_path", F.lit(None).cast("string"))
    n, ok = F.col("added") + F.col("deleted"), F.col("in_scope")
    counted = F.when(ok & (n > 0), n)
    of = lambda f, c: F.collect_set(F.when(F.col(c).isNotNull(), f(F.col(c))))
    both = lambda f: F.size(F.array_union(of(f, "path"), of(f, "new_path"))).cast("long")
    rows = changes.groupBy(*KEY).agg(
        both(subsystem_of).alias("ns"), both(directory_of).alias("nd"), F.count_distinct(F.when(ok, F.struct("path", "added", "deleted"))).alias("nf"),
        *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long").alias(o) for c, o in (("added", "la"), ("deleted", "ld"))],
        F.sum(counted).alias("_all"), F.sum(counted * F.log2(counted)).alias("_weighted"), F.min(counted).alias("_least"),
    )
    # with p = n / all: -sum p log2 p = log2 all - sum n log2 n / all, and -log2 min p = log2 all - log2 min n
    spread = F.greatest(F.log2("_all") - F.col("_weighted") / F.col("_all"), F.lit(0.0))
    entropy = F.when(F.col("_least") < F.col("_all"), spread / (F.log2("_all") - F.log2("_least"))).otherwise(0.0)
    return rows.select(*KEY, "ns", "nd", "nf", "la", "ld", entropy.alias("entropy"))


def experience(commits: DataFrame) -> DataFrame:
    """exp: the author's earlier commits, in order of time_stamp, then pos."""
    out = running(commits, ["project", "author"], F.col("time_stamp"), [F.col("pos")], {}, spread=F.col("pos"))
    return out.select(*KEY, (F.col("rank") - 1).alias("exp"))


def recent_experience(commits: DataFrame, block: int = 512, year: float = 86400 * 365.0) -> DataFrame:
    """rexp: sum over the author's earlier commits of 1 / (years since + 1).

    An author's commits are cut into blocks of ``block``.  Within a block sums are
    exact.  For all that stands before it, 1 / (1 + x) is the sum of 96 exponentials
    (the integral of exp(u - (1 + x) e^u) in steps of 0.4), off by less than 1e-9 of
    itself for up to 1000 years; and a sum of exponentials is carried from block to block.
    So a commit costs ``block`` and the terms, however many its author has, and
    only a row for each block goes along an author's history.
    A null project or author is one like any other."""
    keys, kind = ["project", "author"], dict(commits.dtypes)
    placed = running(commits, keys, F.col("time_stamp"), [F.col("pos")], {}, spread=F.col("pos")).withColumn("b", F.floor((F.col("rank") - 1) / block).cast("long"))
    rows = placed.groupBy(*keys, "b").agg(F.array_sort(F.collect_list(F.struct("rank", "time_stamp", "commit_id"))).alias("r"))
    types = ", ".join(f"{k} {kind[k]}" for k in keys)

    def terms():
        import numpy as np

        u = np.arange(-86, 10) * 0.4
        return np.exp(u) / year, 0.4 * np.exp(u - np.exp(u))

    def of_block(frames):
        import numpy as np

        rate, _ = terms()
        for f in frames:
            sums = [np.exp(-(t[-1] - np.asarray(t, float))[:, None] * rate).sum(0).tolist() for t in f["t"]]
            yield f[[*keys, "b"]].assign(end=[float(t[-1]) for t in f["t"]], s=sums)

    def along(frames):
        import numpy as np

        rate, _ = terms()
        who, now, last = (), None, 0.0
        for f in frames:
            out = []
            for *key, b, end, s in f[[*keys, "b", "end", "s"]].itertuples(index=False, name=None):
                if who != tuple(key) or b == 0:
                    who, now, last = tuple(key), np.zeros(len(rate)), end
                out.append((last, now.tolist()))
                now, last = now * np.exp(-(end - last) * rate) + np.asarray(s), end
            yield f[[*keys, "b"]].assign(last=[x[0] for x in out], a=[x[1] for x in out])

    def sums(frames):
        import numpy as np
        import pandas as pd

        rate, weight = terms()
        for f in frames:
            out = []
            for project, times, ids, b, last, a in f[["project", "t", "ids", "b", "last", "a"]].itertuples(index=False, name=None):
                t = np.asarray(times, float)
                near = np.tril(1 / ((t[:, None] - t[None, :]) / year + 1), -1).sum(1)
                far = np.exp(-(t - last)[:, None] * rate) @ (weight * np.asarray(a)) if b else 0.0
                out.append(pd.DataFrame({"project": [project] * len(t), "commit_id": list(ids), "rexp": near + far}))
            yield pd.concat(out) if out else pd.DataFrame({"project": [], "commit_id": [], "rexp": []})

    with Tables(commits.sparkSession) as tables:
        blocks = tables.put(rows.select(*keys, "b", F.col("r.time_stamp").alias("t"), F.col("r.commit_id").alias("ids")))
        ends = blocks.select(*keys, "b", "t").mapInPandas(of_block, f"{types}, b long, end double, s array<double>")
        carried = ends.repartition(*keys).sortWithinPartitions(*keys, "b").mapInPandas(along, f"{types}, b long, last double, a array<double>")
        parts = same_group(blocks, carried, [*keys, "b"]).select("project", "t", "ids", "b", "last", "a")
        return tables.keep(tables.put(parts.mapInPandas(sums, f"project {kind['project']}, commit_id {kind['commit_id']}, rexp double")))


def subsystem_experience(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """sexp: over the commit's subsystems (``touched``), the mean of the author's earlier commits there; 0 without files."""
    rows = same_group(touched.select(*KEY, "subsystem").distinct(), commits.select(*KEY, "author", "time_stamp", "pos"), KEY)
    ranked = running(rows, ["project", "author", "subsystem"], F.col("time_stamp"), [F.col("pos")], {}, spread=F.col("pos"))
    mean = ranked.groupBy(*KEY).agg(F.avg(F.col("rank") - 1).alias("sexp"))
    return same_group(commits.select(*KEY), mean, KEY, "left").withColumn("sexp", F.coalesce("sexp", F.lit(0.0)))


def c_features(hunks: DataFrame, body_only: bool = False) -> DataFrame:
    """Nine C counts by commit of hunks (path, body): sums, and the deepest pointer; 0 where no C file changed.

    ``body`` is a hunk as a diff has it.  Signs and removed lines are counted as
    they stand there; with ``body_only`` the header, the signs and the removed
    lines are left out first."""
    body = F.col("body")
    if body_only:
        body = F.array_join(F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith("+") | x.startswith(" ")), lambda x: F.substr(x, F.lit(2))), "\n")
    rows = hunks.where(is_c_file(F.col("path"))).select(*KEY, body.alias("body")).select(*KEY, *[c.alias(n) for n, c in metrics(F.col("body")).items()])
    names = list(metrics(F.lit("")))
    sums = rows.groupBy(*KEY).agg(*[(F.max if n == "maxpointerdepth" else F.sum)(n).alias(n) for n in names])
    return same_group(hunks.select(*KEY).distinct(), sums, KEY, "left").na.fill(0, names)


def combine_features(meta: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row per commit: ``meta`` left-joined by each part on (project, commit_id)."""
    for p in parts:
        meta = same_group(meta, p, KEY, "left")
    return meta


def combine_values_annotations(meta: DataFrame, purpose: DataFrame, history: DataFrame, experience: DataFrame, size: DataFrame, diffusion: DataFrame) -> DataFrame:
    """The values of each commit that has a history, and what its log says of it, newest first."""
    values = combine_features(history, experience, size, diffusion)
    return order_report(same_group(values, combine_features(meta, purpose), KEY))


def to_report_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lists and maps as JSON text, the form in which a report keeps them."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def from_report_json(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """JSON text of a report as values of the given types ('map<string,array<int>>'); text that is none gives null."""
    return df.withColumns({c: F.from_json(c, t) for c, t in kinds.items()})


def project_shape(df: DataFrame) -> DataFrame:
    """Rows of each project's table, and its number of columns."""
    return df.groupBy("project").agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def export_code_repo(commits: DataFrame, numbers: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of one text column ``value``, fields joined by ';': commits
    (id, parents, sons, project, email, time, message on one line) and their
    files (path, commit, parent, status letter, added, deleted, old path)."""
    edges = commit_edges(commits).select("project", F.col("parent_id").alias("commit_id"), F.col("child_id").alias("_son"))
    own = F.struct(*[c for c in commits.columns if c not in KEY]).alias("_own")
    one = commits.select(*KEY, own, F.lit(None).cast(edges.schema["_son"].dataType).alias("_son"))
    # commits and edges meet in one exchange
    both = one.unionByName(edges.withColumn("_own", F.lit(None).cast(one.schema["_own"].dataType))).withColumn("_sons", F.collect_list("_son").over(Window.partitionBy(*KEY)))
    rows = both.where("_own is not null").select(*KEY, "_own.*", F.array_sort("_sons").alias("sons"))
    listed = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    text = lambda *cs: F.concat_ws(";", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]).alias("value")
    head = rows.select(text(F.col("commit_id"), listed("parents"), listed("sons"), F.col("project"), F.col("author_email"), F.col("time_stamp"), F.regexp_replace("message", r"\s+", " ")))
    # written first, so that what is shuffled for it is gone before the files; hashes are half as long in zstd
    head = kept(head, "zstd")
    letter = F.upper(F.substring("change_type", 1, 1))
    new, old = F.coalesce("current_path", "modified_path"), F.when(F.col("current_path").isNotNull(), F.col("modified_path"))
    files = file_changes(numbers, kinds).select(text(new, F.col("commit_id"), F.col("base_commit"), letter, F.col("added"), F.col("deleted"), old))
    return head, files


def file_level_features(files: DataFrame, commits: DataFrame, buggy: DataFrame) -> DataFrame:
    """One row per commit and file: the file's own columns, the commit's, and whether ``buggy`` (project, commit_id, path) has it."""
    marked = buggy.select(*KEY, "path").distinct().withColumn("contains_bug", F.lit(True))
    rows = same_group(same_group(files, commits, KEY), marked, [*KEY, "path"], "left")
    return rows.withColumn("contains_bug", F.coalesce("contains_bug", F.lit(False)))


def merge_c_features(common: DataFrame, c: DataFrame) -> DataFrame:
    return same_group(common, c, KEY, "left").na.fill(0, [x for x in c.columns if x not in KEY])


def complete_until_last_fix(features: DataFrame, required: list[str]) -> DataFrame:
    """Commits with all of ``required``, up to the project's last fix in log order (all, if it has none)."""
    last = features.groupBy("project").agg(F.max(F.when(F.col("is_fix"), F.col("pos"))).alias("_last"))
    rows = same_group(features, last, ["project"]).where(F.col("_last").isNull() | (F.col("pos") <= F.col("_last")))
    return rows.dropna(subset=required).drop("_last")


def changed_files(changes: DataFrame, limit: int = 50, delimiter: str = ";", commits: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` paths of each commit; ranks come before collecting, so no list exceeds it.

    With ``commits``, each of them gives a row, '' where it has no changes."""
    w = Window.partitionBy(*KEY).orderBy(F.col("path").asc_nulls_last())
    rows = changes.select(*KEY, "path")
    if commits is not None:
        # a null path, which is ranked last and not collected, stands for the commit itself
        rows = rows.unionByName(commits.select(*KEY, F.lit(None).cast("string").alias("path")))
    top = rows.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return top.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("path")), delimiter).alias("files"))


def order_report(df: DataFrame, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc("time_stamp"), F.desc("commit_id"))
    return out.limit(limit) if limit else out


def file_lineage(touches: DataFrame) -> DataFrame:
    """``touches`` (project, commit_id, time_stamp, pos, path, new_path,
    change_type) with ``lineage``: one name for a file through all its renames.

    A path's time is cut where a file starts there (add, or rename to it) and
    after one ends (delete, or rename away).  A rename ties the old path's
    stretch to the new one's, so stretches are chains, and a file is named by
    its chain's first: (path, number of the stretch).  Chains are followed by
    doubling, in a number of rounds logarithmic in the longest; renames alone
    take part in that."""
    renamed = F.col("change_type") == "rename"
    columns = [*KEY, "time_stamp", "pos", "path", "new_path", "change_type"]
    own = touches.select(*columns, F.col("path").alias("at"), F.lit(0).alias("into"), (F.col("change_type") == "add").cast("int").alias("starts"), (renamed | (F.col("change_type") == "delete")).cast("int").alias("ends"))
    moved = touches.where(renamed).select(*columns, F.col("new_path").alias("at"), F.lit(1).alias("into"), F.lit(1).alias("starts"), F.lit(0).alias("ends"))
    # a busy path is numbered in slices; what ends at a touch counts for the next one
    order = [F.col("pos"), F.col("into")]
    sums = {"_begun": F.col("starts") + F.col("ends")}
    with Tables(touches.sparkSession) as tables:
        when = F.col("time_stamp")
        if dict(touches.dtypes)["time_stamp"] in ("date", "timestamp", "timestamp_ntz"):
            when = F.unix_micros(when.cast("timestamp"))
        numbered = running(own.unionByName(moved), ["project", "at"], when, order, sums, spread=F.col("pos"))
        stretch = F.col("_begun") - F.col("ends")
        placed = tables.put(numbered.withColumn("name", F.concat_ws("#", "at", stretch.cast("string"))).drop("rank", "_begun"))
        key = [*KEY, "pos", "path", "new_path"]
        old = placed.where("into = 0 and change_type = 'rename'").select(*key, F.col("name").alias("root"))
        links = tables.put(same_group(placed.where("into = 1").select(*key, "name"), old, key).select("project", "name", "root"))
        while True:
            up = links.select("project", F.col("name").alias("root"), F.col("root").alias("further"))
            joined = same_group(links, up, ["project", "root"], "left")
            if joined.where("further is not null").isEmpty():
                break
            links = tables.put(joined.select("project", "name", F.coalesce("further", "root").alias("root")), links)
        out = same_group(placed.where("into = 0"), links, ["project", "name"], "left")
        return tables.keep(tables.put(out.select(*columns, F.coalesce("root", "name").alias("lineage"))))
