"""Dumps of text made of the test tables, and the readers applied to them, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.jobs.bindings import CH, C, TASK_ROWS, _changes, _commits, _dealt, _query, _rounded, _table
from ferrule.operators import changes, graph, warnings
from ferrule.operators.history import history
from ferrule.operators.shared import Tables, shared_folder, shuffle_files_go
from ferrule.sources import logs


def _hash(c: Column | str) -> Column:
    m = F.md5((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary"))
    return F.concat(m, F.substring(m, 1, 8))


def _h(x: str) -> str:
    return f"(md5(CAST({x} AS VARCHAR)) || left(md5(CAST({x} AS VARCHAR)), 8))"


def _dump(rows: DataFrame, value: Column, compression: str = "none") -> str:
    """The folder of text files that hold ``value`` of each row; its name is the project's."""
    folder = shared_folder(rows.sparkSession) + "/dump"
    # what was shuffled to get there is not needed again
    with shuffle_files_go(rows.sparkSession):
        rows.select(value.alias("value")).write.text(folder, compression=compression)
    return folder


def _lines(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


P = C + f""", p AS (SELECT c.*, o_orderstatus, lag(commit_id) OVER (PARTITION BY author ORDER BY time_stamp, pos) AS one, lag(commit_id, 2) OVER (PARTITION BY author ORDER BY time_stamp, pos) AS two FROM c JOIN orders ON o_orderkey = commit_id)"""


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's last order as parent, every third also with the one before that."""
    w = Window.partitionBy("author").orderBy("time_stamp", "pos")
    status = _table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), "o_orderstatus")
    return _commits(spark, d).join(status, "commit_id").withColumns({"one": F.lag("commit_id").over(w), "two": F.when(F.col("commit_id") % 3 == 0, F.lag("commit_id", 2).over(w))})


@_query(f"""WITH {P} SELECT {_h('commit_id')} AS commit_id, trim(coalesce({_h('one')}, '') || CASE WHEN commit_id % 3 = 0 AND two IS NOT NULL THEN ' ' || {_h('two')} ELSE '' END) AS parents, author || '@x.org' AS author_email, time_stamp,
 'status ' || o_orderstatus || chr(10) || 'of ' || project AS message, commit_id % 3 = 0 AND two IS NOT NULL AS is_merge FROM p""")
def read_commit_log(spark, d):
    rows = _parents(spark, d)
    both = F.concat_ws(" ", _hash("one"), _hash("two"))
    text = _lines("commit: ", _hash("commit_id"), "\nparent: ", both, "\nauthor: A", F.col("author"), "\nauthor email: ", F.col("author"), "@x.org\ntime stamp: ", F.col("time_stamp"), "\ncommitter: C\ncommitter email: c@x.org\nstatus ", F.col("o_orderstatus"), "\nof ", F.col("project"), "\n")
    log = logs.read_commit_log(spark, _dump(rows, text))
    return log.select("commit_id", F.array_join("parents", " ").alias("parents"), "author_email", "time_stamp", "message", "is_merge")


@_query(f"""WITH RECURSIVE {P}, e AS (SELECT commit_id, one AS parent FROM p WHERE one IS NOT NULL UNION SELECT commit_id, two FROM p WHERE two IS NOT NULL AND commit_id % 3 = 0),
r AS (SELECT commit_id, commit_id AS ancestor FROM p WHERE commit_id % 50 = 0 UNION SELECT r.commit_id, e.parent FROM r JOIN e ON e.commit_id = r.ancestor)
SELECT commit_id, ancestor FROM r WHERE ancestor <> commit_id""")
def ancestors(spark, d):
    rows = _parents(spark, d).select("commit_id", F.lit("all").alias("project"), F.array_compact(F.array("one", "two")).alias("parents"))
    with Tables(spark) as tables:
        rows = tables.put(rows)
        return graph.ancestors(changes.commit_edges(rows), rows.where("commit_id % 50 = 0")).select("commit_id", "ancestor")


# files by their brand, touched by one of seven authors; each customer's orders are a graph of their own
PAST = P + """, e AS MATERIALIZED (SELECT commit_id, one AS parent, true AS first FROM p WHERE one IS NOT NULL UNION ALL SELECT commit_id, two, false FROM p WHERE two IS NOT NULL AND commit_id % 3 = 0),
f AS MATERIALIZED (SELECT l_orderkey AS commit_id, p_brand AS file, CAST(sum(CAST(l_quantity AS BIGINT)) - sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS net FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS MATERIALIZED (SELECT f.*, commit_id % 7 AS author, time_stamp FROM f JOIN c USING (commit_id)),
tree AS (SELECT commit_id, parent FROM e WHERE first UNION SELECT tree.commit_id, e.parent FROM tree JOIN e ON e.commit_id = tree.parent AND e.first),
r AS (SELECT commit_id, parent FROM e WHERE FOLLOWED UNION SELECT r.commit_id, e.parent FROM r JOIN e ON e.commit_id = r.parent AND FOLLOWED),
d AS (SELECT x.commit_id, count(DISTINCT y.author) AS ndev, count(DISTINCT (y.author, y.time_stamp)) AS uses FROM t x JOIN r USING (commit_id) JOIN t y ON y.commit_id = r.parent AND y.file = x.file GROUP BY ALL),
a AS (SELECT x.commit_id, x.file, any_value(x.time_stamp) AS now, max(y.time_stamp) AS last FROM t x JOIN r USING (commit_id) JOIN t y ON y.commit_id = r.parent AND y.file = x.file GROUP BY ALL),
b AS (SELECT commit_id, sum((now - last) / 86400.0) AS days FROM a GROUP BY ALL),
l AS (SELECT x.commit_id, sum(y.net) AS lines FROM t x JOIN tree USING (commit_id) JOIN t y ON y.commit_id = tree.parent AND y.file = x.file GROUP BY ALL),
n AS (SELECT commit_id, count(*) AS nf FROM t GROUP BY ALL)
SELECT n.commit_id, coalesce(ndev, 0) AS ndev, round(coalesce(uses, 0) / nf, 6) AS nuc, round(coalesce(days, 0) / nf, 6) AS age, round(coalesce(lines, 0) / nf, 6) AS lt FROM n LEFT JOIN d USING (commit_id) LEFT JOIN b USING (commit_id) LEFT JOIN l USING (commit_id)"""


def _past(spark: SparkSession, d: str, parents: str) -> DataFrame:
    rows = _parents(spark, d).withColumns({"project": F.lit("all"), "parents": F.array_compact(F.array("one", "two"))})
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("lineage"))
    touched = _table(spark, d, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("commit_id"), "lineage").agg(F.sum(F.col("l_quantity").cast("long")).alias("added"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("deleted"))
    touched = touched.join(rows.select("project", "commit_id", "time_stamp", "pos"), "commit_id").withColumn("author", F.col("commit_id") % 7)
    out = history(touched, rows.select("project", "commit_id"), changes.commit_edges(rows), parents)
    return _rounded(out).select("commit_id", "ndev", "nuc", "age", "lt")


@_query("WITH RECURSIVE " + PAST.replace("FOLLOWED", "first"))
def history_first_parent(spark, d):
    return _past(spark, d, "first")


@_query("WITH RECURSIVE " + PAST.replace("FOLLOWED", "true"))
def history_all_parents(spark, d):
    return _past(spark, d, "all")


# -- change statistics ----------------------------------------------------------

# every third change is a rename within braces, every seventh a binary file
ST = CH + """, st AS (SELECT commit_id, path, replace(path, '/', '/new ') AS other, added, deleted, deleted % 3 = 0 AS ren, added % 7 = 0 AS bin FROM ch)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("commit_id", "path", F.replace("path", F.lit("/"), F.lit("/new ")).alias("other"), "added", "deleted", (F.col("deleted") % 3 == 0).alias("ren"), (F.col("added") % 7 == 0).alias("bin"))


def _blocks(rows: DataFrame, head: Column, line: Column, keys: list[str]) -> DataFrame:
    own = rows.withColumns({"_h": head, "_l": line}).groupBy(*keys, "_h").agg(F.array_join(F.array_sort(F.collect_list("_l")), "\n").alias("_b"))
    return own.select(*keys, F.concat("_h", F.lit("\n"), "_b", F.lit("\n")).alias("value"))


def _numbers_line() -> Column:
    n = lambda c: F.when(F.col("bin"), "-").otherwise(F.col(c).cast("string"))
    return _lines(n("added"), "\t", n("deleted"), "\t", F.when(F.col("ren"), F.concat(F.lit("{"), "path", F.lit(" => "), "other", F.lit("}"))).otherwise(F.col("path")))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return logs.read_numstat(spark, _dump(_blocks(_stats(spark, d), _lines("commit: ", _hash("commit_id")), _numbers_line(), ["commit_id"]), F.col("value"), "gzip"))


def _kinds_line() -> Column:
    letter = F.when(F.col("added") % 4 == 0, "A").when(F.col("added") % 4 == 1, "M").when(F.col("added") % 4 == 2, "D").otherwise("T")
    return F.when(F.col("ren"), F.concat(F.lit("R100\t"), "path", F.lit("\t"), "other")).otherwise(F.concat(letter, F.lit("\t"), "path"))


def _merges(spark: SparkSession, d: str, line: Column) -> str:
    """The folder of a dump with a block for each commit, and a second one, against another parent, after that of an even one."""
    own = _stats(spark, d).groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_b"))
    block = lambda b: _lines(_hash("commit_id"), " (from ", _hash(F.col("commit_id") + b), ") merge\n", F.col("_b"), "\n")
    return _dump(own, F.concat_ws("\n", block(1), F.when(F.col("commit_id") % 2 == 0, block(2))), "gzip")


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return logs.read_namestat(spark, _dump(_blocks(_stats(spark, d), _lines("commit: ", _hash("commit_id")), _kinds_line(), ["commit_id"]), F.col("value"), "gzip"))


NUMBERS = f"{_h('commit_id')} AS commit_id, path AS modified_path, CASE WHEN ren THEN other END AS current_path, CASE WHEN bin THEN 0 ELSE added END AS added, CASE WHEN bin THEN 0 ELSE deleted END AS deleted"
KIND = "CASE WHEN ren THEN 'rename' WHEN added % 4 = 0 THEN 'add' WHEN added % 4 = 2 THEN 'delete' ELSE 'modify' END AS change_type"


@_query(f"WITH {ST} SELECT {NUMBERS}, ren AS is_rename FROM st")
def read_numstat(spark, d):
    return _numbers(spark, d).select("commit_id", "modified_path", "current_path", "added", "deleted", "is_rename")


@_query(f"WITH {ST} SELECT {_h('commit_id')} AS commit_id, path AS modified_path, CASE WHEN ren THEN other END AS current_path, {KIND} FROM st")
def read_namestat(spark, d):
    return _kinds(spark, d).select("commit_id", "modified_path", "current_path", "change_type")


@_query(f"WITH {ST} SELECT {NUMBERS}, {KIND} FROM st")
def file_changes(spark, d):
    return changes.file_changes(_numbers(spark, d), _kinds(spark, d)).select("commit_id", "modified_path", "current_path", "added", "deleted", "change_type")


@_query(f"WITH {ST} SELECT {_h('commit_id')} AS commit_id, {_h('commit_id + b')} AS base_commit, path AS modified_path, CASE WHEN ren THEN other END AS current_path, CASE WHEN bin THEN 0 ELSE added END AS added FROM st, (SELECT unnest([1, 2]) AS b) WHERE commit_id % 2 = 0 OR b = 1")
def read_merge_stats(spark, d):
    return logs.read_merge_stats(spark, _merges(spark, d, _numbers_line())).select("commit_id", "base_commit", "modified_path", "current_path", "added")


@_query(f"WITH {ST} SELECT {_h('commit_id')} AS commit_id, {_h('commit_id + b')} AS base_commit, path AS modified_path, CASE WHEN ren THEN other END AS current_path, {KIND} FROM st, (SELECT unnest([1, 2]) AS b) WHERE commit_id % 2 = 0 AND b = 2 OR commit_id % 2 = 1 AND b = 1")
def read_merge_kinds(spark, d):
    # of even commits the last block counts
    return logs.read_merge_kinds(spark, _merges(spark, d, _kinds_line()), all_parents=False).select("commit_id", "base_commit", "modified_path", "current_path", "change_type")


@_query(f"""WITH {P}, {ST[len(C) + 2:]}, s AS (SELECT parent, string_agg({_h('child')}, ',' ORDER BY {_h('child')}) AS sons FROM (SELECT one AS parent, commit_id AS child FROM p UNION ALL SELECT two, commit_id FROM p WHERE commit_id % 3 = 0) WHERE parent IS NOT NULL GROUP BY parent)
SELECT {_h('commit_id')} || ';' || coalesce({_h('one')}, '') || CASE WHEN commit_id % 3 = 0 AND two IS NOT NULL THEN ',' || {_h('two')} ELSE '' END || ';' || coalesce(sons, '') || ';all;' || author || '@x.org;' || time_stamp || ';of ' || project AS value FROM p LEFT JOIN s ON parent = commit_id
UNION ALL SELECT CASE WHEN ren THEN other ELSE path END || ';' || {_h('commit_id')} || ';;' || CASE WHEN ren THEN 'R' WHEN added % 4 = 0 THEN 'A' WHEN added % 4 = 2 THEN 'D' ELSE 'M' END || ';' || CASE WHEN bin THEN 0 ELSE added END || ';' || CASE WHEN bin THEN 0 ELSE deleted END || ';' || CASE WHEN ren THEN path ELSE '' END FROM st""")
def export_code_repo(spark, d):
    ids = F.array_compact(F.array(_hash("one"), _hash("two")))
    rows = _parents(spark, d).select(F.lit("all").alias("project"), _hash("commit_id").alias("commit_id"), ids.alias("parents"), F.concat(F.col("author").cast("string"), F.lit("@x.org")).alias("author_email"), "time_stamp", F.concat(F.lit("of\n"), "project").alias("message"))
    head, files = changes.export_code_repo(rows, _numbers(spark, d), _kinds(spark, d))
    return head.unionAll(files)


# -- diffs, blame, linter output -------------------------------------------------

# a hunk of C, made of a line item: comments, gotos, allocations, brackets, stars
BODY = """'@@ -' || l_linenumber || ' +' || (l_linenumber + 1) || ' @@' || chr(10) || '+goto end' || l_linenumber || ' ;' || chr(10) || repeat('+a[' || l_linenumber || ']++;' || chr(10), q % 4) || repeat('-*p = **q--;' || chr(10), l_linenumber % 3)
 || '+x = realloc(y); z = calloc(1); w = malloc(2); free(w); // goto out;' || chr(10) || CASE WHEN q % 2 = 0 THEN '-/* malloc(' || chr(10) || '-*/ ***r;' || chr(10) ELSE '' END"""
# line items of one order and part are one hunk each, in an order of their own
D = f"""d AS (SELECT l_orderkey AS commit_id, 'src dir/' || l_partkey || CASE l_partkey % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.h' WHEN 2 THEN '.cpp' ELSE '.sh' END AS path, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
b AS (SELECT *, {BODY} AS body FROM d)"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".c", ".h", ".cpp", ".sh")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    q, n = F.col("q"), F.col("l_linenumber")
    items = _table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    # line items are dealt by order before text is made of them: grouping by file and by commit needs no further shuffle
    items = _dealt(items, items.count(), "l_orderkey")
    rows = items.select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("src dir/"), F.col("l_partkey").cast("string"), ext).alias("path"), "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    body = _lines(
        "@@ -", n, " +", n + 1, " @@\n+goto end", n, " ;\n", F.repeat(_lines("+a[", n, "]++;\n"), (q % 4).cast("int")), F.repeat(F.lit("-*p = **q--;\n"), (n % 3).cast("int")),
        "+x = realloc(y); z = calloc(1); w = malloc(2); free(w); // goto out;\n", F.when(q % 2 == 0, "-/* malloc(\n-*/ ***r;\n").otherwise(""),
    )
    files = rows.groupBy("commit_id", "path").agg(F.array_join(F.sort_array(F.collect_list(body)), "").alias("hunks"))
    part = _lines("diff --git a/", F.col("path"), " b/", F.col("path"), "\n--- a/", F.col("path"), "\n+++ b/", F.col("path"), "\n", F.col("hunks"))
    texts = files.groupBy("commit_id").agg(F.array_join(F.sort_array(F.collect_list(part)), "").alias("text"))
    # a file holds the diffs of one part, so files that are read whole do not grow with the table
    return logs.read_diffs(spark, _dump(texts, _lines("commit: ", _hash("commit_id"), "\n", F.col("text")), "gzip"))


@_query(f"""WITH {D}, l AS (SELECT commit_id, path, l_linenumber, unnest(string_split(body, chr(10))[2:]) AS line, generate_subscripts(string_split(body, chr(10))[2:], 1) AS i, body FROM b),
k AS (SELECT commit_id, path, line[1] AS side, line[2:] AS text, l_linenumber + CASE WHEN line[1] = '+' THEN 1 ELSE 0 END + len(list_filter(string_split(body, chr(10))[2:i], lambda x: x[1] = line[1])) AS line_no FROM l WHERE line <> '')
SELECT {_h('commit_id')} AS commit_id, path, side, text, CAST(line_no AS INTEGER) AS line_no, regexp_full_match(trim(text), '(?s)|(//|/\\*|\\*|import ).*|.*\\*/') AS is_noise FROM k""")
def parse_hunks(spark, d):
    return logs.parse_hunks(_diffs(spark, d)).select("commit_id", "path", "side", "text", "line_no", "is_noise")


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


@_query(rf"""WITH {D}, x AS (SELECT commit_id, path, regexp_replace(body, '(?s)//.*?\n|/\*.*?\*/', '', 'g') AS t FROM b), m AS (SELECT *, list_transform(regexp_extract_all(t, '\*+'), lambda s: length(s)) AS d FROM x WHERE regexp_matches(path, '[cChH]$')),
s AS (SELECT commit_id, sum({_count('malloc')} + {_count('calloc')} + {_count('realloc')}) AS meminc, sum({_count('free')}) AS memdec, sum({_count('realloc')}) AS memchg, sum(len(list_filter(d, lambda v: v = 1))) AS singlepointer, sum(len(list_filter(d, lambda v: v > 1))) AS multiplepointer,
 max(coalesce(list_max(d), 0)) AS maxpointerdepth, sum({_count('goto[ ]+[a-z0-9]+[ ]*;')}) AS gotostm, sum({_count(r'\[[a-z0-9]+\]')}) AS indexused, sum({_count(r'\+\+')} + {_count('--')}) AS autoincredecre FROM m GROUP BY commit_id)
SELECT {_h('a.commit_id')} AS commit_id, """ + ", ".join(f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in ("meminc", "memdec", "memchg", "singlepointer", "multiplepointer", "maxpointerdepth", "gotostm", "indexused", "autoincredecre")) + " FROM (SELECT DISTINCT commit_id FROM b) a LEFT JOIN s ON a.commit_id = s.commit_id")  # fmt: skip
def c_features_of_diffs(spark, d):
    return changes.c_features(logs.hunk_bodies(_diffs(spark, d))).drop("project")


@_query(f"SELECT 'src dir/' || l_partkey || '.c' AS path, l_suppkey AS line_no, CASE WHEN l_linenumber = 1 THEN right({_h('l_orderkey')}, 39) ELSE {_h('l_orderkey')} END AS origin_commit, l_linenumber AS origin_line, l_linenumber = 1 AS is_boundary FROM lineitem")
def read_blame(spark, d):
    first = F.col("l_linenumber") == 1
    name = F.when(first, F.concat(F.lit("^"), F.right(_hash("l_orderkey"), F.lit(39)))).otherwise(_hash("l_orderkey"))
    text = _lines(name, " src dir/", F.col("l_partkey"), ".c ", F.col("l_linenumber"), " (Ann (x) 2020-01-01 10:00:00 +0000 ", F.col("l_suppkey"), ") f(1);")
    rows = logs.read_blame(spark, _dump(_table(spark, d, "lineitem"), text), "head")
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), "origin_commit", "origin_line", "is_boundary")


@_query("SELECT 'p ' || l_partkey || ', x.java' AS path, l_suppkey AS line_no, 1 + l_linenumber % 3 AS priority, 'Rule' || l_linestatus AS rule FROM lineitem")
def read_violations(spark, d):
    text = _lines("1,pkg,\"p ", F.col("l_partkey"), ", x.java\",", F.col("l_linenumber") % 3 + 1, ",", F.col("l_suppkey"), ",\"says \"\"no\"\"\",set,Rule", F.col("l_linestatus"))
    rows = logs.read_violations(spark, _dump(_table(spark, d, "lineitem"), text), "p", "c")
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), "priority", "rule")


def _xml_dump(files: DataFrame, value: Column, items: int) -> str:
    """The folder of XML files, each a document with some of ``files``, which have ``items`` in all: of at most TASK_ROWS items on average."""
    documents = max(16, -(-items // TASK_ROWS))
    body = files.groupBy((F.col("l_partkey") % documents).cast("int").alias("d")).agg(F.array_join(F.sort_array(F.collect_list(value)), "\n").alias("b"))
    return _dump(body.repartitionById(documents, "d"), _lines("<pmd>\n", F.col("b"), "\n</pmd>"))


@_query("SELECT 'p & ' || l_partkey || '.java' AS path, CAST(l_suppkey AS INTEGER) AS line_no, CAST(1 + l_linenumber % 5 AS INTEGER) AS priority, 'Rule' || l_linestatus AS rule FROM lineitem WHERE l_linenumber <> 2")
def read_violations_xml(spark, d):
    line = F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("l_suppkey").cast("string"))
    item = _lines('<violation beginline="', line, '" endline="', F.col("l_suppkey") + 3, '" priority="', F.col("l_linenumber") % 5 + 1, '" rule="Rule', F.col("l_linestatus"), '">\nsays &lt;no&gt;\n</violation>')
    files = _table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_list(item)), "\n").alias("body"))
    folder = _xml_dump(files, _lines('<file name="p &amp; ', F.col("l_partkey"), '.java">\n', F.col("body"), "\n</file>"), _table(spark, d, "lineitem").count())
    return logs.read_violations_xml(spark, folder, "p", "c").select("path", "line_no", "priority", "rule")


@_query("SELECT 'p & ' || l_partkey || '.java' AS path, count(*) FILTER (l_linenumber % 5 = 0) AS block, count(*) FILTER (l_linenumber % 5 = 1) AS critical, count(*) FILTER (l_linenumber % 5 > 1) AS major FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL")
def warning_counts_xml(spark, d):
    line = F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("l_suppkey").cast("string"))
    item = _lines('<violation beginline="', line, '" endline="1" priority="', F.col("l_linenumber") % 5 + 1, '" rule="r"/>')
    files = _table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("body"))
    folder = _xml_dump(files, _lines('<file name="p &amp; ', F.col("l_partkey"), '.java">', F.col("body"), "</file>"), _table(spark, d, "lineitem").count())
    return warnings.warning_counts(logs.read_violations_xml(spark, folder, "p", "c"), ["path"], at_least_major=True)


@_query("WITH " + CH + ", s AS (SELECT project, commit_id, any_value(time_stamp) AS time_stamp, CAST(sum(added) AS BIGINT) AS la, avg(deleted) AS mean FROM ch GROUP BY project, commit_id) SELECT kind, project, commit_id, time_stamp, la, round(mean, 6) AS mean FROM s, (SELECT unnest(['csv', 'parquet']) AS kind)")
def write_features(spark, d):
    rows = _changes(spark, d).groupBy("project", "commit_id").agg(F.first("time_stamp").alias("time_stamp"), F.sum("added").alias("la"), F.avg("deleted").alias("mean"))
    out = []
    for kind in ("csv", "parquet"):
        folder = shared_folder(spark)
        logs.write_features(rows, folder, kind)
        back = logs.read_features(spark, folder, kind, "commit_id long, time_stamp long, la long, mean double")
        out.append(back.select(F.lit(kind).alias("kind"), F.col("project").cast("string").alias("project"), "commit_id", "time_stamp", "la", F.round("mean", 6).alias("mean")))
    return out[0].unionByName(out[1])
