"""Readers of text dumps of version history.  The project is the name of the dump's folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.paths import is_noise_line, parse_hunk_header, parse_namestat_line, parse_numstat_line

if TYPE_CHECKING:
    import pyarrow as pa

COMMIT = "commit: "
HASH = "^[0-9a-f]{40}$"


def _project() -> Column:
    # no pattern: one would be tried from each place of the path, for every row
    return F.substring_index(F.substring_index(F.input_file_name(), "/", -2), "/", 1)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(project, commit_id, body) of dumps made of ``commit: <hash>`` records; other records have commit_id null."""
    raw = spark.read.text(path, lineSep="\n" + COMMIT).withColumn("project", _project())
    text = F.when(F.col("value").startswith(COMMIT), F.substr("value", F.lit(len(COMMIT) + 1))).otherwise(F.col("value"))
    head = F.trim(F.substring_index(text, "\n", 1))
    rest = F.when(text.contains("\n"), F.substr(text, F.locate("\n", text) + 1)).otherwise("")
    return raw.select("project", F.when(head.rlike(HASH), head).alias("commit_id"), rest.alias("body"), F.monotonically_increasing_id().alias("pos"))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a dump of meta records; pos is the place in the dump."""
    rows = _records(spark, path).where("commit_id is not null")
    names = ("parent", "author", "author email", "time stamp", "committer", "committer email")
    field = lambda n: F.trim(F.regexp_extract("body", rf"(?m)^{n}: ?(.*)$", 1))
    message = F.regexp_replace("body", r"(?s)^(?:.*?\n){%d}" % len(names), "")
    parents = F.filter(F.split(field("parent"), " "), lambda p: p != "")
    time = field("time stamp").try_cast("long")
    return rows.select(
        "project", "commit_id", parents.alias("parents"), field("author").alias("author_name"), field("author email").alias("author_email"), field("committer").alias("committer_name"), field("committer email").alias("committer_email"),
        time.alias("time_stamp"), F.timestamp_seconds(time).alias("creation_time"), F.trim(message, F.lit("\n ")).alias("message"), (F.size(parents) > 1).alias("is_merge"), "pos",
    )


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """Records whose first line is no commit hash, such as a message that holds the record mark."""
    return _records(spark, path).where("commit_id is null")


def _lines(rows: DataFrame) -> DataFrame:
    return rows.where("commit_id is not null").withColumn("line", F.explode(F.split("body", "\n"))).where(F.trim("line") != "")


def read_numstat(spark: SparkSession, path: str) -> DataFrame:
    f = parse_numstat_line(F.col("line"))
    rows = _lines(_records(spark, path)).where(F.col("line").contains("\t")).withColumn("f", f)
    return rows.select("project", "commit_id", F.lit(None).cast("string").alias("base_commit"), F.col("f.old").alias("modified_path"), F.col("f.new").alias("current_path"), "f.added", "f.deleted", F.col("f.new").isNotNull().alias("is_rename"))


def read_namestat(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(_records(spark, path)).where(F.col("line").contains("\t")).withColumn("f", parse_namestat_line(F.col("line")))
    return rows.select("project", "commit_id", F.lit(None).cast("string").alias("base_commit"), F.col("f.old").alias("modified_path"), F.col("f.new").alias("current_path"), "f.change_type").where("change_type is not null")


#: Lines of a block of a dump of merges that travel as one row.
BLOCK = 16384
MERGE = r"^([0-9a-f]{40}) \(from ([0-9a-f]{40})\)"


def _merge_blocks(block: int, last_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (key, row, head, value) in the order of their splits as blocks of up to ``block`` lines below one header.

    A header is null where a split begins within a block.  With ``last_only`` a block
    goes if the next one has the same commit, split and lines, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split, known = None, (None, None, None)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            value, key, head = b.column("value"), b.column("key").to_numpy(), b.column("head").to_numpy(zero_copy_only=False)
            turn = np.append(split is None or key[0] != split, key[1:] != key[:-1])
            at = np.flatnonzero(head | turn | (np.arange(n) % block == 0))
            heads = np.flatnonzero(head)
            names = value.take(pa.array(heads))
            # the header known from the batch before comes first
            rows = pa.concat_arrays([pa.array([known[0]], pa.int64()), b.column("row").take(pa.array(heads))])
            commits = pa.concat_arrays([pa.array([known[1]], pa.string()), pc.utf8_slice_codeunits(names, 0, 40)])
            bases = pa.concat_arrays([pa.array([known[2]], pa.string()), pc.utf8_slice_codeunits(names, 47, 87)])
            number = np.cumsum(head)[at]
            # none, where the split has turned since
            since = np.maximum.accumulate(np.where(turn, np.arange(n), -1))[at]
            place = np.append(-1, heads)[number]
            number = pa.array(number, mask=(since >= 0) & (place < since))
            size = np.add.reduceat(~head, at, dtype=np.int64)
            lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), value.filter(pa.array(~head)))
            out = pa.RecordBatch.from_arrays([pa.array(key[at]), rows.take(number), commits.take(number), bases.take(number), lines], ["key", "row", "commit_id", "base_commit", "lines"])
            split, known = key[-1], tuple(x.take(number)[-1].as_py() for x in (rows, commits, bases))
            out = out.filter(pa.array(size > 0))
            if last_only and out.num_rows > 1:
                c, r, k = out.column("commit_id"), out.column("row"), out.column("key").to_numpy()
                same = pc.and_(pc.equal(c[1:], c[:-1]), pc.not_equal(r[1:], r[:-1])).fill_null(False).to_numpy(zero_copy_only=False)
                out = out.filter(pa.array(np.append(~(same & (k[1:] == k[:-1])), True)))
            yield out

    return run


def _merge_lines(spark: SparkSession, path: str, all_parents: bool) -> DataFrame:
    """(project, commit_id, base_commit, line) of blocks headed ``<hash> (from <hash>) subject``.

    Files are read in splits, as any text.  A line's header is the last one before it;
    where a split begins within a block, that is the last header of the splits before.
    Only without ``all_parents`` are lines shuffled, once and in blocks."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), _project().alias("project"), F.monotonically_increasing_id().alias("row"))
    raw = raw.withColumns({"key": F.xxhash64("file", "split"), "head": F.col("value").rlike(MERGE)}).where(F.col("head") | F.col("value").contains("\t"))
    part = lambda i: F.regexp_extract("value", MERGE, i)
    head = F.when(F.col("head"), F.struct("split", "row", part(1).alias("commit_id"), part(2).alias("base_commit")))
    splits = raw.groupBy("key", "file", "split", "project").agg(F.max(head).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("key", "file", "split", "project", F.max("_last").over(earlier).alias("_before"))
    blocks = raw.select("key", "row", "head", "value").mapInArrow(_merge_blocks(BLOCK, not all_parents), "key long, row long, commit_id string, base_commit string, lines array<string>")
    # a row for each split of a file, which the driver has listed, too
    rows = blocks.join(F.broadcast(splits), "key")
    own = F.when(F.col("commit_id").isNotNull(), F.struct("split", "row", "commit_id", "base_commit"))
    rows = rows.select("project", "file", F.coalesce(own, "_before").alias("head"), "lines").where("head is not null")
    if not all_parents:
        last = Window.partitionBy("project", "commit_id")
        at = F.struct("file", "head.split", "head.row")
        rows = rows.select("*", "head.commit_id").withColumn("_final", F.max(at).over(last)).where(at == F.col("_final"))
    return rows.select("project", "head.commit_id", "head.base_commit", F.explode("lines").alias("line"))


def read_merge_stats(spark: SparkSession, path: str, all_parents: bool = True) -> DataFrame:
    """Numbers of merges against a parent, from blocks headed ``<hash> (from <hash>) subject``.

    Without ``all_parents`` the last block of each merge that has changes counts."""
    rows = _merge_lines(spark, path, all_parents).withColumn("f", parse_numstat_line(F.col("line")))
    return rows.select("project", "commit_id", "base_commit", F.col("f.old").alias("modified_path"), F.col("f.new").alias("current_path"), "f.added", "f.deleted", F.col("f.new").isNotNull().alias("is_rename"))


def read_merge_kinds(spark: SparkSession, path: str, all_parents: bool = True) -> DataFrame:
    """Kinds of the changes of merges against a parent, from blocks headed as those of ``read_merge_stats``."""
    rows = _merge_lines(spark, path, all_parents).withColumn("f", parse_namestat_line(F.col("line")))
    return rows.select("project", "commit_id", "base_commit", F.col("f.old").alias("modified_path"), F.col("f.new").alias("current_path"), "f.change_type").where("change_type is not null")


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(project, commit_id, diff_text) of a dump of ``commit: <hash>`` records with each commit's diff."""
    return _records(spark, path).where("commit_id is not null").select("project", "commit_id", F.col("body").alias("diff_text"))


def _hunks(diffs: DataFrame) -> DataFrame:
    files = diffs.select("project", "commit_id", F.explode(F.split("diff_text", "(?m)^(?=diff --git )")).alias("part")).where(F.col("part").startswith("diff --git "))
    name = lambda mark, side: F.regexp_extract("part", rf"(?m)^{mark} {side}/(.*)$", 1)
    return files.select("project", "commit_id", name("---", "a").alias("old"), name(r"\+\+\+", "b").alias("new"), F.posexplode(F.split("part", "(?m)^(?=@@ )")).alias("hunk_no", "hunk")).where("hunk_no > 0")


def hunk_bodies(diffs: DataFrame) -> DataFrame:
    """(project, commit_id, path, hunk_no, body) of unified diffs (project, commit_id, diff_text): whole hunks, header and signs included."""
    path = F.when(F.col("new") != "", F.col("new")).otherwise(F.col("old"))
    return _hunks(diffs).select("project", "commit_id", path.alias("path"), "hunk_no", F.col("hunk").alias("body"))


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """(project, commit_id, path, hunk_no, side, line_no, text, is_noise) of the
    removed and added lines of unified diffs (project, commit_id, diff_text).

    Lines of context, where a diff has them, count but are not returned."""
    files = _hunks(diffs)
    start = parse_hunk_header(F.substring_index("hunk", "\n", 1))
    lines = files.withColumn("s", start).withColumn("all", F.slice(F.split("hunk", "\n"), 2, 1_000_000_000))

    def side(mark: str, first: str, path: str) -> Column:
        seen = F.filter("all", lambda x: x.startswith(mark) | x.startswith(" "))
        row = F.transform(seen, lambda x, i: F.struct(F.substr(x, F.lit(1), F.lit(1)).alias("side"), F.col(path).alias("path"), (F.col(f"s.{first}") + i).alias("line_no"), F.substr(x, F.lit(2)).alias("text")))
        return F.filter(row, lambda r: r["side"] == mark)

    rows = lines.select("project", "commit_id", "hunk_no", F.explode(F.concat(side("-", "old_start", "old"), side("+", "new_start", "new"))).alias("x"))
    return rows.select("project", "commit_id", "x.path", "hunk_no", "x.side", "x.line_no", "x.text", is_noise_line(F.col("x.text")).alias("is_noise"))


BLAME = r"^(\^?)([0-9a-f]{39,40}) +(\S.*?) +(\d+) \(.*?(\d+)\) ?(.*)$"


def read_blame(spark: SparkSession, path: str, at_commit: str) -> DataFrame:
    """Lines of ``blame -f -n -l``: origin commit ('^' marks a boundary), its file (which may have blanks) and line."""
    # a line is matched once, and its fields are parted by what no line of text holds
    fields = F.split(F.regexp_replace("value", BLAME, "\n$1\n$2\n$3\n$4\n$5\n"), "\n")
    raw = spark.read.text(path).withColumn("project", _project())
    # what is no line of blame stays as it is, and has no second field
    rows = raw.select("project", F.explode(F.filter(F.array(fields), lambda f: F.size(f) > 1)).alias("f"))
    part = lambda i: F.get("f", F.lit(i))
    return rows.select("project", F.lit(at_commit).alias("at_commit"), part(3).alias("path"), part(5).try_cast("int").alias("line_no"), part(2).alias("origin_commit"), part(3).alias("origin_path"), part(4).try_cast("int").alias("origin_line"), (part(1) == "^").alias("is_boundary"))


def rejected_blame(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no line of blame."""
    return spark.read.text(path).withColumn("project", _project()).where((F.col("value") != "") & ~F.col("value").rlike(BLAME))


def read_violations(spark: SparkSession, path: str, project: str, commit_id: str) -> DataFrame:
    """A linter's CSV: problem, package, file, priority, line, description, set, rule."""
    raw = spark.read.csv(path, header=False)
    n = lambda i: raw[f"_c{i}"].try_cast("int")
    rows = raw.select(F.lit(project).alias("project"), F.lit(commit_id).alias("commit_id"), raw["_c2"].alias("path"), n(4).alias("line_no"), n(3).alias("priority"), raw["_c7"].alias("rule"))
    return rows.where("priority is not null")


def read_violations_xml(spark: SparkSession, path: str, project: str, commit_id: str) -> DataFrame:
    """A linter's XML: ``file`` elements with a ``name``, and in them ``violation``
    elements with ``beginline``, ``endline``, ``priority`` and ``rule``.

    A violation counts on its first line; one without a number for it or for its
    priority is left out.  A file of XML has one root, as XML has."""
    one = "array<struct<_beginline: string, _endline: string, _priority: string, _rule: string, _VALUE: string>>"
    files = spark.read.format("xml").option("rowTag", "file").schema(f"_name string, violation {one}").load(path)
    rows = files.select(F.col("_name").alias("path"), F.explode("violation").alias("v"))
    n = lambda c: F.trim(F.col(f"v.{c}")).try_cast("int")
    out = rows.select(F.lit(project).alias("project"), F.lit(commit_id).alias("commit_id"), "path", n("_beginline").alias("line_no"), n("_priority").alias("priority"), F.col("v._rule").alias("rule"))
    return out.where("line_no is not null and priority is not null")


def write_features(df: DataFrame, path: str, kind: str = "parquet", spread: int = 16) -> None:
    """The feature table as Parquet or CSV, a folder for each project, newest first within files.

    A project is ``spread`` files at most, so that a large one is no one task's work."""
    rows = df.repartition("project", F.pmod(F.xxhash64("commit_id"), F.lit(spread))).sortWithinPartitions("project", F.desc("time_stamp"))
    rows.write.partitionBy("project").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def read_features(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A feature table as written; text needs the ``schema`` of its columns but for the project."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).schema(f"{schema}, project string")
    return reader.load(path)


def read_table(spark: SparkSession, url: str, table: str, projects: list[str] | None = None, column: str = "project", **properties: str) -> DataFrame:
    """A table of a database, read by one scan with one task for each of
    ``projects``, which asks for that project's rows alone; None is a null project.

    Names are quoted as the database does it."""
    if projects is None:
        return spark.read.jdbc(url, table, properties=properties)
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    quoted = {p: "'" + p.replace("'", "''") + "'" for p in projects if p is not None}
    predicates = [f"{column} IS NULL" if p is None else f"{column} = {quoted[p]}" for p in dict.fromkeys(projects)]
    return spark.read.jdbc(url, table, predicates=predicates or ["1 = 0"], properties=properties)


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(category, words) of files of comma-separated words, one file for each category, named by it."""
    raw = spark.read.text(path, wholetext=True)
    name = F.initcap(F.replace(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit(" ")))
    words = F.filter(F.transform(F.split("value", r"[,\n]"), lambda w: F.lower(F.trim(w, F.lit(" \t\r")))), lambda w: w != "")
    return raw.select(name.alias("category"), words.alias("words"))


def keyword_lists(keywords: DataFrame, order: list[str]) -> list[tuple[str, list[str]]]:
    """The lists in the order in which ``classify_message`` tries them; there are a few words a category."""
    found = {r.category: r.words for r in keywords.collect()}
    return [(c, found[c]) for c in order if found.get(c)]
