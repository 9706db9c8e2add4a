"""Linking fixes to the commits that introduced what they delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.running import same_group


def szz_link(fix_lines: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """(project, fix, origin, path, origin_path, origin_line, fix_time, origin_time) of each deleted
    line of a fix (project, commit_id, path, line_no) that blame traces; boundary hits are dropped."""
    hits = blame.where(~F.coalesce("is_boundary", F.lit(False))).withColumnRenamed("at_commit", "commit_id")
    time = commits.select("project", "commit_id", "time_stamp")
    rows = same_group(fix_lines, hits, ["project", "commit_id", "path", "line_no"]).withColumnsRenamed({"commit_id": "fix", "origin_commit": "origin"})
    rows = same_group(rows, time.withColumnsRenamed({"commit_id": "fix", "time_stamp": "fix_time"}), ["project", "fix"])
    rows = same_group(rows, time.withColumnsRenamed({"commit_id": "origin", "time_stamp": "origin_time"}), ["project", "origin"])
    return rows.select("project", "fix", "origin", "path", "origin_path", "origin_line", "fix_time", "origin_time")


def bug_summary(links: DataFrame) -> DataFrame:
    """Per origin: fix_by (fixes in order of time), find_interval (seconds to the earliest), buggy lines."""
    pairs = links.groupBy("project", "origin", "fix").agg(F.min("fix_time").alias("t"), F.min(F.col("fix_time") - F.col("origin_time")).alias("gap"), F.count("*").alias("lines"))
    fixes = F.transform(F.array_sort(F.collect_list(F.struct("t", "fix"))), lambda x: x["fix"])
    return pairs.groupBy("project", "origin").agg(fixes.alias("fix_by"), F.min("gap").alias("find_interval"), F.sum("lines").alias("buggy_lines"))


def fix_summary(links: DataFrame, fix_lines: DataFrame) -> DataFrame:
    """Per fix: fixes (the origins), and of its deleted lines the number of files
    and of lines, and bug_fix_files, the map of files to lines."""
    origins = links.select("project", "fix", "origin").distinct().groupBy("project", "fix").agg(F.array_sort(F.collect_list("origin")).alias("fixes"))
    files = fix_lines.groupBy("project", F.col("commit_id").alias("fix")).agg(F.count_distinct("path").alias("fix_file_num"), F.count("*").alias("deleted_lines"))
    listed = lines_by_file(fix_lines.withColumnRenamed("commit_id", "fix"), ["project", "fix"], "path", "line_no").withColumnRenamed("lines", "bug_fix_files")
    return same_group(same_group(files, listed, ["project", "fix"]), origins, ["project", "fix"], "left")


def lines_by_file(lines: DataFrame, key: list[str], path: str, line: str) -> DataFrame:
    """path -> line numbers, as a map, for each ``key``."""
    files = lines.where(F.col(path).isNotNull()).groupBy(*key, path).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    return files.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(path, "_l")))).alias("lines"))


def clean_files(touched: DataFrame, buggy: DataFrame) -> DataFrame:
    return same_group(touched, buggy.select("project", "commit_id", "path"), ["project", "commit_id", "path"], "left_anti")


def clean_lines(added: DataFrame, buggy: DataFrame, commits: DataFrame) -> DataFrame:
    """path -> lines, as a map, of what commits added that are neither buggy nor merges.

    ``added`` (project, commit_id, path, line_no, is_noise) has added lines; noise is left out."""
    key = ["project", "commit_id"]
    plain = same_group(commits.where(~F.coalesce("is_merge", F.lit(False))).select(*key), buggy.select(*key).distinct(), key, "left_anti")
    return lines_by_file(same_group(added.where("not is_noise"), plain, key, "left_semi"), key, "path", "line_no")


def valid_modified_files(lines: DataFrame) -> DataFrame:
    """Files of a commit that have a changed line other than noise (``is_noise``)."""
    return lines.groupBy("project", "commit_id", "path").agg(F.bool_or(~F.col("is_noise")).alias("_ok")).where("_ok").drop("_ok")


def interval_quantiles(bugs: DataFrame, approximate: bool = False) -> DataFrame:
    """Quartiles and mean of find_interval, in days."""
    days = F.col("find_interval") / 86400.0
    q = F.percentile_approx(days, [0.25, 0.5, 0.75]) if approximate else F.percentile(days, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = bugs.groupBy("project").agg(q.alias("q"), F.avg(days).alias("mean"))
    return out.select("project", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "mean")


def fix_size_histogram(fixes: DataFrame) -> DataFrame:
    n = F.least(F.col("fix_file_num"), F.lit(5)).cast("int")
    return fixes.where("fix_file_num > 0").groupBy("project", n.alias("files")).agg(F.count("*").alias("commits"))


def author_count(commits: DataFrame, approximate: bool = False) -> DataFrame:
    return commits.groupBy("project").agg((F.approx_count_distinct if approximate else F.count_distinct)("author").alias("authors"))
