"""Work on tables of static-analysis warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.running import running, same_group

LEVELS = {"block": 1, "critical": 2, "major": 3}


def _levels(at_least_major: bool = False) -> list:
    # a linter may number what is less than major, too
    return [F.count_if(F.col("priority") >= p if at_least_major and p == 3 else F.col("priority") == p).alias(n) for n, p in LEVELS.items()]


def warnings_on_added_lines(violations: DataFrame, added: DataFrame) -> DataFrame:
    keys = ["project", "commit_id", "path", "line_no"]
    return same_group(violations, added.select(*keys).distinct(), keys, "left_semi")


def warning_counts(violations: DataFrame, keys: list[str], at_least_major: bool = False) -> DataFrame:
    return violations.groupBy(*keys).agg(*_levels(at_least_major))


def rule_histogram(violations: DataFrame, keys: list[str]) -> DataFrame:
    rules = violations.groupBy(*keys, "rule").agg(F.count("*").alias("n"))
    return rules.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rules"))


def severity_per_line(violations: DataFrame) -> DataFrame:
    return violations.groupBy("project", "path", "line_no").agg(F.min("priority").alias("priority"))


def snapshot_totals(violations: DataFrame) -> DataFrame:
    """Counts per file, and per project where path is null."""
    rows = violations.rollup("project", "path").agg(*_levels(), F.grouping("project").alias("_g"))
    return rows.where("_g = 0").drop("_g")


def warnings_by_label(counts: DataFrame, label: str = "contains_bug") -> DataFrame:
    return counts.groupBy(label).agg(*[F.avg(n).alias(n) for n in LEVELS])


def running_totals(counts: DataFrame) -> DataFrame:
    """Per commit, the project's warnings over live files, from counts of each
    touched file (project, pos, commit_id, path, block, critical, major, gone).

    Each touch changes the total by its counts less the file's last ones; a file
    that is gone counts 0.  Only these differences are summed along the commits.
    """
    w = Window.partitionBy("project", "path").orderBy("pos")
    now = {n: F.when(F.col("gone"), 0).otherwise(F.col(n)) for n in LEVELS}
    deltas = counts.withColumns({f"_{n}": c - F.coalesce(F.lag(c).over(w), F.lit(0)) for n, c in now.items()})
    steps = deltas.groupBy("project", "pos", "commit_id").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in LEVELS])
    out = running(steps, ["project"], F.col("pos"), [F.col("commit_id")], {n: F.col(f"_{n}") for n in LEVELS})
    return out.select("project", "commit_id", *[F.col(n).cast("long").alias(n) for n in LEVELS])
