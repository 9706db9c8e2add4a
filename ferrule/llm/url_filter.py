"""URL filters: a trie of reversed host labels and path segments, the longest rule wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import fresh

#: Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: from there up to ``?`` or ``#``.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are sent to every executor up to this many bytes of hosts and paths; more are joined.
MOST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """The host in lower case (A-Z alone), '' without one or without a URL."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


class Trie:
    """Host labels from the last to the first, then path segments.

    A node is ``[next label, next segment, ends]``.  A rule ends at the node of
    its last whole segment; ``ends`` has what its path goes on with, which the
    rest of a URL's path must begin with."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.top: list = [{}, {}, {}]
        for host, path, verdict in rules:
            node = self.top
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, {}, {}])
            *whole, rest = path.split("/")
            for segment in whole:
                node = node[1].setdefault(segment, [{}, {}, {}])
            old = node[2].get(rest)
            # of two verdicts on one rule, block holds
            node[2][rest] = (host + path, "block" if old and old[1] == "block" else verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the rule with most host labels, and of those with the longest path."""
        hosts, node = [], self.top
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            hosts.append(node)
        for node in reversed(hosts):
            best, left = None, path
            while node is not None:
                ends = node[2]
                segment, slash, left = left.partition("/")
                # what ends here has no slash: look at the ends, or at the segment's beginnings where those are fewer
                fits = [e for e in ends if segment.startswith(e)] if len(ends) <= len(segment) else [e for n in range(len(segment) + 1) if (e := segment[:n]) in ends]
                if fits:
                    best = ends[max(fits, key=len)]
                node = node[1].get(segment) if slash else None
            if best:
                return best
        return None


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that holds, or null) and verdict.

    ``rules`` (host, path, verdict): a rule fits its host and all hosts below it,
    where the URL's path begins with the rule's.  The one of the longest host
    holds, then of the longest path; block, if both verdicts are given for one.
    Where none fits, ``default`` holds.

    Rules of up to ``most_bytes`` are one trie on every executor, and pages are
    not shuffled.  Beyond that each distinct host looks for the rules of it and
    of the hosts above it by a join, whose busy keys Spark splits.

    A null URL, or one without ``://``, has neither host nor path.  Every row
    gives one row, repeated ones too; columns of ``pages`` with the four names
    are replaced, all others stay.  Rules with a null are left out.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
    h, p, out = fresh(pages, "_host"), fresh(pages, "_path"), fresh(pages, "_out")
    rows = pages.withColumns({h: host_of(F.col(f"`{url}`")), p: path_of(F.col(f"`{url}`"))})
    judged = _by_trie(rows, rules, h, p, out) if size <= most_bytes else _by_join(rows, rules, h, p, out)
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    found = F.col(out)
    return judged.select(*keep, F.col(h).alias("host"), F.col(p).alias("path"), found["rule"].alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))


def _by_trie(rows: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    # at most MOST_BYTES, checked before
    sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.collect()])

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(sent.value)
        for hosts, paths in batches:
            found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return rows.withColumn(out, find(host, path))


def _by_join(rows: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    labels = F.split(host, r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = rules.groupBy(F.col("host").alias("_rh"), F.col("path").alias("_rp")).agg(F.min("verdict").alias("_v"), F.max(F.when(F.col("verdict") == "block", "block")).alias("_b"))
    rule = rule.select("_rh", "_rp", F.coalesce("_b", "_v").alias("_v"))
    urls = rows.select(host, path).distinct().withColumn("_rh", F.explode(above))
    fits = urls.join(rule, "_rh").where(F.startswith(F.col(path), F.col("_rp")))
    order = F.struct(F.size(F.split("_rh", r"\.", -1)), F.length("_rp"))
    best = fits.groupBy(host, path).agg(F.max_by(F.struct(F.concat("_rh", "_rp").alias("rule"), F.col("_v").alias("verdict")), order).alias(out))
    return rows.join(best, [host, path], "left")
