"""Column functions on file paths, change lines and messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_extensions(path: Column, extensions: list[str]) -> Column:
    """The last extension, lower-cased, is one of ``extensions`` ('.c'); an empty list takes all.

    A name that starts with its only dot has no extension."""
    if not extensions:
        return F.lit(True)
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1)).isin([e.lower() for e in extensions])


def in_scope_change(is_merge: Column, old: Column, new: Column, is_rename: Column, extensions: list[str]) -> Column:
    ok = in_extensions(old, extensions) & ~old.endswith("/")
    return ~is_merge & (ok | (F.coalesce(is_rename, F.lit(False)) & F.coalesce(in_extensions(new, extensions) & ~new.endswith("/"), F.lit(False))))


def expand_rename(path: Column) -> Column:
    """struct<old, new> of ``pre{a => b}post`` or ``a => b``; new is null for a plain path."""
    braces, arrow = r"^(.*)\{(.*) => (.*)\}(.*)$", r"^(.*) => (.*)$"
    part = lambda p, i: F.regexp_extract(path, p, i)
    side = lambda i: F.replace(F.concat(part(braces, 1), part(braces, i), part(braces, 4)), F.lit("//"), F.lit("/"))
    old = F.when(path.rlike(braces), side(2)).when(path.rlike(arrow), part(arrow, 1)).otherwise(path)
    new = F.when(path.rlike(braces), side(3)).when(path.rlike(arrow), part(arrow, 2))
    return F.struct(old.alias("old"), new.alias("new"))


def parse_numstat_line(line: Column) -> Column:
    """struct<added, deleted, old, new>; binary files ('-') count 0 and 0."""
    f = F.split(line, "\t", 3)
    n = lambda i: F.coalesce(f[i].try_cast("long"), F.lit(0).cast("long"))
    names = expand_rename(f[2])
    return F.struct(n(0).alias("added"), n(1).alias("deleted"), names["old"].alias("old"), names["new"].alias("new"))


def parse_namestat_line(line: Column) -> Column:
    """struct<change_type, old, new>: A add, M and T modify, D delete, R... rename."""
    f = F.split(line, "\t")
    kind = F.substring(f[0], 1, 1)
    name = F.when(kind == "A", "add").when(kind.isin("M", "T"), "modify").when(kind == "D", "delete").when(kind == "R", "rename")
    return F.struct(name.alias("change_type"), f[1].alias("old"), F.when(kind == "R", F.get(f, F.lit(2))).alias("new"))


def subsystem_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_noise_line(text: Column) -> Column:
    """Blank, a comment, or an import."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (t == "") | t.rlike(r"^(//|/\*|\*|import )") | t.endswith("*/")


def parse_hunk_header(line: Column) -> Column:
    number = lambda p: F.regexp_extract(line, p, 1).try_cast("int")
    return F.struct(number(r"-(\d*)").alias("old_start"), number(r"\+(\d*)").alias("new_start"))


def classify_message(message: Column, is_merge: Column, categories: list[tuple[str, list[str]]]) -> Column:
    """'Merge', else the first category any of whose keywords is in the lower-cased message, else 'None'."""
    out = F.when(is_merge, "Merge")
    for name, words in categories:
        out = out.when(F.lower(message).rlike("|".join(map(re.escape, words))), name)
    return out.otherwise("None")
