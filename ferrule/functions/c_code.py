"""Counts of C constructs in a chunk of code, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is counted.
GOTO, INDEX, PLUS, MINUS, STARS = r"(?U)goto\s+\w+\s*;", r"(?U)\[\w+\]", r"\+{2}", r"-{2}", r"\*+"
ALLOCATORS, RELEASE, CHANGE = ("malloc", "calloc", "realloc"), "free", "realloc"


def _n(chunk: Column, pattern: str) -> Column:
    return F.regexp_count(chunk, F.lit(pattern)).cast("long")


def is_c_file(path: Column) -> Column:
    """The last letter is c or h; so 'x.sh' and 'x.doc' are in, 'x.cpp' is not."""
    return path.rlike("[cChH]$")


def strip_comments(chunk: Column) -> Column:
    return F.regexp_replace(chunk, r"(?s)//.*?\n|/\*.*?\*/", "")


def metrics(chunk: Column) -> dict[str, Column]:
    """The nine counts of a chunk, comments taken out first."""
    c = strip_comments(chunk)
    depths = F.transform(F.regexp_extract_all(c, F.lit(STARS), F.lit(0)), F.length)
    single = F.size(F.filter(depths, lambda d: d == 1)).cast("long")
    return {
        "meminc": sum((_n(c, w) for w in ALLOCATORS[1:]), _n(c, ALLOCATORS[0])),
        "memdec": _n(c, RELEASE),
        "memchg": _n(c, CHANGE),
        "singlepointer": single,
        "multiplepointer": F.size(depths) - single,
        "maxpointerdepth": F.coalesce(F.array_max(depths), F.lit(0)).cast("long"),
        "gotostm": _n(c, GOTO),
        "indexused": _n(c, INDEX),
        "autoincredecre": _n(c, PLUS) + _n(c, MINUS),
    }
