"""How far the sources of a language differ in their words, in exact integers.

Shares of a term are integers p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
A term that a source lacks has the source's baseline, the share of count 0, so
two sources differ by V times the difference of their baselines, corrected for
the terms that one of them has.  The first terms of a ranking are found by
radix select: histograms over the bits of the values give each group's
threshold, and ties at it are told apart by their UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, release_memory, saved, small_batches, tidy

SCALE, PRIOR = 1_000_000_000, 5
#: Letters A-Z become a-z, bytes of other ASCII a blank; what is not ASCII stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
#: A task's counts are handed on when they are this many; the same terms meet again after the shuffle.
MOST_ENTRIES = 400_000
#: Sources of a block of pairs, terms of one sum of a block, bits of a histogram.
BLOCK, TERMS, BITS = 256, 256, 11
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents with it."""

    def rows(counts: dict) -> pa.RecordBatch:
        return as_batch(COUNTED, zip(*[(lang, source, t, n, have[t]) for (lang, source), (all_, have) in counts.items() for t, n in all_.items()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in small_batches(batches, "text", 2 << 20):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                all_, have = counts.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.as_py().translate(FOLD).split())
                before = len(all_)
                all_.update(own)
                have.update(own.keys())
                size += len(all_) - before
                if size > MOST_ENTRIES:
                    yield rows(counts)
                    counts, size = {}, 0
        if size:
            yield rows(counts)
        release_memory()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    parts = docs.select(*_groups(), text).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy(*GROUP, F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in decimals of up to 38 digits; 0 where no term is kept."""
    whole = lambda x, d: f"CAST({x} AS DECIMAL({d},0))"
    below = f"nullif({whole(f'{total} + {PRIOR} * {kept}', 20)}, 0)"
    return F.expr(f"coalesce(1 + {whole(SCALE, 10)} * {whole(f'{count} + {PRIOR}', 20)} div {below}, 0)").cast("long")


def select_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int = 31) -> DataFrame:
    """The first ``k`` of each ``group`` by ``value`` (0 to 2^bits - 1) descending, then ``item`` by its UTF-8 bytes, with ``rank``.

    Each pass counts a group's open rows by the next bits of their values, takes
    those of higher bins and keeps open the bin in which the k-th lies.  When the
    bits are used up, open rows tie, and passes go on over the bytes of ``item``
    until no group has more than it needs.  Only counts of bins are gathered by
    group, and k rows in the end.  A group of fewer rows gives all of them; the
    items of a group are distinct, repeated ones are taken in any order."""
    open_, names, taken, at, byte = rows.withColumn("_need", F.lit(k).cast("long")), rows.columns, [], bits, 0
    while True:
        if at > 0:
            width = min(BITS, at)
            at -= width
            digit = -F.shiftright(F.col(value).cast("long"), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        else:
            left = open_.groupBy(*group).agg(F.count("*").alias("_n"), F.first("_need").alias("_need"), F.max(F.octet_length(item)).alias("_most"))
            if left.where(f"_n > _need and _most > {byte}").isEmpty():
                break
            text = F.substring(F.encode(F.col(item), "UTF-8"), byte + 1, 2)
            byte += 2
            # bytes that are there come after none
            digit = F.conv(F.rpad(F.hex(text), 4, "0"), 16, 10).cast("long") * 4 + F.octet_length(text)
        placed = saved(_placed(open_, group, digit))
        taken.append(placed.where("_sure").select(*names))
        open_ = placed.where("not _sure").drop("_sure")
    out = open_.select(*names)
    for t in taken:
        out = out.unionByName(t)
    # about k rows of a group
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), F.asc(item))))
    return ranked.where(F.col("rank") <= k)


def _placed(open_: DataFrame, group: list[str], digit: Column) -> DataFrame:
    """The open rows up to the bin in which the needed rows end: ``_sure`` before it, in it with what is still needed."""
    rows = open_.withColumn("_bin", digit.cast("long"))
    bins = rows.groupBy(*group, "_bin").agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
    w = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    last = before.where("_before < _need").groupBy(*group).agg(F.max(F.struct("_bin", (F.col("_need") - F.col("_before")).alias("_left"))).alias("_last"))
    placed = rows.drop("_need").join(last, group).where(F.col("_bin") <= F.col("_last._bin"))
    return placed.withColumns({"_sure": F.col("_bin") < F.col("_last._bin"), "_need": F.col("_last._left")}).drop("_bin", "_last")


def _pair_sums(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, one, other, extra): for two sources by number, what their terms add to
    the difference of their baselines, summed over the terms that one of them has.

    Terms are dealt into buckets; a task has the shares of a bucket in two blocks
    of sources and sums over all their pairs by array.  Terms and pairs together
    are never a row each."""
    buckets = F.ceil(F.col("kept") / TERMS)
    mine = F.floor((F.col("number") - 1) / BLOCK)
    # a row goes to each pair of blocks, lower first, that has its own
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / BLOCK)), lambda o: F.struct(F.least(mine, o).alias("low"), F.greatest(mine, o).alias("high")))
    columns = ["lang", "bucket", "number", "base", "term", "p", "sources"]
    own = shares.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets)).select(*columns)
    # every source has a part in every bucket, with its baseline alone
    bare = sources.where("kept > 0").withColumns({"bucket": F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)), "term": F.lit(None).cast("string"), "p": F.col("base")}).select(*columns)
    rows = own.unionByName(bare).withColumn("pair", F.explode(blocks)).select("lang", "bucket", "pair.low", "pair.high", "number", "base", "term", "p")

    def sums(key, frame):
        import pandas as pd

        lang, _, low, high = key
        alone = frame["term"].isna().to_numpy()
        numbers, bases = (frame[c].to_numpy(np.int64)[alone] for c in ("number", "base"))
        order = np.argsort(numbers)
        numbers, bases = numbers[order], bases[order]
        terms, t = np.unique(frame["term"].to_numpy(object)[~alone].astype(str), return_inverse=True)
        s = np.searchsorted(numbers, frame["number"].to_numpy(np.int64)[~alone])
        p = np.repeat(bases[:, None], len(terms), axis=1)
        p[s, t] = frame["p"].to_numpy(np.int64)[~alone]
        has = np.zeros(p.shape, bool)
        has[s, t] = True
        block = (numbers - 1) // BLOCK
        out = {"one": [], "other": [], "extra": []}
        for i in np.flatnonzero(block == low):
            others = np.flatnonzero((block == high) & (numbers > numbers[i]))
            gap = np.abs(bases[i] - bases[others])
            extra = np.where(has[i] | has[others], np.abs(p[i] - p[others]) - gap[:, None], 0).sum(1)
            for name, a in (("one", np.full(len(others), numbers[i])), ("other", numbers[others]), ("extra", extra)):
                out[name].append(a)
        return pd.DataFrame({"lang": lang} | {n: np.concatenate(a) if a else np.zeros(0, np.int64) for n, a in out.items()})

    parts = rows.groupBy("lang", "bucket", "low", "high").applyInPandas(sums, "lang string, one long, other long, extra long")
    return parts.groupBy("lang", "one", "other").agg(F.sum("extra").alias("extra"))


@tidy
def audit_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of ``docs``.

    Part ``pair``: every other source of the lang, by the summed difference of
    the two sources' shares of all kept terms.  Part ``term``: the first ``top``
    terms of which the source has a larger share than its lang.  Ranks go by
    value descending, then by the item's UTF-8 bytes.

    Terms are runs of letters A-Z, a-z and of whatever is not ASCII, A-Z
    lower-cased; a lang keeps those in at least ``least_docs`` of its documents.
    Null text, lang and source are ''; a group without terms takes part with its
    baseline alone, and where a lang keeps none, values are 0.  A row counts as a
    document, repeated ones too.  Texts are read whole, other columns do not
    matter, and an empty table gives no rows."""
    counts = saved(term_counts(docs))
    terms = saved(counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total")).where(F.col("_docs") >= least_docs).drop("_docs"))
    kept = saved(counts.join(terms, ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = kept.groupBy(*GROUP).agg(F.sum("n").alias("size"))
    groups = docs.select(*_groups()).distinct().join(langs, "lang", "left").join(sizes, GROUP, "left").na.fill(0, ["kept", "lang_size", "size"])
    # the sources of a lang are numbered; their pairs are the result anyway
    of_lang = Window.partitionBy("lang")
    sources = saved(groups.withColumns({"number": F.row_number().over(of_lang.orderBy("source")).cast("long"), "sources": F.count("*").over(of_lang), "base": _share("0", "size", "kept")}))
    rows = kept.join(sources, GROUP).withColumns({"p": _share("n", "size", "kept"), "q": _share("total", "lang_size", "kept")})
    extra = _pair_sums(rows, sources)
    both = saved(extra.unionByName(extra.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "extra")))
    other = sources.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("base").alias("other_base"))
    pairs = sources.withColumnRenamed("number", "one").join(other, "lang").where("one <> other").join(both, ["lang", "one", "other"], "left")
    value = F.col("kept") * F.abs(F.col("base") - F.col("other_base")) + F.coalesce("extra", F.lit(0))
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(by_value))
    ahead = saved(rows.where("n > 0 and p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    best = select_top(ahead, GROUP, "value", "item", top)
    return pairs.unionByName(best.withColumn("part", F.lit("term")))
