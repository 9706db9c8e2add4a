"""Running sums and positions that no single task has to do for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of fewer rows than this are one slice.
LEAST_ROWS = 16384
#: A slice of a large group is about as many rows, up to 16 times the slices asked for.
SLICE_ROWS = 65536


def same_group(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` on ``by``, where a missing key is a key like any other."""
    other = other.withColumnsRenamed({b: f"_j_{b}" for b in by})
    return df.join(other, [F.col(f"`{b}`").eqNullSafe(F.col(f"`_j_{b}`")) for b in by], how).drop(*[f"_j_{b}" for b in by])


def of_large(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``same_group`` where ``other`` has a few rows for each group of at least LEAST_ROWS, and so stays small beside ``df``."""
    return same_group(df, F.broadcast(other), by, how)


def sliced(df: DataFrame, by: list[str], key: Column, descending: bool = False, slices: int = 16, spread: Column | None = None, evenly: float | None = None) -> DataFrame:
    """``df`` with ``_key`` and ``_slice``: a large group's rows in the order of ``key``
    are cut at its quantiles, so that a group with a third of all rows is spread over ``slices`` tasks or more.

    Equal keys share a slice, unless ``spread`` is given: then a key that makes up
    whole slices is cut at quantiles of that.  With ``evenly``, keys are spread evenly
    from 0 up to that, and are cut without being looked at.  Null keys come first.  Groups of fewer
    than LEAST_ROWS rows have a null ``_slice``; of them only the number is looked at."""
    more = {"_spread": spread.cast("double")} if spread is not None else {}
    rows = df.withColumns({"_key": key.cast("double")} | more)
    finest = 16 * slices
    points = [i / finest for i in range(1, finest)]
    quantiles = lambda c: F.percentile_approx(c, points, 4 * finest)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= LEAST_ROWS)
    step = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.lit(finest * SLICE_ROWS) / F.col("_rows"))))
    if evenly is not None:
        rows = of_large(rows, sizes.select(*[F.col(f"`{b}`") for b in by], step.alias("_step")), by, "left")
        slot = F.when(F.col("_key").isNull(), -1).otherwise(F.floor((evenly - F.col("_key") if descending else F.col("_key")) * finest / evenly / F.col("_step")))
        return rows.withColumn("_slice", F.when(F.col("_step").isNotNull(), slot)).drop("_step", "_spread")
    cuts = of_large(rows.select(*[F.col(f"`{b}`") for b in by], "_key", *more), sizes, by)
    cuts = cuts.groupBy(*by).agg(F.first("_rows").alias("_rows"), quantiles("_key").alias("_cuts"), *[quantiles("_spread").alias("_inner")] * bool(more))
    thin = lambda c: F.filter(c, lambda _, i: (i + 1) % step == 0).alias(c)
    # without any key that is not null there is nothing to cut at
    cuts = cuts.withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<double>")))
    rows = of_large(rows, cuts.select(*[F.col(f"`{b}`") for b in by], thin("_cuts"), *[thin("_inner")] * bool(more)), by, "left")
    past = (lambda c: c > F.col("_key")) if descending else (lambda c: c < F.col("_key"))
    count = lambda a, f: F.coalesce(F.size(F.filter(a, f)), F.lit(0))
    slot = F.when(F.col("_key").isNull(), -1).otherwise(count("_cuts", past)) * (2 * finest)
    if more:
        # a key that is two cuts or more fills a slice by itself
        often = count("_cuts", lambda c: c == F.col("_key")) >= 2
        slot = slot + F.when(often, count("_inner", lambda c: c < F.col("_spread"))).otherwise(0)
    return rows.withColumn("_slice", F.when(F.col("_cuts").isNotNull(), slot)).drop("_cuts", "_inner", "_spread")


def running(df: DataFrame, by: list[str], key: Column, ties: list[Column], sums: dict[str, Column], descending: bool = False, slices: int = 16, spread: Column | None = None, most: dict[str, Column] | None = None, whole: dict[str, Column] | None = None, evenly: float | None = None) -> DataFrame:
    """``df`` with ``rank`` (1, 2, ...) and, for each of ``sums``, its running
    total up to and including the row, in the order of ``key``, then ``ties``;
    for each of ``most``, the largest value so far (null where there is none); for
    each of ``whole``, the total of the group.

    Each slice of a large group (``sliced``) is ordered by itself, and what the slices
    before come to is added.  ``spread`` is a number that never falls along
    ``ties``.  Null keys come first.  Rows are shuffled once, for that ordering; but
    ``df`` is gone through four times (three with ``evenly``, see ``sliced``), so it had better be a table.
    """
    most, whole = most or {}, whole or {}
    values = {f"_s_{n}": c for n, c in sums.items()} | {f"_m_{n}": c for n, c in most.items()} | {f"_w_{n}": c for n, c in whole.items()}
    rows = sliced(df.withColumns({"_one": F.lit(1).cast("long")} | values), by, key, descending, slices, spread, evenly)
    parts = {"rank": "_one"} | {n: f"_s_{n}" for n in sums}
    names = [F.col(f"`{b}`") for b in by]
    totals = rows.where("_slice is not null").groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in parts.items()], *[F.max(f"_m_{n}").alias(f"_t_{n}") for n in most], *[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in whole])
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in parts] + [F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in most]
    earlier += [F.sum(f"_t_{n}").over(Window.partitionBy(*names)).alias(f"_o_{n}") for n in whole]
    rows = of_large(rows, totals.select(*names, "_slice", *earlier), [*by, "_slice"], "left")
    order = F.col("_key").desc_nulls_first() if descending else F.col("_key").asc_nulls_first()
    slice_ = Window.partitionBy(*names, "_slice")
    w = slice_.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {n: (F.sum(c).over(w) + F.coalesce(f"_o_{n}", F.lit(0))) for n, c in parts.items()}
    out |= {n: F.greatest(F.max(f"_m_{n}").over(w), F.col(f"_o_{n}")) for n in most}
    out |= {n: F.coalesce(F.col(f"_o_{n}"), F.sum(f"_w_{n}").over(slice_)) for n in whole}
    return rows.withColumns(out).drop("_key", "_one", "_slice", *values, *[f"_o_{n}" for n in [*parts, *most, *whole]])
