"""Exact quantiles and robust statistics for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. That is right for
groups of proven size; ``exact_quantiles`` is for the others: values are counted per (group,
value), spread over value bins, and only the bins that hold a wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS_PER_OCTAVE = 256


def value_bin(v: Column) -> Column:
    """Order-preserving bin of a finite double: 256 bins per power of two, sign kept."""
    size = F.abs(v)
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * PARTS_PER_OCTAVE)
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS_PER_OCTAVE - 1), part))
    bin_ = (exponent + 1100) * PARTS_PER_OCTAVE + part
    return F.coalesce(F.when(v < 0, -bin_).otherwise(bin_), F.lit(0)).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return (df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from ``keys, _v, _c``. A group is ordered bin by bin, never as a whole."""
    keys = list(keys)
    binned = counts.withColumn("_b", value_bin(F.col("_v")))
    whole = Window.partitionBy(*keys)
    upto = Window.unboundedPreceding, Window.currentRow
    bins = (binned.groupBy(*keys, "_b").agg(F.sum("_c").alias("_m"))
            .withColumn("n", F.sum("_m").over(whole))
            .withColumn("_start", F.sum("_m").over(whole.orderBy("_b").rowsBetween(*upto)) - F.col("_m")))

    def ranks(q: float) -> tuple[Column, Column]:
        low = F.floor(F.lit(float(q)) * (F.col("n") - 1))
        return low, F.least(low + 1, F.col("n") - 1)

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for q in probs.values():
        for r in ranks(q):
            wanted = wanted | holds(r, F.col("_start"), F.col("_m"))
    hit = binned.join(bins.where(wanted).drop("_m"), [*keys, "_b"])
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(*upto)
    hit = hit.withColumn("_at", F.col("_start") + F.sum("_c").over(inside) - F.col("_c"))
    picks = []
    for name, q in probs.items():
        for side, r in zip(("lo", "hi"), ranks(q)):
            picks.append(F.max(F.when(holds(r, F.col("_at"), F.col("_c")), F.col("_v"))).alias(f"_{side}_{name}"))
    got = hit.groupBy(*keys, "n").agg(*picks)
    out = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, "n", *out)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """One row per group: count ``n`` and linearly interpolated quantiles."""
    return quantiles_of_counts(value_counts(df, keys, F.col(value)), keys, probs)


def small_quantile(value: str | Column, q: float) -> Column:
    """Built-in exact quantile, for groups whose size is bounded by construction."""
    return F.percentile(value, F.lit(float(q)))


def robust_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, unscaled MAD, quartiles and count per group of any size."""
    keys = list(keys)
    counts = value_counts(df, keys, F.col(value))
    first = quantiles_of_counts(counts, keys, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    dev = (counts.join(first.select(*keys, "median"), keys)
           .select(*keys, F.abs(F.col("_v") - F.col("median")).alias("_v"), "_c")
           .groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")))
    mad = quantiles_of_counts(dev, keys, {"mad": 0.5}).select(*keys, "mad")
    return first.join(mad, keys)


def modified_z(value: Column, median: Column, mad: Column) -> Column:
    return F.when(mad == 0, F.lit(0.0)).otherwise(F.lit(0.6745) * (value - median) / mad)


def variation(value: str) -> Column:
    """Population standard deviation over the mean; 0 for fewer than two samples or a zero mean."""
    mean = F.avg(value)
    return F.when((F.count(value) < 2) | (mean == 0), F.lit(0.0)).otherwise(F.stddev_pop(value) / mean)


def axis_ratio(u: str, v: str) -> Column:
    """Major over minor semi-axis of a 2D point cloud, from the closed-form 2x2 eigenvalues."""
    a, b, c = F.covar_samp(u, u), F.covar_samp(v, v), F.covar_samp(u, v)
    mid, gap = (a + b) / 2, F.sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)
    major, minor = F.greatest(mid + gap, F.lit(1e-9)), F.greatest(mid - gap, F.lit(1e-9))
    return F.when(F.count(u) < 3, F.lit(1.0)).otherwise(F.sqrt(major) / F.sqrt(minor))
