"""Data quality and exploratory reports on wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.quantiles import exact_quantiles


def _long(row: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """One row with a struct per column, as one row per column."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias("v")) for c in columns])).alias("s")).select(f"s.{name}", "s.v.*")


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: feature, tier, n_rows, n_null, null_rate, by one aggregation over the table."""
    n = F.count(F.lit(1))
    row = df.agg(*[F.struct(n.alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null")).alias(c) for c in columns])
    out = _long(row, columns, "feature").withColumn("null_rate", F.col("n_null") / F.nullif(F.col("n_rows").cast("double"), F.lit(0.0)))
    return out.select("feature", F.substring("feature", 2, 1).cast("int").alias("tier"), "n_rows", "n_null", "null_rate")


def null_rates_by(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Per value of ``by`` and tier: mean and highest null rate, number of columns with a rate above one half."""
    rates = df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = rates.unpivot(by, list(columns), "feature", "rate").withColumn("tier", F.substring("feature", 2, 1).cast("int"))
    return long.groupBy(by, "tier").agg(F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate"), F.count_if(F.col("rate") > 0.5).alias("n_sparse"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, nulls, mean, sample deviation, minimum, exact quartiles, maximum."""
    quarters = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    cells = []
    for c in columns:
        q = [F.lit(v).cast("double") for v in quarters[c]]
        cells.append(F.struct(F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max(c).alias("max")).alias(c))
    return _long(df.agg(*cells), columns, "feature")


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5, least: int = 10) -> DataFrame:
    """Per column with at least ``least`` values and a positive quartile range: n, n_outliers and their percentage (two digits)."""
    cells, quarters = [], exact_quantiles(df, columns, (0.25, 0.75))
    for c in columns:
        q1, q3 = quarters[c]
        if q1 is None or q3 <= q1:
            continue
        reach = factor * (q3 - q1)
        cells.append((c, F.struct(F.count(c).alias("n"), F.count_if((F.col(c) < q1 - reach) | (F.col(c) > q3 + reach)).alias("n_outliers")).alias(c)))
    if not cells:
        return df.sparkSession.createDataFrame([], "feature string, n bigint, n_outliers bigint, pct double")
    out = _long(df.agg(*[x for _, x in cells]), [c for c, _ in cells], "feature").where(F.col("n") >= least)
    return out.withColumn("pct", F.round(F.col("n_outliers") * 100.0 / F.col("n"), 2))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair a < b, 0 where undefined, from one aggregation of means and products."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.struct(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("s")).select("s.a", "s.b", "s.r")


def forward_filled(df: DataFrame, columns: Sequence[str], group: Sequence[str], order: Sequence[str | Column], default: float = 0.0) -> DataFrame:
    """Nulls become the last value before them in their group, else the default."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(default)) for c in columns})


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, n: equal bins from least to largest value; the last is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    out = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(b.cast("int").alias("bin"), "lo", "hi")  # one row of ends
    return out.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), "n")


def largest_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the k keys with most rows; ties go to the smaller key."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(k).select(key)
    return df.join(top, key, "left_semi")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def pair_counts(pairs: DataFrame, strong: float = 0.85, moderate: float = 0.70) -> DataFrame:
    """One row from correlations (a, b, r): number of pairs, and of those whose absolute value is above each bound."""
    r = F.abs("r")
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(r > strong).alias("n_strong"), F.count_if(r > moderate).alias("n_moderate"))


def distribution(df: DataFrame, column: str) -> str:
    """One line: count, least, quartiles, largest; for reports."""
    low, q1, q2, q3, high = exact_quantiles(df, [column], (0.0, 0.25, 0.5, 0.75, 1.0))[column]
    return "no values" if low is None else f"n={df.where(F.col(column).isNotNull()).count()} min={low:.1f} p25={q1:.1f} median={q2:.1f} p75={q3:.1f} max={high:.1f}"
