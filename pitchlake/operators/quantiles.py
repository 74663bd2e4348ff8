"""Exact quantiles without a buffer of all values: approximate bounds, counts outside, order statistics of the few values between."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the approximate bounds: ranks are off by at most one part in so many.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its interpolated quantiles (None without values). Nulls are left out.

    Pass one bounds each quantile from both sides by an approximate percentile. Pass two counts the values below the bounds, pass three
    sorts the distinct values between them by a window, which spills; ties at the bounds cost nothing, as values come with their counts.
    Should a bound miss its quantile, that quantile is looked for among all values.
    """
    columns, shares, slack = list(columns), list(shares), 2 / ACCURACY
    around = [min(1.0, max(0.0, q + s * slack)) for q in shares for s in (-1, 1)]
    data = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    first = data.agg(*[F.struct(F.count(f"_{i}").alias("n"), F.percentile_approx(f"_{i}", around, ACCURACY).alias("b"), F.min(f"_{i}").alias("low"), F.max(f"_{i}").alias("high")).alias(f"_{i}") for i in range(len(columns))]).first()
    wanted, out = {}, {c: [None] * len(shares) for c in columns}
    for i in range(len(columns)):
        if first[i].n:
            for j, q in enumerate(shares):
                wanted[i, j] = first[i].b[2 * j], first[i].b[2 * j + 1], q * (first[i].n - 1)
    while wanted:
        keys = sorted(wanted)
        between = [F.when(F.col(f"_{i}").between(wanted[i, j][0], wanted[i, j][1]), F.struct(F.lit(at).alias("at"), F.col(f"_{i}").alias("v"))) for at, (i, j) in enumerate(keys)]
        counts = data.agg(*[F.count_if(F.col(f"_{i}") < wanted[i, j][0]) for i, j in keys]).first()
        values = data.select(F.explode(F.filter(F.array(*between), lambda s: s.isNotNull())).alias("s")).groupBy("s.at", "s.v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranks = [float(wanted[k][2]) - counts[at] for at, k in enumerate(keys)]
        rank = F.element_at(F.array(*[F.lit(r) for r in ranks]), F.col("at") + 1)
        hit = (F.col("upto") > F.floor(rank)) & (F.col("upto") - F.col("n") <= F.ceil(rank))
        found = values.withColumn("upto", upto).where(hit).select("at", "v", "n", "upto").collect()
        missed = {}
        for at, (i, j) in enumerate(keys):
            low, high = math.floor(ranks[at]), math.ceil(ranks[at])
            own = sorted((r.upto, r.n, r.v) for r in found if r["at"] == at)
            a, b = (next((v for upto, n, v in own if upto - n <= k < upto), None) for k in (low, high))
            if a is None or b is None:
                missed[i, j] = first[i].low, first[i].high, wanted[i, j][2]
            else:
                out[columns[i]][j] = a + (b - a) * (ranks[at] - low)
        wanted = missed if missed != wanted else {}
    return out
