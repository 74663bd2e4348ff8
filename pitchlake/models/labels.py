"""Sequences of state labels: smoothing, flicker, agreement, separation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the silhouette, about.
BLOCK = 4096


def smooth(df: DataFrame, label: str, group: Sequence[str], order: Sequence[str], size: int = 5, out: str | None = None) -> DataFrame:
    """The most frequent label of a centred window (an even size counts one more), the smallest of ties; a size up to 1 changes nothing."""
    out = out or f"{label}_smoothed"
    if size <= 1:
        return df.withColumn(out, F.col(label))
    half = size // 2
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-half, half)
    near = F.collect_list(label).over(w)
    counted = F.transform(F.array_distinct(near), lambda x: F.struct((-F.size(F.filter(near, lambda y: y == x))).alias("n"), x.alias("label")))
    return df.withColumn(out, F.array_min(counted)["label"])


def flicker_rate(df: DataFrame, label: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row: flicker_rate, the mean over sequences of two rows or more of the share of changes; 0 without such."""
    w = Window.partitionBy(*group).orderBy(*order)
    rates = df.withColumn("_c", (F.col(label) != F.lag(label).over(w)).cast("int")).groupBy(*group).agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rates.agg(F.coalesce(F.avg(F.col("c") / (F.col("n") - 1)), F.lit(0.0)).alias("flicker_rate"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari (adjusted Rand index) and nmi (mutual information by the mean of both entropies), from the contingency table."""
    t = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    t = t.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    pairs = lambda x: x * (x - 1) / 2
    n, na, nb = (F.col(x).cast("double") for x in ("n", "na", "nb"))
    total = df.agg(F.count(F.lit(1)).cast("double").alias("m"))
    x = t.crossJoin(F.broadcast(total))  # one row
    s = x.agg(
        F.sum(pairs(n)).alias("both"),
        F.sum(pairs(na) * n / na).alias("pa"),
        F.sum(pairs(nb) * n / nb).alias("pb"),
        F.max("m").alias("m"),
        F.sum(n / F.col("m") * F.log(n * F.col("m") / (na * nb))).alias("mi"),
        F.sum(-n / F.col("m") * F.log(na / F.col("m"))).alias("ha"),
        F.sum(-n / F.col("m") * F.log(nb / F.col("m"))).alias("hb"),
    )
    chance = F.col("pa") * F.col("pb") / F.nullif(pairs(F.col("m")), F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(F.abs(top - chance) < 1e-12, 1.0).otherwise((F.col("both") - chance) / (top - chance))
    nmi = F.when(F.col("ha") + F.col("hb") < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)))
    return s.select(ari.alias("ari"), nmi.alias("nmi"))


def _distance_sums(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, kx: int, ky: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of Euclidean distances: of each row of x to the clusters of y, and of each row of y to the clusters of x.

    Squares are |u|² + |v|² - 2uv, and sums of squared differences where so little is left that digits would be lost.
    """
    member = np.zeros((len(y), ky))
    member[np.arange(len(y)), cy] = 1
    to_y, to_x = np.zeros((len(x), ky)), np.zeros((kx, len(y)))
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    step = max(1, (1 << 22) // max(1, y.size))
    for i in range(0, len(x), step):
        u = x[i : i + step]
        scale = xx[i : i + step, None] + yy[None]
        square = scale - 2 * (u @ y.T)
        a, b = np.nonzero(square <= 1e-4 * scale)
        square[a, b] = ((u[a] - y[b]) ** 2).sum(1)
        d = np.sqrt(square)
        to_y[i : i + step] = d @ member
        np.add.at(to_x, cx[i : i + step], d)
    return to_y, to_x.T


def silhouette(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """One row: the mean silhouette by Euclidean distance; -1 with fewer than two labels or as many labels as rows.

    Exact: every pair of rows is measured once, in pairs of blocks of about BLOCK rows, and what leaves a pair is each row's sum of
    distances per cluster. Work grows with the square of the rows. ``key`` is unique. A row without vector or label counts as 0.
    """
    every = df.select(F.col(key).alias("i"), F.col(vector).alias("e"), F.col(label).alias("c"))
    n = every.count()
    blocks = max(1, -(-n // BLOCK))
    rows = every.where(F.col("e").isNotNull() & F.col("c").isNotNull()).withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    last = F.lit(blocks - 1)
    left = rows.select("i", "e", "c", F.lit(True).alias("first"), F.col("b").alias("b1"), F.explode(F.sequence(F.col("b"), last)).alias("b2"))
    right = rows.select("i", "e", "c", F.lit(False).alias("first"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b1"), F.col("b").alias("b2"))
    kinds = {f.name: f.dataType for f in every.schema}
    schema = f"i {kinds['i'].simpleString()}, ci {kinds['c'].simpleString()}, cj {kinds['c'].simpleString()}, s double"

    def run(key: tuple, both: pa.Table) -> pa.Table:
        x, y, parts = both.filter(both.column("first")), both.filter(pc.invert(both.column("first"))), []
        if len(x) and len(y):
            (ex, vx, cx), (ey, vy, cy) = ((np.array(t.column("e").to_pylist(), dtype=float), *_coded(t.column("c"))) for t in (x, y))
            to_y, to_x = _distance_sums(ex, ey, cx, cy, len(vx), len(vy))
            parts = [(x, vy, to_y)] if key[0].as_py() == key[1].as_py() else [(x, vy, to_y), (y, vx, to_x)]
        tables = [pa.table({"i": t.column("i"), "ci": t.column("c"), "cj": pa.array([v] * len(t), t.schema.field("c").type), "s": sums[:, j]}) for t, values, sums in parts for j, v in enumerate(values)]
        return pa.concat_tables(tables) if tables else pa.table({"i": x.column("i")[:0], "ci": x.column("c")[:0], "cj": x.column("c")[:0], "s": pa.array([], pa.float64())})

    sums = left.unionByName(right).groupBy("b1", "b2").applyInArrow(run, schema).groupBy("i", "ci", "cj").agg(F.sum("s").alias("s"))
    sizes = rows.groupBy(F.col("c").alias("cj")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("ci") == F.col("cj")
    by = sums.join(sizes, "cj").select("i", own.alias("own"), (F.col("s") / F.nullif(F.col("n") - own.cast("int"), F.lit(0))).alias("d"))
    per = by.groupBy("i").agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    facts = every.agg(F.struct(F.countDistinct("c").alias("k"), F.count(F.lit(1)).alias("n")).alias("f"))
    return per.agg(F.sum(s).alias("s")).crossJoin(facts).select(F.when((F.col("f.k") < 2) | (F.col("f.k") >= F.col("f.n")), -1.0).otherwise(F.col("s") / F.col("f.n")).alias("silhouette"))


def _coded(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """The distinct values, and each value's place among them."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def soft_assignment(df: DataFrame, vector: str, centres: Sequence[Sequence[float]], keys: Sequence[str]) -> DataFrame:
    """keys and prob_0 ...: softmax of the negative Euclidean distances to centres."""
    v = F.col(vector).cast("array<double>")
    dist = [F.sqrt(F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in centres]
    e = df.select(*keys, *[d.alias(f"_d{i}") for i, d in enumerate(dist)])
    least = F.least(*[F.col(f"_d{i}") for i in range(len(centres))]) if len(centres) > 1 else F.col("_d0")
    w = [F.exp(least - F.col(f"_d{i}")) for i in range(len(centres))]
    return e.select(*keys, *[(x / sum(w[1:], w[0])).alias(f"prob_{i}") for i, x in enumerate(w)])


def vae_loss(df: DataFrame, x: str, recon: str, mu: str, logvar: str, beta: float = 4.0) -> DataFrame:
    """One row: reconstruction (mean squared error), divergence, loss of a variational autoencoder's outputs."""
    sq = F.aggregate(F.zip_with(x, recon, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    kl = F.aggregate(F.zip_with(mu, logvar, lambda m, v: 1 + v - m * m - F.exp(v)), F.lit(0.0), lambda s, v: s + v)
    s = df.agg((F.sum(sq) / F.sum(F.size(x))).alias("reconstruction"), (-0.5 * F.sum(kl) / F.sum(F.size(mu))).alias("divergence"))
    return s.withColumn("loss", F.col("reconstruction") + beta * F.col("divergence"))
