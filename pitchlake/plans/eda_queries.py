"""Exploratory queries: rates, correlations, outliers, histograms, top groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import quality
from pitchlake.plans.feature_queries import feature_table, rounded
from pitchlake.plans.feature_sql import features_sql

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", *NUMBERS)


def a1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def a3_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = feature_table(spark, sf_dir, 1)
    return rounded(quality.null_rates_by(t, [c for c in t.columns if c.startswith("t1_")], "segment_type"))


def a4_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.describe(_lines(spark, sf_dir), NUMBERS).select("feature", "n", "n_null", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])


def a5_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.correlations(_lines(spark, sf_dir), NUMBERS).withColumn("r", F.round("r", 6))


def a6_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.correlations(_lines(spark, sf_dir), NUMBERS)
    return r.orderBy(F.desc(F.abs("r")), "a", "b").limit(3).withColumn("r", F.round("r", 6))


def a7_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.countDistinct("l_quantity").alias("n_unique"))


def a8_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    return quality.largest_groups(o, "o_custkey", 8).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))


def a9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.iqr_outliers(_lines(spark, sf_dir), NUMBERS, factor=0.5)


def a10_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(_lines(spark, sf_dir), "l_quantity", 7).withColumn("low", F.round("low", 6))


def a5_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return quality.forward_filled(e, ["value"], ["user_id"], ["event_id"])


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return quality.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


QUERIES = {
    "a1_counts": a1_counts,
    "a3_null_rates": a3_null_rates,
    "a4_describe": a4_describe,
    "a5_correlations": a5_correlations,
    "a5_forward_fill": a5_forward_fill,
    "a6_strongest": a6_strongest,
    "a7_by_status": a7_by_status,
    "a8_top_customers": a8_top_customers,
    "a9_outliers": a9_outliers,
    "a10_histogram": a10_histogram,
    "a15_top_per_group": top_per_group,
}

_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS)
_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS n_null, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem"
    for c in NUMBERS
)
_IQR = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, quantile_cont({c}, 0.25) OVER () AS q1, quantile_cont({c}, 0.75) OVER () AS q3 FROM lineitem" for c in NUMBERS)


def _a3_sql() -> str:
    one = features_sql(1)
    names = [p.split(" AS ")[-1] for p in one.split("AS DOUBLE) AS ")[1:]]
    names = [n.split(",")[0].split(" ")[0] for n in names]
    rates = " UNION ALL ".join(f"SELECT segment_type, 1 AS tier, avg(({n} IS NULL)::INT::DOUBLE) AS rate FROM a GROUP BY segment_type" for n in names)
    return f"WITH a AS ({one}), r AS ({rates}) SELECT segment_type, tier, round(avg(rate), 8) AS mean_rate, round(max(rate), 8) AS max_rate, count(*) FILTER (rate > 0.5) AS n_sparse FROM r GROUP BY segment_type, tier"


ORACLES = {
    "a1_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL",
    "a3_null_rates": _a3_sql(),
    "a4_describe": _DESCRIBE,
    "a5_correlations": f"SELECT a, b, round(r, 6) AS r FROM ({_CORR})",
    "a5_forward_fill": "SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0.0) AS value FROM events",
    "a6_strongest": f"SELECT a, b, round(r, 6) AS r FROM ({_CORR}) ORDER BY abs(r) DESC, a, b LIMIT 3",
    "a7_by_status": "SELECT l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, count(DISTINCT l_quantity) AS n_unique FROM lineitem GROUP BY l_linestatus",
    "a8_top_customers": "WITH t AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 8) SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t) GROUP BY o_custkey",
    "a9_outliers": f"WITH x AS ({_IQR}), y AS (SELECT feature, count(*) AS n, count(*) FILTER (v < q1 - 0.5::DOUBLE * (q3 - q1) OR v > q3 + 0.5::DOUBLE * (q3 - q1)) AS n_outliers FROM x WHERE q3 > q1 GROUP BY feature) SELECT feature, n, n_outliers, round(n_outliers * 100.0::DOUBLE / n, 2) AS pct FROM y WHERE n >= 10",
    "a10_histogram": "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 7)), 6)::INT AS bin, lo, hi FROM lineitem, e) SELECT bin, round(lo + bin * ((hi - lo) / 7), 6) AS low, count(*) AS n FROM b GROUP BY bin, lo, hi",
    "a15_top_per_group": "WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT * FROM r WHERE rank <= 3",
}
