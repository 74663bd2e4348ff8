"""Queries on segments and features of the bridged events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.config import WindowConfig
from pitchlake.operators import segments as seg
from pitchlake.operators.features import default_registry, extract_features
from pitchlake.operators.quality import null_rates
from pitchlake.plans.feature_sql import HULL, HULL_SQL, LEAST, OVERLAP, SEGMENTS_SQL, STEADY, TIER3_SQL, WINDOW, feature_names_sql, features_sql
from pitchlake.sources.bridge import EVENTS_SQL, match_contexts, match_events
from pitchlake.sources.store import materialised

#: Windows of four hours that overlap by 80 minutes: the bridged matches last a day.
CONFIG = WindowConfig(WINDOW, OVERLAP, LEAST)
KEYS = ("match_id", "team_id", "segment_type", "segment", "period")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def feature_table(spark: SparkSession, sf_dir: str, max_tier: int = 3) -> DataFrame:
    e = materialised(events(spark, sf_dir))
    return extract_features(seg.segment_events(e, CONFIG), match_contexts(e), max_tier)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def w1_pass_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    w = seg.window_events(e, CONFIG).join(match_contexts(e).select("match_id", F.col("team_id").alias("focal")), "match_id")
    own = F.col("team_id") == F.col("focal")
    ours = own & (F.col("event_type") == "pass")
    out = w.groupBy("match_id", "period", "segment", "start_time", "focal").agg(
        F.count_if(ours).alias("pass_count"), F.avg(F.when(ours, (F.col("event_outcome") == "complete").cast("double"))).alias("completion_rate"), F.avg(own.cast("double")).alias("possession_share")
    )
    return rounded(out.withColumnRenamed("focal", "team_id"))


def w1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seg.windows(events(spark, sf_dir), CONFIG))


def w2_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seg.windows(events(spark, sf_dir), WindowConfig(7200.0, 0.0, 3)))


def w4_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seg.possessions(events(spark, sf_dir)))


def w7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = seg.segment_events(events(spark, sf_dir), CONFIG)
    return e.groupBy("segment_type", "match_id", "period", "segment").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("team_id").alias("n_teams"))


def w8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seg.segment_statistics(events(spark, sf_dir), CONFIG))


def w8_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.possessions(events(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_set_piece").alias("set_pieces"))


def w8_mixed_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.mixed_periods(events(spark, sf_dir))


def tier(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    e = materialised(events(spark, sf_dir))
    names = [x for x in default_registry().feature_names(n) if x.startswith(f"t{n}_") and x not in HULL]
    out = extract_features(seg.segment_events(e, CONFIG), match_contexts(e), n)
    meta = [*KEYS, *(["start_time", "end_time", "match_minute"] if n < 3 else [])]
    # a mean of times in microseconds can lie exactly between two rounded values; a shift below the last digit decides alike
    shift = STEADY if n < 3 else 0.0
    return rounded(out.select(*meta, *[(F.col(x) + shift).alias(x) for x in names]))


def t3_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_table(spark, sf_dir).select(*KEYS, *HULL))


def x4_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = feature_table(spark, sf_dir)
    return rounded(t.select(*[(F.col(c) + STEADY).alias(c) if c.startswith(("t1_", "t2_")) else F.col(c) for c in t.columns]))


def x6_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feature_table(spark, sf_dir, 2)
    return rounded(null_rates(out, default_registry().feature_names(2)))


def x6_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir, 1).groupBy("segment_type", "period").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("match_id").alias("n_matches"))


def n17_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_contexts(events(spark, sf_dir))


QUERIES = {
    "w1_pass_windows": w1_pass_windows,
    "w1_windows": w1_windows,
    "w2_tumbling": w2_tumbling,
    "w4_possessions": w4_possessions,
    "w7_segments": w7_segments,
    "w8_statistics": w8_statistics,
    "w8_outcomes": w8_outcomes,
    "w8_mixed_periods": w8_mixed_periods,
    "f_tier1": partial(tier, n=1),
    "g_tier2": partial(tier, n=2),
    "h_tier3": partial(tier, n=3),
    "h3_hull": t3_hull,
    "x4_feature_table": x4_feature_table,
    "x6_null_rates": x6_null_rates,
    "x6_segment_counts": x6_segment_counts,
    "n17_contexts": n17_contexts,
}

_CTX = "CROSS JOIN (VALUES ('team_a'), ('team_b')) c(focal)"


def _null_rates_sql() -> str:
    names = feature_names_sql()
    one, two = (features_sql(n).rstrip() for n in (1, 2))
    both = f"WITH a AS ({one}), b AS ({two})"
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {n[1]}::INT AS tier, count(*) AS n_rows, count(*) - count({n}) AS n_null, round((count(*) - count({n}))::DOUBLE / count(*), 8) AS null_rate FROM {'a' if n[1] == '1' else 'b'}" for n in names
    )
    return f"{both} {parts}"


ORACLES = {
    "w1_pass_windows": f"""WITH {SEGMENTS_SQL}
SELECT match_id, period, segment, round(start_time, 8) AS start_time, focal AS team_id, count(*) FILTER (team_id = focal AND event_type = 'pass') AS pass_count,
       round(avg((event_outcome = 'complete')::INT::DOUBLE) FILTER (team_id = focal AND event_type = 'pass'), 8) AS completion_rate, round(avg((team_id = focal)::INT::DOUBLE), 8) AS possession_share
FROM seg {_CTX} WHERE segment_type = 'window' GROUP BY ALL""",
    "w1_windows": f"""WITH {SEGMENTS_SQL}
SELECT match_id, period, segment, round(start_time, 8) AS start_time, round(end_time, 8) AS end_time, round(min(match_minute), 8) AS match_minute_start, round(max(match_minute), 8) AS match_minute_end, count(*) AS n_events
FROM seg WHERE segment_type = 'window' GROUP BY match_id, period, segment, start_time, end_time""",
    "w2_tumbling": f"""WITH {EVENTS_SQL}, l AS (SELECT *, min(timestamp) OVER (PARTITION BY match_id, period) AS low FROM ev), w AS (SELECT *, floor((timestamp - low) / 7200)::BIGINT AS segment FROM l)
SELECT match_id, period, segment, round(low + segment * 7200.0::DOUBLE, 8) AS start_time, round(low + segment * 7200.0::DOUBLE + 7200.0::DOUBLE, 8) AS end_time,
       round(min(match_minute), 8) AS match_minute_start, round(max(match_minute), 8) AS match_minute_end, count(*) AS n_events FROM w GROUP BY match_id, period, segment, low HAVING count(*) >= 3""",
    "w4_possessions": f"""WITH {SEGMENTS_SQL}
SELECT match_id, period, segment, team_id, round(start_time, 8) AS start_time, round(end_time, 8) AS end_time, round(min(match_minute), 8) AS match_minute_start, round(max(match_minute), 8) AS match_minute_end,
       count(*) AS n_events, max(fin) AS outcome, arg_min(event_type, seq) LIKE 'set_piece%' AS is_set_piece, CASE WHEN arg_min(event_type, seq) LIKE 'set_piece%' THEN arg_min(event_type, seq) END AS set_piece_type
FROM pev WHERE n >= 3 GROUP BY match_id, period, segment, team_id, start_time, end_time""",
    "w7_segments": f"WITH {SEGMENTS_SQL} SELECT segment_type, match_id, period, segment, count(*) AS n_events, count(DISTINCT team_id) AS n_teams FROM seg GROUP BY ALL",
    "w8_statistics": f"""WITH {SEGMENTS_SQL}, n AS (SELECT segment_type, match_id, period, segment, count(*) AS n FROM seg GROUP BY ALL)
SELECT segment_type, count(*) AS segments, count(DISTINCT match_id) AS matches, round(avg(n), 8) AS mean, round(stddev_pop(n), 8) AS std, round(quantile_cont(n, 0.25), 8) AS q25,
       round(quantile_cont(n, 0.5), 8) AS median, round(quantile_cont(n, 0.75), 8) AS q75, min(n) AS least, max(n) AS most FROM n GROUP BY segment_type""",
    "w8_outcomes": f"""WITH {SEGMENTS_SQL}, p AS (SELECT match_id, segment, max(fin) AS outcome, arg_min(event_type, seq) LIKE 'set_piece%' AS sp FROM pev WHERE n >= 3 GROUP BY ALL)
SELECT outcome, count(*) AS n, count(*) FILTER (sp) AS set_pieces FROM p GROUP BY outcome""",
    "w8_mixed_periods": f"WITH {SEGMENTS_SQL} SELECT match_id, segment, count(DISTINCT period) AS periods FROM pev WHERE n >= 3 GROUP BY match_id, segment HAVING count(DISTINCT period) > 1",
    "f_tier1": features_sql(1),
    "g_tier2": features_sql(2),
    "h_tier3": TIER3_SQL,
    "h3_hull": HULL_SQL,
    "x4_feature_table": f"""SELECT a.*, b.* EXCLUDE (match_id, team_id, segment_type, segment, period, start_time, end_time, match_minute), c.* EXCLUDE (match_id, team_id, segment_type, segment, period), h.* EXCLUDE (match_id, team_id, segment_type, segment, period)
FROM ({features_sql(1)}) a JOIN ({features_sql(2)}) b USING (match_id, team_id, segment_type, segment, period) JOIN ({TIER3_SQL}) c USING (match_id, team_id, segment_type, segment, period) JOIN ({HULL_SQL}) h USING (match_id, team_id, segment_type, segment, period)""",
    "x6_null_rates": _null_rates_sql(),
    "x6_segment_counts": f"WITH {SEGMENTS_SQL} SELECT segment_type, period, 2 * count(DISTINCT (match_id, segment)) AS n_rows, count(DISTINCT match_id) AS n_matches FROM seg GROUP BY segment_type, period",
    "n17_contexts": f"""WITH {EVENTS_SQL}, m AS (SELECT match_id, bool_or(freeze_frame IS NOT NULL) AS has_360 FROM ev GROUP BY match_id)
SELECT match_id, t AS team_id, CASE WHEN t = 'team_a' THEN 'team_b' ELSE 'team_a' END AS opponent_id, t = 'team_a' AS team_is_home, has_360 FROM m CROSS JOIN (VALUES ('team_a'), ('team_b')) v(t)""",
}
