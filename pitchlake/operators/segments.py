"""Segmentation: sliding windows and possession sequences, over all matches at once.

Both are plain expressions: a window's number follows from arithmetic on the event's time, a possession's from a running sum
of boundaries. Nothing is collected per match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.config import PossessionConfig, WindowConfig
from pitchlake.errors import SegmentationError

#: Keys of a segment.
KEYS = ("segment_type", "match_id", "period", "segment", "start_time", "end_time", "match_minute")

#: Event types by which play starts again after a stop. Fixed values.
SET_PIECES = ("set_piece_corner", "set_piece_free_kick", "set_piece_throw_in", "set_piece_goal_kick", "set_piece_kick_off", "set_piece_penalty")

#: Event types that belong to no possession. Fixed values.
OUTSIDE = ("substitution", "goal_keeper")


def window_events(events: DataFrame, config: WindowConfig | None = None) -> DataFrame:
    """Each event once per window that holds it, with the window's keys.

    Windows of a (match, period) start at its first event and every ``step`` seconds after; they are half open, and those with
    fewer than ``min_events`` events are left out.
    """
    c = config or WindowConfig()
    group = Window.partitionBy("match_id", "period")
    w, step = F.lit(float(c.seconds)), F.lit(float(c.step))
    e = events.withColumn("_low", F.min("timestamp").over(group)).withColumn("_rel", F.col("timestamp") - F.col("_low"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_rel") - w) / step) + 1)
    e = e.withColumn("segment", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("_rel") / step)))))
    start = F.col("_low") + F.col("segment") * step
    e = e.withColumn("start_time", start).withColumn("end_time", F.col("start_time") + w)
    if c.step > c.seconds:  # gaps between windows
        e = e.where((F.col("timestamp") >= F.col("start_time")) & (F.col("timestamp") < F.col("end_time")))
    inside = Window.partitionBy("match_id", "period", "segment")
    e = e.withColumn("_n", F.count(F.lit(1)).over(inside)).withColumn("_minute", F.min("match_minute").over(inside)).where(F.col("_n") >= c.min_events)
    own = [x for x in events.columns if x != "period"]
    return e.select(F.lit("window").alias("segment_type"), "period", "segment", "start_time", "end_time", F.col("_minute").alias("segment_minute"), *own)


def possession_events(events: DataFrame, config: PossessionConfig | None = None) -> DataFrame:
    """Each event of a possession with the possession's keys, its team and outcome.

    A possession ends at the period's end, where another team takes over (by a set piece: dead ball, else: turnover), and with a
    shot. Substitutions and goalkeeper events are passed over.
    """
    c = config or PossessionConfig()
    order = Window.partitionBy("match_id").orderBy("seq")
    e = events.where(~F.col("event_type").isin(*OUTSIDE))
    last_team, last_period, last_type = (F.lag(x).over(order) for x in ("team_id", "period", "event_type"))
    starts = last_team.isNull() | (last_period != F.col("period")) | (last_team != F.col("team_id")) | (last_type == "shot")
    e = e.withColumn("_new", starts.cast("int"))
    e = e.withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long") - 1)
    nxt_team, nxt_period, nxt_type = (F.lead(x).over(order) for x in ("team_id", "period", "event_type"))
    e = e.withColumn(
        "_end",
        F.when(F.col("event_type") == "shot", "shot")
        .when(nxt_team.isNull() | (nxt_period != F.col("period")), "end_of_period")
        .when(nxt_team != F.col("team_id"), F.when(nxt_type.isin(*SET_PIECES), "dead_ball").otherwise("turnover")),
    )
    inside = Window.partitionBy("match_id", "segment")
    e = e.withColumn("_n", F.count(F.lit(1)).over(inside)).where(F.col("_n") >= c.min_events)
    e = e.withColumn("start_time", F.min("timestamp").over(inside)).withColumn("end_time", F.max("timestamp").over(inside)).withColumn("segment_minute", F.min("match_minute").over(inside)).withColumn("possession_outcome", F.max("_end").over(inside))
    own = [x for x in events.columns if x != "period"]
    return e.select(F.lit("possession").alias("segment_type"), "period", "segment", "start_time", "end_time", "segment_minute", *own, "possession_outcome")


def windows(events: DataFrame, config: WindowConfig | None = None) -> DataFrame:
    """One row per window: keys, match_minute_start and _end, n_events."""
    e = window_events(events, config)
    return e.groupBy("match_id", "period", "segment", "start_time", "end_time").agg(F.min("match_minute").alias("match_minute_start"), F.max("match_minute").alias("match_minute_end"), F.count(F.lit(1)).alias("n_events"))


def possessions(events: DataFrame, config: PossessionConfig | None = None) -> DataFrame:
    """One row per possession: keys, team, times, outcome, whether and by which set piece it began."""
    e = possession_events(events, config)
    first = F.min_by("event_type", "seq")
    out = e.groupBy("match_id", "period", "segment", "team_id", "start_time", "end_time").agg(
        F.min_by("match_minute", "seq").alias("match_minute_start"), F.max_by("match_minute", "seq").alias("match_minute_end"), F.count(F.lit(1)).alias("n_events"), F.max("possession_outcome").alias("outcome"), first.alias("_first")
    )
    piece = F.col("_first").isin(*SET_PIECES)
    return out.withColumn("is_set_piece", piece).withColumn("set_piece_type", F.when(piece, F.col("_first"))).drop("_first")


def segment_events(events: DataFrame, window: WindowConfig | None = None, possession: PossessionConfig | None = None) -> DataFrame:
    """Windows and possessions together, tagged by ``segment_type``."""
    return window_events(events, window).unionByName(possession_events(events, possession).drop("possession_outcome"))


def require_events(events: DataFrame) -> DataFrame:
    """The same events; raises SegmentationError where there are none."""
    if events.isEmpty():
        raise SegmentationError("no events to segment")
    return events


def segment_statistics(events: DataFrame, window: WindowConfig | None = None, possession: PossessionConfig | None = None) -> DataFrame:
    """Per segment type: segments, matches, mean and population deviation, quartiles, least and most events per segment."""
    e = segment_events(events, window, possession)
    n = e.groupBy("segment_type", "match_id", "period", "segment").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = n.groupBy("segment_type").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("match_id").alias("matches"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), q.alias("q"), F.min("n").alias("least"), F.max("n").alias("most"))
    return out.select("segment_type", "segments", "matches", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "least", "most")


def mixed_periods(events: DataFrame, possession: PossessionConfig | None = None) -> DataFrame:
    """Possessions with events of several periods; always none."""
    return possession_events(events, possession).groupBy("match_id", "segment").agg(F.countDistinct("period").alias("periods")).where("periods > 1")
