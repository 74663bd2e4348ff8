"""Events of any product as match events: the canonical schema from a table (event_id, ts, user_id, event_type, value, props).

A day is a match, its halves before and after noon are periods, users of even and odd id are the two teams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Event types in the order of their slots. Fixed values.
SOURCE_TYPES = ("view", "click", "purchase", "signup", "error")

#: Canonical type per slot, eight slots for each source type (event_id modulo 8).
SLOTS = (
    *("pass", "pass", "shot", "carry", "pressure", "pass", "ball_recovery", "tackle"),
    *("pass", "carry", "shot", "pressure", "pass", "interception", "duel", "pass"),
    *("pressure", "pass", "carry", "pass", "foul_committed", "clearance", "pass", "pressure"),
    *("pass", "tackle", "pass", "block", "ball_receipt", "carry", "set_piece_throw_in", "foul_won"),
    *("set_piece_corner", "pass", "interception", "substitution", "pass", "goal_keeper", "pressure", "dispossessed"),
)

HOME, AWAY = "team_a", "team_b"


def match_events(events: DataFrame) -> DataFrame:
    """One row per event in the canonical schema, with ``seq``, the place of the event in its match."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    slot = F.lit(8) * (F.array_position(F.array(*map(F.lit, SOURCE_TYPES)), F.col("event_type")).cast("long") - 1) + F.col("event_id") % 8
    i = F.col("event_id")
    frame = F.transform(
        F.sequence(F.lit(0).cast("long"), 3 + k % 8),
        lambda n: F.struct(
            F.concat(F.lit("p"), n.cast("string")).alias("player_id"),
            (n % 2 == 0).alias("teammate"),
            ((k * 7 + n * 13) % 101).cast("double").alias("x"),
            ((k * 11 + n * n * 29) % 101).cast("double").alias("y"),
            F.lit("unknown").alias("position"),
        ),
    )
    e = events.select(
        i.cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("match_id"),
        F.when(F.col("user_id") % 2 == 0, HOME).otherwise(AWAY).alias("team_id"),
        F.col("user_id").cast("string").alias("player_id"),
        F.when(F.hour("ts") < 12, 1).otherwise(2).alias("period"),
        (micros % 43_200_000_000 / F.lit(1e6)).alias("timestamp"),
        F.when(i % 17 != 0, k.cast("double")).alias("x"),
        F.when(i % 17 != 0, (F.round(F.col("value") * 100).cast("long") % 10_000) / F.lit(100.0)).alias("y"),
        F.when(i % 7 != 0, ((k * 37 + 11) % 100).cast("double")).alias("end_x"),
        F.when(i % 7 != 0, ((k * 53 + 29) % 100).cast("double")).alias("end_y"),
        F.element_at(F.array(*map(F.lit, SLOTS)), (slot + 1).cast("int")).alias("event_type"),
        F.element_at(F.array(F.lit("complete"), F.lit("incomplete"), F.lit("won")), (i % 3 + 1).cast("int")).alias("event_outcome"),
        (i % 5 == 0).alias("under_pressure"),
        F.when(i % 2 == 0, "right_foot").otherwise("left_foot").alias("body_part"),
        F.when(i % 4 == 0, frame).alias("freeze_frame"),
        i.alias("_i"),
    )
    e = e.withColumn("match_minute", F.lit(45.0) * (F.col("period") - 1) + F.col("timestamp") / 60)
    e = e.withColumn("team_is_home", F.col("team_id") == HOME)
    order = Window.partitionBy("match_id").orderBy("period", "timestamp", "_i")
    goal = (F.col("event_type") == "shot") & (F.col("_i") % 10 == 0)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("score_home", F.sum((goal & F.col("team_is_home")).cast("int")).over(so_far).cast("int"))
    e = e.withColumn("score_away", F.sum((goal & ~F.col("team_is_home")).cast("int")).over(so_far).cast("int"))
    return e.withColumn("seq", F.row_number().over(order).cast("long")).drop("_i")


def match_contexts(events: DataFrame) -> DataFrame:
    """Two rows per match, one from each team's point of view: match_id, team_id, opponent_id, team_is_home, has_360."""
    seen = events.groupBy("match_id").agg(F.bool_or(F.col("freeze_frame").isNotNull()).alias("has_360"))
    sides = F.array(
        F.struct(F.lit(HOME).alias("team_id"), F.lit(AWAY).alias("opponent_id"), F.lit(True).alias("team_is_home")),
        F.struct(F.lit(AWAY).alias("team_id"), F.lit(HOME).alias("opponent_id"), F.lit(False).alias("team_is_home")),
    )
    return seen.select("match_id", F.explode(sides).alias("s"), "has_360").select("match_id", "s.*", "has_360")


_TYPES = ", ".join(f"'{t}'" for t in SLOTS)
_SOURCES = ", ".join(f"'{t}'" for t in SOURCE_TYPES)

#: The same as SQL, the first common table expression of every check.
EVENTS_SQL = f"""
raw AS (
  SELECT event_id AS i, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         [{_TYPES}][8 * (list_position([{_SOURCES}], event_type) - 1) + event_id % 8 + 1] AS event_type
  FROM events),
e0 AS (
  SELECT CAST(i AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d') AS match_id, CASE WHEN user_id % 2 = 0 THEN 'team_a' ELSE 'team_b' END AS team_id,
         CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period, (epoch_us(ts) % 43200000000) / 1e6::DOUBLE AS timestamp,
         CASE WHEN i % 17 <> 0 THEN k::DOUBLE END AS x, CASE WHEN i % 17 <> 0 THEN (round(value * 100)::BIGINT % 10000) / 100.0::DOUBLE END AS y,
         CASE WHEN i % 7 <> 0 THEN ((k * 37 + 11) % 100)::DOUBLE END AS end_x, CASE WHEN i % 7 <> 0 THEN ((k * 53 + 29) % 100)::DOUBLE END AS end_y,
         event_type, ['complete', 'incomplete', 'won'][i % 3 + 1] AS event_outcome, i % 5 = 0 AS under_pressure,
         CASE WHEN i % 2 = 0 THEN 'right_foot' ELSE 'left_foot' END AS body_part,
         CASE WHEN i % 4 = 0 THEN list_transform(range(0, 4 + k % 8), lambda n: {{'teammate': n % 2 = 0, 'x': ((k * 7 + n * 13) % 101)::DOUBLE, 'y': ((k * 11 + n * n * 29) % 101)::DOUBLE}}) END AS freeze_frame, i
  FROM raw),
ev AS (
  SELECT *, 45.0::DOUBLE * (period - 1) + timestamp / 60 AS match_minute, team_id = 'team_a' AS team_is_home,
         sum(CASE WHEN event_type = 'shot' AND i % 10 = 0 AND team_id = 'team_a' THEN 1 ELSE 0 END) OVER w AS score_home,
         sum(CASE WHEN event_type = 'shot' AND i % 10 = 0 AND team_id = 'team_b' THEN 1 ELSE 0 END) OVER w AS score_away,
         row_number() OVER (PARTITION BY match_id ORDER BY period, timestamp, i) AS seq
  FROM e0 WINDOW w AS (PARTITION BY match_id ORDER BY period, timestamp, i ROWS UNBOUNDED PRECEDING))
"""
