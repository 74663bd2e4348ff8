"""Queries on provider normalisation, over raw events made from the table events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions.expressions import file_size
from pitchlake.sources import provider
from pitchlake.sources.bridge import EVENTS_SQL
from pitchlake.operators.features import match_sides
from pitchlake.plans.feature_queries import events, rounded
from pitchlake.sources.store import hconcat, match_summary

#: Raw types by event_id modulo 10. Fixed values.
RAW_TYPES = ("Pass", "Pass", "Shot", "Carry", "Pressure", "Duel", "Ball Receipt*", "Dribble", "Tactical Shift", "Goal Keeper")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider events: id, index, type, sub-types, clock, places of a 120 by 80 pitch."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") % 43_200_000
    k = F.get_json_object("props", "$.k").cast("double")
    y = F.round(F.col("value") * 100).cast("long") % 8000 / F.lit(100.0)
    text = F.format_string("%02d:%02d:%06.3f", F.floor(ms / 3_600_000).cast("int"), (F.floor(ms / 60_000) % 60).cast("int"), (ms % 60_000) / 1000.0)
    return e.select(
        i.cast("string").alias("id"),
        i.alias("index"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("match_id"),
        F.when(i % 97 == 0, "Starting XI").otherwise(F.element_at(F.array(*map(F.lit, RAW_TYPES)), (i % 10 + 1).cast("int"))).alias("type"),
        F.when(F.hour("ts") < 12, 1).otherwise(2).alias("period"),
        F.floor(ms / 60_000).cast("int").alias("minute"),
        (F.floor(ms / 1000) % 60).cast("int").alias("second"),
        text.alias("timestamp"),
        (F.col("user_id") % 2 + 1).cast("int").alias("team_id"),
        F.when(i % 13 != 0, F.col("user_id").cast("double")).alias("player_id"),
        F.when(i % 17 != 0, F.array(k * 1.2, y)).alias("location"),
        F.when(i % 5 == 0, True).alias("under_pressure"),
        F.when(i % 9 == 0, "Corner").when(i % 9 == 1, "Free Kick").when(i % 9 == 2, "Recovery").alias("pass_type"),
        F.when(i % 3 != 0, "Incomplete").alias("pass_outcome"),
        F.when(i % 3 == 0, "Right Foot").alias("pass_body_part"),
        F.when(i % 7 != 0, F.array(y * 1.5, k * 0.8)).alias("pass_end_location"),
        F.when(i % 4 == 0, "Penalty").otherwise("Open Play").alias("shot_type"),
        F.when(F.floor(i / 10) % 5 == 0, "Goal").when(F.floor(i / 10) % 5 == 1, "Off T").alias("shot_outcome"),
        F.when(i % 2 == 1, "Tackle").otherwise("Aerial Lost").alias("duel_type"),
        F.when(i % 6 == 1, "Incomplete").alias("ball_receipt_outcome"),
    )


def n13_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(provider.normalise_events(raw_events(spark, sf_dir)).drop("freeze_frame"))


def n7_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provider.skipped_types(raw_events(spark, sf_dir))


def n16_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = provider.check_vocabulary(events(spark, sf_dir))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def s6_supports_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provider.supports_360(events(spark, sf_dir))


def s16_download_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_summary(events(spark, sf_dir).withColumn("dataset", F.substring("match_id", 1, 9)))


def n20_dataset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    known = e.select("match_id").distinct().where(F.col("match_id") < "2024-01-20").select("match_id", F.substring("match_id", 1, 9).alias("dataset"))
    return e.join(known, "match_id", "left").groupBy(F.coalesce("dataset", F.lit("unknown")).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


def n22_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", file_size(F.col("n_chars") * 64).alias("size"))


def j7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each freeze frame the least distance between the two sides, a nested loop inside the row."""
    e = events(spark, sf_dir).where(F.col("freeze_frame").isNotNull())
    mates, others = F.filter("freeze_frame", lambda p: p["teammate"]), F.filter("freeze_frame", lambda p: ~p["teammate"])
    near = F.array_min(F.transform(mates, lambda t: F.array_min(F.transform(others, lambda o: F.sqrt((t["x"] - o["x"]) * (t["x"] - o["x"]) + (t["y"] - o["y"]) * (t["y"] - o["y"]))))))
    return rounded(e.select("event_id", near.alias("nearest")))


def _day(e: DataFrame) -> DataFrame:
    return e.withColumn("match_id", F.date_format("ts", "yyyyMMdd").cast("int")).withColumn("team_id", (F.col("user_id") % 2 + 1).cast("int"))


def _spot(a: int, b: int, n: Column, k: Column) -> Column:
    return F.array(((k * a + n * 11) % 120).cast("double"), ((k * b + n * 17) % 80).cast("double"))


def raw_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw events with shot frames (player and position), and 360 frames (neither) of a third of the events."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    nine = lambda n: F.when((i + n) % 7 != 0, _spot(3, 5, n, k))
    frame = F.transform(F.sequence(F.lit(0).cast("long"), i % 4), lambda n: F.struct((n % 2 == 0).alias("teammate"), (n == 0).alias("actor"), F.lit(False).alias("keeper"), nine(n).alias("location")))
    frames = e.where(i % 3 == 0).select(i.cast("string").alias("event_uuid"), F.when(i % 27 != 0, frame).alias("freeze_frame"))
    named = lambda n: F.struct((n + 100).cast("int").alias("id"), F.lit("some").alias("name"))
    role = F.struct(F.lit(3).alias("id"), F.lit("Center Back").alias("name"))
    shot = F.transform(F.sequence(F.lit(0).cast("long"), i % 3), lambda n: F.struct(_spot(7, 2, n, k).alias("location"), F.when(n > 0, named(n)).alias("player"), role.alias("position"), (n % 2 == 1).alias("teammate")))
    shots = e.where(i % 10 == 2).select(i.cast("string").alias("id"), shot.alias("shot_freeze_frame"))
    return raw_events(spark, sf_dir).join(shots, "id", "left"), frames


def n11_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player of every freeze frame: of 360 frames, else of shots."""
    raw, frames = raw_frames(spark, sf_dir)
    e = provider.normalise_events(raw, frames).where(F.col("freeze_frame").isNotNull())
    return rounded(e.select("event_id", F.posexplode("freeze_frame").alias("place", "p")).select("event_id", "place", "p.*"))


def s2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of nested raw rows, one a day."""
    e = _day(spark.read.parquet(f"{sf_dir}/events.parquet"))
    days = e.groupBy("match_id").agg(F.count_if(F.col("team_id") == 1).alias("a"), F.count_if(F.col("team_id") == 2).alias("b"), F.min(F.date_format("ts", "yyyy-MM-dd")).alias("match_date"))
    raw = days.select(
        "match_id",
        "match_date",
        F.struct(F.lit("Cup").alias("competition_name")).alias("competition"),
        F.struct(F.substring("match_date", 1, 4).alias("season_name")).alias("season"),
        F.struct((F.col("match_id") % 10).alias("home_team_id"), F.lit("Even").alias("home_team_name")).alias("home_team"),
        F.struct((F.col("match_id") % 7).alias("away_team_id"), F.lit("Odd").alias("away_team_name")).alias("away_team"),
        F.col("a").alias("home_score"),
        F.col("b").alias("away_score"),
    )
    return provider.list_matches(raw)


def n14_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups of nested raw rows: the users of a day, their spells and cards."""
    e = _day(spark.read.parquet(f"{sf_dir}/events.parquet")).select("match_id", "team_id", "user_id").distinct()
    u = F.col("user_id")
    spell = F.struct(F.lit(1).alias("position_id"), F.lit("Wing").alias("position"), F.lit("00:00").alias("from"), F.lit(None).cast("string").alias("to"), F.lit(1).alias("from_period"), F.lit(None).cast("int").alias("to_period"), F.when(u % 3 != 0, F.when(u % 2 == 0, "Starting XI").otherwise("Substitution - On (Tactical)")).alias("start_reason"), F.lit("Final Whistle").alias("end_reason"))
    card = F.struct(F.lit("10:00").alias("time"), F.lit("Yellow Card").alias("card_type"), F.when(u % 10 == 0, "Foul Committed").alias("reason"), F.lit(1).alias("period"))
    player = F.struct(u.alias("player_id"), F.concat(F.lit("p"), u.cast("string")).alias("player_name"), F.when(u % 6 != 0, (u % 30).cast("int")).alias("jersey_number"), F.when(u % 4 != 0, F.array_repeat(spell, (u % 3 + 1).cast("int"))).alias("positions"), F.when(u % 5 == 0, F.array(card)).alias("cards"))
    raw = e.select("match_id", "team_id", player.alias("p")).groupBy("match_id", "team_id").agg(F.collect_list("p").alias("lineup")).withColumn("team_name", F.lit("Team"))
    out = provider.normalise_lineups(raw)
    return out.select("match_id", "team_id", "team_name", "player_id", "player_name", "jersey_number", "starter", F.size("positions").alias("n_positions"), F.size("cards").alias("n_cards"), F.get("positions", F.lit(0))["start_reason"].alias("start_reason"), F.get("cards", F.lit(0))["reason"].alias("card_reason"))


def j9_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of the same vectors side by side, matched by key."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    left = v.select("vec_id", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"a{i}") for i in range(3)])
    right = v.orderBy(F.desc("vec_id")).select("vec_id", F.size("embedding").alias("n"), "label")
    return hconcat([left, right], ["vec_id"])


def j4_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both teams' points of view of each match, from its events alone."""
    return match_sides(events(spark, sf_dir))


QUERIES = {
    "j4_sides": j4_sides,
    "n11_frames": n11_frames,
    "s2_matches": s2_matches,
    "n14_lineups": n14_lineups,
    "j9_side_by_side": j9_side_by_side,
    "n13_normalised": n13_normalised,
    "n7_skipped": n7_skipped,
    "n16_vocabulary": n16_vocabulary,
    "s6_supports_360": s6_supports_360,
    "s16_download_summary": s16_download_summary,
    "n20_dataset_map": n20_dataset_map,
    "n22_sizes": n22_sizes,
    "j7_nearest": j7_nearest,
}

_RAW = ", ".join(f"'{t}'" for t in RAW_TYPES)

RAW_SQL = f"""
r0 AS (SELECT event_id AS i, CAST(strftime(ts, '%Y%m%d') AS INT) AS match_id, CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS period, (epoch_us(ts) // 1000) % 43200000 AS ms, user_id % 2 + 1 AS team_id, user_id,
        CASE WHEN event_id % 97 = 0 THEN 'Starting XI' ELSE [{_RAW}][event_id % 10 + 1] END AS type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, (round(value * 100)::BIGINT % 8000) / 100.0::DOUBLE AS y FROM events),
r1 AS (SELECT *, CASE WHEN type = 'Pass' THEN CASE i % 9 WHEN 0 THEN 'set_piece_corner' WHEN 1 THEN 'set_piece_free_kick' ELSE 'pass' END
        WHEN type = 'Shot' AND i % 4 = 0 THEN 'set_piece_penalty' WHEN type = 'Shot' THEN 'shot' WHEN type = 'Duel' AND i % 2 = 1 THEN 'tackle' WHEN type = 'Duel' THEN 'duel'
        WHEN type IN ('Carry', 'Dribble') THEN 'carry' WHEN type = 'Pressure' THEN 'pressure' WHEN type = 'Ball Receipt*' THEN 'ball_receipt' WHEN type = 'Goal Keeper' THEN 'goal_keeper' END AS event_type,
        CASE (i // 10) % 5 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Off T' END AS so FROM r0),
h AS (SELECT match_id, arg_min(team_id, i) AS home FROM r1 WHERE type = 'Starting XI' GROUP BY match_id),
r2 AS (SELECT r1.*, coalesce(team_id = home, false) AS at_home,
        sum(CASE WHEN type = 'Shot' AND so = 'Goal' AND coalesce(team_id = home, false) THEN 1 ELSE 0 END) OVER w AS score_home,
        sum(CASE WHEN type = 'Shot' AND so = 'Goal' AND NOT coalesce(team_id = home, false) THEN 1 ELSE 0 END) OVER w AS score_away
       FROM r1 LEFT JOIN h USING (match_id) WINDOW w AS (PARTITION BY match_id ORDER BY period, i ROWS UNBOUNDED PRECEDING))
"""

ORACLES = {
    "j4_sides": f"""WITH {EVENTS_SQL}, t AS (SELECT match_id, team_id, bool_or(team_is_home) AS team_is_home, bool_or(freeze_frame IS NOT NULL) AS f FROM ev GROUP BY ALL)
SELECT a.match_id, a.team_id, b.team_id AS opponent_id, a.team_is_home, a.f OR b.f AS has_360 FROM t a JOIN t b ON a.match_id = b.match_id AND a.team_id <> b.team_id""",
    "n13_normalised": f"""WITH {RAW_SQL}
SELECT CAST(i AS VARCHAR) AS event_id, CAST(match_id AS VARCHAR) AS match_id, CAST(team_id AS VARCHAR) AS team_id, CASE WHEN i % 13 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS player_id, period,
  round(ms / 1000.0::DOUBLE, 8) AS timestamp, round(45.0::DOUBLE * (period - 1) + ms // 60000 + ((ms // 1000) % 60) / 60.0::DOUBLE, 8) AS match_minute,
  round(CASE WHEN i % 17 <> 0 THEN k * 1.2::DOUBLE / 120 * 100 END, 8) AS x, round(CASE WHEN i % 17 <> 0 THEN (80 - y) / 80 * 100 END, 8) AS y,
  round(CASE WHEN i % 7 <> 0 THEN y * 1.5::DOUBLE / 120 * 100 END, 8) AS end_x, round(CASE WHEN i % 7 <> 0 THEN (80 - k * 0.8::DOUBLE) / 80 * 100 END, 8) AS end_y, event_type,
  CASE WHEN type = 'Pass' THEN CASE WHEN i % 3 = 0 THEN 'complete' ELSE 'incomplete' END WHEN type = 'Ball Receipt*' THEN CASE WHEN i % 6 = 1 THEN 'incomplete' ELSE 'complete' END
       ELSE coalesce(CASE WHEN i % 3 <> 0 THEN 'incomplete' END, replace(lower(so), ' ', '_'), CASE WHEN i % 6 = 1 THEN 'incomplete' END, 'success') END AS event_outcome,
  i % 5 = 0 AS under_pressure, CASE WHEN i % 3 = 0 THEN 'right_foot' ELSE 'unknown' END AS body_part, score_home, score_away, at_home AS team_is_home,
  row_number() OVER (PARTITION BY match_id ORDER BY period, ms, i) AS seq
FROM r2 WHERE event_type IS NOT NULL""",
    "n7_skipped": f"WITH {RAW_SQL} SELECT type, count(*) AS n, type IN ('Starting XI', 'Tactical Shift') AS known FROM r1 WHERE event_type IS NULL GROUP BY type",
    "n11_frames": f"""WITH {RAW_SQL}, f AS (SELECT i, k::BIGINT AS k, CASE WHEN i % 3 = 0 AND i % 27 <> 0 THEN 1 WHEN i % 10 = 2 THEN 2 END AS kind FROM r2 WHERE event_type IS NOT NULL),
p AS (SELECT i, k, 1 AS kind, unnest(range(0, i % 4 + 1)) AS n FROM f WHERE kind = 1 UNION ALL SELECT i, k, 2 AS kind, unnest(range(0, i % 3 + 1)) AS n FROM f WHERE kind = 2),
q AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n) - 1 AS place FROM p WHERE kind = 2 OR (i + n) % 7 <> 0)
SELECT CAST(i AS VARCHAR) AS event_id, place::INT AS place, CASE WHEN kind = 2 AND n > 0 THEN CAST(n + 100 AS VARCHAR) ELSE 'unknown' END AS player_id, n % 2 = (kind - 1) AS teammate,
  round(CASE WHEN kind = 1 THEN (k * 3 + n * 11) % 120 ELSE (k * 7 + n * 11) % 120 END / 120.0::DOUBLE * 100, 8) AS x, round((80 - CASE WHEN kind = 1 THEN (k * 5 + n * 17) % 80 ELSE (k * 2 + n * 17) % 80 END) / 80.0::DOUBLE * 100, 8) AS y,
  CASE WHEN kind = 2 THEN 'Center Back' ELSE 'unknown' END AS position FROM q""",
    "s2_matches": """WITH d AS (SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS m, strftime(min(ts), '%Y-%m-%d') AS match_date, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT CAST(m AS VARCHAR) AS match_id, 'Cup' AS competition, substr(match_date, 1, 4) AS season, CAST(m % 10 AS VARCHAR) AS home_team_id, 'Even' AS home_team_name, CAST(m % 7 AS VARCHAR) AS away_team_id, 'Odd' AS away_team_name, a::INT AS home_score, b::INT AS away_score, match_date FROM d""",
    "n14_lineups": """WITH u AS (SELECT DISTINCT CAST(strftime(ts, '%Y%m%d') AS INT) AS match_id, user_id % 2 + 1 AS t, user_id AS u FROM events)
SELECT match_id, CAST(t AS VARCHAR) AS team_id, 'Team' AS team_name, CAST(u AS VARCHAR) AS player_id, 'p' || u AS player_name, CASE WHEN u % 6 <> 0 THEN u % 30 ELSE 0 END::INT AS jersey_number, u % 4 <> 0 AND u % 3 <> 0 AND u % 2 = 0 AS starter,
  CASE WHEN u % 4 <> 0 THEN u % 3 + 1 ELSE 0 END::INT AS n_positions, (u % 5 = 0)::INT AS n_cards, CASE WHEN u % 4 <> 0 THEN CASE WHEN u % 3 = 0 THEN 'unknown' WHEN u % 2 = 0 THEN 'Starting XI' ELSE 'Substitution - On (Tactical)' END END AS start_reason,
  CASE WHEN u % 5 = 0 THEN CASE WHEN u % 10 = 0 THEN 'Foul Committed' ELSE 'unknown' END END AS card_reason FROM u""",
    "j9_side_by_side": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS a0, round(embedding[2]::DOUBLE, 6) AS a1, round(embedding[3]::DOUBLE, 6) AS a2, len(embedding)::INT AS n, label FROM embeddings",
    "n16_vocabulary": f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS n FROM ev GROUP BY event_type",
    "s6_supports_360": f"WITH {EVENTS_SQL} SELECT match_id, bool_or(freeze_frame IS NOT NULL) AS has_360 FROM ev GROUP BY match_id",
    "s16_download_summary": f"""WITH {EVENTS_SQL}, m AS (SELECT substr(match_id, 1, 9) AS dataset, match_id, count(*) AS n, count(freeze_frame) AS f FROM ev GROUP BY match_id)
SELECT coalesce(dataset, 'TOTAL') AS dataset, count(*) AS matches, sum(n)::BIGINT AS events, sum(f)::BIGINT AS with_360, count(*) FILTER (f > 0) AS matches_360 FROM m GROUP BY ROLLUP (dataset)""",
    "n20_dataset_map": f"WITH {EVENTS_SQL} SELECT CASE WHEN match_id < '2024-01-20' THEN substr(match_id, 1, 9) ELSE 'unknown' END AS dataset, count(*) AS n FROM ev GROUP BY 1",
    "n22_sizes": "SELECT doc_id, CASE WHEN n_chars * 64 < 1024 THEN format('{:d} B', n_chars * 64) WHEN n_chars * 64 < 1048576 THEN printf('%.1f KB', floor(n_chars * 64 / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * 64 / 1048576 * 10 + 0.5) / 10) END AS size FROM documents",
    "j7_nearest": f"""WITH {EVENTS_SQL}, p AS (SELECT event_id, list_filter(freeze_frame, lambda q: q.teammate) AS t, list_filter(freeze_frame, lambda q: NOT q.teammate) AS o FROM ev WHERE freeze_frame IS NOT NULL)
SELECT event_id, round(list_min(list_transform(t, lambda a: list_min(list_transform(o, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))))), 8) AS nearest FROM p""",
}
