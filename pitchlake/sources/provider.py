"""Provider data to the canonical schema: events, freeze frames, matches and lineups of nested JSON, as expressions.

All matches are normalised by one plan. Types and sub-types outside the vocabulary are dropped; ``skipped_types`` counts them.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.errors import SourceError
from pitchlake.functions.expressions import pitch_x, pitch_y, snake, timestamp_seconds

#: Canonical event types. Fixed values.
EVENT_TYPES = (
    "pass",
    "carry",
    "shot",
    "pressure",
    "tackle",
    "interception",
    "block",
    "clearance",
    "foul_committed",
    "foul_won",
    "ball_receipt",
    "ball_recovery",
    "dispossessed",
    "duel",
    "miscontrol",
    "goal_keeper",
    "substitution",
    "set_piece_corner",
    "set_piece_free_kick",
    "set_piece_throw_in",
    "set_piece_goal_kick",
    "set_piece_penalty",
    "set_piece_kick_off",
)

#: Provider types and canonical types. Fixed values.
TYPE_MAP = {
    "Pass": "pass",
    "Ball Receipt*": "ball_receipt",
    "Carry": "carry",
    "Dribble": "carry",
    "Shot": "shot",
    "Pressure": "pressure",
    "Duel": "duel",
    "Foul Committed": "foul_committed",
    "Foul Won": "foul_won",
    "Interception": "interception",
    "Block": "block",
    "Clearance": "clearance",
    "Ball Recovery": "ball_recovery",
    "Dispossessed": "dispossessed",
    "Miscontrol": "miscontrol",
    "Goal Keeper": "goal_keeper",
    "Substitution": "substitution",
}

#: Provider types that are known and have no canonical type. Fixed values.
SKIPPED_TYPES = (
    "Starting XI",
    "Half Start",
    "Half End",
    "Tactical Shift",
    "Injury Stoppage",
    "Referee Ball-Drop",
    "Bad Behaviour",
    "Error",
    "50/50",
    "Dribbled Past",
    "Shield",
    "Offside",
    "Own Goal For",
    "Own Goal Against",
    "Player Off",
    "Player On",
)

#: Passes that start play again. Fixed values.
PASS_MAP = {"Corner": "set_piece_corner", "Free Kick": "set_piece_free_kick", "Throw-in": "set_piece_throw_in", "Goal Kick": "set_piece_goal_kick", "Kick Off": "set_piece_kick_off"}

#: Columns that are looked through in order. Fixed values.
BODY_PARTS = ("pass_body_part", "shot_body_part", "clearance_body_part", "goalkeeper_body_part")
ENDS = ("pass_end_location", "carry_end_location", "shot_end_location", "goalkeeper_end_location")
OUTCOMES = ("pass_outcome", "shot_outcome", "duel_outcome", "interception_outcome", "ball_receipt_outcome", "dribble_outcome", "goalkeeper_outcome")


class DataAdapter(Protocol):
    """What a provider offers: all of it as DataFrames."""

    def list_matches(self) -> DataFrame: ...

    def load_events(self) -> DataFrame: ...

    def load_lineups(self) -> DataFrame: ...


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def event_type() -> Column:
    """Canonical type of a raw event, null where there is none."""
    kind = F.col("type")
    piece = _lookup(PASS_MAP, F.coalesce("pass_type", F.lit("")))
    return (
        F.when(kind == "Pass", F.coalesce(piece, F.lit("pass")))
        .when((kind == "Shot") & (F.col("shot_type") == "Penalty"), "set_piece_penalty")
        .when((kind == "Duel") & (F.col("duel_type") == "Tackle"), "tackle")
        .otherwise(_lookup(TYPE_MAP, F.coalesce(kind, F.lit(""))))
    )


def _first(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(None).cast(kind)) if there else F.lit(None).cast(kind)


#: Columns that a provider may leave out, and their types.
OPTIONAL = {
    "pass_type": "string",
    "shot_type": "string",
    "duel_type": "string",
    "pass_outcome": "string",
    "shot_outcome": "string",
    "ball_receipt_outcome": "string",
    "under_pressure": "boolean",
    "location": "array<double>",
    "player_id": "double",
}


def with_raw_columns(raw: DataFrame) -> DataFrame:
    """Absent optional columns as nulls, NaN as null."""
    numbers = [f.name for f in raw.schema if f.dataType.typeName() in ("double", "float")]
    raw = raw.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers}) if numbers else raw
    absent = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in raw.columns}
    return raw.withColumns(absent) if absent else raw


def normalise_events(raw: DataFrame, frames: DataFrame | None = None, minute_is_cumulative: bool = False) -> DataFrame:
    """Raw events (and 360 frames: event_uuid, freeze_frame) as canonical events with ``seq``.

    The home team is that of the first starting line-up. The running score counts goals up to and including the event.
    A 360 frame wins over the frame of a shot, and of several for one event the last; players without a place are dropped and an empty
    frame is null. Frames may lack any field of a player but the place.
    """
    raw = with_raw_columns(raw)
    home = raw.where(F.col("type") == "Starting XI").groupBy("match_id").agg(F.min_by("team_id", "index").alias("_home"))
    e = raw.join(home, "match_id", "left")
    so_far = Window.partitionBy("match_id").orderBy("period", "index").rowsBetween(Window.unboundedPreceding, 0)
    goal = (F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal")
    at_home = F.col("team_id").eqNullSafe(F.col("_home"))
    e = e.withColumn("score_home", F.sum(F.coalesce(goal & at_home, F.lit(False)).cast("int")).over(so_far).cast("int"))
    e = e.withColumn("score_away", F.sum(F.coalesce(goal & ~at_home, F.lit(False)).cast("int")).over(so_far).cast("int"))
    e = e.withColumn("_type", event_type()).where(F.col("_type").isNotNull())
    embedded = _players(e, "shot_freeze_frame") if "shot_freeze_frame" in raw.columns else F.lit(None).cast(PLAYERS)
    frame = embedded
    if frames is not None:
        f = frames.withColumn("_at", F.monotonically_increasing_id()).where(F.col("event_uuid").isNotNull() & F.col("freeze_frame").isNotNull())
        e = e.join(f.groupBy(F.col("event_uuid").alias("id")).agg(F.max_by("freeze_frame", "_at").alias("_360")), "id", "left")
        frame = F.when(F.col("_360").isNotNull(), _players(e, "_360")).otherwise(embedded)
    end = _first(e, ENDS, "array<double>")
    kind = F.col("type")
    outcome = F.when(kind == "Pass", F.when(F.col("pass_outcome").isNull(), "complete").otherwise("incomplete")).when(kind == "Ball Receipt*", F.when(F.col("ball_receipt_outcome").isNull(), "complete").otherwise("incomplete")).otherwise(F.coalesce(snake(_first(e, OUTCOMES, "string")), F.lit("success")))
    base = F.lit(0.0) if minute_is_cumulative else F.lit(45.0) * (F.col("period") - 1)
    out = e.select(
        F.col("id").alias("event_id"),
        F.col("match_id").cast("string").alias("match_id"),
        F.col("team_id").cast("string").alias("team_id"),
        F.coalesce(F.col("player_id").cast("double").cast("long").cast("string"), F.lit("unknown")).alias("player_id"),
        F.col("period").cast("int").alias("period"),
        timestamp_seconds(F.col("timestamp")).alias("timestamp"),
        (base + F.col("minute") + F.col("second") / F.lit(60.0)).alias("match_minute"),
        pitch_x(F.get("location", F.lit(0))).alias("x"),
        pitch_y(F.get("location", F.lit(1))).alias("y"),
        pitch_x(F.get(end, F.lit(0))).alias("end_x"),
        pitch_y(F.get(end, F.lit(1))).alias("end_y"),
        F.col("_type").alias("event_type"),
        outcome.alias("event_outcome"),
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"),
        F.coalesce(snake(_first(e, BODY_PARTS, "string")), F.lit("unknown")).alias("body_part"),
        F.when(F.size(frame) > 0, frame).alias("freeze_frame"),
        "score_home",
        "score_away",
        at_home.alias("team_is_home"),
        F.col("index").alias("_index"),
    )
    order = Window.partitionBy("match_id").orderBy("period", "timestamp", "_index")
    return out.withColumn("seq", F.row_number().over(order).cast("long")).drop("_index")


#: Type of a canonical freeze frame.
PLAYERS = "array<struct<player_id:string,teammate:boolean,x:double,y:double,position:string>>"


def _players(df: DataFrame, column: str) -> Column:
    """Players of a raw frame that have a place, in the canonical frame schema; fields that the raw frame lacks get their defaults."""
    kind = df.schema[column].dataType
    fields = {f.name: f.dataType for f in getattr(getattr(kind, "elementType", None), "fields", [])}
    if "location" not in fields:
        return F.lit(None).cast(PLAYERS)

    def inner(p: Column, field: str, name: str) -> Column:
        has = name in [f.name for f in getattr(fields.get(field), "fields", [])]
        return F.coalesce(p[field][name].cast("string"), F.lit("unknown")) if has else F.lit("unknown")

    def player(p: Column) -> Column:
        mate = F.coalesce(p["teammate"].cast("boolean"), F.lit(False)) if "teammate" in fields else F.lit(False)
        place = p["location"]
        return F.struct(inner(p, "player", "id").alias("player_id"), mate.alias("teammate"), pitch_x(F.get(place, F.lit(0))).alias("x"), pitch_y(F.get(place, F.lit(1))).alias("y"), inner(p, "position", "name").alias("position"))

    return F.transform(F.filter(F.col(column), lambda p: p["location"].isNotNull()), player)


def skipped_types(raw: DataFrame) -> DataFrame:
    """type, n and known of raw events that have no canonical type; known: the type is expected to have none."""
    kinds = with_raw_columns(raw).where(event_type().isNull()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("known", F.coalesce(F.col("type").isin(*SKIPPED_TYPES, *TYPE_MAP), F.lit(False)))


def check_vocabulary(events: DataFrame) -> DataFrame:
    """The same events; raises SourceError if one has a type outside the vocabulary."""
    if odd := events.where(~F.col("event_type").isin(*EVENT_TYPES)).select("event_type").head():
        raise SourceError(f"unknown event type {odd.event_type!r}")
    return events


def list_matches(raw: DataFrame) -> DataFrame:
    """Nested matches as flat rows, ids as text, by date."""
    return raw.select(
        F.col("match_id").cast("string").alias("match_id"),
        F.col("competition.competition_name").alias("competition"),
        F.col("season.season_name").alias("season"),
        F.col("home_team.home_team_id").cast("string").alias("home_team_id"),
        F.col("home_team.home_team_name").alias("home_team_name"),
        F.col("away_team.away_team_id").cast("string").alias("away_team_id"),
        F.col("away_team.away_team_name").alias("away_team_name"),
        F.col("home_score").cast("int").alias("home_score"),
        F.col("away_score").cast("int").alias("away_score"),
        "match_date",
    ).orderBy("match_date", "match_id")


def normalise_lineups(raw: DataFrame) -> DataFrame:
    """One row per (team, player): id, name, jersey (0 if absent), starter, positions and cards with their defaults."""
    p = raw.select(*[c for c in ("match_id",) if c in raw.columns], F.col("team_id").cast("string").alias("team_id"), "team_name", F.explode("lineup").alias("p"))
    unknown = F.lit("unknown")
    spells = F.transform(
        F.coalesce("p.positions", F.array().cast(raw.schema["lineup"].dataType.elementType["positions"].dataType)),
        lambda s: F.struct(s["position_id"].alias("position_id"), s["position"].alias("position"), s["from"].alias("from_time"), s["to"].alias("to_time"), s["from_period"].alias("from_period"), s["to_period"].alias("to_period"), F.coalesce(s["start_reason"], unknown).alias("start_reason"), F.coalesce(s["end_reason"], unknown).alias("end_reason")),
    )
    cards = F.transform(
        F.coalesce("p.cards", F.array().cast(raw.schema["lineup"].dataType.elementType["cards"].dataType)),
        lambda c: F.struct(c["time"].alias("time"), c["card_type"].alias("card_type"), F.coalesce(c["reason"], unknown).alias("reason"), c["period"].alias("period")),
    )
    out = p.select(*[c for c in ("match_id", "team_id", "team_name") if c in p.columns], F.col("p.player_id").cast("string").alias("player_id"), F.col("p.player_name").alias("player_name"), F.coalesce("p.jersey_number", F.lit(0)).alias("jersey_number"), spells.alias("positions"), cards.alias("cards"))
    return out.withColumn("starter", F.exists("positions", lambda s: s["start_reason"] == "Starting XI"))


def supports_360(events: DataFrame) -> DataFrame:
    """match_id and whether any of its events has a freeze frame."""
    return events.groupBy("match_id").agg(F.bool_or(F.col("freeze_frame").isNotNull()).alias("has_360"))


class JsonAdapter:
    """Matches, events, frames and lineups of folders of JSON files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("multiLine", True).json(f"{self.folder}/{name}")

    def list_matches(self) -> DataFrame:
        return list_matches(self._read("matches"))

    def load_events(self, with_frames: bool = False) -> DataFrame:
        return normalise_events(self._read("events"), self._read("frames") if with_frames else None)

    def load_lineups(self) -> DataFrame:
        return normalise_lineups(self._read("lineups"))
