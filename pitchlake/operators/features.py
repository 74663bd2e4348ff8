"""The features of a segment from one team's point of view, as aggregate expressions in three tiers.

Every feature of tiers 1 and 2 is a conditional aggregate over the segment's events, so a tier is one aggregation. What needs
the order of events (gaps, transitions, the next three events) is computed once per segment beforehand by window functions
that share their sorting. Tier 3 looks at the segment's last freeze frame, the same for both teams, in a branch of its own, so
that frames aren't multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.config import WindowConfig
from pitchlake.errors import EngineError, FeatureError
from pitchlake.functions.expressions import count_where, norm, ratio, share
from pitchlake.operators.segments import segment_events
from pitchlake.sources.store import materialised, union_tables

SEGMENT = ("segment_type", "match_id", "period", "segment", "start_time", "end_time", "segment_minute")

#: The pitch in hundredths: goal, thirds, penalty box; thresholds of moves. Fixed values.
GOAL_X, GOAL_Y = 100.0, 50.0
LOW_THIRD, HIGH_THIRD = 33.3, 66.7
BOX_X, BOX_LOW, BOX_HIGH = 83.3, 21.1, 78.9
FORWARD, SWITCH, COUNTER = 10.0, 50.0, 25.0

#: Kinds of events. Fixed values.
WON = ("won", "success", "success_in_play", "success_out")
DEFENSIVE = ("tackle", "interception", "clearance", "block")
ENGAGING = ("tackle", "foul_committed", "interception", "block")
CHALLENGES = ("tackle", "interception", "foul_committed")


@dataclass
class Extractor:
    """A named group of features of one tier; ``columns`` are aggregates over prepared events."""

    name: str
    tier: int
    columns: Callable[[], dict[str, Column]]

    @cached_property
    def feature_names(self) -> list[str]:
        return list(self.columns())


@dataclass
class FeatureRegistry:
    """Extractors in order; names of extractors and of features are unique."""

    extractors: list[Extractor] = field(default_factory=list)

    def register(self, extractor: Extractor) -> None:
        if extractor.name in [e.name for e in self.extractors]:
            raise FeatureError(f"extractor {extractor.name!r} is registered already")
        if both := set(extractor.feature_names) & set(self.feature_names()):
            raise FeatureError(f"features registered already: {sorted(both)}")
        self.extractors.append(extractor)

    def up_to(self, max_tier: int) -> list[Extractor]:
        return [e for e in self.extractors if e.tier <= max_tier]

    def feature_names(self, max_tier: int = 3) -> list[str]:
        return [n for e in self.up_to(max_tier) for n in e.feature_names]


def _c(name: str) -> Column:
    return F.col(name)


def _own(kind: str | Sequence[str] | None = None) -> Column:
    own = _c("own")
    if kind is None:
        return own
    return own & (_c("event_type") == kind if isinstance(kind, str) else _c("event_type").isin(*kind))


def _located() -> Column:
    return _c("x").isNotNull() & _c("y").isNotNull()


def _travelled() -> Column:
    return _located() & _c("end_x").isNotNull() & _c("end_y").isNotNull()


def _spatial() -> dict[str, Column]:
    here = _own() & _located()
    x, y = F.when(here, _c("x")), F.when(here, _c("y"))
    p = "t1_spatial_"
    return {
        p + "event_centroid_x": F.avg(x),
        p + "event_centroid_y": F.avg(y),
        p + "event_spread_x": F.stddev_pop(x),
        p + "event_spread_y": F.stddev_pop(y),
        p + "avg_distance_to_goal": F.avg(norm(x - GOAL_X, y - GOAL_Y)),
        p + "attacking_third_pct": share(_c("x") > HIGH_THIRD, here),
        p + "middle_third_pct": share(_c("x").between(LOW_THIRD, HIGH_THIRD), here),
        p + "defensive_third_pct": share(_c("x") < LOW_THIRD, here),
        p + "left_channel_pct": share(_c("y") > HIGH_THIRD, here),
        p + "center_channel_pct": share(_c("y").between(LOW_THIRD, HIGH_THIRD), here),
        p + "right_channel_pct": share(_c("y") < LOW_THIRD, here),
    }


def _temporal() -> dict[str, Column]:
    ts, gap = F.when(_own(), _c("timestamp")), F.when(_own(), _c("own_gap"))
    length = F.max(ts) - F.min(ts)
    valid = (F.count_if(_own()) >= 2) & (length > 0)
    p = "t1_temporal_"
    return {
        p + "event_rate": F.when(valid, F.count_if(_own()) / length),
        p + "mean_inter_event_time": F.when(valid, F.avg(gap)),
        p + "std_inter_event_time": F.when(valid, F.stddev_pop(gap)),
        p + "max_inter_event_time": F.when(valid, F.max(gap)),
        p + "match_minute": F.avg(F.when(_own(), _c("match_minute"))),
        p + "period": F.max(F.when(_own(), _c("period"))).cast("double"),
    }


def _passing() -> dict[str, Column]:
    go = _own("pass") & _travelled()
    dx, dy = _c("dx"), _c("dy")
    n = F.count_if(go)
    p = "t1_pass_"
    none = F.lit(None).cast("double")
    return {
        p + "count": count_where(_own("pass")),
        p + "completion_rate": share(_c("event_outcome") == "complete", _own("pass")),
        p + "length_mean": F.avg(F.when(go, _c("length"))),
        p + "length_std": F.stddev_pop(F.when(go, _c("length"))),
        p + "angle_std": F.stddev_pop(F.when(go, F.atan2(dy, dx))),
        p + "progressive_count": F.when(n > 0, count_where(go & (dx > FORWARD))),
        p + "backward_ratio": share(dx < 0, go),
        p + "height_ground_pct": F.max(none),
        p + "height_low_pct": F.max(none),
        p + "height_high_pct": F.max(none),
        p + "switch_count": F.when(n > 0, count_where(go & (F.abs(dy) > SWITCH))),
        p + "directness": F.avg(F.when(go & (_c("length") > 0), dx / _c("length"))),
    }


def _carrying() -> dict[str, Column]:
    go = _own("carry") & _travelled()
    p = "t1_carry_"
    return {
        p + "count": count_where(_own("carry")),
        p + "distance_total": F.sum(F.when(go, _c("length"))),
        p + "distance_mean": F.avg(F.when(go, _c("length"))),
        p + "directness": F.avg(F.when(go & (_c("length") > 0), _c("dx") / _c("length"))),
        p + "progressive_count": count_where(go & (_c("dx") > FORWARD)),
        p + "dribble_attempt_count": count_where(_own("carry")),
        p + "dribble_success_rate": F.max(F.lit(None).cast("double")),
    }


def _defending() -> dict[str, Column]:
    p = "t1_defend_"
    duel = _own(("tackle", "duel"))
    return {
        p + "pressure_count": count_where(_own("pressure")),
        p + "pressure_rate": count_where(_own("pressure")) / F.count(F.lit(1)),
        p + "tackle_count": count_where(duel),
        p + "tackle_success_rate": share(_c("event_outcome").isin(*WON), duel),
        p + "interception_count": count_where(_own("interception")),
        p + "clearance_count": count_where(_own("clearance")),
        p + "foul_count": count_where(_own("foul_committed")),
        p + "under_pressure_pct": share(_c("under_pressure"), _own()),
        p + "defensive_action_height": F.avg(F.when(_own(DEFENSIVE) & _located(), 100.0 - _c("x"))),
    }


def _shooting() -> dict[str, Column]:
    return {
        "t1_shoot_count": count_where(_own("shot")),
        "t1_shoot_distance_mean": F.avg(F.when(_own("shot") & _located(), norm(_c("x") - GOAL_X, _c("y") - GOAL_Y))),
    }


def _context() -> dict[str, Column]:
    ahead = F.when(_c("focal_is_home"), _c("score_home") - _c("score_away")).otherwise(_c("score_away") - _c("score_home"))
    return {
        "t1_context_score_differential": F.max_by(ahead.cast("double"), "seq"),
        "t1_context_possession_share": share(_own()),
        "t1_context_possession_team": F.max_by(_own().cast("double"), "seq"),
    }


ZONES = ("def", "mid", "att")


def _zonal() -> dict[str, Column]:
    moved = _own() & _located() & _c("last_x").isNotNull()
    now, before = _zone(_c("x")), _zone(_c("last_x"))
    now_in, was_in = _in_box(_c("x"), _c("y")), _in_box(_c("last_x"), _c("last_y"))
    out = {f"t2_zonal_zone_{a}_to_{b}": share((before == a) & (now == b), moved) for a in ZONES for b in ZONES}
    return out | {"t2_zonal_box_entries": count_where(moved & ~was_in & now_in), "t2_zonal_box_exits": count_where(moved & was_in & ~now_in)}


def _zone(x: Column) -> Column:
    return F.when(x < LOW_THIRD, "def").when(x > HIGH_THIRD, "att").otherwise("mid")


def _in_box(x: Column, y: Column) -> Column:
    return (x > BOX_X) & (y > BOX_LOW) & (y < BOX_HIGH)


def _shape() -> dict[str, Column]:
    here = _own() & _located()
    x, y = F.when(here, _c("x")), F.when(here, _c("y"))
    engaged = ~_c("own") & _c("event_type").isin(*ENGAGING) & _located()
    p = "t2_shape_"
    return {
        p + "team_centroid_x_est": F.avg(x),
        p + "team_centroid_y_est": F.avg(y),
        p + "team_spread_est": F.sqrt(F.var_pop(x) + F.var_pop(y)),
        p + "engagement_line": F.when(F.count_if(engaged) >= 2, 100.0 - F.median(F.when(engaged, _c("x")))),
        p + "compactness_proxy": F.max(x) - F.min(x),
    }


def _pressing() -> dict[str, Column]:
    there = _own("pressure") & _located()
    p = "t2_press_"
    return {
        p + "intensity": ratio(count_where(_own("pressure")), count_where(~_c("own"))),
        p + "trigger_x": F.avg(F.when(there, _c("x"))),
        p + "trigger_y": F.avg(F.when(there, _c("y"))),
        p + "success_rate": share(_c("regained"), _own("pressure")),
        p + "ppda": ratio(count_where(~_c("own") & (_c("event_type") == "pass")), count_where(_own(CHALLENGES))),
    }


def _transition() -> dict[str, Column]:
    won, lost = _c("turnover") & _c("own"), _c("turnover") & ~_c("own")
    p = "t2_transition_"
    return {
        p + "counter_attack_indicator": F.max(F.when(won, F.coalesce(_c("gain") > COUNTER, F.lit(False)).cast("double"))),
        p + "counter_press_indicator": F.max(F.when(lost, (_c("pressed_back") >= 2).cast("double"))),
        p + "transition_speed": F.avg(F.when(won & (_c("gain_time") > 0), _c("gain") / _c("gain_time"))),
    }


def _formation() -> dict[str, Column]:
    p = "t3_formation_"
    xs, ys, n = _c("tx"), _c("ty"), F.size("tx").cast("double")
    enough = F.size("tx") >= 3
    mx, my = _mean(xs), _mean(ys)
    a, c = _variance(xs), _variance(ys)
    together = lambda m: F.aggregate(F.arrays_zip(xs.alias("tx"), ys.alias("ty")), F.lit(0.0), lambda s, v: s + (v["tx"] - m["x"]) * (v["ty"] - m["y"])) / n
    b = _let(F.struct(mx.alias("x"), my.alias("y")), together)
    axes = lambda s: F.struct(((s["a"] + s["c"]) / 2).alias("half"), F.sqrt((s["a"] - s["c"]) / 2 * ((s["a"] - s["c"]) / 2) + s["b"] * s["b"]).alias("root"))
    flat = lambda r: F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))
    shape = lambda s: F.when(s["half"] + s["root"] <= 0, 0.0).otherwise(_let((s["half"] - s["root"]) / F.nullif(s["half"] + s["root"], F.lit(0.0)), flat))
    low, mid, high = _mean(F.slice(F.array_sort(xs), 1, 3)), _median(xs), _mean(F.slice(F.array_sort(xs), -3, 3))
    out = {
        "team_centroid_x": mx,
        "team_centroid_y": my,
        "team_spread_x": F.sqrt(a),
        "team_spread_y": F.sqrt(c),
        "team_width": F.array_max(ys) - F.array_min(ys),
        "team_length": F.array_max(xs) - F.array_min(xs),
        "convex_hull_area": _c("hull.area"),
        "convex_hull_perimeter": _c("hull.perimeter"),
        "defensive_line": low,
        "midfield_line": mid,
        "attacking_line": high,
        "def_mid_gap": mid - low,
        "mid_att_gap": high - mid,
        "formation_eccentricity": _let(_let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), axes), shape),
    }
    return {p + k: F.when(enough, v) for k, v in out.items()}


def _relational() -> dict[str, Column]:
    p = "t3_relational_"
    enough = (F.size("tx") > 0) & (F.size("ox") >= 3)
    nearest = F.transform(F.arrays_zip("tx", "ty"), lambda t: F.array_min(F.transform(F.arrays_zip("ox", "oy"), lambda o: norm(t["tx"] - o["ox"], t["ty"] - o["oy"]))))
    mx = _mean(_c("ox"))
    out = {
        "avg_nearest_opponent_dist": _mean(nearest),
        "min_nearest_opponent_dist": F.array_min(nearest),
        "opp_centroid_x": mx,
        "opp_spread_x": F.sqrt(_variance(_c("ox"))),
        "opp_defensive_line": _mean(F.slice(F.array_sort("ox"), -3, 3)),
    }
    return {p + k: F.when(enough, v) for k, v in out.items()}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _variance(values: Column) -> Column:
    return _let(_mean(values), lambda m: _mean(F.transform(values, lambda v: (v - m) * (v - m))))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def default_registry() -> FeatureRegistry:
    out = FeatureRegistry()
    for tier, groups in (
        (1, {"spatial": _spatial, "temporal": _temporal, "passing": _passing, "carrying": _carrying, "defending": _defending, "shooting": _shooting, "context": _context}),
        (2, {"zonal": _zonal, "shape": _shape, "pressing": _pressing, "transition": _transition}),
        (3, {"formation": _formation, "relational": _relational}),
    ):
        for name, columns in groups.items():
            out.register(Extractor(name, tier, columns))
    return out


def prepared(segment_events: DataFrame) -> DataFrame:
    """Segment events with what depends on their order: gaps, last place of the same team, regained pressures, turnovers."""
    key = ("segment_type", "match_id", "period", "segment")
    team = Window.partitionBy(*key, "team_id").orderBy("seq")
    every = Window.partitionBy(*key).orderBy("seq")
    here = _located()
    e = segment_events.drop("freeze_frame", "player_id", "body_part")
    e = e.withColumn("dx", _c("end_x") - _c("x")).withColumn("dy", _c("end_y") - _c("y")).withColumn("length", norm(_c("dx"), _c("dy")))
    e = e.withColumn("own_gap", _c("timestamp") - F.lag("timestamp").over(team))
    place = F.last(F.when(here, F.struct("x", "y")), ignorenulls=True).over(team.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_place", place).withColumn("last_x", _c("_place.x")).withColumn("last_y", _c("_place.y"))
    e = e.withColumn("_now", F.struct("team_id", "event_type", "x", "y", "timestamp"))
    for i in (1, 2, 3):
        e = e.withColumn(f"_n{i}", F.lead("_now", i).over(every))
    e = e.withColumn("_before", F.lag("team_id").over(every))
    e = e.withColumn("regained", F.exists(F.array("_n1", "_n2", "_n3"), lambda n: F.coalesce((n["team_id"] == _c("team_id")) & (n["event_type"] != "pressure"), F.lit(False))))
    e = e.withColumn("turnover", F.coalesce(_c("_before") != _c("team_id"), F.lit(False)))
    three = F.filter(F.array("_now", "_n1", "_n2"), lambda n: n.isNotNull())
    e = e.withColumn("_ours", F.filter(three, lambda n: (n["team_id"] == _c("team_id")) & n["x"].isNotNull() & n["y"].isNotNull()))
    two = F.size("_ours") >= 2
    e = e.withColumn("gain", F.when(two, F.element_at("_ours", -1)["x"] - F.element_at("_ours", 1)["x"])).withColumn("gain_time", F.when(two, F.element_at("_ours", -1)["timestamp"] - F.element_at("_ours", 1)["timestamp"]))
    e = e.withColumn("pressed_back", F.size(F.filter(three, lambda n: (n["team_id"] == _c("_before")) & (n["event_type"] == "pressure"))))
    return e.drop("_place", "_now", "_n1", "_n2", "_n3", "_before", "_ours")


@F.pandas_udf(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("perimeter", T.DoubleType())]))
def _hull(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for xs, ys in batches:
        yield pd.DataFrame([convex_hull(x, y) for x, y in zip(xs, ys, strict=True)], columns=["area", "perimeter"])


def convex_hull(xs: Sequence[float], ys: Sequence[float]) -> tuple[float | None, float | None]:
    """Area and perimeter of the hull of points; nulls if they lie on one line."""
    points = sorted(set(zip(map(float, xs), map(float, ys), strict=True)))
    if len(points) < 3:
        return None, None

    def chain(path: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in path:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(points) + chain(points[::-1])
    sides = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in sides)) / 2
    if len(ring) < 3 or area == 0:
        return None, None
    return area, sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in sides)


def last_frames(segment_events: DataFrame) -> DataFrame:
    """Per segment the places of both sides in its last freeze frame: tx, ty (the actor's team), ox, oy, and the hull."""
    frames = segment_events.where(_c("freeze_frame").isNotNull()).groupBy("segment_type", "match_id", "period", "segment").agg(F.max_by("freeze_frame", "seq").alias("_f"))
    mates, others = F.filter("_f", lambda q: q["teammate"]), F.filter("_f", lambda q: ~q["teammate"])
    for s, players in (("t", mates), ("o", others)):
        frames = frames.withColumn(s + "x", F.transform(players, lambda q: q["x"])).withColumn(s + "y", F.transform(players, lambda q: q["y"]))
    return frames.drop("_f").withColumn("hull", _hull("tx", "ty"))


def extract_features(segment_events: DataFrame, contexts: DataFrame, max_tier: int = 3, registry: FeatureRegistry | None = None) -> DataFrame:
    """One row per (segment, team): metadata, then the features in the registry's order, each a nullable double."""
    registry = registry or default_registry()
    groups = registry.up_to(max_tier)
    if not groups:
        raise FeatureError("no extractor of these tiers")
    who = contexts.select("match_id", _c("team_id").alias("focal"), _c("team_is_home").alias("focal_is_home"))
    e = prepared(segment_events).join(who, "match_id").withColumn("own", _c("team_id") == _c("focal"))
    flat = {n: c for g in groups if g.tier < 3 for n, c in g.columns().items()}
    out = e.groupBy(*SEGMENT, "focal").agg(*[c.cast("double").alias(n) for n, c in flat.items()] or [F.count(F.lit(1)).alias("_n")])
    if late := {n: c for g in groups if g.tier == 3 for n, c in g.columns().items()}:
        frames = last_frames(segment_events)
        frames = frames.select("segment_type", "match_id", "period", "segment", *[c.cast("double").alias(n) for n, c in late.items()])
        out = out.join(frames, ["segment_type", "match_id", "period", "segment"], "left")
    meta = ["match_id", _c("focal").alias("team_id"), "segment_type", "start_time", "end_time", "period", _c("segment_minute").alias("match_minute"), "segment"]
    return out.select(*meta, *[n for g in groups for n in g.feature_names])


def match_sides(events: DataFrame) -> DataFrame:
    """Two rows per match, one from each team's point of view: match_id, team_id, opponent_id, team_is_home, has_360. Matches without two teams have none."""
    e = events.groupBy("match_id", "team_id").agg(F.bool_or("team_is_home").alias("team_is_home"), F.bool_or(_c("freeze_frame").isNotNull()).alias("_f"))
    both = e.groupBy("match_id").agg(F.sort_array(F.collect_list("team_id")).alias("_teams"), F.bool_or("_f").alias("has_360")).where(F.size("_teams") == 2)
    other = F.when(_c("team_id") == _c("_teams")[0], _c("_teams")[1]).otherwise(_c("_teams")[0])
    return e.drop("_f").join(both, "match_id").select("match_id", "team_id", other.alias("opponent_id"), "team_is_home", "has_360")


def extract_corpus(datasets: Mapping[str, DataFrame], window: WindowConfig | None = None, max_tier: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """Features of all data sets (canonical events by name) in one table with ``dataset_slug``, and the data sets that failed, with their reasons.

    Columns that one data set lacks are null there. If every data set fails FeatureError is raised.
    """
    tables, failed = [], {}
    for slug, events in datasets.items():
        try:
            e = materialised(events)
            t = materialised(extract_features(segment_events(e, window or WindowConfig()), match_sides(e), max_tier))
            if t.isEmpty():
                raise FeatureError("no segment")
            tables.append(t.withColumn("dataset_slug", F.lit(slug)))
        except (EngineError, PySparkException) as error:
            failed[slug] = str(error).splitlines()[0]
    if not tables:
        raise FeatureError(f"no data set gave features: {failed}")
    return union_tables(*tables), failed
