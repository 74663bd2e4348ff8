"""Windows and possessions on small hand-made matches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pitchlake.config import ChangepointConfig, MixtureConfig, PipelineConfig, PreprocessConfig, WindowConfig
from pitchlake.errors import FeatureError, SegmentationError
from pitchlake.operators import segments as seg
from pitchlake.operators.features import Extractor, FeatureRegistry, convex_hull, default_registry, extract_features

SCHEMA = "match_id string, team_id string, period int, timestamp double, match_minute double, x double, y double, end_x double, end_y double, event_type string, event_outcome string, under_pressure boolean, freeze_frame array<struct<player_id:string,teammate:boolean,x:double,y:double,position:string>>, score_home int, score_away int, player_id string, body_part string, seq long"


def events(spark, rows):
    """rows: (team, timestamp, type) and optionally period, x, y, outcome, frame."""
    out = []
    for i, r in enumerate(rows):
        team, ts, kind, *more = r
        period, x, y, outcome, frame = [*more, *[1, None, None, "complete", None][len(more) :]]
        out.append(("m", team, period, float(ts), ts / 60, x, y, None, None, kind, outcome, False, frame, 0, 0, "p", "right_foot", i + 1))
    return spark.createDataFrame(out, SCHEMA)


def contexts(spark):
    return spark.createDataFrame([("m", "a", True), ("m", "b", False)], "match_id string, team_id string, team_is_home boolean")


@pytest.mark.parametrize(
    ("times", "config", "counts"),
    [
        (range(0, 60, 3), WindowConfig(15, 5, 3), [5, 5, 5, 5, 5, 3]),
        (range(0, 60, 3), WindowConfig(30, 10, 3), [10, 10, 6]),
        (range(0, 30, 5), WindowConfig(10, 0, 2), [2, 2, 2]),
        ([0, 100], WindowConfig(15, 5, 3), []),
    ],
)
def test_windows(spark, times, config, counts):
    found = seg.windows(events(spark, [("a", t, "pass") for t in times]), config).orderBy("start_time").collect()
    assert [r.n_events for r in found] == counts


def test_windows_by_brute_force(spark):
    rng = random.Random(1)
    times = sorted(rng.randrange(0, 20_000) / 100 for _ in range(150))
    c = WindowConfig(15, 5, 3)
    expected, start = [], times[0]
    while start <= times[-1]:
        if (n := sum(start <= t < start + 15 for t in times)) >= 3:
            expected.append((round(start, 6), n))
        start += 10
    found = seg.windows(events(spark, [("a", t, "pass") for t in times]), c).collect()
    assert sorted((round(r.start_time, 6), r.n_events) for r in found) == expected


def possessions(spark, rows):
    return [(r.team_id, r.n_events, r.outcome) for r in seg.possessions(events(spark, rows)).orderBy("segment").collect()]


def test_possessions(spark):
    passes = lambda team, n, at, period=1: [(team, at + i, "pass", period) for i in range(n)]
    assert possessions(spark, passes("a", 5, 0)) == [("a", 5, "end_of_period")]
    assert possessions(spark, [*passes("a", 3, 0), ("b", 3, "interception"), *passes("b", 3, 4)]) == [("a", 3, "turnover"), ("b", 4, "end_of_period")]
    assert possessions(spark, [*passes("a", 3, 0), ("a", 3, "shot"), *passes("b", 3, 4)]) == [("a", 4, "shot"), ("b", 3, "end_of_period")]
    assert possessions(spark, [*passes("a", 3, 0), ("b", 3, "set_piece_throw_in"), *passes("b", 2, 4)]) == [("a", 3, "dead_ball"), ("b", 3, "end_of_period")]
    assert possessions(spark, [*passes("a", 4, 0), *passes("a", 4, 0, 2)]) == [("a", 4, "end_of_period")] * 2
    assert possessions(spark, [("a", 0, "pass"), ("b", 1, "substitution"), ("a", 2, "pass"), ("a", 3, "pass")]) == [("a", 3, "end_of_period")]
    assert possessions(spark, passes("a", 2, 0)) == []


def test_empty(spark):
    with pytest.raises(SegmentationError):
        seg.require_events(events(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA))


def features(spark, rows, team="a", tier=3):
    e = events(spark, rows)
    out = extract_features(seg.window_events(e, WindowConfig(1000, 0, 1)), contexts(spark), tier)
    return out.where(F.col("team_id") == team).first().asDict()


def test_spatial_and_temporal(spark):
    xy = [10, 20, 30, 40, 50, 55, 60, 70, 80, 90]
    f = features(spark, [("a", i, "pass", 1, float(v), float(v)) for i, v in enumerate(xy)])
    assert f["t1_spatial_event_centroid_x"] == pytest.approx(50.5)
    assert [f[f"t1_spatial_{z}_third_pct"] for z in ("defensive", "middle", "attacking")] == pytest.approx([0.3, 0.4, 0.3])
    assert f["t1_temporal_event_rate"] == pytest.approx(10 / 9)
    assert (f["t1_temporal_mean_inter_event_time"], f["t1_temporal_std_inter_event_time"]) == pytest.approx((1, 0))
    assert f["t1_pass_progressive_count"] is None and f["t1_carry_progressive_count"] == 0
    one = features(spark, [("a", 0, "pass")])
    assert one["t1_temporal_event_rate"] is None and one["t1_temporal_period"] == 1


def test_press_and_transition(spark):
    rows = [("b", 0, "pass"), ("a", 1, "pressure"), ("a", 2, "ball_recovery"), ("b", 3, "pass"), ("a", 4, "pressure"), ("b", 5, "pass"), ("b", 6, "pass"), ("b", 7, "pass")]
    assert features(spark, rows)["t2_press_success_rate"] == pytest.approx(0.5)
    rows = [("b", 0, "pass", 1, 50.0, 50.0), ("a", 1, "ball_recovery", 1, 30.0, 50.0), ("a", 2, "carry", 1, 70.0, 50.0)]
    f = features(spark, rows)
    assert f["t2_transition_counter_attack_indicator"] == 1 and f["t2_transition_transition_speed"] == pytest.approx(40)
    rows = [("b", 0, "tackle", 1, 60.0, 1.0), ("b", 1, "tackle", 1, 80.0, 1.0), ("a", 2, "pass")]
    assert features(spark, rows)["t2_shape_engagement_line"] == pytest.approx(30)


def test_formation(spark):
    frame = lambda mates, others: [("p", t, float(x), float(y), "u") for t, side in ((True, mates), (False, others)) for x, y in side]
    f = features(spark, [("a", 0, "pass", 1, None, None, "complete", frame([(20, 30), (25, 60), (40, 20), (45, 50), (70, 40), (80, 55)], [(30, 45), (40, 55), (55, 35), (65, 50), (75, 60)]))])
    assert (f["t3_formation_midfield_line"], f["t3_formation_team_width"], f["t3_formation_team_length"]) == pytest.approx((42.5, 40, 60))
    square = features(spark, [("a", 0, "pass", 1, None, None, "complete", frame([(40, 40), (40, 60), (60, 40), (60, 60)], []))])
    assert square["t3_formation_formation_eccentricity"] == pytest.approx(0) and square["t3_formation_convex_hull_area"] == pytest.approx(400)
    near = features(spark, [("a", 0, "pass", 1, None, None, "complete", frame([(0, 0), (10, 0), (20, 0)], [(3, 4), (10, 3), (18, 0)]))])
    assert near["t3_relational_avg_nearest_opponent_dist"] == pytest.approx(10 / 3) and near["t3_formation_convex_hull_area"] is None
    assert features(spark, [("a", 0, "pass", 1, None, None, "complete", frame([(0, 0)], []))])["t3_formation_team_centroid_x"] is None


def test_registry(spark):
    r = default_registry()
    assert [len(r.feature_names(t)) for t in (1, 2, 3)] == [50, 74, 93]
    with pytest.raises(FeatureError):
        r.register(Extractor("spatial", 1, dict))
    assert FeatureRegistry().feature_names() == []


def test_hull():
    assert convex_hull([0, 0, 4, 4, 2], [0, 4, 0, 4, 2]) == pytest.approx((16, 16))
    assert convex_hull([0, 1, 2], [0, 1, 2]) == (None, None)


def test_config():
    for make in (lambda: WindowConfig(5, 5), lambda: PreprocessConfig(nulls="x"), lambda: PreprocessConfig(variance=0.0), lambda: ChangepointConfig("x"), lambda: MixtureConfig(covariance="x"), lambda: PipelineConfig(max_tier=4)):
        with pytest.raises(ValueError):
            make()
