"""Provider data, caches and sinks, on files and hand-made rows."""

from __future__ import annotations

import json

import numpy as np
import pytest

from pitchlake.errors import SourceError
from pitchlake.sources import provider, store

EVENTS = [
    {"id": "a", "index": 1, "match_id": 7, "type": "Starting XI", "period": 1, "minute": 0, "second": 0, "timestamp": "00:00:00.000", "team_id": 1},
    {"id": "b", "index": 2, "match_id": 7, "type": "Pass", "period": 1, "minute": 0, "second": 5, "timestamp": "00:00:05.500", "team_id": 1, "player_id": 10.0, "location": [60.0, 40.0], "pass_end_location": [80.0, 50.0], "under_pressure": True},
    {"id": "c", "index": 3, "match_id": 7, "type": "Shot", "period": 1, "minute": 1, "second": 30, "timestamp": "00:01:30.000", "team_id": 2, "location": [0.0, 0.0], "shot_outcome": "Goal", "shot_body_part": "Right Foot", "shot_end_location": [120.0, 80.0, 1.0]},
    {"id": "d", "index": 4, "match_id": 7, "type": "Half End", "period": 1, "minute": 45, "second": 0, "timestamp": "00:45:00.000", "team_id": 1},
    {"id": "e", "index": 5, "match_id": 7, "type": "Strange", "period": 2, "minute": 46, "second": 0, "timestamp": "00:01:00.000", "team_id": 1},
]
#: As the provider sends them: neither player nor position.
FRAMES = [
    {"event_uuid": "b", "freeze_frame": [{"teammate": True, "actor": True, "keeper": False, "location": [60.0, 40.0]}]},
    {"event_uuid": "b", "freeze_frame": [{"teammate": False, "actor": False, "keeper": True, "location": [120.0, 80.0]}, {"teammate": True, "actor": True, "keeper": False, "location": None}]},
    {"event_uuid": None, "freeze_frame": []},
    {"event_uuid": "c", "freeze_frame": []},
]
MATCHES = [{"match_id": 7, "match_date": "2024-05-01", "competition": {"competition_name": "Cup"}, "season": {"season_name": "2024"}, "home_team": {"home_team_id": 1, "home_team_name": "A"}, "away_team": {"away_team_id": 2, "away_team_name": "B"}, "home_score": 0, "away_score": 1}]
SPELL = {"position_id": 1, "position": "Goalkeeper", "from": "00:00", "to": None, "from_period": 1, "to_period": None, "start_reason": "Starting XI", "end_reason": None}
LINEUPS = [{"match_id": 7, "team_id": 1, "team_name": "A", "lineup": [{"player_id": 10, "player_name": "X", "jersey_number": None, "positions": [SPELL], "cards": [{"time": "9:00", "card_type": "Yellow Card", "reason": None, "period": 1}]}, {"player_id": 11, "player_name": "Y", "jersey_number": 4, "positions": [], "cards": []}]}]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("provider")
    for name, rows in (("events", EVENTS), ("frames", FRAMES), ("matches", MATCHES), ("lineups", LINEUPS)):
        (top / name).mkdir()
        (top / name / "7.json").write_text(json.dumps(rows))
    return str(top)


def test_events_of_files(spark, folder):
    """No column of the provider's is needed that these events lack; values are those of the hand-checked list."""
    got = {r.event_id: r for r in provider.JsonAdapter(spark, folder).load_events(with_frames=True).collect()}
    assert set(got) == {"b", "c"}
    b, c = got["b"], got["c"]
    assert (b.x, b.y, round(b.end_x, 2), b.end_y, b.timestamp) == (50, 50, 66.67, 37.5, 5.5)
    assert (b.event_outcome, b.under_pressure, b.player_id, b.team_is_home, b.score_away) == ("complete", True, "10", True, 0)
    assert (c.x, c.y, c.end_x, c.end_y, c.timestamp) == (0, 100, 100, 0, 90) and c.body_part == "right_foot"
    assert (c.event_outcome, c.under_pressure, c.player_id, c.score_away, c.seq) == ("goal", False, "unknown", 1, 2)
    # the last frame of an event wins; a player without a place is dropped; an empty frame is none
    assert [tuple(p) for p in b.freeze_frame] == [("unknown", False, 100.0, 0.0, "unknown")] and c.freeze_frame is None


def test_events_without_optional_columns(spark):
    rows = [("a", 1, 7, "Pressure", 1, 0, 1, "00:00:01.000", 1)]
    raw = spark.createDataFrame(rows, "id string, index int, match_id int, type string, period int, minute int, second int, timestamp string, team_id int")
    r = provider.normalise_events(raw).first()
    assert (r.event_type, r.event_outcome, r.body_part, r.player_id, r.x, r.under_pressure, r.freeze_frame) == ("pressure", "success", "unknown", "unknown", None, False, None)


def test_nan_is_null(spark):
    rows = [("a", 1, 7, "Pass", 1, 0, 1, "00:00:01.000", 1, float("nan"), None)]
    raw = spark.createDataFrame(rows, "id string, index int, match_id int, type string, period int, minute int, second int, timestamp string, team_id int, player_id double, pass_outcome string")
    assert provider.normalise_events(raw).first().player_id == "unknown"


def test_skipped(spark, folder):
    raw = spark.read.option("multiLine", True).json(f"{folder}/events")
    assert {(r.type, r.n, r.known) for r in provider.skipped_types(raw).collect()} == {("Starting XI", 1, True), ("Half End", 1, True), ("Strange", 1, False)}
    with pytest.raises(SourceError):
        provider.check_vocabulary(spark.createDataFrame([("odd",)], "event_type string"))


def test_matches_and_lineups(spark, folder):
    a = provider.JsonAdapter(spark, folder)
    m = a.list_matches().first()
    assert (m.match_id, m.competition, m.home_team_id, m.away_score) == ("7", "Cup", "1", 1)
    x, y = a.load_lineups().orderBy("player_id").collect()
    assert (x.starter, x.jersey_number, x.positions[0].end_reason, x.cards[0].reason) == (True, 0, "unknown", "unknown")
    assert (y.starter, y.jersey_number, y.positions, y.cards) == (False, 4, [], [])


def test_store(spark, folder, tmp_path):
    tables = store.TableStore(spark, f"file://{tmp_path}/store")
    summary, failed = store.ingest(tables, {"good": provider.JsonAdapter(spark, folder), "bad": provider.JsonAdapter(spark, f"{folder}/absent")})
    assert list(failed) == ["bad"]
    assert sorted((r.dataset, r.matches, r.events) for r in summary.collect()) == [("TOTAL", 1, 2), ("good", 1, 2)]
    assert tables.exists("events/good") and not tables.exists("events/bad") and [r.match_id for r in tables.keys("events/good").collect()] == ["7"]
    made = []
    again = tables.get_or_put("events/good", lambda: made.append(1))
    assert again.count() == 2 and not made
    assert tables.get_or_put("new", lambda: again).count() == 2 and tables.exists("new")
    more = again.limit(1).withColumn("match_id", store.F.lit("8"))
    tables.put("new", more)
    assert sorted(str(r.match_id) for r in tables.get("new").collect()) == ["7", "7", "8"]
    assert not store.has_frames(again, "7")
    with pytest.raises(SourceError):
        store.ingest(tables, {"bad": provider.JsonAdapter(spark, f"{folder}/absent")})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, "b"), (1, 1.25, None)], "i int, v double, s string")
    store.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert store.write_npy(df, f"{tmp_path}/x.npy", ["i", "v"], ["i"]) == 2
    assert np.load(f"{tmp_path}/x.npy").tolist() == [[1, 1.25], [2, 0.5]]
    assert [(r.i, r.v) for r in store.read_npy(spark, f"{tmp_path}/x.npy").orderBy("i").collect()] == [(0, [1, 1.25]), (1, [2, 0.5])]
    with pytest.raises(ValueError, match="too many"):
        store.write_npy(df, f"{tmp_path}/y.npy", ["i", "v"], ["i"], limit=3)
    store.write_text(spark, f"{tmp_path}/summary.json", store.summary_json(spark.createDataFrame([(5, 0.123456)], "best_k int, score double")))
    assert store.read_point(spark, f"{tmp_path}/summary.json", "best_k") == 5
    assert json.loads(store.read_text(spark, f"{tmp_path}/summary.json"))["score"] == 0.1235
    for field, path in (("other", f"{tmp_path}/summary.json"), ("best_k", f"{tmp_path}/none.json")):
        with pytest.raises(SourceError):
            store.read_point(spark, path, field)
    with pytest.raises(SourceError):
        store.read_text(spark, f"{tmp_path}/none.json")
    assert store.text_table(df.orderBy("i"), {"v": ".1f"}, "T").split("\n") == ["T", "i    v  s", "-  ---  -", "1  1.2  -", "2  0.5  b"]
    assert store.union_tables(df, df.drop("s")).where("s IS NULL").count() == 3
    with pytest.raises(ValueError, match="two tables"):
        store.hconcat([df, df], ["i"])
