"""Segments and features as SQL, written apart from the column expressions, to check these."""

from __future__ import annotations

from pitchlake.sources.bridge import EVENTS_SQL

WINDOW, OVERLAP, LEAST = 14400.0, 4800.0, 3
STEP = WINDOW - OVERLAP
#: Added before rounding, so that values between two rounded ones go the same way in both engines.
STEADY = 3.7e-10

SEGMENTS_SQL = f"""
{EVENTS_SQL},
wlow AS (SELECT *, min(timestamp) OVER (PARTITION BY match_id, period) AS low FROM ev),
wid AS (SELECT *, unnest(generate_series(greatest(0, floor((timestamp - low - {WINDOW}) / {STEP})::BIGINT + 1), floor((timestamp - low) / {STEP})::BIGINT)) AS segment FROM wlow),
wev AS (SELECT *, low + segment * {STEP}::DOUBLE AS start_time, low + segment * {STEP}::DOUBLE + {WINDOW}::DOUBLE AS end_time,
        count(*) OVER (PARTITION BY match_id, period, segment) AS n FROM wid),
pin AS (SELECT *, lag(team_id) OVER o AS lt, lag(period) OVER o AS lp, lag(event_type) OVER o AS le, lead(team_id) OVER o AS nt, lead(period) OVER o AS np, lead(event_type) OVER o AS ne
        FROM ev WHERE event_type NOT IN ('substitution', 'goal_keeper') WINDOW o AS (PARTITION BY match_id ORDER BY seq)),
pid AS (SELECT *, sum(CASE WHEN lt IS NULL OR lp <> period OR lt <> team_id OR le = 'shot' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY seq)::BIGINT - 1 AS segment,
        CASE WHEN event_type = 'shot' THEN 'shot' WHEN nt IS NULL OR np <> period THEN 'end_of_period' WHEN nt <> team_id THEN CASE WHEN ne LIKE 'set_piece%' THEN 'dead_ball' ELSE 'turnover' END END AS fin FROM pin),
pev AS (SELECT *, min(timestamp) OVER g AS start_time, max(timestamp) OVER g AS end_time, count(*) OVER g AS n FROM pid WINDOW g AS (PARTITION BY match_id, segment)),
seg AS (
  SELECT 'window' AS segment_type, match_id, period, segment, start_time, end_time, team_id, timestamp, match_minute, x, y, end_x, end_y, event_type, event_outcome, under_pressure, freeze_frame, score_home, score_away, seq FROM wev WHERE n >= {LEAST}
  UNION ALL
  SELECT 'possession', match_id, period, segment, start_time, end_time, team_id, timestamp, match_minute, x, y, end_x, end_y, event_type, event_outcome, under_pressure, freeze_frame, score_home, score_away, seq FROM pev WHERE n >= {LEAST})
"""

PREPARED_SQL = f"""
{SEGMENTS_SQL},
p1 AS (
  SELECT *, end_x - x AS dx, end_y - y AS dy, sqrt((end_x - x) * (end_x - x) + (end_y - y) * (end_y - y)) AS len,
         timestamp - lag(timestamp) OVER t AS gap,
         last_value(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {{'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY segment_type, match_id, period, segment, team_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place,
         lag(team_id) OVER s AS before,
         lead(team_id, 1) OVER s AS t1, lead(team_id, 2) OVER s AS t2, lead(team_id, 3) OVER s AS t3, lead(event_type, 1) OVER s AS k1, lead(event_type, 2) OVER s AS k2, lead(event_type, 3) OVER s AS k3,
         lead(x, 1) OVER s AS x1, lead(x, 2) OVER s AS x2, lead(y, 1) OVER s AS y1, lead(y, 2) OVER s AS y2, lead(timestamp, 1) OVER s AS s1, lead(timestamp, 2) OVER s AS s2
  FROM seg
  WINDOW t AS (PARTITION BY segment_type, match_id, period, segment, team_id ORDER BY seq), s AS (PARTITION BY segment_type, match_id, period, segment ORDER BY seq)),
p2 AS (
  SELECT *, coalesce(t1 = team_id AND k1 <> 'pressure', false) OR coalesce(t2 = team_id AND k2 <> 'pressure', false) OR coalesce(t3 = team_id AND k3 <> 'pressure', false) AS regained,
         coalesce(before <> team_id, false) AS turn,
         (x IS NOT NULL AND y IS NOT NULL) AS m0, coalesce(t1 = team_id AND x1 IS NOT NULL AND y1 IS NOT NULL, false) AS m1, coalesce(t2 = team_id AND x2 IS NOT NULL AND y2 IS NOT NULL, false) AS m2,
         coalesce((t1 = before AND k1 = 'pressure')::INT, 0) + coalesce((t2 = before AND k2 = 'pressure')::INT, 0) AS back FROM p1),
p3 AS (
  SELECT *, CASE WHEN m0::INT + m1::INT + m2::INT >= 2 THEN (CASE WHEN m2 THEN x2 ELSE x1 END) - (CASE WHEN m0 THEN x ELSE x1 END) END AS gain,
         CASE WHEN m0::INT + m1::INT + m2::INT >= 2 THEN (CASE WHEN m2 THEN s2 ELSE s1 END) - (CASE WHEN m0 THEN timestamp ELSE s1 END) END AS gain_time FROM p2),
f AS (
  SELECT p3.*, c.focal, c.home, team_id = c.focal AS own, x IS NOT NULL AND y IS NOT NULL AS loc, x IS NOT NULL AND y IS NOT NULL AND end_x IS NOT NULL AND end_y IS NOT NULL AS go
  FROM p3 CROSS JOIN (VALUES ('team_a', true), ('team_b', false)) c(focal, home))
"""

_ZONE = "CASE WHEN {0} < 33.3 THEN 'def' WHEN {0} > 66.7 THEN 'att' ELSE 'mid' END"
_BOX = "({0} > 83.3 AND {1} > 21.1 AND {1} < 78.9)"


def _avg(value: str, where: str) -> str:
    return f"avg({value}) FILTER ({where})"


def _pct(what: str, where: str) -> str:
    return f"avg(({what})::INT::DOUBLE) FILTER ({where})"


def _n(where: str) -> str:
    return f"(count(*) FILTER ({where}))::DOUBLE"


def _tiers() -> dict[str, str]:
    here, ours = "own AND loc", "own AND event_type = "
    goal = "sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50))"
    t = {
        "t1_spatial_event_centroid_x": _avg("x", here),
        "t1_spatial_event_centroid_y": _avg("y", here),
        "t1_spatial_event_spread_x": f"stddev_pop(x) FILTER ({here})",
        "t1_spatial_event_spread_y": f"stddev_pop(y) FILTER ({here})",
        "t1_spatial_avg_distance_to_goal": _avg(goal, here),
        "t1_spatial_attacking_third_pct": _pct("x > 66.7", here),
        "t1_spatial_middle_third_pct": _pct("x >= 33.3 AND x <= 66.7", here),
        "t1_spatial_defensive_third_pct": _pct("x < 33.3", here),
        "t1_spatial_left_channel_pct": _pct("y > 66.7", here),
        "t1_spatial_center_channel_pct": _pct("y >= 33.3 AND y <= 66.7", here),
        "t1_spatial_right_channel_pct": _pct("y < 33.3", here),
    }
    span = "(max(timestamp) FILTER (own) - min(timestamp) FILTER (own))"
    ok = f"count(*) FILTER (own) >= 2 AND {span} > 0"
    t |= {
        "t1_temporal_event_rate": f"CASE WHEN {ok} THEN count(*) FILTER (own) / {span} END",
        "t1_temporal_mean_inter_event_time": f"CASE WHEN {ok} THEN avg(gap) FILTER (own) END",
        "t1_temporal_std_inter_event_time": f"CASE WHEN {ok} THEN stddev_pop(gap) FILTER (own) END",
        "t1_temporal_max_inter_event_time": f"CASE WHEN {ok} THEN max(gap) FILTER (own) END",
        "t1_temporal_match_minute": _avg("match_minute", "own"),
        "t1_temporal_period": "(max(period) FILTER (own))::DOUBLE",
    }
    p = "own AND event_type = 'pass' AND go"
    t |= {
        "t1_pass_count": _n(ours + "'pass'"),
        "t1_pass_completion_rate": _pct("event_outcome = 'complete'", ours + "'pass'"),
        "t1_pass_length_mean": _avg("len", p),
        "t1_pass_length_std": f"stddev_pop(len) FILTER ({p})",
        "t1_pass_angle_std": f"stddev_pop(atan2(dy, dx)) FILTER ({p})",
        "t1_pass_progressive_count": f"CASE WHEN count(*) FILTER ({p}) > 0 THEN {_n(p + ' AND dx > 10')} END",
        "t1_pass_backward_ratio": _pct("dx < 0", p),
        "t1_pass_height_ground_pct": "NULL",
        "t1_pass_height_low_pct": "NULL",
        "t1_pass_height_high_pct": "NULL",
        "t1_pass_switch_count": f"CASE WHEN count(*) FILTER ({p}) > 0 THEN {_n(p + ' AND abs(dy) > 50')} END",
        "t1_pass_directness": _avg("dx / len", p + " AND len > 0"),
    }
    c = "own AND event_type = 'carry' AND go"
    t |= {
        "t1_carry_count": _n(ours + "'carry'"),
        "t1_carry_distance_total": f"sum(len) FILTER ({c})",
        "t1_carry_distance_mean": _avg("len", c),
        "t1_carry_directness": _avg("dx / len", c + " AND len > 0"),
        "t1_carry_progressive_count": _n(c + " AND dx > 10"),
        "t1_carry_dribble_attempt_count": _n(ours + "'carry'"),
        "t1_carry_dribble_success_rate": "NULL",
    }
    d = "own AND event_type IN ('tackle', 'duel')"
    t |= {
        "t1_defend_pressure_count": _n(ours + "'pressure'"),
        "t1_defend_pressure_rate": f"{_n(ours + chr(39) + 'pressure' + chr(39))} / count(*)",
        "t1_defend_tackle_count": _n(d),
        "t1_defend_tackle_success_rate": _pct("event_outcome IN ('won', 'success', 'success_in_play', 'success_out')", d),
        "t1_defend_interception_count": _n(ours + "'interception'"),
        "t1_defend_clearance_count": _n(ours + "'clearance'"),
        "t1_defend_foul_count": _n(ours + "'foul_committed'"),
        "t1_defend_under_pressure_pct": _pct("under_pressure", "own"),
        "t1_defend_defensive_action_height": _avg("100 - x", here + " AND event_type IN ('tackle', 'interception', 'clearance', 'block')"),
        "t1_shoot_count": _n(ours + "'shot'"),
        "t1_shoot_distance_mean": _avg(goal, here + " AND event_type = 'shot'"),
        "t1_context_score_differential": "arg_max(CASE WHEN home THEN score_home - score_away ELSE score_away - score_home END, seq)::DOUBLE",
        "t1_context_possession_share": "avg(own::INT::DOUBLE)",
        "t1_context_possession_team": "arg_max(own::INT, seq)::DOUBLE",
    }
    moved = here + " AND place IS NOT NULL"
    now, was = _ZONE.format("x"), _ZONE.format("place.x")
    t |= {f"t2_zonal_zone_{a}_to_{b}": _pct(f"{was} = '{a}' AND {now} = '{b}'", moved) for a in ("def", "mid", "att") for b in ("def", "mid", "att")}
    into, out = _BOX.format("x", "y"), _BOX.format("place.x", "place.y")
    engaged = "NOT own AND loc AND event_type IN ('tackle', 'foul_committed', 'interception', 'block')"
    press = here + " AND event_type = 'pressure'"
    won, lost = "turn AND own", "turn AND NOT own"
    t |= {
        "t2_zonal_box_entries": _n(f"{moved} AND NOT {out} AND {into}"),
        "t2_zonal_box_exits": _n(f"{moved} AND {out} AND NOT {into}"),
        "t2_shape_team_centroid_x_est": _avg("x", here),
        "t2_shape_team_centroid_y_est": _avg("y", here),
        "t2_shape_team_spread_est": f"sqrt(var_pop(x) FILTER ({here}) + var_pop(y) FILTER ({here}))",
        "t2_shape_engagement_line": f"CASE WHEN count(*) FILTER ({engaged}) >= 2 THEN 100 - median(x) FILTER ({engaged}) END",
        "t2_shape_compactness_proxy": f"max(x) FILTER ({here}) - min(x) FILTER ({here})",
        "t2_press_intensity": f"{_n(ours + chr(39) + 'pressure' + chr(39))} / nullif(count(*) FILTER (NOT own), 0)",
        "t2_press_trigger_x": _avg("x", press),
        "t2_press_trigger_y": _avg("y", press),
        "t2_press_success_rate": _pct("regained", ours + "'pressure'"),
        "t2_press_ppda": f"{_n('NOT own AND event_type = ' + chr(39) + 'pass' + chr(39))} / nullif(count(*) FILTER (own AND event_type IN ('tackle', 'interception', 'foul_committed')), 0)",
        "t2_transition_counter_attack_indicator": f"max(coalesce(gain > 25, false)::INT::DOUBLE) FILTER ({won})",
        "t2_transition_counter_press_indicator": f"max((back >= 2)::INT::DOUBLE) FILTER ({lost})",
        "t2_transition_transition_speed": _avg("gain / gain_time", won + " AND gain_time > 0"),
    }
    return t


#: Columns of the hull, which has a text of its own.
HULL = ("t3_formation_convex_hull_area", "t3_formation_convex_hull_perimeter")


def feature_names_sql() -> list[str]:
    """The features of tiers 1 and 2."""
    return list(_tiers())


def features_sql(tier: int) -> str:
    """One row per segment and team with the features of tier 1 or 2, rounded to 8 digits."""
    sql = _tiers()
    names = [n for n in sql if n.startswith(f"t{tier}_")]
    columns = ", ".join(f"CAST(round({sql[n]} + {STEADY}::DOUBLE, 8) AS DOUBLE) AS {n}" for n in names)
    return f"WITH {PREPARED_SQL} SELECT match_id, focal AS team_id, segment_type, segment, period, round(start_time, 8) AS start_time, round(end_time, 8) AS end_time, round(min(match_minute), 8) AS match_minute, {columns} FROM f GROUP BY match_id, focal, home, segment_type, segment, period, start_time, end_time"


_LIST3 = "list_avg(list_sort({0})[{1}])"

TIER3_SQL = f"""
WITH {SEGMENTS_SQL},
fr AS (SELECT segment_type, match_id, period, segment, arg_max(freeze_frame, seq) FILTER (freeze_frame IS NOT NULL) AS ff FROM seg GROUP BY ALL),
pl AS (SELECT *, list_filter(ff, lambda q: q.teammate) AS tm, list_filter(ff, lambda q: NOT q.teammate) AS op FROM fr),
xy AS (SELECT *, list_transform(tm, lambda q: q.x) AS tx, list_transform(tm, lambda q: q.y) AS ty, list_transform(op, lambda q: q.x) AS ox FROM pl),
st AS (SELECT *, list_var_pop(tx) AS a, list_var_pop(ty) AS c, list_avg(list_transform(tm, lambda q: (q.x - list_avg(tx)) * (q.y - list_avg(ty)))) AS b,
       list_transform(tm, lambda t: list_min(list_transform(op, lambda o: sqrt((t.x - o.x) * (t.x - o.x) + (t.y - o.y) * (t.y - o.y))))) AS near FROM xy),
ev2 AS (SELECT *, (a + c) / 2 + sqrt((a - c) / 2 * ((a - c) / 2) + b * b) AS major, (a + c) / 2 - sqrt((a - c) / 2 * ((a - c) / 2) + b * b) AS minor, len(tx) >= 3 AS ok, len(tx) > 0 AND len(ox) >= 3 AS ok2 FROM st)
SELECT match_id, team AS team_id, segment_type, segment, period,
  round(CASE WHEN ok THEN list_avg(tx) END, 8) AS t3_formation_team_centroid_x, round(CASE WHEN ok THEN list_avg(ty) END, 8) AS t3_formation_team_centroid_y,
  round(CASE WHEN ok THEN sqrt(a) END, 8) AS t3_formation_team_spread_x, round(CASE WHEN ok THEN sqrt(c) END, 8) AS t3_formation_team_spread_y,
  round(CASE WHEN ok THEN list_max(ty) - list_min(ty) END, 8) AS t3_formation_team_width, round(CASE WHEN ok THEN list_max(tx) - list_min(tx) END, 8) AS t3_formation_team_length,
  round(CASE WHEN ok THEN {_LIST3.format("tx", ":3")} END, 8) AS t3_formation_defensive_line, round(CASE WHEN ok THEN list_median(tx) END, 8) AS t3_formation_midfield_line,
  round(CASE WHEN ok THEN {_LIST3.format("tx", "-3:")} END, 8) AS t3_formation_attacking_line,
  round(CASE WHEN ok THEN list_median(tx) - {_LIST3.format("tx", ":3")} END, 8) AS t3_formation_def_mid_gap, round(CASE WHEN ok THEN {_LIST3.format("tx", "-3:")} - list_median(tx) END, 8) AS t3_formation_mid_att_gap,
  round(CASE WHEN ok THEN CASE WHEN major <= 0 THEN 0 ELSE sqrt(greatest(0, 1 - (minor / major) * (minor / major))) END END, 8) AS t3_formation_formation_eccentricity,
  round(CASE WHEN ok2 THEN list_avg(near) END, 8) AS t3_relational_avg_nearest_opponent_dist, round(CASE WHEN ok2 THEN list_min(near) END, 8) AS t3_relational_min_nearest_opponent_dist,
  round(CASE WHEN ok2 THEN list_avg(ox) END, 8) AS t3_relational_opp_centroid_x, round(CASE WHEN ok2 THEN sqrt(list_var_pop(ox)) END, 8) AS t3_relational_opp_spread_x,
  round(CASE WHEN ok2 THEN {_LIST3.format("ox", "-3:")} END, 8) AS t3_relational_opp_defensive_line
FROM ev2 CROSS JOIN (VALUES ('team_a'), ('team_b')) v(team)
"""

#: A hull's edges: pairs of points with no point to their right, and none on their line beyond them.
HULL_SQL = f"""
WITH {SEGMENTS_SQL},
fr AS (SELECT segment_type, match_id, period, segment, arg_max(freeze_frame, seq) FILTER (freeze_frame IS NOT NULL) AS ff FROM seg GROUP BY ALL),
pt AS (SELECT DISTINCT segment_type, match_id, period, segment, q.x AS x, q.y AS y FROM (SELECT segment_type, match_id, period, segment, unnest(ff) AS q FROM fr) WHERE q.teammate),
ab AS (SELECT a.segment_type, a.match_id, a.period, a.segment, a.x AS ax, a.y AS ay, b.x AS cx, b.y AS cy FROM pt a JOIN pt b USING (segment_type, match_id, period, segment) WHERE a.x <> b.x OR a.y <> b.y),
abp AS (SELECT ab.*, (cx - ax) * (p.y - ay) - (cy - ay) * (p.x - ax) AS side, (p.x - ax) * (cx - ax) + (p.y - ay) * (cy - ay) AS along, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) AS whole FROM ab JOIN pt p USING (segment_type, match_id, period, segment)),
edge AS (SELECT segment_type, match_id, period, segment, ax, ay, cx, cy FROM abp GROUP BY ALL HAVING bool_and(side > 0 OR (side = 0 AND along BETWEEN 0 AND whole))),
hull AS (SELECT segment_type, match_id, period, segment, sum(ax * cy - cx * ay) / 2 AS area, sum(sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))) AS ring FROM edge GROUP BY ALL)
SELECT match_id, team AS team_id, segment_type, segment, period, round(CASE WHEN area <> 0 THEN area END, 8) AS {HULL[0]}, round(CASE WHEN area <> 0 THEN ring END, 8) AS {HULL[1]}
FROM fr LEFT JOIN hull USING (segment_type, match_id, period, segment) CROSS JOIN (VALUES ('team_a'), ('team_b')) v(team)
"""
