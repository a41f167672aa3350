"""Seeded synthetic season: landed CSV files of a few short matches."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd


def make_match(match_id: int, seed: int, seconds: int = 60, hz: int = 5, percent: bool = False):
    """Tracking, events and provider sequences of one match (both halves)."""
    rng = np.random.default_rng(seed)
    teams = (100, 200 + match_id)
    players = [(teams[s] * 100 + i, teams[s]) for s in (0, 1) for i in range(11)]
    track, events, seqs = [], [], []
    event_no = 0
    for period in (0, 1):
        n = seconds * hz
        t = (np.arange(n) * (1000 // hz) + (2_700_000 if period else 0)).astype(int)
        home_right = period == 0
        base = rng.uniform(0.15, 0.85, (22, 2))
        pos = np.clip(base[None] + np.cumsum(rng.normal(0, 0.003, (n, 22, 2)), axis=0), 0, 1)
        # possession spells: one team holds the ball, moving it along between its players
        ball = np.full((n, 2), np.nan)
        holder = np.full(n, -1)
        i = 0
        while i < n:
            spell = int(rng.integers(4 * hz, 16 * hz))
            team = int(rng.integers(0, 2))
            stop = min(n, i + spell)
            goal = 1.0 if (team == 0) == home_right else 0.0
            x0 = rng.uniform(0.2, 0.6)
            start = np.array([x0 if goal else 1 - x0, rng.uniform(0.1, 0.9)])
            end = np.array([goal + (0.08 if goal == 0 else -0.08), rng.uniform(0.2, 0.8)])
            reach = rng.uniform(0.3, 1.0)
            steps = np.linspace(0, reach, stop - i)[:, None]
            ball[i:stop] = start + (end - start) * steps
            ids, k = [], i
            kinds = ["recovery" if rng.random() < 0.5 else "pass"]
            while k < stop:
                p = team * 11 + int(rng.integers(0, 11))
                hold = min(stop, k + int(rng.integers(hz, 3 * hz)))
                pos[k:hold, p] = ball[k:hold] + rng.normal(0, 0.0005, (hold - k, 2))
                holder[k:hold] = p
                last = hold >= stop
                kind = kinds.pop() if kinds else ("shot" if last and rng.random() < 0.4 else "pass")
                prop = {}
                if kind == "shot":
                    prop = {"outcome": str(rng.choice(["Goal", "OffTarget", "Saved", "Blocked"])), "xG": round(float(rng.uniform(0.02, 0.5)), 3)}
                entry = [{"event_type": kind.capitalize(), "property": prop}]
                if rng.random() < 0.08:
                    entry.append({"event_type": "setPiece", "property": {"type": str(rng.choice(["throwIn", "goalKick", "corner"]))}})
                shift = rng.normal(0, 0.06, 2) if rng.random() < 0.1 else np.zeros(2)
                event_no += 1
                place = np.clip(pos[k, p] + shift, 0, 1)
                to = ball[min(hold, stop - 1)]
                scale = 100 if percent else 1
                events.append({
                    "match_id": match_id, "id": f"e{event_no}", "player_id": players[p][0], "team_id": players[p][1], "period_order": period,
                    "event_time": int(t[k]), "x": place[0] * scale, "y": place[1] * scale, "to_x": to[0] * scale, "to_y": to[1] * scale,
                    "player_name": f"P{players[p][0]}", "team_name": f"Club {players[p][1]}",
                    "attack_direction": "right" if (players[p][1] == teams[0]) == home_right else "left", "events": json.dumps(entry),
                    "match_start_time": "2025-11-15T17:00:00", "season_id": 9, "sport_type": "FOOTBALL"})
                ids.append(f"e{event_no}")
                k = hold
            seqs.append({"sequence_id": f"s{len(seqs) + 1}", "team_id": teams[team], "period": period, "start": int(t[i]), "end": int(t[stop - 1]),
                         "ids": ids, "dist": float(np.hypot(*((ball[stop - 1] - ball[i]) * [102, 64]))), "passes": max(0, len(ids) - 1),
                         "prog": float(abs(ball[stop - 1, 0] - ball[i, 0]) * 102), "dir": "forward"})
            if rng.random() < 0.25:
                gap = min(n, stop + 5)
                ball[stop:gap] = np.nan
                stop = gap
            i = stop
        for k in range(n):
            for p, (pid, team) in enumerate(players):
                track.append((match_id, k + period * n, int(t[k]), period, pid, f"P{pid}", team, f"Club {team}", pos[k, p, 0], pos[k, p, 1],
                              ball[k, 0], ball[k, 1], ["home", "away", "neutral"][holder[k] // 11 if holder[k] >= 0 else 2]))
    tr = pd.DataFrame(track, columns=["match_id", "frame", "match_time", "period", "player_id", "player_name", "team_id", "team_name", "x", "y",
                                      "ball_x", "ball_y", "ball_state"])
    tr["dist_ball"] = np.hypot(tr.x - tr.ball_x, tr.y - tr.ball_y)
    tr["poseedor"], tr["tipo_posesion"] = 0, ""
    # one more row of the own team, and one duplicate
    tr = pd.concat([tr, tr.iloc[[0]].assign(frame=-1, match_time=0), tr.iloc[[5]]], ignore_index=True)
    return tr, pd.DataFrame(events), pd.DataFrame(seqs)


def write_season(root: str, matches: int = 3, seconds: int = 60) -> dict[str, str]:
    """Match 1 snake_case sequences, match 2 camelCase in seconds, match 3 none and percent coordinates."""
    folders = {k: os.path.join(root, k) for k in ("tracking", "events", "sequences")}
    for f in folders.values():
        os.makedirs(f, exist_ok=True)
    for m in range(1, matches + 1):
        tr, ev, sq = make_match(m, 42 + m, seconds, percent=m == 3)
        tr.to_csv(f"{folders['tracking']}/partido_{m}_tracking_poseedor.csv", index=False)
        ev.to_csv(f"{folders['events']}/partido_{m}_eventing.csv", index=False, encoding="utf-8-sig")
        if m % 3 == 1:
            out = pd.DataFrame({"sequence_id": sq.sequence_id, "team_id": sq.team_id, "period_order": sq.period, "start_time_ms": sq.start,
                                "end_time_ms": sq.end, "event_ids": sq.ids.map(json.dumps), "total_distance": sq.dist,
                                "num_of_passes": sq.passes, "progress_distance": sq.prog, "progress_direction": sq.dir})
        elif m % 3 == 2:
            out = pd.DataFrame({"sequenceId": sq.sequence_id, "teamId": sq.team_id, "periodOrder": sq.period, "startTime": sq.start,
                                "durationSec": (sq.end - sq.start) / 1000, "eventIds": sq.ids.map(", ".join), "totalDistance": sq.dist,
                                "numOfPasses": sq.passes})
        else:
            continue
        out.to_csv(f"{folders['sequences']}/partido_{m}_sequences.csv", index=False)
    return folders
