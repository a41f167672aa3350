"""Segmentation of random matches against a plain row-by-row model of the same rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchflow.operators import segment as sg

L, W, RIVAL, OWN = 102.0, 64.0, 2, 1
KINDS = ["pass", "pass", "pass", "recovery", "interception", "shot", "clearance", "setpiece", "passreceived"]


def random_match(match_id: int, seed: int, provider: bool):
    rng = np.random.default_rng(seed)
    frames, events, seqs = [], [], []
    for period in (0, 1):
        n = 1600
        t0 = 2_700_000 * period
        x, y = np.cumsum(rng.normal(0, 1.6, n)) + 50, np.cumsum(rng.normal(0, 1.0, n)) + 32
        x, y = np.abs((x + 102) % 204 - 102), np.abs((y + 64) % 128 - 64)
        speed = np.abs(rng.normal(5.5, 2.5, n))
        team, left = OWN, 0
        for i in range(n):
            if left <= 0:
                team, left = int(rng.choice([OWN, RIVAL, RIVAL])), int(rng.integers(4, 60))
            left -= 1
            lost = rng.random() < 0.02
            held = None if rng.random() < 0.35 else team
            frames.append((match_id, period, i + period * n, t0 + 250 * i, None if lost else float(x[i]), None if lost else float(y[i]), float(speed[i]), held))
        t = t0 + 100
        while t < t0 + 250 * n:
            kind = str(rng.choice(KINDS))
            who = int(rng.choice([OWN, RIVAL, RIVAL]))
            text = kind + (" goal" if kind == "shot" and rng.random() < 0.2 else "") + (" shotontarget" if kind == "shot" and rng.random() < 0.3 else "")
            px, py, dx, dy = rng.random(4)
            events.append((match_id, period, t, f"{match_id}-{len(events):05d}", who, [kind], "corner" if kind == "setpiece" and rng.random() < 0.5 else None, text,
                           float(px), float(py), float(dx) if rng.random() < 0.9 else None, float(dy), "right" if (rng.random() < 0.8) == (period == 0) else "left"))
            t += int(rng.integers(300, 2600))
        t = t0 + 1000
        while provider and t < t0 + 250 * n - 20_000:
            end = t + int(rng.choice([700, 2500, 6000, 9000, 14_000, 50_000], p=[.1, .25, .25, .2, .15, .05]))
            ids = [e[3] for e in events if e[0] == match_id and e[1] == period and t <= e[2] <= end] if rng.random() < 0.7 else []
            given = rng.random() < 0.6
            seqs.append((match_id, f"{match_id}-{len(seqs):04d}", int(rng.choice([RIVAL, RIVAL, OWN])), period, float(t), float(end), ids,
                         float(rng.uniform(0, 40)) if given else None, float(rng.integers(0, 5)) if given else None, float(rng.uniform(0, 25)) if given else None,
                         str(rng.choice(["forward", "backward", ""])), ""))
            t = end + int(rng.integers(200, 9000))
    return frames, events, seqs


FRAMES = "match_id long, period long, frame long, match_time long, ball_x_m double, ball_y_m double, ball_speed double, possessing_team long"
EVENTS = ("match_id long, period long, match_time long, event_id string, team_id long, event_types array<string>, setpiece_type string, event_text string, x double, y double, "
          "to_x double, to_y double, attack_direction string")
SEQS = ("match_id long, provider_id string, team_id long, period long, start_ms double, end_ms double, event_ids array<string>, total_distance double, num_passes double, "
        "progress_distance double, progress_direction string, ball_status string")


def names(schema):
    return [c.strip().split(" ")[0] for c in schema.split(",")]


class Plain:
    """One match, read row by row."""

    def __init__(self, frames, events, seqs):
        self.fr = pd.DataFrame(frames, columns=names(FRAMES))
        self.ev = pd.DataFrame(events, columns=names(EVENTS)).sort_values("match_time", kind="stable")
        self.sq = [dict(zip(names(SEQS), s)) for s in seqs]
        self.mine = self.ev[self.ev.team_id == RIVAL]
        self.high = {p: sorted(g.attack_direction.value_counts().items(), key=lambda kv: (-kv[1], kv[0]))[0][0] == "right"
                     for p, g in self.mine.groupby("period")}

    def norm(self, v, period):
        return v if self.high.get(period, True) else L - v

    def ball(self, period, a, b):
        g = self.fr[(self.fr.period == period) & self.fr.match_time.between(a, b)]
        return g.dropna(subset=["ball_x_m", "ball_y_m"])

    def path(self, g, period):
        if len(g) < 2:
            return dict(path=0.0, gain=0.0, speed=0.0)
        x, y = g.ball_x_m.to_numpy(), g.ball_y_m.to_numpy()
        return dict(path=float(np.hypot(x[-1] - x[0], y[-1] - y[0])), gain=self.norm(x[-1], period) - self.norm(x[0], period), speed=g.ball_speed.mean())

    def events_of(self, s, a, b, ids):
        m = self.mine
        return m[m.event_id.isin(ids)] if ids else m[(m.period == s["period"]) & m.match_time.between(a, b)]

    def provider(self):
        rival = [s for s in self.sq if s["team_id"] == RIVAL and s["end_ms"] > s["start_ms"]]
        out = []
        for s in sorted(rival, key=lambda s: (s["period"], s["start_ms"])):
            p, a, b, ids, why = s["period"], s["start_ms"], s["end_ms"], list(s["event_ids"]), "cierre_bepro"
            ev = self.events_of(s, a, b, ids)
            had_shot = any("shot" in k for k in ev.event_types)
            if had_shot:
                at, add = a, list(ids)
                while a - at < 15_000:
                    prev = [q for q in rival if q["period"] == p and 0 <= at - q["end_ms"] <= 5000]
                    if not prev:
                        break
                    q = max(prev, key=lambda q: q["end_ms"])
                    at, add = q["start_ms"], add + list(q["event_ids"])
                if at < a:
                    if add:
                        ev = self.events_of(s, at, b, add)
                    a = at
            else:
                later = [q["start_ms"] for q in rival if q["period"] == p and q["start_ms"] > b]
                limit = min([b + 3500] + ([min(later) - 1] if later else []))
                for e in self.ev[(self.ev.period == p) & (self.ev.match_time > b) & (self.ev.match_time <= limit)].itertuples():
                    own = e.team_id != RIVAL
                    if (own and e.event_types[0] in sg.TERMINAL_TYPES) or (not own and e.event_types[0] == "shot"):
                        b, why = min(e.match_time + 500, limit), "cierre_recuperacion_propia" if own else "cierre_tiro_rival"
                        ev = self.events_of(s, a, b, [])
                        break
            g = self.ball(p, a, b)
            if len(g) < 2:
                continue
            m = self.path(g, p)
            x_max = max(self.norm(v, p) for v in g.ball_x_m)
            reach = [x_max] + [self.norm(v * L, p) for c in ("x", "to_x") for v in ev[c].dropna()]
            gain = max(0.0, m["gain"])
            dist = m["path"] if s["total_distance"] is None else s["total_distance"]
            prog = gain if s["progress_distance"] is None else s["progress_distance"]
            if had_shot:
                dist, prog = max(dist, m["path"]), max(prog, gain)
            passes, way = int(s["num_passes"] or 0), s["progress_direction"]
            kind, reason = self.judge(s, ev, a, b, dist, prog, passes, way, gain, x_max, max(reach), p)
            if kind:
                out.append((s["provider_id"], a, b, why, kind, reason, len(ev)))
        return out

    def judge(self, s, ev, a, b, dist, prog, passes, way, gain, x_max, reach, p):
        sec, n = (b - a) / 1000, len(ev)
        if sec < 1 or sec > 45:
            return None, None
        shot = any("shot" in k for k in ev.event_types)
        text = " ".join(ev.event_text)
        stop = ev[ev.setpiece_type.notna()]
        busy = passes >= 2 or n >= 4
        if len(stop):
            t = stop.match_time.min()
            ok = (ev.match_time >= t).sum() >= 2 and b - t >= 4000 and (dist >= 15 or prog >= 8 or passes >= 2)
            return ("balon_parado_con_continuidad", "setpiece_con_continuidad_bepro") if ok and not (way == "backward" and prog < 8) else (None, None)
        first = ev.iloc[0] if n else None
        if n and first.event_types[0] in sg.REGAIN_TYPES:
            if not shot and s["end_ms"] - s["start_ms"] <= 3000 and n <= 2 and passes <= 2 and not (reach >= .57 * L or (gain >= 14 and reach >= .5 * L)):
                return None, None
            if sec >= 2 and n >= 2 and dist >= 10 and sec <= 10 and (gain >= 8 or x_max >= .62 * L or (way == "forward" and prog >= 8)):
                return "transicion_rapida", "origen_recuperacion_rival"
            return ("ataque_elaborado", "recuperacion_con_posesion_elaborada") if n >= 3 and sec >= 6 and dist >= 10 and busy else (None, None)
        pace = "transicion_rapida" if sec <= 10 else "ataque_elaborado"
        if shot and "gol" in text.replace("goal", "gol") and n >= 2:
            return pace, "finalizacion_gol_con_continuidad"
        if shot and ("shotontarget" in text or "goal" in text) and sec >= 2 and n >= 2:
            return pace, "tiro_a_puerta_con_continuidad"
        long_ball = direct = False
        if n and first.event_types[0] == "pass":
            if not (pd.isna(first.to_x) or pd.isna(first.to_y)):
                far = np.hypot((first.to_x - first.x) * L, (first.to_y - first.y) * W)
                long_ball = far >= 15 and self.norm(first.to_x * L, p) - self.norm(first.x * L, p) >= 8
            direct = passes <= 2 and dist >= 15 and prog >= 8 and way == "forward"
        if (long_ball or direct) and (n >= 2 or sec >= 2):
            return "juego_directo", "primer_pase_largo_progresivo"
        return ("ataque_elaborado", "posesion_bepro_elaborada") if n >= 3 and sec >= 6 and dist >= 10 and busy else (None, None)

    def possession(self):
        out = []
        for p, g in self.fr.groupby("period"):
            runs, team, since, before, last_t = [], None, None, None, None
            for f in g.sort_values("match_time").itertuples():
                if not pd.isna(f.possessing_team):
                    team, since, now = f.possessing_team, f.match_time, f.possessing_team
                else:
                    now = team if team is not None and f.match_time - since <= 3500 and f.ball_speed >= 0.3 else None
                mine = now == RIVAL
                if mine and not (before and f.match_time - last_t <= 4000):
                    runs.append([])
                if mine:
                    runs[-1].append(f)
                before, last_t = mine, f.match_time
            for run in runs:
                r = self.block(p, pd.DataFrame(run))
                if r:
                    out.append(r)
        return out

    def block(self, p, g):
        a, b = g.match_time.iloc[0], g.match_time.iloc[-1]
        sec = (b - a) / 1000
        if sec < 1 or sec > 45:
            return None
        ev = self.mine[(self.mine.period == p) & self.mine.match_time.between(a, b)]
        ends = g.iloc[[0, -1]]
        path = float(np.hypot(*(ends[["ball_x_m", "ball_y_m"]].iloc[1] - ends[["ball_x_m", "ball_y_m"]].iloc[0])))
        gain = self.norm(ends.ball_x_m.iloc[1], p) - self.norm(ends.ball_x_m.iloc[0], p)
        speed, n = g.ball_speed.mean(), len(ev)
        stop = ev[ev.setpiece_type.notna()]
        if len(stop):
            ball = self.ball(p, stop.match_time.min(), b)
            step = np.hypot(ball.ball_x_m.diff(), ball.ball_y_m.diff()).to_numpy()
            go = np.flatnonzero(step > 0.5)
            if len(ball) < 2 or not len(go):
                return None
            k = go[0]
            t = ball.match_time.iloc[k]
            kick = np.hypot(ball.ball_x_m.iloc[k] - ball.ball_x_m.iloc[0], ball.ball_y_m.iloc[k] - ball.ball_y_m.iloc[0])
            active, m, later = (ball.match_time.iloc[-1] - t) / 1000, self.path(ball.iloc[k:], p), (ev.match_time >= t).sum()
            if active < 4 or later < 2:
                return None
            if m["path"] >= 10:
                return a, b, "balon_parado_con_continuidad", "setpiece_corto_con_elaboracion" if kick <= 15 else "setpiece_largo_con_elaboracion"
            return None
        fast = n >= 1 and speed >= 5.5 and gain >= 8
        early = ev[ev.match_time <= a + 3000]
        if any("recovery" in k for k in early.event_types) and fast and sec <= 10 and path >= 10:
            return a, b, "transicion_rapida", "recuperacion_y_amenaza"
        if n >= 3 and sec >= 6 and path >= 10:
            return a, b, "ataque_elaborado", "elaboracion_juego_fluido"
        return (a, b, "juego_directo", "desplazamiento_vertical_claro") if fast and path >= 15 else None


@pytest.fixture(scope="module")
def matches():
    return {1: random_match(1, 11, True), 2: random_match(2, 12, True), 3: random_match(3, 13, False), 4: random_match(4, 14, False)}


@pytest.fixture(scope="module")
def found(spark, matches):
    def frame(i, schema):
        return spark.createDataFrame([r for m in matches.values() for r in m[i]], schema)

    teams = spark.createDataFrame([(m, OWN, RIVAL) for m in matches], "match_id long, own_team long, rival_team long")
    out = sg.segment_sequences(frame(0, FRAMES), frame(1, EVENTS), frame(2, SEQS), teams)
    return out.orderBy("match_id", "seq_id").collect()


@pytest.mark.parametrize("m", [1, 2])
def test_provider_path(matches, found, m):
    got = [(r.provider_id, r.start_ms, r.end_ms, r.close_reason, r.sequence_type, r.keep_reason, r.n_rival_events) for r in found if r.match_id == m]
    want = Plain(*matches[m]).provider()
    assert sorted(got) == sorted(want) and len(want) > 5


@pytest.mark.parametrize("m", [3, 4])
def test_tracking_path(matches, found, m):
    got = [(r.start_ms, r.end_ms, r.sequence_type, r.keep_reason) for r in found if r.match_id == m]
    want = Plain(*matches[m]).possession()
    assert sorted(got) == sorted(want) and len(want) > 5


def test_numbers_follow_period_and_start(found):
    for m in {r.match_id for r in found}:
        mine = [r for r in found if r.match_id == m]
        assert [r.seq_id for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.period, r.start_ms) for r in mine] == sorted((r.period, r.start_ms) for r in mine)
