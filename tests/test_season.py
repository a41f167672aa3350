"""Landed files to published tables on the synthetic season: invariants, sinks, store, incremental run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchflow.operators import detail as dt
from matchflow.plans import season as plan
from matchflow.sources import catalogue as cat, readers as rd, writers as wr
from matchflow.streaming.incremental import run_incremental
from season import write_season


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return write_season(str(tmp_path_factory.mktemp("season")), seconds=45)


@pytest.fixture(scope="module")
def result(spark, folders):
    return plan.analyse_matches(rd.read_tracking(spark, folders["tracking"]), rd.read_events(spark, folders["events"]),
                                rd.read_sequences(spark, folders["sequences"]), own_team=100, n_clusters=2, restarts=1)


def test_readers(spark, folders):
    seqs = rd.read_sequences(spark, folders["sequences"])
    assert {r.match_id for r in seqs.select("match_id").distinct().collect()} == {1, 2}
    assert seqs.where("end_ms <= start_ms OR size(event_ids) = 0").count() == 0
    assert rd.read_sequences(spark, folders["sequences"] + "_none").count() == 0
    assert rd.list_matches(spark, folders["tracking"]).count() == 3
    with pytest.raises(FileNotFoundError):
        rd.read_events(spark, folders["events"] + "_none")


def test_sequences(result):
    seqs = result.sequences.collect()
    assert seqs
    for m in {s.match_id for s in seqs}:
        mine = sorted((s for s in seqs if s.match_id == m), key=lambda s: s.seq_id)
        assert [s.seq_id for s in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda s: (s.period, s.start_ms))
    assert all(1 <= s.duration_s <= 45 and s.n_frames >= 2 for s in seqs)
    origins = {(s.match_id, s.origin) for s in seqs}
    assert (1, "bepro_sequences") in origins and all(o == "tracking_poseedor" for m, o in origins if m == 3)


def test_indices(result):
    rows = result.indexed.collect()
    assert rows
    for r in rows:
        assert 0 <= r.idd <= 1 and (r.ipo is None or 0 <= r.ipo <= 1)
        if r.control_own:
            assert all(abs(a + b - 1) < 1e-9 for a, b in zip(r.control_own, r.control_rival))
        assert r.threat is None or (len(r.threat) == 20 and max(r.threat) <= 0.32)


def test_tagging(result):
    tagged = result.extra["tagged"].join(result.sequences.select("match_id", "seq_id", "start_ms", "end_ms", F.col("period").alias("p")), ["match_id", "seq_id"])
    assert tagged.where("match_time < start_ms OR match_time > end_ms OR period <> p").count() == 0


def test_published(spark, result, tmp_path):
    tables = {k: v for k, v in plan.published_tables(result).items() if k in ("detail", "category_matrix", "cluster_summary", "light_trajectories", "metadata")}
    out = str(tmp_path / "gold")
    wr.write_match_outputs(tables, out)
    detail = spark.read.parquet(out + "/detail")
    n = result.detail.count()
    assert detail.count() == n
    wr.write_match_outputs({"detail": result.detail.where("match_id = 1")}, out)
    detail = spark.read.parquet(out + "/detail")
    assert detail.count() == n
    assert {"secuencia_rival_id", "indice_desorganizacion"} <= set(wr.published_names(detail).columns)
    share = spark.read.parquet(out + "/cluster_summary").groupBy("match_id").agg(F.sum("share_pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 0.3 for r in share)
    assert spark.read.parquet(out + "/light_trajectories").groupBy("match_id", "seq_id").count().where("count > 24").count() == 0
    typed = dt.detail_types(detail.withColumn("goal", F.lit("Sí")))
    assert typed.select("goal").distinct().collect()[0].goal == 1


def test_frames_and_lineup(spark):
    frames = spark.createDataFrame([(1, 10, 0, 0, "home", [(0.5, 0.5)], [(7, 0.51, 0.5), (8, 0.9, 0.9)]), (1, 11, 40, 0, "home", [], [(7, 0.5, 0.5)])],
                                   "match_id long, frame_index long, match_time long, period_order int, ball_state string, balls array<struct<x:double,y:double>>, "
                                   "players array<struct<player_id:long,x:double,y:double>>")
    from matchflow.operators import tracking as tr
    raw = spark.createDataFrame([(1, '{"data":[{"lineup":[{"player_id":"7","player_name":"Ann","team_id":1,"team_name":"One"}]}]}')], "match_id long, raw string")
    rows = tr.nearest_possessor(tr.flatten_frames(frames, cat.lineup_dim(raw)), 1).orderBy("frame", "player_id").collect()
    assert [(r.player_name, r.possessor, r.possession_side) for r in rows] == [("Ann", 1, "propia"), ("ID: 8", 0, "propia"), ("Ann", 0, None)]
    assert rows[0].dist_ball == pytest.approx(0.01) and rows[2].dist_ball is None


def test_match_list(spark):
    raw = spark.createDataFrame([('{"id": 5, "date": "2025-01-01", "home_team": {"name": "A"}, "away_team_name": "B"}',), ('{"match_id": 4}',), ('{"x": 1}',)], "raw string")
    rows = cat.normalise_matches(raw).orderBy("match_id").collect()
    assert [(r.match_id, r.match_date, r.home_team, r.away_team) for r in rows] == [(4, None, None, None), (5, "2025-01-01", "A", "B")]


def test_nested_csv_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "match_id long, ids array<string>")
    wr.write_nested_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first()["ids"] == '["a","b"]'
    wanted = spark.createDataFrame([(1, 9), (2, 9)], "match_id long, team_id long")
    calls = []

    def compute(keys):
        calls.append(sorted(r.match_id for r in keys.collect()))
        return keys.withColumn("v", F.col("match_id") * 10)

    first = wr.match_result_store(spark, str(tmp_path / "store"), "t", wanted.where("match_id = 1"), compute)
    assert first.count() == 1
    assert wr.match_result_store(spark, str(tmp_path / "store"), "t", wanted, compute).count() == 2
    assert calls == [[1], [2]]


def test_incremental_run(spark, folders, tmp_path):
    import shutil
    landing, seen = tmp_path / "landing", []
    landing.mkdir()
    for m in (1, 2):
        shutil.copy(f"{folders['tracking']}/partido_{m}_tracking_poseedor.csv", landing)
        run_incremental(spark, str(landing), str(tmp_path / "progress"), lambda todo: seen.append(sorted(r.match_id for r in todo.collect())))
    assert seen == [[1], [2]]
