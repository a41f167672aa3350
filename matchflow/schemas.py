"""Explicit schemas of the landed feeds and the names of the published tables."""

from __future__ import annotations

from pyspark.sql import types as T

TRACKING = T.StructType([
    T.StructField(n, t) for n, t in (
        ("match_id", T.LongType()), ("frame", T.LongType()), ("match_time", T.StringType()), ("period", T.StringType()),
        ("player_id", T.StringType()), ("player_name", T.StringType()), ("team_id", T.StringType()), ("team_name", T.StringType()),
        ("x", T.StringType()), ("y", T.StringType()), ("ball_x", T.StringType()), ("ball_y", T.StringType()),
        ("ball_state", T.StringType()), ("dist_ball", T.StringType()), ("poseedor", T.StringType()), ("tipo_posesion", T.StringType()))])

FRAMES = T.StructType([
    T.StructField("match_id", T.LongType()), T.StructField("frame_index", T.LongType()), T.StructField("match_time", T.LongType()),
    T.StructField("period_order", T.IntegerType()), T.StructField("ball_state", T.StringType()),
    T.StructField("balls", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
    T.StructField("players", T.ArrayType(T.StructType([
        T.StructField("player_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])

# File name patterns of the landed folders, by feed.
FILE_PATTERNS = {
    "tracking": r"partido_(\d+)_tracking_poseedor\.csv$",
    "events": r"partido_(\d+)_eventing\.csv$",
    "sequences": r"partido_(\d+)_sequences\.csv$",
}

# Columns of the provider's possession sequences with their accepted names.
SEQUENCE_SYNONYMS = {
    "provider_id": ("sequence_id", "sequenceId", "id"),
    "team_id": ("team_id", "teamId", "possession_team_id", "possessionTeamId"),
    "period": ("period_order", "period", "periodOrder"),
    "start_ms": ("start_time_ms", "startTimeMs", "start_time", "startTime", "start_event_time", "startEventTime"),
    "end_ms": ("end_time_ms", "endTimeMs", "end_time", "endTime", "end_event_time", "endEventTime"),
    "duration": ("duration", "duration_ms", "durationMs", "duration_sec", "durationSec"),
    "event_ids": ("event_ids", "eventIds", "events"),
    "total_distance": ("total_distance", "totalDistance"),
    "num_passes": ("num_of_passes", "numOfPasses", "passes"),
    "progress_distance": ("progress_distance", "progressDistance"),
    "progress_direction": ("progress_direction", "progressDirection"),
    "ball_status": ("ball_status", "ballStatus"),
}

# Our column -> published column.
PUBLISHED = {
    "seq_id": "secuencia_rival_id",
    "provider_id": "bepro_sequence_id",
    "origin": "origen_segmentacion",
    "typology": "tipologia",
    "cluster": "cluster_trayectoria",
    "period": "period",
    "minute": "minuto_partido",
    "start_s": "start_time_seg",
    "end_s": "end_time_seg",
    "end_provider_ms": "end_time_bepro_ms",
    "close_reason": "motivo_cierre",
    "duration_s": "duracion_seg",
    "idd": "indice_desorganizacion",
    "ipo": "indice_peligrosidad_accion",
    "score": "score_critico",
    "xt_max": "xT_max",
    "xt_gain": "xT_added",
    "xt_peak": "pico_amenaza_concedida",
    "xt_sum": "exposicion_amenaza_concedida",
    "control_own_mean": "control_campo_subiza_medio",
    "control_rival_mean": "control_campo_rival_medio",
    "danger_own_mean": "control_zona_peligrosa_subiza_medio",
    "danger_rival_mean": "control_zona_peligrosa_rival_medio",
    "danger_behind": "pitch_control_rival_detras_linea",
    "control_lost": "perdida_control_campo_subiza",
    "danger_gained": "incremento_control_zona_peligrosa_rival",
    "idd_category": "categoria_desorganizacion_auto",
    "ipo_category": "categoria_peligrosidad_auto",
    "cause": "tipo_desorganizacion_principal",
    "second_cause": "tipo_desorganizacion_secundaria",
    "shot": "tipo_finalizacion_tiro",
    "on_target": "tipo_finalizacion_tiro_puerta",
    "goal": "es_gol",
    "xg": "xg_tiro",
    "finish_score": "score_finalizacion",
    "shot_ms": "match_time_tiro_oficial",
    "gap_ms": "distancia_tiro_seq_ms",
    "assignment": "tipo_asignacion_tiro_seq",
    "x_end": "x_fin",
    "y_end": "y_fin",
    "ball_x_m_start": "ball_x_ini_m",
    "ball_y_m_start": "ball_y_ini_m",
    "ball_x_m_end": "ball_x_fin_m",
    "ball_y_m_end": "ball_y_fin_m",
    "ball_x_norm_start": "ball_x_ini_norm_m",
    "ball_y_norm_start": "ball_y_ini_norm_m",
    "ball_x_norm_end": "ball_x_fin_norm_m",
    "ball_y_norm_end": "ball_y_fin_norm_m",
    "gain_m": "progresion_x_norm_m",
    "x_max_norm": "x_max_norm_m",
    "path_m": "recorrido_balon_m",
    "action_m": "recorrido_bepro_m",
    "action_gain_m": "progresion_bepro_m",
    "n_passes": "num_pases_bepro",
    "progress_direction": "direccion_progresion_bepro",
    "n_events": "num_eventos",
    "n_rival_events": "num_eventos_rivales",
    "has_setpiece": "tiene_setpiece",
    "sequence_type": "tipo_secuencia_ofensiva",
    "keep_reason": "motivo_conservacion",
    "frames_rival": "frames_poseedor_rival",
    "frames_own": "frames_poseedor_propio",
    "rival_share": "pct_poseedor_rival",
    "rival_ok": "validacion_rival_ok",
    "alert": "alerta_validacion",
}

# Published tables and the roll-up columns that differ from the detail names.
PUBLISHED_ROLLUP = {
    "sequences": "secuencias", "idd_mean": "ddi_medio", "ipo_mean": "ipar_medio", "shots": "tiros", "shots_on_target": "tiros_puerta",
    "duration_mean": "duracion_media", "share_pct": "porcentaje", "shot_pct": "tiro_pct", "zone": "zona_dominante",
    "lane": "carril_dominante", "tactical_label": "etiqueta_tactica", "point": "punto", "mean_threat": "amenaza_media",
    "frequency": "frecuencia", "n_sequences": "n_secuencias", "main_cause": "causa_principal", "risk": "riesgo", "value": "valor",
}
