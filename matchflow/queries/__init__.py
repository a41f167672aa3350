"""The library's operators run on the shared test tables, each with an SQL statement of the same result."""

from . import q_align, q_base, q_cluster, q_fields, q_indices, q_ordered, q_outputs, q_rollups, q_segment, q_timeline

MODULES = (q_base, q_fields, q_ordered, q_align, q_segment, q_indices, q_rollups, q_timeline, q_cluster, q_outputs)


def all_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
