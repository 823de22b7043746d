"""All registered queries of the mesh library."""

from __future__ import annotations

from . import q_corpora, q_delaunay, q_evaluation, q_fields, q_flow, q_geometry, q_handles, q_intake, q_solve, q_spatial, q_topology, q_views
from .registry import ORACLES, QUERIES

_ = (q_corpora, q_delaunay, q_evaluation, q_fields, q_flow, q_geometry, q_handles, q_intake, q_solve, q_spatial, q_topology, q_views)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
