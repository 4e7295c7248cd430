"""All registered queries with their SQL twins."""

from __future__ import annotations

from orrery.plans import check_queries, cluster_queries, graph_queries, panel_queries, stat_queries, stream_queries, track_queries  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES  # noqa: F401
