"""All registered queries of the library; importing this module registers them."""

from cadenza.plans import boundary_queries, feature_queries, inventory_queries, midi_queries, motif_queries, timeline_queries
from cadenza.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "boundary_queries", "feature_queries", "inventory_queries", "midi_queries", "motif_queries", "timeline_queries"]
