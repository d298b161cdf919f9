"""Further queries, by topic; importing the package registers them."""

from . import funnel, judging, packs, planning, results, similarity, store, streams, synthesis, windows

__all__ = ["funnel", "judging", "packs", "planning", "results", "similarity", "store", "streams", "synthesis", "windows"]
