"""Streams of task events."""

from .monitor import StateTable, fold_states, liveness, monitor, reconcile, state_rank, stale_sessions

__all__ = ["StateTable", "fold_states", "liveness", "monitor", "reconcile", "stale_sessions", "state_rank"]
