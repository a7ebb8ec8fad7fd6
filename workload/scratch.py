"""Folders for data a query writes and reads back."""

from leaksieve.plans.scratch import scratch_dir

__all__ = ["scratch_dir"]
