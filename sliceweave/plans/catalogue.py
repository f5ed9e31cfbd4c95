"""All registered queries."""

from sliceweave.plans import q_extraction, q_labels, q_sampling, q_series, q_sources  # noqa: F401
from sliceweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
