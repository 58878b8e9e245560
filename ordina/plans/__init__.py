"""The query catalogue over the driver's tables, with the SQL that each is held against."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import aggregate_queries, join_queries, sampling_queries, sequence_queries, token_queries  # noqa: E402, F401
