"""Registered queries over the given tables, each with an equivalent SQL text where SQL can express it."""

from sparktick.queries import (  # noqa: F401
    analysis, backtests, bar_queries, excitation_queries, inputs, label_queries, quality_queries, signal_queries, stores, trading,
)
from sparktick.queries.registry import QUERIES, SQL  # noqa: F401
