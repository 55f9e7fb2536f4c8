"""All registered queries. Importing this package registers them."""

from . import event_queries, harness_queries, sequence_queries, tabular_queries, tokenizer_queries, vector_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "event_queries", "harness_queries", "sequence_queries", "tabular_queries", "tokenizer_queries", "vector_queries"]
