"""Hybrid retrieval, agent memory and training corpora on Spark."""

#: Modules whose import registers queries.
QUERY_MODULES = ["quarry.queries", "quarry.queries_store", "quarry.queries_search", "quarry.queries_eval"]
