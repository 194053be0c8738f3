"""Importing this module fills the catalog."""

from tastegrid.plans import (  # noqa: F401
    prepare_queries,
    metric_queries,
    recommend_queries,
    graph_queries,
    text_queries,
    knowledge_queries,
    io_queries,
    result_queries,
)
