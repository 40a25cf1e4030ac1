"""Registered queries: each one an operator bound to the given tables, with its SQL check."""

from voxtally.plans import (  # noqa: F401
    label_queries,
    model_queries,
    quality_queries,
    request_queries,
    store_queries,
    text_queries,
)
from voxtally.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
