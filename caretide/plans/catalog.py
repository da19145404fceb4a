"""All registered queries."""

from caretide.plans import (  # noqa: F401  (importing a module registers its queries)
    decision_queries,
    message_queries,
    retrieval_queries,
    service_queries,
    state_queries,
    stream_queries,
    text_queries,
    triage_queries,
)
from caretide.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
