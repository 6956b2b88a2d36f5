"""Queries over the driver tables, each with its SQL counterpart."""

from tidewarden.plans import (  # noqa: F401
    corpus_plans,
    document_plans,
    label_plans,
    quality_plans,
    session_plans,
)
from tidewarden.plans.registry import PLANS, SQL  # noqa: F401
