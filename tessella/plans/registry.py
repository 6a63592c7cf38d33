"""All registered queries."""

from __future__ import annotations

from tessella.plans import catalog, documents, evaluation, extras, graphs, relational, search  # noqa: F401
from tessella.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk"
