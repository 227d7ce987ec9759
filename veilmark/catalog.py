"""All registered queries with their SQL oracles."""

from __future__ import annotations

from veilmark.plans import documents
from veilmark.plans.queries import ORACLES as _ORACLES
from veilmark.plans.queries import QUERIES as _QUERIES

QUERIES = _QUERIES | documents.QUERIES
ORACLES = _ORACLES | documents.ORACLES
