"""Registered queries: importing the modules fills the registry."""

from cutline.plans import oracle_tables  # noqa: F401
from cutline.plans import documents, diagnostics, evaluation, ingest, learning, panel, percentile, recommendation  # noqa: F401
from cutline.plans.registry import ORACLES, QUERIES  # noqa: F401
