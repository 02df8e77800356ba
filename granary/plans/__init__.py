"""Named queries: what runs on a folder of tables, and the SQL that gives the same rows."""

from granary.plans.registry import ORACLE, QUERIES  # noqa: F401
from granary.plans import analytics, answers, exchange, ingestion, lists, market, provenance, requests, series, serving, status, stored, streams, texts  # noqa: F401, E402, I001  each fills the registry
