"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from netsieve.plans import q_alerts, q_examples, q_io, q_labels, q_metrics, q_models, q_streaming, q_windows  # noqa: F401
from netsieve.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: f() for k, f in ORACLE.items()}
