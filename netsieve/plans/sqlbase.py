"""Shared DuckDB SQL fragments for the oracle (independent of the Spark engine code).

The fixed lookup tables are rendered from the same data module the engine
uses, so both sides read one source of truth for label names and templates.
"""

from __future__ import annotations

from netsieve.functions import domains as D
from netsieve.sources.adapters import cte


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({cols}))"


MAPPING = values(D.ATTACK_MAPPING, "m_raw, m_std")
KNOWN = values([(n,) for n in D.KNOWN_LABELS], "k_name")
ENCODER = values([(i, n) for i, n in enumerate(D.ENCODER_CLASSES)], "e_id, e_name")
LABEL_DIM = values([(m, i, n) for m, pairs in D.LABEL_MAPS.items() for i, n in pairs], "mapping, id, name")


def round_half_up(e: str, digits: int) -> str:
    """SQL twin of ``detect.round_half_up``."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(floor(CAST({e} AS DOUBLE) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def gt(x: str, v: float) -> str:
    return f"(NOT isnan(CAST({x} AS DOUBLE)) AND CAST({x} AS DOUBLE) > {v})"


# Cleaned + standardized (not yet filtered to known names).
STANDARDIZED = f"""
standardized AS (
  SELECT a.*, coalesce(m.m_std, a.raw_label) AS label
  FROM alerts a LEFT JOIN {MAPPING} m ON a.raw_label = m.m_raw
  WHERE a.raw_label IS DISTINCT FROM 'Label' AND a.raw_label IS NOT NULL
)"""

LABELLED = STANDARDIZED + f""",
labelled AS (
  SELECT * FROM standardized WHERE label IN (SELECT k_name FROM {KNOWN})
)"""

SCORED = LABELLED + f""",
scored0 AS (
  SELECT l.*,
    CASE WHEN binary_score IS NULL THEN NULL ELSE {gt('binary_score', 0.5)} END AS binary_pred,
    coalesce(e.e_name, 'Unknown') AS class_label
  FROM labelled l LEFT JOIN {ENCODER} e ON l.class_id = e.e_id
),
scored AS (
  SELECT *,
    CASE WHEN coalesce(binary_pred, false) THEN class_label END AS attack_label,
    coalesce(binary_pred, false)
      OR coalesce(lower(slm_label) <> 'normal' AND {gt('slm_score', 0.7)}, false) AS is_malicious
  FROM scored0
)"""


def with_alerts(*ctes: str, adapters: tuple[str, ...] = ("alerts",)) -> str:
    return cte(*adapters) + "".join("," + c for c in ctes)
