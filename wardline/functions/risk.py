"""Risk score and level, as SQL expressions over SQL operands."""

from __future__ import annotations

# Base without a signature, multipliers, upper ends of the bands.
UNKNOWN_BASE = 30
UNAPPROVED_FACTOR = 1.5
CRITICAL_FACTOR = 2.0
HIGH_FACTOR = 1.5
MAX_SCORE = 100
BANDS = {"LOW": 25, "MEDIUM": 50, "HIGH": 75}
TOP_BAND = "CRITICAL"


def has_severity(dlp_matches: str, severity: str) -> str:
    return f"exists({dlp_matches}, m -> m.severity = '{severity}')"


def risk_score(base: str, critical: str, high: str, unapproved: str = "false") -> str:
    """Base times its multipliers, at most 100, cut (not rounded) to an integer."""
    return f"""CAST(least(
        CAST(coalesce({base}, {UNKNOWN_BASE}) AS double)
        * IF({unapproved}, {UNAPPROVED_FACTOR}D, 1D)
        * CASE WHEN {critical} THEN {CRITICAL_FACTOR}D WHEN {high} THEN {HIGH_FACTOR}D ELSE 1D END,
        {MAX_SCORE}D) AS int)"""


def risk_level(score: str) -> str:
    bands = " ".join(f"WHEN {score} <= {upper} THEN '{name}'" for name, upper in BANDS.items())
    return f"CASE {bands} ELSE '{TOP_BAND}' END"
