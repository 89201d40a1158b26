"""The settings by which views are told apart and identities repaired; ``sources.rules.identity_settings`` reads them from a file."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IdentityPolicy:
    """Limits of cuts (``visual``, ``churn``, ``cut``), of links (``max_gap`` to ``max_ratio``) and of hypotheses.

    ``reset``: no link and no filled gap goes over a cut.  ``fill``: gaps within a track are filled.
    """

    visual: float = 0.28
    churn: float = 0.80
    cut: float = 0.72
    reset: bool = True
    fill: bool = True
    max_gap: int = 3
    link: float = 0.72
    max_court: float = 260.0
    max_ratio: float = 1.35
    with_hypotheses: bool = True
    hypothesis: float = 0.55
    top: int = 3
    ambiguity: float = 0.05
