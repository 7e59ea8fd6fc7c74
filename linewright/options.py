"""Per-run settings of the matching job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchOptions:
    """Thresholds and retrieval sizes of one run.

    ``auto_threshold`` and ``review_threshold`` are explicit overrides; when
    left out, the thresholds of the supplier, the category and finally the
    global defaults apply. ``parity`` keeps known blind spots of the original
    main path: no article or category reaches retrieval and scoring, and the
    unit of the catalog is compared as it is written.
    """

    auto_threshold: float | None = None
    review_threshold: float | None = None
    retrieval_top_n: int = 50
    rerank_top_n: int = 10
    alternatives: int = 5
    list_cap: int = 200
    relaxed_list_cap: int = 100
    relaxed_top_n: int = 25
    fusion_k: int = 60
    name_threshold: float = 0.15
    document_threshold: float = 0.10
    relaxed_name_threshold: float = 0.08
    relaxed_document_threshold: float = 0.05
    scale_rerank: bool = False
    parity: bool = False
