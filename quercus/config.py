"""Every constant of the similarity pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    weights: dict[str, float] = field(default_factory=lambda: {"contents": 0.45, "competences": 0.35, "literature": 0.20})
    content_mix: dict[str, float] = field(default_factory=lambda: {"document": 0.4, "points": 0.4, "tfidf": 0.2})
    fuzzy_threshold: float = 88.0
    literature_scale: float = 6.0
    top_n: int = 10
    point_matches: int = 3
    min_df: int = 2
    max_df: float = 0.5
    label_max_df: float = 0.3
    label_terms: int = 25
    shown_points: int = 14
    shown_headings: int = 8
    caps: tuple[int, ...] = (3, 4, 5, 6, 8, 0)
    evidence_total: float = 1.0
    evidence_single: float = 1.5
    phrase_df: int = 8
    phrase_prefix: tuple[int, int] = (2, 12)
    phrase_rounds: int = 3
    place_strong: int = 2
    place_weak: int = 3
    levels: tuple[tuple[float, str], ...] = ((99.0, "sehr hoch"), (96.0, "hoch"), (90.0, "mittel"))
    cancelled: str = "X"
    default_cap: int = 5
    default_k: int = 90

    def share(self, dimension: str) -> float:
        """A dimension's weight as a share of all weights."""
        return self.weights[dimension] / sum(self.weights.values())


def check_parameters(weights: dict[str, int], cap: int, k: int, n: int, merges: int, config: Config | None = None) -> tuple[dict[str, int], int, int]:
    """Validated view parameters: three weights of 0 to 100 with one above nought, a cap the
    clustering was made for, and a cluster number the merges can reach. Invalid weights or
    caps fall back to the defaults, k is clamped."""
    config = config or Config()
    fine = set(weights) == set(config.weights) and all(isinstance(w, int) and 0 <= w <= 100 for w in weights.values()) and any(weights.values())
    weights = weights if fine else {d: round(100 * config.share(d)) for d in config.weights}
    cap = cap if cap in config.caps else config.default_cap
    return weights, cap, max(n - merges, min(n, k))
