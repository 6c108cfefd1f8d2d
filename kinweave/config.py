"""Parameters of the linkage operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The defaults that results depend on."""

    seed: int = 42
    top_k: int = 50
    exact_posting_cap: int = 2000
    address_posting_cap: int = 500
    word_min_df: int = 2
    word_max_df: float = 0.05
    char_ngrams: tuple[int, int] = (2, 4)
    char_min_df: int = 2
    char_max_df: float = 0.05
    phonetic_max_df: float = 0.03
    max_query_terms: int = 12
    phonetic_query_terms: int = 16
    max_posting_scan: int = 10_000
    include_address: bool = False
    rrf_k_grid: tuple[int, ...] = (10, 20, 40, 60)
    target_k: float = 6.25
    target_k_band: tuple[float, float] = (5.5, 7.0)
    k_min: int = 6
    k_max: int = 12
    ratio: float = 0.9
    ratio_grid: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)
    coarse_weights: tuple[float, float, float] = (0.60, 0.25, 0.15)
    hard_per_positive: int = 3
    easy_per_positive: int = 2
    singleton_hard: int = 3
    singleton_easy: int = 2
    easy_pool: int = 200_000
    folds: int = 5
    tau_match_grid: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    tau_s_grid: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
    tau_match: float = 0.5
    tau_s: float = 0.3
    margin: float = 0.05
    seen: tuple[str, ...] = ("us", "india")
    open_set: tuple[str, ...] = ("france",)
    boost: float = 0.10
    veto: float = 0.50
    recall_hat_grid: tuple[float, ...] = (0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 1.0)
    tau_floor_grid: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.5)
    ece_bins: int = 15
    broadcast_rows: int = 200_000


DEFAULTS = Settings()
