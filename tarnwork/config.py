"""All tunable limits of the linkage engine, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Parameters of blocking, training and prediction.

    The defaults are the production values; tests shrink them with :meth:`but`
    so that every cap binds on small inputs. ``learner`` is "depth" (MLlib's boosted
    trees of ``tree_depth``) or "leaves" (trees of ``leaves`` leaves with ``l2``, grown leaf by leaf).
    """

    # Defaults that results have to agree on (all but batch_rows, tree_depth, learner and min_hessian).
    batch_rows: int = 10_000
    max_candidates: int = 50
    fallback_below: int = 20
    max_predictions: int = 20
    max_token_df: int = 500
    min_token_length: int = 4
    rare_rank_limit: int = 150
    name_prefix_length: int = 4
    min_name_length: int = 2
    prefilter_name: float = 0.55
    prefilter_address: float = 0.35
    prefilter_top_k: int = 100
    threshold: float = 0.70
    min_precision: float = 0.90
    max_positives: int = 500_000
    hard_per_positive: int = 4
    easy_per_positive: int = 1
    validation_percent: int = 20
    validation_max_positives: int = 100_000
    validation_negatives_per_positive: int = 5
    trees: int = 250
    learning_rate: float = 0.08
    tree_depth: int = 5
    min_leaf: int = 30
    learner: str = "depth"
    leaves: int = 31
    l2: float = 1.0
    min_hessian: float = 1e-3
    seed: int = 42
    thresholds: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.94, 0.96)

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    @property
    def quotas(self) -> tuple[int, int, int]:
        """Rows kept of the exact (when it overflows), rare-token and prefix stages."""
        half_up = lambda x: int(x + 0.5)
        m = self.max_candidates
        return max(1, half_up(m * 0.60)), max(1, half_up(m * 0.25)), max(1, m - half_up(m * 0.60) - half_up(m * 0.25))
