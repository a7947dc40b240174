"""Dataset descriptors and run settings (plain frozen dataclasses)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Experiment parameters; defaults are the study's published configuration."""

    seed: int = 42
    test_size: float = 0.20
    n_folds: int = 5
    shuffle: bool = True
    threshold: float = 0.50
    primary_metric: str = "pr_auc"
    iqr_multiplier: float = 1.5
    variance_threshold: float = 1e-4
    correlation_threshold: float = 0.9
    top_k: int = 10
    max_explain: int = 200
    max_background: int = 50


@dataclass(frozen=True)
class Cohort:
    """What the study's ``DatasetConfig`` carries: target, explicit numeric
    allow-list (everything else is categorical), zero-as-missing columns,
    dedupe flag and IQR-clipped columns.  ``key_columns`` name a unique key
    used for stable row ids (empty: content hash plus copy number)."""

    key: str
    name: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    zero_as_missing: tuple[str, ...] = ()
    iqr_columns: tuple[str, ...] = ()
    dedupe: bool = False
    key_columns: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical
