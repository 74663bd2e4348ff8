"""Settings as frozen dataclasses, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True, slots=True)
class WindowConfig:
    """Sliding windows: seconds, seconds shared with the next window, fewest events."""

    seconds: float = 15.0
    overlap: float = 5.0
    min_events: int = 3

    def __post_init__(self) -> None:
        if self.seconds <= 0 or not 0 <= self.overlap < self.seconds:
            raise ValueError("overlap must be at least 0 and less than the window")

    @property
    def step(self) -> float:
        return self.seconds - self.overlap


@dataclass(frozen=True, slots=True)
class PossessionConfig:
    min_events: int = 3


@dataclass(frozen=True, slots=True)
class MixtureConfig:
    """Gaussian mixtures: range of K, covariance type, restarts, iterations, tolerance, ridge, seed; ``bayesian`` for a variational fit, full covariances only."""

    k_min: int = 3
    k_max: int = 12
    covariance: str = "full"
    n_init: int = 3
    max_iter: int = 100
    tol: float = 1e-3
    ridge: float = 1e-6
    seed: int = 42
    bayesian: bool = False

    def __post_init__(self) -> None:
        if self.bayesian and self.covariance != "full":
            raise ValueError("a Bayesian mixture has full covariances")
        if self.covariance not in ("full", "tied", "diag", "spherical"):
            raise ValueError("covariance must be full, tied, diag or spherical")
        if self.k_min < 1:
            raise ValueError("k_min must be positive")


@dataclass(frozen=True, slots=True)
class HmmConfig:
    n_states: int = 6
    max_iter: int = 100
    tol: float = 1e-2
    ridge: float = 1e-3
    seed: int = 42


@dataclass(frozen=True, slots=True)
class ChangepointConfig:
    """method: pelt, binseg or window; cost: rbf, l2 or linear; ``jump`` restricts places to its multiples."""

    method: str = "pelt"
    cost: str = "rbf"
    penalty: float = 3.0
    min_size: int = 10
    jump: int = 5

    def __post_init__(self) -> None:
        if self.method not in ("pelt", "binseg", "window"):
            raise ValueError(f"unknown method {self.method!r}")
        if self.cost not in ("rbf", "l2", "linear"):
            raise ValueError(f"unknown cost {self.cost!r}")


@dataclass(frozen=True, slots=True)
class VaeConfig:
    """Variational autoencoder: latent numbers, hidden layers, dropout, weight of the divergence, training; ``fit_rows`` rows at most are trained on."""

    latent: int = 8
    hidden: tuple[int, ...] = (256, 128, 64)
    dropout: float = 0.2
    beta: float = 4.0
    epochs: int = 150
    batch: int = 512
    rate: float = 1e-3
    fit_rows: int = 200_000
    seed: int = 42

    def __post_init__(self) -> None:
        if self.latent < 1 or not self.hidden or min(self.hidden) < 1:
            raise ValueError("layers must have at least one number")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must be at least 0 and less than 1")


@dataclass(frozen=True, slots=True)
class PreprocessConfig:
    prefix: str = "t"
    nulls: str = "drop_rows"
    variance: float | None = 0.95

    def __post_init__(self) -> None:
        if self.nulls not in ("drop_rows", "impute_median"):
            raise ValueError("nulls must be drop_rows or impute_median")
        if self.variance is not None and not 0 < self.variance <= 1:
            raise ValueError("variance must be above 0 and at most 1")


@dataclass(frozen=True, slots=True)
class PipelineConfig:
    window: WindowConfig = field(default_factory=WindowConfig)
    possession: PossessionConfig = field(default_factory=PossessionConfig)
    max_tier: int = 3

    def __post_init__(self) -> None:
        if self.max_tier not in (1, 2, 3):
            raise ValueError("max_tier must be 1, 2 or 3")
