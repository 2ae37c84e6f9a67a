"""Scalar configuration as frozen dataclasses.

Fixed values that must equal the original pricing scripts are gathered here,
as plain numbers, with the variant they belong to.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PricingConfig:
    # fixed values: loss-ratio target, undercut rule, prior log price
    target_loss_ratio: float = 0.45
    undercut_abs: float = 100.0
    undercut_rel: float = 0.992
    prior_price: float = 10.74
    # True: fit on log(price) - prior; False: fit on price / own price
    absolute: bool = True


@dataclass(frozen=True)
class CorridorWeights:
    """Weights and sharpness of the asymmetric corridor loss family."""
    alpha_under: float
    alpha_over: float
    w_under: float
    w_over: float
    w_mid: float
    w_loss_high: float
    w_loss_low: float


# fixed values: the four corridor variants of the pricing scripts
CORRIDOR_TARIFF = CorridorWeights(5e-5, 5e-3, 10.0, 10.0, 1.0, 1.0, 1.0)     # O1
CORRIDOR_NORMALISED = CorridorWeights(5e-3, 5e-3, 10.0, 5.0, 1.0, 1.0, 3.0)  # O2
CORRIDOR_CONVERSION = CorridorWeights(5e-3, 5e-3, 100.0, 5.0, 1.0, 1.0, 10.0)  # O3 (alpha_over unused)
CORRIDOR_PLOT = CorridorWeights(5e-3, 5e-3, 10.0, 5.0, 1.0, 1.0, 3.0)        # L1

# fixed values: conversion curve (1 + tanh(-a*x + b)) / 2
CONVERSION_A = 8.78002
CONVERSION_B = 8.32548

# fixed values: technical premium base constant = 0.067173373 * 1.022752496 * 702800
TP_BASE_FACTORS = (0.067173373, 1.022752496, 702800.0)


@dataclass(frozen=True)
class FitConfig:
    """Additive (linear) fit: rounds, L1/L2 and convergence tolerance."""
    max_rounds: int = 100
    l1: float = 0.0
    l2: float = 1e-5
    tol: float = 1e-7
    hess_floor: float = 1e-9


@dataclass(frozen=True)
class TreeConfig:
    """Histogram boosted trees under a custom objective."""
    rounds: int = 100
    max_depth: int = 6
    eta: float = 0.05
    reg_lambda: float = 1.0
    min_child_hess: float = 1.0
    bins: int = 256


@dataclass(frozen=True)
class DemandConfig:
    # fixed values: demand study (true and guessed demand, cost, grids)
    true_intercept: float = 100.0
    true_slope: float = 2.0
    guess_intercept: float = 95.0
    guess_slope: float = 1.8
    cost: float = 10.0
    price_lo: float = 5.0
    price_hi: float = 60.0
    n_prices: int = 500
    theta_lo: float = 1.5
    theta_hi: float = 2.5
    n_thetas: int = 200


@dataclass(frozen=True)
class ReportConfig:
    """Column roles of the reports: own price, model price, market, break-even."""
    own: str = "a"
    model: str = "np"
    market: str = "nm"
    breakeven: str = "nt"
    model_fit: str = "p"
    market_fit: str = "m"
    earned: str = "earned"
    premium: str = "policy_premium"
    claim: str = "claim"
    extra: dict = field(default_factory=dict)
