"""Custom objectives (gradient, Hessian) and loss values as column expressions.

Each objective maps prediction / target columns to a ``(grad, hess)`` pair
of Catalyst expressions, so a fit evaluates them inside whole-stage codegen
and sums them with ordinary aggregations; no Python runs per row.  Masks
use the unclipped logistic of the original scripts (IEEE overflow gives the
exact 0/1 limits) unless stated.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (CORRIDOR_CONVERSION, CORRIDOR_NORMALISED, CORRIDOR_PLOT, CORRIDOR_TARIFF,
                      CorridorWeights)
from .pricing import conversion, deviation_weight, sigmoid
from .semantics import col

ONE = 1.0
TWO = 2.0


def logistic(x: Column, alpha: float = 1.0) -> Column:
    """``1 / (1 + exp(-x/alpha))`` without clipping (R semantics)."""
    return ONE / (ONE + F.exp(-x / F.lit(alpha)))


@dataclass(frozen=True)
class Pulls:
    """What draws a policy's prediction: ``low`` with strength ``to_low``, ``high`` with strength ``to_high``.

    The corridor family is a sum of two weighted squares
    ``to_low (p - low)^2 + to_high (p - high)^2`` whose strengths are held fixed
    in the derivatives, so value, gradient and Hessian follow from the pulls.
    """
    low: Column
    high: Column
    to_low: Column
    to_high: Column

    def value(self, p: Column) -> Column:
        return self.to_low * F.pow(p - self.low, 2) + self.to_high * F.pow(p - self.high, 2)

    def grad(self, p: Column) -> tuple[Column, Column]:
        return (TWO * (self.to_low * (p - self.low) + self.to_high * (p - self.high)), TWO * (self.to_low + self.to_high))

    def staged(self, name: str) -> tuple[dict[str, Column], Pulls]:
        """(columns to project first, the pulls in terms of them): gradient and Hessian then share each mask.

        Catalyst doesn't merge a projection into the next one if that would
        compute an exponential twice, so a mask costs one exponential a row.
        """
        names = {k: f"{name}_{k}" for k in ("high", "to_low", "to_high")}
        return {v: getattr(self, k) for k, v in names.items()}, Pulls(self.low, *(F.col(v) for v in names.values()))


def _pulls(t: Column, u: Column, m: Column, w: CorridorWeights, under: Column, over: Column) -> Pulls:
    """A policy whose ceiling ``u`` lies above its break-even ``t`` is drawn to ``t`` where the ``under`` mask
    holds, and to ``u``: by the middle weight, or where the ``over`` mask holds by the upper one times the
    corridor's width.  Any other policy is drawn to break-even and market by fixed weights.

    The three masks of the family (under, over and what is left) sum to 1, so normalising them changes nothing.
    """
    profit = u > t
    middle, loss = F.lit(w.w_mid), F.lit(w.w_loss_low)
    return Pulls(low=t, high=F.when(profit, u).otherwise(m),
                 to_low=F.when(profit, under * F.lit(w.w_under)).otherwise(F.lit(w.w_loss_high)),
                 to_high=F.when(profit, middle + over * (F.lit(w.w_over) * (u - t) - middle)).otherwise(loss))


def corridor_pulls(p, t, m, u, w: CorridorWeights = CORRIDOR_TARIFF) -> Pulls:
    """O1: logistic masks with their own sharpness on each side, any ceiling ``u``."""
    p, t, m, u = col(p), col(t), col(m), col(u)
    return _pulls(t, u, m, w, logistic(t - p, w.alpha_under), logistic(p - u, w.alpha_over))


def normalised_pulls(p, t, m, w: CorridorWeights = CORRIDOR_NORMALISED) -> Pulls:
    """O2: the market (base margin) as ceiling."""
    return corridor_pulls(p, t, m, m, w)


def conversion_pulls(p, t, m, w: CorridorWeights = CORRIDOR_CONVERSION) -> Pulls:
    """O3: the conversion curve of ``p - m`` as the upper mask (the middle weight may go negative)."""
    p, t, m = col(p), col(t), col(m)
    return _pulls(t, m, m, w, logistic(t - p, w.alpha_under), conversion(p - m))


def corridor_grad(p, t, m, u, w: CorridorWeights = CORRIDOR_TARIFF) -> tuple[Column, Column]:
    """O1: gradient and Hessian."""
    return corridor_pulls(p, t, m, u, w).grad(col(p))


def normalised_grad(p, t, m, w: CorridorWeights = CORRIDOR_NORMALISED) -> tuple[Column, Column]:
    """O2: gradient and Hessian."""
    return normalised_pulls(p, t, m, w).grad(col(p))


def conversion_grad(p, t, m, w: CorridorWeights = CORRIDOR_CONVERSION) -> tuple[Column, Column]:
    """O3: gradient and Hessian."""
    return conversion_pulls(p, t, m, w).grad(col(p))


def corridor_objective(t, m, u, w: CorridorWeights = CORRIDOR_TARIFF):
    """O1 for a fit: prediction -> (gradient, Hessian, columns that the fit projects first)."""
    def objective(p: Column) -> tuple[Column, Column, dict[str, Column]]:
        columns, pulls = corridor_pulls(p, t, m, u, w).staged("__pull")
        return (*pulls.grad(p), columns)
    return objective


def convex_loss(p, t, m, w: CorridorWeights = CORRIDOR_PLOT, alpha: float | None = None) -> Column:
    """L1: loss value of the corridor family with the market as ceiling and one sharpness."""
    a = w.alpha_under if alpha is None else alpha
    return corridor_pulls(p, t, m, m, replace(w, alpha_under=a, alpha_over=a)).value(col(p))


def profit_logistic_grad(margin, label, market, weight) -> tuple[Column, Column]:
    """``w (M p(1-p) - A(1-p))`` and ``w (M (1-2p) p(1-p) + A p(1-p))``, ``p = sigmoid``."""
    pr = sigmoid(col(margin), 1.0, 35.0)
    A, M, w = col(label), col(market), col(weight)
    q = ONE - pr
    return (w * (M * pr * q - A * q), w * (M * (ONE - TWO * pr) * pr * q + A * pr * q))


def deviation_logistic_grad(margin, label, own, market, a: float = 1.5,
                            cap: float = 1.0) -> tuple[Column, Column]:
    """Logistic gradient scaled by the deviation weight of own vs market price."""
    pr = logistic(col(margin))
    w = deviation_weight(own, market, a, cap)
    return ((pr - col(label)) * w, pr * (ONE - pr) * w)


def hinge_grad(p, tap, m, alpha: float = 0.1, floor: float = 1e-6) -> tuple[Column, Column]:
    """Smooth hinge; surrogate gradient and floored Hessian.

    The gap that the mask opens is ``m - tap`` where the market is above
    break-even; elsewhere it is ``tap - p``, and the mask's slope counts against it.
    """
    p, tap, m = col(p), col(tap), col(m)
    a = F.lit(alpha)
    mask = logistic((p - m) / a)
    slope = mask * (ONE - mask) / a
    bend = slope * (ONE - TWO * mask) / a
    closed = tap >= m
    gap, sign = F.when(closed, tap - p).otherwise(m - tap), F.when(closed, F.lit(-ONE)).otherwise(F.lit(ONE))
    return sign * slope * gap - (ONE - mask), F.greatest(gap * bend + sign * slope, F.lit(floor))


def hinge_value(p, tap, m, alpha: float = 0.1) -> Column:
    p, tap, m = col(p), col(tap), col(m)
    s = logistic((p - m) / F.lit(alpha))
    return F.when(tap >= m, (ONE - s) * (p - tap)).otherwise(s * (m - tap) + (ONE - s) * (m - p))


def step_loss(P, A, M, eps: float = 0.2, k: float = 10.0) -> Column:
    """L2: ``max(M,A) - P + (M - A - (max(M,A) - P)) * sigma(k (P - (M - eps))))``."""
    P, A, M = col(P), col(A), col(M)
    mx = F.greatest(M, A)
    s = ONE / (ONE + F.exp(-F.lit(k) * (P - (M - F.lit(eps)))))
    return mx - P + (M - A - (mx - P)) * s
