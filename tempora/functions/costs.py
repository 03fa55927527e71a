"""Trade-cost formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published square-root impact calibration, and the exponent variant.
ETA, BETA, GAMMA = 0.142, 0.6, 0.314
SQUARE_ROOT_BETA = 0.5
BPS = 10_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def impact_bps(shares: Column, sigma: Column, adv: Column, theta: Column, *, eta=ETA, beta=BETA, gamma=GAMMA) -> tuple[Column, Column]:
    """(permanent, temporary) impact in basis points; zero for zero shares.

    Parameters may be numbers or columns, so a scenario can carry its own values.
    Without a positive volume both are NULL.
    """
    q = F.abs(shares)
    traded = adv > 0
    part = F.when(traded, q / adv)
    permanent = F.lit(0.5) * _c(gamma) * sigma * part * F.pow(F.when(traded, theta / adv), F.lit(0.25)) * BPS
    temporary = _c(eta) * sigma * F.pow(part, _c(beta)) * BPS
    return F.when(q == 0, 0.0).otherwise(permanent), F.when(q == 0, 0.0).otherwise(temporary)


def zero_cost(*, unsuitable_for_deployment: bool) -> tuple[Column, Column]:
    """No impact at all; the caller has to say that this is not for real use."""
    if unsuitable_for_deployment is not True:
        raise ValueError("zero_cost needs unsuitable_for_deployment=True")
    return F.lit(0.0), F.lit(0.0)


def per_share_commission(shares: Column, rate) -> Column:
    return F.abs(shares) * _c(rate)


def notional_commission(notional: Column, bps) -> Column:
    return F.abs(notional) * _c(bps) / BPS


def exact_commission(shares: Column, rate: str) -> Column:
    """Per-share commission in exact decimal arithmetic."""
    return (F.abs(shares.cast("decimal(19,9)")) * F.lit(rate).cast("decimal(18,9)")).cast("decimal(38,18)")


def arrival_price(model: Column, open_: Column, close: Column, prior_close: Column) -> Column:
    """Price the model fills from; NULL for a model that cannot be filled here."""
    return F.when(model == "OPEN", open_).when(model == "CLOSE", close).when(model == "ARRIVAL", prior_close)


def fill_status(model: Column, prior_close: Column) -> Column:
    return (
        F.when(~model.isin("OPEN", "CLOSE", "ARRIVAL"), "unsupported_model")
        .when((model == "ARRIVAL") & prior_close.isNull(), "no_prior_close")
        .otherwise("ok")
    )


def total_bps(slippage: Column, temporary: Column, permanent: Column) -> Column:
    return slippage + temporary + permanent
