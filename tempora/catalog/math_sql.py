"""SQL text of the normal CDF, its inverse and the Sharpe formulas."""

from __future__ import annotations

from tempora.functions import normal as N


def _poly(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-({a}) * ({a}) / 2)"
    frac = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k}e0 / {frac})"
    tail = f"CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < {N.HART_SPLIT!r}::DOUBLE THEN {e} * {_poly(N.HART_N, a)} / {_poly(N.HART_D, a)} ELSE {e} / {frac} / {N.SQRT_2PI!r}::DOUBLE END"
    return f"(CASE WHEN {z} > 0 THEN 1e0 - ({tail}) ELSE {tail} END)"


def quantile(p: str) -> str:
    def tail(q):
        return f"{_poly(N.ACKLAM_C, q)} / {_poly((*N.ACKLAM_D, 1.0), q)}"

    r = f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    low = tail(f"sqrt(-2e0 * ln({p}))")
    high = tail(f"sqrt(-2e0 * ln(1e0 - {p}))")
    middle = f"{_poly(N.ACKLAM_A, r)} * ({p} - 0.5e0) / {_poly((*N.ACKLAM_B, 1.0), r)}"
    return f"(CASE WHEN {p} < 0.02425e0 THEN {low} WHEN {p} > 0.97575e0 THEN -({high}) ELSE {middle} END)"


def variance(sr: str, g3: str, g4: str) -> str:
    return f"(1e0 - {g3} * {sr} + ({g4} - 1) / 4e0 * {sr} * {sr})"


def z_score(sr: str, star: str, t: str, g3: str, g4: str) -> str:
    return f"(({sr} - {star}) * sqrt({t} - 1) / sqrt({variance(sr, g3, g4)}))"


def benchmark(v: str, n: int) -> str:
    import math

    g = f"{N.EULER_GAMMA!r}::DOUBLE"
    q1, q2 = quantile(f"{1.0 - 1.0 / n!r}::DOUBLE"), quantile(f"{1.0 - 1.0 / (n * math.e)!r}::DOUBLE")
    return f"(sqrt({v}) * ((1e0 - {g}) * {q1} + {g} * {q2}))"
