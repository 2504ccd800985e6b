"""Distribution functions that Spark SQL does not ship.

Two kinds live here:

* Column / SQL expressions that stay in the JVM: normal quantile and distribution function, tail of Student's t,
  Lilliefors p-value.
* numpy routines for the handful of result rows of a test (Dickey-Fuller p-values, Shapiro-Wilk) and for tests
  (incomplete beta function).

scipy is not available, so the special functions are written out from their
published definitions (Acklam's rational approximation of the normal quantile,
Lentz's continued fraction for the incomplete beta function, MacKinnon's
response surfaces, Royston's Shapiro-Wilk approximation).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Acklam's coefficients for the inverse normal CDF ---
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
_P_LOW = 0.02425

# --- fixed values: MacKinnon (1994) p-value surface, constant-only ADF, one series ---
_TAU_MAX_C = 2.74
_TAU_MIN_C = -18.83
_TAU_STAR_C = -1.61
_TAU_SMALLP_C = (2.1659, 1.4412, 0.038269)
_TAU_LARGEP_C = (1.7339, 0.93202, -0.12745, -0.010368)
# MacKinnon (2010) critical values, constant-only, one series: b0 + b1/n + b2/n^2 + b3/n^3
_TAU_CRIT_C = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# --- fixed values: Royston (1992/1995) Shapiro-Wilk polynomials ---
_SW_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
_SW_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SW_C6 = (-0.4803, -0.082676, 0.0030302)
_SW_G = (-2.273, 0.459)
# ---------------------------------------------------------------------------------


def _horner(coefs, x):
    out = coefs[0]
    for c in coefs[1:]:
        out = out * x + c
    return out


def _poly(coefs, x):
    """c0 + c1 x + c2 x^2 + ..."""
    return _horner(tuple(reversed(coefs)), x)


# ------------------------------------------------------------------ normal
def norm_ppf_col(p) -> Column:
    """Inverse standard-normal CDF as a JVM column expression (|rel err| < 1.2e-9)."""
    p = F.col(p) if isinstance(p, str) else p
    q_lo = F.sqrt(-2.0 * F.log(p))
    q_hi = F.sqrt(-2.0 * F.log(1.0 - p))
    q = p - 0.5
    r = q * q
    low = _horner(_C, q_lo) / (_horner(_D, q_lo) * q_lo + 1.0)
    high = -_horner(_C, q_hi) / (_horner(_D, q_hi) * q_hi + 1.0)
    mid = _horner(_A, r) * q / (_horner(_B, r) * r + 1.0)
    return (F.when(p < _P_LOW, low).when(p > 1.0 - _P_LOW, high).otherwise(mid))


def norm_ppf_sql(p: str) -> str:
    """The same approximation as ANSI SQL text (used by the SQL oracle)."""

    def horner(coefs, x):
        out = repr(coefs[0])
        for c in coefs[1:]:
            out = f"({out}) * {x} + ({c!r})"
        return out

    q_lo = f"sqrt(-2.0 * ln({p}))"
    q_hi = f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = f"({horner(_C, q_lo)}) / (({horner(_D, q_lo)}) * {q_lo} + 1.0)"
    high = f"-({horner(_C, q_hi)}) / (({horner(_D, q_hi)}) * {q_hi} + 1.0)"
    mid = f"({horner(_A, r)}) * {q} / (({horner(_B, r)}) * {r} + 1.0)"
    return (f"CASE WHEN {p} < {_P_LOW!r} THEN {low} "
            f"WHEN {p} > {1.0 - _P_LOW!r} THEN {high} ELSE {mid} END")


def norm_cdf(x):
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2.0))


def norm_sf(x):
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc)(x / math.sqrt(2.0))


def norm_ppf(p):
    """Inverse normal CDF in numpy: Acklam + one Halley step (full double precision)."""
    p = np.asarray(p, dtype=float)
    out = np.full(p.shape, np.nan)
    ok = (p > 0) & (p < 1)
    pp = p[ok]
    x = np.empty_like(pp)
    lo = pp < _P_LOW
    hi = pp > 1 - _P_LOW
    mid = ~(lo | hi)
    q = np.sqrt(-2 * np.log(pp[lo]))
    x[lo] = _horner(_C, q) / (_horner(_D, q) * q + 1)
    q = np.sqrt(-2 * np.log(1 - pp[hi]))
    x[hi] = -_horner(_C, q) / (_horner(_D, q) * q + 1)
    q = pp[mid] - 0.5
    r = q * q
    x[mid] = _horner(_A, r) * q / (_horner(_B, r) * r + 1)
    e = norm_cdf(x) - pp
    u = e * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    x = x - u / (1 + x * u / 2)
    out[ok] = x
    out[p == 0] = -np.inf
    out[p == 1] = np.inf
    return out


# ------------------------------------------------------------------ t distribution
def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if not (x > 0):
        return 0.0 if x == 0 else float("nan")
    if x >= 1:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def _gamma_ratio_col(z: Column, shift: int = 12) -> Column:
    """ln(Gamma(z + 1/2) / Gamma(z)): the asymptotic series at ``z + shift``, carried back; no difference of large logarithms."""
    far = z + shift
    series = 0.5 * F.log(far) - 1 / (8 * far) + 1 / (192 * far ** 3) - 1 / (640 * far ** 5) + 17 / (14336 * far ** 7)
    steps = F.lit(0.0)
    for i in range(shift):
        steps = steps + F.log1p(0.5 / (z + i))
    return series - steps


def t_sf_col(t: Column, df: Column, per_unit: int = 16, span: int = 5) -> Column:
    """P(T > |t|) of Student's t, in the JVM.

    The density beyond |t| is summed at s = exp(pi/2 sinh(v)) for evenly spaced v: the integrand dies away doubly exponentially
    at both ends, so the sum is exact to rounding for any number of degrees of freedom."""
    at, half = F.abs(t), math.pi / 2
    node = lambda k: F.exp(half * F.sinh(k / per_unit))
    term = lambda k: F.exp(-(df + 1) / 2 * F.log1p((at + node(k)) ** 2 / df)) * F.cosh(k / per_unit) * node(k)
    total = F.aggregate(F.sequence(F.lit(-span * per_unit), F.lit(span * per_unit)), F.lit(0.0), lambda s, k: s + term(k))
    tail = total * (half / per_unit) * F.exp(_gamma_ratio_col(df / 2)) / F.sqrt(df * math.pi)
    return F.when((df > 0) & t.isNotNull() & ~F.isnan(t), F.least(tail, F.lit(0.5)))


def t_pvalue_col(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    """p-value of a t statistic; alternative is two-sided, less or greater."""
    tail = t_sf_col(t, df)
    if alternative == "two-sided":
        return 2 * tail
    beyond = t < 0 if alternative == "less" else t > 0
    return F.when(beyond, tail).otherwise(1 - tail)


# ------------------------------------------------------------------ normal distribution function, Lilliefors
# --- fixed values: rational approximation of the normal tail (West 2005, after Hart), highest power first ---
_TAIL_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
           440.413735824752)
# --- fixed values: p-value of the Lilliefors statistic (Dallal and Wilkinson 1986; polynomials for p > 0.1 by Molin and Abdi 1998) ---
_LILLIE = (-7.01256, 2.78019, 2.99587, -0.122119, 0.974598, 1.67997)
_LILLIE_LARGE = ((0.302, (1.0,)), (0.5, (81.218052, -138.55152, 80.709644, -19.828315, 2.76773)),
                 (0.9, (-32.355711, 94.029866, -97.490286, 40.662806, -4.901232)), (1.31, (2.423045, -12.234627, 23.186922, -19.558097, 6.198765)))


def norm_cdf_col(x: Column) -> Column:
    """P(Z <= x) as arithmetic on columns (whole-stage code), to about 1e-15."""
    a = F.abs(x)
    far = a
    for c in (0.65, 4.0, 3.0, 2.0, 1.0):
        far = far + c if c == 0.65 else a + c / far
    e = F.exp(-a * a / 2)
    tail = F.when(a < 7.07106781186547, e * _horner(_TAIL_P, a) / _horner(_TAIL_Q, a)).otherwise(e / (far * math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    """The same in SQL, for arguments within seven standard deviations."""
    def horner(c):
        out = repr(c[0])
        for v in c[1:]:
            out = f"({out} * abs({x}) + {v!r})"
        return out

    tail = f"exp(-({x}) * ({x}) / 2) * {horner(_TAIL_P)} / {horner(_TAIL_Q)}"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


def lilliefors_p_col(d: Column, n: Column) -> Column:
    """p-value of the Kolmogorov-Smirnov distance to a normal with fitted mean and deviation (n of 5 or more)."""
    k = d * F.when(n > 100, F.pow(n / 100, F.lit(0.49))).otherwise(1.0)
    m = F.least(n.cast("double"), F.lit(100.0))
    a, b, c, e, f, g = _LILLIE
    p = F.exp(a * k * k * (m + b) + c * k * F.sqrt(m + b) + e + f / F.sqrt(m) + g / m)
    kk = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * d
    large = F.lit(0.0)
    for upto, coefs in reversed(_LILLIE_LARGE):
        large = F.when(kk <= upto, _horner(coefs, kk)).otherwise(large)
    return F.when(n >= 5, F.when(p > 0.1, large).otherwise(p))


# ------------------------------------------------------------------ Dickey-Fuller
def mackinnon_p(stat: float) -> float:
    """Approximate p-value of an ADF statistic (constant, no trend)."""
    if stat > _TAU_MAX_C:
        return 1.0
    if stat < _TAU_MIN_C:
        return 0.0
    coefs = _TAU_SMALLP_C if stat <= _TAU_STAR_C else _TAU_LARGEP_C
    return float(norm_cdf(_poly(coefs, stat)))


def mackinnon_crit(nobs: int) -> dict[str, float]:
    return {k: float(_poly(v, 1.0 / nobs)) for k, v in _TAU_CRIT_C.items()}


# ------------------------------------------------------------------ Shapiro-Wilk
def shapiro_wilk(x) -> tuple[float, float]:
    """W statistic and p-value (Royston's approximation, 3 <= n <= 5000)."""
    x = np.sort(np.asarray(x, dtype=float))
    x = x[~np.isnan(x)]
    n = x.size
    if n < 3:
        return float("nan"), float("nan")
    if x[-1] - x[0] == 0:
        return 1.0, 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        i = np.arange(1, n + 1)
        m = norm_ppf((i - 0.375) / (n + 0.25))
        mm = float(np.sum(m * m))
        u = 1.0 / math.sqrt(n)
        a = m / math.sqrt(mm)
        an = a[-1] + _poly(_SW_C1, u)
        if n > 5:
            an1 = a[-2] + _poly(_SW_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[-2] = an, an1
            a[0], a[1] = -an, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = an, -an
    xc = x - x.mean()
    w = float(np.dot(a, x) ** 2 / np.dot(xc, xc))
    w = min(w, 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if n <= 11:
        gamma = _poly(_SW_G, n)
        mu = _poly(_SW_C3, n)
        sigma = math.exp(_poly(_SW_C4, n))
        if 1 - w <= 0 or gamma - math.log(1 - w) <= 0:
            return w, 0.0 if w < 1 else 1.0
        z = (-math.log(gamma - math.log(1 - w)) - mu) / sigma
    else:
        ln = math.log(n)
        mu = _poly(_SW_C5, ln)
        sigma = math.exp(_poly(_SW_C6, ln))
        if w >= 1:
            return 1.0, 1.0
        z = (math.log(1 - w) - mu) / sigma
    return w, float(norm_sf(z))
