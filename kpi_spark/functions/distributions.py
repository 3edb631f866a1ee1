"""Normal and Student distributions for the few numbers that inference ends with."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()
#: The 97.5 percent point of the normal distribution.
Z95 = NORMAL.inv_cdf(0.975)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    """Chance of a Student value as far from 0."""
    return beta_regularised(freedom / 2, 0.5, freedom / (freedom + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, freedom: float) -> float:
    """For p above one half, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, freedom) / 2 < p else (low, middle)
    return (low + high) / 2


def z_two_sided(z: float) -> float:
    return 2 * (1 - NORMAL.cdf(abs(z))) if math.isfinite(z) else 0.0


# fixed values: numerators and denominators (from the highest power) of the rational functions of algorithm AS 241,
# for the middle, the tails and the far tails
_MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a share, as a column expression; null outside (0, 1)."""
    ratio = lambda parts, x: reduce(lambda acc, c: acc * x + c, parts[0][1:], F.lit(parts[0][0])) / reduce(lambda acc, c: acc * x + c, parts[1][1:], F.lit(parts[1][0]))
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(_TAIL, r - 1.6)).otherwise(ratio(_FAR, r - 5.0))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail))
