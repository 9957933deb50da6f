"""Logarithms, power transforms, scaling, the normal distribution."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_cox(x: Column, lam: Column | float) -> Column:
    """(x^lam - 1) / lam, and log(x) at lam = 0."""
    lam = F.lit(lam) if not isinstance(lam, Column) else lam
    return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def box_cox_of_log(log_x: Column, lam: Column) -> Column:
    """Box-Cox from the logarithm of x; exact near lam = 0."""
    return F.when(F.abs(lam) < 1e-12, log_x).otherwise(F.expm1(lam * log_x) / lam)


def box_cox1p(x: Column, lam: float) -> Column:
    """Box-Cox of 1 + x with a given power."""
    return F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(float(lam))) - 1) / lam


def centred(x: Column, centre: Column, scale: Column) -> Column:
    """(x - centre) / scale; null for a constant column."""
    return F.try_divide(x - centre, scale)


def round_half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def normal_kernel(u: Column) -> Column:
    return F.exp(u * u * -0.5) / sqrt(2 * pi)


# fixed values: rational approximation of the normal quantile (Wichura, algorithm AS 241, PPND16);
# numerator and denominator in ascending powers for the centre, the shoulder and the tail
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
SHOULDER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, parts: tuple[Sequence[float], Sequence[float]]) -> Column:
    def poly(coefficients):
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * x + c
        return out

    return poly(parts[0]) / poly(parts[1])


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, as a plain column expression."""
    q = p - 0.5
    root = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(root <= 5, _ratio(root - 1.6, SHOULDER)).otherwise(_ratio(root - 5, TAIL))
    return F.when(F.abs(q) <= 0.425, q * _ratio(F.lit(0.180625) - q * q, CENTRE)).otherwise(F.signum(q) * tail)
