"""Distribution functions as column expressions (published rational forms)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Double-precision normal CDF (Hart 1968, as published by West 2005).
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# Normal quantile, algorithm AS 241 (Wichura 1988), highest power first.
PPF_CENTRAL_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
                   4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
                   1.3314166789178437745e2, 3.3871328727963666080e0)
PPF_CENTRAL_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
                   2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
                   4.2313330701600911252e1, 1.0)
PPF_MIDDLE_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
                  1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
                  4.63033784615654529590e0, 1.42343711074968357734e0)
PPF_MIDDLE_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
                  1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
                  2.05319162663775882187e0, 1.0)
PPF_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
                2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
                5.46378491116411436990e0, 6.65790464350110377720e0)
PPF_TAIL_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
                7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
                5.99832206555887937690e-1, 1.0)


def _horner(x: Column, coefs) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(z) -> Column:
    z = col(z)
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    near = e * _horner(x, CDF_NUM) / _horner(x, CDF_DEN)
    frac = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = x + F.lit(k) / frac
    tail = F.when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, near).otherwise(e / frac / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_ppf(p) -> Column:
    """Normal quantile; NULL outside (0, 1)."""
    p = col(p)
    q = p - 0.5
    r0 = 0.180625 - q * q
    central = q * _horner(r0, PPF_CENTRAL_NUM) / _horner(r0, PPF_CENTRAL_DEN)
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    rm, rt = r - 1.6, r - 5.0
    outer = F.when(r <= 5, _horner(rm, PPF_MIDDLE_NUM) / _horner(rm, PPF_MIDDLE_DEN)).otherwise(
        _horner(rt, PPF_TAIL_NUM) / _horner(rt, PPF_TAIL_DEN)
    )
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * outer))


def t4_ppf(u) -> Column:
    """Quantile of Student's t with 4 degrees of freedom (closed form)."""
    u = col(u)
    alpha = 4 * u * (1 - u)
    q = F.cos(F.acos(F.sqrt(alpha)) / 3) / F.sqrt(alpha)
    return F.signum(u - 0.5) * 2 * F.sqrt(F.greatest(q - 1, F.lit(0.0)))


def chi2_sf_odd(x, dof: int) -> Column:
    """Upper tail of chi-square for odd degrees of freedom (finite series)."""
    x = col(x)
    root = F.sqrt(x)
    phi = F.exp(-x / 2) / math.sqrt(2 * math.pi)
    total, denom = F.lit(0.0), 1.0
    for r in range(1, (dof - 1) // 2 + 1):
        denom *= 2 * r - 1
        total = total + F.pow(root, F.lit(float(2 * r - 1))) / denom
    return 2 * (1 - norm_cdf(root)) + 2 * phi * total
