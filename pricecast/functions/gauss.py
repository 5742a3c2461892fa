"""The normal distribution as columns: its distribution function and its quantiles, to about double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricecast.functions.arrays import bound

# Rational approximations of the normal quantile (Wichura, algorithm AS 241, PPND16): numerators and
# denominators, lowest power first, for the centre, for tails up to sqrt(-ln p) = 5, and beyond.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Hart's approximation of the distribution function (as given by West), lowest power first.
HART = (
    (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2),
    (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2),
)
HART_END = 7.07106781186547


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def ratio(of: tuple[Sequence[float], Sequence[float]], x: Column) -> Column:
    return polynomial(of[0], x) / polynomial(of[1], x)


def quantile(p: Column) -> Column:
    """The value below which a standard normal falls with probability p, 0 < p < 1."""

    def of(p: Column) -> Column:
        q = p - 0.5
        centre = bound(F.lit(0.180625) - q * q, lambda r: q * ratio(CENTRE, r))
        tail = bound(F.sqrt(-F.log(F.least(p, 1 - p))), lambda r: F.when(r <= 5, ratio(TAIL, r - 1.6)).otherwise(ratio(FAR_TAIL, r - 5.0)))
        return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)

    return bound(p, of)


def below(x: Column) -> Column:
    """The probability that a standard normal falls below x."""

    def of(x: Column) -> Column:
        far = F.lit(0.65)
        for n in (4.0, 3.0, 2.0, 1.0):
            far = F.lit(n) / (x + far)
        density = F.exp(-x * x / 2)
        return F.when(x < HART_END, density * ratio(HART, x)).otherwise(density / (x + far) / 2.506628274631)

    tail = bound(F.abs(x), of)
    return F.when(x > 0, 1 - tail).otherwise(tail)
