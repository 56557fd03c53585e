"""Scalar column expressions (built-in functions only, so they stay in codegen).

Every helper returns a ``Column``; nothing here touches data on the driver except
the two plain-Python parameter rules ``sketch_width`` and ``series_length``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method (they must equal the original's to reproduce it):
#   month index origin: year 1982, valid years 1982 .. 2002
#   missing-value sentinel: -9999
#   solver defaults: tol 1e-2, epsilon 0.1, d 3; anomaly threshold 0.1
FIRST_YEAR = 1982
LAST_YEAR = 2002
MISSING_SENTINEL = -9999.0
DEFAULT_TOL = 1e-2
DEFAULT_EPS = 0.1
DEFAULT_D = 3
DEFAULT_THRESHOLD = 0.1

# exp(x) is exactly 0.0 in IEEE doubles for x below about -745.1332; a weight
# exp(-d2 / (2 sigma^2)) can only be non-zero when d2 < 2 sigma^2 * 745.1332.
# Candidate pruning uses a slightly larger bound and the exact weight decides.
EXP_UNDERFLOW = 745.2


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_index(year, month) -> Column:
    """(year - 1982) * 12 + month - 1; NULL for a year outside 1982-2002 or a month
    outside 0-12 (month 0 is accepted, as in the original check)."""
    y, m = _c(year), _c(month)
    ok = (y >= FIRST_YEAR) & (y <= LAST_YEAR) & (m >= 0) & (m <= 12)
    return F.when(ok, (y - FIRST_YEAR) * 12 + m - 1).cast("int")


def missing_to_zero(value, sentinel: float = MISSING_SENTINEL) -> Column:
    v = _c(value)
    return F.when(v == F.lit(sentinel), F.lit(0.0)).otherwise(v.cast("double"))


def floor_div(x, p: int) -> Column:
    """floor(x / p) of integers, exact over all 64-bit values: a division of doubles
    rounds ids beyond 2**53 into the wrong tile.  A negative x goes through its
    complement, which can't overflow."""
    c, n = _c(x).cast("bigint"), F.lit(int(p)).cast("bigint")
    return F.when(c >= 0, F.call_function("div", c, n)).otherwise(
        F.bitwise_not(F.call_function("div", F.bitwise_not(c), n)))


def round_unit(x, digits: int) -> Column:
    """``round(x, digits)`` of numbers from 0 to 1, up to 9 digits.  Spark's round goes
    through a decimal in text; only near a tie, where the product may be off, it decides.
    Elsewhere the quotient of two whole numbers is the nearest double, as it is there."""
    if not 0 <= digits <= 9:
        raise ValueError("digits must be from 0 to 9")
    c, scale = _c(x), F.lit(10.0 ** digits)
    up = F.floor(c * scale + F.lit(0.5)).cast("double")
    off = F.abs(c * scale + F.lit(0.5) - up)
    return F.when((off > F.lit(1e-3)) & (off < F.lit(0.999)), up / scale).otherwise(F.round(c, digits))


def flat_index(row, col, ncols) -> Column:
    """Row-major node id of a grid cell."""
    return (_c(row).cast("bigint") * _c(ncols) + _c(col)).cast("bigint")


def inv_degree(deg, power: float = -0.5) -> Column:
    """deg ** power with the division-by-zero case mapped to 0."""
    d = _c(deg)
    return F.when(d != 0, F.pow(d, F.lit(float(power)))).otherwise(F.lit(0.0))


def l2_norm(x) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0),
                              lambda acc, v: acc + v.cast("double") * v.cast("double")))


def hash_uniform(seed, *parts) -> Column:
    """Uniform draw in [0, 1) from the first 13 hex digits of md5(seed|parts)."""
    key = F.concat_ws("|", *[(_c(p) if not isinstance(p, (int, float)) else F.lit(p))
                            .cast("string") for p in (seed, *parts)])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def hash_normal(seed, *parts) -> Column:
    """Standard normal draw (Box-Muller on two md5 uniforms)."""
    u1 = hash_uniform(seed, *parts, F.lit("a"))
    u2 = hash_uniform(seed, *parts, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def sketch_width(n: int, eps: float = DEFAULT_EPS) -> int:
    """Number of random projections: int(ceil(log2 n) / eps)."""
    if n <= 1:
        return 0
    return int(math.ceil(math.log(n, 2)) / eps)


def series_length(tol: float = DEFAULT_TOL, d: int = DEFAULT_D) -> int:
    """Terms K of the random-walk series that the chain preconditioner plus
    ``q - 1`` Richardson steps amount to: 2^(max(d,1)-1) * max(q-1, 0),
    q = -ceil(ln tol)."""
    q = -int(math.ceil(math.log(tol)))
    return (2 ** (max(d, 1) - 1)) * max(q - 1, 0)
