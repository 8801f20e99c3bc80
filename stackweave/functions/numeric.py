"""Array-arithmetic semantics as Columns: total functions without SQL errors or NULLs for numbers.

Integer division and remainder by zero give 0; float remainder takes the divisor's sign; float division by zero and
logarithms outside their domain give infinities and NaN; comparisons with NaN are false. Inputs are not null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def int_div(a: Column, b: Column) -> Column:
    """Truncating quotient; 0 where b is 0."""
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, F.when(b != 0, b).otherwise(F.lit(1))))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; 0 where b is 0."""
    return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b != 0, b).otherwise(F.lit(1)))


def fmod(a: Column, b: Column) -> Column:
    """Remainder of the truncated quotient; NaN where b is 0."""
    return F.when(b == 0, nan()).otherwise(a % F.nullif(b, F.lit(0.0)))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder of the floored quotient; NaN for NaN operands, infinite a and b = 0."""
    r = a % F.nullif(b, F.lit(0.0))
    bad = F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == inf())
    return F.when(bad, nan()).when((r != 0) & (F.signum(r) != F.signum(b)), r + b).otherwise(r)


def true_div(a: Column, b: Column) -> Column:
    """Quotient as double; by zero: infinities, or NaN for 0 and NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def log_of(x: Column, function=F.log, pole: float = 0.0) -> Column:
    """A logarithm that is -inf at its pole and NaN below."""
    x = x.cast("double")
    return F.when(F.isnan(x), nan()).when(x == pole, -inf()).when(x < pole, nan()).otherwise(function(x))


def log(x: Column) -> Column:
    return log_of(x)


def log10(x: Column) -> Column:
    return log_of(x, F.log10)


def log1p(x: Column) -> Column:
    return log_of(x, F.log1p, -1.0)


def float_greater(a: Column, b: Column) -> Column:
    """a > b; false if either is NaN."""
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def float_equal(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def int_pow(a: Column, n: int) -> Column:
    """Repeated squaring for small whole exponents, exact for whole numbers."""
    if n < 0:
        return true_div(F.lit(1.0), int_pow(a, -n))
    out, square = None, a
    while n:
        if n & 1:
            out = square if out is None else out * square
        n >>= 1
        if n:
            square = square * square
    return F.lit(1) if out is None else out


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_div(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_of(true_div(a["re"] * b["re"] + a["im"] * b["im"], n), true_div(a["im"] * b["re"] - a["re"] * b["im"], n))


def complex_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def complex_abs(a: Column) -> Column:
    """The modulus as a complex number."""
    return complex_of(F.hypot(a["re"], a["im"]), F.lit(0.0))


def complex_exp(a: Column) -> Column:
    return complex_of(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def complex_log(a: Column) -> Column:
    return complex_of(log(F.hypot(a["re"], a["im"])), F.atan2(a["im"], a["re"]))


def complex_sqrt(a: Column) -> Column:
    r = F.hypot(a["re"], a["im"])
    re = F.sqrt((r + a["re"]) / 2)
    im = F.sqrt((r - a["re"]) / 2)
    return complex_of(re, F.when(a["im"] < 0, -im).otherwise(im))


def shift_left(a: Column, b: Column) -> Column:
    """a << b for whole numbers, 0 <= b below the width of a."""
    return F.call_function("shiftleft", a, b.cast("int"))


def shift_right(a: Column, b: Column) -> Column:
    """a >> b, which keeps the sign."""
    return F.call_function("shiftright", a, b.cast("int"))


def float_at_least(a: Column, b: Column) -> Column:
    """a >= b; false if either is NaN."""
    return (a >= b) & ~F.isnan(a) & ~F.isnan(b)


def float_not_equal(a: Column, b: Column) -> Column:
    """a != b; true if either is NaN."""
    return ~float_equal(a, b)


def whole(x: Column, kind: str = "bigint") -> Column:
    """The cast of a float to a whole kind: cut towards zero; 0 for NaN and infinities, which have none."""
    return F.when(F.isnan(x) | (F.abs(x) == inf()), F.lit(0)).otherwise(x).cast(kind)


def complex_real(a: Column) -> Column:
    return a["re"].cast("float")


def complex_imag(a: Column) -> Column:
    return a["im"].cast("float")


def complex_equal(a: Column, b: Column) -> Column:
    return float_equal(a["re"], b["re"]) & float_equal(a["im"], b["im"])


def complex_not_equal(a: Column, b: Column) -> Column:
    return ~complex_equal(a, b)


def one() -> Column:
    return complex_of(F.lit(1.0), F.lit(0.0))


def complex_pow(a: Column, b: Column) -> Column:
    """a to the power b by logarithms; 0 to the power 0 is 1, and 0 to any other 0."""
    zero, none = (a["re"] == 0) & (a["im"] == 0), (b["re"] == 0) & (b["im"] == 0)
    return F.when(none, one()).when(zero, complex_of(F.lit(0.0), F.lit(0.0))).otherwise(complex_exp(complex_mul(b, complex_log(a))))


def complex_expm1(a: Column) -> Column:
    """exp(a) - 1 without loss for small a."""
    half = F.sin(a["im"] / 2)
    return complex_of(F.expm1(a["re"]) * F.cos(a["im"]) - 2 * half * half, F.exp(a["re"]) * F.sin(a["im"]))


def complex_log1p(a: Column) -> Column:
    """log(1 + a); for small a without the loss of adding 1."""
    return complex_of(0.5 * log1p(a["re"] * (2 + a["re"]) + a["im"] * a["im"]), F.atan2(a["im"], 1 + a["re"]))


def complex_sin(a: Column) -> Column:
    return complex_of(F.sin(a["re"]) * F.cosh(a["im"]), F.cos(a["re"]) * F.sinh(a["im"]))


def complex_cos(a: Column) -> Column:
    return complex_of(F.cos(a["re"]) * F.cosh(a["im"]), -F.sin(a["re"]) * F.sinh(a["im"]))


def complex_tan(a: Column) -> Column:
    return complex_div(complex_sin(a), complex_cos(a))


def complex_sinh(a: Column) -> Column:
    return complex_of(F.sinh(a["re"]) * F.cos(a["im"]), F.cosh(a["re"]) * F.sin(a["im"]))


def complex_cosh(a: Column) -> Column:
    return complex_of(F.cosh(a["re"]) * F.cos(a["im"]), F.sinh(a["re"]) * F.sin(a["im"]))


def complex_tanh(a: Column) -> Column:
    return complex_div(complex_sinh(a), complex_cosh(a))
