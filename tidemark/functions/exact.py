"""Integer and rational arithmetic with one fixed rounding rule per function.

Amounts are unsigned 64-bit and a price is quote/base, so products need up to 128 bits.
``return_bps`` tries decimal(38,0) first and falls back on two limbs of 18 digits, so it is
known whenever it fits 64 bits. Prices are ordered by ``price_key``, which is exact for all
64-bit amounts. ``ratio_exact`` / ``bps_exact`` give fractions and returns of any size
through Arrow batches.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64_MAX = 2**64 - 1
WIDE = "decimal(38,0)"
PRICE = "decimal(38,18)"
LIMB = 10**18


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wide(c) -> Column:
    return _col(c).cast(WIDE)


def div_trunc(a, b) -> Column:
    """Integer quotient toward zero; null on a zero divisor."""
    return F.call_function("div", _col(a), F.nullif(_col(b), F.lit(0).cast("int")))


def div_floor(a, b) -> Column:
    """Integer quotient toward minus infinity for a positive divisor."""
    a, b = _col(a), F.nullif(_col(b), F.lit(0).cast("int"))
    return F.call_function("div", a - F.pmod(a, b), b)


def clip(c, low: int, high: int) -> Column:
    # least/greatest skip nulls, so unknown has to be kept by hand
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def price(quote, base) -> Column:
    """Comparable price, quote per base, 18 decimal places."""
    return F.try_divide(_col(quote).cast("decimal(20,0)"), _col(base).cast("decimal(20,0)")).cast(PRICE)


def _whole(a: str, b: str) -> str:
    """Integer quotient of non-negative decimals, up to 32 digits; ``div`` stops at 64 bits."""
    return f"cast(try_divide({a} - {a} % {b}, {b}) as {WIDE})"


def _steps(*steps: dict) -> str:
    """A lambda that computes the fields of each step from those of the step before (``x``); the last step has one unnamed field."""
    out = ""
    for i, fields in enumerate(steps):
        struct = fields[""] if "" in fields else "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        out = f"x -> {struct}" if i == 0 else f"x -> get(transform(array({out.removeprefix('x -> ')}), x -> {struct}), 0)"
    return out


def _apply(body: str, **arguments: Column) -> Column:
    """The lambda's result for one struct of arguments, which are computed once however often the lambda names them."""
    one = F.array(F.struct(*[c.alias(k) for k, c in arguments.items()]))
    return F.get(F.call_function("transform", one, F.expr(body)), F.lit(0))


_LIMB = f"cast({LIMB} as {WIDE})"
_DIGITS = ", ".join(
    f"'d{i}', cast({rest} * {_LIMB} as {WIDE}) div x.b"
    for i, rest in ((1, "(x.q % x.b)"), (2, f"(cast((x.q % x.b) * {_LIMB} as {WIDE}) % x.b)"),
                    (3, f"(cast((cast((x.q % x.b) * {_LIMB} as {WIDE}) % x.b) * {_LIMB} as {WIDE}) % x.b)")))
_KEY = f"x -> case when x.q is not null and x.b is not null then named_struct('whole', cast({_whole('x.q', 'x.b')} as decimal(20,0)), {_DIGITS}) end"


def price_key(quote, base) -> Column:
    """Struct that orders quote / base exactly: integer part and 54 digits after the point.

    Different fractions of 64-bit numbers are at least 2^-128 apart, so 39 digits tell them apart.
    """
    return _apply(_KEY, q=wide(quote), b=F.nullif(wide(base), F.lit(0).cast(WIDE)))


def _divided(d: str) -> tuple[dict, dict]:
    """Steps that divide upper * 10^18 + lower by the field ``d`` (below 10^20) and note whether something is left."""
    carry = {"upper": _whole("x.upper", f"x.{d}"), "rest": f"cast((x.upper % x.{d}) * {_LIMB} + x.lower as {WIDE})", "b": "x.b", "q0": "x.q0", "inexact": "x.inexact"}
    divide = {"upper": "x.upper", "lower": _whole("x.rest", f"x.{d}"), "b": "x.b", "q0": "x.q0", "inexact": f"x.inexact or x.rest % x.{d} <> 0"}
    return carry, divide


_HALF, _EIGHT, _TIMES = f"cast({10**10} as {WIDE})", f"cast({10**8} as {WIDE})", f"cast(x.q * cast(10000 as {WIDE}) as {WIDE})"
#: floor or, below one, ceiling of 10000 * q * b0 / b / q0, less 10000; null beyond 64 bits. 10000 * q * b0 is held as upper * 10^18 + lower
#: and divided by one limb at a time: floor(x / (b * q0)) = floor(floor(x / b) / q0).
_RETURN = _steps(
    {"high": f"cast({_TIMES} * {_whole('x.b0', _HALF)} as {WIDE})", "low": f"cast({_TIMES} * (x.b0 % {_HALF}) as {WIDE})", "b": "x.b", "q0": "x.q0"},
    {"upper": _whole("x.high", _EIGHT), "lower": f"cast((x.high % {_EIGHT}) * {_HALF} + x.low as {WIDE})", "b": "x.b", "q0": "x.q0"},
    {"upper": f"cast(x.upper + {_whole('x.lower', _LIMB)} as {WIDE})", "lower": f"cast(x.lower % {_LIMB} as {WIDE})", "b": "x.b", "q0": "x.q0", "inexact": "false"},
    *_divided("b"),
    *_divided("q0"),
    {"value": f"cast(try_add(cast(try_multiply(x.upper, {_LIMB}) as {WIDE}), x.lower) as {WIDE})", "inexact": "x.inexact"},
    {"": f"try_cast(x.value + if(x.value < 10000 and x.inexact, 1, 0) - cast(10000 as {WIDE}) as bigint)"},
)


def _return_bps_limbs(q: Column, b: Column, q0: Column, b0: Column) -> Column:
    zero = F.lit(0).cast(WIDE)
    return _apply(_RETURN, q=q, b=F.nullif(b, zero), q0=F.nullif(q0, zero), b0=b0)


def return_bps(quote, base, quote0, base0) -> Column:
    """trunc(((quote/base)/(quote0/base0) - 1) * 10000) on integers below 10^20; null only when the result leaves 64 bits."""
    q, b, q0, b0 = map(wide, (quote, base, quote0, base0))
    left, right = F.try_multiply(q, b0), F.try_multiply(q0, b)
    scaled = F.try_multiply(F.try_subtract(left, right).cast(WIDE), F.lit(10000).cast(WIDE))
    # ``div`` keeps the low 64 bits of a larger quotient, so large ratios take the other way
    fits = F.try_divide(left.cast("double"), right.cast("double")) < 9e14
    return F.coalesce(F.when(fits, div_trunc(scaled.cast(WIDE), right.cast(WIDE))), _return_bps_limbs(q, b, q0, b0))


def change_bps(value, base) -> Column:
    """trunc((value - base) * 10000 / base) for plain integers."""
    scaled = F.try_multiply(F.try_subtract(wide(value), wide(base)).cast(WIDE), F.lit(10000).cast(WIDE))
    return div_trunc(scaled.cast(WIDE), wide(base))


def u64(text) -> Column:
    """Digits-only unsigned 64-bit amount carried as text, else null."""
    text = _col(text)
    value = F.when(text.rlike("^[0-9]{1,38}$"), text.cast(WIDE))
    return F.when(value <= F.lit(str(U64_MAX)).cast(WIDE), value.cast("decimal(20,0)"))


def haircut_output(minimum_output, output, adverse_bps) -> Column:
    """Smaller of the quoted minimum and the output cut by an adverse move, floored."""
    kept = F.try_multiply(wide(output), (F.lit(10000) - F.lit(adverse_bps)).cast(WIDE))
    return F.least(wide(minimum_output), div_floor(kept.cast(WIDE), F.lit(10000).cast(WIDE)).cast(WIDE))


def nearest_rank(n, p: int) -> Column:
    """1-based rank of the p-th percentile of n values."""
    n = _col(n)
    return F.least(n, F.call_function("div", n * F.lit(p) + F.lit(99), F.lit(100)))


RATIO = T.StructType([T.StructField("numerator", T.StringType()), T.StructField("denominator", T.StringType())])


@F.pandas_udf(RATIO)
def ratio_exact(num: pd.Series, den: pd.Series) -> pd.DataFrame:
    """Reduced fraction of two integer texts of any size; null on missing or zero denominator."""
    out = []
    for n, d in zip(num, den):
        if n is None or d is None or pd.isna(n) or pd.isna(d) or int(d) == 0:
            out.append((None, None))
        else:
            f = Fraction(int(n), int(d))
            out.append((str(f.numerator), str(f.denominator)))
    return pd.DataFrame(out, columns=["numerator", "denominator"])


def fraction(numerator, denominator, zeros: int = 0) -> Column:
    """Reduced numerator / denominator as texts; the numerator is followed by ``zeros`` zeros before it is reduced."""
    num = _col(numerator).cast(WIDE).cast("string")
    return ratio_exact(F.concat(num, F.lit("0" * zeros)) if zeros else num, _col(denominator).cast(WIDE).cast("string"))


@F.pandas_udf(T.LongType())
def bps_exact(q: pd.Series, b: pd.Series, q0: pd.Series, b0: pd.Series) -> pd.Series:
    """``return_bps`` without a size limit; arguments are integer texts."""
    out = []
    for quote, base, quote_0, base_0 in zip(q, b, q0, b0):
        if None in (quote, base, quote_0, base_0) or 0 in (int(base), int(quote_0)):
            out.append(None)
        else:
            out.append(int((Fraction(int(quote), int(base)) / Fraction(int(quote_0), int(base_0)) - 1) * 10000))
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.ArrayType(RATIO))
def returns_exact(quotes: pd.Series, bases: pd.Series) -> pd.Series:
    """Successive simple returns of one window as reduced fractions; arguments as in ``rms_return_bps``."""
    out = []
    for q, b in zip(quotes, bases):
        p = [] if q is None else [Fraction(int(x), int(y)) for x, y in zip(q, b)]
        r = [y / x - 1 for x, y in zip(p, p[1:])]
        out.append([{"numerator": str(x.numerator), "denominator": str(x.denominator)} for x in r] or None)
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def rms_return_bps(quotes: pd.Series, bases: pd.Series) -> pd.Series:
    """Floor of the root mean square of successive price returns in basis points, exact.

    Each row holds the (bounded) quote and base amounts of one window, oldest first.
    """
    out = []
    for q, b in zip(quotes, bases):
        if q is None or len(q) < 2:
            out.append(None)
            continue
        p = [Fraction(int(x), int(y)) for x, y in zip(q, b)]
        r = [(y / x - 1) ** 2 for x, y in zip(p, p[1:])]
        var = sum(r, Fraction(0)) / len(r)
        out.append(isqrt((var.numerator * 100_000_000) // var.denominator))
    return pd.Series(out, dtype="Int64")
