"""Column functions over strings, numbers and JSON, and statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def sanitised(value: Column) -> Column:
    """A string that can stand in a record: semicolons become bars."""
    return F.translate(value, ";", "|")


def is_number(value: Column) -> Column:
    return value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def is_number_like(value: Column) -> Column:
    """Decimal, hexadecimal, octal or binary."""
    return is_number(value) | value.rlike(r"^[+-]?0[xX][0-9a-fA-F]+$") | value.rlike(r"^[+-]?0[bB][01]+$")


def parsed_integer(value: Column) -> Column:
    """Decimal, 0x hexadecimal, 0b binary or 0-led octal; null for others."""
    hexa, binary, octal = (F.conv(F.regexp_replace(value, f"^0{p}", ""), b, 10).try_cast("bigint") for p, b in (("[xX]", 16), ("[bB]", 2), ("", 8)))
    return F.when(value.rlike("^0[xX][0-9a-fA-F]+$"), hexa).when(value.rlike("^0[bB][01]+$"), binary).when(value.rlike("^0[0-7]+$"), octal).when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("bigint"))


def typed_list(value: Column, kind: str) -> Column:
    """A comma list as an array of int, float or string; what doesn't parse is null."""
    to = {"Integer": "int", "Float": "float", "String": "string"}[kind]
    return F.transform(F.split(value, ","), lambda x: F.when(x != ".", x.try_cast(to) if to != "string" else x))


def json_path(value: Column, path: str) -> Column:
    return F.get_json_object(value, path)


def general_format(value: Column) -> Column:
    """Six significant digits without trailing zeros, as %g prints."""
    e = F.floor(F.log10(F.abs(value)))
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", value), r"\.?0+e", "e"), r"e([+-])0*([0-9]{2,})$", "e$1$2")
    plain = F.concat(*[F.lit("")])
    for d in range(-4, 6):
        plain = F.when(e == d, F.format_string(f"%.{5 - d}f", value)).otherwise(plain)
    trimmed = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(value.isNull(), None).when(value == 0, "0").when((e >= -4) & (e < 6), trimmed).otherwise(fixed)


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: the probability of all tables as unlikely or more."""
    n, row, col = a + b + c + d, a + b, a + c
    lo, hi = max(0, row + col - n), min(row, col)
    logs = [_log_choose(row, x) + _log_choose(n - row, col - x) - _log_choose(n, col) for x in range(lo, hi + 1)]
    here = logs[a - lo]
    return min(1.0, sum(math.exp(x) for x in logs if x <= here + 1e-9))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def gamma_share(s: float, x: float) -> float:
    """The regularised lower incomplete gamma function P(s, x), by its series, or from its complement's continued fraction."""
    if not s > 0 or not x >= 0:
        return math.nan
    if x == 0:
        return 0.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(front * total, 1.0)
    return 1.0 - front * _continued(lambda i: (-i * (i - s), x + 2 * i + 1 - s), x + 1 - s)


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by the continued fraction on the side where it converges fast."""
    if not (a > 0 and b > 0 and 0 <= x <= 1):
        return math.nan
    if x in (0, 1):
        return float(x)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    return front * _continued(step, 1.0)


def _continued(step: Callable[[int], tuple[float, float]], first: float) -> float:
    """1 / (first + n1 / (d1 + n2 / (d2 + ...))) of successive (n, d), by the ratios of its convergents' numerators and denominators."""
    tiny = 1e-300
    value = above = first or tiny
    below = 0.0
    for i in range(1, 100_000):
        n, d = step(i)
        below = 1 / (d + n * below or tiny)
        above = d + n / above or tiny
        value *= above * below
        if abs(above * below - 1) < 1e-15:
            break
    return 1 / value


@F.pandas_udf(DoubleType())
def incomplete_gamma(s: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([gamma_share(*p) for p in zip(s, x, strict=True)])


@F.pandas_udf(DoubleType())
def incomplete_beta(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([beta_share(*p) for p in zip(a, b, x, strict=True)])


def hardy_weinberg(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Chi-square of genotype counts against Hardy-Weinberg proportions."""
    n = (hom_ref + het + hom_alt).cast("double")
    p = (2 * hom_ref + het) / (2 * n)
    expect = (n * p * p, 2 * n * p * (1 - p), n * (1 - p) * (1 - p))
    parts = [F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in zip((hom_ref, het, hom_alt), expect, strict=True)]
    return F.when(n > 0, parts[0] + parts[1] + parts[2])


def base64_text(value: Column) -> Column:
    """base64 on one line: Spark's own breaks it after 76 characters."""
    return F.translate(F.base64(value), "\r\n", "")
