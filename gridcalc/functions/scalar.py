"""Scalar functions: name to arity and a builder of Column expressions.

Builders take Columns of doubles, texts or booleans as their kinds say and give a Column; out of a function's domain the
result is null. ``register`` adds a function of the user's.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int
    takes: str  # one letter an argument, the last repeats: n number, t text, a any
    gives: str  # num, text or bool
    build: Callable[..., Column]


FUNCTIONS: dict[str, Function] = {}


def register(name: str, least: int, most: int, takes: str, gives: str, build: Callable[..., Column]) -> None:
    """Adds or replaces a scalar function; ``build`` may wrap a pandas UDF."""
    FUNCTIONS[name.upper()] = Function(name.upper(), least, most, takes, gives, build)


def _when(domain: Column, value: Column) -> Column:
    return F.when(domain, value)


def _double(c: Column) -> Column:
    return c.cast("double")


def _floor(c: Column) -> Column:
    """Largest whole number not above, as a double of any size."""
    return F.when(F.abs(c) < 1e18, _double(F.floor(c))).otherwise(c)


def _ceil(c: Column) -> Column:
    return F.when(F.abs(c) < 1e18, _double(F.ceil(c))).otherwise(c)


def _products(step: int, most: int) -> list[float]:
    """n times (n - step) times ... down to 1, for n from 0."""
    out: list[int] = []
    for n in range(most + 1):
        out.append(n * out[n - step] if n > step else max(1, n))
    return [float(x) for x in out]


def _from_products(table: list[float]) -> Callable[[Column], Column]:
    def build(x: Column) -> Column:
        values = F.array(*map(F.lit, table))
        whole = F.when(x >= 0, _floor(x))
        return F.when(whole < len(table), F.element_at(values, (F.least(whole, F.lit(float(len(table) - 1))) + 1).cast("int")))

    return build


def _numeral(n: int) -> str:
    """A roman numeral by the subtractive rule."""
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


def _roman(x: Column) -> Column:
    n = F.when((x >= 0) & (x < 5000), _floor(x).cast("int"))
    digit = lambda p: F.element_at(F.array(*(F.lit(_numeral(k * p)) for k in range(10))), ((n / p).cast("int") % 10) + 1)
    return F.when(n == 0, "N").otherwise(F.concat(digit(1000), digit(100), digit(10), digit(1)))


def _arabic(t: Column) -> Column:
    values = F.create_map(*(F.lit(v) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in pair))
    signs = F.reverse(F.split(t, ""))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))

    def step(acc: Column, sign: Column) -> Column:
        v = F.coalesce(values[sign], F.lit(0))
        return F.struct(F.when(v < acc["most"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), F.greatest(v, acc["most"]).alias("most"))

    valid = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    total = _double(F.aggregate(signs, start, step, lambda acc: acc["sum"]))
    return F.when(t == "N", 0.0).when(t.rlike(valid) & (t != ""), total)


def _decimal(t: Column, base: Column) -> Column:
    b = F.when((base >= 2) & (base <= 36), _floor(base).cast("int"))
    digits = F.upper(F.regexp_replace(t, r"\.0*$", ""))
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(digits, "^-", "")
    every = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    fold = F.aggregate(F.split(digits, ""), F.lit(0.0), lambda acc, d: acc * b + (F.instr(every, d) - 1))
    fine = digits.rlike("^[0-9A-Z]+$") & F.forall(F.split(digits, ""), lambda d: F.instr(every, d) <= b)
    return F.when(fine & b.isNotNull(), fold * sign)


def _scaled(rounding: Callable[[Column], Column]) -> Callable[..., Column]:
    def build(x: Column, digits: Column | None = None) -> Column:
        p = F.pow(F.lit(10.0), digits if digits is not None else F.lit(0.0))
        return F.try_divide(rounding(x * p), p)

    return build


def _multiple(rounding: Callable[[Column], Column], size: Callable[[Column], Column] = lambda y: y) -> Callable[..., Column]:
    def build(x: Column, y: Column | None = None) -> Column:
        step = size(y if y is not None else F.lit(1.0))
        return rounding(F.try_divide(x, step)) * step

    return build


def _multiple_mode(rounding: Callable[[Column], Column]) -> Callable[..., Column]:
    def build(x: Column, y: Column | None = None, mode: Column | None = None) -> Column:
        y = y if y is not None else F.lit(1.0)
        plain = rounding(F.try_divide(x, y)) * y
        if mode is None:
            return plain
        return F.when(mode == 0, plain).otherwise(F.signum(x) * rounding(F.try_divide(F.abs(x), y)) * y)

    return build


def _mod(a: Column, b: Column) -> Column:
    return a - b * _floor(F.try_divide(a, b))


def _find(needle: Column, text: Column, start: Column | None = None) -> Column:
    return (F.call_function("locate", needle, text, (start if start is not None else F.lit(0)).cast("int") + 1) - 1).cast("int")


def _count(c: Column | None) -> Column:
    return F.greatest(c.cast("int"), F.lit(0)) if c is not None else F.lit(1)


def _mid(t: Column, start: Column, n: Column) -> Column:
    return F.substring(t, start.cast("int") + 1, F.greatest(n.cast("int"), F.lit(0)))


def _replace(t: Column, at: Column, n: Column, new: Column) -> Column:
    at, n = at.cast("int"), n.cast("int")
    return F.concat(F.substring(t, F.lit(1), at), new, F.substring(t, at + n + 1, F.length(t)))


def _try_date(text: Column, pattern: str) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))


def _value(t: Column) -> Column:
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    number = lambda k: F.regexp_extract(t, r"^(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", k).try_cast("double")
    hours = number(1) + F.when(F.upper(t).contains("PM"), 12.0).otherwise(0.0)
    time = (hours * 3600 + number(2) * 60 + F.coalesce(number(3), F.lit(0.0))) / 86400
    day = F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _try_date(t, "y-M-d")),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _try_date(t, "M/d/y")),
        F.when(t.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), _try_date(F.initcap(t), "MMMM d, y")),
    )
    date = _double(F.datediff(day, F.lit("1899-12-30").cast("date")))
    digits = F.regexp_replace(t, r"[^0-9.]", "").try_cast("double")
    plain = F.when(t.contains("%"), digits / 100).otherwise(digits)
    is_date = t.contains("-") | t.contains("/") | t.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$")
    return F.when(t.contains(":"), time).when(is_date, date).otherwise(plain)


def _random(lo: Column, hi: Column) -> Column:
    lo, hi = _ceil(lo), _ceil(hi)
    return F.when(hi > lo, _floor(lo + F.rand() * (hi - lo)))


def _one(name: str, build: Callable[[Column], Column], gives: str = "num") -> None:
    register(name, 1, 1, "n", gives, build)


_one("ABS", F.abs)
_one("ACOS", lambda x: _when(F.abs(x) <= 1, F.acos(x)))
_one("ACOSH", lambda x: _when(x >= 1, F.acosh(x)))
_one("ACOT", lambda x: F.when(x == 0, PI / 2).otherwise(F.atan(F.try_divide(F.lit(1.0), x))))
_one("ACOTH", lambda x: _when(F.abs(x) > 1, 0.5 * F.ln(F.try_divide(x + 1, x - 1))))
register("ARABIC", 1, 1, "t", "num", _arabic)
_one("ASIN", lambda x: _when(F.abs(x) <= 1, F.asin(x)))
_one("ASINH", F.asinh)
_one("ATAN", F.atan)
_one("ATANH", lambda x: _when(F.abs(x) < 1, F.atanh(x)))
_one("COS", F.cos)
_one("COSH", F.cosh)
_one("COT", lambda x: F.try_divide(F.lit(1.0), F.tan(x)))
_one("COTH", lambda x: F.try_divide(F.lit(1.0), F.tanh(x)))
_one("CSC", lambda x: F.try_divide(F.lit(1.0), F.sin(x)))
_one("CSCH", lambda x: F.try_divide(F.lit(1.0), F.sinh(x)))
_one("DEGREES", F.degrees)
_one("EVEN", lambda x: _ceil(x / 2) * 2)
_one("EXP", F.exp)
_one("FACT", _from_products(_products(1, 170)))
_one("FACTDOUBLE", _from_products(_products(2, 300)))
_one("INT", _floor)
_one("ISEVEN", lambda x: _mod(x, F.lit(2.0)) == 0, "bool")
_one("ISODD", lambda x: _mod(x, F.lit(2.0)) == 1, "bool")
_one("LN", lambda x: _when(x > 0, F.ln(x)))
_one("LOG10", lambda x: _when(x > 0, F.log10(x)))
_one("NEGATE", lambda x: -x)
_one("ODD", lambda x: _floor(_ceil(x) / 2) * 2 + 1)
_one("RADIANS", F.radians)
_one("SEC", lambda x: F.try_divide(F.lit(1.0), F.cos(x)))
_one("SECH", lambda x: F.try_divide(F.lit(1.0), F.cosh(x)))
_one("SIGN", lambda x: F.signum(x).cast("int"))
_one("SIN", F.sin)
_one("SINH", F.sinh)
_one("SQRT", lambda x: _when(x >= 0, F.sqrt(x)))
_one("SQRTPI", lambda x: _when(x >= 0, F.sqrt(x * PI)))
_one("TAN", F.tan)
_one("TANH", F.tanh)
_one("ROMAN", _roman, "text")
_one("%", lambda x: x / 100)
register("ATAN2", 2, 2, "n", "num", F.atan2)
register("DECIMAL", 2, 2, "tn", "num", _decimal)
register("MOD", 2, 2, "n", "num", _mod)
register("MROUND", 2, 2, "n", "num", lambda x, y: y * F.rint(F.try_divide(x, y)))
register("POWER", 2, 2, "n", "num", F.pow)
register("^", 2, 2, "n", "num", F.pow)
register("RANDBETWEEN", 2, 2, "n", "num", _random)
register("CEILING", 1, 2, "n", "num", _multiple(_ceil))
register("CEILING.MATH", 1, 3, "n", "num", _multiple_mode(_ceil))
register("CEILING.PRECISE", 1, 2, "n", "num", _multiple(_ceil, F.abs))
register("ISO.CEILING", 1, 2, "n", "num", _multiple(_ceil, F.abs))
register("FLOOR", 1, 2, "n", "num", _multiple(_floor))
register("FLOOR.MATH", 1, 3, "n", "num", _multiple_mode(_floor))
register("FLOOR.PRECISE", 1, 2, "n", "num", _multiple(_floor, F.abs))
register("ROUND", 1, 2, "n", "num", _scaled(F.rint))
register("ROUNDDOWN", 1, 2, "n", "num", _scaled(_floor))
register("ROUNDUP", 1, 2, "n", "num", _scaled(_ceil))
register("TRUNC", 1, 2, "n", "num", _scaled(lambda x: F.signum(x) * _floor(F.abs(x))))
register("CONCAT", 2, 255, "t", "text", F.concat)
register("CONCATENATE", 2, 255, "t", "text", F.concat)
register("&", 2, 2, "t", "text", F.concat)
register("EXACT", 2, 2, "t", "bool", lambda a, b: F.coalesce(a == b, F.lit(False)))
register("FIND", 2, 3, "ttn", "num", _find)
register("LEFT", 1, 2, "tn", "text", lambda t, n=None: F.substring(t, F.lit(1), _count(n)))
register("LEN", 1, 1, "t", "num", F.length)
register("LOWER", 1, 1, "t", "text", F.lower)
register("MID", 3, 3, "tnn", "text", _mid)
register("REPLACE", 4, 4, "tnnt", "text", _replace)
register("RIGHT", 1, 2, "tn", "text", lambda t, n=None: F.right(t, F.least(_count(n), F.length(t))))
register("TRIM", 1, 1, "t", "text", lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
register("UPPER", 1, 1, "t", "text", F.upper)
register("VALUE", 1, 1, "t", "num", _value)
