"""Functions for calculated columns. Each takes and returns columns; plain Python values stand for literals.

Arithmetic never raises on data: text that is no number, and a zero divisor in a cell, give NULL. A divisor that is
literally zero is refused when the expression is written. In text functions a missing cell is empty text.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import TableError, strip, written_date


def value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _is(x: Column, *types: str) -> Column:
    """Is the cell of one of these types? Known when the query is planned, so only one branch is left."""
    return F.typeof(x).isin(*types)


def _float_text(x: Column) -> Column:
    """A double as its shortest digits: 0.5, 100000.0, 1e+16, 1e-05."""
    java = x.cast("string")
    sign, digits = F.regexp_extract(java, "^-?", 0), F.regexp_replace(F.regexp_extract(java, r"^-?([0-9]+(?:\.[0-9]+)?)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, "E(-?[0-9]+)$", 1).try_cast("int")
    plain = F.replace(digits, F.lit("."), F.lit(""))
    size = F.length(plain)
    large = F.concat(F.rpad(plain, F.greatest(size, power + 1), F.lit("0")))
    large = F.concat(F.left(large, power + 1), F.lit("."), F.coalesce(F.nullif(F.substring(large, power + 2, F.lit(99)), F.lit("")), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), plain)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    moved = F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(F.concat(digits, F.lit("e"), exponent))
    spelled = F.when(F.contains(java, F.lit("E")), F.concat(sign, moved)).otherwise(java)
    return F.when(java == "Infinity", "inf").when(java == "-Infinity", "-inf").when(java == "NaN", "nan").otherwise(spelled)


def text(x) -> Column:
    """The cell as text, '' when missing: True and False, doubles by their shortest digits."""
    if not isinstance(x, Column):
        return F.lit("" if x is None else str(x))
    return F.coalesce(F.when(_is(x, "boolean"), F.initcap(x.cast("string"))).when(_is(x, "double", "float"), _float_text(x)).otherwise(x.cast("string")), F.lit(""))


def number(x) -> Column:
    """The cell as a double, NULL when it is not a number."""
    if not isinstance(x, Column):
        return F.lit(float(x))
    return F.when(~x.cast("string").rlike(r"[0-9.][dDfF]\s*$"), x.try_cast("double"))


def _numeric(x) -> Column:
    """A declared number as it is, any other cell as a double or NULL."""
    if not isinstance(x, Column):
        return F.lit(x)
    return F.when(_is(x, "string", "boolean"), number(x)).otherwise(x)


# ---- text -----------------------------------------------------------------------------------------------------------
def CONCAT(*parts) -> Column:
    return F.concat(*[text(p) for p in parts])


def UPPER(x) -> Column:
    return F.upper(text(x))


def LOWER(x) -> Column:
    return F.lower(text(x))


def TRIM(x) -> Column:
    return strip(text(x))


def LEFT(x, n: int) -> Column:
    return F.left(text(x), F.lit(max(int(n), 0)))


def RIGHT(x, n: int) -> Column:
    return F.right(text(x), F.lit(max(int(n), 0)))


def LEN(x) -> Column:
    return F.length(text(x))


def REPLACE(x, old: str, new: str) -> Column:
    return F.replace(text(x), F.lit(old), F.lit(new))


def REPEAT(x, n: int, most: int = 1000) -> Column:
    if abs(n) > most:
        raise TableError(f"a text is repeated {most} times at most; `most` sets another limit")
    return F.repeat(text(x), F.lit(int(n)))


# ---- numbers --------------------------------------------------------------------------------------------------------
def ROUND(x, decimals: int = 0) -> Column:
    """Halves go away from zero, on the number as it is written (2.675 gives 2.68)."""
    if not -15 <= decimals <= 15:
        raise TableError("the number of decimals must be between -15 and 15")
    return F.round(_numeric(x), decimals)


def ABS(x) -> Column:
    return F.abs(number(x))


def CEILING(x) -> Column:
    return F.ceil(number(x)).cast("double")


def FLOOR(x) -> Column:
    return F.floor(number(x)).cast("double")


def ADD(a, b) -> Column:
    """The sum of two numbers; cells that are no numbers give NULL. `CONCAT` joins texts."""
    return number(a) + number(b)


def SUBTRACT(a, b) -> Column:
    return number(a) - number(b)


def MULTIPLY(a, b) -> Column:
    """The product of two numbers; `REPEAT` repeats a text."""
    return number(a) * number(b)


def _refuse_zero(b) -> None:
    if not isinstance(b, Column) and b == 0:
        raise TableError("division by zero")


def DIVIDE(a, b) -> Column:
    _refuse_zero(b)
    return F.try_divide(number(a), number(b))


def FLOORDIV(a, b) -> Column:
    return F.floor(DIVIDE(a, b)).cast("double")


def MOD(a, b) -> Column:
    """Remainder with the sign of the divisor."""
    _refuse_zero(b)
    return number(a) - number(b) * F.floor(F.try_divide(number(a), number(b)))


def POWER(a, b, most: float = 10) -> Column:
    if not isinstance(b, Column) and abs(b) > most:
        raise TableError(f"exponents go up to {most}; `most` sets another limit")
    return F.pow(number(a), number(b))


# ---- dates ----------------------------------------------------------------------------------------------------------
def _date(x, order: str) -> Column:
    """A date, however it is written: ISO, 20240305, 03/05/2024 (by `order`), 5 Mar 2024, March 5, 2024."""
    spelled = value(x).cast("string")
    iso = F.when(spelled.rlike(r"^\d{4}-\d{1,2}(-\d{1,2}([ T].*)?)?$") & (F.length(spelled) >= 8), spelled.try_cast("date"))
    compact = F.when(spelled.rlike(r"^\d{8}$"), F.try_make_timestamp(*[F.substring(spelled, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2))], F.lit(0), F.lit(0), F.lit(0)))
    return F.coalesce(iso, compact.cast("date"), written_date(spelled, T.StringType(), order).cast("date"))


def YEAR(x, order: str = "MDY") -> Column:
    return F.year(_date(x, order))


def MONTH(x, order: str = "MDY") -> Column:
    return F.month(_date(x, order))


def DAY(x, order: str = "MDY") -> Column:
    return F.day(_date(x, order))


def TODAY() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


# ---- conditions -----------------------------------------------------------------------------------------------------
def ISNULL(x) -> Column:
    return value(x).isNull()


def COALESCE(*xs) -> Column:
    return F.coalesce(*[value(x) for x in xs])


def IF(condition: Column, then, otherwise) -> Column:
    """A missing condition counts as false."""
    return F.when(condition, value(then)).otherwise(value(otherwise))


def EQ(a, b) -> Column:
    return F.coalesce(value(a) == value(b), F.lit(False))


def NE(a, b) -> Column:
    """True where either side is missing, as well as where they differ."""
    return F.coalesce(value(a) != value(b), F.lit(True))


def LT(a, b) -> Column:
    return F.coalesce(value(a) < value(b), F.lit(False))


def LE(a, b) -> Column:
    return F.coalesce(value(a) <= value(b), F.lit(False))


def GT(a, b) -> Column:
    return F.coalesce(value(a) > value(b), F.lit(False))


def GE(a, b) -> Column:
    return F.coalesce(value(a) >= value(b), F.lit(False))


def BETWEEN(low, x, high) -> Column:
    """low < x < high, as a chained comparison."""
    return LT(low, x) & LT(x, high)
