"""Cell expressions against what Python says of cases built from the grammar of written numbers, dates and formulas."""
import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import cells
from gridloom.functions import formulas as f


def column(spark, values, type_="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")


def results(df, c):
    return [r[0] for r in df.select(c, "i").orderBy("i").collect()]


# ---- numbers: sign x grouping x fraction x exponent -----------------------------------------------------------------
WHOLE = [8, 96, 4071, 250_318, 63_004_975]
FRACTION = ["", "5", "0625"]


def spelled(point):
    """(text, value) of every number the grammar writes with this decimal point."""
    mark = "," if point == "." else "."
    for n, fraction, grouped, sign in itertools.product(WHOLE, FRACTION, (False, True), ("", "-", "+", "()")):
        text = f"{n:,}".replace(",", mark) if grouped else str(n)
        text += point + fraction if fraction else ""
        value = float(f"{n}.{fraction or 0}")
        yield (f"({text})", -value) if sign == "()" else (sign + text, -value if sign == "-" else value)


@pytest.mark.parametrize("point", [".", ","])
def test_written_numbers(spark, point):
    cases = list(spelled(point))
    df = column(spark, [t for t, _ in cases])
    assert results(df, cells.written_number(F.col("v"), point)) == [v for _, v in cases]


def test_numbers_with_marks_and_exponents(spark):
    plain = [t for t, _ in spelled(".") if not t.startswith(("-", "+", "("))]
    df = column(spark, [f"{mark}{t}" for t in plain for mark in "$€£"])
    assert results(df, cells.written_number(F.col("v"), ".")) == [float(t.replace(",", "")) for t in plain for _ in range(3)]
    powers = [f"{a}e{b}" for a in (3, 4.25) for b in (-2, 0, 6)]
    assert results(column(spark, powers), cells.written_number(F.col("v"), ".")) == [float(p) for p in powers]


@pytest.mark.parametrize("point", [".", ","])
def test_what_is_no_number(spark, point):
    mark = "," if point == "." else "."
    broken = [f"40{mark}71", f"9{mark}63{mark}004", f"63004{mark}9", f"8{point}2{point}1", "seven", "7 seven", "", "   ", "+-8", "€", "8e999", f"8{point}2{mark}100"]
    assert results(column(spark, broken), cells.written_number(F.col("v"), point)) == [None] * len(broken)


def test_written_integers_are_exact(spark):
    large = [2 ** 53 + 1, 2 ** 62 + 3, 10 ** 18 + 7]
    texts = [*map(str, large), *(f"{n:,}" for n in large), *(f"({n})" for n in large), "41.0", "41.5", "forty-one"]
    assert results(column(spark, texts), cells.written_integer(F.col("v"))) == [*large, *large, *(-n for n in large), 41, None, None]


# ---- dates: every spelling of a few days, as datetime reads it --------------------------------------------------------
DAYS = [dt.datetime(1987, 11, 23), dt.datetime(2031, 7, 9), dt.datetime(2020, 2, 29, 18, 45, 7)]


@pytest.mark.parametrize("order,form", [("MDY", "{m}{s}{d}{s}{y}"), ("DMY", "{d}{s}{m}{s}{y}"), ("YMD", "{y}{s}{m}{s}{d}")])
def test_numeric_dates(spark, order, form):
    texts, want = [], []
    for day, mark, wide in itertools.product(DAYS, "/-.", (True, False)):
        pad = "02d" if wide else "d"
        text = form.format(y=day.year, m=format(day.month, pad), d=format(day.day, pad), s=mark)
        texts += [text] + ([f"{text} {day:%H:%M:%S}", f"{text}T{day:%H:%M}"] if day.hour else [])
        midnight = day.replace(hour=0, minute=0, second=0)
        want += [midnight] + ([day, day.replace(second=0)] if day.hour else [])
    year_first = [f"{d:%Y-%m-%d}" for d in DAYS]                                            # always year, month, day
    df = column(spark, texts + year_first)
    assert results(df, cells.written_date(F.col("v"), T.StringType(), order)) == want + [d.replace(hour=0, minute=0, second=0) for d in DAYS]


def test_short_years_and_month_names(spark):
    read = lambda texts, order="MDY": results(column(spark, texts), cells.written_date(F.col("v"), T.StringType(), order))          # noqa: E731
    years = ["07/09/31", "07/09/69", "07/09/68", "07/09/00"]
    assert read(years) == [dt.datetime.strptime(t, "%m/%d/%y") for t in years]
    for form, style in (("%d %b %Y", 0), ("%d %B %Y", 0), ("%B %d, %Y", 0), ("%b %d, %Y", 0), ("%d-%b-%y", 0)):
        days = [d.replace(hour=0, minute=0, second=0) for d in DAYS if "%y" not in form or d.year >= 1969]
        assert read([d.strftime(form) for d in days]) == days, form
    assert read(["9 July 31", "31/04/2031", "2031-02-29", "29.02.2031", "a day", "", "07/2031"], "DMY") == [None] * 7
    assert read(["23/11/1987"], "MDY") == [None]


@pytest.mark.parametrize("values,expected", [
    (["23/11/1987", "04/05/2031"], "DMY"), (["11/23/1987", "04/05/2031"], "MDY"), (["1987-11-23", "9 Jul 2031"], None),
    (["08/08/2031"], None), ([None, "someday"], None), (["23/11/1987", "11/23/1987"], "error"), (["04/05/2031", "1987-11-23"], "error")])
def test_date_order(spark, values, expected):
    df = column(spark, values)
    if expected == "error":
        with pytest.raises(cells.TableError):
            cells.date_order(df, "v")
    else:
        assert cells.date_order(df, "v") == expected


# ---- text of cells --------------------------------------------------------------------------------------------------
FLOATS = [s * m * 10.0 ** e for s in (1, -1) for m in (1, 2.5, 1.0625) for e in (-12, -6, -4, -1, 0, 3, 9, 15, 17)]


def test_canonical_text(spark):
    df = column(spark, [*FLOATS, float("nan"), None], "double")
    assert results(df, cells.canonical_text(F.col("v"), T.DoubleType())) == [str(int(v)) if v == int(v) else repr(v) for v in FLOATS] + [None, None]
    df = column(spark, [dt.datetime(2031, 7, 9), dt.datetime(2031, 7, 9, 10, 11, 12), dt.datetime(2031, 7, 9, 10, 11, 12, 34)], "timestamp")
    assert results(df, cells.canonical_text(F.col("v"), T.TimestampType())) == ["2031-07-09", "2031-07-09 10:11:12", "2031-07-09 10:11:12.000034"]
    df = column(spark, [False, None, True], "boolean")
    assert results(df, cells.canonical_text(F.col("v"), T.BooleanType())) == ["False", None, "True"]


def test_text_in_formulas_reads_like_python(spark):
    extra = [0.0, 123456.789, 1e15, 1e16, 0.0001, 0.00001, math.inf, -math.inf]
    assert results(column(spark, FLOATS + extra, "double"), f.CONCAT(F.col("v"), "!")) == [f"{v!r}!" for v in FLOATS + extra]
    assert results(column(spark, [True, False, None], "boolean"), f.CONCAT(F.col("v"))) == ["True", "False", ""]
    assert results(column(spark, [12, None], "bigint"), f.CONCAT(F.col("v"), 1.5, True)) == ["121.5True", "1.5True"]


def test_blanks_and_plain_numbers(spark):
    df = column(spark, [None, "", "\t \n", "0"])
    assert results(df, cells.is_blank(F.col("v"), T.StringType())) == [True, True, True, False]
    assert results(df, cells.is_missing(F.col("v"), T.StringType())) == [True, False, False, False]
    df = column(spark, ["  41", "-0.5 ", "6e2", "41d", "0.5F", "NaN", "forty", None])
    assert results(df, cells.plain_number(F.col("v"), T.StringType())) == [41, -0.5, 600, None, None, None, None, None]


# ---- formulas: the expression and what Python makes of the same cells ---------------------------------------------------
ROWS = [("river delta", 12, 0.75), (" Cove", -7, None), (None, 40, -2.5)]
SPOKEN = lambda t: t or ""                                                                  # noqa: E731
FORMULAS = {
    "sum": (lambda t, n, x: f.ADD(n, 5), lambda t, n, x: n + 5.0), "difference": (lambda t, n, x: f.SUBTRACT(n, x), lambda t, n, x: None if x is None else n - x),
    "product": (lambda t, n, x: f.MULTIPLY(n, n), lambda t, n, x: float(n * n)), "quotient": (lambda t, n, x: f.DIVIDE(n, 8), lambda t, n, x: n / 8),
    "floor division": (lambda t, n, x: f.FLOORDIV(n, 5), lambda t, n, x: float(n // 5)), "remainder": (lambda t, n, x: f.MOD(n, 5), lambda t, n, x: float(n % 5)),
    "negative divisor": (lambda t, n, x: f.MOD(n, -9), lambda t, n, x: float(n % -9)), "power": (lambda t, n, x: f.POWER(n, 3), lambda t, n, x: float(n ** 3)),
    "absolute": (lambda t, n, x: f.ABS(n), lambda t, n, x: float(abs(n))), "ceiling": (lambda t, n, x: f.CEILING(x), lambda t, n, x: None if x is None else float(math.ceil(x))),
    "floor": (lambda t, n, x: f.FLOOR(x), lambda t, n, x: None if x is None else float(math.floor(x))),
    "equal": (lambda t, n, x: f.EQ(x, 0.75), lambda t, n, x: x == 0.75), "unequal": (lambda t, n, x: f.NE(x, 0.75), lambda t, n, x: x != 0.75),
    "less": (lambda t, n, x: f.LT(n, 12), lambda t, n, x: n < 12), "at least": (lambda t, n, x: f.GE(n, 12), lambda t, n, x: n >= 12),
    "either": (lambda t, n, x: f.LE(n, -7) | f.GT(n, 12), lambda t, n, x: n <= -7 or n > 12), "between": (lambda t, n, x: f.BETWEEN(0, n, 40), lambda t, n, x: 0 < n < 40),
    "upper": (lambda t, n, x: f.UPPER(t), lambda t, n, x: SPOKEN(t).upper()), "lower": (lambda t, n, x: f.LOWER(t), lambda t, n, x: SPOKEN(t).lower()),
    "trim": (lambda t, n, x: f.TRIM(t), lambda t, n, x: SPOKEN(t).strip()), "length": (lambda t, n, x: f.LEN(t), lambda t, n, x: len(SPOKEN(t))),
    "replace": (lambda t, n, x: f.REPLACE(t, "e", "3"), lambda t, n, x: SPOKEN(t).replace("e", "3")), "join": (lambda t, n, x: f.CONCAT(t, "/", n), lambda t, n, x: f"{SPOKEN(t)}/{n}"),
    "repeat": (lambda t, n, x: f.REPEAT(t, 3), lambda t, n, x: SPOKEN(t) * 3), "missing": (lambda t, n, x: f.ISNULL(x), lambda t, n, x: x is None),
    "first there": (lambda t, n, x: f.COALESCE(x, 9.0), lambda t, n, x: 9.0 if x is None else x), "choice": (lambda t, n, x: f.IF(x > 0, "up", "down"), lambda t, n, x: "up" if x and x > 0 else "down"),
    **{f"left {k}": ((lambda k: lambda t, n, x: f.LEFT(t, k))(k), (lambda k: lambda t, n, x: SPOKEN(t)[:max(k, 0)])(k)) for k in (-2, 0, 4, 50)},
    **{f"right {k}": ((lambda k: lambda t, n, x: f.RIGHT(t, k))(k), (lambda k: lambda t, n, x: SPOKEN(t)[-k:] if k > 0 else "")(k)) for k in (0, 4, 50)},
}


def test_formulas(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, t string, n long, x double").orderBy("i")
    got = df.select(*[make(F.col("t"), F.col("n"), F.col("x")).alias(name) for name, (make, _) in FORMULAS.items()]).collect()
    for name, (_, python) in FORMULAS.items():
        assert [r[name] for r in got] == [python(*r) for r in ROWS], name


def test_formulas_on_text_cells(spark):
    df = column(spark, ["20", "-1.5", "x", "", None])
    numbers = [20.0, -1.5, None, None, None]
    for make, python in ((lambda v: f.ADD(v, 1), lambda v: v + 1), (lambda v: f.MULTIPLY(v, v), lambda v: v * v), (lambda v: f.POWER(v, 2), lambda v: v ** 2),
                         (lambda v: f.ROUND(v, 0), lambda v: float(math.copysign(math.floor(abs(v) + 0.5), v))), (lambda v: f.ABS(v), abs)):
        assert results(df, make(F.col("v"))) == [None if v is None else python(v) for v in numbers]


def test_parts_of_written_dates(spark):
    day = dt.date(2031, 7, 9)
    texts = [day.isoformat(), f"{day:%Y%m%d}", f"{day:%m/%d/%Y}", f"{day:%d %b %Y}", f"{day:%B %d, %Y}", f"{day} 10:11:12", "20311309", "2031", "soon", None]
    got = [results(column(spark, texts), part(F.col("v"))) for part in (f.YEAR, f.MONTH, f.DAY)]
    assert got == [[n] * 6 + [None] * 4 for n in (2031, 7, 9)]
    assert results(column(spark, ["09/07/2031"]), f.MONTH(F.col("v"), "DMY")) == [7]


def test_rounding_on_the_written_decimal(spark):
    values = [0.145, 8.575, 6.5, -6.5]
    assert results(column(spark, values, "double"), f.ROUND(F.col("v"), 2)) == [0.15, 8.58, 6.5, -6.5]
    assert results(column(spark, values, "double"), f.ROUND(F.col("v"))) == [0, 9, 7, -7]
    assert results(column(spark, [35, 44], "bigint"), f.ROUND(F.col("v"), -1)) == [40, 40]


def test_today_and_refusals(spark):
    assert dt.date.fromisoformat(spark.range(1).select(f.TODAY()).first()[0])
    for bad in (lambda: f.DIVIDE(F.lit(4), 0), lambda: f.MOD(F.lit(4), 0), lambda: f.FLOORDIV(F.lit(4), 0), lambda: f.ROUND(F.lit(4), -16), lambda: f.POWER(F.lit(4), 10.5),
                lambda: f.REPEAT("no", -1001)):
        with pytest.raises(cells.TableError):
            bad()
    assert spark.range(1).select(f.POWER(F.lit(2), 12, most=12), F.length(f.REPEAT("ab", 2000, most=2000))).first()[:] == (4096.0, 4000)
