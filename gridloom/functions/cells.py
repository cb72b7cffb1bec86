"""Cell-level expressions shared by every operator: names, blanks, text forms, numbers and dates.

Everything here builds a `Column`; nothing runs a job. A cell's Spark type is known from the schema, so each helper
takes the type next to the column and picks the expression for it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters that count as white space, the no-break and wide spaces included.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\s\x1c-\x1f"              # the same inside a character class of a (?U) pattern

# Month names as they appear in written dates.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]


class TableError(ValueError):
    """Something the caller can fix: an unknown column, a missing choice, a column of the wrong kind."""


# ---- names ----------------------------------------------------------------------------------------------------------
def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def free_name(wanted: str, taken) -> str:
    """`wanted` with underscores added until no column in `taken` has that name."""
    taken = set(taken)
    while wanted in taken:
        wanted += "_"
    return wanted


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require_columns(df: DataFrame, names, where: str = "the table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise TableError(f"not in {where}: {', '.join(missing)}")


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


# ---- the three kinds of blank ---------------------------------------------------------------------------------------
def is_missing(c: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN in a floating column."""
    return c.isNull() | F.isnan(c) if is_float(dtype) else c.isNull()


def is_blank(c: Column, dtype: T.DataType) -> Column:
    """Missing, or text that holds nothing but white space."""
    if is_text(dtype):
        return c.isNull() | (strip(c) == "")
    return is_missing(c, dtype)


def present(c: Column, dtype: T.DataType) -> Column:
    """The cell, with missing values (NaN included) as NULL."""
    return F.when(~F.isnan(c), c) if is_float(dtype) else c


def filled(c: Column, dtype: T.DataType) -> Column:
    """The cell, with blanks as NULL."""
    if is_text(dtype):
        return F.when(strip(c) != "", c)
    return present(c, dtype)


# ---- text forms -----------------------------------------------------------------------------------------------------
def _double_text(c: Column) -> Column:
    """Whole numbers without a fraction, other doubles in their shortest decimal form (0.0005, 1e-05)."""
    plain = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E-([0-9]+)$", 1)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    small = F.when(exponent == "4", F.concat(sign, F.lit("0.000"), F.regexp_replace(mantissa, r"\.", ""))) \
        .otherwise(F.concat(sign, mantissa, F.lit("e-"), F.lpad(exponent, 2, "0")))
    whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
    # a fraction beside eight or more whole digits has at most nine decimals
    large = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.when(whole, c.cast("decimal(38,0)").cast("string")) \
        .when(plain.contains("E-"), small).when(plain.contains("E") & (F.abs(c) < 1e18), large).otherwise(plain)


def canonical_text(c: Column, dtype: T.DataType) -> Column:
    """The text a cell is compared by: 5.0 reads '5', a date at midnight has no clock, True/False are capitalised."""
    if is_text(dtype):
        return c
    if is_float(dtype):
        return _double_text(present(c.cast("double"), T.DoubleType()))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        day = F.date_format(c, "yyyy-MM-dd")
        clock = F.date_format(c, "HH:mm:ss.SSSSSS")
        return F.when(clock == "00:00:00.000000", day) \
            .otherwise(F.concat_ws(" ", day, F.regexp_replace(clock, r"\.000000$", "")))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    return canonical_text(col(name), type_of(df, name))


def strip(c: Column) -> Column:
    """Without white space at the ends, any Unicode space included."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, f"(?U)[{SPACE}]+", " ")


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What full case folding changes in lower-case text: one character for another, and one for several. From Unicode's own table."""
    folds = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c and c.lower() == c}
    return {c: f for c, f in folds.items() if len(f) == 1}, {c: f for c, f in folds.items() if len(f) > 1}


def folded(c: Column) -> Column:
    """Text without differences of case: `STRASSE` and `straße` are alike. Only text that holds such characters is looked through for them."""
    single, several = _foldings()
    lower = F.lower(c)
    lower = F.when(lower.rlike("[^\\x00-\\x7F]"), F.translate(lower, "".join(single), "".join(single.values()))).otherwise(lower)
    spelled = lower
    for letter, letters in several.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(letters))
    return F.when(lower.rlike(f"[{''.join(several)}]"), spelled).otherwise(lower)


def loose_text(c: Column, dtype: T.DataType) -> Column:
    """Text for a comparison that ignores case and spacing; other types compare by their canonical text."""
    if not is_text(dtype):
        return F.coalesce(canonical_text(c, dtype), F.lit(""))
    return folded(collapse(strip(F.coalesce(c, F.lit("")))))


# ---- numbers --------------------------------------------------------------------------------------------------------
# What a cast reads as a double, but for `nan` and Java's '1d' and '1f'. Asking first is many times faster than a cast that fails.
_PLAIN_NUMBER = r"(?i)^[\x00-\x20]*[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|0x[0-9a-f.]+p[+-]?[0-9]+)[\x00-\x20]*$"


def plain_number(c: Column, dtype: T.DataType) -> Column:
    """The cell as a double, NULL where it is not a number."""
    if is_number(dtype):
        return present(c.cast("double"), T.DoubleType())
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if not is_text(dtype):
        return F.lit(None).cast("double")
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    return plain_number(col(name), type_of(df, name))


def _number_pattern(point: str, whole_only: bool = False) -> str:
    grouping, mark = (r"[.\u00a0 ']", ",") if point == "," else (r"[,\u00a0 ']", r"\.")
    whole = rf"(?:[0-9]{{1,3}}(?:{grouping}[0-9]{{3}})+|[0-9]+)"
    core = rf"[+-]?(?:{whole}(?:{mark}[0-9]+)?|{mark}[0-9]+)(?:[eE][+-]?[0-9]+)?"
    padded = rf"[\u00a0 $€£¥]*{rf'[+-]?{whole}' if whole_only else core}[\u00a0 $€£¥]*"
    return rf"^[\s\u00a0]*(?:\({padded}\)|{padded})[\s\u00a0]*$"


def _bare_number(text: Column, point: str) -> Column:
    """Without grouping, currency and brackets, and with a decimal point: what a cast reads."""
    noise = "\u00a0 '$€£¥()\t\n\r"
    return F.translate(text, ",." + noise, ".") if point == "," else F.translate(text, "," + noise, "")


def written_number(text: Column, point: str = ".") -> Column:
    """A number as people write it: thousands in threes, a currency sign, brackets for negatives, an exponent.

    `point` is the decimal mark; NULL where the text is not a number in that notation. One pattern decides, so each
    cell is matched once."""
    value = F.when(text.rlike(_number_pattern(point)), _bare_number(text, point).try_cast("double"))
    value = F.when(F.abs(value) != float("inf"), value)
    return F.when(text.contains("("), -value).otherwise(value)


def written_integer(text: Column, point: str = ".") -> Column:
    """A whole number as people write it, exact to 64 bits; NULL for 3.7."""
    exact = F.when(text.rlike(_number_pattern(point, whole_only=True)), _bare_number(text, point).try_cast("bigint"))
    exact = F.when(text.contains("("), -exact).otherwise(exact)
    value = written_number(text, point)
    return F.coalesce(exact, F.when((value == F.floor(value)) & (F.abs(value) < 9.2e18), value.cast("bigint")))


# ---- dates ----------------------------------------------------------------------------------------------------------
CLOCK = r"(?:(?:\s+|T)([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?))?"
NUMERIC_DATE = rf"(?U)^\s*([0-9]{{1,4}})[/.\-]([0-9]{{1,2}})[/.\-]([0-9]{{1,4}}){CLOCK}\s*$"
YEAR_FIRST = r"(?U)^\s*[0-9]{4}[/.\-]"
DAY_MONTH_YEAR = r"(?U)^\s*([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4}|[0-9]{2})\s*$"
DAY_DASH_MONTH = r"(?U)^\s*([0-9]{1,2})-([A-Za-z]{3})-([0-9]{4}|[0-9]{2})\s*$"
MONTH_DAY_YEAR = r"(?U)^\s*([A-Za-z]+)\s+([0-9]{1,2}),?\s+([0-9]{4})\s*$"


def _timestamp(ymd: Column) -> Column:
    """'y-m-d [clock]' as a timestamp; years of one or two digits fall in 1969 to 2068. NULL for 30 February."""
    year = F.regexp_replace(ymd, "^0+(?=[0-9])", "")
    year = F.regexp_replace(year, "^([0-9])-", "200$1-")
    year = F.regexp_replace(year, "^([0-5][0-9]|6[0-8])-", "20$1-")
    year = F.regexp_replace(year, "^([67][0-9]|[89][0-9])-", "19$1-")
    year = F.regexp_replace(year, "^([0-9]{3})-", "0$1-")
    return F.when(ymd.rlike("^[1-9][0-9]{3}-"), ymd.try_cast("timestamp")).otherwise(year.try_cast("timestamp"))


def _named(text: Column, pattern: str, year: int, month: int, day: int, full_names: bool) -> Column:
    names = {m[:3]: i for i, m in enumerate(MONTHS, 1)} | ({m: i for i, m in enumerate(MONTHS, 1)} if full_names else {})
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in (pair[0], str(pair[1]))])
    part = [F.regexp_extract(text, pattern, i) for i in (year, month, day)]
    return _timestamp(F.concat(part[0], F.lit("-"), F.try_element_at(table, F.lower(part[1])), F.lit("-"), part[2]))


def _month_name_date(text: Column) -> Column:
    """'5 Mar 2024', '5-Mar-24', 'March 5, 2024'. With a two-digit year or dashes the month is abbreviated."""
    four_digits = text.rlike(r"(?U)[0-9]{4}\s*$")
    return F.when(text.rlike(DAY_MONTH_YEAR), F.when(four_digits, _named(text, DAY_MONTH_YEAR, 3, 2, 1, True))
                  .otherwise(_named(text, DAY_MONTH_YEAR, 3, 2, 1, False))) \
        .when(text.rlike(DAY_DASH_MONTH), _named(text, DAY_DASH_MONTH, 3, 2, 1, False)) \
        .when(text.rlike(MONTH_DAY_YEAR), _named(text, MONTH_DAY_YEAR, 3, 1, 2, True))


def written_date(c: Column, dtype: T.DataType, order: str) -> Column:
    """A timestamp from a written date; `order` (MDY, DMY or YMD) settles 03/04/2024. NULL where it is no date."""
    if isinstance(dtype, T.TimestampType):
        return c
    if is_time(dtype):
        return c.cast("timestamp")
    if not is_text(dtype):
        return F.lit(None).cast("timestamp")
    places = {"DMY": "$3-$2-$1 $4", "MDY": "$3-$1-$2 $4", "YMD": "$1-$2-$3 $4"}
    if order not in places:
        raise TableError(f"the date order is MDY, DMY or YMD, not {order!r}")
    year_first = _timestamp(F.regexp_replace(c, NUMERIC_DATE, places["YMD"]))
    numeric = F.when(c.rlike(YEAR_FIRST), year_first).otherwise(_timestamp(F.regexp_replace(c, NUMERIC_DATE, places[order])))
    return F.when(c.rlike(NUMERIC_DATE), numeric).otherwise(_month_name_date(c))


def date_order(df: DataFrame, name: str) -> str | None:
    """DMY or MDY as the column's own values settle it, None when nothing needs settling. One aggregate.

    Raises when day-first and month-first dates are mixed, or when every date could be read both ways."""
    if not is_text(type_of(df, name)):
        return None
    text = col(name)
    asks = text.rlike(NUMERIC_DATE) & ~text.rlike(YEAR_FIRST)
    first = F.when(asks, F.regexp_extract(text, NUMERIC_DATE, 1).try_cast("int"))
    second = F.when(asks, F.regexp_extract(text, NUMERIC_DATE, 2).try_cast("int"))
    unsure = (first <= 12) & (second <= 12) & (first != second)
    seen = df.agg(F.count_if((first > 12) & (second <= 12)).alias("day_first"),
                  F.count_if((second > 12) & (first <= 12)).alias("month_first"),
                  F.min(F.when(unsure, text)).alias("example")).first()
    if seen.day_first and seen.month_first:
        raise TableError(f"column {name!r} mixes day-first and month-first dates")
    if seen.day_first:
        return "DMY"
    if seen.month_first:
        return "MDY"
    if seen.example is not None:
        raise TableError(f"column {name!r}: the date order is ambiguous (for example {seen.example}); give it")
    return None
