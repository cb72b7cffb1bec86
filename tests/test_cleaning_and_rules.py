"""Filters, column operations, text, conversion, filling, validation and sorting."""
import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions import patterns
from gridloom.functions.cells import TableError
from gridloom.operators import cleaning, columns, fill, filters, sorting, types, validate


def values(df, column, order="i"):
    return [r[0] for r in df.orderBy(order).select(F.col(f"`{column}`")).collect()]


# ---- filters --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(0, "Alpha", "1", 5.0), (1, "beta", "10", 7.5), (2, None, "abc", None), (3, "  ", " 3 ", 5.0), (4, "ALPHABET", None, -1.0)],
                                 "i int, t string, n string, d double")


@pytest.mark.parametrize("condition,want", [
    (("t", "equals", "ALPHA"), [0]), (("t", "not_equals", "alpha"), [1, 2, 3, 4]), (("t", "contains", "lph"), [0, 4]),
    (("t", "not_contains", "lph"), [1, 2, 3]), (("t", "starts_with", "alpha"), [0, 4]), (("t", "ends_with", "A"), [0, 1]),
    (("n", "greater_than", "2"), [1, 3]), (("n", "less_equal", 3), [0, 3]), (("n", "less_than", 3), [0]), (("n", "greater_equal", "3"), [1, 3]),
    (("t", "is_empty", ""), [2, 3]), (("t", "is_not_empty", ""), [0, 1, 4]), (("t", "in_list", "beta, alpha"), [0, 1]),
    (("d", "equals", "5"), [0, 3]), (("d", "is_empty", ""), [2]), (("d", "greater_than", 5), [1])])
def test_conditions(mixed, condition, want):
    column, test, value = condition
    assert values(filters.row_filter(mixed, [{"column": column, "operator": test, "value": value}]), "i") == want


def test_and_binds_tighter_than_or(spark, mixed):
    cases = list(itertools.product("yn", repeat=4))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string, d string")
    test = lambda name, **logic: {"column": name, "operator": "equals", "value": "y", **logic}                             # noqa: E731
    y = [[v == "y" for v in c] for c in cases]
    for logics, truth in (((None, "OR", "AND", "AND"), lambda a, b, c, d: a or b and c and d), ((None, "AND", "OR", "AND"), lambda a, b, c, d: a and b or c and d),
                          ((None, "OR", None, "AND"), lambda a, b, c, d: a or b or c and d), ((None, None, None, "OR"), lambda a, b, c, d: a and b and c or d)):
        rules = [test(n, **({"logic": x} if x else {})) for n, x in zip("abcd", logics)]
        assert values(filters.row_filter(df, rules), "i") == [i for i, v in enumerate(y) if truth(*v)]
    for bad in ([], [{"column": "x", "operator": "equals"}], [{"column": "t", "operator": "like"}], [{"column": "n", "operator": "less_than", "value": "x"}]):
        with pytest.raises(TableError):
            filters.row_filter(mixed, bad)


# ---- columns --------------------------------------------------------------------------------------------------------
def test_column_operations(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, `c d` double")
    assert columns.reorder_columns(df, ["c d", "a", "a"]).columns == ["c d", "a", "b"]
    swapped = columns.rename_columns(df, {"a": "b", "b": "a"})
    assert swapped.columns == ["b", "a", "c d"] and swapped.first()["a"] == "x"
    assert columns.delete_columns(df, ["b"]).columns == ["a", "c d"]
    assert columns.duplicate_column(df, "a", "a2").columns == ["a", "a2", "b", "c d"]
    for bad in (lambda: columns.rename_columns(df, {"a": " "}), lambda: columns.rename_columns(df, {"a": "b"}), lambda: columns.delete_columns(df, ["z"]),
                lambda: columns.duplicate_column(df, "a", "b"), lambda: columns.calculated_column(df, "a", F.lit(1)), lambda: columns.merge_columns(df, ["a"], "", "z")):
        with pytest.raises(TableError):
            bad()
    assert columns.calculated_column(df, "n", "a + 1").first()["n"] == 2
    texts = spark.createDataFrame([("6", "x"), ("0.5", "7")], "a string, b string")
    doubled = columns.calculated_column(texts, "n", "a * 2", infer=True)
    assert dict(doubled.dtypes) == {"a": "string", "b": "string", "n": "double"} and sorted(r.n for r in doubled.collect()) == [1.0, 12.0]


def test_split_and_merge(spark):
    df = spark.createDataFrame([(0, "a.b.c", 5.0), (1, "x", None), (2, None, 2.5), (3, "", 1.0)], "i int, v string, n double")
    out = columns.split_column(df, "v", ".", ["one"])
    assert out.columns == ["i", "one", "v_part2", "v_part3", "n"]
    assert [tuple(r)[1:4] for r in out.orderBy("i").collect()] == [("a", "b", "c"), ("x", None, None), (None, None, None), ("", None, None)]
    assert columns.split_column(df, "v", ".", parts=1).columns == ["i", "v_part1", "n"]
    merged = columns.merge_columns(df, ["v", "n"], "|", "all")
    assert merged.columns == ["i", "v", "n", "all"] and values(merged, "all") == ["a.b.c|5", "x|", "|2.5", "|1"]


def test_find_replace(spark):
    df = spark.createDataFrame([(0, "aXa a", 5.0), (1, "A\\1$", 15.0), (2, None, None), (3, "2024-05", 1.5)], "i int, v string, n double")
    result = columns.find_replace(df, "a", "\\1$", ["v"])
    assert values(result.df, "v") == ["\\1$X\\1$ \\1$", "\\1$\\1$", None, "2024-05"] and tuple(result.metrics.first()) == (4, 2)
    assert values(columns.find_replace(df, "a", "b", ["v"], case_sensitive=True).df, "v") == ["bXb b", "A\\1$", None, "2024-05"]
    swapped = columns.find_replace(df, r"(?P<y>\d+)-(\d+)", r"\2-\g<y>0", ["v"], use_regex=True)
    assert values(swapped.df, "v")[3] == "05-20240"
    whole = columns.find_replace(df, "5", "five", None, whole_cell=True)
    assert values(whole.df, "n") == ["five", "15", None, "1.5"] and tuple(whole.metrics.first()) == (1, 1)
    assert values(columns.find_replace(df, ".", "!", ["v"]).df, "v")[0] == "aXa a"
    for bad in (dict(find="(", replace="", use_regex=True), dict(find="", replace=""), dict(find="a" * 501, replace="", use_regex=True)):
        with pytest.raises(TableError):
            columns.find_replace(df, columns=["v"], **bad)


def test_pattern_dialect():
    assert patterns.pattern(r"(?P<a>x)(?P=a)\Z") == r"(?<a>x)\k<a>\z"
    assert patterns.replacement(r"\1\g<2>\g<n>\n\\$") == "$1$2${n}\n\\\\\\$"
    assert patterns.literal(r"a\Eb") == r"\Qa\E\\E\Qb\E"


# ---- text -----------------------------------------------------------------------------------------------------------
def test_text_cleaner(spark):
    texts = ["  Ann   O'neil  ", "zero​width", "Café  del Mar", " 1,234.50 ", "x-ray (2)", None, "tab\tand\nline", "ﬁn"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    tidy = cleaning.clean_text(df, ["v"])
    assert values(tidy.df, "v") == ["Ann O'neil", "zerowidth", "Café del Mar", " 1,234.50 ", "x-ray (2)", None, "tab and line", "ﬁn"]
    row = tidy.metrics.first()
    assert (row.cells_changed, row.nonprinting_changed, row.trim_changed, row.collapse_changed) == (4, 1, 1, 3)
    assert values(cleaning.clean_text(df, ["v"], ["trim"], "title").df, "v")[0] == "Ann   O'Neil"
    assert values(cleaning.clean_text(df, ["v"], [], "title").df, "v")[4] == "X-Ray (2)"
    assert values(cleaning.clean_text(df, ["v"], ["accents"]).df, "v")[2] == "Cafe  del Mar"
    assert values(cleaning.clean_text(df, ["v"], ["punctuation"], "upper").df, "v")[4] == "XRAY 2"
    assert values(cleaning.clean_text(df, ["v"], ["trim", "collapse"], "sentence").df, "v")[0] == "Ann o'neil"
    with pytest.raises(TableError):
        cleaning.clean_text(df, ["v"], [])


# ---- conversion -----------------------------------------------------------------------------------------------------
def test_normalize_types(spark):
    df = spark.createDataFrame([(0, "1.234,56", "50%", "yes", "13/02/2024"), (1, "2,5", "0,5", "0", "01/03/2024"), (2, "x", "y%", "maybe", "31/02/2024"), (3, None, None, None, None)],
                               "i int, n string, p string, b string, d string")
    result = types.normalize_types(df, {"n": "currency", "p": "percentage", "b": "boolean", "d": "date"}, point=",")
    assert values(result.df, "n") == [1234.56, 2.5, None, None] and values(result.df, "n_original")[2] == "x"
    assert values(result.df, "n_failed") == [False, False, True, False]
    assert values(result.df, "p") == [0.5, 0.5, None, None] and values(result.df, "b") == [True, False, None, None]
    assert values(result.df, "d") == [dt.datetime(2024, 2, 13), dt.datetime(2024, 3, 1), None, None]
    assert {r.column: (r.converted, r.failed, r.example) for r in result.metrics.collect()} == {
        "n": (2, 1, "x"), "p": (2, 1, "y%"), "b": (2, 1, "maybe"), "d": (2, 1, "31/02/2024")}
    whole = types.normalize_types(df, {"n": "integer", "b": "text"}, keep_original=False)
    assert whole.df.columns == ["i", "n", "n_failed", "p", "b", "b_failed", "d"]
    with pytest.raises(TableError):
        types.normalize_types(df, {"n": "colour"})


# ---- fill -----------------------------------------------------------------------------------------------------------
def test_fill(spark):
    df = spark.createDataFrame([(0, None, "1", None), (1, "a", " ", 2.0), (2, " ", "4", None), (3, "b", None, 5.0), (4, "b", "10", 2.0)], "i int, t string, n string, d double")
    assert values(fill.fill_missing(df, ["t"], "previous", order_by=["i"]).df, "t") == [None, "a", "a", "b", "b"]
    assert values(fill.fill_missing(df, ["t"], "next", order_by=["i"]).df, "t") == ["a", "a", "b", "b", "b"]
    assert values(fill.fill_missing(df, ["n"], "mean").df, "n") == ["1", "5", "4", "5", "10"]
    assert values(fill.fill_missing(df, ["n", "d"], "median").df, "d") == [2.0, 2.0, 2.0, 5.0, 2.0]
    assert values(fill.fill_missing(df, ["t"], "mode", order_by=["i"]).df, "t") == ["b", "a", "b", "b", "b"]
    assert values(fill.fill_missing(df, ["d"], "mode", order_by=["i"]).df, "d") == [2.0, 2.0, 2.0, 5.0, 2.0]
    result = fill.fill_missing(df, ["t", "d"], "constant", "7", flag=True)
    assert values(result.df, "d") == [7.0, 2.0, 7.0, 5.0, 2.0] and values(result.df, "filled_columns") == ["t, d", None, "t, d", None, None]
    row = result.metrics.first()
    assert (row.blank_cells, row.cells_filled, row.filled_t, row.filled_d) == (4, 4, 2, 2)
    dropped = fill.drop_blank_rows(df, ["t", "n"])
    assert values(dropped.df, "i") == [4] and values(dropped.side("removed"), "i") == [0, 1, 2, 3]
    for bad in (lambda: fill.fill_missing(df, ["t"], "mean"), lambda: fill.fill_missing(df, ["t"], "constant", ""), lambda: fill.fill_missing(df, ["t"], "previous")):
        with pytest.raises(TableError):
            bad()


# ---- validation -----------------------------------------------------------------------------------------------------
def test_validation_against_plain_python(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["", " ", None, "7", "12.5", "abc", "-3"]), rng.choice(["red", "green", "Blue", None]), rng.choice(["AB-12", "ab-12", "AB-1", "", "AB-12\n"])) for i in range(200)]
    df = spark.createDataFrame(data, "i int, a string, b string, c string")
    rules = [{"column": "a", "type": "required"}, {"column": "a", "type": "range", "value": {"min": "0", "max": 10}}, {"column": "b", "type": "list", "value": ["red", "green"]},
             {"column": "c", "type": "pattern", "value": r"[A-Z]{2}-\d{2}"}, {"column": "c", "type": "length", "value": {"min": 5, "max": ""}}, {"column": "a", "type": "numeric"},
             {"column": "zzz", "type": "required"}, {"column": "a", "type": "unheard"}]

    def broken(a, b, c):
        out = []
        blank = lambda x: x is None or not x.strip()
        number = lambda x: float(x) if re.fullmatch(r"-?\d+(\.\d+)?", x) else None
        if blank(a):
            out.append("a: a value is needed")
        elif number(a) is None:
            out.append(f'a: "{a}" is no number, so it lies in no range')
        elif number(a) < 0:
            out.append(f"a: {a} is less than 0")
        elif number(a) > 10:
            out.append(f"a: {a} is more than 10")
        if not blank(b) and b not in ("red", "green"):
            out.append(f'b: "{b}" is none of the values listed')
        if not blank(c) and not re.fullmatch(r"[A-Z]{2}-\d{2}", c):
            out.append(f'c: "{c}" does not fit the pattern')
        if not blank(c) and len(c) < 5:
            out.append(f"c: {len(c)} characters are too few or too many")
        if not blank(a) and number(a) is None:
            out.append(f'a: "{a}" is no number')
        return out
    want = {r[0]: broken(*r[1:]) for r in data}
    result = validate.validate(df, rules, row_numbers=True, order_by=["i"])
    assert {r.i: r.errors for r in result.df.collect()} == want
    assert {r.i + 2 == r.row_number for r in result.side("invalid").collect()} == {True}
    bad = sum(bool(e) for e in want.values())
    assert result.side("valid").count() == 200 - bad
    assert tuple(result.metrics.first()) == (200, 200 - bad, bad, round(bad / 2, 2), sum(map(len, want.values())))
    with pytest.raises(TableError):
        validate.validate(df, [{"column": "a", "type": "range", "value": {"min": "low"}}])


# ---- sorting --------------------------------------------------------------------------------------------------------
def test_sort_rank_and_samples(spark):
    df = spark.createDataFrame([(0, "10", "b"), (1, "9", "A"), (2, None, "a"), (3, "9", None), (4, "-1", "B")], "i int, n string, t string")
    assert [r.i for r in sorting.sort_rows(df, ["n"], ["i"]).collect()] == [4, 1, 3, 0, 2]
    assert [r.i for r in sorting.sort_rows(df, [("n", "descending")], ["i"]).collect()] == [0, 1, 3, 4, 2]
    assert [r.i for r in sorting.sort_rows(df, ["t", ("n", "descending")], ["i"]).collect()] == [1, 2, 0, 4, 3]
    assert {r.i: r.rank for r in sorting.rank_rows(df, ["n"], within="t", order_by=["i"]).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1}
    assert [r.i for r in sorting.last_n(df, 2, ["i"]).collect()] == [3, 4]
    assert [r.i for r in sorting.last_n(df, 2, ["i"], ["n"]).collect()] == [0, 2]
    assert [r.i for r in sorting.every_nth(df, 2, ["i"]).orderBy("i").collect()] == [0, 2, 4]
    one, two = ([r.i for r in sorting.sample_n(df, 3, 9, ["i"]).collect()] for _ in range(2))
    assert one == two == sorted(one) and len(one) == 3 and sorting.sample_n(df, 99, 9, ["i"]).count() == 5
    assert {r.t: r.group_number for r in sorting.group_numbers(df, ["t"], order_by=["i"]).collect()} == {"b": 1, "A": 2, "a": 3, None: 4, "B": 5}
    for bad in (lambda: sorting.first_n(df, 0, ["i"]), lambda: sorting.sort_rows(df, ["n", "n"], ["i"]), lambda: sorting.rank_rows(df, [], order_by=["i"])):
        with pytest.raises(TableError):
            bad()
