"""Joins, comparison, duplicates, grouping and pivots against brute force on small random tables."""
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import TableError
from gridloom.operators import compare, dedupe, group, joins, pivot, reshape


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


# ---- merge ----------------------------------------------------------------------------------------------------------
def brute_merge(left, right, how, duplicates):
    def first(rows):
        seen, out = set(), []
        for r in rows:
            if r[0] is None or r[0] not in seen:
                out.append(r)
            seen.add(r[0])
        return out
    if duplicates == "keep_first":
        left, right = first(left), first(right)
    pairs = [(a, b) for a in left for b in right if a[0] is not None and a[0] == b[0]]
    alone_left = [a for a in left if not any(x is a for x, _ in pairs)]
    alone_right = [b for b in right if not any(x is b for _, x in pairs)]
    if how == "left_only":
        return alone_left
    if how == "right_only":
        return alone_right
    out = [(a[0], a[1], b[1]) for a, b in pairs]
    out += [(a[0], a[1], None) for a in alone_left] if how in ("left", "outer") else []
    out += [(b[0], None, b[1]) for b in alone_right] if how in ("right", "outer") else []
    return out


@pytest.mark.parametrize("how", joins.JOINS)
@pytest.mark.parametrize("duplicates", ["keep_all", "keep_first"])
def test_merge_against_nested_loops(spark, how, duplicates):
    rng = random.Random(how + duplicates)
    left = [(rng.choice(["1", "2", "3", "x", None]), f"l{i:02d}") for i in range(rng.randint(4, 12))]
    right = [(rng.choice(["1", "2", "4", "x", None]), f"r{i:02d}") for i in range(rng.randint(4, 12))]
    a, b = spark.createDataFrame(left, "id string, lv string"), spark.createDataFrame(right, "id string, rv string")
    result = joins.merge_tables(a, b, "id", how=how, duplicates=duplicates, left_order=["lv"], right_order=["rv"])
    want = brute_merge(left, right, how, duplicates)
    assert collected(result.df) == sorted(want, key=str)
    stats = result.metrics.first()
    assert stats.merged_rows == len(want)
    inner = len(brute_merge(left, right, "inner", duplicates))
    if not how.endswith("_only"):
        assert stats.matched_rows == inner
    assert stats.unmatched_left == len(brute_merge(left, right, "left_only", duplicates))
    assert stats.unmatched_right == len(brute_merge(left, right, "right_only", duplicates))


def test_merge_key_rules(spark):
    numbers = spark.createDataFrame([(123, 1, "a"), (5, 2, "b")], "code long, year int, v string")
    texts = spark.createDataFrame([("123", 1, "c"), ("00123", 1, "d"), ("5", 9, "e")], "key string, year int, v string")
    merged = joins.merge_tables(numbers, texts, ["code", "year"], ["key", "year"], "inner", "keep_all", left_order=["code"], right_order=["key"]).df
    assert merged.columns == ["code", "year", "v_left", "key", "v_right"]
    assert collected(merged) == [(123, 1, "a", "123", "c")]
    with pytest.raises(TableError):
        joins.merge_tables(numbers, texts, ["code"], ["key", "year"])
    twice = spark.createDataFrame([(1, 1), (1, 2)], "k int, n int")
    with pytest.raises(TableError, match="repeat a key"):
        joins.merge_tables(twice, twice, "k", duplicates="error")
    stats = joins.merge_tables(twice.limit(1), twice, "k", duplicates="keep_all").metrics.first()
    assert stats.multiplication_factor == 2.0 and stats.rows_multiplied
    picked = joins.merge_tables(numbers, numbers, "code", left_columns=["v"], right_columns=["year"], left_order=["code"], right_order=["code"]).df
    assert picked.columns == ["code", "v", "year"]


# ---- compare --------------------------------------------------------------------------------------------------------
def brute_compare(a, b):
    def keyed(rows):
        seen, out = {}, {}
        for k1, k2, v in rows:
            if k1 is None and k2 is None:
                continue
            seen[k1, k2] = seen.get((k1, k2), 0) + 1
            out[k1, k2, seen[k1, k2]] = v
        return out
    x, y = keyed(a), keyed(b)
    return sorted([(*k, "removed" if k not in y else "added" if k not in x else "unchanged" if x[k] == y[k] else "changed") for k in set(x) | set(y)], key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode", ["window", "slices"])
def test_compare_against_brute_force(spark, seed, mode, request):
    if mode == "slices":
        request.getfixturevalue("sliced")
    rng = random.Random(seed)
    make = lambda: [(rng.choice(["1", "2", None]), rng.choice(["x", None]), rng.choice(["p", "q", None])) for _ in range(12)]
    a, b = make(), make()
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k1 string, k2 string, v string")
    result = compare.compare_tables(frame(a), frame(b), ["k1", "k2"], ["v"], ["i"], ["i"])
    assert collected(result.status()) == brute_compare(a, b)
    summary = {r.metric: r.value for r in result.summary().collect()}
    assert summary["total_rows_1"] == 12 and summary["total_rows_2"] == 12
    assert summary["keyless_1"] == sum(r[0] is None and r[1] is None for r in a) == result.rows_without_key().filter("file = 1").count()
    statuses = [s[3] for s in brute_compare(a, b)]
    assert [summary[s] for s in ("added", "removed", "changed", "unchanged")] == [statuses.count(s) for s in ("added", "removed", "changed", "unchanged")]


def test_compare_by_canonical_text(spark):
    a = spark.createDataFrame([(1, 5.0, None), (2, 1.5, "x")], "id long, n double, t string")
    b = spark.createDataFrame([("1", "5", None), ("2", "2.5", "x")], "id string, n string, t string")
    result = compare.compare_tables(a, b, ["id"], first_order=["id"], second_order=["id"])
    assert collected(result.status().select("id", "status")) == [("1", "unchanged"), ("2", "changed")]
    assert collected(result.changed_cells()) == [("2", 1, "n", "1.5", "2.5")]
    assert result.changed().columns == ["id", "n (Old)", "n (New)", "n", "t (Old)", "t (New)", "t"]


def test_compare_schemas_and_change_preview(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(1, 2.0)], "id long, price double")
    result = compare.compare_schemas(a, b)
    assert [tuple(r) for r in result.df.collect()] == [("id", "Yes", "Yes", "int", "bigint"), ("name", "Yes", "No", "string", None), ("price", "No", "Yes", None, "double")]
    assert tuple(result.metrics.first()) == (3, 2, 2, 1, 1, 1)
    before = spark.createDataFrame([(1, "a", "k"), (2, "b", None)], "id int, v string, w string")
    after = before.withColumn("v", F.upper("v")).withColumn("more", F.lit(1)).filter("true")
    change = compare.describe_change(before, after, ["id"])
    row = change.metrics.first()
    assert (row.rows_before, row.rows_after, row.cells_changed, row.rows_changed, row.columns_added, row.columns_removed) == (2, 2, 2, 2, ["more"], [])
    assert [(r.position.id, r.column, r.before, r.after) for r in change.df.collect()] == [(1, "v", "a", "A"), (2, "v", "b", "B")]
    assert compare.describe_change(before, before.limit(1), ["id"]).metrics.first().cells_changed is None


def test_reordered(spark, sliced):
    rows = [(i, f"v{i % 4}", None if i % 3 else "x") for i in range(30)]
    table = lambda data: spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(data)], "at int, v string, w string")        # noqa: E731
    first = table(rows)
    r = random.Random(5)
    mixed = r.sample(rows, len(rows))
    cells = ["v", "w"]
    assert compare.reordered(first, table(mixed), ["at"], columns=cells)
    assert not compare.reordered(first, first.repartition(5), ["at"], columns=cells)
    assert not compare.reordered(first, table(rows).withColumn("at", F.col("at") * 10), ["at"], columns=cells)                  # other positions, same order
    assert not compare.reordered(first, table([(0, "v9", "x"), *rows[1:]]), ["at"], columns=cells)                              # a cell changed
    assert not compare.reordered(first, table(rows + rows[:1]), ["at"], columns=cells)                                          # a repeat more
    assert compare.reordered(first, first, ["at"], after_order=["v", "at"]) and not compare.reordered(first, first, ["at"])
    assert not compare.reordered(table([]), table([]), ["at"])


def test_full_case_folding(spark):
    from gridloom.functions import cells
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, "x" + c + "y") for i, c in enumerate(letters)], "i int, t string")
    wrong = [letters[r.i] for r in df.select("i", cells.folded(F.col("t")).alias("f")).collect() if r.f != ("x" + letters[r.i] + "y").casefold() and letters[r.i].isprintable()]
    assert wrong == [], wrong[:20]
    out = dedupe.remove_duplicates(spark.createDataFrame([(1, "Straße"), (2, "STRASSE "), (3, "ﬁn"), (4, "FIN"), (5, "Σίσυφος"), (6, "ΣΊΣΥΦΟΣ"), (7, "strase")], "i int, t string"), ["t"],
                                   ignore_case_and_spaces=True, order_by=["i"])
    assert sorted(r.i for r in out.df.collect()) == [1, 3, 5, 7]


# ---- duplicates -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("mode", ["window", "slices"])
def test_duplicates_against_brute_force(spark, seed, mode, request):
    if mode == "slices":
        request.getfixturevalue("sliced")
    rng = random.Random(seed)
    data = [(i, rng.choice(["x", "x, y", "nan", "None", None, ""]), rng.choice(["1", "1", None])) for i in range(14)]
    df = spark.createDataFrame(data, "id int, a string, b string")
    groups = {}
    for i, a, b in data:
        groups.setdefault((a, b), []).append(i)
    want = {ids[0]: ids for ids in groups.values() if len(ids) > 1}
    found = dedupe.duplicate_groups(df, "id", ["a", "b"], order_by=["id"]).collect()
    assert {r.keep_id: r["count"] for r in found} == {k: len(v) for k, v in want.items()}
    lists = dedupe.duplicate_id_lists(df, "id", ["a", "b"], order_by=["id"], page_rows=2).collect()
    pages = {}
    for r in sorted(lists, key=lambda r: r.page):
        assert len(r.all_ids) <= 2
        pages.setdefault(r.keep_id, []).extend(r.all_ids)
    assert pages == want
    assert sorted(r.id for r in dedupe.ids_to_remove(df, "id", ["a", "b"], order_by=["id"]).collect()) == sorted(i for v in want.values() for i in v[1:])
    strict = dedupe.duplicate_groups(df, "id", ["a", "b"], blank_is_value=False, order_by=["id"]).collect()
    assert {r.keep_id for r in strict} == {v[0] for k, v in groups.items() if len(v) > 1 and None not in k}


@pytest.mark.parametrize("keep", dedupe.KEEP)
@pytest.mark.parametrize("mode", ["window", "slices"])
def test_remove_duplicates(spark, keep, mode, request):
    if mode == "slices":
        request.getfixturevalue("sliced")
    data = [(1, "Acme  Corp", None, 1.0), (2, "acme corp", "x", None), (3, " ACME CORP ", "x", 2.0), (4, "Beta", None, None), (5, "beta", "y", 1.0), (6, None, None, 1.0), (7, "", "z", 1.0)]
    df = spark.createDataFrame(data, "i int, name string, note string, n double")
    result = dedupe.remove_duplicates(df, ["name"], keep, ignore_case_and_spaces=True, order_by=["i"])
    want = {"first": [1, 4, 6], "last": [3, 5, 7], "most_complete": [3, 5, 7]}[keep]
    assert sorted(r.i for r in result.df.collect()) == want
    removed = result.side("removed")
    assert sorted(r.i for r in removed.collect()) == [i for i in range(1, 8) if i not in want] and removed.columns == df.columns
    assert tuple(result.metrics.first()) == (7, 3, 4, 3)


def test_whole_row_copies(spark, sliced):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), ("c", 2)], "k string, n int")
    assert dedupe.exact_copies(df).first()[0] == 2
    result = dedupe.remove_duplicates(df, order_by=["k"])
    assert result.df.count() == 3 and result.side("removed").count() == 2


# ---- group, pivot ---------------------------------------------------------------------------------------------------
DEPT = [("Sales", "ann", "10"), ("Sales", "Bob", " "), ("sales", "cy", "5"), (None, "dee", "7"), (" ", "eve", "1.5"), ("Sales", "bob", "30"), (None, None, None)]


@pytest.mark.parametrize("mode", ["window", "slices"])
def test_group_summary(spark, mode, request):
    if mode == "slices":
        request.getfixturevalue("sliced")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(DEPT)], "i int, dept string, who string, amount string")
    out = group.group_summary(df, ["dept"], ["amount"], group.FUNCTIONS, order_by=["i"], first_appearance=True)
    assert out.columns == ["dept", "rows"] + [f"amount_{f}" for f in group.FUNCTIONS]
    rows = [tuple(r) for r in out.collect()]
    assert rows == [("Sales", 3, 40.0, 20.0, 20.0, 10.0, 30.0, 2, 2, "10", "30"), ("sales", 1, 5.0, 5.0, 5.0, 5.0, 5.0, 1, 1, "5", "5"),
                    (None, 3, 8.5, 4.25, 4.25, 1.5, 7.0, 2, 2, "7", "1.5")]
    texts = group.group_summary(df, ["dept"], ["who"], ["min", "max", "count"], order_by=["i"], first_appearance=True)
    assert [tuple(r) for r in texts.collect()] == [("Sales", 3, "ann", "bob", 3), ("sales", 1, "cy", "cy", 1), (None, 3, "dee", "eve", 2)]
    with pytest.raises(TableError, match="not numbers"):
        group.group_summary(df, ["dept"], ["who"], ["sum"])
    assert group.group_summary(df.filter("dept is null"), ["dept"], ["amount"], ["sum"]).count() == 1


def brute_pivot(data, agg):
    """Totals from the source rows; text that is no number is ignored by everything but counts."""
    def value(rows):
        cells = [r[2] for r in rows if r[2] is not None]
        if agg == "count":
            return len(cells)
        if agg == "nunique":
            return len(set(cells))
        numbers = sorted(float(x) for x in cells if x not in ("abc",))
        if agg == "sum":
            return sum(numbers)
        if not numbers:
            return None
        if agg == "mean":
            return sum(numbers) / len(numbers)
        if agg == "std":
            mean = sum(numbers) / len(numbers)
            return (sum((x - mean) ** 2 for x in numbers) / (len(numbers) - 1)) ** 0.5 if len(numbers) > 1 else None
        if agg == "median":
            mid = len(numbers) // 2
            return numbers[mid] if len(numbers) % 2 else (numbers[mid - 1] + numbers[mid]) / 2
        return min(numbers) if agg == "min" else max(numbers)
    label = lambda x: "(blank)" if x is None else x
    heads = sorted({label(r[1]) for r in data}, key=lambda x: (x == "(blank)", x))
    empty = 0 if agg in ("sum", "count", "nunique") else None
    out = {}
    for g in [*{label(r[0]) for r in data}, "Total"]:
        mine = [r for r in data if g == "Total" or label(r[0]) == g]
        cells = [[r for r in mine if label(r[1]) == h] for h in heads]
        out[g] = [value(c) if c else empty for c in cells] + [value(mine)]
    return heads, out


@pytest.mark.parametrize("agg", pivot.AGGREGATIONS)
def test_pivot_against_brute_force(spark, agg):
    rng = random.Random(agg)
    data = [(rng.choice(["A", "B", None]), rng.choice(["x", "y", "z", None]), rng.choice(["1", "2.5", "-3", "abc", None])) for _ in range(25)]
    df = spark.createDataFrame(data, "g string, c string, v string")
    heads, want = brute_pivot(data, agg)
    got = pivot.pivot_table(df, ["g"], ["c"], ["v"], agg).df
    assert got.columns == ["g"] + [f"v_{h}" for h in heads] + ["v_Total"]
    rows = [tuple(r) for r in got.collect()]
    assert rows[-1][0] == "Total"
    for row in rows:
        assert list(row[1:]) == [pytest.approx(x) for x in want[row[0]]], row


def test_pivot_labels_names_and_shares(spark):
    df = spark.createDataFrame([("Total", 2, 10.0, "a"), ("N", 10, 0.0, "b"), ("N", 2, 30.0, "c")], "r string, c int, v double, w string")
    result = pivot.pivot_table(df, ["r"], ["c"], ["v", "w"], ["count"])
    assert result.df.columns == ["r", "v_2", "v_10", "v_Grand Total", "w_2", "w_10", "w_Grand Total"]
    assert [r.r for r in result.df.collect()] == ["N", "Total", "Grand Total"]
    several = pivot.pivot_table(df, ["r"], ["c"], ["v"], ["sum", "mean"]).df
    assert several.columns == ["r", "sum_v_2", "sum_v_10", "sum_v_Grand Total", "mean_v_2", "mean_v_10", "mean_v_Grand Total"]
    column_share = [tuple(r) for r in pivot.pivot_table(df, ["r"], ["c"], ["v"], "sum", show_as="column").df.collect()]
    assert column_share == [("N", 0.75, None, 0.75), ("Total", 0.25, None, 0.25), ("Grand Total", 1.0, None, 1.0)]
    only_columns = pivot.pivot_table(df, [], ["c"], ["v"], "sum").df
    assert [tuple(r) for r in only_columns.collect()] == [(40.0, 0.0, 40.0)]
    default = pivot.pivot_table(df, ["r"], [], ["w"]).df
    assert [tuple(r) for r in default.collect()] == [("N", 2), ("Total", 1), ("Grand Total", 3)]
    with pytest.raises(TableError):
        pivot.pivot_table(df, ["r"], [], ["v"], "sum", show_as="row")
    with pytest.raises(TableError):
        pivot.pivot_table(df, ["r"], [], ["v"], "mean", show_as="total")


def test_pivot_dates_and_filter(spark):
    start, rows = dt.date(2029, 11, 20), []
    for i in range(120):
        day = start + dt.timedelta(days=3 * i)
        rows.append(("even" if i % 2 == 0 else "odd", None if i % 11 == 5 else "later" if i % 13 == 7 else f"{day:%d/%m/%Y}" if i % 3 else day.isoformat(), str(i), day))
    df = spark.createDataFrame([r[:3] for r in rows], "side string, day string, n string")

    def sums(unit, keep=lambda r: True):
        out = {}
        for r in filter(keep, rows):
            label = "(blank)" if r[1] is None else "(not a date)" if r[1] == "later" else f"{r[3]:%Y-%m}" if unit == "month" else f"{r[3].year}-Q{(r[3].month + 2) // 3}"
            for key in (label, "Total"):
                out[key] = out.get(key, 0) + int(r[2])
        return out
    months = pivot.pivot_table(df, ["day"], [], ["n"], "sum", date_groups={"day": "month"}).df
    assert {r.day: r.n for r in months.collect()} == sums("month")
    quarters = pivot.pivot_table(df, ["day"], [], ["n"], "sum", filters={"side": "odd"}, date_groups={"day": "quarter"}).df
    assert {r.day: r.n for r in quarters.collect()} == sums("quarter", lambda r: r[0] == "odd")


def test_pivot_keeps_whole_numbers_and_number_order(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(k, big + k, "None" if k % 2 else "nan") for k in (110, 9, 25, -4, 100)], "k int, v long, c string")
    rows = pivot.pivot_table(df, ["k"], None, ["v"], "sum").df.collect()
    assert [(r.k, r.v) for r in rows] == [(str(k), big + k) for k in (-4, 9, 25, 100, 110)] + [("Total", 5 * big + 240)]
    assert pivot.pivot_table(df, ["k"], ["c"], ["v"], "count").df.columns == ["k", "v_None", "v_nan", "v_Total"]


def test_pivot_sums_beyond_64_bits(spark):
    """Sums of 64-bit integers are exact where they need more than 64 bits, and stay 64-bit where all of them fit."""
    top = 2 ** 63 - 1
    df = spark.createDataFrame([("a", "x", top, 1), ("a", "y", top, 2), ("b", "x", -top, 3), (None, "y", None, 4)], "k string, c string, big long, small long")
    plain = pivot.pivot_table(df, ["k"], None, ["big", "small"], "sum").df
    assert [tuple(r) for r in plain.collect()] == [("a", 2 * top, 3), ("b", -top, 3), ("(blank)", 0, 4), ("Total", top, 10)]
    assert dict(plain.dtypes) == {"k": "string", "big": "decimal(38,0)", "small": "bigint"}
    crossed = pivot.pivot_table(df, ["k"], ["c"], ["big"], "sum").df
    assert [tuple(r) for r in crossed.collect()] == [("a", top, top, 2 * top), ("b", -top, 0, -top), ("(blank)", 0, 0, 0), ("Total", 0, top, top)]
    few = pivot.pivot_table(df.filter("c = 'x'"), ["k"], None, ["big"], "sum").df
    assert few.dtypes == [("k", "string"), ("big", "bigint")] and [r.big for r in few.collect()] == [top, -top, 0]
    share = pivot.pivot_table(df.filter("k = 'a'"), ["k"], ["c"], ["big"], "sum", show_as="row").df
    assert [tuple(r) for r in share.collect()] == [("a", 0.5, 0.5, 1.0), ("Total", 0.5, 0.5, 1.0)]


# ---- reshape --------------------------------------------------------------------------------------------------------
def test_unpivot_and_back(spark):
    rng, names = random.Random(12), [f"m{k}" for k in range(4)]
    data = [(f"id{i}", rng.choice("pq"), *[rng.choice([None, "", "7", "8.5", "z"]) for _ in names]) for i in range(30)]
    df = spark.createDataFrame(data, "key string, side string, " + ", ".join(f"{n} string" for n in names))
    long = reshape.unpivot(df, ["key", "side"], name_column="which")
    assert collected(long.df.groupBy("key", "side").pivot("which", names).agg(F.first("value"))) == sorted(data, key=str)
    dropped = reshape.unpivot(df, ["key", "side"], drop_blank=True)
    blank = sum(v in (None, "") for r in data for v in r[2:])
    assert dropped.df.count() == 120 - blank and tuple(dropped.metrics.first()) == (120 - blank, blank)
    mixed = reshape.unpivot(spark.createDataFrame([(1, 2.0, 5)], "i int, x double, y int"), ["i"]).df
    assert dict(mixed.dtypes)["value"] == "double"
    with pytest.raises(TableError):
        reshape.unpivot(df, ["m1"], ["m1"])


def test_transpose_and_its_limit(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "i int, name string, n double")
    out = reshape.transpose(df, ["i"])
    assert out.columns == ["Original Column/Row", "0", "1"]
    assert [tuple(r) for r in out.collect()] == [("i", "1", "2"), ("name", "a", "b"), ("n", "1.5", None)]
    with pytest.raises(TableError):
        reshape.transpose(df, ["i"], most_rows=1)


def test_transpose_in_blocks(spark):
    """Any length: against the rows themselves, with missing cells, copies, names that clash, whole and partial blocks."""
    data = [(i // 2, None if i % 7 == 0 else f"t{i // 2}", float(i // 2)) for i in range(95)]
    df = spark.createDataFrame(data, "i int, `rows` string, `c0` double").repartition(4)
    for size in (10, 95, 1, 1000):
        out = reshape.transpose_blocks(df, ["i", "rows"], size).collect()
        got = {(r.place, r.column): [] for r in out}
        for r in sorted(out, key=lambda r: r.block):
            assert r.first_row == r.block * size and len(r["values"]) == min(size, 95 - r.first_row)
            got[r.place, r.column] += r["values"]
        ordered = sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        assert got == {(0, "i"): [str(r[0]) for r in ordered], (1, "rows"): [r[1] for r in ordered], (2, "c0"): [str(int(r[2])) for r in ordered]}
    assert reshape.transpose_blocks(df.limit(0), ["i"]).count() == 0
    with pytest.raises(TableError):
        reshape.transpose_blocks(df, ["i"], 0)


def test_append(spark):
    """Three tables whose columns differ in order, name, case, spaces and type."""
    first = spark.createDataFrame([(f"k{i}", str(10 * i)) for i in range(3)], "Part string, Weight string")
    second = spark.createDataFrame([("77", "k8", "wet")], "` weight` string, `Part No` string, State string")
    third = spark.createDataFrame([(905, "k9"), (906, None)], "WEIGHT int, Part string")
    result = reshape.append_tables([("one", first), ("two", second), ("three", third)], {"two": {"Part No": "Part"}}, loose=True)
    assert result.df.columns == ["source_file", "Part", "Weight", "State"]
    want = [("one", f"k{i}", str(10 * i), None) for i in range(3)] + [("two", "k8", "77", "wet"), ("three", "k9", "905", None), ("three", None, "906", None)]
    assert collected(result.df) == sorted(want, key=str)
    assert collected(result.side("partial_columns")) == [("State", "one"), ("State", "three")]
    assert collected(result.metrics) == [("one", 3), ("three", 2), ("two", 1)]
    with pytest.raises(TableError):
        reshape.append_tables([("one", first)])
