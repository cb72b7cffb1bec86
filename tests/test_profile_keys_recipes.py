"""Profiles, keys, anonymization, readiness, recipes, files, streams, and the queries against their SQL."""
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import TableError
from gridloom.operators import anonymize, keys, profile, readiness
from gridloom.plans import recipes
from gridloom.sources import readers, sinks, synthetic
from gridloom.streaming import rows as stream

def _card(stem):
    """`stem` with the digit that makes it pass the Luhn test."""
    for last in range(10):
        digits = [int(c) for c in reversed(f"{stem}{last}")]
        if (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0:
            return f"{stem}{last}"


#: Columns made from the row number: name, cell, type.
MADE = [
    ("serial", lambda i: f"LOT{i:04d}", "ID/Serial"), ("repeated_serial", lambda i: f"LOT{i % 9}", "Text"), ("iso_day", lambda i: f"2031-{1 + i % 12:02d}-{1 + i % 28:02d}", "Date"),
    ("named_day", lambda i: f"{1 + i % 28} {['Jan', 'Jul', 'Dec'][i % 3]} 2031", "Date"), ("long_day", lambda i: f"{['April', 'August'][i % 2]} {1 + i % 28}, 2031", "Date"),
    ("moment", lambda i: f"2031-07-09T{i % 24:02d}:30:{i % 60:02d}", "Date"), ("plz", lambda i: f"{40000 + 7 * i}", "Postal Code"), ("direction", lambda i: ["up", "down", "left"][i % 3], "Text"),
    ("contact", lambda i: f"desk.{i}@mail.test.org", "Email"), ("line", lambda i: f"({200 + i % 700}) 867-{1000 + i}", "Phone Number"), ("link", lambda i: f"http://host{i}.test/a?b={i}", "URL"),
    ("cost", lambda i: f"£{i}.{i % 100:02d}", "Currency"), ("money", lambda i: ["CAD", "GBP"][i % 2], "Currency"), ("discounted", lambda i: f"{i % 101}%", "Percentage"),
    ("active", lambda i: ["On", "off"][i % 2], "Boolean"), ("bit_text", lambda i: str(i % 2), "Boolean"), ("payment", lambda i: _card(f"37{i:04d}90210{i % 9}18"[:15].ljust(15, "3")), "Credit Card"),
    ("host", lambda i: f"172.16.{i % 256}.9", "IP Address"), ("token", lambda i: f"{i:08x}-0a1b-4c2d-8e3f-{i:012x}", "UUID"), ("insured", lambda i: f"{100 + i % 800}-4{i % 10}-{1000 + i}", "SSN"),
    ("nothing", lambda i: None, "Unknown"), ("turns", lambda i: f"desk.{i}@mail.test.org" if i < 1500 else f"moved away {i}", "Text"),
]


def test_semantic_types(spark):
    """On 6000 rows: `turns` holds addresses only in its first quarter."""
    size = 6000
    data = [(i, *[cell(i) for _, cell, _ in MADE], 7 * i, i / 64, i % 2, (i % 5) / 4) for i in range(size)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"{n} string" for n, _, _ in MADE) + ", units int, weight double, lamp int, hit_rate double")
    out = {r.column: r for r in profile.semantic_types(df, order_by=["i"]).collect()}
    want = {n: t for n, _, t in MADE} | {"units": "Integer", "weight": "Float", "lamp": "Boolean", "hit_rate": "Percentage", "i": "Integer"}
    assert {n: r.detected_type for n, r in out.items()} == want
    assert out["cost"].format_info == "Symbol: £" and out["money"].format_info == "Symbol: CAD" and out["host"].format_info == "IPv4"
    assert [out[n].format_info for n in ("iso_day", "named_day", "long_day", "moment")] == [f"Format: {x}" for x in ("%Y-%m-%d", "%d %b %Y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S")]
    head = {r.column: r.detected_type for r in profile.semantic_types(df, ["turns"], sample_rows=1000, order_by=["i"]).collect()}
    assert head == {"turns": "Email"}                                                       # what only the head would say


@pytest.mark.parametrize("form", profile.DATE_FORMATS)
def test_date_formats_against_strptime(spark, form):
    import datetime as dt
    r = random.Random(form)
    texts = [dt.datetime(r.randrange(1900, 2100), r.randrange(1, 13), r.randrange(1, 29), r.randrange(24), r.randrange(60), r.randrange(60)).strftime(r.choice(profile.DATE_FORMATS)) for _ in range(150)]
    texts += [dt.datetime(2031, 7, 9, 10, 11, 12).strftime(form), "31/31/2031", "2031-02-29", "9 Smarch 2031", "2031-7-9", "99/99/9999", "", "x"]

    def fits(t):
        try:
            dt.datetime.strptime(t, form)
            return True
        except ValueError:
            return False
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", profile._date_parts(F.col("t")).alias("p"))
    got = {r.t: r.f[profile.DATE_FORMATS.index(form)] for r in df.select("t", F.array(*[F.coalesce(x, F.lit(False)) for x in profile._formats(F.col("p"))]).alias("f")).collect()}
    assert got == {t: fits(t) for t in texts}


def test_profile_against_pandas(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, rng.gauss(0, 10)]), rng.choice(["a", "bb", "bb", None]), 1.0) for i in range(301)]
    pdf = pd.DataFrame(data, columns=["i", "x", "t", "flat"])
    df = spark.createDataFrame(data, "i int, x double, t string, flat double")
    got = {r.column: r for r in profile.profile_numeric(df).collect()}
    x = pdf["x"]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    want = [x.mean(), x.median(), x.std(), x.min(), x.max(), q1, x.median(), q3, x.skew(), x.kurtosis()]
    assert list(got["x"])[1:11] == [pytest.approx(v) for v in want]
    outliers = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    assert got["x"].outliers == outliers and got["x"].outlier_percentage == round(outliers / 301 * 100, 2)
    assert (got["flat"].skew, got["flat"].kurtosis) == (0.0, 0.0)
    basics = {r.column: r for r in profile.profile_columns(df).collect()}
    for n in pdf.columns:
        assert (basics[n].non_null, basics[n].null_count, basics[n].unique_count) == (pdf[n].notna().sum(), pdf[n].isna().sum(), pdf[n].nunique())
    assert {r.column: r.unique_count for r in profile.profile_columns(df, approximate=True).collect()}["t"] == 2
    top = [(r.value, r["count"]) for r in profile.top_values(df, ["t"], ["i"]).orderBy("rank").collect()]
    assert top == list(pdf["t"].value_counts().items())
    lengths = profile.text_lengths(df).first()
    assert (lengths.min_length, lengths.max_length) == (1, 2)
    few = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert profile.profile_numeric(few).first().skew is None


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "1.5", "007", "x", None), ("2", "2", "1", "1", None), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    assert dict(profile.infer_types(df).dtypes) == {"a": "bigint", "b": "double", "c": "bigint", "d": "string", "e": "string"}


def brute_keys(data, names):
    unique = lambda c: len({tuple(r[i] for i in c) for r in data}) == len(data)
    found = []
    for size in range(1, len(names) + 1):
        for c in itertools.combinations(range(len(names)), size):
            if unique(c) and not any(set(k) <= set(c) for k in found):
                found.append(c)
    return {tuple(sorted(names[i] for i in c)) for c in found}


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_against_brute_force(spark, seed):
    rng = random.Random(seed)
    width, rows = rng.randint(2, 4), rng.randint(4, 20)
    names = [f"c{i}" for i in range(width)]
    data = [tuple(rng.choice([None, *range(rng.choice([2, 4, 9]))]) for _ in names) for _ in range(rows)]
    df = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names))
    for sizes in ({}, {"sample_rows": 2, "screen_rows": 3}):
        found = keys.find_minimal_keys(df, **sizes)
        assert {tuple(sorted(k)) for k in found.keys} == brute_keys(data, names) and not found.truncated


def test_key_honesty_and_limits(spark):
    df = spark.createDataFrame([("k7", "oak"), ("k9", "elm"), ("k7", "oak"), ("k8", "oak"), ("k7", "oak")], "id string, v string")
    report = keys.find_keys(df)
    assert report.keys == [] and ["id"] in report.keys_after_dedup and report.duplicate_rows == 2
    gaps = spark.createDataFrame([(n, None if n == 3 else "t", "flat") for n in range(5)], "id int, v string, same string")
    assert keys.find_keys(gaps).skipped_columns == ["v"]
    wide = spark.createDataFrame([tuple((r >> i) & 1 for i in range(5)) for r in range(32)], ", ".join(f"c{i} int" for i in range(5)))
    many = spark.range(40).select(*[(F.col("id") * (k + 1)).alias(f"u{k}") for k in range(14)])
    few = keys.find_minimal_keys(many, max_candidates=7)
    assert few.truncated and "7 candidates" in few.reason and len(few.keys) == few.tested == 7
    short = keys.find_minimal_keys(wide, max_size=3)
    assert short.truncated and "3" in short.reason and short.keys == []
    assert keys.find_minimal_keys(wide).keys == [[f"c{i}" for i in range(5)]]
    with_id = keys.unique_id(df, order_by=["id"])
    assert with_id.columns == ["id", "v", "Unique_ID", "_is_duplicate"]
    assert sorted((r.Unique_ID, r._is_duplicate) for r in with_id.collect()) == [("k7", False), ("k7", True), ("k7", True), ("k8", False), ("k9", False)]


def test_many_keys_and_large_keys_are_all_found(spark):
    many = spark.range(40).select(*[(F.col("id") * (k + 1)).alias(f"u{k}") for k in range(14)])
    assert len(keys.find_minimal_keys(many).keys) == 14
    some = keys.find_minimal_keys(many, max_keys=5)
    assert len(some.keys) == 5 and some.truncated and "5 keys" in some.reason
    six = spark.range(64).select(*[F.shiftright("id", k).bitwiseAND(F.lit(1)).alias(f"b{k}") for k in range(6)])
    assert keys.find_minimal_keys(six).keys == [[f"b{k}" for k in range(6)]] and not keys.find_minimal_keys(six).truncated


def test_a_key_of_seven_of_thirty_columns(spark):
    """Seven columns of a few values each make the key; the others repeat parts of it, or are constant."""
    key = F.col("id")
    part = [F.pmod(F.floor(key / 3 ** k), F.lit(3)) for k in range(7)]
    made = [p.alias(f"k{i}") for i, p in enumerate(part)]
    made += [(part[i % 7] % 2).alias(f"half{i}") for i in range(14)] + [F.lit(i).alias(f"flat{i}") for i in range(3)]
    made += [((part[i] + part[i + 1]) % 2).alias(f"mix{i}") for i in range(6)]
    df = spark.range(3 ** 7).select(*made)
    assert len(df.columns) == 30
    for sizes in ({}, {"sample_rows": 100, "screen_rows": 500}):
        found = keys.find_minimal_keys(df, **sizes)
        assert found.keys == [[f"k{i}" for i in range(7)]] and not found.truncated and found.tested < 500
    assert keys.find_minimal_keys(df.unionByName(df.limit(1))).keys == []                  # a copy leaves no key


def test_rows_outside_the_sample_refute(spark):
    """Only two rows of 3000 agree in `a` and `b`: the sample does not hold both."""
    df = spark.range(3000).select(F.col("id").alias("c"), (F.col("id") % 50).alias("b"), F.floor(F.col("id") / 50).alias("a"))
    df = df.withColumn("a", F.when(F.col("c") == 2999, F.lit(0)).otherwise(F.col("a")))    # row 2999 now repeats row 49
    for sizes in ({}, {"sample_rows": 20}, {"sample_rows": 20, "screen_rows": 200}):
        assert keys.find_minimal_keys(df, **sizes).keys == [["c"]]


def test_minimal_hitting_sets_against_brute_force():
    from gridloom.plans.hitting_sets import minimal_hitting_sets, smallest_sets
    rng = random.Random(8)
    for _ in range(200):
        width = rng.randrange(1, 8)
        family = smallest_sets(rng.randrange(1, 1 << width) for _ in range(rng.randrange(0, 9)))
        hits = [k for k in range(1 << width) if all(k & s for s in family)]
        want = sorted(k for k in hits if not any(k != x and k & x == x for x in hits))
        assert sorted(minimal_hitting_sets(family, width)[0]) == want
        for most in range(width):
            found, larger = minimal_hitting_sets(family, most)
            assert sorted(found) == [k for k in want if k.bit_count() <= most] and (larger or len(found) == len(want))
    assert smallest_sets([7, 3, 1 << 70, 6, 3, 1 << 70 | 1]) == [1 << 70, 3, 6] and minimal_hitting_sets([0], 3) == ([], False)


def test_key_samples_are_filters(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 7)
    plan = keys._share(df, ["id", "w"], 1000, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "Exchange" not in plan and 0 < keys._share(df, ["id", "w"], 1000, 100).count() < 200
    with pytest.raises(TableError):
        keys.unique_id(spark.createDataFrame([(None, 1), (None, 2)], "a string, b int").select("a"))


def test_anonymize(spark):
    data = [(0, "Ann", "x", 1.0), (1, "Bob", "y", None), (2, "Ann", None, 1.0), (3, None, None, 2.0), (4, "Ann", "x", 1.0)]
    df = spark.createDataFrame(data, "i int, `Full Name` string, vendor_code string, n double")
    done = anonymize.anonymize(df, ["Full Name", "n"], order_by=["i"])
    got = [tuple(r) for r in done.df.orderBy("i").collect()]
    assert got == [(0, "Full Name - 1", "x", "n_1"), (1, "Full Name - 2", "y", None), (2, "Full Name - 1", None, "n_1"), (3, None, None, "n_2"), (4, "Full Name - 1", "x", "n_1")]
    mapping = done.side("mapping")
    anonymize.verify_anonymized(df, done.df, ["Full Name", "n"], mapping)
    with pytest.raises(TableError, match="not anonymized"):
        anonymize.verify_anonymized(df, df, ["Full Name"], mapping)
    with pytest.raises(TableError, match="blank cells"):
        anonymize.verify_anonymized(df, done.df.withColumn("n", F.lit("n_1")), ["n"], mapping)
    related = anonymize.anonymize(df, ["vendor_code", "Full Name"], related=True, order_by=["i"])
    assert [(r.vendor_code, r["Full Name"]) for r in related.df.orderBy("i").collect()] == [
        ("vendor_1", "vendor_1"), ("vendor_2", "vendor_2"), (None, "vendor_3"), (None, None), ("vendor_1", "vendor_1")]
    assert {tuple(r.original): r.pseudonym for r in related.side("mapping").collect()} == {("x", "Ann"): "vendor_1", ("y", "Bob"): "vendor_2", (None, "Ann"): "vendor_3"}
    assert anonymize.pseudonym_prefix("Org Code") == "Org Code - " and anonymize.pseudonym_prefix("VENDOR_ID") == "VENDOR_"


def test_readiness(spark):
    df = spark.createDataFrame([(1, "Ann", "2024-01-05", None), (2, "Bob", "2024-02-05", "x"), (3, "Cy", "2024-03-05", None)], "id int, name string, day string, note string")
    job = readiness.assess(df, ["id"], triage={"note": readiness.ATTENTION}, anonymize_columns=["name"], normalize_columns=["day"], gap_columns=["note"], seconds=None)
    assert job.keys.keys[0] == ["id"] and job.sensitive == [("name", "name")]
    assert {(r.type, r.column) for r in job.recommendations.collect()} == {("anonymization", "name"), ("normalization", "day"), ("gap_handling", "note")}
    assert sorted(r.name for r in job.result.collect()) == ["NAM_00001", "NAM_00002", "NAM_00003"]
    assert [e["status"] for e in job.log] == ["applied", "recorded, not applied", "recorded, not applied"]
    facts = {r.fact: r.value for r in job.findings.collect()}
    assert facts["largest_gap"] == "note" and facts["columns_with_gaps"] == "1" and facts["key"] == "id"
    overview = job.overview.first()
    assert (overview.rows, overview.columns, overview.duplicate_rows, overview.reclassified_columns) == (3, 4, 0, 1)
    assert overview.completeness == pytest.approx(100 - 2 / 12 * 100)
    assert [r.bucket for r in job.gaps.collect()] == ["30% or more"]


# ---- recipes --------------------------------------------------------------------------------------------------------
def step(tool, **options):
    return {"tool": tool, "options": options}


ORDER_STEPS = [step("find-replace", find="#", replace="no. ", columns=["o_clerk"]), step("fill-missing", columns=["o_orderpriority", "o_clerk"], value="5-LOW"),
               step("row-filter", conditions=[{"column": "o_totalprice", "operator": "greater_equal", "value": 20}]),
               step("calculated-column", new_name="half", expression="o_totalprice / 2"), step("anonymize", columns=["o_clerk"]),
               step("group-and-summarise", group_columns=["o_orderpriority"], value_columns=["half"], sum=True)]


@pytest.fixture
def some_orders(spark):
    rows = [(1, "Clerk#7", 10.0, "1-URGENT"), (2, "Clerk#7", 30.0, None), (3, None, 50.0, "1-URGENT"), (4, "Clerk#8", 20.0, " "), (5, "none", 90.0, "2-HIGH")]
    return spark.createDataFrame(rows, "o_orderkey int, o_clerk string, o_totalprice double, o_orderpriority string")


def test_replay_and_one_run_counts(spark, some_orders, tmp_path):
    done = recipes.replay(recipes.make_recipe(ORDER_STEPS, "orders"), some_orders, ["o_orderkey"])
    want = {("5-LOW", 25.0, 2), ("1-URGENT", 25.0, 1), ("2-HIGH", 45.0, 1)}
    assert {(r.o_orderpriority, r.half_sum, r.rows) for r in done.df.collect()} == want
    assert [s["columns_added"] for s in done.steps[:4]] == [[], [], [], ["half"]]
    report = [tuple(r) for r in done.report(str(tmp_path / "out")).orderBy("step").collect()]
    assert report == [(1, "find-replace", 5, 5, 3), (2, "fill-missing", 5, 5, 3), (3, "row-filter", 5, 4, None), (4, "calculated-column", 4, 4, 0),
                      (5, "anonymize", 4, 4, 4), (6, "group-and-summarise", 4, 3, None)]
    assert {(r.o_orderpriority, r.half_sum, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert [r.rows_out for r in done.report().orderBy("step").collect()] == [5, 5, 4, 4, 4, 3]


def test_counts_of_steps_that_need_the_order(spark, some_orders):
    steps = [step("fill-missing", columns=["o_orderpriority"], method="previous", flag=True), step("remove-duplicates", columns=["o_clerk"]),
             step("sort-rank-sample", sort1="o_totalprice", direction1="descending", rank=True), step("normalize-types", targets={"o_totalprice": "integer"}),
             step("fill-missing", columns=["o_clerk"], method="mode")]
    done = recipes.replay(recipes.make_recipe(steps), some_orders, ["o_orderkey"])
    assert [tuple(r) for r in done.report().orderBy("step").collect()] == [
        (1, "fill-missing", 5, 5, 2), (2, "remove-duplicates", 5, 4, None), (3, "sort-rank-sample", 4, 4, 0), (4, "normalize-types", 4, 4, 0), (5, "fill-missing", 4, 4, 1)]
    assert done.side(2, "removed").count() == 1 and done.metrics[1].first().rows_removed == 1
    assert recipes.dry_run(recipes.make_recipe(steps), some_orders, ["o_orderkey"]) == done.steps


def test_a_step_that_does_not_fit(some_orders):
    for run in (recipes.replay, recipes.dry_run):
        with pytest.raises(TableError, match=r"step 2 \(fill-missing\): columns names no column of the table: 'o_orderpriority'"):
            run(recipes.make_recipe(ORDER_STEPS), some_orders.drop("o_orderpriority"), ["o_orderkey"])


def test_recipes_as_json_and_in_the_log():
    import json
    told = recipes.make_recipe(ORDER_STEPS, "orders")
    read = recipes.Recipe.read(json.dumps(told))
    assert read.told() == told and read.name == "orders" and recipes.Recipe.read(read) is read
    first, third = read.log()[0]["options"], read.log()[2]["options"]
    assert first["find"] == {"characters": 1} and first["replace"] == {"characters": 4} and first["columns"] == ["o_clerk"] and third["conditions"] == {"entries": 1}


@pytest.mark.parametrize("told, faults", [
    ("{", ["JSON"]), ([], ["object"]), ({"steps": 5}, ["recipe_version is 1", "list of one step"]), ({"recipe_version": 1, "steps": []}, ["list of one step"]),
    ({"recipe_version": 7, "steps": [{"tool": "unheard"}, "x", ORDER_STEPS[0]]}, ["recipe_version is 1", "step 1 names no operator: 'unheard'", "step 1 has no options", "step 2 names no operator"])])
def test_all_faults_of_a_recipe_at_once(told, faults):
    with pytest.raises(TableError) as error:
        recipes.Recipe.read(told)
    assert all(f in str(error.value) for f in faults)


def test_the_limit_of_steps_is_an_argument():
    told = recipes.make_recipe(ORDER_STEPS * 9)
    with pytest.raises(TableError, match="more than 50 steps"):
        recipes.Recipe.read(told)
    assert len(recipes.Recipe.read(told, most_steps=54).steps) == 54


def test_options_and_own_operators(spark):
    df = spark.range(3)
    sort = recipes.OPERATORS["sort-rank-sample"]
    given = {"sort1": "x", "count": 0, "keep": "none", "rank": "perhaps", "seed": "many", "huh": 1}
    with pytest.raises(TableError) as error:
        recipes.check_options(sort, given, df)
    assert all(n in str(error.value) for n in given) and str(error.value).count(";") == 5
    read = recipes.check_options(sort, {"sort1": "id", "rank": "True", "count": "5", "seed": 2.0}, df)
    assert (read["sort1"], read["sort2"], read["rank"], read["count"], read["seed"], read["keep"]) == ("id", None, True, 5, 2, "all")
    with pytest.raises(TableError, match="find is needed"):
        recipes.check_options(recipes.OPERATORS["find-replace"], {"replace": "x"}, df)
    with pytest.raises(TableError, match="at most 500 characters"):
        recipes.check_options(recipes.OPERATORS["find-replace"], {"find": "x" * 501}, df)
    recipes.register(recipes.Operator("double", lambda df, column: df.withColumn(column, F.col(column) * 2), (recipes.Option("column", recipes.OneColumn(), required=True),), cells="changed"))
    done = recipes.replay(recipes.make_recipe([step("double", column="id")]), df)
    assert sorted(r.id for r in done.df.collect()) == [0, 2, 4] and done.report().first().cells_changed == 2


# ---- files ----------------------------------------------------------------------------------------------------------
def save(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_lossless_and_inferred_csv(spark, tmp_path):
    path = save(tmp_path / "a.csv", "﻿code;v;n\n00123;NA;1\n;None;2,5\n7;;3\n")
    assert readers.detect_delimiter(spark, path) == ";" and readers.detect_encoding(spark, path) == "UTF-8"
    df = readers.read_delimited(spark, path)
    assert df.columns == ["code", "v", "n"] and [tuple(r) for r in df.collect()] == [("00123", "NA", "1"), (None, "None", "2,5"), ("7", None, "3")]
    assert dict(readers.read_delimited(spark, path, mode="infer").dtypes) == {"code": "bigint", "v": "string", "n": "string"}
    placed = readers.read_delimited(spark, path, position=True)
    assert [r.code for r in placed.orderBy("_position").collect()] == ["00123", None, "7"]
    assert readers.read_headers(spark, save(tmp_path / "h.csv", " a ,,b\n1,2,3\n")) == ["a", "b"]
    samples = readers.column_samples(df)
    assert samples[0] == {"column": "code", "type": "string", "samples": ["00123", "7"]}
    shown = readers.preview(df, 2)
    assert (len(shown["rows"]), shown["total_rows"], shown["total_columns"], readers.row_count(df)) == (2, 3, 3, 3)


@pytest.mark.parametrize("text,want", [("a,b;c;d\n", ","), ('"a,b";c;d\n', ";"), ("\n\na\tb\n", "\t"), ("a|b|c\n", "|"), ("one\n", ",")])
def test_delimiters(spark, tmp_path, text, want):
    assert readers.detect_delimiter(spark, save(tmp_path / "d.txt", text)) == want


def test_windows_text_and_line_breaks(spark, tmp_path):
    path = save(tmp_path / "w.csv", "Text,Price\n“Quoted”,€5\n", "cp1252")
    assert readers.detect_encoding(spark, path) == "windows-1252"
    assert [tuple(r) for r in readers.read_delimited(spark, path, encoding="windows-1252").collect()] == [("“Quoted”", "€5")]
    odd = save(tmp_path / "l.csv", "a,b\né\x81,1\n", "latin-1")
    assert readers.detect_encoding(spark, odd) == "ISO-8859-1"
    broken = save(tmp_path / "m.csv", 'a,b\n"x\ny",1\nz,2\n')
    assert readers.row_count(readers.read_delimited(spark, broken, multi_line=True)) == 2


@pytest.fixture
def small_ranges(spark):
    """Files are cut into byte ranges of 150 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "150b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("seed", range(2))
def test_quoted_line_breaks_in_many_ranges(spark, tmp_path, small_ranges, seed):
    """Against the standard library's reader, with cells that span several ranges and quotes inside plain cells."""
    import csv
    import io
    rng = random.Random(seed)
    cells = ["", "a", "5\" pipe", "x\ny", 'say "hi"', "\r\n", "one;two", "long\n" * 30, '"', '"\n"', "é\n", ' "b', "\n\n", "c" * 90]
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        made = io.StringIO(newline="")
        writer = csv.writer(made, delimiter=";", lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        writer.writerow(["n", "t\nwo", "u"])
        for i in range(40):
            writer.writerow([f"{name}{i}", rng.choice(cells), rng.choice(cells)])
            if i % 20 == 0:
                made.write(f"raw{name}{i};5\" wide;6\" deep{end}")
        save(tmp_path / name, made.getvalue())
    want = []
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, newline="", encoding="utf-8") as f:
            want.append([tuple(v or None for v in r) for r in csv.reader(f, delimiter=";")])
    df = readers.read_delimited(spark, str(tmp_path), position=True, delimiter=";")
    assert df.rdd.getNumPartitions() > 10 and df.columns == ["n", "t\nwo", "u", "_position"]
    plain = lambda r: tuple(v or None for v in r)                                  # noqa: E731
    got = [plain(tuple(r)[:3]) for r in df.orderBy("_position").collect()]
    assert got == want[0][1:] + want[1][1:]
    assert readers.count_records(spark, str(tmp_path)) == len(got)
    grid = [plain(r.cells[:3]) for r in readers.raw_grid(spark, str(tmp_path), ";").orderBy("_position").collect()]
    assert grid == want[0] + want[1]


def test_every_begin_of_a_range(small_ranges, spark, tmp_path):
    """The states of all ranges, against a walk through the bytes; one file ends inside a quoted cell."""
    from gridloom.sources import records
    text = 'a,b\n' + ''.join(f'{i},"{"y" * (i % 50)}\n{"z" * (i * 7 % 90)}"\n' for i in range(40)) + '9,"open\n' + "tail\n" * 30
    path = save(tmp_path / "o.csv", text)
    values = [r.value.decode() for r in records.quoted_records(spark, path, ",").orderBy("block", "row").collect()]
    assert "\n".join(values) + "\n" == text.rstrip("\n") + "\n" and len(values) == 42 and values[-1].startswith('9,"open\ntail')
    for line, begin, end in ((b'a,"b', False, True), (b'a,b"', False, False), (b'x",y', True, False), (b'x"",y', True, True), (b'x"","y', True, False), (b'"a","b""', False, True), (b'"', True, False),
                             (b'""', False, False), (b'"a" junk,"b', False, True), (b'', True, True)):
        assert records.ends_inside(line, b",", begin) is end, line


def test_states_of_lines_as_arrays(spark):
    """All lines of an array at once, against a walk through their characters; arrays may begin in the middle of their buffers."""
    import numpy as np
    import pyarrow as pa

    from gridloom.sources import records

    def walk(line: bytes, d: bytes, inside: bool) -> bool:
        i, begins = 0, True
        while i < len(line):
            if inside:
                if line[i:i + 2] == b'""':
                    i += 2
                    continue
                inside, begins, i = line[i:i + 1] != b'"', False, i + 1
            elif begins and line[i:i + 1] == b'"':
                inside, i = True, i + 1
            else:
                begins = line[i:i + len(d)] == d
                i += len(d) if begins else 1
        return inside
    rng = random.Random(31)
    for d in (b";", b"\t", b"::"):
        for _ in range(300):
            lines = [b"".join(rng.choices([b'"', b'""', d, b"a", b"\r"], k=rng.randrange(7))) for _ in range(12)]
            values, inside = pa.array(lines, pa.binary()).slice(rng.randrange(3)), rng.random() < 0.5
            got = records._states(*records._runs(values, d), len(values), inside)
            want = []
            for line in lines[len(lines) - len(values):]:
                want.append(walk(line, d, want[-1] if want else inside))
            assert got.dtype == np.bool_ and got.tolist() == want, (lines, d, inside)


def test_each_cut_hands_on_what_it_is_for(small_ranges, spark, tmp_path):
    """The pass for records that cross ranges returns their pieces only, and the other one none of them."""
    from gridloom.sources import records
    text = "a;b\n" + "".join(f'{i};"{"y" * (i % 50)}\n{"z" * (i * 7 % 90)}"\n' for i in range(60))
    lines = records.raw_lines(spark, save(tmp_path / "p.csv", text))
    turns = records._turns(lines, b";")
    inside = spark.sparkContext.broadcast(frozenset((r.file, r.block) for r in records._begins_inside(turns).collect()))
    cut = {(w, c): records._cut(lines, b";", inside, w, c).collect() for w, c in ((True, True), (True, False), (False, True))}
    whole, pieces = cut[True, False], cut[False, True]
    assert inside.value and pieces and {r.piece for r in whole} == {0} and 0 not in {r.piece for r in pieces}
    assert sorted(whole + pieces) == sorted(cut[True, True]) and sum(r.head for r in whole) == 1


def test_ragged_rows_among_quoted_line_breaks(spark, tmp_path):
    """Delimiters inside quotes make no row too long; one cell too many in the last of the files does, also in bytes that are no UTF-8."""
    (tmp_path / "r").mkdir()
    for i in range(6):
        save(tmp_path / "r" / f"{i}.csv", 'k;v\n1;"a;b;c\n;;d"\n"2;;";x\n')
    assert sorted(readers.read_delimited(spark, str(tmp_path / "r"), encoding="UTF-8", multi_line=True).collect()) == sorted([("1", "a;b;c\n;;d"), ("2;;", "x")] * 6)
    (tmp_path / "r" / "6.csv").write_bytes(b'k;v\n1;"a\nb"\n2;\xe2;\n3;\xe2;y\n')
    with pytest.raises(TableError, match="more than the 2 cells"):
        readers.read_delimited(spark, str(tmp_path / "r"), encoding="UTF-8", multi_line=True)


def test_encodings_by_file(spark, tmp_path):
    texts = {"u.csv": ("k,v\n1,Zoë €\n2,ÿ\n", "utf-8"), "b.csv": ("k,v\n3,Ærø\n", "utf-8-sig"), "w.csv": ("k,v\n4,“é”\n", "cp1252"), "l.csv": ("k,v\n5,é\x81\n", "latin-1"),
             "q.csv": ('k,v\n6,"ü\nö"\n', "cp1252"), "plain.csv": ("k,v\n7,x\n", "ascii")}
    for name, (text, encoding) in texts.items():
        save(tmp_path / name, text, encoding)
    look = readers.look_through(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[1]: r.encoding for r in look.files.collect()} == {
        "u.csv": "UTF-8", "b.csv": "UTF-8", "w.csv": "windows-1252", "l.csv": "ISO-8859-1", "q.csv": "windows-1252", "plain.csv": "UTF-8"}
    got = sorted(tuple(r) for r in readers.read_delimited(spark, str(tmp_path)).collect())
    assert got == [("1", "Zoë €"), ("2", "ÿ"), ("3", "Ærø"), ("4", "“é”"), ("5", "é\x81"), ("6", "ü\nö"), ("7", "x")]
    with pytest.raises(TableError, match="different encodings"):
        readers.detect_encoding(spark, str(tmp_path))
    assert sorted(r.cells[1] for r in readers.raw_grid(spark, str(tmp_path)).collect() if r.cells[0] != "k") == sorted(v for _, v in got)


def test_raw_grid(spark, tmp_path):
    path = save(tmp_path / "g.csv", 'Report,,,\n"made, 2024",,,\n,,,\nid,amount,,amount\n1,"5,5",,x\n,,,\n2,"say ""hi""",,y\n')
    grid = readers.raw_grid(spark, path, ",")
    assert readers.suggest_header_row(grid) == 4
    table = readers.table_from_grid(grid, 4)
    assert table.columns == ["id", "amount", "amount_2", "_position"]
    assert [tuple(r)[:3] for r in table.orderBy("_position").collect()] == [("1", "5,5", "x"), ("2", 'say "hi"', "y")]
    assert readers.table_from_grid(grid, 0, drop_empty=False).columns[:2] == ["Column 1", "Column 2"]
    with pytest.raises(TableError):
        readers.table_from_grid(grid, 99)


def test_small_chunks_share_tasks(spark, tmp_path):
    """Every task reports to the driver, so there are no more of them than shuffle partitions; a chunk is still one file, in order."""
    df = spark.range(300).select((F.lit(299) - F.col("id")).alias("i")).repartition(3)
    sinks.write_split_by_rows(df, str(tmp_path / "rows"), 5, ["i"])
    files = {part.name: [f.name for f in part.glob("*.parquet")] for part in (tmp_path / "rows").glob("part=*")}
    assert set(files) == {f"part={n}" for n in range(1, 61)} and all(len(names) == 1 for names in files.values())
    assert len({names[0].split("-")[1] for names in files.values()}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (1, 17, 60):
        assert pd.read_parquet(tmp_path / "rows" / f"part={n}" / files[f"part={n}"][0]).i.tolist() == [*range(5 * n - 5, 5 * n)]
    sinks.write_split_by_rows(df.limit(0), str(tmp_path / "none"), 5, ["i"])
    assert not [*(tmp_path / "none").glob("part=*")]


def test_safe_csv_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(0, "=1+1", -5.0), (1, "-5", 2.5), (2, "+x", 1.0), (3, "ok", None)], "i int, `=cell` string, n double")
    assert sinks.safe_cells(df).columns == ["i", "'=cell", "n"]
    assert [r[1] for r in sinks.safe_cells(df).orderBy("i").collect()] == ["'=1+1", "-5", "'+x", "ok"]
    sinks.write_csv(df, str(tmp_path / "out"))
    back = readers.read_delimited(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect() if r.n) == [("0", "'=1+1", "-5"), ("1", "-5", "2.5"), ("2", "'+x", "1")]
    sinks.write_split_by_rows(df, str(tmp_path / "rows"), 3, ["i"])
    assert {p.name for p in (tmp_path / "rows").iterdir() if p.is_dir()} == {"part=1", "part=2"}
    assert spark.read.parquet(str(tmp_path / "rows" / "part=2")).count() == 1
    kinds = spark.createDataFrame([(0, " a/b "), (1, "A_B"), (2, None), (3, "***"), (4, "a/b")], "i int, k string")
    labels = {r.value: (r.label, r.rows, r.number) for r in sinks.split_labels(kinds, "k", ["i"]).collect()}
    assert labels == {"a/b": ("a_b", 2, 1), "A_B": ("A_B_2", 1, 2), None: ("blank", 1, 3), "***": ("value", 1, 4)}
    sinks.write_split_by_value(kinds, str(tmp_path / "values"), "k", ["i"])
    assert {p.name for p in (tmp_path / "values").iterdir() if p.is_dir()} == {"part=a_b", "part=A_B_2", "part=blank", "part=value"}
    many = spark.range(1400).select(F.col("id").alias("i"))
    with pytest.raises(TableError):
        sinks.split_by_rows(many, sinks.MOST_CHUNK_ROWS + 1, ["i"])
    assert sinks.split_by_rows(many, sinks.MOST_CHUNK_ROWS + 1, ["i"], most_rows=None).agg(F.max("chunk")).first()[0] == 1


@pytest.mark.parametrize("seed", range(3))
def test_split_labels_against_one_by_one(spark, seed):
    """Clashes in case, among names that end in numbers themselves, and with the names for blanks."""
    rng = random.Random(seed)
    stems = ["a", "A", "a_2", "A_2", "a 2", "a_2_2", "a_2_3", "a_3", "b", "B ", "b_02", "blank", "Blank_2", "value", "***", "v/w", "v w", "V-w", "long" * 20, "long" * 20 + "x"]
    values = [rng.choice([None, "  ", *stems]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, k string")
    want, used = {}, set()
    for v in values:
        v = (v or "").strip() or None
        if v not in want:
            base = "blank" if v is None else "".join(c if c.isalnum() or c in "_-" else "_" for c in v)[:60].strip("_") or "value"
            name, n = base, 1
            while name.lower() in used:
                n += 1
                name = f"{base}_{n}"
            used.add(name.lower())
            want[v] = name
    got = sinks.split_labels(df, "k", ["i"]).collect()
    assert {r.value: r.label for r in got} == want and [r.value for r in sorted(got, key=lambda r: r.number)] == list(want)


def test_one_rule_for_many_clashing_values(spark, sliced):
    for size in (40, 1500):
        df = spark.range(size).select(F.col("id").alias("i"), F.concat(F.lit("/" * 3), F.repeat(F.lit("*"), F.col("id").cast("int"))).alias("k"))
        labels = {r.number: r.label for r in sinks.split_labels(df, "k", ["i"]).collect()}
        assert labels == {n: "value" if n == 1 else f"value_{n}" for n in range(1, size + 1)}


def test_log(spark, tmp_path):
    df = spark.range(10)
    record = sinks.write_with_log(df, df.filter("id > 3"), str(tmp_path / "t"), "row-filter", {"columns": ["id"], "api_key": "x", "nested": {"password": 1, "n": 2}})
    assert record[3:5] == (10, 6) and record[5] == '{"columns": ["id"], "nested": {"n": 2}}'
    assert spark.read.json(str(tmp_path / "t.log")).first().rows_out == 6


def test_scratch_tables_go_when_released(spark, tmp_path):
    from gridloom.session import release_scratch, written
    release_scratch(spark)
    table = written(spark.range(5))
    assert table.count() == 5 and release_scratch(spark) == 1
    with pytest.raises(Exception):
        table.count()


def test_synthetic_table(spark):
    one, two = synthetic.synthetic_table(spark, 2000), synthetic.synthetic_table(spark, 2000).repartition(3)
    assert one.count() == 2000 and len(one.columns) == 15 and one.exceptAll(two).isEmpty()
    row = one.agg(F.min("amount"), F.max("amount"), F.avg(F.col("notes").isNull().cast("int")), F.count_distinct("vendor_code")).first()
    assert row[0] >= 10 and row[1] <= 50000 and 0.5 < row[2] < 0.7 and row[3] > 400


def test_rows_on_a_stream(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select("id", F.concat(F.lit(" v "), "id").alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from gridloom.operators import cleaning, filters
    source = stream.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    step = lambda df: cleaning.clean_text(filters.row_filter(df, [{"column": "id", "operator": "less_than", "value": 25}]), ["t"]).df
    for _ in range(2):                                         # the second run finds nothing new
        stream.run_rows(source, step, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 25 and out.filter("t like ' %'").count() == 0


# ---- the queries ----------------------------------------------------------------------------------------------------
def test_every_query_has_sql():
    from gridloom import suite
    assert set(suite.QUERIES) == set(suite.ORACLES)


def test_a_dry_run_writes_nothing(spark, monkeypatch, tmp_path):
    import gridloom.session as session
    df = spark.createDataFrame([(i, "a b" if i % 3 else None, float(i)) for i in range(30)], "i int, t string, x double")
    steps = [{"tool": "fill-missing", "options": {"columns": ["t"], "method": "previous", "flag": True}}, {"tool": "sort-rank-sample", "options": {"sort1": "x", "rank": True}},
             {"tool": "split-column", "options": {"column": "t", "delimiter": " "}}]
    recipe = recipes.make_recipe(steps, "trial")
    real = recipes.replay(recipe, df, ["i"]).steps

    def refuse(*_, **__):
        raise AssertionError("a dry run wrote a table")
    monkeypatch.setattr(session, "scratch_path", refuse)
    assert recipes.dry_run(recipe, df, ["i"]) == real
