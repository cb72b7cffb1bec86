import datetime
import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import TableError
from gridloom.plans.order import carry_values, dense_index, file_order, first_rows, running_sum, with_position
from gridloom.plans.quantiles import exact_quantiles, grouped_quantile, order_key


def rows(spark, n=400, seed=1):
    """Two thirds of the rows share one key; a few keys are missing."""
    rng = random.Random(seed)
    data = [(i, "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None, "z"]), rng.choice([None, 1.0, 2.5, 7.0, 7.0, 9.25]), rng.randint(0, 50))
            for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "i int, k string, v double, w int").repartition(5), sorted(data)


def numbered(data, key):
    seen, out = {}, {}
    for r in data:
        seen[key(r)] = seen.get(key(r), 0) + 1
        out[r[0]] = seen[key(r)]
    return out


def test_dense_index(spark):
    df, data = rows(spark)
    got = {r.i: r.n for r in dense_index(df, [F.col("w").desc(), F.col("i")], "n").collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(data, key=lambda r: (-r[3], r[0])), 1)}


@pytest.mark.parametrize("mode", ["window", "slices"])
def test_occurrence_with_a_hot_key(spark, mode, request):
    if mode == "slices":
        request.getfixturevalue("sliced")
    df, data = rows(spark)
    got = {r.i: r.n for r in running_sum(df, ["k"], [F.col("i")], "n").collect()}
    assert got == numbered(data, lambda r: r[1])


@pytest.mark.parametrize("mode", ["window", "slices"])
def test_running_sum_of_weights(spark, mode, request):
    if mode == "slices":
        request.getfixturevalue("sliced")
    df, data = rows(spark)
    got = {r.i: r.n for r in running_sum(df, ["k"], [F.col("i")], "n", F.col("w").cast("bigint")).collect()}
    sums, want = {}, {}
    for i, k, _, w in data:
        sums[k] = sums.get(k, 0) + w
        want[i] = sums[k]
    assert got == want


def test_a_hot_key_spans_slices(spark, sliced):
    """The sliced plan must really cut the hot key: it is spread over several range partitions."""
    df, _ = rows(spark, 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.n for r in running_sum(df, ["k"], [F.col("i")], "n").collect()}
        _, data = rows(spark, 2000)
        assert got == numbered(data, lambda r: r[1])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("forward", [True, False])
def test_carry_values_over_empty_slices(spark, forward, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        data = [(i, "x%d" % i if i in (3, 4, 250) else None, float(i) if i % 90 == 10 else None) for i in range(300)]
        df = spark.createDataFrame(data, "i int, a string, b double").repartition(7)
        got = sorted((r.i, r.fa, r.fb) for r in carry_values(df, {"fa": F.col("a"), "fb": F.col("b")}, [F.col("i")], forward).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    a = b = None
    want = []
    for i, x, y in data if forward else reversed(data):
        a, b = x if x is not None else a, y if y is not None else b
        want.append((i, a, b))
    assert got == sorted(want)


def test_first_rows_short_and_long(spark, sliced):
    df, _ = rows(spark)
    assert sorted(r.i for r in first_rows(df, [F.col("i")], 2).collect()) == [0, 1]
    assert sorted(r.i for r in first_rows(df, [F.col("i")], 57).collect()) == list(range(57))


def test_order_is_asked_for(spark):
    with pytest.raises(TableError):
        file_order(spark.range(3))
    assert len(file_order(spark.range(3), ["id"])) == 2


def test_file_positions(spark, tmp_path):
    df, data = rows(spark)
    df.coalesce(1).orderBy("i").write.parquet(str(tmp_path / "p"))
    placed = with_position(spark.read.parquet(str(tmp_path / "p")))
    assert [r.i for r in placed.orderBy("_position").collect()] == [r[0] for r in data]
    df.coalesce(1).orderBy("i").select("i").write.csv(str(tmp_path / "c"))
    placed = with_position(spark.read.schema("i int").csv(str(tmp_path / "c")))
    assert [r.i for r in placed.orderBy("_position").collect()] == [r[0] for r in data]


def quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_order_key_is_the_layout_of_a_double(spark):
    """Against the bytes themselves: powers of two and their neighbours, subnormal numbers, both signs, both infinities."""
    rng = random.Random(5)
    values = [0.0, 5e-324, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, math.inf]
    values += [math.nextafter(2.0 ** e, to) for e in range(-1070, 1024, 7) for to in (0, math.inf)] + [2.0 ** e for e in range(-1074, 1024)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(52) | rng.randrange(2047) << 52))[0] for _ in range(3000)]
    values += [-v for v in values if v]
    got = {r.v: r.k for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()}
    layout = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0]                    # noqa: E731
    assert got == {v: -layout(v) if v < 0 else layout(v) for v in values}
    assert spark.range(1).select(order_key(F.lit(float("nan"))).alias("k")).first().k > got[math.inf]


@pytest.mark.parametrize("few", [65536, 40, 0])
def test_exact_quantiles(spark, few):
    """All rounds run when no step counts as small."""
    rng = random.Random(3)
    near = [1.0 + j * 2.0 ** -50 for j in range(300)]
    data = [(rng.gauss(0, 100), rng.choice([-1.0, 0.0, 1.0]), 5.0 if rng.random() < 0.7 else rng.random() * 1000, None, rng.choice(near), -rng.random() ** 40)
            for _ in range(3001)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double").repartition(4)
    spark.conf.set("spark.gridloom.fewRows", str(few))
    try:
        got = exact_quantiles(df, {n: F.col(n) for n in "abcdef"}, [0.0, 0.25, 0.5, 0.77, 1.0])
        single = exact_quantiles(df.limit(1), {"a": F.lit(3)}, [0.5, 0.9])
        empty = exact_quantiles(df.limit(0), {"a": F.col("a")}, [0.5])
    finally:
        spark.conf.unset("spark.gridloom.fewRows")
    for j, n in enumerate("abcdef"):
        for p, value in got[n].items():
            want = None if n == "d" else quantile([r[j] for r in data], p)
            assert value == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-300)), (n, p)
    assert single == {"a": {0.5: 3.0, 0.9: 3.0}} and empty == {"a": {0.5: None}}


@pytest.mark.parametrize("few", [None, 65536, 0])
@pytest.mark.parametrize("p", [0.5, 0.9])
def test_grouped_quantile(spark, few, p, request):
    """The built-in for small groups, radix selection of groups that are not, with few and with all rounds."""
    if few is not None:
        request.getfixturevalue("sliced")
        spark.conf.set("spark.gridloom.fewRows", str(few))
    try:
        df, data = rows(spark)
        got = {r.k: r.q for r in grouped_quantile(df, ["k"], F.col("v") - F.col("w"), p, "q").collect()}
    finally:
        spark.conf.unset("spark.gridloom.fewRows")
    values = {}
    for _, k, v, w in data:
        if v is not None:
            values.setdefault(k, []).append(v - w)
    assert got == {k: pytest.approx(quantile(v, p)) for k, v in values.items()}


def test_slices_are_bounded_and_backward_is_linear(spark):
    from gridloom.plans import order
    spark.conf.set("spark.gridloom.sliceRows", "100")
    try:
        df = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 40 == 0, F.col("id")).alias("v"))
        sizes = order._slices(df, [F.col("i")]).groupBy(order._SLICE).count().agg(F.max("count"), F.count("*")).first()
        assert sizes[0] <= 200 and sizes[1] >= 40
        back = carry_values(df, {"next": F.col("v")}, [F.col("i")], forward=False)
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "currentrow$(), unboundedfollowing$()" not in plan
        assert {r.i: r.next for r in back.collect()} == {i: (i + 39) // 40 * 40 if i <= 4960 else None for i in range(5000)}
    finally:
        spark.conf.unset("spark.gridloom.sliceRows")


def test_ranges_between_splitters(spark, monkeypatch):
    """Numbers, sums and carried values without a written table: NULL, NaN, ties and copies in the order, text, struct and time columns."""
    from gridloom.plans import order
    monkeypatch.setattr(order, "written", lambda df: pytest.fail("a table was written"))
    spark.conf.set("spark.gridloom.sliceRows", "60")
    try:
        r = random.Random(4)
        data = [(i, r.choice([None, float("nan"), -0.0, 0.0, r.gauss(0, 9)]), r.choice([None, "", "a", "Zoë", "z" * r.randrange(30)]),
                 datetime.datetime(2020, 1, 1) + datetime.timedelta(days=r.randrange(99))) for i in range(1500)]
        df = spark.createDataFrame(data, "i int, x double, s string, t timestamp").repartition(6).withColumn("p", F.struct("s", F.struct("x", "i")))
        for by in (["i"], ["x", "i"], ["s", "x", "i"], ["t", "i"], ["p"]):
            plain = [F.col(n) for n in by]
            want = {x.i: x.n for x in df.select("i", F.row_number().over(order.W.orderBy(*plain)).alias("n")).collect()}
            assert {x.i: x.n for x in dense_index(df, plain, "n", ascending=True).collect()} == want, by
        sizes = order._slices(df, [F.col("i")], ascending=True).groupBy(order._SLICE).agg(F.count("*").alias("n"), F.max(order._OFFSET).alias("last")).collect()
        assert len(sizes) == 25 and max(x.n for x in sizes) <= 120 and all(x["last"] == x.n - 1 for x in sizes)
        for forward in (True, False):
            got = {x.i: x.c for x in carry_values(df, {"c": F.when(F.col("i") % 70 == 3, F.col("i"))}, [F.col("i")], forward, ascending=True).collect()}
            filled = [i for i in range(1500) if i % 70 == 3]
            assert got == {i: max((f for f in filled if f <= i), default=None) if forward else min((f for f in filled if f >= i), default=None) for i in range(1500)}
        summed = running_sum(df, ["s"], [F.col("i")], "n", F.col("i").cast("bigint"), sliced=True, ascending=True)
        sums, want = {}, {}
        for i, _, s, _ in data:
            sums[s] = sums.get(s, 0) + i
            want[i] = sums[s]
        assert {x.i: x.n for x in summed.collect()} == want
        assert dense_index(df.limit(0), [F.col("i")], "n", ascending=True).count() == 0
        assert dense_index(df.withColumn("__order0", F.col("i")), [F.col("i")], "n", ascending=True).columns == [*df.columns, "__order0", "n"]
    finally:
        spark.conf.unset("spark.gridloom.sliceRows")


def test_copies_that_fill_slices_are_split(spark, sliced):
    df = spark.range(300).select(F.lit(1).alias("a"), F.lit("x").alias("b")).repartition(3)
    numbers = dense_index(df, file_order(df, ["a"]), "n", ties=["a"], ascending=True)
    assert sorted(x.n for x in numbers.collect()) == list(range(1, 301)) and numbers.columns == ["a", "b", "n"]
    carried = carry_values(df, {"c": F.col("b")}, file_order(df, ["a"]), ties=["a"], ascending=True)
    assert {tuple(x) for x in carried.collect()} == {(1, "x", "x")} and carried.count() == 300


@pytest.mark.parametrize("seed", range(2))
def test_long_heads_against_brute_force(spark, sliced, seed):
    """Heads, tails and samples beyond the limit of a top-k, with NULLs, NaN, ties and numbers of both signs."""
    from gridloom.operators import sorting
    r = random.Random(seed)
    data = [(i, r.choice([None, float("nan"), 0.0, -1.5, float(r.randrange(-50, 50)), r.gauss(0, 1e9)]), r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(data, "i int, x double, k int").repartition(5)
    blank = lambda v: v is None or v != v                                          # noqa: E731
    for direction, sign in ((sorting.ASCENDING, 1), (sorting.DESCENDING, -1)):
        full = sorted(data, key=lambda t: (blank(t[1]), 0 if blank(t[1]) else sign * t[1], t[0]))
        for n in (40, 290, 400):
            assert [x.i for x in sorting.first_n(df, n, ["i"], [("x", direction)]).collect()] == [t[0] for t in full[:n]]
            assert [x.i for x in sorting.last_n(df, n, ["i"], [("x", direction)]).collect()] == [t[0] for t in full[-n:]]
    for n in (5, 120, 299):
        assert [x.i for x in sorting.first_n(df, n, ["i"]).collect()] == list(range(n)) and [x.i for x in sorting.last_n(df, n, ["i"]).collect()] == list(range(300 - n, 300))
        drawn = sorted(sorted(range(300), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:n])
        assert [x.i for x in sorting.sample_n(df, n, 9, ["i"]).collect()] == drawn


def test_a_long_head_sorts_little(spark, monkeypatch):
    from gridloom.operators import sorting
    from gridloom.plans import order
    sorted_rows = []
    real = order.dense_index
    monkeypatch.setattr(order, "dense_index", lambda df, *a, **k: (sorted_rows.append(df.count()), real(df, *a, **k))[1])
    df = spark.range(200_000).withColumn("x", F.rand(3))
    assert sorting.sample_n(df, 20_000, 1, ["id"]).count() == 20_000 and sorting.first_n(df, 15_000, ["id"], ["x"]).count() == 15_000
    assert 20_000 <= sorted_rows[0] < 20_200 and 15_000 <= sorted_rows[1] < 15_200
