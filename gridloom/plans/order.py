"""Row order on a distributed table: positions, dense numbering, running sums and carried values.

A DataFrame has no order, so every operator that needs one takes `order_by`, or uses the position column the readers
add. Work that looks like one long window over the whole table (numbering, filling down) or over one very large group
is cut into slices, each slice is handled on its own, and one row per slice carries what the slices before it add up to.

Slices of an ascending order are ranges between splitters, values taken from one sample. A row's slice follows from its own
values, so rows are counted a range in one pass and placed in another, and nothing is written. That asks for a table which gives the
same rows each time it is read; other orders are range-sorted and written once.
"""
from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import TableError, col, free_name, require_columns
from ..session import setting, written

POSITION = "_position"
GROUP_ROWS = 5_000_000          # a group up to this size is handled by one task; larger ones are sliced
SLICE_ROWS = 5_000_000          # rows of a slice, about
TOP_ROWS = 10_000               # a longer head of the table is numbered instead of gathered in one task
_SAMPLED = 30                   # rows of a slice that its splitters are chosen from
_CUT_ACCURACY = 10_000          # of the percentile that cuts a long head off
_PLACE, _SLICE, _OFFSET, _ROW, _VALUE = "__place", "__slice", "__offset", "__row", "__sorted_by"
_BITS = 33                      # monotonically_increasing_id: partition above, row in partition below


def with_position(df: DataFrame, name: str = POSITION) -> DataFrame:
    """Add the file position of each row to a frame read directly from files.

    Parquet knows each row's index. Text formats only know the block, whose rows are read in order."""
    metadata = F.col("_metadata")
    try:
        return df.select("*", F.struct(metadata.getField("file_path").alias("file"),
                                       metadata.getField("row_index").alias("row")).alias(name))
    except Exception:
        return df.select("*", F.struct(metadata.getField("file_path").alias("file"),
                                       metadata.getField("file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("row")).alias(name))


def order_names(df: DataFrame, order_by=None) -> list[str]:
    names = list(order_by or ([POSITION] if POSITION in df.columns else []))
    if not names:
        raise TableError("row order matters here: give order_by, or read the table with its position")
    require_columns(df, names)
    return names


def _tie_break(df: DataFrame) -> list[Column]:
    """A hash of the whole row, so rows with equal order values still have one order and can be spread over tasks."""
    names = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.xxhash64(*[col(n) for n in names])]


def file_order(df: DataFrame, order_by=None) -> list[Column]:
    """Sort columns for the order of the rows. The position column is unique; given columns get a tie-break."""
    names = order_names(df, order_by)
    return [col(n) for n in names] + ([] if names == [POSITION] else _tie_break(df))


def order_value(df: DataFrame, order_by=None) -> Column:
    """The same order as one comparable value, for min_by, max_by and min."""
    return F.struct(*file_order(df, order_by))


def first_place(df: DataFrame, order_by=None) -> Column:
    """Where a row stands, for the first row of a group of equal values.

    One plain order column is used as it is: `min` of a plain value is a hash aggregate, `min` of a struct sorts first."""
    names = order_names(df, order_by)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(names[0])
    return order_value(df, order_by)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group. Reads the key columns only, and combines before the shuffle."""
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.max("__n")).first()[0] or 0


def group_limit(df: DataFrame) -> int:
    return setting(df.sparkSession, "groupRows", GROUP_ROWS)


def fits_one_task(df: DataFrame, keys: list[str]) -> bool:
    return largest_group(df, keys) <= group_limit(df)


def tie_names(df: DataFrame, order_by=None) -> list[str]:
    """The columns whose equal values could pile up in one slice: none for the position, which is unique."""
    names = order_names(df, order_by)
    return [] if names == [POSITION] else names


def _constant(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType) and value is not None:
        return F.struct(*[_constant(value[i], f.dataType).alias(f.name) for i, f in enumerate(dtype)])
    return F.lit(value).cast(dtype)


def _range_of(value: Column, splitters: list[Column]) -> Column:
    """How many splitters a value has reached, by halving: bits of the answer from the highest."""
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    if not steps:
        return F.lit(0)
    reached = lambda at, step: F.when(F.get(F.array(*splitters), at + step - 1) <= value, at + step).otherwise(at)
    return F.reduce(F.array(*[F.lit(x) for x in steps]), F.lit(0), reached)


def _read_alike(df: DataFrame, order: list[Column]) -> bool:
    """Whether the order values are the same at each reading. Places in text files follow from how the files were cut into tasks."""
    return not any(isinstance(f.dataType, T.StructType) and "block" in f.dataType.names for f in df.select(*order).schema)


def _ranged(df: DataFrame, order: list[Column], ties: list[str] | None) -> tuple[DataFrame, list[Column]]:
    """The table with the slice of every row, and its order, to which a row number is added if copies fill more than a slice."""
    spark, rows = df.sparkSession, df.count()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // setting(spark, "sliceRows", SLICE_ROWS)))
    value = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([col(n) for n in ties] if ties else order)])      # without the tie-break
    taken = df.select(value.alias("value")).sample(min(1.0, _SAMPLED * slices / max(rows, 1)), seed=1).orderBy("value")
    sample = [r.value for r in taken.collect()]
    most = max(Counter(map(str, sample)).values(), default=0)
    if ties and 2 * most * rows > len(sample) * group_limit(df) and largest_group(df, ties) > group_limit(df):
        return _ranged(with_position(written(df), _ROW), [*order, F.col(_ROW)], None)
    dtype = taken.schema["value"].dataType
    splitters = [_constant(sample[len(sample) * j // slices], dtype) for j in range(1, slices)] if sample else []
    return df.withColumn(_VALUE, value).withColumn(_SLICE, _range_of(F.col(_VALUE), splitters)).drop(_VALUE), order


def _with_order(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[Column]]:
    """The order as columns, so that a tie-break is computed once and all windows share one sort."""
    names = [f"{_VALUE}{i}" for i in range(len(order))]
    return df.select("*", *[c.alias(n) for n, c in zip(names, order)]), [F.col(n) for n in names]


def _slices(df: DataFrame, order: list[Column], ties: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """The table with the slice of every row and its place in it.

    Rows that sort alike fall into one slice. If more rows share the values of `ties` than one task should hold, they
    may be copies that no column tells apart; the table is then written first, and its row positions split them.
    `ascending` says that every order column is plain, so that ranges between splitters can take the place of a sorted copy."""
    if ascending and _read_alike(df, order):
        ranged, order = _ranged(df, order, ties)
        ranged, order = _with_order(ranged, order)
        return ranged.withColumn(_OFFSET, (F.row_number().over(W.partitionBy(_SLICE).orderBy(*order)) - 1).cast("bigint")).drop(_ROW, *[f"{_VALUE}{i}" for i in range(len(order))])
    if ties and largest_group(df, ties) > group_limit(df):
        df = with_position(written(df), _ROW)
        order = [*order, F.col(_ROW)]
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // setting(df.sparkSession, "sliceRows", SLICE_ROWS)))
    placed = written(df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn(_PLACE, F.monotonically_increasing_id()))
    place = F.col(_PLACE)
    return placed.withColumn(_SLICE, F.shiftright(place, _BITS)) \
        .withColumn(_OFFSET, place.bitwiseAND(F.lit((1 << _BITS) - 1))).drop(_PLACE, _ROW)


def _over_slices():
    """A window over a table with one row per slice, so no larger than the number of partitions."""
    return W.partitionBy(F.lit(0)).orderBy(_SLICE)


def _per_slice(df: DataFrame, values: DataFrame, how: str = "left") -> DataFrame:
    """The table with what `values` says of each slice. A slice is never NULL, and <=> keeps Spark from inferring filters from the slice's
    expression, which it may place where the expression's columns are not."""
    return df.join(F.broadcast(values.withColumnRenamed(_SLICE, "__of_slice")), F.col(_SLICE).eqNullSafe(F.col("__of_slice")), how).drop("__of_slice")


def dense_index(df: DataFrame, order: list[Column], name: str, start: int = 1, ties: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """Number all rows start, start+1, ... in the given order."""
    cut = _slices(df, order, ties, ascending)
    base = cut.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("__n")) \
        .select(_SLICE, F.coalesce(F.sum("__n").over(_over_slices().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return _per_slice(cut, base) \
        .withColumn(name, F.col("__base") + F.col(_OFFSET) + F.lit(start)).drop(_SLICE, _OFFSET, "__base")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], name: str, weight: Column | None = None,
                ties: list[str] | None = None, sliced: bool | None = None, ascending: bool = False) -> DataFrame:
    """Sum of `weight` (rows counted when None) from the first row of the group up to each row.

    The size of the largest group decides: with groups of one row the number is 1 and nothing is shuffled; groups that
    fit a task take one ordinary window; beyond that the table is sliced. A group may then span many slices, and only
    the first group of a slice can have begun earlier, so one carried sum per slice completes the result."""
    if not keys and weight is None:
        return dense_index(df, order, name, ties=ties, ascending=ascending)
    largest = largest_group(df, keys) if keys and sliced is None else None
    if largest is not None and largest <= 1 and weight is None:
        return df.withColumn(name, F.lit(1).cast("bigint"))
    if sliced is False or (largest is not None and largest <= group_limit(df)):
        window = W.partitionBy(*[col(k) for k in keys]).orderBy(*order)
        if weight is None:
            return df.withColumn(name, F.row_number().over(window).cast("bigint"))
        return df.withColumn(name, F.sum(weight).over(window.rowsBetween(W.unboundedPreceding, W.currentRow)))

    step = free_name("__weight", df.columns)
    group = [col(k) for k in keys]
    cut = _slices(df.withColumn(step, weight if weight is not None else F.lit(1).cast("bigint")), group + order, [*keys, *ties] if ties else None, ascending)
    window = W.partitionBy(_SLICE, *group).orderBy(_OFFSET).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.withColumn(name, F.sum(step).over(window))

    sizes = cut.groupBy(_SLICE).agg(F.max(_OFFSET).alias("__last"))
    pieces = cut.groupBy(_SLICE, *group).agg(F.sum(step).alias("__sum"), F.min(_OFFSET).alias("__from"), F.max(_OFFSET).alias("__to"))
    edges = _per_slice(pieces, sizes, "inner").filter((F.col("__from") == 0) | (F.col("__to") == F.col("__last")))
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.withColumn("__carry", F.sum("__sum").over(before)) \
        .filter((F.col("__from") == 0) & F.col("__carry").isNotNull()).select(_SLICE, "__to", "__carry")
    return _per_slice(local, carried) \
        .withColumn(name, F.col(name) + F.when(F.col(_OFFSET) <= F.col("__to"), F.col("__carry")).otherwise(F.lit(0))) \
        .drop(_SLICE, _OFFSET, "__to", "__carry", step)


def carry_values(df: DataFrame, values: dict[str, Column], order: list[Column], forward: bool = True,
                 ties: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """Add one column per entry of `values`: the nearest non-NULL value at or before each row (after, if not forward).

    Both ways a slice is read once: backward is forward on the slice turned round."""
    sources = {name: free_name(f"__from_{i}", df.columns) for i, name in enumerate(values)}
    wide = df.select("*", *[v.alias(sources[n]) for n, v in values.items()])
    if ascending and _read_alike(wide, order):
        cut, order = _with_order(*_ranged(wide, order, ties))
    else:
        cut, order = _slices(wide, order, ties), [F.col(_OFFSET)]
    place = F.struct(*order) if len(order) > 1 else order[0]
    window = W.partitionBy(_SLICE).orderBy(*(order if forward else [c.desc() for c in order])).rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = F.max_by if forward else F.min_by
    outer = W.partitionBy(F.lit(0)).orderBy(F.col(_SLICE) if forward else F.col(_SLICE).desc()).rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(_SLICE).agg(*[edge(F.col(s), F.when(F.col(s).isNotNull(), place)).alias(s) for s in sources.values()])
    carried = ends.select(_SLICE, *[F.last(F.col(s), ignorenulls=True).over(outer).alias(f"{s}_carried") for s in sources.values()])
    joined = _per_slice(cut, carried)
    return joined.select(*[col(n) for n in df.columns if n != _ROW], *[
        F.coalesce(F.last(F.col(s), ignorenulls=True).over(window), F.col(f"{s}_carried")).alias(name) for name, s in sources.items()])


def first_rows(df: DataFrame, order: list[Column], count: int, ties: list[str] | None = None, key: Column | None = None, nulls_first: bool = False) -> DataFrame:
    """The first `count` rows. A short list is a top-k; a long one is numbered, so no task has to hold it.

    `key` is a number by which the rows are ordered first, smaller ones earlier. Then one aggregate finds a value that enough rows,
    and few more, do not exceed, and only these are sorted and numbered."""
    if count <= setting(df.sparkSession, "topRows", TOP_ROWS):
        return df.orderBy(*order).limit(count)
    name = free_name("__index", df.columns)
    return dense_index(df if key is None else _up_to(df, key, count, nulls_first), order, name, ties=ties).filter(F.col(name) <= count).drop(name)


def _up_to(df: DataFrame, key: Column, count: int, nulls_first: bool) -> DataFrame:
    """The rows whose `key` is small enough to be among the first `count`, a few more, and all of equal key.

    The approximate percentile is off by no more than its accuracy, which is added on top; that it sufficed is counted."""
    cut, seen = 1 / _CUT_ACCURACY, df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys")).first()
    wanted = count - (seen.rows - seen["keys"]) if nulls_first else count
    if wanted >= seen["keys"]:
        return df
    low = F.lit(False)
    if wanted > 0:
        share = min(1.0, wanted / seen["keys"] + 2 * cut)
        value = df.agg(F.percentile_approx(key, share, _CUT_ACCURACY).alias("v")).first().v
        low = F.coalesce(key <= F.lit(value), F.lit(False))
        if df.agg(F.count_if(low).alias("n")).first().n < wanted:
            return df
    return df.filter(low | key.isNull() if nulls_first else low)
