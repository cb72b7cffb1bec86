"""Records of delimited files whose quoted cells hold line breaks, with many tasks to a file.

Spark hands over the lines of a file a byte range at a time, and whether a line begins inside a quoted cell depends on all that
comes before it. But there are only two answers, so each range is summed up by a function of two states: where it ends if
it began outside a quoted cell, and where if inside. These functions are put together along each file by a window over one row a
range, which gives every range its true beginning. A second pass cuts the records of each range at their true ends; only the
record that crosses from one range into the next is put together from its pieces.

A quote opens a cell only as its first character; inside, two quotes are one. Records end in a line feed, with or
without a carriage return before it; line breaks inside cells stay as they are.

So only runs of an odd number of quotes change anything. One that stands first in its cell, if there is a cell, turns the state over: outside
it opens, inside it closes. Any other one ends outside. All runs of a batch are found and added up at once, as arrays.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WHOLE, _GOES_ON, _BEGINS = 0, 1, 2          # a record; a piece of one that began in an earlier range; the first piece of one


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (bytes), file and block (where the byte range begins) of every line; the lines of a range come in order."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("block"))


def _runs(values: pa.Array, delimiter: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(line, turns) of every run of an odd number of quotes, in order: does it turn the state over, or end outside in any case?"""
    _, offsets, data = values.buffers()
    begins = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1]
    text = np.frombuffer(data, np.uint8, begins[-1]) if begins[-1] else np.empty(0, np.uint8)
    at = np.flatnonzero(text[begins[0]:] == ord('"')) + begins[0]
    line = np.searchsorted(begins, at, "right") - 1
    first = np.flatnonzero(np.diff(at, prepend=-2) + np.diff(line, prepend=-1) != 1)       # of a run: not right after a quote of the same line
    odd = first[np.diff(first, append=len(at)) % 2 == 1]
    at, line = at[odd], line[odd]
    after = at - begins[line]
    opens = after >= len(delimiter)
    for back, byte in enumerate(reversed(delimiter), 1):
        opens &= text[np.maximum(at - back, 0)] == byte
    return line, opens | (after == 0)


def _states(line: np.ndarray, turns: np.ndarray, lines: int, inside: bool) -> np.ndarray:
    """Is the end of each line inside a quoted cell, if the first one's begin is (`inside`) or is not?"""
    turned = np.cumsum(turns)
    last = np.maximum.accumulate(np.where(turns, -1, np.arange(len(turns))))        # the last run that ended outside in any case
    after = np.where(last < 0, turned + inside, turned - turned[last]) % 2 == 1
    return np.concatenate([[inside], after])[np.searchsorted(line, np.arange(lines), "right")]


def ends_inside(line: bytes, delimiter: bytes, inside: bool) -> bool:
    """Is the end of `line` inside a quoted cell, if its begin is (`inside`) or is not?"""
    return bool(_states(*_runs(pa.array([line], pa.binary()), delimiter), 1, inside)[0])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, block), lines): batches cut where a byte range ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, file = batch.column("block").to_numpy(), batch.column("file")
        code = file.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield (file[a].as_py(), int(block[a])), batch.column("value").slice(a, b - a).cast(pa.binary())


def _turns(lines: DataFrame, delimiter: bytes) -> DataFrame:
    """(file, block, from_outside, from_inside): is a range's end inside a quoted cell, for either begin?"""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, states = None, (False, True)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]])],
                                              names=["file", "block", "from_outside", "from_inside"])
        for place, values in _ranges(batches):
            if place != held:
                if held is not None:
                    yield out()
                held, states = place, (False, True)
            runs = _runs(values, delimiter)
            states = tuple(bool(_states(*runs, len(values), x)[-1]) for x in states)
        if held is not None:
            yield out()
    return lines.mapInArrow(turn, "file string, block bigint, from_outside boolean, from_inside boolean")


def _begins_inside(turns: DataFrame) -> DataFrame:
    """(file, block) of the ranges that begin inside a quoted cell.

    A range turns both states into one, or keeps them, or swaps them. So a range begins as the last one before it that
    knows its end says (outside, if none does), swapped as often as the ranges in between swap."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    known = F.col("from_outside") == F.col("from_inside")
    swaps = turns.withColumn("swaps", F.sum((~known & F.col("from_outside")).cast("int")).over(W.partitionBy("file").orderBy("block")))
    last = F.last(F.when(known, F.struct(F.col("from_outside").alias("inside"), "swaps")), ignorenulls=True).over(before)
    here = swaps.withColumn("last", last).withColumn("until", F.coalesce(F.lag("swaps").over(W.partitionBy("file").orderBy("block")), F.lit(0)))
    since = F.col("until") - F.coalesce("last.swaps", F.lit(0))
    return here.where((F.coalesce("last.inside", F.lit(False)).cast("int") + since) % 2 == 1).select("file", "block")


def _joined(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """The lines up to each end, one value for each end, put together with the line feeds between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1]), pa.int32()), values), b"\n")


def _cut(lines: DataFrame, delimiter: bytes, inside, wholes: bool, crossing: bool) -> DataFrame:
    """(file, block, row, head, piece, value): the records that lie in one range (`wholes`) and the pieces of those that do not (`crossing`).
    row: number in the range; head: the first record of the file that is not blank."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, is_open, kind, row, headed = None, False, _WHOLE, 0, True
        pieces: list[pa.Array] = []

        def out(values: pa.Array, what: int, head: int = -1) -> pa.RecordBatch:
            """Values from number `row` on, of which the one at `head` is the head."""
            n = len(values)
            at = np.arange(n)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(held[0]), n), pa.repeat(pa.scalar(held[1], pa.int64()), n), pa.array(at + row, pa.int64()),
                                               pa.array(at == head), pa.repeat(pa.scalar(what, pa.int32()), n), values.cast(pa.binary())],
                                              names=["file", "block", "row", "head", "piece", "value"])

        def last() -> Iterator[pa.RecordBatch]:
            """The piece that is open where a range ends."""
            if pieces and crossing:
                values = pa.concat_arrays(pieces)
                value, what = _joined(values, np.array([len(values) - 1])), kind or _BEGINS
                yield out(value, what, 0 if not headed and what != _GOES_ON and value[0].as_py().strip() else -1)
            pieces.clear()
        for place, values in _ranges(batches):
            if place != held:
                yield from last()
                held, is_open, row, headed = place, place in inside.value, 0, place[1] != 0
                kind = _GOES_ON if is_open else _WHOLE
            states = _states(*_runs(values, delimiter), len(values), is_open)
            is_open, ends = bool(states[-1]), np.flatnonzero(~states)
            if not len(ends):
                pieces.append(values)
                continue
            done, rest = values.slice(0, ends[-1] + 1), values.slice(ends[-1] + 1)
            if pieces:                                  # the first record began in an earlier batch
                ends = ends + sum(map(len, pieces))
                done = pa.concat_arrays([*pieces, done])
            pieces = [rest] if len(rest) else []
            if kind == _GOES_ON:
                if crossing:
                    yield out(_joined(done.slice(0, ends[0] + 1), ends[:1]), _GOES_ON)
                done, ends, kind, row = done.slice(ends[0] + 1), ends[1:] - ends[0] - 1, _WHOLE, row + 1
            if not len(ends):
                continue
            if wholes or not headed:
                records = _joined(done, ends) if len(done) > len(ends) else done
                head = next((i for i, v in enumerate(records) if v.as_py().strip()), -1) if not headed else -1
                headed = headed or head >= 0
                if wholes:
                    yield out(records, _WHOLE, head)
            row += len(ends)
        yield from last()
    return lines.mapInArrow(cut, "file string, block bigint, row bigint, head boolean, piece int, value binary")


def quoted_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """file, block, row, head, value: the bytes of every record without its line end; blank ones too. (file, block, row) is the order.

    A pass over the files tells where ranges begin, another cuts the records; if some cross ranges, a third hands on only their pieces. What
    reaches the driver is one entry for each byte range that begins inside a quoted cell."""
    lines, sep = raw_lines(spark, path), delimiter.encode()
    inside = frozenset((r.file, r.block) for r in _begins_inside(_turns(lines, sep)).collect())
    known, names = spark.sparkContext.broadcast(inside), ["file", "block", "row", "head", "value"]
    whole = _cut(lines, sep, known, True, not inside).select(*names)
    if not inside:                                      # a file's last record may be open: a first piece that nothing follows
        return whole.withColumn("value", _without_return("value"))
    order = W.partitionBy("file").orderBy("block", "piece")
    crossing = _cut(lines, sep, known, False, True).withColumn("record", F.sum((F.col("piece") == _BEGINS).cast("int")).over(order))
    pieces = crossing.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "piece", "row", "head", "value"))).alias("p"))
    first = F.col("p")[0]
    joined = pieces.select("file", *[first[n].alias(n) for n in ("block", "row", "head")],
                           F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["value"])), "0A")).alias("value"))
    return whole.union(joined).withColumn("value", _without_return("value"))


def _without_return(name: str):
    """A binary value without a carriage return at its end."""
    value = F.col(name)
    return F.when(F.hex(F.substring(value, -1, 1)) == "0D", F.substring(value, F.lit(1), F.octet_length(value) - 1)).otherwise(value)
