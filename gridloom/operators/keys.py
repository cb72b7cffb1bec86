"""Minimal keys: the smallest column combinations that identify every row."""
from __future__ import annotations

import functools
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import TableError, canonical_text, col, free_name, is_missing, present, require_columns, type_of
from ..plans.hitting_sets import OutOfTime, minimal_hitting_sets, smallest_sets
from ..plans.order import file_order, running_sum, tie_names
from ..session import written
from .dedupe import distinct_rows, exact_copies

SAMPLE = 50_000                             # rows of the sample on the driver
SAMPLE_CELLS = 2_000_000                    # its cells at most (16 MB of hashes)
SCREEN = 5_000_000                          # rows of the second screen
TOGETHER = 200                              # candidates tried by one job at most
TAGGED_ROWS = 100_000_000                   # rows times candidates of one job, about
SHARES = 64                                 # parts of the key space, one of which is looked at on large tables
PAIRS = 2_000                               # row pairs compared at once for their difference sets
WITNESSES = 16                              # repeated keys looked up for each refuted candidate


@dataclass
class KeySearch:
    """`tested`: candidates tried on the table or its sample."""
    keys: list[list[str]] = field(default_factory=list)
    truncated: bool = False
    reason: str = ""
    tested: int = 0


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns h0, g0, h1, g1, ..: two 64-bit hashes a column, seeded with the column and true to missing cells.

    The fingerprint of a combination is the exclusive or of its columns' hashes, so a row is hashed once, however many
    combinations are tried on it."""
    cells = [(is_missing(col(n), type_of(df, n)), present(col(n), type_of(df, n))) for n in columns]
    return df.select(*[F.xxhash64(F.lit(2 * i + seed), *cell).alias(f"{letter}{i}") for i, cell in enumerate(cells) for seed, letter in ((0, "h"), (1, "g"))])


def _share(df: DataFrame, columns: list[str], rows: int, wanted: int) -> DataFrame:
    """About `wanted` of the `rows` rows, chosen by a hash of the row: a filter, so no task gathers them."""
    parts = -(-rows // max(wanted, 1))
    return df if parts <= 1 else df.filter(F.pmod(F.xxhash64(*[col(n) for n in columns]), F.lit(parts)) == 0)


def _members(key: int) -> list[int]:
    return [i for i in range(key.bit_length()) if key >> i & 1]


class Sample:
    """Hashes of some rows, a line a column, and the difference sets they show. Bounded in rows and in cells."""

    def __init__(self, df: DataFrame, columns: list[str], rows: int, wanted: int):
        most = max(1, min(wanted, SAMPLE, SAMPLE_CELLS // len(columns)))
        held = _hashed(_share(df, columns, rows, most).limit(2 * most), columns).select(*[f"h{i}" for i in range(len(columns))]).toPandas()
        self.cells = np.array([held[f"h{i}"].to_numpy("int64") for i in range(len(columns))])
        self.weights = np.random.default_rng(7).integers(1, 1 << 62, len(columns), dtype=np.int64) * 2 + 1

    def differences(self, a: np.ndarray, b: np.ndarray) -> set[int]:
        """The difference sets of the row pairs (a, b)."""
        out: set[int] = set()
        for start in range(0, len(a), PAIRS * 10):
            unlike = self.cells[:, a[start:start + PAIRS * 10]] != self.cells[:, b[start:start + PAIRS * 10]]
            packed = np.packbits(unlike, axis=0, bitorder="little")
            out |= {int.from_bytes(column.tobytes(), "little") for column in np.unique(packed, axis=1).T}
        return out

    def neighbours(self) -> set[int]:
        """Difference sets of rows that stand next to each other in the order of one column, then of the others, those with
        the fewest values first: such rows agree in much."""
        if self.cells.shape[1] < 2:
            return set()
        few = np.argsort([len(np.unique(line)) for line in self.cells], kind="stable")
        out: set[int] = set()
        for first in range(len(self.cells)):
            order = np.lexsort([self.cells[i] for i in [*few[few != first][::-1], first]])
            out |= self.differences(order[1:], order[:-1])
        return out

    def refuted(self, key: int) -> set[int]:
        """Difference sets of row pairs that agree in all columns of `key`; empty if the sample has none."""
        members = _members(key)
        mixed = (self.cells[members] * self.weights[members][:, None]).sum(axis=0)
        order = np.argsort(mixed, kind="stable")
        like = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
        if not len(like):
            return set()
        return {d for d in self.differences(order[like + 1][:PAIRS], order[like][:PAIRS]) if not d & key}


def _refuted(hashed: DataFrame, width: int, candidates: list[int], shares: int = 1) -> dict[int, set[int]]:
    """The candidates that repeat, each with difference sets of rows that agree in it.

    One aggregate of fingerprints, tagged with the candidate, finds the repeats of all of them and names two rows of each
    by a hash of the row; a few rows a candidate are then looked up and compared column by column. With `shares`, only
    fingerprints in one of that many parts of the key space are looked at: all copies of a key fall into the same part."""
    mix = lambda letter, key: functools.reduce(Column.bitwiseXOR, [F.col(f"{letter}{j}") for j in _members(key)])
    prints = F.array(*[F.struct(F.lit(i).alias("i"), mix("h", key).alias("a"), mix("g", key).alias("b")) for i, key in enumerate(candidates)])
    named = hashed.withColumn("row", F.xxhash64(*[f"h{j}" for j in range(width)]))
    tagged = named.select("row", F.explode(prints).alias("p")).select("row", "p.i", "p.a", "p.b")
    if shares > 1:
        tagged = tagged.filter(F.pmod("a", F.lit(shares)) == 0)
    groups = tagged.groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("x"), F.max("row").alias("y")).filter("n > 1")
    some = groups.withColumn("nth", F.row_number().over(W.partitionBy("i").orderBy("a", "b"))).filter(F.col("nth") <= WITNESSES).select("i", "x", "y").collect()
    if not some:
        return {}
    asked = hashed.sparkSession.createDataFrame([(row,) for row in {row for r in some for row in (r.x, r.y)}], "row bigint")     # 2 * WITNESSES a candidate at most
    cells = {r.row: r[1:] for r in named.join(F.broadcast(asked), "row").dropDuplicates(["row"]).select("row", *[f"h{j}" for j in range(width)]).collect()}
    out: dict[int, set[int]] = {}
    for r in some:
        key, unlike = candidates[r.i], sum(1 << j for j, (x, y) in enumerate(zip(cells[r.x], cells[r.y])) if x != y)
        if not unlike & key:                            # else two fingerprints collided
            out.setdefault(key, set()).add(unlike)
    return out


def find_minimal_keys(df: DataFrame, columns: list[str] | None = None, max_size: int | None = None, max_keys: int | None = None,
                      max_candidates: int | None = None, seconds: float | None = None, sample_rows: int = SAMPLE, screen_rows: int = SCREEN) -> KeySearch:
    """All minimal keys, smallest first. Missing equals missing.

    The difference sets of sampled row pairs have minimal hitting sets; these, and no other combinations, are tried on the
    sample, on large tables on a larger sample and on a part of the key space, and at last on all rows. Two rows that agree in
    a candidate refute it, and their difference set, which it does not meet, joins the family; the hitting sets are then
    found anew. A candidate that no row pair refutes is a minimal key, because every column of it is the only one to meet some
    difference set. The search ends when nothing was refuted and no larger hitting set exists.

    Without limits all minimal keys are found; wide tables without a small key can have very many. `truncated` says that
    a limit took effect, `reason` which ones: a key not found may exist."""
    columns = list(dict.fromkeys(columns or df.columns))
    require_columns(df, columns)
    deadline = time.monotonic() + seconds if seconds else None
    df = df.select(*[col(n) for n in columns])
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[e for i, n in enumerate(columns) for e in (
        F.count(present(col(n), type_of(df, n))).alias(f"n{i}"), F.min(present(col(n), type_of(df, n))).alias(f"a{i}"),
        F.max(present(col(n), type_of(df, n))).alias(f"b{i}"))]).first()
    rows = seen.rows
    if rows <= 1:
        return KeySearch([[n] for n in columns][:max_keys])
    constant = lambda i: seen[f"n{i}"] == 0 or (seen[f"n{i}"] == rows and seen[f"a{i}"] == seen[f"b{i}"])           # noqa: E731
    usable = [n for i, n in enumerate(columns) if not constant(i)]
    if not usable:
        return KeySearch()
    sample = Sample(df, usable, rows, sample_rows)
    hashed = _hashed(df, usable)
    stages = [(hashed, rows, 1)]
    if rows > screen_rows:
        spread = df.sparkSession.sparkContext.defaultParallelism
        screen = written(_hashed(_share(df, usable, rows, screen_rows).repartition(spread), usable))
        stages = [(screen, screen_rows, 1), (hashed, rows // SHARES, SHARES), *stages]

    search, reasons = KeySearch(), []
    family = smallest_sets([*sample.neighbours(), (1 << len(usable)) - 1])       # two rows differ somewhere
    sure: set[int] = set()                              # unique in all rows
    likely: set[int] = set()                            # unique in the sample
    late = lambda: deadline is not None and time.monotonic() > deadline                                         # noqa: E731

    def on_all_rows(candidates: list[int]) -> set[int]:
        """Difference sets that refute some of `candidates`, which are tried together; those not refuted are sure."""
        shown: set[int] = set()
        for table, size, shares in stages:
            alive, at = [], 0
            while at < len(candidates):
                many = max(1, min(TOGETHER, TAGGED_ROWS // max(size, 1)))
                part = candidates[at:at + many]
                at += many
                if late():
                    return shown
                bad = _refuted(table, len(usable), part, shares)
                shown |= set().union(*bad.values())
                alive += [k for k in part if k not in bad]
                if shares == 1 and table is hashed:
                    sure.update(k for k in part if k not in bad)
            candidates = alive
        return shown

    def on_the_sample(found: list[int]) -> set[int]:
        """The same on the sample; stops at the limit of candidates."""
        shown: set[int] = set()
        for key in found:
            if key not in likely and (max_candidates is None or search.tested < max_candidates):
                search.tested += 1
                refuted = sample.refuted(key)
                shown |= refuted
                if not refuted:
                    likely.add(key)
        return shown

    size, found, larger = 1, [], True
    try:
        while True:
            found, larger = minimal_hitting_sets(family, size, deadline)
            found.sort(key=lambda k: (k.bit_count(), _members(k)))
            new = on_the_sample(found)
            spent = max_candidates is not None and search.tested >= max_candidates
            enough = max_keys is not None and len(found) >= max_keys
            if not new and larger and not spent and not enough and 0 not in family and (max_size is None or size < max_size):
                size += 1                               # all of this size stand on the sample: look at larger ones
                continue
            if not new:
                asked = [k for k in found[:max_keys] if k in likely and k not in sure]
                new = on_all_rows(asked)
                if late():
                    raise OutOfTime
                if not new:
                    break
            family = smallest_sets([*family, *new])
        if not all(k in sure or k in likely for k in found):
            reasons.append(f"no more than {max_candidates:,} candidates")
        if max_keys is not None and (len(found) > max_keys or (len(found) == max_keys and larger)):
            reasons.append(f"no more than {max_keys} keys")
        elif larger and max_size is not None and size >= max_size and 0 not in family:
            reasons.append(f"no combinations of more than {max_size} columns")
    except OutOfTime:
        reasons.append(f"no longer than {seconds} seconds")
    search.keys = [[usable[i] for i in _members(k)] for k in sorted(sure, key=lambda k: (k.bit_count(), _members(k)))][:max_keys]
    search.truncated, search.reason = bool(reasons), "; ".join(reasons)
    return search


@dataclass
class KeyReport:
    """Keys of the table as it is, and of the table without its exact copies."""
    keys: list[list[str]]
    keys_after_dedup: list[list[str]]
    skipped_columns: list[str]
    rows: int
    duplicate_rows: int
    truncated: bool
    reason: str


def find_keys(df: DataFrame, columns: list[str] | None = None, allow_missing: bool = False, **limits) -> KeyReport:
    """Key search that is honest about copies: with exact duplicate rows nothing identifies every row, so `keys` is
    empty and the keys of the distinct rows stand apart. Columns with missing cells are skipped unless allowed."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(present(col(n), type_of(df, n))).alias(f"n{i}") for i, n in enumerate(columns)]).first()
    skipped = [] if allow_missing else [n for i, n in enumerate(columns) if seen[f"n{i}"] < seen.rows]
    usable = [n for n in columns if n not in skipped]
    if not usable:
        raise TableError("all of these columns have gaps; allow gaps or name other columns")
    copies = exact_copies(df).first().duplicate_rows
    search = find_minimal_keys(written(distinct_rows(df)) if copies else df, usable, **limits)
    return KeyReport([] if copies else search.keys, search.keys if copies else [], skipped, seen.rows, copies, search.truncated, search.reason)


def unique_id(df: DataFrame, columns: list[str] | None = None, allow_missing: bool = False, order_by=None, **limits) -> DataFrame:
    """Add `Unique_ID`, the texts of the first minimal key joined by |||, and `_is_duplicate`, true for a row that
    repeats an earlier one. Every row is kept."""
    report = find_keys(df, columns, allow_missing, **limits)
    found = report.keys or report.keys_after_dedup
    if not found:
        raise TableError("these columns hold no key" + (f" within the limits ({report.reason})" if report.truncated else ""))
    return add_unique_id(df, found[0], order_by, copies=report.duplicate_rows > 0)


def add_unique_id(df: DataFrame, key: list[str], order_by=None, copies: bool = True) -> DataFrame:
    """`copies`: False where it is known that no row repeats another, which saves the numbering."""
    require_columns(df, key)
    id_name = free_name("Unique_ID", df.columns)
    copy_name = free_name("_is_duplicate", [*df.columns, id_name])
    nth = free_name("__nth", df.columns)
    values = F.concat_ws("|||", *[F.coalesce(canonical_text(col(n), type_of(df, n)), F.lit("")) for n in key])
    numbered = df.withColumn(nth, F.lit(1)) if not copies else running_sum(df, list(df.columns), file_order(df, order_by), nth, ties=tie_names(df, order_by))
    return numbered.select(*[col(n) for n in df.columns], values.alias(id_name), (F.col(nth) > 1).alias(copy_name))
