"""What an operator returns: the table, side tables and counts. All of them are frames to be
read when wanted; an operator that needs the order of rows, or looks at sizes first, runs those jobs when it is called."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Result:
    df: DataFrame
    extra: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    metrics: DataFrame | None = None

    def side(self, name: str) -> DataFrame:
        """A side table such as "removed". Some are planned only when asked for, because planning them runs a check."""
        table = self.extra[name]
        return table() if callable(table) else table
