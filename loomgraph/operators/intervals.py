"""Overlapping and gapped time intervals: continuous periods and the gaps between them, per key.

Every key keeps an ordered map of disjoint intervals. An insertion finds the intervals it meets by binary search and
replaces them by their union, which also closes or narrows the gaps around it. The union is associative, so each input
partition first folds its own rows (`_combine`) and only disjoint intervals are shuffled: a key that holds a third of
all rows arrives as a few intervals per input partition.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Day number that stands for "no end"; above every real date (9999-12-31 is 2932896).
OPEN = 2_932_896

#: Intervals held by one partition's fold before they are passed on; bounds a Python worker's memory.
FOLD_LIMIT = 200_000


class IntervalMap:
    """Disjoint half-open intervals in order; touching ones are joined."""

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, lo: int, hi: int) -> None:
        if hi <= lo:
            return
        i = bisect_left(self.ends, lo)
        j = bisect_right(self.starts, hi)
        if i < j:
            lo, hi = min(lo, self.starts[i]), max(hi, self.ends[j - 1])
        self.starts[i:j] = [lo]
        self.ends[i:j] = [hi]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def tidy_relation(c: Column) -> Column:
    """Upper case with underscores: case, outer white space and the separators of words do not count."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_\-]+", "_"))


def _schema(keys: list[str]) -> str:
    return ", ".join(f"`{k}` string" for k in keys)


def _combine(keys: list[str]):
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, IntervalMap] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(*k, lo, hi) for k, m in held.items() for lo, hi in m.periods()]
            cols = list(zip(*rows)) if rows else [()] * (n + 2)
            kinds = [pa.string()] * n + [pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [*keys, "lo", "hi"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                m = held.get(row[:n])
                if m is None:
                    m = held[row[:n]] = IntervalMap()
                m.insert(row[n], row[n + 1])
            size += b.num_rows
            if size >= FOLD_LIMIT:
                yield flush()
                held, size = {}, 0
        yield flush()

    return fold


def _keyed(keys: list[str]):
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, IntervalMap(), []

        def close() -> None:
            if current is None:
                return
            out.extend((*current, "period", lo, hi) for lo, hi in state.periods())
            out.extend((*current, "gap", lo, hi) for lo, hi in state.gaps())

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * (n + 3)
            kinds = [pa.string()] * (n + 1) + [pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [*keys, "kind", "lo", "hi"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                if row[:n] != current:
                    close()
                    current, state = row[:n], IntervalMap()
                state.insert(row[n], row[n + 1])
            if len(out) >= 10_000:
                yield emit()
                out.clear()
        close()
        yield emit()

    return run


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows (keys..., kind, from_day, to_day) with kind 'period' or 'gap'; to_day is null for a period without end.

    Intervals include `start` and exclude `end`; a null or 9999-12-31 end is open. Rows with a null start or an end not
    after it are left out. Overlapping, nested and touching intervals form one period; repeated rows change nothing.
    A null key value is a key of its own. An empty input gives no rows. Columns besides keys, start and end are ignored.
    """
    key_cols = [F.col(k).cast("string").alias(k) for k in keys]
    lo, hi = F.unix_date(F.col(start).cast("date")), F.unix_date(F.col(end).cast("date"))
    rows = df.select(*key_cols, lo.alias("lo"), F.coalesce(F.least(hi, F.lit(OPEN)), F.lit(OPEN)).alias("hi")).where("lo < hi")
    folded = rows.mapInArrow(_combine(keys), f"{_schema(keys)}, lo int, hi int")
    placed = folded.repartition(*keys).sortWithinPartitions(*keys, "lo")
    out = placed.mapInArrow(_keyed(keys), f"{_schema(keys)}, kind string, lo int, hi int")
    return out.select(
        *keys, "kind", F.date_from_unix_date("lo").alias("from_day"), F.when(F.col("hi") < OPEN, F.date_from_unix_date("hi")).alias("to_day")
    )


def fact_periods(facts: DataFrame) -> DataFrame:
    """Periods and gaps of `facts` per source, relation (tidied) and target."""
    return periods_and_gaps(
        facts.select("source", tidy_relation(F.col("relation")).alias("relation"), "target", "valid_from", "valid_to"),
        ["source", "relation", "target"],
    )
