"""Periods and gaps kept up to date over a stream of facts, in keyed state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.operators.intervals import OPEN, IntervalMap, tidy_relation

_EPOCH = dt.date(1970, 1, 1)


def _day(n: int) -> str:
    return "" if n >= OPEN else (_EPOCH + dt.timedelta(days=n)).isoformat()


def stream_periods(facts: DataFrame, keys: list[str]) -> DataFrame:
    """For each key touched by a batch: n_periods, its periods and gaps ('from/to', no end left empty), after the batch.

    The state of a key is its ordered interval map, two arrays of day numbers; late and repeated facts fall into place.
    Rows that do not count are those of the batch operator. Run it in update mode.
    """

    def insert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = IntervalMap()
        if state.exists:
            starts, ends = state.get
            m.starts, m.ends = list(starts), list(ends)
        for f in frames:
            for lo, hi in zip(f["lo"], f["hi"]):
                m.insert(int(lo), int(hi))
        state.update((m.starts, m.ends))
        row = dict(zip(keys, key))
        row |= {"n_periods": len(m.starts), "periods": [f"{_day(a)}/{_day(b)}" for a, b in m.periods()], "gaps": [f"{_day(a)}/{_day(b)}" for a, b in m.gaps()]}
        yield pd.DataFrame([row])

    cols = [(tidy_relation(F.col(k)) if k == "relation" else F.col(k).cast("string")).alias(k) for k in keys]
    lo, hi = F.unix_date("valid_from"), F.unix_date("valid_to")
    rows = facts.select(*cols, lo.alias("lo"), F.coalesce(F.least(hi, F.lit(OPEN)), F.lit(OPEN)).alias("hi")).where("lo < hi")
    schema = ", ".join(f"`{k}` string" for k in keys) + ", n_periods int, periods array<string>, gaps array<string>"
    return rows.groupBy(*keys).applyInPandasWithState(insert, schema, "starts array<int>, ends array<int>", "update", GroupStateTimeout.NoTimeout)
