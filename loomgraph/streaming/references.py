"""The current orphan report kept up to date over a stream of change deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_orphans(deltas: DataFrame) -> DataFrame:
    """Rows (kind, key, n_refs, n_exist, orphan) for each key that a batch of (kind, key, d_refs, d_exist) touches.

    Signed reference and existence counts are the whole state of a key, so records may arrive late, go and come back.
    Counts are summed per batch before they reach the state. Run it in update mode.
    """

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        refs, exist = state.get if state.exists else (0, 0)
        for f in frames:
            refs += int(f["d_refs"].sum())
            exist += int(f["d_exist"].sum())
        state.update((refs, exist))
        yield pd.DataFrame([{"kind": key[0], "key": key[1], "n_refs": refs, "n_exist": exist, "orphan": refs > 0 and exist <= 0}])

    rows = deltas.select("kind", "key", "d_refs", "d_exist").fillna(0)
    return rows.groupBy("kind", "key").applyInPandasWithState(add, "kind string, key string, n_refs bigint, n_exist bigint, orphan boolean", "refs bigint, exist bigint", "update", GroupStateTimeout.NoTimeout)
