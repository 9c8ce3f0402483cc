"""Filling fixed-capacity containers with items of varying length.

The lengths' histogram (at most `capacity` rows, whatever the corpus) defines a configuration linear program: a
configuration is a multiset of lengths that fits a container, and as few containers as possible must cover all counts.
Multiplicative weights solve it: each round prices the lengths, a knapsack dynamic program finds the most valuable
configuration, and covered lengths become cheaper. The solution is rounded down, the program is solved again over what
is left, and the last remainder is filled container by container with the fullest combination (subset sums). Items are
then numbered per length, in buckets, and looked up in the plan; no task ever holds all items of a length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, count), ...), times


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable configuration: unbounded knapsack by dynamic programming over the capacity."""
    by_len = np.full(capacity + 1, -np.inf)
    by_len[lengths] = values
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    least = int(lengths.min())
    for c in range(least, capacity + 1):
        gain = best[c - least :: -1] + by_len[least : c + 1]  # length `least`, `least` + 1, ... at the end
        k = int(np.argmax(gain))
        if gain[k] > best[c - 1]:
            best[c], took[c] = gain[k], k + least
        else:
            best[c] = best[c - 1]
    config: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            config[int(took[c])] = config.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return config


def fractional(hist: dict[int, int], capacity: int, rounds: int, eps: float = 0.25) -> dict[tuple, float]:
    """Multiplicative weights for the covering program: configurations with their fractional numbers."""
    lengths = np.array(sorted(hist), dtype=np.int64)
    need = np.array([hist[int(x)] for x in lengths], dtype=np.float64)
    spot = {int(x): k for k, x in enumerate(lengths)}
    covered, bought = np.zeros(len(need)), {}
    for _ in range(rounds):
        left = np.clip(1 - covered / need, 0, None)
        if left.max() <= 0:
            break
        # A length's price falls with its coverage; its own size keeps large and small lengths in step.
        values = lengths * np.exp(-eps * 8 * (covered / need)) * (left > 0)
        config = price(np.where(values > 0, values, -1.0), lengths, capacity)
        if not config:
            break
        step = min((need[spot[x]] - covered[spot[x]]) / a for x, a in config.items())
        step = max(min(step, eps * min(need[spot[x]] / a for x, a in config.items())), 1e-9)
        for x, a in config.items():
            covered[spot[x]] += a * step
        key = tuple(sorted(config.items(), reverse=True))
        bought[key] = bought.get(key, 0.0) + step
    return bought


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest item left, and the items that best fill the rest: subset sums as bits, longest lengths preferred."""
    first = max(left)
    room, counts = capacity - first, dict(left)
    counts[first] -= 1
    lengths = [x for x in sorted(counts, reverse=True) if x <= room and counts[x] > 0]
    mask, reach, states = (1 << (room + 1)) - 1, 1, []
    used: list[tuple[int, int]] = []
    for x in lengths:
        for _ in range(min(counts[x], room // x)):
            states.append(reach)
            used.append((x, 1))
            reach |= (reach << x) & mask
        if reach >> room & 1:
            break
    total, config = reach.bit_length() - 1, {first: 1}
    for k in range(len(used) - 1, -1, -1):
        if not states[k] >> total & 1:
            x = used[k][0]
            config[x] = config.get(x, 0) + 1
            total -= x
    return config


def plan_containers(hist: dict[int, int], capacity: int, rounds: int = 200, solves: int = 4) -> Plan:
    """Configurations and how often each is used; together they hold exactly the counts of `hist`."""
    left = {x: n for x, n in hist.items() if n > 0}
    plan: Plan = []
    for _ in range(solves):
        if sum(left.values()) < 4 * len(left) or not left:
            break
        for key, times in sorted(fractional(left, capacity, rounds).items(), key=lambda kv: (-kv[1], kv[0])):
            whole = min([int(times + 1e-6), *(left.get(x, 0) // a for x, a in key)])
            if whole > 0:
                plan.append((key, whole))
                for x, a in key:
                    left[x] -= a * whole
        left = {x: n for x, n in left.items() if n > 0}
    while left:
        config = fullest(left, capacity)
        times = min(left[x] // a for x, a in config.items())
        plan.append((tuple(sorted(config.items(), reverse=True)), times))
        for x, a in config.items():
            left[x] -= a * times
            if not left[x]:
                del left[x]
    return plan


def _slots(plan: Plan) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first container, items per container, offset in the container)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    container = 0
    for config, times in plan:
        offset = 0
        for x, a in config:
            rows.setdefault(x, []).append((given.get(x, 0), container, a, offset))
            given[x] = given.get(x, 0) + a * times
            offset += a * x
        container += times
    return {x: np.asarray(r, dtype=np.int64) for x, r in rows.items()}


def fill_containers(items: DataFrame, capacity: int = 2048, bucket_rows: int = 200_000) -> DataFrame:
    """Rows (item_id, piece, n, item_from, container, at): where every item, or piece of an oversized one, goes.

    `items` has item_id and n; null, zero and negative sizes are left out. An item is split only if it alone exceeds the
    capacity, into full pieces and a remainder. item_from is the piece's offset in its item, `at` its offset in the
    container. Repeated item_ids are items of their own, in any order. An empty table gives no rows.
    """
    size = F.col("n").cast("bigint")
    pieces = items.where(size > 0).select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / capacity))).alias("piece"), size.alias("size"))
    pieces = pieces.select("item_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece") * capacity).alias("n"))
    pieces = cut(pieces)  # sizes come from a tokenizer: computed once, used for the histogram and the assignment
    hist = {int(r["n"]): int(r["k"]) for r in pieces.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most `capacity` rows
    slots = _slots(plan_containers(hist, capacity))
    buckets = max(1, -(-sum(hist.values()) // bucket_rows))
    p = pieces.withColumn("b", F.pmod(F.xxhash64("item_id", "piece"), F.lit(buckets)).cast("int"))
    counts = p.groupBy("n", "b").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("n", "b", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("n", "b").orderBy("item_id", "piece")) - 1
    ranked = p.withColumn("r", rank.cast("bigint")).join(base, ["n", "b"]).select("item_id", "piece", "n", (F.col("base") + F.col("r")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, rank_ = b["n"].to_numpy(), b["rank"].to_numpy()
            container, at = np.empty(len(b), dtype=np.int64), np.empty(len(b), dtype=np.int64)
            for x in np.unique(n):
                own, s = np.flatnonzero(n == x), slots[int(x)]
                row = s[np.searchsorted(s[:, 0], rank_[own], side="right") - 1]
                inside = rank_[own] - row[:, 0]
                container[own] = row[:, 1] + inside // row[:, 2]
                at[own] = row[:, 3] + inside % row[:, 2] * x
            yield b.assign(container=container, at=at)[["item_id", "piece", "n", "container", "at"]]

    kind = dict(items.dtypes)["item_id"]
    out = ranked.mapInPandas(place, f"item_id {kind}, piece bigint, n bigint, container bigint, at bigint")
    return out.select("item_id", "piece", "n", (F.col("piece") * capacity).alias("item_from"), "container", "at")
