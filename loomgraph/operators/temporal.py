"""Facts with two times: when they hold and when they were known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations that one source at a time can hold to a target.
EXCLUSIVE = ["CTO_OF", "CEO_OF"]
FACTS = "fact_id bigint, source string, relation string, target string, valid_from date, valid_to date, recorded_at date, invalidated_at date, prior_valid_to date"


def empty_facts(spark) -> DataFrame:
    return spark.createDataFrame([], FACTS)


def is_valid(at: Column, known_at: Column | None = None) -> Column:
    """Did a fact hold at `at`, by what was recorded until `known_at` (null or None: by what is known now)?"""
    end = F.col("valid_to")
    seen = F.lit(True)
    if known_at is not None:
        end = F.when(known_at.isNotNull() & (F.col("invalidated_at") > known_at), F.col("prior_valid_to")).otherwise(end)
        seen = known_at.isNull() | (F.coalesce("recorded_at", "valid_from") <= known_at)
    return F.coalesce(seen & (F.col("valid_from") <= at) & (end.isNull() | (at < end)), F.lit(False))


def as_of(facts: DataFrame, at: str, known_at: str | None = None) -> DataFrame:
    """The facts that hold on a day, optionally as believed on another. A filter: it reaches the scan."""
    return facts.where(is_valid(F.lit(at).cast("date"), F.lit(known_at).cast("date") if known_at else None))


def holders(facts: DataFrame, at: str, known_at: str | None = None) -> DataFrame:
    """Rows (relation, target, source): who holds a relation to a target on a day."""
    return as_of(facts, at, known_at).select("relation", "target", "source").distinct()


def replay(facts: DataFrame, exclusive: list[str] = EXCLUSIVE) -> DataFrame:
    """Facts added one after another in the order of recorded_at, fact_id, as FACTS.

    A new fact of an exclusive relation closes other sources' facts on the same target that are not yet invalidated and
    end after its start (or never): their end becomes its start, the old end is remembered. Arrival is taken for time
    order, as the reference semantics have it: a late fact with an early start ends later facts before they begin.
    Rows of a key arrive sorted; a task holds only the open facts of one key, never a group.
    """
    rows = facts.select("fact_id", "source", "relation", "target", "valid_from", "valid_to", F.coalesce("recorded_at", "valid_from").alias("recorded_at")).where("fact_id is not null and valid_from is not null").distinct()
    plain = rows.where(~F.coalesce(F.col("relation").isin(exclusive), F.lit(False))).select("*", F.lit(None).cast("date").alias("invalidated_at"), F.lit(None).cast("date").alias("prior_valid_to"))
    names = [x.split()[0] for x in FACTS.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                f, source, relation, target, lo, hi, rec = r
                hi = None if hi is None or hi is pd.NaT else hi
                if (relation, target) != key:
                    out += held
                    key, held = (relation, target), []
                left = []
                for h in held:
                    if h[1] != source and (h[5] is None or h[5] > lo):
                        out.append((*h[:5], lo, h[6], rec, h[5]))
                    else:
                        left.append(h)
                held = [*left, (f, source, relation, target, lo, hi, rec, None, None)]
            yield pd.DataFrame(out, columns=names, dtype=object)
        yield pd.DataFrame(held, columns=names, dtype=object)

    some = rows.where(F.col("relation").isin(exclusive))
    placed = some.repartition("relation", "target").sortWithinPartitions("relation", "target", "recorded_at", "fact_id")
    return placed.mapInPandas(fold, FACTS).unionByName(plain.select(*names))


def succession(facts: DataFrame, exclusive: list[str] = EXCLUSIVE) -> DataFrame:
    """The corrected mode: in the order of valid_from, whatever the arrival, a holder ends where the next one starts."""
    w = Window.partitionBy("relation", "target").orderBy("valid_from", "fact_id")
    rows = facts.where(F.col("relation").isin(exclusive) & F.col("valid_from").isNotNull()).select("fact_id", "source", "relation", "target", "valid_from", "valid_to").distinct()
    nxt = F.lead("valid_from").over(w)
    return rows.withColumn("closed_to", F.least(F.coalesce("valid_to", nxt), F.coalesce(nxt, "valid_to")))


def sample_timeline(spark) -> DataFrame:
    """A small invented history to try the operators on, in the order in which it was recorded; one fact is already closed by hand."""
    import datetime as dt

    day = lambda x: dt.date.fromisoformat(x) if x else None
    told = [
        ("Ada Moss", "WORKED_AT", "Low Reef Station", "2014-01-01", "2018-01-01", "2018-05-02"), ("Ada Moss", "FOUNDED", "Weir Works", "2018-01-01", None, "2018-05-02"),
        ("Ada Moss", "CEO_OF", "Weir Works", "2018-01-01", None, "2018-05-02"), ("Tam Brandt", "CTO_OF", "Weir Works", "2018-01-01", None, "2018-05-02"),
        ("Kiln Yard", "SUPPLIED", "Weir Works", "2019-03-01", None, "2019-03-09"), ("Weir Works", "RUNS", "Project Lantern", "2020-02-01", None, "2020-02-20"),
        ("Harbour Fund", "INVESTED_IN", "Weir Works", "2021-06-15", None, "2021-06-15"), ("Iris Okonedo", "LEADS", "Project Lantern", "2021-09-01", None, "2021-11-12"),
        ("Project Lantern", "DETECTED", "2022 cable fault", "2022-07-08", None, "2022-09-01"), ("Iris Okonedo", "CTO_OF", "Weir Works", "2023-04-01", None, "2023-04-18"),
        ("Tam Brandt", "ADVISES", "Weir Works", "2023-04-01", None, "2023-04-18"), ("Iris Okonedo", "CEO_OF", "Weir Works", "2024-10-01", None, "2024-10-05"),
    ]
    rows = [(k, s, r, t, day(a), day(b), day(rec), None, None) for k, (s, r, t, a, b, rec) in enumerate(told)]
    closed = [(*row[:5], day("2023-12-31"), row[6], day("2023-11-20"), None) if row[2] == "SUPPLIED" else row for row in rows]
    return replay(spark.createDataFrame(closed, FACTS))
