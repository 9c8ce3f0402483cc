"""Intervals and references: brute force, edge cases, and the streaming forms."""

import datetime as dt
import random

from loomgraph.operators import intervals, references
from loomgraph.operators.intervals import IntervalMap

FACTS = "source string, relation string, target string, valid_from date, valid_to date, lo string, kind int"


def test_interval_map_against_days():
    rng = random.Random(3)
    for _ in range(300):
        m, days = IntervalMap(), set()
        for _ in range(rng.randint(0, 12)):
            lo = rng.randint(0, 40)
            hi = lo + rng.randint(-2, 8)
            m.insert(lo, hi)
            days |= set(range(lo, hi))
        assert {d for lo, hi in m.periods() for d in range(lo, hi)} == days
        assert all(a < b for a, b in m.periods()) and all(a < b for a, b in m.gaps())
        assert [e for e, _ in m.gaps()] == [hi for _, hi in m.periods()][:-1]


def test_periods_edge_cases(spark):
    d = dt.date
    rows = [
        ("a", "ceo-of", "x", d(2020, 1, 1), d(2020, 2, 1), "clash", 1),
        ("a", " CEO OF ", "x", d(2020, 2, 1), d(2020, 3, 1), None, None),  # touches
        ("a", "CEO_OF", "x", d(2020, 2, 1), d(2020, 3, 1), None, None),
        ("a", "CEO_OF", "x", d(2020, 2, 1), d(2020, 3, 1), None, None),  # repeated
        ("a", "ceo_of", "x", d(2020, 5, 1), d(9999, 12, 31), None, None),  # open
        ("a", "ceo_of", "x", None, d(2020, 6, 1), None, None),
        ("a", "ceo_of", "x", d(2020, 4, 1), d(2020, 4, 1), None, None),  # empty
        ("a", "ceo_of", "x", d(2020, 4, 9), d(2020, 4, 1), None, None),  # reversed
        (None, "OWNS", None, d(2020, 1, 1), None, None, None),
    ]
    got = intervals.fact_periods(spark.createDataFrame(rows, FACTS)).collect()
    gaps = [(r.source, r.relation, r.from_day, r.to_day) for r in got if r.kind == "gap"]
    assert gaps == [("a", "CEO_OF", d(2020, 3, 1), d(2020, 5, 1))]
    assert {(r.source, r.from_day, r.to_day) for r in got if r.kind == "period"} == {("a", d(2020, 1, 1), d(2020, 3, 1)), ("a", d(2020, 5, 1), None), (None, d(2020, 1, 1), None)}
    assert intervals.fact_periods(spark.createDataFrame([], FACTS)).count() == 0


def test_hot_key_in_many_partitions(spark):
    rows = [("hot", "OWNS", "x", dt.date(2000, 1, 1) + dt.timedelta(days=2 * k), dt.date(2000, 1, 2) + dt.timedelta(days=2 * k), None, None) for k in range(500)]
    got = intervals.fact_periods(spark.createDataFrame(rows, FACTS).repartition(16))
    assert got.where("kind = 'gap'").count() == 499


def _entities(spark, rows):
    return spark.createDataFrame(rows, "name string, created_at timestamp_ntz, deleted_at timestamp_ntz, h bigint, key string")


def test_orphans_against_brute_force(spark):
    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rng = random.Random(5)
    ents = [(rng.choice(["Ann", " ann ", "Bob", "Cyd", "", None]), rng.choice([t(rng.randint(0, 9)), None]), rng.choice([None, t(rng.randint(0, 19))]), 1, "x") for _ in range(12)]
    ents += ents[:3]
    refs = [(k, rng.choice(["ANN", "bob ", "cyd", "dan", " ", None]), rng.choice([t(rng.randint(-2, 20)), None]), "clash") for k in range(120)]
    deltas = references.existence_deltas(_entities(spark, ents), "name", "name", "created_at", "deleted_at")
    r = references.references(spark.createDataFrame(refs + refs[:5], "rel_id bigint, source string, recorded_at timestamp_ntz, t string"), "rel", "rel_id", "recorded_at", {"source": "name"})
    got = {(x.ref_id, x.ref_value) for x in references.orphan_references(r, references.existence_timeline(deltas)).collect()}
    want = set()
    for k, v, at, _ in refs:
        if v is None or not v.strip():
            continue
        now = at or dt.datetime.max
        alive = any(n and n.strip().lower() == v.strip().lower() and b is not None and b <= now and (g is None or now < g) and (g is None or b < g) for n, b, g, _, _ in ents)
        if not alive:
            want.add((str(k), v))
    assert got == want


def test_reference_lists_and_empty_tables(spark):
    q = spark.createDataFrame([("q1", ["s1", "s1", None, " ", "S2 "], dt.datetime(2024, 1, 2)), ("q2", None, None), ("q3", [], None)], "id string, supporting_docs array<string>, asked_at timestamp_ntz")
    r = references.references(q, "questions", "id", "asked_at", {}, {"supporting_docs": "slug"})
    none = references.existence_deltas(_entities(spark, []), "slug", "name", "created_at", "deleted_at")
    got = references.orphan_references(r, references.existence_timeline(none))
    assert sorted((x.ref_id, x.ref_value) for x in got.collect()) == [("q1", "S2 "), ("q1", "s1")]
    assert [(x.month, x.n_orphans) for x in references.orphans_by_month(got).collect()] == [("2024-01", 2)]
    assert {(x.key, x.n_refs) for x in references.current_orphans(r, none).collect()} == {("s1", 1), ("s2", 1)}


def test_interval_stream(spark, tmp_path):
    from loomgraph.streaming.intervals import stream_periods

    d = dt.date
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "OWNS", "x", d(2020, 1, 1), d(2020, 2, 1), None, None), ("a", "OWNS", "x", d(2020, 3, 1), d(2020, 4, 1), None, None)], FACTS).write.parquet(src)
    out = stream_periods(spark.readStream.schema(FACTS).parquet(src), ["source", "relation", "target"])
    q = out.writeStream.format("memory").queryName("periods").outputMode("update").start()
    q.processAllAvailable()
    spark.createDataFrame([("a", "OWNS", "x", d(2020, 2, 1), d(2020, 2, 20), None, None)], FACTS).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    last = spark.sql("select * from periods").collect()[-1]
    assert last.gaps == ["2020-02-20/2020-03-01"] and last.n_periods == 2
