"""References to records that do not exist.

Targets turn into signed existence deltas (+1 when a record appears, -1 when it is deleted), which are summed per key
and moment and kept as one short ordered list per key. A reference is an orphan when the existence count of its key,
summed up to the reference's own moment, is not positive. The current report sums signed reference and existence
counts per key. Both sides are aggregated before they meet; the large side is joined once, on a 64-bit hash with the key
compared exactly, and each key has a single row on the small side, so that a hot key can be split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALWAYS = "0001-01-01 00:00:00"
EVER = "9999-12-31 23:59:59"


def norm(c: Column) -> Column:
    """Names and ids match without outer white space and case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _stamp(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def existence_deltas(df: DataFrame, kind: str, key: str, born: str | None, gone: str | None) -> DataFrame:
    """Rows (kind, key, t, d). `born` None: exists always; null `born`: never; null `gone`: still alive. A record gone before it is born never exists."""
    lo = _stamp(F.col(born)) if born else F.lit(ALWAYS).cast("timestamp_ntz")
    hi = _stamp(F.col(gone)) if gone else F.lit(None).cast("timestamp_ntz")
    base = df.select(norm(F.col(key)).alias("key"), lo.alias("lo"), hi.alias("hi")).where("key <> '' and lo is not null and (hi is null or lo < hi)")
    both = F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("t"), F.lit(-1).alias("d")))
    return base.select(F.lit(kind).alias("kind"), "key", F.explode(both).alias("x")).select("kind", "key", "x.t", "x.d").where("t is not null")


def existence_timeline(deltas: DataFrame) -> DataFrame:
    """One row per (kind, key): its deltas in order, and the count as it now stands."""
    summed = deltas.groupBy("kind", "key", "t").agg(F.sum("d").alias("d"))
    return summed.groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("t", "d"))).alias("line"), F.sum("d").alias("now"))


def _entries(field: str, kind: str) -> Column:
    return F.transform(F.col(field), lambda v: F.struct(F.lit(field).alias("f"), F.lit(kind).alias("k"), v.cast("string").alias("v")))


def references(df: DataFrame, table: str, ref_id: str, moment: str, fields: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """Rows (ref_table, ref_id, ref_field, ref_value, kind, t) of plain and list columns; null and blank references are no cases."""
    plain = [F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.col(f).cast("string").alias("v")) for f, k in fields.items()]
    many = [_entries(f, k) for f, k in (lists or {}).items()]
    arrays = ([F.array(*plain)] if plain else []) + [F.coalesce(m, F.array().cast("array<struct<f:string,k:string,v:string>>")) for m in many]
    rows = df.select(F.col(ref_id).cast("string").alias("ref_id"), _stamp(F.col(moment)).alias("t"), F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("x"))
    return rows.select(F.lit(table).alias("ref_table"), "ref_id", F.col("x.f").alias("ref_field"), F.col("x.v").alias("ref_value"), F.col("x.k").alias("kind"), "t").where(
        F.col("ref_value").isNotNull() & F.col("ref_value").rlike(r"(?U)\S")
    )


def _hash(kind: Column, key: Column) -> Column:
    return F.xxhash64(kind, key)


def _met(refs: DataFrame, timeline: DataFrame) -> DataFrame:
    line = timeline.select(_hash(F.col("kind"), F.col("key")).alias("h"), F.col("kind").alias("line_kind"), F.col("key").alias("line_key"), "line", "now")
    r = refs.withColumn("h", _hash(F.col("kind"), norm(F.col("ref_value"))))
    return r.join(line, (r.h == line.h) & (r.kind == line.line_kind) & (norm(r.ref_value) == line.line_key), "left").drop(line.h)


def orphan_references(refs: DataFrame, timeline: DataFrame) -> DataFrame:
    """Rows (ref_table, ref_id, ref_field, ref_value, t), each once: references whose target's existence count at t is not positive.

    A null moment is taken as the present. Repeated rows and repeated list entries give one case.
    """
    t = F.coalesce(F.col("t"), F.lit(EVER).cast("timestamp_ntz"))
    at = F.aggregate(F.filter("line", lambda x: x.t <= t), F.lit(0).cast("bigint"), lambda a, x: a + x.d)
    gone = F.col("line").isNull() | (at <= 0)
    return _met(refs, timeline).where(gone).select("ref_table", "ref_id", "ref_field", "ref_value", "t").distinct()


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, field and calendar month (null where the row has no moment)."""
    return orphans.groupBy("ref_table", "ref_field", F.date_format("t", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


def current_orphans(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Keys with a positive reference count and no existence now, with their count of referring rows, from signed counts alone.

    One sum of (reference, existence) deltas per key; map-side partial sums keep a hot key small.
    """
    once = refs.select("kind", norm(F.col("ref_value")).alias("key"), "ref_table", "ref_id", "ref_field").distinct()
    r = once.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_refs")).select("kind", "key", "n_refs", F.lit(0).cast("bigint").alias("n_exist"))
    e = deltas.groupBy("kind", "key").agg(F.sum("d").alias("n_exist")).select("kind", "key", F.lit(0).cast("bigint").alias("n_refs"), "n_exist")
    total = r.unionByName(e).groupBy("kind", "key").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_exist").alias("n_exist"))
    return total.where("n_refs > 0 and n_exist <= 0").select("kind", "key", "n_refs")


def corpus_deltas(entities: DataFrame, gazetteer: DataFrame, text_units: DataFrame, documents: DataFrame) -> DataFrame:
    """Existence deltas of everything that relationships and questions can name."""
    parts = [
        existence_deltas(entities, "name", "name", "created_at", "deleted_at"),
        existence_deltas(gazetteer, "name", "name", None, None),
        existence_deltas(text_units, "unit", "id", "created_at", "deleted_at"),
        existence_deltas(documents, "slug", "slug", "ingested_at", "deleted_at"),
    ]
    return reduce(DataFrame.unionByName, parts)


def corpus_references(relationships: DataFrame, questions: DataFrame) -> DataFrame:
    rel = references(relationships, "relationships", "rel_id", "recorded_at", {"source": "name", "target": "name", "source_id": "unit"})
    return rel.unionByName(references(questions, "questions", "id", "asked_at", {}, {"supporting_docs": "slug"}))
