"""Queries of the general training-data operators (intervals, orphan references) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import intervals, references
from loomgraph.sources.tables import table


def _facts(spark: SparkSession, root: str) -> DataFrame:
    return intervals.fact_periods(table(spark, root, "facts", "source", "relation", "target", "valid_from", "valid_to"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _facts(spark, root).where("kind = 'gap'").select(
        "source", "relation", "target", F.date_format("from_day", "yyyy-MM-dd").alias("gap_from"), F.date_format("to_day", "yyyy-MM-dd").alias("gap_to")
    )


def p2_periods(spark: SparkSession, root: str) -> DataFrame:
    return _facts(spark, root).where("kind = 'period'").select(
        "source", "relation", "target", F.date_format("from_day", "yyyy-MM-dd").alias("period_from"), F.date_format("to_day", "yyyy-MM-dd").alias("period_to")
    )


def _refs(spark: SparkSession, root: str) -> DataFrame:
    return references.corpus_references(
        table(spark, root, "relationships", "rel_id", "source", "target", "source_id", "recorded_at"),
        table(spark, root, "questions", "id", "supporting_docs", "asked_at"),
    )


def _deltas(spark: SparkSession, root: str) -> DataFrame:
    return references.corpus_deltas(
        table(spark, root, "entities", "name", "created_at", "deleted_at"),
        table(spark, root, "gazetteer", "name"),
        table(spark, root, "text_units", "id", "created_at", "deleted_at"),
        table(spark, root, "documents", "slug", "ingested_at", "deleted_at"),
    )


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_references(_refs(spark, root), references.existence_timeline(_deltas(spark, root)))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("ref_table", "ref_id", "ref_field", "ref_value")


def p4_monthly(spark: SparkSession, root: str) -> DataFrame:
    return references.orphans_by_month(_orphans(spark, root))


def p4_current(spark: SparkSession, root: str) -> DataFrame:
    return references.current_orphans(_refs(spark, root), _deltas(spark, root))


_PERIODS = r"""
with f as (
  select distinct source, upper(regexp_replace(regexp_replace(relation, '^\s+|\s+$', '', 'g'), '[\s_\-]+', '_', 'g')) as relation, target,
    valid_from as lo, least(coalesce(valid_to, date '9999-12-31'), date '9999-12-31') as hi
  from facts where valid_from is not null and (valid_to is null or valid_to > valid_from)),
m as (select *, max(hi) over (partition by source, relation, target order by lo, hi rows between unbounded preceding and 1 preceding) as prev from f),
g as (select *, sum(case when prev is null or lo > prev then 1 else 0 end) over (partition by source, relation, target order by lo, hi rows unbounded preceding) as island from m),
p as (select source, relation, target, island, min(lo) as lo, max(hi) as hi from g group by source, relation, target, island)
"""

_REFS = r"""
with targets as (
  select 'name' as kind, lower(trim(name)) as key, created_at as lo, deleted_at as hi from entities
  union all select 'name', lower(trim(name)), timestamp '0001-01-01', null from gazetteer
  union all select 'unit', lower(trim(id)), created_at, deleted_at from text_units
  union all select 'slug', lower(trim(slug)), ingested_at, deleted_at from documents),
refs as (
  select distinct 'relationships' as ref_table, cast(rel_id as varchar) as ref_id, 'source' as ref_field, source as ref_value, 'name' as kind, recorded_at as t from relationships
  union select distinct 'relationships', cast(rel_id as varchar), 'target', target, 'name', recorded_at from relationships
  union select distinct 'relationships', cast(rel_id as varchar), 'source_id', source_id, 'unit', recorded_at from relationships
  union select distinct 'questions', id, 'supporting_docs', unnest(supporting_docs), 'slug', asked_at from questions),
r as (select *, lower(regexp_replace(ref_value, '^\s+|\s+$', '', 'g')) as key from refs where ref_value is not null and regexp_matches(ref_value, '\S')),
orphans as (
  select ref_table, ref_id, ref_field, ref_value, t from r
  where not exists (select 1 from targets x where x.kind = r.kind and x.key = r.key and x.lo <= r.t and (x.hi is null or r.t < x.hi)))
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_periods": p2_periods, "p4_found": p4_found, "p4_monthly": p4_monthly, "p4_current": p4_current}


def oracles() -> dict[str, str]:
    return {
        "p2_found": _PERIODS + """select source, relation, target, strftime(hi, '%Y-%m-%d') as gap_from, strftime(nxt, '%Y-%m-%d') as gap_to
            from (select *, lead(lo) over (partition by source, relation, target order by lo) as nxt from p) where nxt is not null""",
        "p2_periods": _PERIODS + """select source, relation, target, strftime(lo, '%Y-%m-%d') as period_from,
            case when hi < date '9999-12-31' then strftime(hi, '%Y-%m-%d') end as period_to from p""",
        "p4_found": _REFS + "select distinct ref_table, ref_id, ref_field, ref_value from orphans",
        "p4_monthly": _REFS + "select ref_table, ref_field, strftime(t, '%Y-%m') as month, count(*) as n_orphans from (select distinct * from orphans) group by all",
        "p4_current": _REFS + """select kind, key, count(*) as n_refs from (select distinct kind, key, ref_table, ref_id, ref_field from r) q
            where not exists (select 1 from targets x where x.kind = q.kind and x.key = q.key and x.lo is not null and x.hi is null) group by all""",
    }
