"""Queries of the llm operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import abuse, encoding, names, packing, pairs, splitting, survivors
from loomgraph.sources.tables import table


def _survivors(spark: SparkSession, root: str, unstamped: str) -> DataFrame:
    mentions = table(spark, root, "entity_mentions", "entity_id", "mention_id", "description", "type", "source_id", "extractor", "recorded_at")
    return survivors.surviving_values(mentions, table(spark, root, "extractors", "extractor", "trust"), unstamped)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _survivors(spark, root, "oldest").select("entity_id", "field", "mention_id")


def p1_golden(spark: SparkSession, root: str) -> DataFrame:
    return _survivors(spark, root, "learned")


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(table(spark, root, "text_units", "id", "doc_id", "text"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root).select(F.col("unit_id").alias("id")).distinct()


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    units = table(spark, root, "text_units", "id", "doc_id", "text", "start_char")
    return splitting.in_document(_pieces(spark, root), units, table(spark, root, "documents", "doc_id", "text"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "questions", "id", "question", "answer")
    return pairs.defective_pairs(pairs.answer_pairs(q, table(spark, root, "search_results", "id", "question_id", "answer")))


def _variants(spark: SparkSession, root: str) -> DataFrame:
    return names.link_variants(table(spark, root, "entities", "entity_id", "name", "type", "frequency"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return names.linked_pairs(_variants(spark, root))


def p6_links(spark: SparkSession, root: str) -> DataFrame:
    return _variants(spark, root)


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, root, "documents", "doc_id", "text"), encoding.vocabulary_path())


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    sizes = encoding.corpus_sizes(table(spark, root, "documents", "doc_id", "text"), encoding.vocabulary_path())
    return packing.fill_containers(sizes.select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("n")), 2048).withColumnRenamed("item_id", "doc_id")


def _scored(spark: SparkSession, root: str) -> DataFrame:
    return abuse.score_documents(table(spark, root, "documents", "doc_id", "source", "text"), table(spark, root, "review_labels", "doc_id", "toxic"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).where("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root)


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates_by_source(_scored(spark, root))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_golden": p1_golden, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p6_found": p6_found, "p6_links": p6_links, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}


_STAND_INS = ", ".join("'" + x + "'" for x in survivors.STAND_INS)
_OUTER = r"'^[\s\pP\pS]+|[\s\pP\pS]+$'"


def _ok(c: str) -> str:
    b = f"regexp_replace(lower({c}), {_OUTER}, '', 'g')"
    return f"{c} is not null and {b} <> '' and {b} not in ({_STAND_INS})"


def oracles() -> dict[str, str]:
    parts = " union all ".join(
        f"select entity_id, '{f}' as field, mention_id, coalesce(t.trust, -1) as trust, recorded_at from entity_mentions m left join extractors t using (extractor) where {_ok('m.' + f)}"
        + (r" and not regexp_matches(m.description, '(\.\.\.|…|\[\s*(\.\.\.|…|cut|truncated)\s*\])\s*$')" if f == "description" else "")
        for f in survivors.FIELDS
    )
    return {
        "p1_found": f"""with groups as (select entity_id from entity_mentions group by entity_id having count(distinct mention_id) > 1), c as ({parts}),
            r as (select *, row_number() over (partition by entity_id, field order by trust desc, recorded_at desc nulls last, mention_id) as k from c)
            select entity_id, field, mention_id from r semi join groups using (entity_id) where k = 1""",
        "p3_found": r"select distinct id from text_units where ceil(len(regexp_extract_all(text, '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) * 4 / 3.0) > 400",
    }
