"""The whole build: documents to chunks, mentions, aliases, graph, summaries, communities, reports and vectors, as one chain of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import chunking, evaluation, extraction, graph, methods, models, ranking, reports, resolution, search, walks
from loomgraph.session import cut
from loomgraph.sources.files import Index, IndexConfig


def _extracted(units: DataFrame, gazetteer: DataFrame, config: IndexConfig, make: Callable[[], models.Model] | None, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions (name, type, description, unit_id), relationships (source, target, description, strength, unit_id), claims): by the model, or by the same rules as joins."""
    if make is not None:
        e, r, _ = extraction.extract_units(units.select("unit_id", "text"), make, model, config.entity_types, config.max_gleanings)
        return e, r, extraction.extract_claims(units.select("unit_id", "text"), make, model, config.entity_types)
    sents = cut(extraction.unit_sentences(units.select(F.col("unit_id").alias("id"), "text")))
    found = cut(extraction.find_mentions(sents, gazetteer))
    mentions = found.join(sents, ["unit_id", "sent"]).select(F.upper("name").alias("name"), "type", F.col("sentence").alias("description"), "unit_id").distinct()
    return mentions, extraction.sentence_relations(found, sents), extraction.dated_claims(found, sents)


def build_index(documents: DataFrame, gazetteer: DataFrame, config: IndexConfig | None = None, make: Callable[[], models.Model] | None = None, model: str = "rules") -> Index:
    """An index of documents (doc_id, text) with names from a gazetteer (name, type); with `make`, a model extracts instead.

    Stages that several others read are written once. The order of mentions is that of their units.
    """
    config = config or IndexConfig()
    units = cut(chunking.chunk_documents(documents, config.chunk_size, config.overlap))
    mentions, relations, claims = _extracted(units, gazetteer, config, make, model)
    mentions = cut(ranking.with_position(mentions, "seq", "unit_id", "name", "description"))
    relations = cut(ranking.with_position(relations, "seq", "unit_id", "source", "target"))
    aliases = cut(resolution.resolve_entities(mentions.select("name", "type"), config.alias_threshold))
    own = graph.rewrite_names(mentions, "name", aliases)
    ties = graph.rewrite_names(graph.rewrite_names(relations, "source", aliases), "target", aliases)
    edges = cut(graph.merge_edges(ties))
    nodes = graph.with_ends(graph.merge_nodes(own), edges)
    said, linked = graph.node_descriptions(own), graph.edge_descriptions(ties)
    entities = graph.rank_nodes(nodes, edges).join(graph.summarized(said, ["name"], config.summarize_max_tokens), "name", "left").fillna("", ["description"]).withColumn("rank", F.col("degree"))
    entities = cut(entities.select("name", "type", "description", "frequency", "degree", "rank", "human_id"))
    full = ranking.with_position(graph.rank_edges(edges), "human_id", "u", "v").join(graph.summarized(linked, ["u", "v"], config.summarize_max_tokens), ["u", "v"], "left").fillna("", ["description"])
    full = cut(full.select("u", "v", "description", "weight", "combined_degree", F.col("combined_degree").alias("rank"), "human_id"))
    levels = cut(walks.hierarchy(full, entities.select("name"), config.max_cluster_size))
    report = cut(reports.all_reports(entities, full, levels, config.report_max_tokens))
    embed = search.get_embedder(config.embedder)
    tables = {
        "text_units": units, "entities": entities, "entity_descriptions": said, "entity_units": graph.node_sources(own), "entity_aliases": graph.node_aliases(mentions, aliases),
        "relationships": full, "relationship_descriptions": linked, "relationship_units": graph.edge_sources(ties), "communities": levels, "community_reports": report,
        "entity_vectors": embed(entities.select(F.col("name").alias("id"), F.concat_ws(": ", "name", "description").alias("text")), "id", "text"),
        "relationship_vectors": embed(full.select(F.col("human_id").cast("string").alias("id"), F.concat(F.concat_ws(" ", "u", "v"), F.lit(": "), "description").alias("text")), "id", "text"),
        "text_unit_vectors": embed(units.select(F.col("unit_id").alias("id"), "text"), "id", "text"), "report_vectors": embed(report.select("id", F.col("content").alias("text")), "id", "text"),
    }
    if config.extract_claims:
        tables["claims"] = graph.rewrite_names(graph.rewrite_names(claims, "subject", aliases), "object", aliases)
    return Index(config, tables)


def ask(index: Index, question: str, method: str = "local", **options) -> DataFrame:
    """One result row (query_id, method, answer, context, sources, llm_calls) for a question."""
    q = index.text_units.sparkSession.createDataFrame([("q", question)], "query_id string, text string")
    return methods.get_method(method, **options)(index, q)


def evaluate(index: Index, questions: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scored answers, their means) of methods for questions (id, question, type, answer, supporting_docs), all questions of a method at once."""
    q = questions.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    out = None
    for name in names:
        got = cut(methods.get_method(name)(index, q).withColumn("method", F.lit(name)))
        out = got if out is None else out.unionByName(got)
    results = out.select(F.concat_ws("/", "query_id", "method").alias("id"), F.col("query_id").alias("question_id"), "method", "answer", "sources")
    scored = evaluation.scored_answers(questions, results)
    return results, evaluation.summarize(scored)
