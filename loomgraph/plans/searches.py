"""Queries of the whole searches, reports and extraction over the test tables: an index is made of them once, and asked by every method."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import extraction, graph, graphquery, methods, models, ranking, reports, resolution, search, walks
from loomgraph.plans.graphs import _E, _N, _key, _mentions, _queries, _questions
from loomgraph.session import forget, shared_dir
from loomgraph.sources.files import Index, IndexConfig
from loomgraph.sources.tables import table


class Stored(dict):
    """Tables that are made and written to a folder when first asked for."""

    def __init__(self, spark: SparkSession, folder: str, make: dict[str, Callable[[Stored], DataFrame]]) -> None:
        super().__init__()
        self.spark, self.folder, self.make = spark, folder, make

    def __missing__(self, name: str) -> DataFrame:
        df = self.make[name](self)
        df.write.parquet(f"{self.folder}/{name}")
        self[name] = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        return self[name]


def _rels(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "relationships", "rel_id", "source", "target", "description", "strength", "source_id").distinct()
    return r.select(F.col("rel_id").alias("seq"), "source", "target", "description", "strength", F.col("source_id").alias("unit_id"))


def _makers(spark: SparkSession, root: str, config: IndexConfig) -> dict[str, Callable[[Stored], DataFrame]]:
    embed = search.get_embedder(config.embedder)
    words = lambda df, id_, *cs: embed(df.select(F.col(id_).cast("string").alias("id"), F.concat_ws(": ", *cs).alias("text")), "id", "text")

    def units(_: Stored) -> DataFrame:
        return table(spark, root, "text_units", "id", "doc_id", "text").where("id is not null").groupBy(F.col("id").alias("unit_id")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))

    def entities(t: Stored) -> DataFrame:
        n = graph.rank_nodes(graph.with_ends(graph.merge_nodes(_mentions(spark, root)), t["merged"]), t["merged"])
        said = graph.summarized(graph.node_descriptions(_mentions(spark, root)), ["name"], config.summarize_max_tokens)
        return n.join(said, "name", "left").fillna("", ["description"]).select("name", "type", "description", "frequency", "degree", F.col("degree").alias("rank"), "human_id")

    def relationships(t: Stored) -> DataFrame:
        e = ranking.with_position(graph.rank_edges(t["merged"]), "human_id", "u", "v")
        e = e.join(graph.summarized(graph.edge_descriptions(_rels(spark, root)), ["u", "v"], config.summarize_max_tokens), ["u", "v"], "left").fillna("", ["description"])
        return e.select("u", "v", "description", "weight", "combined_degree", F.col("combined_degree").alias("rank"), "human_id")

    return {
        "text_units": units, "merged": lambda t: graph.merge_edges(_rels(spark, root)), "entities": entities, "relationships": relationships,
        "entity_units": lambda t: graph.node_sources(_mentions(spark, root)), "relationship_units": lambda t: graph.edge_sources(_rels(spark, root)),
        "entity_aliases": lambda t: spark.createDataFrame([], "name string, alias string, first_seq bigint"),
        "communities": lambda t: walks.hierarchy(t["relationships"], t["entities"].select("name"), 50),
        "community_reports": lambda t: reports.all_reports(t["entities"], t["relationships"], t["communities"], config.report_max_tokens),
        "entity_vectors": lambda t: words(t["entities"], "name", "name", "description"),
        "relationship_vectors": lambda t: words(t["relationships"].withColumn("ends", F.concat_ws(" ", "u", "v")), "human_id", "ends", "description"),
        "text_unit_vectors": lambda t: words(t["text_units"], "unit_id", "text"), "report_vectors": lambda t: words(t["community_reports"], "id", "content"),
    }


_HELD: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, root: str) -> Index:
    """The index of the tables in a folder: one per session, its tables written to the shared folder on first use and removed at the end."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _HELD:
        folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        config = IndexConfig()
        _HELD[key] = Index(config, Stored(spark, folder, _makers(spark, root, config)))
        atexit.register(forget, spark, folder)
    return _HELD[key]


#: Methods that answer every question; the others every hundredth.
WHOLE = ("subgraph", "ppr", "global")


def _asked(name: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        got = methods.get_method(name)(index_of(spark, root), (_questions if name in WHOLE else _queries)(spark, root))
        return got.select("query_id", "method", "answer", F.md5("context").alias("context_md5"), F.array_join("sources", ";").alias("sources"), "llm_calls")

    query.__name__ = f"search_{name}"
    query.__doc__ = f"Every question of the query set, answered by the method {name!r}."
    return query


def local_context(spark, root):
    return methods.local_context(index_of(spark, root), _queries(spark, root)).select("query_id", "table", "pos", "id", F.md5("line").alias("line_md5"))


def dual_context(spark, root):
    return methods.dual_context(index_of(spark, root), _queries(spark, root)).select("query_id", "table", "pos", "id", F.md5("line").alias("line_md5"))


def global_dynamic(spark, root):
    got = methods.global_search(index_of(spark, root), _queries(spark, root), dynamic=True)
    return got.select("query_id", "method", "answer", F.array_join("sources", ";").alias("sources"), "llm_calls")


def hierarchy_reports(spark, root):
    """Reports of all detected communities, the deepest first."""
    return index_of(spark, root).community_reports.select("id", "level", "parent", "title", "summary", "rating", "rating_explanation", F.to_json("findings").alias("findings"), "content")


def report_sources(spark, root):
    ix = index_of(spark, root)
    near = methods.hits(ix, "report", _queries(spark, root), 5).select("query_id", "id")
    return reports.report_documents(near, ix.communities, ix.entity_units, ix.text_units)


def node_summaries(spark, root):
    return index_of(spark, root).entities.select("name", "description", "degree", "human_id")


def edge_summaries(spark, root):
    return index_of(spark, root).relationships.select("u", "v", "description", "combined_degree", "human_id")


def node_descriptions(spark, root):
    return graph.node_descriptions(_mentions(spark, root)).select("name", F.md5("description").alias("description_md5"), "first_seq")


def node_sources(spark, root):
    return graph.node_sources(_mentions(spark, root))


def edge_descriptions(spark, root):
    return graph.edge_descriptions(_rels(spark, root)).select("u", "v", F.md5("description").alias("description_md5"), "first_seq")


def edge_sources(spark, root):
    return graph.edge_sources(_rels(spark, root))


def _gazetteer_nodes(spark, root):
    return table(spark, root, "gazetteer", "name").select(F.lit("all").alias("query_id"), graph.node_key(F.col("name")).alias("name")).distinct()


def induced_edges(spark, root):
    e = graph.merge_edges(_rels(spark, root))
    return graph.induced(e, _gazetteer_nodes(spark, root)).select("u", "v", F.round("weight", 6).alias("weight"))


def markdown_lines(spark, root):
    n = graph.merge_nodes(_mentions(spark, root)).withColumn("description", F.lit(""))
    e = graph.merge_edges(_rels(spark, root)).withColumn("description", F.lit("related"))
    return graph.markdown_tables(n, e, _gazetteer_nodes(spark, root)).select("kind", "name", "other", "line")


def node_link_graphs(spark, root):
    """The graph of each question's entities as node-link JSON."""
    ix = index_of(spark, root)
    return graph.node_link(ix.entities, ix.relationships, methods.chosen_entities(ix, _queries(spark, root)).select("query_id", "name"))


def resolve_entities(spark, root):
    """Alias resolution over all names of the entities, in the order of names."""
    return resolution.resolve_entities(table(spark, root, "entities", "name", "type").select(F.upper(F.trim("name")).alias("name"), F.upper("type").alias("type")))


def mention_finder(spark, root):
    """Mentions of gazetteer names and of phrases that look like names: longest first, without overlaps."""
    sents = extraction.unit_sentences(table(spark, root, "text_units", "id", "text").distinct())
    return extraction.find_mentions(sents, table(spark, root, "gazetteer", "name", "type"))


def _model(spark, root) -> Callable[[], models.Model]:
    known = {r["name"]: r["type"] for r in table(spark, root, "gazetteer", "name", "type").where("name is not null").collect()}  # a table that does not grow
    return lambda: models.RuleModel(known)


def _units(spark, root):
    return table(spark, root, "text_units", "id", "text").where("id is not null").groupBy(F.col("id").alias("unit_id")).agg(F.min("text").alias("text"))


def gleaned_entities(spark, root):
    """Entities by the model interface, with one gleaning pass."""
    return extraction.extract_units(_units(spark, root), _model(spark, root), "rules", IndexConfig().entity_types, 1)[0]


def gleaned_relationships(spark, root):
    return extraction.extract_units(_units(spark, root), _model(spark, root), "rules", IndexConfig().entity_types, 1)[1]


def model_claims(spark, root):
    return extraction.extract_claims(_units(spark, root), _model(spark, root), "rules", IndexConfig().entity_types)


def graph_queries(spark, root):
    """The graph query that the rules write for each question, and what a check of it finds."""
    ix = index_of(spark, root)
    _, labels = graphquery.schema_text(ix.entities)
    found = methods.named(ix, _queries(spark, root)).groupBy("query_id").agg(F.min("name").alias("name"))
    text = F.udf(lambda n: graphquery.query_for([n] if n else []), "string")
    wrong = F.udf(lambda q: "; ".join(graphquery.problems(q, labels)), "string")
    q = _queries(spark, root).join(found, "query_id", "left").select("query_id", text("name").alias("query"))
    return q.select("query_id", "query", wrong("query").alias("problems"))


def queries() -> dict:
    named = [local_context, dual_context, global_dynamic, hierarchy_reports, report_sources, node_summaries, edge_summaries, node_descriptions, node_sources, edge_descriptions, edge_sources, induced_edges,
             markdown_lines, node_link_graphs, resolve_entities, mention_finder, gleaned_entities, gleaned_relationships, model_claims, graph_queries, *map(_asked, methods.NAMES)]
    return {f.__name__: f for f in named}


_RD = f"""rd as (select distinct rel_id as seq, {_key('source')} as a, {_key('target')} as b, description, source_id as unit_id from relationships),
re as (select seq, least(a, b) as u, greatest(a, b) as v, description, unit_id from rd where a <> '' and b <> '' and a <> b)"""
_GZ = f"gz as (select distinct {_key('name')} as name from gazetteer)"


def oracles() -> dict[str, str]:
    cell = lambda c: f"replace(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), '|', '/')"
    return {
        "node_descriptions": "with " + _N + "select name, md5(description) as description_md5, min(seq) as first_seq from m where description <> '' group by name, description",
        "node_sources": "with " + _N + "select name, unit_id, min(seq) as first_seq from m where unit_id <> '' group by name, unit_id",
        "edge_descriptions": "with " + _RD + " select u, v, md5(description) as description_md5, min(seq) as first_seq from re where description <> '' group by u, v, description",
        "edge_sources": "with " + _RD + " select u, v, unit_id, min(seq) as first_seq from re where unit_id <> '' group by u, v, unit_id",
        "induced_edges": "with " + _E + "," + _GZ + " select u, v, round(weight, 6) as weight from e where u in (select name from gz) and v in (select name from gz)",
        "markdown_lines": "with " + _N + "," + _E + "," + _GZ + f""" select 'entity' as kind, name, '' as other, '| ' || {cell('name')} || ' | ' || {cell('type')} || ' |  |' as line from n where name in (select name from gz)
            union all select 'relationship', u, v, '| ' || {cell('u')} || ' | ' || {cell('v')} || ' | related | ' || cast(round(weight, 2) as varchar) || ' |' from e where u in (select name from gz) and v in (select name from gz)""",
    }
