"""Queries of graph assembly, graph algorithms, search, retrieval, time and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import answers, evaluation, graph, ranking, retrieval, search, temporal, walks
from loomgraph.plans.texts import SPACE, terms_sql, tokens_sql
from loomgraph.session import cut
from loomgraph.sources.tables import table


def _mentions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entity_mentions", "mention_id", "name", "type", "description", "source_id").select(F.col("mention_id").alias("seq"), "name", "type", "description", F.col("source_id").alias("unit_id"))


def _rels(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "relationships", "rel_id", "source", "target", "strength", "source_id").select(F.col("rel_id").alias("seq"), "source", "target", "strength", F.col("source_id").alias("unit_id"))


def _nodes(spark, root):
    return graph.merge_nodes(_mentions(spark, root))


def _edges(spark, root):
    return graph.merge_edges(_rels(spark, root))


def node_merge(spark, root):
    return _nodes(spark, root)


def edge_merge(spark, root):
    return _edges(spark, root).withColumn("weight", F.round("weight", 6))


def degree_rank(spark, root):
    e = _edges(spark, root)
    return graph.rank_nodes(graph.with_ends(_nodes(spark, root), e), e).select("name", "type", "frequency", "degree", "human_id")


def combined_degree(spark, root):
    return graph.rank_edges(_edges(spark, root)).select("u", "v", "combined_degree")


def canonical_rewrite(spark, root):
    e = table(spark, root, "entities", "name").distinct()
    aliases = e.select(graph.node_key(F.col("name")).alias("alias"), X.normalize_name(F.col("name")).alias("canonical"))
    r = table(spark, root, "relationships", "rel_id", "source").distinct().select("rel_id", graph.node_key(F.col("source")).alias("source"))
    return graph.rewrite_names(r, "source", aliases)


def alias_by_token_subset(spark, root):
    names = table(spark, root, "entities", "name", "type").select(graph.node_key(F.col("name")).alias("name"), F.upper("type").alias("type")).where("type is not null").distinct()
    return graph.subset_aliases(names)


def edit_similarity(spark, root):
    f = table(spark, root, "facts", "fact_id", "source", "target").distinct()
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", "~")
    return f.select("fact_id", F.round(graph.edit_similarity(ascii_("source"), ascii_("target")), 6).alias("similarity"))


def neighbourhood(spark, root):
    return graph.adjacency_lines(_edges(spark, root)).select("name", F.md5("line").alias("line_md5"))


def _first_edge_description(spark, root):
    r = table(spark, root, "relationships", "rel_id", "source", "target", "description").distinct().withColumnRenamed("rel_id", "seq")
    return graph.edge_descriptions(r).groupBy("u", "v").agg(F.min(F.struct("first_seq", "description")).alias("f")).select("u", "v", F.col("f.description").alias("description"))


def triples_text(spark, root):
    r = _edges(spark, root).join(_first_edge_description(spark, root), ["u", "v"], "left")
    return graph.triples(r).select(F.md5("line").alias("line_md5"))


def table_text(spark, root):
    e = graph.rank_edges(_edges(spark, root))
    return e.select(graph.table_lines(e, ["u", "v", "combined_degree"]).alias("line"))


def node_link_json(spark, root):
    return _nodes(spark, root).select("name", F.to_json(F.struct(F.col("name").alias("id"), "type", "frequency")).alias("node"))


def cypher_export(spark, root):
    e = _edges(spark, root)
    d = graph.node_descriptions(_mentions(spark, root)).groupBy("name").agg(F.min(F.struct("first_seq", "description")).alias("f")).select("name", F.col("f.description").alias("description"))
    n = graph.rank_nodes(_nodes(spark, root), e).join(d, "name", "left")
    out = graph.merge_statements(n, e.join(_first_edge_description(spark, root), ["u", "v"], "left"))
    return out.select("kind", F.md5("statement").alias("statement_md5"))


def modularity_by_type(spark, root):
    e = _edges(spark, root)
    n = graph.with_ends(_nodes(spark, root), e)
    return walks.modularity(e, n.select("name", F.col("type").alias("community"))).select(F.round("modularity", 6).alias("modularity"))


def louvain_partition(spark, root):
    e = _edges(spark, root)
    return walks.communities(e, graph.with_ends(_nodes(spark, root), e))


def community_hierarchy(spark, root):
    e = _edges(spark, root)
    return walks.hierarchy(e, graph.with_ends(_nodes(spark, root), e), most=50)


def _members(spark, root):
    """Two levels of communities that SQL can also form: by type, and by type and first letter."""
    n = _nodes(spark, root).where("type <> ''")
    l0 = n.select(F.lit(0).alias("level"), F.col("type").alias("community"), F.lit(None).cast("string").alias("parent"), "name")
    return l0.unionByName(n.select(F.lit(1).alias("level"), F.concat_ws("/", "type", F.substring("name", 1, 1)).alias("community"), F.col("type").alias("parent"), "name"))


def community_context(spark, root):
    """Each community's entities by degree, and edges by combined degree, each within half of the budget."""
    e = graph.rank_edges(_edges(spark, root))
    m = _members(spark, root).select("community", "name")
    d = graph.degrees(e).select(F.col("node").alias("name"), "degree")
    ents = m.join(d, "name", "left").fillna(0, ["degree"])
    ents = ranking.budget_prefix(ents, ["community"], [F.desc("degree"), F.col("name")], X.count_tokens(F.concat_ws("|", "name", F.col("degree").cast("string"))), 200)
    rows = e.join(m.select(F.col("community").alias("c"), F.col("name").alias("u")), "u").join(m.select(F.col("community").alias("c"), F.col("name").alias("v")), ["c", "v"])
    rels = ranking.budget_prefix(rows.withColumnRenamed("c", "community"), ["community"], [F.desc("combined_degree"), F.col("u"), F.col("v")], X.count_tokens(F.concat_ws("|", "u", "v", F.col("combined_degree").cast("string"))), 200)
    out = ents.select("community", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), "used_tokens")
    return out.unionByName(rels.select("community", F.lit("relationship").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), "used_tokens"))


def _reports(spark, root):
    """Rule-based reports: title of the two names of the greatest degree, rating by the number of inner edges."""
    e = _edges(spark, root)
    m = _members(spark, root)
    d = graph.degrees(e).select(F.col("node").alias("name"), "degree")
    top = ranking.best_of(m.join(d, "name", "left").fillna(0, ["degree"]), ["community"], [F.desc("degree"), F.col("name")], 3)
    head = top.groupBy("community", "level", "parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    k = m.select("community", "name")
    inner = e.join(k.select(F.col("community").alias("c"), F.col("name").alias("u")), "u").join(k.select(F.col("community").alias("c"), F.col("name").alias("v")), ["c", "v"]).groupBy("c").agg(F.count(F.lit(1)).alias("n_rels"))
    r = head.join(inner, F.col("community") == F.col("c"), "left").fillna(0, ["n_rels"])
    return r.select(F.col("community").alias("id"), "level", "parent", F.concat(F.lit("This community centres on "), "names", F.lit(".")).alias("content"), F.round(F.least(F.lit(10.0), 2 + 0.5 * F.col("n_rels")), 1).alias("rating"))


def community_reports(spark, root):
    return _reports(spark, root)


def reports_at_level(spark, root):
    return retrieval.reports_at(_reports(spark, root), 1).select("id", "level", "rating")


def _questions(spark, root):
    return table(spark, root, "questions", "id", "question").distinct().select(F.col("id").alias("query_id"), F.col("question").alias("text"))


def _queries(spark, root):
    """Every hundredth question."""
    return _questions(spark, root).where(F.regexp_replace("query_id", "[^0-9]", "").cast("bigint") % 100 == 0)


def map_scores(spark, root):
    return answers.map_points(_queries(spark, root), _reports(spark, root), 20).select("query_id", "id", F.col("score").cast("int").alias("score"))


def dynamic_selection(spark, root):
    return retrieval.select_reports(_queries(spark, root), _reports(spark, root), threshold=1)


def cosine_topk(spark, root):
    v = table(spark, root, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "embedding")
    return search.cosine_top_k(v.where("id = 7").select(F.col("id").alias("query_id"), "embedding"), v, 10)


def cosine_topk_batch(spark, root):
    v = table(spark, root, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "embedding")
    return search.cosine_top_k(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), v, 10)


def vector_append(spark, root):
    v = table(spark, root, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "embedding")
    return search.append_vectors(v, v.select((F.col("id") + 1_000_000).alias("id"), "embedding")).select("id", F.size("embedding").alias("dim"))


def hashed_vectors_md5(spark, root):
    return search.hashed_terms(table(spark, root, "text_units", "id", "text").distinct(), "id", "text").select("id", "bucket", F.round("value", 6).alias("value")).where("value <> 0")


def hashed_vectors_blake(spark, root):
    return search.hashing_embedder(table(spark, root, "text_units", "id", "text").distinct(), "id", "text")


def _bm25(spark, root, k, asked=_queries):
    d = table(spark, root, "documents", "doc_id", "text")
    n, avg = search.corpus_stats(d, "text")
    return search.bm25(search.postings(d, "doc_id", "text"), n, avg, asked(spark, root), k)


def bm25_topk(spark, root):
    return _bm25(spark, root, 10)


def _hashed_hits(spark, root, k, asked=_queries):
    """Cosine of hashed vectors, summed over shared buckets."""
    d = search.hashed_terms(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")
    return search.hashed_top_k(cut(search.hashed_terms(asked(spark, root), "query_id", "text")), d, k)


def _fused(spark, root, asked):
    one = lambda r: r.select("query_id", "id", "rank", F.lit(1.0).alias("weight"))
    fused = ranking.fuse_rankings(one(_bm25(spark, root, 20, asked)).unionByName(one(_hashed_hits(spark, root, 20, asked))), ["query_id"], "id")
    return ranking.best_of(fused.withColumn("score", F.round("score", 8)), ["query_id"], [F.desc("score"), F.col("id")], 10)


def rrf_fusion(spark, root):
    return _fused(spark, root, _queries)


def hybrid_retrieval(spark, root):
    """Flagship: fused word and vector rankings of every question, then the texts that fit a token budget."""
    fused = _fused(spark, root, _questions)
    sizes = table(spark, root, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), X.count_tokens(F.col("text")).alias("n_tokens"))
    return ranking.budget_prefix(fused.join(sizes, "id"), ["query_id"], [F.col("rank")], F.col("n_tokens"), 4000).select("query_id", "id", "rank", "used_tokens")


def basic_context_budget(spark, root):
    sizes = table(spark, root, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), X.count_tokens(F.col("text")).alias("n_tokens"))
    return ranking.budget_prefix(_hashed_hits(spark, root, 5).join(sizes, "id"), ["query_id"], [F.col("rank")], F.col("n_tokens"), 1000).select("query_id", "id", "used_tokens")


def _similar_nodes(spark, root, k, asked=_queries):
    """Entities by BM25 of their names: a similarity that SQL can also compute."""
    n = _nodes(spark, root).select("name")
    count, avg = search.corpus_stats(n, "name")
    return search.bm25(search.postings(n, "name", "name"), count, avg, asked(spark, root), k).select("query_id", F.col("id").alias("name"), "score", "rank")


def query_entities(spark, root):
    return retrieval.query_entities(_queries(spark, root), _nodes(spark, root), _similar_nodes(spark, root, 20), 10)


def local_edges_ranked(spark, root):
    return retrieval.local_edges(query_entities(spark, root), _edges(spark, root), 800).withColumn("weight", F.round("weight", 6))


def _node_units(spark, root):
    return _mentions(spark, root).select(graph.node_key(F.col("name")).alias("name"), "unit_id").where("name <> '' and unit_id is not null").distinct()


def local_units_ranked(spark, root):
    sel = query_entities(spark, root)
    touch = graph.both_ways(_edges(spark, root)).select("node", "other")
    one = sel.select("query_id", F.col("name").alias("node")).join(touch, "node").select("query_id", F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    a, b = graph.node_key(F.col("source")), graph.node_key(F.col("target"))
    cites = _rels(spark, root).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "unit_id").where("unit_id is not null").distinct()
    cited = one.join(cites, ["u", "v"]).groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    texts = table(spark, root, "text_units", "id", "text").distinct().select(F.col("id").alias("unit_id"), X.count_tokens(F.col("text")).alias("n_tokens"))
    return retrieval.local_units(sel, _node_units(spark, root), cited, texts, 1500)


def dual_level_edges(spark, root):
    e = graph.rank_edges(_edges(spark, root))
    hits = _similar_nodes(spark, root, 10)
    named = cut(e.select(F.concat_ws("|", "u", "v").alias("id"), F.concat_ws(" ", "u", "v").alias("text"), "u", "v"))
    n, avg = search.corpus_stats(named, "text")
    top = search.bm25(search.postings(named, "id", "text"), n, avg, _queries(spark, root), 5).join(named.select("id", "u", "v"), "id")
    return retrieval.dual_level_edges(hits, top.select("query_id", "u", "v", "rank"), e.withColumn("weight", F.round("weight", 6)), 10)


def keyword_split(spark, root):
    q = _queries(spark, root)
    low = retrieval.named_in_query(q, table(spark, root, "gazetteer", "name").union(table(spark, root, "entities", "name")))
    low = low.groupBy("query_id").agg(F.array_sort(F.collect_set(F.upper("name"))).alias("low"))
    j = q.join(low, "query_id", "left").withColumn("low", F.coalesce("low", F.array().cast("array<string>")))
    high = F.array_except(X.analyze(F.col("text")), X.analyze(F.array_join("low", " ")))
    return j.select("query_id", F.array_join("low", ";").alias("low"), F.array_join(F.array_sort(high), ";").alias("high"))


def _prizes(spark, root, asked):
    return _similar_nodes(spark, root, 10, asked).select("query_id", "name", (F.lit(11) - F.col("rank")).cast("double").alias("prize"))


def rank_prizes(spark, root):
    return _prizes(spark, root, _queries)


def _sources(spark, root):
    return rank_prizes(spark, root).select("name").distinct()


def pcst_subgraph(spark, root):
    got = walks.prize_subgraphs(_edges(spark, root), cut(_prizes(spark, root, _questions)))
    return got.select("query_id", F.explode("edges").alias("e")).select("query_id", "e.u", "e.v")


#: A change of PageRank that no rounding shows: rounds that change less are left out.
STILL = 1e-13


def _seeded(spark, root, asked):
    """Edges, nodes, questions and seeds of PageRank. As in the SQL, a question near no entity has no ranks."""
    e = cut(_edges(spark, root))
    seeds = cut(_prizes(spark, root, asked).select("query_id", "name", F.col("prize").alias("weight")))
    return e, graph.with_ends(_nodes(spark, root), e), seeds.select("query_id"), seeds


def ppr(spark, root):
    """Personalised PageRank of every question, 50 rounds."""
    return walks.pagerank_batch(*_seeded(spark, root, _questions), tol=STILL).select("query_id", "name", F.round("p", 8).alias("p")).where("p > 0")


def passage_rank(spark, root):
    p = walks.passage_scores(*_seeded(spark, root, _questions), _node_units(spark, root), tol=STILL)
    return p.select("query_id", "unit_id", F.round("score", 8).alias("score")).where("score > 0")


def seed_nodes(spark, root):
    s = retrieval.seed_nodes(_queries(spark, root), _nodes(spark, root), _similar_nodes(spark, root, 5), 5)
    return s.select("query_id", "name", F.round("weight", 6).alias("weight"))


def flow_spread(spark, root):
    flow, _ = walks.spread_flow(_edges(spark, root), _sources(spark, root), 3, 0.8, FLOW)
    return flow.select("source", "node", F.round("flow", 8).alias("flow"), "hop")


def _targets(spark, root):
    return table(spark, root, "gazetteer", "name").select(graph.node_key(F.col("name")).alias("name"))


#: Shares of flow below this are not passed on: a bit lower than the usual 0.02, as the nodes of the test tables have more edges.
FLOW = 0.01


def _paths(spark, root):
    return walks.relational_paths(_edges(spark, root), _sources(spark, root), _targets(spark, root), 3, 0.8, FLOW)


def relational_paths(spark, root):
    """The ten best paths of up to three edges from each entity near a question to the gazetteer's names."""
    p = _paths(spark, root).withColumn("score", F.round("score", 8))
    return walks.best_paths(p, ["source"], 10).select("source", "target", F.array_join("path", " > ").alias("path"), "score", "rank")


def path_text(spark, root):
    p = walks.best_paths(_paths(spark, root).withColumn("score", F.round("score", 8)), ["source"], 10)
    return walks.narrated(p, _first_edge_description(spark, root)).select("source", "rank", F.md5("line").alias("line_md5"))


def k_shortest_bounded(spark, root):
    pairs = _sources(spark, root).select(F.col("name").alias("source")).crossJoin(F.broadcast(_targets(spark, root).select(F.col("name").alias("target"))))
    return walks.shortest_paths(_edges(spark, root), pairs, 3, 3).select("source", "target", F.array_join("path", " > ").alias("path"), "rank")


def _facts(spark, root):
    return table(spark, root, "facts", "fact_id", "source", "relation", "target", "valid_from", "valid_to", "recorded_at", "invalidated_at", "prior_valid_to").distinct()


def as_of_snapshot(spark, root):
    return temporal.as_of(_facts(spark, root), "2015-06-01").select("fact_id")


def known_at_snapshot(spark, root):
    return temporal.as_of(_facts(spark, root), "2015-06-01", "2016-01-01").select("fact_id")


def fact_holders(spark, root):
    return temporal.holders(_facts(spark, root), "2018-01-01")


def facts_replayed(spark, root):
    f = temporal.replay(_facts(spark, root)).where(F.col("relation").isin(temporal.EXCLUSIVE))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return f.select("fact_id", day("valid_to"), day("invalidated_at"), day("prior_valid_to"))


def facts_scd2(spark, root):
    return temporal.succession(_facts(spark, root)).select("fact_id", F.date_format("closed_to", "yyyy-MM-dd").alias("closed_to"))


def _scored(spark, root):
    return evaluation.scored_answers(table(spark, root, "questions", "id", "type", "answer", "supporting_docs"), table(spark, root, "search_results", "id", "question_id", "method", "answer", "sources"))


def answer_scores(spark, root):
    return _scored(spark, root).select("id", "exact_match", F.round("token_f1", 6).alias("token_f1"), F.round("context_recall", 6).alias("context_recall"))


def eval_grouping_sets(spark, root):
    s = evaluation.summarize(_scored(spark, root))
    return s.select("system", "group", "n", "exact_match", "token_f1", "context_recall")


def _answers(spark, root):
    r = table(spark, root, "search_results", "id", "question_id", "method", "answer").dropDuplicates(["id"])
    return r.where("answer is not null").select("question_id", F.col("method").alias("system"), "answer")


def judge_pairs(spark, root):
    return evaluation.judged_pairs(_answers(spark, root), "basic", "hybrid")


def judge_pivot(spark, root):
    return evaluation.win_table(judge_pairs(spark, root))


def questions_answered(spark, root):
    """Extractive answers: the answers' sentences that share the rarest words with the question, the best per question."""
    q = table(spark, root, "questions", "id", "question").dropDuplicates(["id"])
    a = _answers(spark, root).join(q, F.col("question_id") == F.col("id")).select("id", "question", F.explode(X.sentences(F.col("answer"))).alias("s")).distinct()
    w = a.select("id", "s", F.explode(F.array_intersect(X.analyze(F.col("s")), X.analyze(F.col("question")))).alias("w"))
    df = w.groupBy("id", "w").agg(F.count(F.lit(1)).alias("df"))
    n = a.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    scored = w.join(df, ["id", "w"]).join(n, "id").groupBy("id", "s").agg(F.round(F.sum(F.log(1 + F.col("n") / F.col("df"))), 6).alias("score"))
    return ranking.best_of(scored, ["id"], [F.desc("score"), F.col("s")], 5).select("id", F.md5("s").alias("sentence_md5"), "score", "rank")


def global_answers(spark, root):
    r, q = cut(_reports(spark, root)), _queries(spark, root)
    return answers.reduce_points(answers.map_points(q, r), q, answers.report_batches(r, 3000))


def drift_follow_ups(spark, root):
    q = _queries(spark, root)
    best = ranking.best_of(answers.map_points(q, _reports(spark, root), 1), ["query_id"], [F.desc("score"), F.col("id")], 5)
    return answers.follow_ups(q, _nodes(spark, root).select("name"), best.select("query_id", F.col("point").alias("content")))


def extractive_summaries(spark, root):
    d = table(spark, root, "text_units", "id", "text").dropDuplicates(["id"])
    return d.select("id", answers.extractive_summary(X.sentences(F.coalesce("text", F.lit(""))), 60).alias("summary"))


def substituted_context(spark, root):
    m = _members(spark, root).where("level = 1").select("community", "parent", "name")
    return answers.substituted_context(_edges(spark, root), m, _reports(spark, root).where("level = 1").select("id", "content"), 200)


def queries() -> dict:
    return {f.__name__: f for f in (
        global_answers, drift_follow_ups, extractive_summaries, substituted_context, node_merge, edge_merge, degree_rank, combined_degree, canonical_rewrite, alias_by_token_subset, edit_similarity, neighbourhood, triples_text, table_text, node_link_json, cypher_export,
        modularity_by_type, louvain_partition, community_hierarchy, community_context, community_reports, reports_at_level, map_scores, dynamic_selection,
        cosine_topk, cosine_topk_batch, vector_append, hashed_vectors_md5, hashed_vectors_blake, bm25_topk, rrf_fusion, hybrid_retrieval, basic_context_budget,
        query_entities, local_edges_ranked, local_units_ranked, dual_level_edges, keyword_split, rank_prizes, pcst_subgraph, ppr, passage_rank, seed_nodes,
        flow_spread, relational_paths, path_text, k_shortest_bounded, as_of_snapshot, known_at_snapshot, fact_holders, facts_replayed, facts_scd2,
        answer_scores, eval_grouping_sets, judge_pairs, judge_pivot, questions_answered,
    )}


def _key(c: str) -> str:
    return f"upper(regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"


_N = f"""
m as (select distinct mention_id as seq, {_key('name')} as name, replace(upper(trim(type)), ' ', '_') as type, description, source_id as unit_id from entity_mentions where {_key('name')} <> ''),
votes as (select name, type, count(*) as n, min(seq) as f from m where type <> '' group by all),
kinds as (select name, type from (select *, row_number() over (partition by name order by n desc, f) as k from votes) where k = 1),
n as (select s.name, coalesce(kinds.type, '') as type, frequency, n_descriptions, first_seq from
  (select name, count(distinct unit_id) as frequency, count(distinct description) as n_descriptions, min(seq) as first_seq from m group by name) s left join kinds using (name))
"""
_E = f"""
r as (select distinct rel_id as seq, {_key('source')} as a, {_key('target')} as b, coalesce(strength, 1.0) as s, source_id as unit_id from relationships),
e as (select least(a, b) as u, greatest(a, b) as v, sum(s) as weight, count(*) as n_mentions, count(distinct unit_id) as n_units, min(seq) as first_seq from r where a <> '' and b <> '' and a <> b group by all),
adj as (select u as node, v as other, weight from e union all select v, u, weight from e),
deg as (select node, count(*) as degree from adj group by node),
ec as (select e.*, du.degree + dv.degree as combined_degree from e join deg du on du.node = u join deg dv on dv.node = v),
al as (select name, type, frequency from n union all select distinct node, '', 0 from adj where node not in (select name from n))
"""
_Q = """
q as (select distinct id as query_id, question as text from questions where cast(regexp_replace(id, '[^0-9]', '', 'g') as bigint) % 100 = 0)
"""
_EVERY_Q = """
q as (select distinct id as query_id, question as text from questions)
"""


def _bm25_sql(name: str, source: str, id_col: str, text: str, k: int) -> str:
    """CTEs ending in `name` (query_id, id, score, rank)."""
    return f"""
{name}_d as (select {id_col} as id, {terms_sql(text)} as w from {source}),
{name}_l as (select id, coalesce(len(w), 0) as dl from {name}_d),
{name}_a as (select count(*) as n, avg(dl) as a from {name}_l),
{name}_t as (select id, term, count(*) as tf from (select id, unnest(w) as term from {name}_d) group by all),
{name}_f as (select term, count(*) as df from {name}_t group by term),
{name}_q as (select query_id, unnest(list_distinct({terms_sql('text')})) as term from q),
{name}_s as (select query_id, t.id, round(sum(ln((x.n - f.df + 0.5) / (f.df + 0.5) + 1) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.dl / x.a))), 6) as score
  from {name}_q qq join {name}_t t using (term) join {name}_f f using (term) join {name}_l l on l.id = t.id, {name}_a x group by query_id, t.id),
{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from {name}_s) where rank <= {k})
"""


def _hash_sql(name: str, source: str, id_col: str, text: str) -> str:
    """CTEs ending in `name` (id, bucket, value)."""
    return f"""
{name}_t as (select {id_col} as id, unnest({terms_sql(text)}) as term from {source}),
{name}_c as (select id, cast('0x' || substr(md5(term), 1, 8) as bigint) % 512 as bucket, sum(case when substr(md5(term), 9, 1) < '8' then 1.0::double else -1.0::double end) as v from {name}_t group by all),
{name} as (select id, bucket, v / nullif(sqrt(sum(v * v) over (partition by id)), 0) as value from {name}_c)
"""


def _hits_sql(k: int) -> str:
    return _hash_sql("hd", "documents", "doc_id", "text") + "," + _hash_sql("hq", "q", "query_id", "text") + f""",
hits as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from
  (select hq.id as query_id, hd.id, round(sum(hd.value * hq.value), 6) as score from hd join hq using (bucket) where hd.value is not null and hq.value is not null group by all)) where rank <= {k})
"""


_RANKED = "," + _bm25_sql("b", "documents", "doc_id", "text", 20) + "," + _hits_sql(20) + """,
fused as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from
  (select query_id, id, round(sum(1.0::double / (60 + rank)), 8) as score from (select query_id, id, rank from b union all select query_id, id, rank from hits) group by all)) where rank <= 10)
"""
_RRF = "with " + _Q + _RANKED
_SIM = _bm25_sql("sim", "n", "name", "name", 20)
_WORDS = r"'[\p{L}\p{N}_]+'"
_NAMED = f"""
named as (select distinct query_id, n.name, n.frequency from q, n where len(regexp_extract_all(upper(n.name), {_WORDS})) > 0
  and contains(' ' || array_to_string(regexp_extract_all(upper(q.text), {_WORDS}), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(upper(n.name), {_WORDS}), ' ') || ' '))
"""
_QE = _SIM + "," + _NAMED + """,
qe as (select * from (select query_id, name, row_number() over (partition by query_id order by tier, o, name) as rank from
  (select query_id, name, min(tier) as tier, arg_min(o, tier) as o from (select query_id, name, 0 as tier, frequency as o from named union all select query_id, id, 1, rank from sim) group by all)) where rank <= 10)
"""
_PRIZED = _SIM + """,
pq as (select query_id, id as name, (11 - rank)::double as prize from sim where rank <= 10),
pz as (select distinct name from pq)
"""
_PRIZES = "with " + _N + "," + _E + "," + _Q + "," + _PRIZED


def _ppr_sql(rounds: int = 50, asked: str = _Q) -> str:
    out = "with " + _N + "," + _E + "," + asked + "," + _PRIZED + """,
po as (select node, sum(weight) as o from adj where weight > 0 group by node),
st as materialized (select adj.node, adj.other, adj.weight / po.o as m from adj join po using (node) where weight > 0),
s0 as (select query_id, name, prize / sum(prize) over (partition by query_id) as s from pq where name in (select name from al)),
sd as materialized (select s0.*, coalesce((select sum(z.s) from s0 z where z.query_id = s0.query_id and z.name not in (select node from po)), 0) as apart from s0), p0 as (select query_id, name, s as p from sd)
"""
    for k in range(1, rounds + 1):
        x = "(0.85::double * apart)"
        out += f""",
p{k} as materialized (select query_id, name, sum(p) as p from (select query_id, other as name, 0.85::double * m * p as p from st join p{k - 1} z on z.name = st.node
  union all select query_id, name, s * (0.15::double + 0.85::double * apart * (0.15::double * (1 - pow({x}, {k - 1})) / (1 - {x}) + pow({x}, {k - 1}))) from sd) group by all)
"""
    return out


def _flow_sql(hops: int) -> str:
    out = _PRIZES + """,
f0 as (select name as source, name as node, 1.0::double as flow, 0 as hop from pz where name in (select node from deg)), a0 as (select * from f0)
"""
    for k in range(1, hops + 1):
        out += f""",
x{k} as materialized (select source, node, 0.8 * flow / degree as share from f{k - 1} join deg using (node) where 0.8 * flow / degree >= {FLOW}),
f{k} as materialized (select source, adj.other as node, sum(share) as flow, {k} as hop from x{k} join adj using (node) where not exists (select 1 from a{k - 1} a where a.source = x{k}.source and a.node = adj.other) group by source, adj.other),
a{k} as (select * from a{k - 1} union all select * from f{k})
"""
    return out


def _step_sql(k: int) -> str:
    return f"""s{k} as (select s{k - 1}.source, adj.other as last, list_append(path, adj.other) as path, total + a.flow as total from s{k - 1} join ex on ex.source = s{k - 1}.source and ex.node = s{k - 1}.last join adj on adj.node = s{k - 1}.last join a3 a on a.source = s{k - 1}.source and a.node = adj.other
  where s{k - 1}.last not in (select name from tg) and not list_contains(path, adj.other))"""


_PATHS = _flow_sql(3) + f""",
tg as (select {_key('name')} as name from gazetteer), ex as (select source, node from x1 union select source, node from x2 union select source, node from x3),
s1 as (select f0.source, adj.other as last, [f0.source, adj.other] as path, a.flow as total from f0 join ex on ex.source = f0.source and ex.node = f0.node join adj on adj.node = f0.node join a3 a on a.source = f0.source and a.node = adj.other where adj.other <> f0.source),
""" + _step_sql(2) + "," + _step_sql(3) + """,
pt as (select source, last as target, path, round(total / (len(path) - 1), 8) as score from (select * from s1 union all select * from s2 union all select * from s3) where last in (select name from tg)),
pb as (select * from (select *, row_number() over (partition by source order by score desc, len(path), path) as rank from pt) where rank <= 10)
"""
_ED = f"""ed as (select u, v, arg_min(description, seq) as description from (select rel_id as seq, least({_key('source')}, {_key('target')}) as u, greatest({_key('source')}, {_key('target')}) as v, min(description) as description from relationships where description <> '' group by all) group by u, v)"""

_MEMBERS = """
mem as (select 0 as level, type as community, null as parent, name from n where type <> '' union all select 1, type || '/' || name[1], type, name from n where type <> ''),
md as (select mem.*, coalesce(degree, 0) as degree from mem left join deg on deg.node = name)
"""
_REPORTS = "with " + _N + "," + _E + "," + _MEMBERS + """,
hd as (select community, level, parent, string_agg(name, ', ' order by k) as names from (select *, row_number() over (partition by community order by degree desc, name) as k from md) where k <= 3 group by all),
inr as (select a.community, count(*) as n_rels from e join mem a on a.name = e.u join mem b on b.name = e.v and a.community = b.community group by all),
rp as (select hd.community as id, level, parent, 'This community centres on ' || names || '.' as content, round(least(10.0::double, 2 + 0.5::double * coalesce(n_rels, 0)), 1) as rating from hd left join inr using (community))
"""
_BROAD = ", ".join(f"'{w}'" for w in retrieval.BROAD)


def _rule_sql(broad: str, else_: str) -> str:
    shared = f"len(list_intersect(list_distinct({terms_sql('q.text')}), list_distinct({terms_sql('rp.content')})))"
    return f"case when len(list_intersect({terms_sql('q.text')}, [{_BROAD}])) > 0 then {broad.format(n=shared)} else {else_.format(n=shared)} end"


_SENTENCES = "len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(" + "".join("regexp_replace(" for _ in X.ABBREVIATIONS) + "{c}" + "".join(
    rf", '(^|[^A-Za-z]){a.replace('.', chr(92) + '.')}', '\1{a.replace('.', '․')}', 'g')" for a in X.ABBREVIATIONS) + r", '([.!?])([ \t\r\f\x{{0B}}])', '\1' || chr(1) || '\2', 'g'), '\n', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[" + SPACE.replace("{", "{{").replace("}", "}}") + "]+|[" + SPACE.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g')), lambda s: length(s) > 0))"
_NORM = f"list_filter(regexp_extract_all(regexp_replace(lower({{c}}), '[!-/:-@\\[-`{{{{-~]', '', 'g'), '[^{SPACE.replace('{', '{{').replace('}', '}}')}]+'), lambda w: w not in ('a', 'an', 'the'))"
_SCORED = f"""
with s as (select distinct id, question_id, method, coalesce(answer, '') as answer, coalesce(sources, []) as sources from search_results), g as (select distinct id as question_id, type, coalesce(answer, '') as gold, coalesce(supporting_docs, []) as docs from questions),
j as (select s.id, type, method as system, {_NORM.format(c='answer')} as p, {_NORM.format(c='gold')} as g, sources, list_distinct(docs) as docs, len(list_distinct(list_filter(docs, lambda d: d is not null))) + cast(len(list_filter(docs, lambda d: d is null)) > 0 as integer) as n_docs from s join g using (question_id)),
k as (select *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) as common from j),
sc as (select id, type, system, cast(p = g as double) as exact_match, case when common > 0 then 2.0::double * common / (len(p) + len(g)) else 0 end as token_f1,
  case when n_docs = 0 then 1.0::double else (len(list_intersect(list_distinct(docs), list_distinct(sources))) + cast(n_docs > len(list_distinct(docs)) and len(list_filter(sources, lambda d: d is null)) > 0 as integer))::double / n_docs end as context_recall from k)
"""
_PAIRED = "with x as (select distinct id, question_id, method, answer from search_results where answer is not null), a as (select question_id, min(answer) as x from x where method = 'basic' group by 1), b as (select question_id, min(answer) as y from x where method = 'hybrid' group by 1), j as (select * from a join b using (question_id)), jm as (" + " union all ".join(
    f"select question_id, '{c}' as criterion, {m.format(c='x')} as mx, {m.format(c='y')} as my from j" for c, m in {
        "comprehensiveness": "len(list_distinct(" + terms_sql("{c}") + "))", "diversity": _SENTENCES,
        "empowerment": "len(string_split({c}, '[Data:')) - 1", "directness": "-len(regexp_extract_all({c}, '[^" + SPACE.replace("{", "{{").replace("}", "}}") + "]+'))",
    }.items()) + "), jw as (select question_id, criterion, case when mx > my then 'A' when my > mx then 'B' else 'TIE' end as winner from jm)"
_DAY = "strftime({c}, '%Y-%m-%d') as {c}"


def oracles() -> dict[str, str]:
    w = "with "
    return {
        "node_merge": w + _N + "select * from n",
        "edge_merge": w + _E.replace(", al as", ", al_ as").split("adj as")[0].rstrip().rstrip(",") + " select u, v, round(weight, 6) as weight, n_mentions, n_units, first_seq from e",
        "degree_rank": w + _N + "," + _E + "select name, type, frequency, coalesce(degree, 0) as degree, row_number() over (order by name) - 1 as human_id from al left join deg on node = name",
        "combined_degree": w + _N + "," + _E + "select u, v, combined_degree from ec",
        "canonical_rewrite": rf"with a as (select {_key('name')} as alias, min(regexp_replace(array_to_string(regexp_extract_all(regexp_replace(upper(name), '[''’]S\b', '', 'g'), '[A-Z0-9]+'), ' '), '^(({'|'.join(X.TITLES)})( |$))+', '')) as canonical from entities group by 1), r as (select distinct rel_id, {_key('source')} as source from relationships) select rel_id, coalesce(canonical, source) as source from r left join a on alias = source",
        "alias_by_token_subset": rf"with x as (select distinct {_key('name')} as name, upper(type) as type from entities where type is not null), n as (select name, type, list_distinct(string_split(regexp_replace(array_to_string(regexp_extract_all(regexp_replace(name, '[''’]S\b', '', 'g'), '[A-Z0-9]+'), ' '), '^(({'|'.join(X.TITLES)})( |$))+', ''), ' ')) as words from x), k as (select * from n where len(words) > 0 and not list_contains(words, '')) select a.name as alias, a.type, min(b.name) as canonical from k a join k b on a.type = b.type and len(a.words) < len(b.words) and list_has_all(b.words, a.words) group by a.name, a.type having count(distinct b.name) = 1",
        "edit_similarity": "select fact_id, round(1 - levenshtein(source, target)::double / greatest(length(source), length(target), 1), 6) as similarity from (select distinct fact_id, regexp_replace(source, '[^\\x00-\\x7f]', '~', 'g') as source, regexp_replace(target, '[^\\x00-\\x7f]', '~', 'g') as target from facts)",
        "neighbourhood": w + _N + "," + _E + "select node as name, md5(node || ': ' || string_agg(distinct other, ', ' order by other)) as line_md5 from adj group by node",
        "triples_text": w + _N + "," + _E + "," + _ED + " select md5('(' || u || ', ' || coalesce(description, '') || ', ' || v || ')') as line_md5 from e left join ed using (u, v)",
        "table_text": w + _N + "," + _E + "select replace(u, '|', '/') || '|' || replace(v, '|', '/') || '|' || combined_degree as line from ec",
        "node_link_json": w + _N + """select name, '{"id":' || to_json(name) || ',"type":' || to_json(type) || ',"frequency":' || frequency || '}' as node from n""",
        "cypher_export": w + _N + "," + _E + "," + _ED + r""", nd as (select name, arg_min(description, seq) as description from m where description <> '' group by name)
            select kind, md5(statement) as statement_md5 from (select 'node' as kind, 'MERGE (n:Entity:' || coalesce(nullif(array_to_string(list_transform(list_filter(regexp_split_to_array(type, '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(p[2:])), ''), ''), 'Thing') || ' {name: ' || to_json(name) || '}) SET n.description = ' || to_json(coalesce(description, '')) || ', n.degree = ' || coalesce(degree, 0) as statement from n left join deg on node = name left join nd using (name)
            union all select 'edge', 'MATCH (a:Entity {name: ' || to_json(u) || '}), (b:Entity {name: ' || to_json(v) || '}) MERGE (a)-[r:RELATED_TO]->(b) SET r.description = ' || to_json(coalesce(description, '')) || ', r.weight = ' || printf('%.2f', weight) from e left join ed using (u, v))""",
        "modularity_by_type": w + _N + "," + _E + ", l as (select a.type as c, sum(weight) as l from e join al a on a.name = u join al b on b.name = v where a.type = b.type group by 1), d as (select type as c, sum(weight) as d from adj join al on al.name = node group by 1), mm as (select sum(weight) as m from e) select round(sum(coalesce(l, 0) / mm.m - (d / (2 * mm.m)) * (d / (2 * mm.m))), 6) as modularity from d left join l using (c), mm",
        "community_context": w + _N + "," + _E + "," + _MEMBERS + f""", ents as (select community, name, sum({tokens_sql("name || '|' || degree")}) over (partition by community order by degree desc, name rows unbounded preceding) as used_tokens from md),
            rel as (select a.community, u, v, sum({tokens_sql("u || '|' || v || '|' || combined_degree")}) over (partition by a.community order by combined_degree desc, u, v rows unbounded preceding) as used_tokens from ec join mem a on a.name = u join mem b on b.name = v and a.community = b.community)
            select community, 'entity' as kind, name as a, '' as b, used_tokens from ents where used_tokens <= 200 union all select community, 'relationship', u, v, used_tokens from rel where used_tokens <= 200""",
        "community_reports": _REPORTS + "select * from rp",
        "reports_at_level": _REPORTS + "select id, level, rating from rp where level = 1 or level < 1 and id not in (select parent from rp where parent is not null)",
        "map_scores": _REPORTS + "," + _Q + f"select * from (select query_id, rp.id, least(100, {_rule_sql('40 + 10 * {n}', '25 * {n}')}) as score from q, rp) where score >= 20",
        "dynamic_selection": _REPORTS + "," + _Q + f", rt as (select query_id, rp.id, parent, level, {_rule_sql('3', 'least(5, {n})')} as rating from q, rp), g0 as (select * from rt where level = 0 and rating >= 1), g1 as (select rt.* from rt join g0 on g0.query_id = rt.query_id and rt.parent = g0.id where rt.rating >= 1) select query_id, id from g1 union all select query_id, id from g0 where not exists (select 1 from g1 where g1.query_id = g0.query_id and g1.parent = g0.id)",
        "cosine_topk": "select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id = 7)) where rank <= 10",
        "cosine_topk_batch": "select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 100 = 0)) where rank <= 10",
        "vector_append": "select vec_id as id, len(embedding) as dim from embeddings union all select vec_id + 1000000, len(embedding) from embeddings",
        "hashed_vectors_md5": w + _hash_sql("h", "(select distinct id, text from text_units)", "id", "text") + "select id, bucket, round(value, 6) as value from h where value <> 0",
        "bm25_topk": w + _Q + "," + _bm25_sql("b", "documents", "doc_id", "text", 10) + "select * from b",
        "rrf_fusion": _RRF + "select * from fused",
        "hybrid_retrieval": w + _EVERY_Q + _RANKED + f"select * from (select query_id, f.id, f.rank, sum({tokens_sql('text')}) over (partition by query_id order by f.rank rows unbounded preceding) as used_tokens from fused f join documents on doc_id = f.id) where used_tokens <= 4000",
        "basic_context_budget": w + _Q + "," + _hits_sql(5) + f"select * from (select query_id, f.id, sum({tokens_sql('text')}) over (partition by query_id order by f.rank rows unbounded preceding) as used_tokens from hits f join documents on doc_id = f.id) where used_tokens <= 1000",
        "query_entities": w + _N + "," + _Q + "," + _QE + "select * from qe",
        "local_edges_ranked": w + _N + "," + _E + "," + _Q + "," + _QE + f""", o as (select query_id, node, other, weight, exists (select 1 from qe z where z.query_id = qe.query_id and z.name = adj.other) as inside from qe join adj on node = name),
            l as (select query_id, other, count(*) as links from o where not inside group by all), b as (select o.query_id, node as source, o.other as target, weight, inside, case when inside then 0 else links end as links from o left join l on l.query_id = o.query_id and l.other = o.other where not inside or node < o.other)
            select query_id, source, target, round(weight, 6) as weight, inside, links, used_tokens from (select *, sum({tokens_sql("source || '|' || target || '|' || cast(round(weight, 1) as varchar)")}) over (partition by query_id order by inside desc, links desc, weight desc, source, target rows unbounded preceding) as used_tokens from b) where used_tokens <= 800""",
        "local_units_ranked": w + _N + "," + _E + "," + _Q + "," + _QE + f""", nu as (select distinct name, unit_id from m where unit_id is not null), o as (select distinct query_id, least(node, other) as u, greatest(node, other) as v from qe join adj on node = name),
            ct as (select query_id, unit_id, count(*) as n from o join (select distinct least(a, b) as u, greatest(a, b) as v, unit_id from r where unit_id is not null) using (u, v) group by all), tx as (select distinct id as unit_id, {tokens_sql('text')} as n_tokens from text_units),
            b as (select query_id, unit_id, min(rank) as best_rank from qe join nu using (name) group by all), c as (select b.*, coalesce(n, 0) as n_cited, n_tokens from b left join ct using (query_id, unit_id) join tx using (unit_id))
            select query_id, unit_id, best_rank, n_cited, used_tokens from (select *, sum(n_tokens) over (partition by query_id order by best_rank, n_cited desc, unit_id rows unbounded preceding) as used_tokens from c) where used_tokens <= 1500""",
        "dual_level_edges": w + _N + "," + _E + "," + _Q + "," + _SIM + "," + _bm25_sql("rl", "(select u || '|' || v as rid, u || ' ' || v as label from ec)", "rid", "label", 5) + """, nr as (select *, row_number() over (partition by query_id order by combined_degree desc, round(weight, 6) desc, u, v) as r from (select distinct query_id, u, v, weight, combined_degree from ec join (select query_id, id from sim where rank <= 10) on id = u or id = v)),
            gl as (select query_id, u, v, rank as r from rl join ec on ec.u || '|' || ec.v = rl.id), bo as (select query_id, u, v, case when r <= 10 then 0 else 2 end as part, r from nr union all select query_id, u, v, 1, r from gl),
            f as (select query_id, u, v, min(part) as part, arg_min(r, part) as r from bo group by all) select query_id, u, v, row_number() over (partition by query_id order by part, r, u, v) as position from f""",
        "keyword_split": w + _Q + f", nm as (select distinct name from (select name from gazetteer union all select name from entities)), lo as (select query_id, list_sort(list_distinct(list(upper(name)))) as low from q, nm where len(regexp_extract_all(upper(name), {_WORDS})) > 0 and contains(' ' || array_to_string(regexp_extract_all(upper(text), {_WORDS}), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(upper(name), {_WORDS}), ' ') || ' ') group by query_id), j as (select query_id, text, coalesce(low, []) as low from q left join lo using (query_id)) select query_id, array_to_string(low, ';') as low, array_to_string(list_sort(list_filter(list_distinct({terms_sql('text')}), lambda t: not list_contains({terms_sql("array_to_string(low, ' ')")}, t))), ';') as high from j",
        "rank_prizes": w + _N + "," + _Q + "," + _SIM + "select query_id, id as name, (11 - rank)::double as prize from sim where rank <= 10",
        "ppr": _ppr_sql(asked=_EVERY_Q) + "select query_id, name, round(p, 8) as p from p50 where round(p, 8) > 0",
        "passage_rank": _ppr_sql(asked=_EVERY_Q) + ", nu as (select distinct name, unit_id from m where unit_id is not null) select * from (select query_id, unit_id, round(sum(p), 8) as score from nu join p50 using (name) group by query_id, unit_id) where score > 0",
        "seed_nodes": w + _N + "," + _Q + "," + _SIM + "," + _NAMED + """, b as (select query_id, name, max(score) as score from (select query_id, name, 1.0::double as score from named union all select query_id, id, score from sim where rank <= 5) group by all),
            t as (select *, row_number() over (partition by query_id order by score desc, name) as k from b) select query_id, name, round(score / greatest(frequency, 1), 6) as weight from t join n using (name) where k <= 5 and score > 0""",
        "flow_spread": _flow_sql(3) + "select source, node, round(flow, 8) as flow, hop from a3",
        "relational_paths": _PATHS + "select source, target, array_to_string(path, ' > ') as path, score, rank from pb",
        "path_text": _PATHS + "," + _ED + """, pn as (select source, rank, score, path, unnest(range(1, len(path))) as k from pb),
            ph as (select pn.*, ' --[' || substr(coalesce(description, 'related to'), 1, 200) || ']--> ' || path[k + 1] as s from pn left join ed on u = least(path[k], path[k + 1]) and v = greatest(path[k], path[k + 1]))
            select source, rank, md5(path[1] || string_agg(s, '' order by k) || '  (score ' || printf('%.3f', score) || ')') as line_md5 from ph group by source, rank, path, score""",
        "k_shortest_bounded": _PRIZES + f""", pr as (select pz.name as source, t.name as target from pz, (select {_key('name')} as name from gazetteer) t where pz.name <> t.name),
            k1 as (select source, target, [source, target] as path from pr join adj on node = source and other = target),
            k2 as (select source, target, [source, a.other, target] as path from pr join adj a on a.node = source join adj b on b.node = a.other and b.other = target where a.other <> target),
            k3 as (select source, target, [source, a.other, b.other, target] as path from pr join adj c on c.other = target join adj b on b.other = c.node join adj a on a.other = b.node and a.node = source where a.other <> target and b.other <> source and b.other <> target and a.other <> source)
            select source, target, array_to_string(path, ' > ') as path, rank from (select *, row_number() over (partition by source, target order by len(path), path) as rank from (select * from k1 union all select * from k2 union all select * from k3)) where rank <= 3""",
        "as_of_snapshot": "select distinct fact_id from facts where valid_from <= date '2015-06-01' and (valid_to is null or date '2015-06-01' < valid_to)",
        "known_at_snapshot": "select distinct fact_id from (select *, case when invalidated_at > date '2016-01-01' then prior_valid_to else valid_to end as e from facts where coalesce(recorded_at, valid_from) <= date '2016-01-01') where valid_from <= date '2015-06-01' and (e is null or date '2015-06-01' < e)",
        "fact_holders": "select distinct relation, target, source from facts where valid_from <= date '2018-01-01' and (valid_to is null or date '2018-01-01' < valid_to)",
        "facts_replayed": """with f as (select distinct fact_id, source, relation, target, valid_from, valid_to, coalesce(recorded_at, valid_from) as rec from facts where valid_from is not null and relation in ('CTO_OF', 'CEO_OF')),
            o as (select *, row_number() over (partition by relation, target order by rec, fact_id) as k from f),
            c as (select a.fact_id, min(b.k) as k from o a join o b on a.relation = b.relation and a.target = b.target and b.k > a.k and b.source <> a.source and (a.valid_to is null or a.valid_to > b.valid_from) group by 1)
            select o.fact_id, strftime(case when c.k is null then o.valid_to else b.valid_from end, '%Y-%m-%d') as valid_to, strftime(b.rec, '%Y-%m-%d') as invalidated_at, strftime(case when c.k is not null then o.valid_to end, '%Y-%m-%d') as prior_valid_to
            from o left join c using (fact_id) left join o b on b.relation = o.relation and b.target = o.target and b.k = c.k""",
        "facts_scd2": "select fact_id, strftime(least(coalesce(valid_to, nxt), coalesce(nxt, valid_to)), '%Y-%m-%d') as closed_to from (select *, lead(valid_from) over (partition by relation, target order by valid_from, fact_id) as nxt from (select distinct fact_id, source, relation, target, valid_from, valid_to from facts where relation in ('CTO_OF', 'CEO_OF') and valid_from is not null))",
        "answer_scores": _SCORED + "select id, exact_match, round(token_f1, 6) as token_f1, round(context_recall, 6) as context_recall from sc",
        "eval_grouping_sets": _SCORED + "select system, case when grouping(type) = 1 then 'all' else type end as \"group\", count(*) as n, round(avg(exact_match), 3) as exact_match, round(avg(token_f1), 3) as token_f1, round(avg(context_recall), 3) as context_recall from sc group by grouping sets ((system), (system, type))",
        "judge_pairs": _PAIRED + " select * from jw",
        "judge_pivot": _PAIRED + " select criterion, count(*) filter (winner = 'A') as \"A\", count(*) filter (winner = 'B') as \"B\", count(*) filter (winner = 'TIE') as \"TIE\" from jw group by criterion",
    }
