"""Whole searches: for a batch of questions (query_id, text) the context, the answer and its sources, by every method.

A method puts together context rows (query_id, part, table, pos, id, text, line, unit_id): `part` and `pos` order the
tables and their rows, `text` is what answers are taken from, `line` what a prompt shows. All rankings are per query_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomgraph.functions import text as X
from loomgraph.operators import answers, models, prompts, ranking, reports, retrieval, search, sparse, walks
from loomgraph.operators.graph import both_ways
from loomgraph.session import cut
from loomgraph.sources.files import Index

NAMES = ["local", "global", "drift", "basic", "dual", "ppr", "hybrid", "subgraph"]
RESULT = ["query_id", "method", "answer", "context", "sources", "llm_calls"]
_HEADERS = {"Reports": "id|title|content", "Entities": "id|entity|description|number of relationships", "Relationships": "id|source|target|description|weight", "Sources": "id|text"}


def _line(*columns: str) -> Column:
    return F.concat_ws("|", *[X.clean_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def _table(rows: DataFrame, part: int, table: str, order: list[Column], budget: int | None, id_: str, text: str, line: Column, unit: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Context rows of one table, in order, within the budget."""
    rows = rows.withColumn("line", line)
    rows = rows.withColumn("tokens", tokens if tokens is not None else X.count_tokens(F.col("line")))
    if budget is not None:
        rows = ranking.budget_prefix(rows, ["query_id"], order, F.col("tokens"), budget, 1 if tokens is None else 0)
    rows = ranking.best_of(rows, ["query_id"], order, 1 << 30, "pos")
    return rows.select("query_id", F.lit(part).alias("part"), F.lit(table).alias("table"), "pos", F.col(id_).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), "line", (unit if unit is not None else F.lit(None)).cast("string").alias("unit_id"))


def context_text(rows: DataFrame) -> DataFrame:
    """Rows (query_id, context): the tables as text. Budgets bound what a query has."""
    names = F.create_map(*[F.lit(x) for kv in _HEADERS.items() for x in kv])
    head = rows.select("query_id", "part", "table").distinct().select("query_id", "part", F.lit(0).alias("pos"), F.concat(F.lit("-----"), "table", F.lit("-----\n"), names[F.col("table")]).alias("line"))
    lines = head.unionByName(rows.select("query_id", "part", "pos", "line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))), lambda x: x["line"]), "\n").alias("context"))


def extracted(queries: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """Rows (query_id, answer): the sentences of the context that share the rarest words with the question, each with its table and id."""
    parts = rows.select("query_id", "part", "table", "pos", "id", F.posexplode(F.split("text", r"\s{2,}")).alias("k", "piece"))
    s = parts.select("query_id", "part", "table", "pos", "id", "k", F.posexplode(X.sentences(F.col("piece"))).alias("i", "raw")).withColumn("s", X.clean_sentence(F.col("raw")))
    s = s.where((F.length("s") > 30) & F.col("s").rlike('[.!?"]$')).join(queries.select("query_id", X.analyze(F.col("text")).alias("q")), "query_id")
    s = s.select("query_id", F.struct("part", "pos", "k", "i").alias("at"), "table", "id", "s", F.array_distinct(F.array_intersect(X.analyze(F.col("s")), F.col("q"))).alias("w"))
    n = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    w = s.select("query_id", "at", "table", "id", "s", F.explode("w").alias("w"))
    df = w.groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("df"))
    scored = w.join(df, ["query_id", "w"]).join(n, "query_id").groupBy("query_id", "at", "table", "id", "s").agg(F.round(F.sum(F.log(1 + F.col("n") / F.col("df"))), 9).alias("score"))
    one = scored.groupBy("query_id", F.lower("s").alias("low")).agg(F.min(F.struct((-F.col("score")).alias("o"), "at", "table", "id", "s")).alias("b"))
    top = ranking.best_of(one.select("query_id", "b.*"), ["query_id"], [F.col("o"), F.col("at")], most)
    shown = F.concat("s", F.lit(" [Data: "), "table", F.lit(" ("), "id", F.lit(")]"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("x")))), lambda x: x["x"]), " ").alias("answer"))


def documents_of(index: Index, rows: DataFrame) -> DataFrame:
    """Rows (query_id, sources): the distinct documents of the context's units, in the order of their first unit."""
    u = rows.where("unit_id is not null").select("query_id", "part", "pos", "unit_id").join(index.text_units.select("unit_id", F.col("doc_id").cast("string").alias("doc_id")), "unit_id")
    first = u.groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "pos", "unit_id")).alias("o"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "doc_id"))), lambda x: x["doc_id"]).alias("sources"))


def answered(index: Index, queries: DataFrame, rows: DataFrame, method: str, calls: int = 1, sources: DataFrame | None = None, make: Callable[[], models.Model] | None = None, model: str = "rules", form: str = "multiple paragraphs") -> DataFrame:
    """One result row per question. Answers are taken from the context by rule, or asked from a model: the context is its system prompt, the question the user's."""
    rows = cut(rows)
    text = context_text(rows)
    q = queries.select("query_id", "text").join(text, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    if make is None:
        said = extracted(queries, rows)
    else:
        p = q.select("query_id", F.lit("answer").alias("task"), prompts.fill_column(prompts.ANSWER, form=form, context=F.col("context"), question=F.col("text")).alias("prompt"))
        said = models.complete_all(p, None, make, model)[0].select("query_id", F.col("reply").alias("answer"))
    docs = sources if sources is not None else documents_of(index, rows)
    none = F.array().cast("array<string>")
    return q.join(said, "query_id", "left").join(docs, "query_id", "left").select(
        "query_id", F.lit(method).alias("method"), F.coalesce("answer", F.lit(models.NOT_KNOWN)).alias("answer"), "context", F.coalesce("sources", none).alias("sources"), F.lit(calls).alias("llm_calls"))


# retrieval

def hits(index: Index, store: str, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, score, rank) of the store ('entity', 'relationship', 'text_unit', 'report') nearest to each text."""
    v = search.get_embedder(index.config.embedder)(queries.select("query_id", "text"), "query_id", "text").withColumnRenamed("id", "query_id")
    return search.cosine_top_k(v, index.tables[f"{store}_vectors"], k)


def names_of(index: Index) -> DataFrame:
    """Rows (name, said): every node under its own name and its aliases."""
    return index.entities.select("name", F.col("name").alias("said")).unionByName(index.entity_aliases.select("name", F.col("alias").alias("said")))


def named(index: Index, queries: DataFrame) -> DataFrame:
    """Rows (query_id, name): nodes whose name or alias stands in the text."""
    a = names_of(index)
    found = retrieval.named_in_query(queries, a.select(F.col("said").alias("name")).distinct())
    return found.withColumnRenamed("name", "said").join(a, "said").select("query_id", "name").distinct()


def chosen_entities(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, name, rank): nodes named in the question, the rarest first, then those of the nearest descriptions; k in all."""
    own = named(index, queries).join(index.entities.select("name", "frequency"), "name").select("query_id", "name", F.lit(0).alias("tier"), F.col("frequency").cast("bigint").alias("o"))
    near = hits(index, "entity", queries, 2 * k).select("query_id", F.col("id").alias("name"), F.lit(1).alias("tier"), F.col("rank").cast("bigint").alias("o"))
    first = own.unionByName(near).groupBy("query_id", "name").agg(F.min(F.struct("tier", "o")).alias("f"))
    return cut(ranking.best_of(first, ["query_id"], [F.col("f.tier"), F.col("f.o"), F.col("name")], k).select("query_id", "name", "rank"))


def _entity_rows(index: Index, chosen: DataFrame, part: int, budget: int | None) -> DataFrame:
    e = chosen.join(index.entities.select("name", "human_id", "description", "degree"), "name")
    return _table(e, part, "Entities", [F.col("rank"), F.col("name")], budget, "human_id", "description", _line("human_id", "name", "description", "degree"))


def _edge_rows(index: Index, edges: DataFrame, part: int, order: list[Column], budget: int | None) -> DataFrame:
    e = edges.join(index.relationships.select("u", "v", "human_id", "description", "weight"), ["u", "v"]).withColumn("w", F.round("weight", 2))
    return _table(e, part, "Relationships", order, budget, "human_id", "description", _line("human_id", "u", "v", "description", "w"))


def _unit_rows(index: Index, units: DataFrame, part: int, order: list[Column], budget: int) -> DataFrame:
    u = units.join(index.text_units.select("unit_id", "text"), "unit_id")
    return _table(u, part, "Sources", order, budget, "unit_id", "text", _line("unit_id", "text"), F.col("unit_id"), F.greatest(F.lit(1), X.count_tokens(F.col("text"))))


def local_context(index: Index, queries: DataFrame, k: int = 10, budget: int = 8000, report_share: float = 0.15, unit_share: float = 0.5) -> DataFrame:
    """Context rows around each question's entities: reports of their communities, the entities, their edges, and units.

    Reports of communities with the most of the entities come first, then by rating. Edges among the entities come first,
    then those to outside nodes that most of them touch. Units of the best entities come first, then the most cited.
    Edges share what the entities leave of their part of the budget.
    """
    chosen = chosen_entities(index, queries, k)
    counts = chosen.join(index.communities.select("community", "name"), "name").groupBy("query_id", "community").agg(F.count(F.lit(1)).alias("n"))
    r = counts.join(index.community_reports.select(F.col("id").alias("community"), "title", "content", "rating"), "community")
    report_rows = _table(r, 0, "Reports", [F.desc("n"), F.desc("rating"), F.col("community")], int(budget * report_share), "community", "content", _line("community", "title", "content"))
    local = int(budget * (1 - report_share - unit_share))
    entity_rows = _entity_rows(index, chosen, 1, local // 2)
    adj = both_ways(index.relationships)
    inside_mark = chosen.select("query_id", F.col("name").alias("other"), F.lit(True).alias("inside"))
    near = chosen.select("query_id", F.col("name").alias("node")).join(adj, "node").join(inside_mark, ["query_id", "other"], "left").fillna(False, ["inside"])
    near = cut(near.where("not inside or node < other"))
    links = near.where("not inside").groupBy("query_id", "other").agg(F.count(F.lit(1)).alias("links"))
    e = near.join(links, ["query_id", "other"], "left").select("query_id", F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), "inside", F.when(F.col("inside"), 0).otherwise(F.col("links")).alias("links"), F.col("weight").alias("strength"))
    edge_order = [F.desc("inside"), F.desc("links"), F.desc("strength"), F.col("u"), F.col("v")]
    used = entity_rows.groupBy("query_id").agg(F.sum(X.count_tokens(F.col("line"))).alias("used"))
    edge_rows = _edge_rows(index, e, 2, edge_order, local)
    t = X.count_tokens(F.col("line"))
    edge_rows = ranking.budget_prefix(edge_rows.join(used, "query_id", "left"), ["query_id"], [F.col("pos")], t, local).where(F.col("used_tokens") + F.coalesce("used", F.lit(0)) <= local).drop("used", "used_tokens")
    cited = e.select("query_id", "u", "v").join(index.relationship_units.select("u", "v", "unit_id"), ["u", "v"]).groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("n_cited"))
    u = chosen.join(index.entity_units.select("name", "unit_id"), "name").groupBy("query_id", "unit_id").agg(F.min("rank").alias("best")).join(cited, ["query_id", "unit_id"], "left").fillna(0, ["n_cited"])
    unit_rows = _unit_rows(index, u, 3, [F.col("best"), F.desc("n_cited"), F.col("unit_id")], int(budget * unit_share))
    return report_rows.unionByName(entity_rows).unionByName(edge_rows).unionByName(unit_rows)


def keywords(queries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(low, high) as questions (query_id, text): the names in each question, and its other words; the whole question where there are none."""
    own = retrieval.named_in_query(queries, names.select("name")).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("low"))
    j = queries.select("query_id", "text").join(own, "query_id", "left")
    high = F.array_join(F.array_except(F.array_distinct(X.analyze(F.col("text"))), X.analyze(F.coalesce("low", F.lit("")))), ", ")
    pick = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.col("text")).otherwise(c).alias("text")
    return j.select("query_id", pick(F.col("low"))), j.select("query_id", pick(high))


def dual_context(index: Index, queries: DataFrame, k: int = 10, budget: int = 4000, mode: str = "hybrid") -> DataFrame:
    """Context rows by two levels of keywords: entities near the names and their edges, and relationships near the other words with their ends."""
    low, high = keywords(queries, names_of(index).select(F.col("said").alias("name")))
    no_hits = lambda: hits(index, "entity", queries.limit(0), k)
    es = hits(index, "entity", low, k).select("query_id", F.col("id").alias("name"), "rank") if mode != "global" else no_hits().select("query_id", F.col("id").alias("name"), "rank")
    rel = index.relationships.select(F.col("human_id").cast("string").alias("id"), "u", "v")
    rs = (hits(index, "relationship", high, k) if mode != "local" else no_hits()).join(rel, "id").select("query_id", "u", "v", "rank")
    es, rs = cut(es), cut(rs)
    edges = cut(retrieval.dual_level_edges(es, rs, index.relationships, k, mode))
    ends = rs.select("query_id", F.explode(F.array("u", "v")).alias("name"), (F.col("rank") + (1 << 20)).alias("rank"))
    nodes = es.unionByName(ends).groupBy("query_id", "name").agg(F.min("rank").alias("rank"))
    third = budget // 3
    cites = nodes.select("query_id", "name").join(index.entity_units.select("name", "unit_id"), "name").select("query_id", "unit_id").unionByName(
        edges.select("query_id", "u", "v").join(index.relationship_units.select("u", "v", "unit_id"), ["u", "v"]).select("query_id", "unit_id"))
    units = cites.groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    return _entity_rows(index, nodes, 1, third).unionByName(_edge_rows(index, edges, 2, [F.col("position")], third)).unionByName(_unit_rows(index, units, 3, [F.desc("n"), F.col("unit_id")], third))


def linked(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, name, weight): PageRank seeds: named nodes score 1, those near the question their cosine; the k best, over their frequency."""
    both = named(index, queries).select("query_id", "name", F.lit(1.0).alias("score")).unionByName(hits(index, "entity", queries, k).select("query_id", F.col("id").alias("name"), "score"))
    top = ranking.best_of(both.groupBy("query_id", "name").agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), F.col("name")], k)
    return top.join(index.entities.select("name", "frequency"), "name").where("score > 0").select("query_id", "name", (F.col("score") / F.greatest("frequency", F.lit(1))).alias("weight"))


def passages(index: Index, queries: DataFrame, k: int, alpha: float = 0.85, rounds: int = 50) -> DataFrame:
    """Rows (query_id, id, rank): units by the summed PageRank of the nodes taken from them."""
    s = walks.passage_scores(index.relationships, index.entities, queries, cut(linked(index, queries)), index.entity_units.select("name", "unit_id"), k, alpha, rounds)
    s = s.select("query_id", F.col("unit_id").alias("id"), F.round("score", 12).alias("score"))
    return ranking.best_of(s, ["query_id"], [F.desc("score"), F.col("id")], k)


def word_hits(index: Index, queries: DataFrame, k: int) -> DataFrame:
    n, avg = search.corpus_stats(index.text_units, "text")
    return search.bm25(search.postings(index.text_units, "unit_id", "text"), n, avg, queries, k)


# methods

def _from_units(index: Index, queries: DataFrame, ranked: DataFrame, method: str, budget: int, calls: int, **how) -> DataFrame:
    rows = _unit_rows(index, ranked.select("query_id", F.col("id").alias("unit_id"), "rank"), 0, [F.col("rank")], budget)
    return answered(index, queries, rows, method, calls, **how)


def basic_search(index: Index, queries: DataFrame, k: int = 5, budget: int = 4000, **how) -> DataFrame:
    return _from_units(index, queries, hits(index, "text_unit", queries, k), "basic", budget, 1, **how)


def ppr_search(index: Index, queries: DataFrame, k: int = 5, budget: int = 4000, rounds: int = 50, **how) -> DataFrame:
    return _from_units(index, queries, passages(index, queries, k, rounds=rounds), "ppr", budget, 2, **how)


def hybrid_search(index: Index, queries: DataFrame, k: int = 5, candidates: int = 20, budget: int = 4000, rounds: int = 50, **how) -> DataFrame:
    """Rankings by words, by vectors and by PageRank, fused."""
    one = lambda r: r.select("query_id", "id", "rank", F.lit(1.0).alias("weight"))
    three = one(word_hits(index, queries, candidates)).unionByName(one(hits(index, "text_unit", queries, candidates))).unionByName(one(passages(index, queries, candidates, rounds=rounds)))
    fused = ranking.fuse_rankings(three, ["query_id"], "id").withColumn("score", F.round("score", 12))
    return _from_units(index, queries, ranking.best_of(fused, ["query_id"], [F.desc("score"), F.col("id")], k), "hybrid", budget, 1, **how)


def local_search(index: Index, queries: DataFrame, k: int = 10, budget: int = 8000, **how) -> DataFrame:
    return answered(index, queries, local_context(index, queries, k, budget), "local", 1, **how)


def dual_search(index: Index, queries: DataFrame, mode: str = "hybrid", k: int = 10, budget: int = 4000, **how) -> DataFrame:
    return answered(index, queries, dual_context(index, queries, k, budget, mode), f"dual-{mode}", 2, **how)


def prizes(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, name, prize): the i-th nearest entity, from 0, is worth k - i."""
    return hits(index, "entity", queries, k).select("query_id", F.col("id").alias("name"), (F.lit(k + 1) - F.col("rank")).cast("double").alias("prize"))


def subgraph_search(index: Index, queries: DataFrame, k: int = 10, edge_cost: float = 1.0, **how) -> DataFrame:
    """Answers from a connected part of the graph that holds the nodes most like the question."""
    trees = cut(walks.prize_subgraphs(index.relationships, prizes(index, queries, k), edge_cost))
    nodes = trees.select("query_id", F.posexplode("nodes").alias("rank", "name"))
    edges = trees.select("query_id", F.posexplode("edges").alias("o", "e")).select("query_id", "o", "e.u", "e.v")
    rows = _entity_rows(index, nodes, 1, None).unionByName(_edge_rows(index, edges, 2, [F.col("o")], None))
    units = nodes.join(index.entity_units.select("name", "unit_id"), "name").select("query_id", F.lit(0).alias("part"), F.col("rank").alias("pos"), "unit_id")
    return answered(index, queries, rows, "subgraph", 1, documents_of(index, units), **how)


def _report_sources(index: Index, chosen: DataFrame) -> DataFrame:
    d = reports.report_documents(chosen, index.communities, index.entity_units, index.text_units)
    return d.groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("sources"))


#: Bytes of sources that a task brings out at most, or those of one question.
SOURCE_BYTES = 1 << 26


def with_sources(index: Index, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """`rows` (query_id, ...) with `sources`: the distinct documents behind each question's reports (query_id, id), in their order.

    The documents of each report are shipped to the executors as files of numbers, and the last task of a question unites
    those of its reports: nothing grows as questions times nodes, and the sources themselves are not shuffled.
    """
    spark = rows.sparkSession
    behind = reports.report_documents(chosen.select(F.col("id").alias("query_id"), "id").distinct(), index.communities, index.entity_units, index.text_units)
    behind = cut(behind.select(F.col("query_id").alias("id"), F.col("doc_id").cast("string").alias("doc")).where("doc is not null").distinct())
    ids = sparse.numbered(behind.select(F.col("doc").alias("name")))
    files = sparse.Files()
    files.write({"doc_size": "<i4", "doc_bytes": "u1"}, sparse.stream(ids.orderBy("i").select(F.col("name").alias("doc")), {}, ("doc",)))
    files.add_pairs(behind.join(ids.withColumnRenamed("name", "doc"), "doc").select("id", "i"), "id", "i", "report")
    size = len(files.get("doc_bytes"))
    files = files.ship(spark)
    rows = cut(rows.join(chosen.groupBy("query_id").agg(F.collect_set("id").alias("_of")), "query_id", "left"))
    kind = StructType([*(f for f in rows.schema if f.name != "_of"), StructField("sources", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, report = files.texts("doc"), {x: k for k, x in enumerate(files.texts("report").to_pylist())}
        start, of = sparse.starts(files.get("report"), len(report)), files.get("report_of")
        for b in batches:
            own = b.drop_columns(["_of"])
            for r, names in enumerate(b.column("_of").to_pylist()):
                found = np.zeros(len(docs), bool)
                for k in (report[x] for x in names or [] if x in report):
                    found[of[start[k] : start[k + 1]]] = True
                at = docs.take(pa.array(np.flatnonzero(found))).cast(pa.string())
                sources = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), at)
                yield pa.RecordBatch.from_arrays([*own.slice(r, 1).columns, sources], kind.names)

    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() * size // SOURCE_BYTES))
    return rows.repartition(tasks).mapInArrow(run, kind)


def global_search(index: Index, queries: DataFrame, level: int | None = None, dynamic: bool = False, budget: int = 3000, least: int = 20, most: int = 8) -> DataFrame:
    """Map and reduce over community reports: each report's point by rule with a score, points under `least` dropped, the best in one answer.

    `dynamic` takes each question's reports from the top down instead of a level's. Sources are the documents behind all
    reports of a batch with a point.
    """
    r = index.community_reports.select("id", "level", "parent", "content")
    queries = cut(queries.select("query_id", "text"))
    asked = r if dynamic else cut(retrieval.reports_at(r, level or 0))
    points = answers.map_points(queries, asked, least).select("query_id", "id", "score")
    if dynamic:
        points = points.join(retrieval.select_reports(queries, r), ["query_id", "id"], "left_semi")
    points = cut(points)
    told = asked.select("id", answers.report_point(F.col("content"), F.col("id")).alias("point"))
    batches = cut(answers.report_batches(asked, budget))
    used = points.join(batches, "id").select("query_id", "batch").distinct().join(batches, "batch").select("query_id", "id") if not dynamic else points.select("query_id", "id")
    top = cut(ranking.best_of(points, ["query_id"], [F.desc("score"), F.col("id")], most).drop("rank").join(told, "id"))
    out = answers.reduce_points(top, queries, batches, most).select("query_id", "answer")
    top = ranking.best_of(top, ["query_id"], [F.desc("score"), F.col("id")], most)
    context = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "point"))), lambda x: F.concat(F.lit("Importance: "), x["score"].cast("string"), F.lit("\n"), x["point"])), "\n\n").alias("context"))
    n = batches.select("batch").distinct().count()
    said = queries.select("query_id").join(out, "query_id").join(context, "query_id", "left").select(
        "query_id", F.lit("global-dynamic" if dynamic else "global").alias("method"), "answer", F.coalesce("context", F.lit("")).alias("context"), F.lit(n + 1).alias("llm_calls"))
    return with_sources(index, said, used).select(*RESULT)


def drift_search(index: Index, queries: DataFrame, k: int = 5, follow: int = 3) -> DataFrame:
    """A first answer from the nearest reports, local searches for follow-up questions about names, and all of it merged."""
    queries = cut(queries.select("query_id", "text"))
    near = hits(index, "report", queries, k).join(index.community_reports.select("id", "title", "content"), "id")
    near = cut(near.select("query_id", "id", "rank", "title", "content"))
    rows = _table(near, 0, "Reports", [F.col("rank")], None, "id", "content", _line("id", "title", "content"))
    first = extracted(queries, rows).select("query_id", F.lit(0).alias("o"), F.lit(100).alias("score"), "answer")
    asked = cut(answers.follow_ups(queries, names_of(index).select(F.col("said").alias("name")).distinct(), near.select("query_id", "content"), follow))
    local = cut(local_search(index, asked.select(F.col("follow_id").alias("query_id"), "text")).select(F.col("query_id").alias("follow_id"), "answer", "sources"))
    later = asked.join(local, "follow_id").select("query_id", F.substring_index("follow_id", "#", -1).cast("int").alias("o"), F.lit(80).alias("score"), "answer")
    said = first.unionByName(later).where("answer <> ''")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "score", "answer"))), lambda x: F.struct(x["score"].alias("score"), F.array_join(F.split(x["answer"], r"\s+"), " ").alias("a")))
    merged = said.groupBy("query_id").agg(lines.alias("xs"))
    merged = merged.select("query_id", F.concat(F.lit("Key points from the dataset:\n"), F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- "), x["a"])), "\n")).alias("answer"), F.array_join(F.transform("xs", lambda x: F.concat(F.lit("Importance: "), x["score"].cast("string"), F.lit("\n"), x["a"])), "\n\n").alias("context"))
    docs = _report_sources(index, near.select("query_id", "id")).select("query_id", F.explode("sources").alias("d")).unionByName(asked.select("query_id", "follow_id").join(local.select("follow_id", F.explode("sources").alias("d")), "follow_id").select("query_id", "d"))
    docs = docs.groupBy("query_id").agg(F.array_sort(F.collect_set("d")).alias("sources"))
    calls = asked.groupBy("query_id").agg((F.count(F.lit(1)) + 2).cast("int").alias("llm_calls"))
    return queries.select("query_id").join(merged, "query_id", "left").join(docs, "query_id", "left").join(calls, "query_id", "left").select(
        "query_id", F.lit("drift").alias("method"), F.coalesce("answer", F.lit(answers.NO_DATA)).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("llm_calls", F.lit(2)).alias("llm_calls"))


def get_method(name: str, **options) -> Callable[[Index, DataFrame], DataFrame]:
    """The search of that name as a function of index and questions (query_id, text)."""
    known = {"local": local_search, "global": global_search, "drift": drift_search, "basic": basic_search, "dual": dual_search, "ppr": ppr_search, "hybrid": hybrid_search, "subgraph": subgraph_search}
    if name not in known:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(NAMES)}")
    return lambda index, queries: known[name](index, queries, **options)
