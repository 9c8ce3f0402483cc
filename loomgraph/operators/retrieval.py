"""Retrieval plans over many questions at once: every ranking is partitioned by query_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.graph import both_ways
from loomgraph.operators.ranking import best_of, budget_prefix


def named_in_query(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (query_id, name): names that stand in a query as whole words, case aside.

    A name is looked up by its words in the query's word runs of the same length, an equi-join, so that no query meets every name.
    """
    words = F.regexp_extract_all(F.upper("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n = names.select("name", F.regexp_extract_all(F.upper("name"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    n = n.select("name", F.array_join("w", " ").alias("run"), F.size("w").alias("len")).distinct()
    q = queries.select("query_id", words.alias("w")).where("size(w) > 0")
    most = 6
    runs = q.select("query_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).select("query_id", "w", "i", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("len")).where("i + len - 1 <= size(w)")
    runs = runs.select("query_id", "len", F.expr("array_join(slice(w, i, len), ' ')").alias("run")).distinct()
    long = n.where(F.col("len") > most)  # longer names are found by their first words, then compared whole
    head = long.withColumn("run", F.substring_index("run", " ", most)).withColumn("len", F.lit(most)).join(runs, ["run", "len"]).join(q, "query_id")
    head = head.where(F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.upper("name"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " "), F.lit(" "))))
    return n.where(F.col("len") <= most).join(runs, ["run", "len"]).select("query_id", "name").unionByName(head.select("query_id", "name")).distinct()


def query_entities(queries: DataFrame, nodes: DataFrame, similar: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, name, rank): names in the query first, rarest first, then similar ones (query_id, name, rank); k in all.

    nodes: (name, frequency).
    """
    named = named_in_query(queries, nodes).join(nodes.select("name", "frequency"), "name").select("query_id", "name", F.lit(0).alias("tier"), F.col("frequency").cast("bigint").alias("o"))
    both = named.unionByName(similar.select("query_id", "name", F.lit(1).alias("tier"), F.col("rank").cast("bigint").alias("o")))
    first = both.groupBy("query_id", "name").agg(F.min(F.struct("tier", "o")).alias("f"))
    return best_of(first, ["query_id"], [F.col("f.tier"), F.col("f.o"), F.col("name")], k).select("query_id", "name", "rank")


def local_edges(selected: DataFrame, edges: DataFrame, budget: int = 2800) -> DataFrame:
    """Rows (query_id, source, target, weight, inside, links, rank, used_tokens): edges around a query's entities (query_id, name, rank), within the budget.

    Edges among the entities come first, then those to outside neighbours that are linked with most of them, then by weight.
    """
    adj = both_ways(edges)
    one = selected.select("query_id", F.col("name").alias("node")).join(adj, "node")
    inside = one.join(selected.select("query_id", F.col("name").alias("other")), ["query_id", "other"], "left_semi").where("node < other")
    outside = one.join(selected.select("query_id", F.col("name").alias("other")), ["query_id", "other"], "left_anti")
    links = outside.groupBy("query_id", "other").agg(F.count(F.lit(1)).alias("links"))
    zero = F.lit(0).cast("bigint")
    both = inside.select("query_id", "node", "other", "weight", F.lit(True).alias("inside"), zero.alias("links")).unionByName(
        outside.join(links, ["query_id", "other"]).select("query_id", "node", "other", "weight", F.lit(False).alias("inside"), "links"))
    rows = both.select("query_id", F.col("node").alias("source"), F.col("other").alias("target"), "weight", "inside", "links")
    order = [F.desc("inside"), F.desc("links"), F.desc("weight"), F.col("source"), F.col("target")]
    tokens = X.count_tokens(F.concat_ws("|", "source", "target", F.round("weight", 1).cast("string")))
    return budget_prefix(rows, ["query_id"], order, tokens, budget)


def local_units(selected: DataFrame, node_units: DataFrame, cited: DataFrame, texts: DataFrame, budget: int = 4000) -> DataFrame:
    """Rows (query_id, unit_id, best_rank, n_cited, used_tokens): units of the best entities first, then by citing edges, within the budget.

    node_units (name, unit_id), cited (query_id, unit_id, n), texts (unit_id, n_tokens); units without a text are left out.
    """
    u = selected.join(node_units, "name").groupBy("query_id", "unit_id").agg(F.min("rank").alias("best_rank"))
    u = u.join(cited, ["query_id", "unit_id"], "left").select("query_id", "unit_id", "best_rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_cited")).join(texts, "unit_id")
    return budget_prefix(u, ["query_id"], [F.col("best_rank"), F.desc("n_cited"), F.col("unit_id")], F.col("n_tokens"), budget).drop("n_tokens")


def dual_level_edges(hits: DataFrame, relation_hits: DataFrame, edges: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
    """Rows (query_id, u, v, position): one-hop edges of entity hits (query_id, name) by combined degree and weight, relation hits (query_id, u, v, rank), each edge once.

    'local' uses the first, 'global' the second; 'hybrid' takes k local ones, then the relation hits, then the rest.
    """
    e = edges.select("u", "v", "weight", "combined_degree")
    ends = hits.select("query_id", "name").distinct()
    near = ends.join(e, F.col("name") == F.col("u")).unionByName(ends.join(e, F.col("name") == F.col("v"))).select("query_id", "u", "v", "weight", "combined_degree").distinct()
    near = best_of(near, ["query_id"], [F.desc("combined_degree"), F.desc("weight"), F.col("u"), F.col("v")], 1 << 30, "r")
    local = near.select("query_id", "u", "v", F.when(F.col("r") <= k, 0).otherwise(2).alias("part"), F.col("r").cast("bigint").alias("o"))
    globe = relation_hits.select("query_id", "u", "v", F.lit(1).alias("part"), F.col("rank").cast("bigint").alias("o"))
    both = {"local": local, "global": globe, "hybrid": local.unionByName(globe)}[mode]
    first = both.groupBy("query_id", "u", "v").agg(F.min(F.struct("part", "o")).alias("f"))
    return best_of(first, ["query_id"], [F.col("f.part"), F.col("f.o"), F.col("u"), F.col("v")], 1 << 30, "position").drop("f")


def rank_passages(scores: DataFrame, node_units: DataFrame) -> DataFrame:
    """Rows (unit_id, score): the summed scores (name, p) of the entities taken from each unit."""
    return node_units.join(scores, "name").groupBy("unit_id").agg(F.sum("p").alias("score"))


def seed_nodes(queries: DataFrame, nodes: DataFrame, similar: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, name, weight): named entities score 1, similar ones (query_id, name, score) theirs; the k best, divided by their frequency."""
    both = named_in_query(queries, nodes).select("query_id", "name", F.lit(1.0).alias("score")).unionByName(similar.select("query_id", "name", "score"))
    top = best_of(both.groupBy("query_id", "name").agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), F.col("name")], k)
    return top.join(nodes.select("name", "frequency"), "name").where("score > 0").select("query_id", "name", (F.col("score") / F.greatest("frequency", F.lit(1))).alias("weight"))


# Words that make a question a broad one.
BROAD = ["theme", "main", "overall", "risk", "summarize", "summary", "trend", "evolved", "role", "relationship"]


def is_broad(question):
    return F.arrays_overlap(X.analyze(question), F.array(*map(F.lit, BROAD)))


def rule_score(broad, n):
    """The rule's score of a report that shares n words with a question, 0 to 100."""
    return F.least(F.lit(100), F.when(broad, 40 + 10 * n).otherwise(25 * n))


def report_rating(question, report):
    return F.when(is_broad(question), F.lit(3)).otherwise(F.least(F.lit(5), X.overlap(question, report)))


def select_reports(queries: DataFrame, reports: DataFrame, threshold: int = 2) -> DataFrame:
    """Rows (query_id, id): reports found top-down. A report rated below the threshold closes its subtree; a parent gives way to relevant children.

    queries (query_id, text), reports (id, parent, level, content). One join per level, over the open frontier only.
    """
    from loomgraph.session import cut

    r = reports.select("id", "parent", "level", "content")
    q = queries.select("query_id", "text")
    top = F.broadcast(q) if q.count() <= 1000 else q
    frontier = r.where("level = 0").crossJoin(top)
    found = None
    while True:
        good = cut(frontier.where(report_rating(F.col("text"), F.col("content")) >= threshold).select("query_id", "text", "id", "parent"))
        found = good if found is None else found.unionByName(good)
        nxt = good.select("query_id", "text", F.col("id").alias("parent")).join(r, "parent")
        if nxt.isEmpty():
            break
        frontier = nxt
    dropped = found.where("parent is not null").select("query_id", F.col("parent").alias("id")).distinct()
    return found.select("query_id", "id").join(dropped, ["query_id", "id"], "left_anti")


def reports_at(reports: DataFrame, level: int = 0) -> DataFrame:
    """Reports of a level, and shallower ones without children."""
    parents = reports.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    return reports.where(F.col("level") == level).unionByName(reports.where(F.col("level") < level).join(parents, "id", "left_anti"))
