"""Community reports: contexts within a budget, rules that write them, and the way up the hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.ranking import budget_prefix
from loomgraph.session import cut

FINDING = "array<struct<summary:string,explanation:string>>"


def _line(*columns: str) -> Column:
    return F.concat_ws("|", *[X.clean_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def _rows(members: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of entities and of inner edges per community, each with its tokens."""
    e = members.join(entities.select("name", "human_id", "type", "description", "degree"), "name").withColumn("tokens", X.count_tokens(_line("human_id", "name", "type", "description", "degree")))
    m = members.select("community", F.col("name").alias("u"))
    r = edges.select("u", "v", "human_id", "description", "combined_degree").join(m, "u").join(m.withColumnRenamed("u", "v"), ["community", "v"])
    return e, r.withColumn("tokens", X.count_tokens(_line("human_id", "u", "v", "description", "combined_degree")))


def _within(e: DataFrame, r: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Half of the budget each: entities by degree, edges by the sum of their ends' degrees."""
    es = budget_prefix(e, ["community"], [F.desc("degree"), F.col("name")], F.col("tokens"), budget // 2, 2)
    rs = budget_prefix(r, ["community"], [F.desc("combined_degree"), F.col("u"), F.col("v")], F.col("tokens"), budget // 2, 2)
    return es, rs


def _listed(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Per community its rows' structs in order; a budget bounds how many there are."""
    o = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], value.alias("x"))
    return df.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(o)), lambda s: s["x"]).alias(name))


def written(communities: DataFrame, entities: DataFrame, relationships: DataFrame, children: DataFrame) -> DataFrame:
    """Reports by rules (id, level, parent, title, summary, rating, rating_explanation, findings, content) of communities (community, level, parent).

    What a report is written from: the rows of its context, as entities (community, human_id, name, description, degree),
    relationships (community, human_id, u, v, description, combined_degree) and children (community, n, id, title,
    summary). The first names give the title, the first description the summary; the relationships of the greatest
    degrees, then the children, are the findings; their number gives the rating.
    """
    e = _listed(entities, [-F.col("degree"), F.col("name")], F.struct("human_id", "name", "description"), "es")
    r = _listed(relationships, [-F.col("combined_degree"), F.col("u"), F.col("v")], F.struct("human_id", "u", "v", "description"), "rs")
    c = _listed(children, [-F.col("n"), F.col("id")], F.struct("id", "title", "summary"), "cs")
    j = communities.join(e, "community", "left").join(r, "community", "left").join(c, "community", "left")
    for col, like in (("es", e), ("rs", r), ("cs", c)):
        j = j.withColumn(col, F.coalesce(col, F.array().cast(dict(like.dtypes)[col])))
    text = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    data = lambda table, x: F.concat(F.lit(f" [Data: {table} ("), x["human_id"].cast("string"), F.lit(")]"))
    names = F.when(F.size("es") > 0, F.transform(F.slice("es", 1, 3), lambda x: F.initcap(x["name"]))).otherwise(F.transform(F.slice("cs", 1, 2), lambda x: x["title"]))
    title = F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 2), " and ")).otherwise("Unnamed community")
    more = F.when(F.size("es") > 0, text(F.try_element_at(F.col("es"), F.lit(1))["description"], 300)).otherwise(F.array_join(F.transform(F.slice("cs", 1, 2), lambda x: text(x["summary"], 200)), " "))
    summary = F.rtrim(F.concat(F.lit("This community centres on "), F.array_join(names, ", "), F.lit(". "), more))
    by_edge = F.transform(F.slice("rs", 1, 5), lambda x: F.struct(F.concat(F.initcap(x["u"]), F.lit(" and "), F.initcap(x["v"])).alias("summary"), F.concat(text(x["description"], 400), data("Relationships", x)).alias("explanation")))
    by_child = F.transform(F.slice("cs", 1, 3), lambda x: F.struct(x["title"].alias("summary"), F.coalesce(x["summary"], F.lit("")).alias("explanation")))
    by_name = F.transform(F.slice("es", 1, 3), lambda x: F.struct(F.initcap(x["name"]).alias("summary"), F.concat(text(x["description"], 300), data("Entities", x)).alias("explanation")))
    findings = F.when((F.size("rs") > 0) | (F.size("cs") > 0), F.concat(by_edge, by_child)).otherwise(by_name).cast(FINDING)
    rating = F.round(F.least(F.lit(10.0), 2 + 0.5 * (F.size("rs") + F.size("cs"))), 1)
    out = j.select(
        F.col("community").alias("id"), "level", "parent", title.alias("title"), summary.alias("summary"), rating.alias("rating"),
        F.format_string("Rated %s for %d relationships among %d entities.", rating.cast("string"), F.size("rs") + F.size("cs"), F.size("es")).alias("rating_explanation"), findings.alias("findings"),
    )
    return out.withColumn("content", markdown(F.col("title"), F.col("summary"), F.col("findings")))


def markdown(title: Column, summary: Column, findings: Column) -> Column:
    """A report as Markdown: what is embedded and put into contexts."""
    each = F.transform(findings, lambda f: F.concat(F.lit("## "), F.coalesce(f["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(f["explanation"], F.lit("")), F.lit("\n")))
    return F.rtrim(F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(summary, F.lit("")), F.lit("\n\n"), F.array_join(each, "\n")))


def all_reports(entities: DataFrame, edges: DataFrame, levels: DataFrame, budget: int = 4000, least: int = 2) -> DataFrame:
    """Reports of all communities of at least `least` nodes, the deepest level first; see `written`.

    entities (name, type, description, degree, human_id), edges (u, v, description, combined_degree, human_id), levels
    (level, community, parent, name). A community whose rows exceed the budget is described by its children's reports,
    the largest first within half of the budget, and by what they leave open within the other half.
    """
    sizes = cut(levels.groupBy("level", "community", "parent").agg(F.count(F.lit(1)).alias("n")))
    depth = sizes.agg(F.max("level")).first()[0]
    done = None
    for level in range(depth if depth is not None else -1, -1, -1):
        todo = sizes.where((F.col("level") == level) & (F.col("n") >= least))
        members = levels.where(F.col("level") == level).select("community", "name").join(todo.select("community"), "community", "left_semi")
        e, r = _rows(members, entities, edges)
        none = todo.select("community", "n", F.col("community").alias("id"), F.lit("").alias("title"), F.lit("").alias("summary")).limit(0)
        if done is None:
            es, rs = _within(e, r, budget)
            cs = none
        else:
            total = e.groupBy("community").agg(F.sum("tokens").alias("t")).unionByName(r.groupBy("community").agg(F.sum("tokens").alias("t"))).groupBy("community").agg(F.sum("t").alias("t"))
            below = sizes.where(F.col("level") == level + 1).select(F.col("parent").alias("community"), F.col("community").alias("id"), "n").join(done.select("id", "title", "summary"), "id")
            large = cut(total.where(F.col("t") > budget).select("community").join(below.select("community").distinct(), "community", "left_semi"))
            sub = below.join(large, "community", "left_semi").withColumn("tokens", X.count_tokens(_line("id", "title", "summary")))
            cs = budget_prefix(sub, ["community"], [F.desc("n"), F.col("id")], F.col("tokens"), budget // 2, 2).select("community", "n", "id", "title", "summary")
            inside = levels.where(F.col("level") == level + 1).select(F.col("community").alias("id"), "name").join(cs.select("community", "id"), "id").select("community", "name").distinct()
            small_e, small_r = e.join(large, "community", "left_anti"), r.join(large, "community", "left_anti")
            open_e = e.join(large, "community", "left_semi").join(inside, ["community", "name"], "left_anti")
            mark = lambda c: inside.select("community", F.col("name").alias(c), F.lit(True).alias(f"in_{c}"))
            open_r = r.join(large, "community", "left_semi").join(mark("u"), ["community", "u"], "left").join(mark("v"), ["community", "v"], "left").where("not coalesce(in_u and in_v, false)").drop("in_u", "in_v")
            es, rs = _within(small_e, small_r, budget)
            more_e, more_r = _within(open_e, open_r, budget // 2)
            es, rs = es.unionByName(more_e), rs.unionByName(more_r)
        now = cut(written(todo.select("community", "level", "parent"), es, rs, cs))
        done = now if done is None else done.unionByName(now)
    if done is None:
        done = written(sizes.select("community", "level", "parent"), *_rows(levels.select("community", "name"), entities, edges), sizes.select("community", "n", F.col("community").alias("id"), F.lit("").alias("title"), F.lit("").alias("summary")))
    return done


def report_documents(selected: DataFrame, levels: DataFrame, node_units: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id): the documents behind each query's reports (query_id, id), by the units of their communities' nodes."""
    named = selected.select("query_id", F.col("id").alias("community")).distinct().join(levels.select("community", "name"), "community").select("query_id", "name").distinct()
    found = named.join(node_units.select("name", "unit_id"), "name").select("query_id", "unit_id").distinct()
    return found.join(units.select("unit_id", "doc_id"), "unit_id").select("query_id", "doc_id").distinct()
