"""Walks over shipped graphs against brute force, and at sizes that were refused before."""

import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import sparse, walks


def _cheapest(graph, tree):
    """Paths of a search by (distance, name, name it came from)."""
    before, best, heap = {}, dict.fromkeys(tree, 0.0), [(0.0, n, -1) for n in tree]
    heapq.heapify(heap)
    while heap:
        d, n, came = heapq.heappop(heap)
        if n in before:
            continue
        before[n] = came if came >= 0 else None
        for o, w in graph.get(n, {}).items():
            if o not in before and d + w <= best.get(o, float("inf")):
                best[o] = d + w
                heapq.heappush(heap, (d + w, o, n))
    return before


def test_cheapest_paths_and_their_ties():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randint(3, 25)
        pairs = {(a, b): float(rng.choice([0, 0, 1, 2])) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(3 * n))}
        rows = sorted([(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()])
        graph = {}
        for a, b, w in rows:
            graph.setdefault(a, {})[b] = w
        node, other, weight = (np.array(c) for c in zip(*rows))
        paths, tree = walks._Paths(sparse.starts(node, n), other, weight), set()
        for _ in range(3):
            new = {rng.randrange(n)} - tree
            tree |= new
            goals = set(range(n)) - tree
            paths.grow(new, goals)
            before = _cheapest(graph, tree)
            for g in goals:
                way, at = [], g if g in before else None
                while at is not None:
                    way.append(at)
                    at = before[at]
                assert (paths.to(g) or []) == way[::-1]


def test_subgraph_of_many_edges(spark):
    e = spark.range(200_001).select(F.lit("a").alias("u"), F.format_string("n%06d", "id").alias("v"), F.lit(1.0).alias("weight"))
    nodes, kept = walks.collect_subgraph(e, spark.createDataFrame([("n000001", 5.0), ("n200000", 5.0)], "name string, prize double"))
    assert nodes == ["a", "n000001", "n200000"] and kept == [("a", "n000001"), ("a", "n200000")]


def _graph(spark, n=40, seed=5):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n - 2), 2))) for _ in range(3 * n)}
    e = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(rng.randint(1, 5))) for a, b in sorted(pairs)], "u string, v string, weight double")
    return e, spark.createDataFrame([(f"n{k:02d}",) for k in range(n)], "name string")


def _asked(spark):
    q = spark.createDataFrame([(k,) for k in range(70)], "query_id int")
    return q, q.where("query_id > 2").select("query_id", F.format_string("n%02d", F.col("query_id") % 40).alias("name"), F.lit(1.0).alias("weight"))


def test_rounds_write_no_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(walks, "cut", lambda df, real=walks.cut: written.append(1) or real(df))
    e, n = _graph(spark)
    p = walks.pagerank_batch(e, n, *_asked(spark), tol=0.0)
    sums = {r.query_id: r.s for r in p.groupBy("query_id").agg(F.sum("p").alias("s")).collect()}
    assert sorted(sums) == list(range(70)) and all(abs(s - 1) < 1e-9 for s in sums.values())
    assert len(written) <= 2


def test_passages_are_sums_of_their_nodes(spark):
    e, n = _graph(spark)
    members = spark.createDataFrame([(f"n{k:02d}", u) for k in range(40) for u in (k % 7, 10 + k % 11)] + [("gone", 99), ("n00", 0)], "name string, unit_id int")
    p = walks.pagerank_batch(e, n, *_asked(spark))
    want = {(r.query_id, r.unit_id): r.s for r in p.join(members.distinct(), "name").groupBy("query_id", "unit_id").agg(F.sum("p").alias("s")).collect()}
    got = {(r.query_id, r.unit_id): r.score for r in walks.passage_scores(e, n, *_asked(spark), members).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    best = {(r.query_id, r.unit_id) for r in walks.passage_scores(e, n, *_asked(spark), members, 3).collect()}
    for q in range(70):
        top = sorted((s for (k, _), s in want.items() if k == q), reverse=True)
        assert {u for k, u in best if k == q} == {u for (k, u), s in want.items() if k == q and s >= top[:3][-1] - 1e-9}


def test_communities_of_many_edges_without_joins(spark, monkeypatch):
    monkeypatch.setattr(walks, "_level_by_joins", None)
    k = spark.range(640 * 400).select(F.expr("id div 400").alias("b"), F.expr("id div 20 % 20").alias("i"), F.expr("id % 20").alias("j")).where("i < j")
    name = lambda c: F.format_string("b%03d-%02d", "b", c)
    e = k.select(name("i").alias("u"), name("j").alias("v"), F.lit(1.0).alias("weight"))  # 121,600 edges
    got = walks.communities(e, e.select(F.col("u").alias("name")).union(e.select("v")))
    r = got.groupBy("community").agg(F.count_distinct(F.substring("name", 1, 4)).alias("blocks"), F.count(F.lit(1)).alias("n")).agg(F.max("blocks"), F.min("n"), F.count(F.lit(1))).first()
    assert tuple(r) == (1, 20, 640)


def test_hashed_hits_are_those_of_the_join(spark):
    from loomgraph.operators import ranking, search

    rng = random.Random(8)
    rows = lambda n: spark.createDataFrame([(k, b, rng.choice([-1.0, 1.0, 0.5])) for k in range(n) for b in rng.sample(range(512), rng.randint(1, 4) if k % 2 else 30)], "id int, bucket int, value double")
    d, q = rows(60), rows(25)
    s = d.join(q.select(F.col("id").alias("query_id"), "bucket", F.col("value").alias("w")), "bucket").groupBy("query_id", "id").agg(F.round(F.sum(F.col("value") * F.col("w")), 6).alias("score"))
    want = {tuple(r) for r in ranking.best_of(s, ["query_id"], [F.desc("score"), F.col("id")], 20).select("query_id", "id", "score", "rank").collect()}
    assert {tuple(r) for r in search.hashed_top_k(q, d, 20).select("query_id", "id", "score", "rank").collect()} == want
