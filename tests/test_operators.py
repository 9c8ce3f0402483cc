"""Core operators against brute force, invariants and hand-made cases."""

import difflib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import chunking, extraction, graph, ranking, search, walks


def test_chunk_fixed_overlap(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    d = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "one")], "doc_id bigint, text string")
    rows = chunking.chunk_fixed(d).orderBy("doc_id", "ord").collect()
    assert [r.doc_id for r in rows] == [1, 1, 1, 1, 4]
    assert rows[0].text.split()[-50:] == rows[1].text.split()[:50]
    assert all(text[r.start_char : r.end_char] == r.text for r in rows[:4])
    with pytest.raises(ValueError):
        chunking.chunk_fixed(d, 10, 10)


def test_sentence_packing():
    text = "Dr. Ade spoke. Really! Why? " + " ".join(f"Sentence number {k} is here." for k in range(100))
    spans = chunking.sentence_spans(text)
    assert text[slice(*spans[0])] == "Dr. Ade spoke."
    chunks = chunking.pack_sentences(text, 40, 1)
    assert all(c[1] <= 40 for c in chunks) and chunks[-1][3] == len(text)


def test_sentences_agree_with_python(spark):
    texts = ["A b. C d! E?\nF g", "e.g. this one. And St. Ives.", "", "no end", "x.\n\ny. "]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(X.sentences(F.col("t")).alias("s"))
    for t, r in zip(texts, d.collect()):
        assert list(r.s) == [t[a:b].strip() for a, b in chunking.sentence_spans(t)]


def test_records_with_chatter(spark):
    out = 'Sure! ("Entity"<|> "Ann Bo" <|>person kind<|>says <|> hi)##("relationship"<|>a<|>b<|>d<|>1.2.3)\n("relationship"<|>a<|>b<|>d<|>about 8)("relationship"<|>a<|>b<|>d)\ngarbage<|COMPLETE|>'
    recs = extraction.records(spark.createDataFrame([(1, out), (2, None)], "id int, output string"))
    e = extraction.parse_entities(recs).collect()
    assert [(r.name, r.type, r.description) for r in e] == [("ANN BO", "PERSON_KIND", "says<|>hi")]
    r = extraction.parse_relationships(recs).orderBy("ord").collect()
    assert [(x.strength, x.description) for x in r] == [(1.0, "d<|>1.2.3"), (8.0, "d"), (1.0, "d")]


def _edges(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in pairs], "u string, v string, weight double")


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_pagerank_both_ways_and_dense(spark):
    rng = random.Random(1)
    names = [f"n{k:02d}" for k in range(20)]
    pairs = [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations(names[:18], 2) if rng.random() < 0.2]
    e, n, s = _edges(spark, pairs), _names(spark, names), spark.createDataFrame([("n00", 2.0), ("n05", 1.0), ("gone", 5.0), ("n07", -1.0)], "name string, weight double")
    w = np.zeros((20, 20))
    for a, b, x in pairs:
        w[int(a[1:]), int(b[1:])] = w[int(b[1:]), int(a[1:])] = x
    out = w.sum(0)
    seed = np.zeros(20)
    seed[0], seed[5] = 2 / 3, 1 / 3
    p = seed.copy()
    for _ in range(6):
        p = 0.15 * seed + 0.85 * (w @ (p / np.where(out > 0, out, 1)) + p[out == 0].sum() * seed)
    got = {r.name: r.p for r in walks.pagerank(e, n, s, rounds=6).collect()}
    assert all(math.isclose(got[x], p[int(x[1:])], abs_tol=1e-9) for x in names)
    flat = {r.name: r.p for r in walks.pagerank(e, n, s.limit(0), rounds=50).collect()}
    assert math.isclose(sum(flat.values()), 1.0, abs_tol=1e-9) and all(flat.values())


def test_communities_find_blocks(spark):
    rng = random.Random(2)
    names = [f"{b}{k:02d}" for b in "abcd" for k in range(12)]
    pairs = [(x, y, 1) for x, y in itertools.combinations(names, 2) if rng.random() < (0.7 if x[0] == y[0] else 0.02)]
    e, n = _edges(spark, pairs), _names(spark, [*names, "alone"])
    got = walks.communities(e, n).collect()
    assert len({r.community for r in got}) == 5 and all(r.community[0] == r.name[0] for r in got if r.name != "alone")
    assert walks.modularity(e, walks.communities(e, n)).first().modularity > 0.3
    assert walks.modularity(e.limit(0), n.withColumn("community", F.lit("x"))).first().modularity == 0.0
    assert walks.communities(e.limit(0), n).where("name <> community").count() == 0


def test_communities_by_joins(spark):
    pairs = [(f"{b}{i}", f"{b}{j}", 1) for b in "ab" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 1)]
    names = [f"{b}{k}" for b in "ab" for k in range(5)]
    e = _edges(spark, pairs)
    got = {r.name: r.community for r in walks.communities(e, _names(spark, names), small=0).collect()}
    assert got == {n: n[0] + "0" for n in names} or len({*got.values()}) == 2
    assert got == {r.name: r.community for r in walks.communities(e, _names(spark, names)).collect()}  # in the driver the same


def test_hierarchy_partitions(spark):
    pairs = [(f"{b}{i}", f"{b}{j}", 1) for b in "ab" for i, j in itertools.combinations(range(8), 2) if (i < 4) == (j < 4) or (i, j) == (0, 7)]
    names = [f"{b}{k}" for b in "ab" for k in range(8)]
    rows = walks.hierarchy(_edges(spark, pairs), _names(spark, names), most=3).collect()
    parent = {r.community: r.parent for r in rows}
    held = {}
    for r in rows:
        held.setdefault(r.community, set()).add(r.name)
    for c, p in parent.items():
        assert p is None or held[c] <= held[p]


def test_parts_are_graphs_of_their_own(spark):
    small = [(f"a{i}", f"a{j}", 1) for i, j in itertools.combinations(range(8), 2) if (i < 4) == (j < 4) or (i, j) == (0, 7)]
    large = [(f"z{k}", f"z{k + 1}", 50) for k in range(40)]
    a, z = [f"a{k}" for k in range(8)], [f"z{k}" for k in range(41)]
    parts = spark.createDataFrame([(n, n[0]) for n in a + z], "name string, part string")
    both = {r.name: r.community for r in walks.communities(_edges(spark, small + large), _names(spark, a + z), parts=parts).collect()}
    alone = {r.name: r.community for r in walks.communities(_edges(spark, small), _names(spark, a)).collect()}
    assert {n: both[n] for n in a} == alone and len({*alone.values()}) == 2
    joined = {r.name: r.community for r in walks.communities(_edges(spark, small + large), _names(spark, a + z)).collect()}
    assert len({joined[n] for n in a}) == 1  # as one graph the two halves are not worth telling apart


def test_flow_prunes_hubs(spark):
    e = _edges(spark, [("h", f"s{k}", 1) for k in range(50)] + [("a", "x", 1), ("x", "h", 1)])
    flow, expanded = walks.spread_flow(e, _names(spark, ["a"]), 3, 0.8, 0.02)
    got = {r.node: r.flow for r in flow.collect()}
    assert got["x"] == pytest.approx(0.8) and got["h"] == pytest.approx(0.32) and "s1" not in got
    assert {r.node for r in expanded.collect()} == {"a", "x"}


def test_subgraph_prunes_cheap_leaf(spark):
    e = _edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("a", "z", 1)])
    nodes, kept = walks.collect_subgraph(e, spark.createDataFrame([("a", 5.0), ("d", 5.0), ("z", 0.1)], "name string, prize double"))
    assert nodes == ["a", "b", "c", "d"] and len(kept) == 3
    assert walks.collect_subgraph(e, spark.createDataFrame([("q", 1.0)], "name string, prize double")) == ([], [])


def test_shortest_paths_brute(spark):
    rng = random.Random(4)
    names = "abcdefg"
    pairs = [(x, y, 1) for x, y in itertools.combinations(names, 2) if rng.random() < 0.5]
    near = {n: {y if x == n else x for x, y, _ in pairs if n in (x, y)} for n in names}
    want = sorted((p for k in range(0, 3) for m in itertools.permutations(set(names) - {"a", "g"}, k) for p in [["a", *m, "g"]] if all(y in near[x] for x, y in zip(p, p[1:]))), key=lambda p: (len(p), p))[:3]
    got = walks.shortest_paths(_edges(spark, pairs), spark.createDataFrame([("a", "g")], "source string, target string"), 3, 3).orderBy("rank").collect()
    assert [r.path for r in got] == want


def test_positions(spark):
    rng = random.Random(6)
    d = spark.createDataFrame([(rng.randint(0, 10**6), k) for k in range(5000)], "x int, y int").repartition(9)
    got = ranking.with_position(d, "pos", "x", "y").collect()
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.pos)] == sorted((r.x, r.y) for r in got)
    assert sorted(r.pos for r in got) == list(range(5000))


def test_acronyms_and_ratio():
    assert graph.is_acronym("TWI", "TWIN WEIR INSTITUTE") is False
    assert graph.is_acronym("TWE", "TWIN ELM") and not graph.is_acronym("T", "TWIN INSTITUTE") and not graph.is_acronym("TI", "TIN")
    assert graph.ratio("abcd", "abed") == difflib.SequenceMatcher(None, "abcd", "abed").ratio()


def test_table_round_trip():
    text = graph.format_table("Entities", ["id", "name"], [[1, "a|b\nc"], [2, "d"]])
    assert graph.parse_tables("chatter\n" + text) == {"Entities": [{"id": "1", "name": "a/b c"}, {"id": "2", "name": "d"}]}


def test_hashing_embedder(spark):
    d = spark.createDataFrame([(1, "drones drone reef"), (2, None), (3, "the of")], "id bigint, text string")
    got = {r.id: np.array(r.embedding) for r in search.hashing_embedder(d, "id", "text", 64).collect()}
    assert np.allclose(got[1], search.blake_vector(["drone", "drone", "reef"], 64)) and math.isclose(np.linalg.norm(got[1]), 1, rel_tol=1e-6)
    assert not got[2].any() and not got[3].any()
    with pytest.raises(ValueError):
        search.get_embedder("nope")


def test_cosine_ties_and_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [1.0, float(k // 2)]) for k in range(8)] + [(99, None)], "id bigint, embedding array<float>")
    one = search.cosine_top_k(v.withColumnRenamed("id", "query_id"), v, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert search.cosine_top_k(v.withColumnRenamed("id", "query_id"), v, 3).orderBy("query_id", "rank").collect() == one
    assert [r.id for r in one if r.query_id == 1][:2] == [0, 1]
    assert search.cosine_top_k(v.limit(0).withColumnRenamed("id", "query_id"), v, 3).count() == 0


def test_summary_skips_what_does_not_fit(spark):
    from loomgraph.operators.answers import extractive_summary

    d = spark.createDataFrame([(["One two.", "one TWO.", "a b c d e f g.", "Three four."],), ([],)], "s array<string>")
    assert [r[0] for r in d.select(extractive_summary(F.col("s"), 8)).collect()] == ["One two. Three four.", ""]


def test_report_batches_and_answers(spark):
    from loomgraph.operators import answers

    r = spark.createDataFrame([(f"r{k}", f"tide gauge report number {k} about cables" + " x" * k) for k in range(30)], "id string, content string")
    b = answers.report_batches(r, 40, width=2)
    sizes = b.join(r, "id").groupBy("batch").agg(F.sum(X.count_tokens(F.col("content"))).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(x.n for x in sizes) == 30 and all(x.t <= 40 or x.n == 1 for x in sizes)
    q = spark.createDataFrame([("q1", "Where is the tide gauge?"), ("q2", "zebra"), ("q3", "main themes")], "query_id string, text string")
    got = {x.query_id: x for x in answers.reduce_points(answers.map_points(q, r), q, b).collect()}
    assert got["q1"].answer.count("\n- ") == 8 and got["q2"].answer == answers.NO_DATA and got["q3"].n_sources == 30
