"""Sources, artifacts, the build, models, graph queries and fact replay."""

import datetime as dt
import itertools
import json
import random
from xml.etree import ElementTree

import pytest

from loomgraph.cli import main
from loomgraph.operators import answers, extraction, graph, graphquery, methods, models, prompts, reports, resolution, temporal
from loomgraph.plans.pipeline import ask, build_index, evaluate
from loomgraph.sources import files, graphdb


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "one.md").write_text("Weir Works acquired Kiln Yard in March 2021. Ada Moss runs Weir Works near Low Reef.", encoding="utf-8")
    (d / "two.md").write_text("Ada Moss joined Kiln Yard. Low Reef is monitored by Kiln Yard.", encoding="utf-8")
    (d / "skip.txt").write_text("x", encoding="utf-8")
    return d


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    files.save_index(build_index(files.load_documents(spark, str(corpus)), _gazetteer(spark)), folder)
    return files.load_index(spark, folder)


def _gazetteer(spark):
    return spark.createDataFrame([("Weir Works", "ORGANIZATION"), ("Kiln Yard", "ORGANIZATION"), ("Ada Moss", "PERSON"), ("Low Reef", "LOCATION")], "name string, type string")


def test_build_save_load_ask(spark, corpus, tmp_path):
    docs = files.load_documents(spark, str(corpus))
    assert sorted(r.doc_id for r in docs.collect()) == ["one", "two"]
    index = build_index(docs, _gazetteer(spark))
    files.save_index(index, str(tmp_path / "ix"))
    back = files.load_index(spark, str(tmp_path / "ix"))
    assert back.config == index.config
    assert {r.name for r in back.entities.collect()} == {"WEIR WORKS", "KILN YARD", "ADA MOSS", "LOW REEF"}
    assert back.relationships.count() >= 4 and [r.start_date for r in back.claims.collect()] == ["2021-03-01"]
    assert {r.id for r in back.report_vectors.collect()} == {r.id for r in back.community_reports.collect()}
    assert back.communities_of("ADA MOSS").count() >= 1
    files.write_graphml(back.entities, back.relationships, str(tmp_path / "g.xml"))
    assert (tmp_path / "g.xml").read_text().count("<node ") == 4
    ElementTree.parse(tmp_path / "g.xml")


def test_every_method(spark, index):
    for name in methods.NAMES:
        got = ask(index, "Who runs Weir Works near Low Reef?", name, **({"rounds": 5} if name in ("ppr", "hybrid") else {})).collect()
        assert len(got) == 1 and got[0].asDict().keys() == {*methods.RESULT}
        assert got[0].answer and got[0].context and got[0].sources and got[0].llm_calls >= 1, name
    local = ask(index, "Who runs Weir Works near Low Reef?", "local").first()
    assert "Ada Moss runs Weir Works near Low Reef. [Data: " in local.answer and local.sources[0] == "one"
    assert [t for t in ("Reports", "Entities", "Relationships", "Sources") if f"-----{t}-----" in local.context] == ["Reports", "Entities", "Relationships", "Sources"]
    dynamic = ask(index, "Who runs Weir Works?", "global", dynamic=True).first()
    assert dynamic.method == "global-dynamic" and "[Data: Reports (" in dynamic.answer
    none = ask(index, "zebra", "global").first()
    assert none.answer == answers.NO_DATA and none.sources == []
    with pytest.raises(ValueError):
        ask(index, "x", "nope")


def test_model_answers(spark, index):
    class Echo:
        def complete(self, prompt, task):
            return f"{task}: {prompt[-20:]}"

    got = ask(index, "Who joined Kiln Yard?", "basic", make=Echo, model="echo").first()
    assert got.answer.startswith("answer: ") and got.answer.endswith("joined Kiln Yard?")
    rule = ask(index, "Who joined Kiln Yard?", "basic", make=models.RuleModel).first()
    assert "[Data: Sources (two-000)]" in rule.answer and rule.answer == ask(index, "Who joined Kiln Yard?", "basic").first().answer


def test_model_extraction(spark, corpus):
    docs = files.load_documents(spark, str(corpus))
    known = {r["name"]: r["type"] for r in _gazetteer(spark).collect()}
    by_model = build_index(docs, _gazetteer(spark), make=lambda: models.RuleModel(known))
    by_rule = build_index(docs, _gazetteer(spark))
    for t, key in (("entities", ["name", "type", "degree", "frequency"]), ("relationships", ["u", "v", "weight"])):
        assert sorted(map(tuple, by_model.tables[t].select(*key).collect())) == sorted(map(tuple, by_rule.tables[t].select(*key).collect())), t


def test_evaluate(spark, index):
    q = spark.createDataFrame([("q1", "Who joined Kiln Yard?", "single", "Ada Moss", ["two"]), ("q2", "What are the main themes?", "global", "Weir Works", [])], files.QUESTION)
    results, means = evaluate(index, q, ["basic", "global"])
    assert results.count() == 4 and {(r.system, r.group) for r in means.collect()} == {(s, g) for s in ("basic", "global") for g in ("all", "single", "global")}


def test_command_line(spark, corpus, tmp_path, capsys):
    _gazetteer(spark).write.parquet(str(tmp_path / "gaz"))
    assert main(["index", "--input", str(corpus), "--gazetteer", str(tmp_path / "gaz"), "--output", str(tmp_path / "ix")]) == 0
    assert main(["query", "--index", str(tmp_path / "ix"), "--method", "basic", "--show-context", "Who joined Kiln Yard?"]) == 0
    out = capsys.readouterr().out
    assert "two-000" in out and "[method=basic llm_calls=1 sources=two" in out
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "question": "Who joined Kiln Yard?", "type": "single", "answer": "Ada Moss", "supporting_docs": ["two"]}\n')
    assert main(["eval", "--index", str(tmp_path / "ix"), "--questions", str(tmp_path / "q.jsonl"), "--methods", "basic,hybrid", "--judge"]) == 0
    assert "hybrid" in capsys.readouterr().out


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "question": "Who?", "supporting_docs": ["a"]}\n\n{"id": "q2"}\n')
    assert [r.id for r in files.load_questions(spark, str(tmp_path / "q.jsonl")).where("id is not null").orderBy("id").collect()] == ["q1", "q2"]


def test_model_cache(spark):
    p = spark.createDataFrame([(1, "other", "a"), (2, "other", "a"), (3, "other", "b"), (4, "other", None)], "n int, task string, prompt string")
    got, cache = models.complete_all(p, None, models.RuleModel, "rules")
    assert cache.count() == 2 and {r.n: r.reply for r in got.collect()} == {1: "OK", 2: "OK", 3: "OK", 4: None}
    assert models.complete_all(p, cache, models.RuleModel, "rules")[1].count() == 2
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def complete(self, prompt, task):
            calls.add(1)
            return prompt * 2

    got, cache = models.complete_all(p, None, Counting, "counting")
    assert got.count() == 4 and cache.count() == 2 and calls.value == 2  # both results, one call each
    with pytest.raises(ValueError):
        models.get_model("nope")


def test_graph_query_checks():
    ok = graphquery.query_for(['A "b"'])
    assert graphquery.problems(ok, ["Entity"], ["RELATED_TO"]) == []
    assert graphquery.problems('MATCH (n:Entity {name: "DELETE"}) RETURN n', ["Entity"]) == []
    for bad in ("CREATE (n) RETURN n", "MATCH (n:Nope) RETURN n", "MATCH (n RETURN n", "RETURN 1", "MATCH (a)-[r:KNOWS]-(b) RETURN a"):
        assert graphquery.problems(bad, ["Entity"], ["RELATED_TO"])


def test_graph_query_runs(spark):
    e = spark.createDataFrame([("A", "B", 2.0), ("A", "C", 5.0)], "u string, v string, weight double")
    n = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert [r.other for r in graphquery.run(graphquery.query_for(["A"]), n, e, ["Entity"]).collect()] == ["C", "B"]
    assert [r.name for r in graphquery.run(graphquery.query_for([]), n, e, ["Entity"]).collect()] == ["A", "B", "C"]
    with pytest.raises(ValueError):
        graphquery.run("MATCH (n) DELETE n RETURN n", n, e, ["Entity"])


def test_alias_cases(spark):
    names = [("DR. ADA MOSS", "PERSON"), ("MOSS", "PERSON"), ("ADA MOSS", "PERSON"), ("AX", "ORG"), ("ADA X LABS", "ORG"), ("ADA X LABZ", "ORG"), ("MARA MOSS", "PERSON")]
    got = {r.alias: r.canonical for r in resolution.resolve_entities(spark.createDataFrame(names, "name string, type string")).collect()}
    assert got["ADA MOSS"] == "DR. ADA MOSS" and got["ADA X LABZ"] == got["ADA X LABS"]
    assert resolution.resolve([("ANN LEE", "ANN LEE"), ("BO LEE", "BO LEE"), ("LEE", "LEE")])["LEE"] == "LEE"


def test_replay_against_brute_force(spark):
    rng, rows = random.Random(8), []
    d = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    for k in range(80):
        rows.append((k, rng.choice("ab"), rng.choice(["CEO_OF", "OWNS", None]), rng.choice("xy"), d(rng.randint(0, 60)), rng.choice([None, d(rng.randint(0, 90))]), rng.choice([None, d(rng.randint(0, 60))])))
    facts = spark.createDataFrame(rows + rows[:3], "fact_id bigint, source string, relation string, target string, valid_from date, valid_to date, recorded_at date")
    want: dict[int, list] = {}
    for f, s, r, t, lo, hi, rec in sorted(rows, key=lambda x: (x[6] or x[4], x[0])):
        rec = rec or lo
        if r == "CEO_OF":
            for g in want.values():
                if g[1] == r and g[2] == t and g[0] != s and g[4] is None and (g[3] is None or g[3] > lo):
                    g[3], g[4], g[5] = lo, rec, g[3]
        want[f] = [s, r, t, hi, None, None]
    got = {r.fact_id: (r.valid_to, r.invalidated_at, r.prior_valid_to) for r in temporal.replay(facts).collect()}
    assert got == {f: tuple(v[3:]) for f, v in want.items()}
    assert temporal.replay(temporal.empty_facts(spark)).count() == 0


def test_orphan_stream(spark, tmp_path):
    from loomgraph.streaming.references import stream_orphans

    schema = "kind string, key string, d_refs int, d_exist int"
    src = str(tmp_path / "in")
    spark.createDataFrame([("name", "a", 1, 0), ("name", "b", 1, 1)], schema).write.parquet(src)
    q = stream_orphans(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("orphans").outputMode("update").start()
    q.processAllAvailable()
    spark.createDataFrame([("name", "a", 0, 1), ("name", "b", 0, -1)], schema).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    rows = [(r.key, r.orphan) for r in spark.sql("select * from orphans").collect()]
    assert sorted(rows[:2]) == [("a", True), ("b", False)] and sorted(rows[2:]) == [("a", False), ("b", True)]
    assert len(list(itertools.chain(rows))) == 4


def test_prompts(spark):
    assert prompts.fill("{a} {b} {{x}} {a}", a="{b}", b=2, x=1) == "{b} 2 {1} {b}"
    assert prompts.slots(prompts.ANSWER) == ["form", "context", "question"]
    with pytest.raises(KeyError):
        prompts.fill("{a}")
    d = spark.createDataFrame([("q",), (None,)], "t string")
    assert [r[0] for r in d.select(prompts.fill_column("<{t}|{n}>", t=d.t, n="7")).collect()] == ["<q|7>", "<|7>"]


def test_mention_places(spark):
    names = {"Keel": "PROJECT", "Keel Yard": "ORGANIZATION", "Weir": "ORGANIZATION"}
    text = "Keelhauled by KEEL and Keel Yard, x.Keel; Dr. Ona Pill of Old Reef met Weir."
    want = [(15, "Keel", "PROJECT"), (24, "Keel Yard", "ORGANIZATION"), (43, "Dr. Ona Pill", "PERSON"), (59, "Old Reef", "LOCATION"), (72, "Weir", "ORGANIZATION")]
    assert extraction.mentions_in(text, names) == want
    sents = spark.createDataFrame([("u", 0, text), ("u", 1, "nothing here"), ("v", 0, "")], "unit_id string, sent int, sentence string")
    gaz = spark.createDataFrame([*names.items(), (None, "X")], "name string, type string")
    assert sorted((r.at, r.name, r.type) for r in extraction.find_mentions(sents, gaz).collect()) == want
    assert extraction.find_mentions(sents.limit(0), gaz).count() == 0


def test_descriptions_and_summaries(spark):
    m = spark.createDataFrame([(1, "b", "P", "Two. One.", "u1"), (2, " B ", "P", "One. three words here.", "u2"), (3, "B", None, None, None), (4, "c", "P", "Alone.", "u1"), (5, None, "P", "x", "u1"), (6, "d", "P", "w " * 40, "u3"), (7, "d", "P", "v " * 40, "u3")], "seq bigint, name string, type string, description string, unit_id string")
    d = graph.node_descriptions(m)
    assert {(r.name, r.description, r.first_seq) for r in d.where("name <> 'D'").collect()} == {("B", "Two. One.", 1), ("B", "One. three words here.", 2), ("C", "Alone.", 4)}
    got = {r.name: r.description for r in graph.summarized(d, ["name"], 8).collect()}
    assert got["B"] == "One. three words here. Two." and got["C"] == "Alone." and got["D"] == ("v " * 40 + " " + "w " * 40)[:500].strip() or got["D"].startswith("v v")
    assert {(r.name, r.unit_id) for r in graph.node_sources(m).collect()} == {("B", "u1"), ("B", "u2"), ("C", "u1"), ("D", "u3")}
    a = spark.createDataFrame([("C", "B"), ("B", "B")], "alias string, canonical string")
    assert [(r.name, r.alias) for r in graph.node_aliases(m, a).collect()] == [("B", "C")]


def test_linearised(spark):
    n = spark.createDataFrame([("A", "P", "a|b"), ("B", "O", None), ("C", "O", "c")], "name string, type string, description string")
    e = spark.createDataFrame([("A", "B", "x y", 2.0), ("B", "C", "z", 1.0)], "u string, v string, description string, weight double")
    sel = spark.createDataFrame([("q", "A"), ("q", "B"), ("r", "C"), ("r", "gone")], "query_id string, name string")
    lines = {(r.query_id, r.line) for r in graph.markdown_tables(n, e, sel).collect()}
    assert lines == {("q", "| A | P | a/b |"), ("q", "| B | O |  |"), ("q", "| A | B | x y | 2.0 |"), ("r", "| C | O | c |")}
    got = {r.query_id: json.loads(r.graph) for r in graph.node_link(n, e, sel).collect()}
    assert [x["id"] for x in got["q"]["nodes"]] == ["A", "B"] and got["q"]["links"] == [{"source": "A", "target": "B", "description": "x y", "weight": 2.0}] and got["r"]["links"] == []


def test_statements_are_sent_nodes_first(spark, tmp_path):
    class Session:
        def __init__(self, path):
            self.path, self.sent = path, []

        def run(self, statement):
            self.sent.append(statement)

        def close(self):
            with open(self.path, "a") as f:
                f.writelines(s + "\n" for s in self.sent)

    path = str(tmp_path / "sent")
    rows = spark.createDataFrame([("edge", "e1"), ("node", "n1"), ("node", "n2")], "kind string, statement string").coalesce(1)
    graphdb.write_statements(rows, lambda: Session(path), 1)
    assert open(path).read().split() == ["n1", "n2", "e1"]
    with pytest.raises(ModuleNotFoundError):
        graphdb.open_session("bolt://nowhere", "u", "p")


def test_timeline(spark):
    t = temporal.sample_timeline(spark)
    at = lambda relation, day, known=None: [r.source for r in temporal.holders(t, day, known).where(f"relation = '{relation}' and target = 'Weir Works'").collect()]
    assert at("CTO_OF", "2020-01-01") == ["Tam Brandt"] and at("CTO_OF", "2024-01-01") == ["Iris Okonedo"] and at("CEO_OF", "2025-01-01") == ["Iris Okonedo"]
    assert at("CTO_OF", "2023-06-01", "2023-04-10") == ["Tam Brandt"] and at("SUPPLIED", "2024-06-01") == []


def test_resolution_in_parts_equals_one_pass(spark):
    rng = random.Random(11)
    words = ["ADA", "MOSS", "WEIR", "WORKS", "KILN", "YARD", "LOW", "REEF", "MARA", "LEE"]
    names = {" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)} | {"WW", "LR", "KY", "WEIR WORKZ", "MOSSS"}
    rows = [(n, rng.choice(["PERSON", "ORG", None])) for n in sorted(names)]
    kind = {n: t or "" for n, t in rows}
    want = resolution.resolve([(n, n, kind[n]) for n in sorted(names)])
    got = {r.alias: r.canonical for r in resolution.resolve_entities(spark.createDataFrame(rows, "name string, type string")).collect()}
    assert got == want
    assert resolution.resolve_entities(spark.createDataFrame([], "name string, type string")).count() == 0


def test_reports_bottom_up(spark):
    n = spark.createDataFrame([(f"N{k}", "P", f"About {k}." + " word" * 30, 2, k) for k in range(6)], "name string, type string, description string, degree bigint, human_id bigint")
    e = spark.createDataFrame([(f"N{a}", f"N{b}", f"link {a} {b}", 4, a) for a, b in ((0, 1), (1, 2), (3, 4), (4, 5), (2, 3))], "u string, v string, description string, combined_degree bigint, human_id bigint")
    levels = spark.createDataFrame([(0, "top", None, f"N{k}") for k in range(6)] + [(1, "top/a" if k < 3 else "top/b", "top", f"N{k}") for k in range(6)] + [(1, "lone", None, "X")], "level int, community string, parent string, name string")
    small = {r.id: r for r in reports.all_reports(n, e, levels, 120).collect()}
    assert set(small) == {"top", "top/a", "top/b"} and small["top/a"].title == "N0" and small["top"].title.startswith("N")
    assert any(f.summary.startswith("N") and "[Data: Relationships" not in f.explanation for f in small["top"].findings)  # a child's report stands in
    large = {r.id: r for r in reports.all_reports(n, e, levels, 4000).collect()}
    assert len(large["top"].findings) == 5 and large["top"].rating == 4.5 and large["top"].content.startswith("# N0 and N1\n\nThis community centres on N0, N1, N2. About 0.")
    assert reports.all_reports(n, e, levels.limit(0), 100).count() == 0


def test_sources_of_a_global_search(spark):
    # two questions without a report, one with reports that share documents, one with a report that has none
    members = spark.createDataFrame([(0, f"c{k % 40}", None, f"n{k}") for k in range(400)] + [(0, "bare", None, "x")], "level int, community string, parent string, name string")
    units = spark.createDataFrame([(f"n{k}", f"u{(7 * k + j) % 900}") for k in range(400) for j in range(3)], "name string, unit_id string")
    texts = spark.createDataFrame([(f"u{k}", k % 300 if k % 11 else None, "t") for k in range(900)], "unit_id string, doc_id bigint, text string")
    index = files.Index(files.IndexConfig(), {"communities": members, "entity_units": units, "text_units": texts})
    chosen = spark.createDataFrame([("b", "c1"), ("b", "c2"), ("b", "c2"), ("b", "unknown"), *[("c", f"c{k}") for k in range(40)], ("d", "bare")], "query_id string, id string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)], "query_id string, x int")
    got = {r.query_id: (r.x, r.sources) for r in methods.with_sources(index, rows, chosen).collect()}
    want = {r.query_id: r.sources for r in methods._report_sources(index, chosen).collect()}
    assert got == {r.query_id: (r.x, want.get(r.query_id, [])) for r in rows.collect()} and len(got["c"][1]) > len(got["b"][1]) > 0
    plan = methods.with_sources(index, rows, chosen)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # nothing grows as questions times nodes


def test_points_of_rows_that_share_an_id(spark):
    q = spark.createDataFrame([("q", "Who leads the river survey?"), ("q", "Main river themes?"), ("n", None)], "query_id string, text string")
    r = spark.createDataFrame([("r1", "The river survey is led by Ada."), ("r2", "River. River. Survey."), ("r3", "Nothing here.")], "id string, content string")
    got = sorted((x.query_id, x.id, x.score, x.content) for x in answers.map_points(q, r, 20).collect())
    a, b, c = (x.content for x in r.orderBy("id").collect())
    assert got == sorted([("q", "r1", 50, a), ("q", "r2", 50, b), ("q", "r1", 50, a), ("q", "r2", 50, b), ("q", "r3", 40, c)])
