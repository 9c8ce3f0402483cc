"""The llm operators: brute force, exact round trips, held-out accuracy, and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest

from loomgraph.llm import abuse, encoding, names, packing, pairs, splitting, survivors

MENTION = "mention_id bigint, entity_id bigint, description string, type string, source_id string, extractor string, recorded_at timestamp_ntz, field string, value string, w int"
TRUST = "extractor string, kind string, trust int"


def _t(k):
    return None if k is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def test_survivors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([1, 2, 3, None]), rng.choice(["good one", "Known for...", "N/A", " ", None, "cut [cut]", "None of these"]), rng.choice(["PERSON", "tbd", "?", None]), rng.choice(["s1", "unknown", "s2"]),
             rng.choice(["a", "b", "zz", None]), _t(rng.choice([None, 1, 2, 3])), "clash", "clash", 1) for k in range(60)]
    rows += [(100, 9, "alone", "PERSON", "s", "a", _t(1), None, None, None)] * 2 + rows[:5]
    trust = {"a": 5, "b": 2}
    ok = {"description": {"good one", "None of these"}, "type": {"PERSON"}, "source_id": {"s1", "s2"}}
    want = set()
    for e in (1, 2, 3):
        mine = {r[0]: r for r in rows if r[1] == e}
        for c, f in ((2, "description"), (3, "type"), (4, "source_id")):
            fit = [r for r in mine.values() if r[c] in ok[f]]
            if fit:
                want.add((e, f, max(fit, key=lambda r: (trust.get(r[5], -1), r[6] or dt.datetime.min, -r[0]))[0]))
    ex = spark.createDataFrame([("a", "human", 5), ("b", "rule", 2), ("a", "human", 1)], TRUST)
    got = survivors.surviving_values(spark.createDataFrame(rows, MENTION), ex, "oldest").collect()
    assert {(r.entity_id, r.field, r.mention_id) for r in got} == want and len(got) == len(want)
    assert survivors.surviving_values(spark.createDataFrame([], MENTION), ex, "learned").count() == 0


def test_currency_is_learned(spark):
    rows, k = [], 0
    for e in range(5):  # trainee is always followed by engineer
        for v, at in (("trainee", 1), ("engineer", 30)):
            k += 1
            rows.append((k, e, None, v, None, "a", _t(at), None, None, None))
    rows += [(90, 50, None, "trainee", None, "a", _t(5), None, None, None), (91, 50, None, "engineer", None, "a", None, None, None, None)]
    rows += [(92, 51, None, "engineer", None, "a", _t(5), None, None, None), (93, 51, None, "trainee", None, "a", None, None, None, None)]
    ex = spark.createDataFrame([("a", "human", 5)], TRUST)
    got = {r.entity_id: (r.mention_id, r.how) for r in survivors.surviving_values(spark.createDataFrame(rows, MENTION), ex).collect()}
    assert got[50] == (91, "learned") and got[51] == (92, "stamped")


def test_pieces_cover_and_overlap():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.choice([0, 5, 300, 301, 900, 2500])
        text = "".join(rng.choice(["w", "word", "Dr.", "end.", "x,", "日本"]) + rng.choice([" ", "\n", "\n\n", "　", "  "]) for _ in range(n))
        cuts = splitting.cut_points(text, 400, 30)
        if n <= 300:
            assert cuts == []
            continue
        words = text.split()
        assert cuts[0][0] == 0 and cuts[-1][1] == len(words)
        for i, j, lo, hi in cuts:
            assert text[lo:hi].split() == words[i:j] and splitting.word_tokens(j - i) <= 400
        assert all(a[1] - 30 == b[0] for a, b in zip(cuts, cuts[1:]))


def test_pieces_prefer_boundaries_and_tables(spark):
    text = " ".join("w" for _ in range(250)) + " stop.\n\n" + " ".join("v" for _ in range(200))
    u = spark.createDataFrame([("u", 1, text, 10, "x"), ("u", 1, text, 10, "x"), ("n", 1, None, None, None), ("e", 1, "", 0, None), ("lost", 2, text, None, None), ("gone", 3, text, None, None), ("long", 1, "y" * 5000, 0, None)],
                              "id string, doc_id bigint, text string, start_char int, piece string")
    p = splitting.split_oversized(u)
    assert [r.at_to for r in p.where("id = 'u/000'").collect()] == [text.index("stop.") + 5]
    d = spark.createDataFrame([(2, "ab " + text), (1, text)], "doc_id bigint, text string")
    got = {(r.id): (r.start_char, r.n_tokens) for r in splitting.in_document(p, u, d).collect()}
    assert got["u/000"][0] == 10 and got["lost/000"][0] == 3 and got["gone/000"][0] is None and len(got) == 6
    assert splitting.split_oversized(u.limit(0)).count() == 0


def test_pairs(spark):
    q = "Who leads the tide gauge project near Low Reef?"
    cases = {
        "a1": (q, None, "empty"), "a2": (q, " ​ ", "empty"), "a3": (q, "Final answer: ", "empty"), "a4": (q, "N/A", "empty"),
        "b1": (q, q.upper(), "copy"), "b2": (q, "Question: " + q, "copy"), "b3": (q, "Who  leads the tide guage project near Low Reef", "copy"),
        "c1": (q, "I'm sorry, but I can't help with that.", "refusal"), "c2": (q, "Lo siento, no puedo ayudar con eso.", "refusal"), "c3": (q, 'She said "I cannot say" and left the room with Ann.', None),
        "d1": (q, "Le travail est mené par Ann depuis la fin de la saison.", "language"), "d2": (q, "この計画は変更されました。", "language"), "d3": (q, "The motto reads «nous gardons la mesure».", None),
        "e1": (q, "The work is headed by Ann, who reports to the…", "truncated"), "e2": (q, "They need spare modules (seals, fuses", "truncated"), "e3": (q, "Work stopped at the gauge because,", "truncated"),
        "f1": (q, "Ann Lee", None), "f2": (q, "1. fog\n2. cables", None), "f3": (q, "No.", None), "f4": (None, "It is led by Ann.", None), "f5": (None, "", "empty"),
    }
    rows = [("t", k, a, b, "clash") for k, (a, b, _) in cases.items()]
    rows += [("bulk", f"s{k}", q, f"The work at station {k} is headed by Ann and ended in the old harbour.", None) for k in range(40)]
    rows += [("bulk", "stopless", q, "The work at station 77 is headed by Ann and ended in the old harbour", None), ("bulk", "cut", q, "The work at station 78 is headed by Ann and ended in", None)]
    df = spark.createDataFrame(rows + rows[:4], "pair_table string, pair_id string, question string, answer string, defect string")
    got = {r.pair_id: r.defect for r in pairs.defective_pairs(df).collect()}
    assert {k: got.get(k) for k in cases} == {k: d for k, (_, _, d) in cases.items()}
    assert got["cut"] == "truncated" and "stopless" not in got and "s3" not in got
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_suffix_automaton_coverage():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        seen = [False] * len(b)
        for i in range(len(b)):
            for j in range(i + 3, len(b) + 1):
                if b[i:j] in a:
                    seen[i:j] = [True] * (j - i)
        assert pairs.SuffixAutomaton(a).coverage(b, 3) == sum(seen)


def _same(spark, rows):
    links = names.link_variants(spark.createDataFrame(rows, "entity_id bigint, name string, type string, frequency int, root string, sid string"))
    return {(r.entity_id_a, r.entity_id_b) for r in names.linked_pairs(links).collect()}, links.count()


def test_name_variants(spark):
    group = {
        1: ["Katherine Melvontar", "MELVONTAR, K.", "Kate Melvontar", "Dr. Katherine Melvontra", "katherine_melvontar"],
        2: ["Robert Melvontar", "Bob L. Melvontar"],
        3: ["Sordunkel Marine Institute", "Institute of Sordunkel Marine", "SordunkelMarine Inst.", "Sordunkel M. I.", "Sordunkel Institute"],
        4: ["Sordunkel Polar Foundation"],
        5: ["Project Harbolin 4", "The Harbolin Project no. 4", "Prj Harbolin IV"], 6: ["Project Harbolin 5"],
        7: ["RV Tansilvor", "Tansilvor (vessel)"], 8: ["Melvontar Reef", "Reef Melvontar", "the Melvontar Rf"],
    }
    kind = {1: "PERSON", 2: None, 3: "ORG", 4: "organization", 5: "PROGRAMME", 6: "PROJECT", 7: "SHIP", 8: "Place"}
    rows, want, k = [], set(), 0
    for g, ns in group.items():
        ids = list(range(k, k + len(ns)))
        rows += [(i, n, kind[g], 3, "clash", "clash") for i, n in zip(ids, ns)]
        want |= {(a, b) for a in ids for b in ids if a < b}
        k += len(ns)
    # other names, from which the words that qualify names are learned
    others = [f"{c} {q}" for c in ("Quorbin", "Zadmeltor", "Hulvensir", "Pelgandor", "Tarfolin", "Wexunbar") for q in ("Marine Institute", "Polar Foundation")]
    rows += [(500 + i, n, "ORG", 1, None, None) for i, n in enumerate(others)] + [(600 + i, f"{c} Reef", "PLACE", 1, None, None) for i, c in enumerate(("Ostermul", "Jandovar", "Kelbrusan", "Yolpentir", "Ubranzol"))]
    rows += [(700 + i, f"{g} {c}", "PERSON", 1, None, None) for i, (g, c) in enumerate((g, c) for g in ("Katherine", "Robert") for c in ("Ilverdan", "Xunporel", "Wastimor"))]
    k += 23
    rows += [(900, None, None, None, None, None), (901, " ", None, None, None, None), (902, "12", "PERSON", 1, None, None)] + rows[:3]
    got, n = _same(spark, rows)
    assert got == want and n == k + 3
    assert _same(spark, [])[0] == set()


def test_typing_cost():
    assert names.typing_cost("abcd", "abcd") == 0 and names.typing_cost("abdc", "abcd") == pytest.approx(0.9)
    assert names.typing_cost("abc", "abcd") == pytest.approx(1.0) and names.typing_cost("abccd", "abcd") == pytest.approx(0.9)
    assert names.typing_cost("abxx", "yzcd") == float("inf")


@pytest.fixture(scope="module")
def coder():
    return encoding.encoder(encoding.vocabulary_path())


def test_encoding_is_exact(coder, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("abc'sdt 12.,\n日é ", "ab'\n\t　", "wordy ", "日本語") for n in (1, 40, 3000)]
    texts += ["<|endoftext|> is text", "a" * 9000, " " * 5000, "it's " * 2000, "é​" * 3000]
    for longest in (4096, 37):
        monkeypatch.setattr(encoding, "LONGEST", longest)
        coder.known.clear()
        for x in texts:
            assert coder.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_encode_corpus_edges(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encoding.encode_corpus(d, encoding.vocabulary_path()).collect()}
    assert got == {1: [], 2: [], 3: [15496, 995]}
    assert encoding.encode_corpus(d.limit(0), encoding.vocabulary_path()).count() == 0
    assert [(r.doc_id, r.n_tokens) for r in encoding.corpus_sizes(d, encoding.vocabulary_path()).collect()] == [(3, 2)]


def test_containers(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.randint(1, 300), rng.randint(1, 2048), 2048, 5000, 7]), "clash") for k in range(3000)] + [(9001, None, None), (9002, 0, None), (9003, -4, None)]
    items = spark.createDataFrame(rows, "item_id bigint, n int, container string")
    got = packing.fill_containers(items, 2048, bucket_rows=500).collect()
    size, used, spans = {i: n for i, n, _ in rows if n and n > 0}, {}, {}
    for r in got:
        used.setdefault(r.container, []).append((r["at"], r.n))
        spans.setdefault(r.item_id, []).append((r.item_from, r.n))
    assert set(spans) == set(size)
    for i, s in spans.items():
        s.sort()
        assert sum(n for _, n in s) == size[i] and (len(s) == 1 or size[i] > 2048) and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
    for s in used.values():
        s.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048
    assert len(used) <= 1.02 * -(-sum(size.values()) // 2048) + 2
    assert packing.fill_containers(items.limit(0)).count() == 0


def test_plan_holds_every_item():
    rng = np.random.default_rng(6)
    for n in (1, 30, 4000):
        lengths, counts = np.unique(rng.integers(1, 101, n), return_counts=True)
        hist = dict(zip(lengths.tolist(), counts.tolist()))
        plan, held = packing.plan_containers(hist, 100, rounds=60), {}
        for config, times in plan:
            assert sum(x * a for x, a in config) <= 100
            for x, a in config:
                held[x] = held.get(x, 0) + a * times
        assert held == hist


def _labelled(n, seed):
    rng = random.Random(seed)
    calm = ["The board discussed ferry delays for an hour.", "A second winch was bought in {m}.", "The gauge near {p} returned many readings.", "Volunteers counted nests along the shore of {p}.", "The pump killed the bacteria in the tank.", "Nobody knows why the {m} log is missing."]
    bad = ["{p} is a worthless piece of dirt and should be beaten.", "Those hill folk are vermin, drive them out.", "I will break your bones, {p}."]
    out = []
    for k in range(n):
        s = [rng.choice(calm) for _ in range(rng.randint(2, 6))]
        y = k % 5 == 0
        if y:
            b = rng.choice(bad)
            s.insert(rng.randint(0, len(s)), b.replace("{p}", "Dunkel").upper() if k % 2 else b.replace("e", "3") if k % 3 else b)
        out.append((" ".join(x.format(p=rng.choice(["Dunkel", "Morvil", "Tasvor", "Helkin"]), m=rng.choice(["March", "June", "May"])) for x in s), int(y)))
    return out


def test_abuse_held_out(spark):
    fit, held = _labelled(600, 1), _labelled(300, 2)
    model = abuse.train([t for t, _ in fit], [y for _, y in fit])
    got = [model.score(t)[0] > model.threshold for t, _ in held]
    hit = sum(g and y for g, (_, y) in zip(got, held))
    assert hit >= 0.9 * sum(y for _, y in held) and hit >= 0.9 * sum(got)
    docs = spark.createDataFrame([(k, t, "s" if k % 2 else None, "clash") for k, (t, _) in enumerate(fit)] + [(9000, None, "s", None), (9001, "", "s", None), (9002, "x" * 60_000, "s", None)], "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(k, y, "r") for k, (_, y) in enumerate(fit)] + [(1, 1, "r"), (2, None, "r")], "doc_id bigint, toxic int, reviewer string")
    scored = abuse.score_documents(docs, labels)
    assert scored.count() == 603 and [r.flagged for r in scored.where("doc_id >= 9000").collect()] == [False] * 3
    assert {r.source for r in abuse.rates_by_source(scored).collect()} == {"s", None}
    assert abuse.score_documents(docs, labels.limit(0)).where("flagged").count() == 0
    assert abuse.score_documents(docs.limit(0), labels).count() == 0


def test_abuse_with_few_verdicts(spark):
    docs = [(t, y) for k, (t, y) in enumerate(_labelled(400, 3)) if k < 80 or not y or k % 20 == 0]  # verdicts are enriched in offending documents
    frame = spark.createDataFrame([(k, t, "s") for k, (t, _) in enumerate(docs)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(k, y, "r") for k, (_, y) in enumerate(docs[:80])], "doc_id bigint, toxic int, reviewer string")
    found = {r.doc_id for r in abuse.score_documents(frame, labels).where("flagged").collect()}
    true = {k for k, (_, y) in enumerate(docs) if y}
    assert len(found & true) >= 0.8 * len(true) and len(found & true) >= 0.95 * len(found)


def test_folding():
    assert abuse.fold("p a t h e t i c") == "pathetic" and abuse.fold("brаindеad") == "braindead"
    assert abuse.segments("7H1GH$ @ND")[0][0] == "thighs" and abuse.fold("ex​plicit <|im_start|> é") == "explicit   e"


def test_refusals_of_unseen_wording():
    said = [
        "I am not able to give you any names here.", "We cannot comment on ongoing work.", "I won't speculate about the reasons.", "Sorry, this is a matter that I am not permitted to discuss.", "I don't have any details on that person.",
        "The documents do not provide sufficient information on this.", "It would not be right for me to talk about their health.", "Regrettably the question cannot be answered here.", "I would prefer not to go into this.",
        "Je ne suis pas en mesure de vous communiquer ces noms.", "Je n'ai pas les données nécessaires.", "No me es posible revelar ese nombre.", "No dispongo de los datos necesarios.",
        "Dazu darf ich Ihnen nichts sagen.", "Ich kann das leider nicht kommentieren.", "Mir fehlen dazu die Unterlagen, daher habe ich leider keine Angaben.",
    ]
    sound = [
        "He could not answer the call because the line was cut.", "The crew cannot help with repairs until May.", "The report does not say who paid.", "Nobody was allowed to talk during the vote.", "I think the ferry sank. It can't be helped.",
        "The minister said “I cannot answer that” and left.", "Le conseil ne peut pas payer la réparation.", "El puerto no tiene acceso al tren.", "Die Fähre kann nicht fahren, sagen die Leute.", "The context contains enough information about the pump.", "",
    ]
    assert [t for t in said if not pairs.refuses(t)] == []
    assert [t for t in sound if pairs.refuses(t)] == []
