"""Cases that a shortcut once left out."""

import datetime as dt
import math
import random

from loomgraph.llm import names, pairs, survivors


def test_names_with_errors_in_both_ends(spark):
    right = ["Ingrid Zanferborter", "Ingrid.Zanferborter", "INGRID ZANFERBORTER", "ingrid_zanferborter", "Dr. Ingrid Zanferborter", "Zanferborter, Ingrid"] * 3
    rows = [(k, n, "PERSON", 30, None, None) for k, n in enumerate(right + ["Ingrid Zabferboeter", "Ingrid Morvilkar"])]
    links = names.link_variants(spark.createDataFrame(rows, "entity_id bigint, name string, type string, frequency int, root string, sid string"))
    root = {r.entity_id: r.root for r in links.collect()}
    assert len({root[k] for k in range(19)}) == 1 and root[19] != root[0]


def test_every_core_within_the_cost_is_met(spark):
    rng, want = random.Random(7), set()
    for _ in range(6000):
        y = "".join(rng.choice("abcdermnos") for _ in range(rng.randint(2, 11)))
        x = y
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(x) + 1)
            x = rng.choice([x[:k] + rng.choice("aemst") + x[k:], x[:k] + x[k + 1 :], x[:k] + x[k : k + 2][::-1] + x[k + 2 :], x[:k] + x[k : k + 1] + x[k:], x[: k - 1] + rng.choice("aemst") + x[k:] if k else x])
        if x and x != y and names.typing_cost(x, y, names.MOST) < math.inf:
            want.add((x, y))
    kinds = spark.createDataFrame(sorted({("person", w) for p in want for w in p}), "kind string, core string")
    met = {(r.centre, r.core) for r in names.near_cores(kinds).collect()}
    assert len(want) > 1000 and want <= met
    assert any(x[:4] != y[:4] and x[-4:] != y[-4:] for x, y in want)  # the starts and ends of cores alone miss some


def test_repeated_question_is_a_copy():
    q = "Which of the stations along the northern coast reported the longest outage of the tide gauge in March?"
    for times in (1, 2, 3, 5):
        assert pairs.is_copy(q, " ".join([q] + [q.lower().rstrip("?") + "."] * (times - 1)))
    assert not pairs.is_copy(q, q + " The longest outage in March was at Low Reef, where a storm broke the cable and the spare had to come by ship from the south.")


def test_learned_edges_are_followed_to_the_last_value(spark):
    def row(k, e, v, hour):
        return (k, e, None, v, None, "a", None if hour is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour))

    rows = []
    for e in range(4):  # cadet, then mate, then master: cadet and master never follow each other directly
        rows += [row(10 * e, e, "cadet", 1), row(10 * e + 1, e, "mate", 30), row(10 * e + 2, e, "master", 60)]
    rows += [row(100, 50, "cadet", 5), row(101, 50, "mate", None), row(102, 50, "master", None)]  # through an unstamped value
    rows += [row(110, 51, "cadet", None), row(111, 51, "mate", None)]  # no stamp at all
    rows += [row(120, 52, "pilot", None), row(121, 52, "cook", None)]  # nothing learned
    rows += [row(130, 53, "master", 5), row(131, 53, "mate", None)]
    m = spark.createDataFrame(rows, "mention_id bigint, entity_id bigint, description string, type string, source_id string, extractor string, recorded_at timestamp_ntz")
    ex = spark.createDataFrame([("a", "human", 5)], "extractor string, kind string, trust int")
    got = {r.entity_id: (r.mention_id, r.value, r.how) for r in survivors.surviving_values(m, ex).collect() if r.entity_id >= 50}
    assert got == {50: (102, "master", "learned"), 51: (111, "mate", "learned"), 52: (120, "pilot", "trust"), 53: (130, "master", "stamped")}


def test_last_value():
    ids = {v: k for k, v in enumerate("abcde")}
    assert survivors.last_value(ids, [("a", "b"), ("a", "c"), ("b", "c")], "a") == "c"
    assert survivors.last_value(ids, [("a", "b"), ("b", "a")], "a") is None  # a circle with the start
    assert survivors.last_value(ids, [("a", "d"), ("d", "c"), ("c", "d")], "a") == "c"  # a circle after it
    assert survivors.last_value(ids, [("b", "c")], "a") is None and survivors.last_value(ids, [], None) is None
    assert survivors.last_value(ids, [("a", "b"), ("c", "d"), ("d", "e")], None) == "e"
