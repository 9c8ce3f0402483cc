"""A read-only subset of the graph query language: read as tokens, checked, then run as joins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import models, prompts
from loomgraph.operators.graph import both_ways, type_label

# Words that write; after LOAD and CALL the next word decides.
WRITES = {"CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "FOREACH"}
WRITE_PAIRS = {("LOAD", "CSV"), ("CALL", "DBMS"), ("CALL", "APOC")}

_LEX = re.compile(r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[^\W\d]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<space>\s+)|(?P<sign>.)""", re.S)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) of a query's tokens, white space left out; strings are one token with their quotation marks."""
    return [(m.lastgroup, m.group()) for m in _LEX.finditer(query) if m.lastgroup != "space"]


@dataclass
class Shape:
    """What a query's tokens say: its words outside brackets, names after colons by bracket, and brackets that don't match."""

    words: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    unmatched: set[str] = field(default_factory=set)


def shape(query: str) -> Shape:
    out, stack, names = Shape(), [], False
    for kind, t in tokens(query):
        if t in _CLOSES.values():
            stack.append(t)
        elif t in _CLOSES:
            if stack and stack[-1] == _CLOSES[t]:
                stack.pop()
            else:
                out.unmatched.add(_CLOSES[t] + t)
        if t == ":" or t == "|" and names:
            names = True
            continue
        if kind == "word":
            where = stack[-1] if stack else ""
            if names and where == "(":
                out.labels.append(t)
            elif names and where == "[":
                out.relations.append(t)
            elif not names:
                out.words.append(t.upper())
            if names:
                continue  # a bar may follow, and another name
        names = False
    out.unmatched |= {x + y for y, x in _CLOSES.items() if x in stack}
    return out


def problems(query: str, labels: list[str], relations: list[str] | None = None) -> list[str]:
    """What is wrong with a query; nothing if it may run. String contents don't matter."""
    s = shape(query)
    found = [f"write clause {w}" for w in s.words if w in WRITES]
    found += [f"write clause {a} {b}" for a, b in zip(s.words, s.words[1:]) if (a, b) in WRITE_PAIRS]
    found += [f"{w} is required" for w in ("MATCH", "RETURN") if w not in s.words]
    found += [f"unbalanced {x}" for x in sorted(s.unmatched)]
    found += [f"unknown label {x}" for x in s.labels if x not in labels]
    if relations is not None:
        found += [f"unknown relation {x}" for x in s.relations if x not in relations]
    return found


def schema_text(nodes: DataFrame, relation: str = "RELATED_TO") -> tuple[str, list[str]]:
    """(description of the graph for a prompt, its labels): labels by number of nodes, and the properties of nodes and edges. Labels are as many as types."""
    rows = nodes.groupBy(type_label(F.col("type")).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").collect()
    labels = [r["label"] for r in rows]
    lines = ["Node labels: Entity (all nodes), " + ", ".join(f"{r['label']} ({r['n']})" for r in rows), "Node properties: name, description, degree", f"Relationships: (:Entity)-[:{relation} {{description, weight}}]-(:Entity)"]
    return "\n".join(lines), ["Entity", *labels]


def query_for(names: list[str]) -> str:
    """The query a question's names give: the first name's neighbourhood, or some nodes without a name."""
    if names:
        name = names[0].replace("\\", "\\\\").replace('"', '\\"')
        return f'MATCH (e:Entity {{name: "{name}"}})-[r]-(n:Entity) RETURN e.name, n.name, r.weight LIMIT 25'
    return "MATCH (n:Entity) RETURN n.name LIMIT 10"


def ask_for_query(question: str, nodes: DataFrame, make: Callable[[], models.Model]) -> tuple[str, list[str]]:
    """(query, problems): what a model writes for the question, without code fences, and what is wrong with it."""
    schema, labels = schema_text(nodes)
    reply = make().complete(prompts.fill(prompts.GRAPH_QUERY, schema=schema, question=question), "query")
    query = re.sub(r"^\s*```\w*\n?|```\s*$", "", reply).strip()
    return query, problems(query, labels)


def _limit(words: list[tuple[str, str]], default: int) -> int:
    return next((int(b[1]) for a, b in zip(words, words[1:]) if a[1].upper() == "LIMIT" and b[0] == "number"), default)


def run(query: str, nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """Rows (name, other, weight) of a checked query: the neighbours of one named node, or nodes; other forms are errors."""
    wrong = problems(query, labels)
    if wrong:
        raise ValueError("; ".join(wrong))
    ts = tokens(query)
    plain = [t for _, t in ts]
    upper = [t.upper() for t in plain]
    pattern = plain[1 : upper.index("RETURN")] if upper[:1] == ["MATCH"] and "RETURN" in upper else []
    texts = [t for k, t in ts[: upper.index("RETURN")] if k == "text"]
    form = "".join(t for t in pattern if t in "()[]{}-<>")
    if form == "({})-[]-()" and len(texts) == 1 and [pattern[k - 2] for k, t in enumerate(pattern) if t in texts] == ["name"]:
        name = re.sub(r"\\(.)", r"\1", texts[0][1:-1])
        near = both_ways(edges).where(F.col("node") == name)
        return near.select(F.col("node").alias("name"), "other", "weight").orderBy(F.desc("weight"), "other").limit(_limit(ts, 25))
    if form == "()":
        return nodes.select("name", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("weight")).orderBy("name").limit(_limit(ts, 10))
    raise ValueError("this form of query is not supported")
