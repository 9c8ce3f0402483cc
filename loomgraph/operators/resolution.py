"""Alias resolution in the order of names: candidate pairs by keys, then a sequential pass within each connected part."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.graph import is_acronym, ratio
from loomgraph.session import cut


def compatible(short: str, long: str, short_kind: str, long_kind: str, threshold: float) -> bool:
    """May the shorter name be another form of the longer one? Kinds must agree, an unknown one agrees with any."""
    if short_kind and long_kind and short_kind != long_kind:
        return False
    return set(short.split()) < set(long.split()) or is_acronym(short, long) or ratio(short, long) >= threshold


def resolve(names: list[tuple], threshold: float = 0.9) -> dict[str, str]:
    """Raw name -> display name, for (raw name, normal name) or (raw name, normal name, kind).

    Longer normal names come first; one joins an earlier head if exactly one is compatible. The display name of a group is
    the longest raw spelling of its head.
    """
    spelled: dict[str, set[str]] = {}
    kind: dict[str, str] = {}
    for raw, normal, *k in names:
        spelled.setdefault(normal or raw, set()).add(raw)
        kind[normal or raw] = k[0] if k else ""
    head: dict[str, str] = {}
    heads: list[str] = []
    for name in sorted(spelled, key=lambda n: (-len(n.split()), -len(n), n)):
        fits = [h for h in heads if compatible(name, h, kind[name], kind[h], threshold)]
        head[name] = fits[0] if len(fits) == 1 else name
        if len(fits) != 1:
            heads.append(name)
    shown = {h: max(spelled[h], key=lambda r: (len(r), r)) for h in heads}
    return {raw: shown[head[n]] for n, raws in spelled.items() for raw in raws}


def _keys(name: str) -> set[str]:
    """Keys that two names have in common if one may be a form of the other: a word; one letter less; initials.

    A short form is a strict subset of the words, so it shares each of its words. Initials: those of a name of several
    words, and every choice of letters with the first one from a single word of 2 to 6.
    """
    words = name.split()
    out = {"w " + w for w in words} | {"d " + name} | {"d " + name[:k] + name[k + 1 :] for k in range(len(name))}
    if len(words) > 1:
        out.add("i " + "".join(w[0] for w in words))
    elif 2 <= len(name) <= 6:
        out |= {"i " + name[0] + "".join(c) for n in range(1, len(name)) for c in combinations(name[1:], n)}
    return out


def resolve_entities(mentions: DataFrame, threshold: float = 0.9, most: int = 20_000) -> DataFrame:
    """Rows (alias, canonical) of all distinct names of mentions (name, type).

    Names that share a key are compared; the compatible ones form connected parts, found by passing on the smallest name,
    and each part is resolved as a whole, in the order of names, by one task. So the result is that of one pass over all
    names, but for similar names that share no word and are more than one letter apart. A word of more than a
    thousandth of the names (and of ten names at least) is a key only together with a second word, or alone for names of
    that one word. More than `most` names in one part are an error: their order-dependent result can't be had piecewise.
    """
    n = mentions.select("name", X.normalize_name(F.col("name")).alias("normal"), F.upper("type").alias("type")).where("name <> ''")
    n = n.withColumn("normal", F.when(F.col("normal") == "", F.col("name")).otherwise(F.col("normal")))
    votes = n.where("type <> ''").groupBy("normal", "type").agg(F.count(F.lit(1)).alias("n"))
    kind = votes.groupBy("normal").agg(F.max_by("type", F.struct("n", "type")).alias("kind"))
    raw = cut(n.select("name", "normal").distinct())
    names = cut(raw.select("normal").distinct().join(kind, "normal", "left").fillna("", ["kind"]))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.iloc[k : k + 1000]
                yield pd.DataFrame([(key, x, t) for x, t in zip(part["normal"], part["kind"]) for key in _keys(x)], columns=["key", "normal", "kind"])

    keys = cut(names.mapInPandas(keyed, "key string, normal string, kind string"))
    total = names.count()
    usual = keys.where("key like 'w %'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(10, total // 1000)).select("key")
    rare = keys.join(usual, "key", "left_anti")
    # names all of whose words are usual meet by pairs of words, and names of one usual word meet what holds it
    frequent = keys.join(usual, "key", "left_semi")
    ones = frequent.where(F.instr("normal", " ") == 0).select("key", "normal", "kind")
    only = names.join(rare.where("key like 'w %'").select("normal").distinct(), "normal", "left_anti").where("normal like '% %'")
    two = lambda df: df.select("normal", "kind", F.array_sort(F.array_distinct(F.split("normal", " "))).alias("w")).where("size(w) > 1").select("normal", "kind", F.explode(F.expr("flatten(transform(sequence(1, size(w) - 1), i -> transform(slice(w, i + 1, size(w)), y -> concat('p ', w[i - 1], ' ', y))))")).alias("key"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("key", F.col("normal").alias("long"), F.col("kind").alias("long_kind"))
        met = a.join(b, "key").where((F.col("normal") != F.col("long")) & ((F.col("kind") == "") | (F.col("long_kind") == "") | (F.col("kind") == F.col("long_kind"))))
        return met.select("normal", "kind", "long", "long_kind")

    met = pairs(rare, rare).unionByName(pairs(ones, frequent)).unionByName(pairs(two(only), two(names))).distinct()

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [(x, y) for x, k, y, m in b.itertuples(index=False, name=None) if (-len(x.split()), -len(x), x) > (-len(y.split()), -len(y), y) and compatible(x, y, k, m, threshold)]
            yield pd.DataFrame(ok, columns=["a", "b"])

    links = cut(met.mapInPandas(fits, "a string, b string"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = names.select(F.col("normal").alias("a"), F.col("normal").alias("part"))
    while True:  # the smallest name of a part spreads, by neighbours and by jumps
        near = both.join(label.select(F.col("a").alias("b"), F.col("part").alias("p")), "b").groupBy("a").agg(F.min("p").alias("p"))
        new = label.join(near, "a", "left").select("a", F.least("part", F.coalesce("p", "part")).alias("next"), "part")
        jump = new.join(new.select(F.col("a").alias("next"), F.col("next").alias("far")), "next").select("a", F.least("next", "far").alias("part"), (F.least("next", "far") != F.col("part")).alias("moved"))
        jump = cut(jump)
        label = jump.select("a", "part")
        if jump.where("moved").isEmpty():
            break
    rows = raw.join(names, "normal").join(label.withColumnRenamed("a", "normal"), "normal").select("part", "name", "normal", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []

        def out() -> pd.DataFrame:
            if len({x[1] for x in held}) > most:
                raise ValueError(f"{part!r} is connected with more than {most} names")
            return pd.DataFrame(list(resolve(held, threshold).items()), columns=["alias", "canonical"])

        for b in batches:
            for p, *row in b.itertuples(index=False, name=None):
                if p != part:
                    if held:
                        yield out()
                    part, held = p, []
                held.append(tuple(row))
        if held:
            yield out()

    return rows.repartition("part").sortWithinPartitions("part", "name").mapInPandas(run, "alias string, canonical string")


def majority(values: list[str]) -> str:
    """The most frequent value, ties to the first seen."""
    return Counter(values).most_common(1)[0][0] if values else ""
