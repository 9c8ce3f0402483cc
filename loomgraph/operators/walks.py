"""Iterative graph algorithms as rounds of joins: PageRank, flow, paths, communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import sparse
from loomgraph.operators.graph import both_ways, degrees
from loomgraph.session import cut

#: Edges up to which Louvain's sweeps are computed in the driver, 16 bytes each way in mapped files; beyond, the same sweeps run as joins.
SMALL = 5_000_000


def pagerank_batch(edges: DataFrame, nodes: DataFrame, queries: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """Rows (query_id, name, p) with p > 0: personalised PageRank of many queries (query_id) at once, alpha being the probability of following an edge.

    nodes (name), seeds (query_id, name, weight). Negative seed weights count as 0 and unknown names are ignored; a query
    without a valid seed gets plain PageRank, computed once for all of them. Nodes without edges send their mass to the
    seeds. Edges of weight 0 or less are not followed. The edges are shipped to the executors as files of numbers; a task
    takes a block of queries through all rounds, until no query of the block changes by tol, so nothing is shuffled in between.
    """
    return _spread(edges, nodes, queries, seeds, None, None, alpha, rounds, tol)


def passage_scores(edges: DataFrame, nodes: DataFrame, queries: DataFrame, seeds: DataFrame, members: DataFrame, best: int | None = None, alpha: float = 0.85, rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """Rows (query_id, unit_id, score) with score > 0: the summed PageRank (see pagerank_batch) of the nodes taken from each unit; members (name, unit_id).

    With `best` only units whose score is at least the best-th of their query, up to 1e-9, have rows.
    """
    return _spread(edges, nodes, queries, seeds, members, best, alpha, rounds, tol)


#: Queries and bytes of a task's block.
BLOCK, BLOCK_BYTES = 32, 1 << 26


def _spread(edges: DataFrame, nodes: DataFrame, queries: DataFrame, seeds: DataFrame, members: DataFrame | None, best: int | None, alpha: float, rounds: int, tol: float) -> DataFrame:
    spark = edges.sparkSession
    ids = sparse.numbered(nodes)
    files = sparse.graph_files(both_ways(edges.where("weight > 0")), ids)
    if members is not None:
        m = members.where("unit_id is not null").select("name", F.col("unit_id").cast("string").alias("unit_id")).distinct()
        files.add_pairs(m.join(ids, "name").select("unit_id", "i"), "unit_id", "i", "unit")
    files = files.ship(spark)
    what, kind = ("name", "string") if members is None else ("unit", dict(members.dtypes)["unit_id"])
    valid = seeds.join(ids, "name").groupBy("query_id", "i").agg(F.sum(F.greatest("weight", F.lit(0.0))).cast("double").alias("w")).where("w > 0")
    per = cut(valid.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("seeds")))  # as many as a query has seeds
    # queries of the same seeds are ranked once, up to BLOCK of them
    alike = per.groupBy("seeds").agg(F.collect_list(F.struct("query_id")).alias("ids"))
    alike = cut(alike.select(F.col("seeds.i").alias("at"), F.col("seeds.w").alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(BLOCK)), lambda k: F.slice("ids", k, BLOCK))).alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = files.texts(what)
        node, other, weight = (files.get(c) for c in ("node", "other", "weight"))
        n = len(files.get("name_size"))
        out = np.bincount(node, weight, n)
        step, apart = sparse.Product(node, other, weight / out[other], n), np.flatnonzero(out == 0)
        sums = sparse.Product(files.get("unit"), files.get("unit_of"), None, len(texts)) if what == "unit" else None
        width = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, n, len(texts)))))
        for b in batches:
            at, w = b.column("at").to_pylist(), b.column("w").to_pylist()
            for first in range(0, b.num_rows, width):
                block = range(first, min(first + width, b.num_rows))
                s = np.zeros((n, len(block)))
                for k, r in enumerate(block):
                    s[at[r] if at[r] else slice(None), k] = w[r] if at[r] else 1.0
                s /= s.sum(0)
                p = s.copy()
                for _ in range(rounds):
                    new = step.of(p)
                    new += s * p[apart].sum(0)
                    new *= alpha
                    new += (1 - alpha) * s
                    p -= new
                    change = np.abs(p, out=p).sum(0).max()
                    p = new
                    if change < tol:
                        break
                got = p if sums is None else sums.of(p)
                for k, r in enumerate(block):
                    x = got[:, k]
                    least = np.partition(x, -best)[-best] - 1e-9 if best and best < len(x) else 0.0
                    rows = np.flatnonzero((x > 0) & (x >= least))
                    names, x = texts.take(pa.array(rows)).cast(pa.string()), pa.array(x[rows])
                    for q in b.column("ids")[r].values.field(0):
                        yield pa.RecordBatch.from_arrays([pa.repeat(q, len(rows)), names, x], ["query_id", "unit", "p"])

    def ranked(rows: DataFrame, n: int) -> DataFrame:
        wide = spark.sparkContext.defaultParallelism
        got = rows.repartition(wide * max(1, -(-n // (BLOCK * wide)))).mapInArrow(run, f"query_id {rows.schema['ids'].dataType.elementType['query_id'].dataType.simpleString()}, unit string, p double")
        return got.withColumnRenamed("unit", "name") if members is None else got.select("query_id", F.col("unit").cast(kind).alias("unit_id"), F.col("p").alias("score"))

    got = ranked(alike, alike.count())
    known = per.select(F.col("query_id").alias("_known"))
    plain = queries.select("query_id").distinct().join(known, F.col("query_id").eqNullSafe(F.col("_known")), "left_anti")
    if plain.isEmpty() or ids.isEmpty():
        return got
    every = ranked(spark.range(1).select(F.array(F.struct(F.lit(0).alias("query_id"))).alias("ids"), F.array().cast("array<bigint>").alias("at"), F.array().cast("array<double>").alias("w")), 1)
    return got.unionByName(every.drop("query_id").crossJoin(F.broadcast(plain) if plain.count() <= 1000 else plain).select(*got.columns))


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """Rows (name, p) of every node for one query's seeds (name, weight); see pagerank_batch."""
    one = F.lit(0).alias("query_id")
    p = pagerank_batch(edges, nodes, edges.sparkSession.range(1).select(one), seeds.select(one, "name", "weight"), alpha, rounds, tol)
    return nodes.select("name").distinct().join(p.select("name", "p"), "name", "left").fillna(0.0, ["p"])


def spread_flow(edges: DataFrame, sources: DataFrame, hops: int = 3, decay: float = 0.8, threshold: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(flow, expanded): rows (source, node, flow, hop), and the (source, node) that passed their flow on.

    Each hop a node gives decay * its flow / degree to each neighbour without flow before this hop; shares below the
    threshold are not passed on. sources: (name).
    """
    adj = both_ways(edges).select("node", "other")
    deg = degrees(edges)
    start = sources.select(F.col("name").alias("source"), F.col("name").alias("node")).distinct().join(deg.select("node"), "node", "left_semi")
    flow = start.select("source", "node", F.lit(1.0).alias("flow"), F.lit(0).alias("hop"))
    frontier, expanded = flow, None
    for hop in range(1, hops + 1):
        given = frontier.join(deg, "node").withColumn("share", decay * F.col("flow") / F.greatest("degree", F.lit(1))).where(F.col("share") >= threshold)
        given = cut(given.select("source", "node", "share"))
        expanded = given.select("source", "node") if expanded is None else expanded.unionByName(given.select("source", "node"))
        got = given.join(adj, "node").select("source", F.col("other").alias("node"), "share").join(flow.select("source", "node"), ["source", "node"], "left_anti")
        frontier = cut(got.groupBy("source", "node").agg(F.sum("share").alias("flow")).withColumn("hop", F.lit(hop)))
        flow = flow.unionByName(frontier.select("source", "node", "flow", "hop"))
    return flow, expanded.distinct()


def relational_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int = 3, decay: float = 0.8, threshold: float = 0.02) -> DataFrame:
    """Rows (source, target, path, score): simple paths of up to `hops` edges through nodes that passed flow on.

    A path ends at its first target. The score is the mean flow of its nodes after the source (node flow, not path flow).
    How many paths there are is bounded by the flow: a node passes shares of at least the threshold or none, and a hub
    none. Paths grow only towards nodes from which a target can still be reached. `best_paths` keeps the best.
    """
    flow, expanded = spread_flow(edges, sources, hops, decay, threshold)
    adj = both_ways(edges).select("node", "other")
    goal = targets.select(F.col("name").alias("last")).distinct()
    reach = flow.select("source", F.col("node").alias("other"), "flow")
    # per source, how many edges a node is from a target, through nodes that flow reached
    far = near = reach.join(goal, reach.other == goal.last).select("source", F.col("other").alias("node"), F.lit(0).alias("far"))
    for k in range(1, hops):
        step = near.join(adj, "node").select("source", F.col("other").alias("node")).distinct().join(reach.select("source", F.col("other").alias("node")), ["source", "node"], "left_semi")
        near = cut(step.join(far, ["source", "node"], "left_anti").withColumn("far", F.lit(k)))
        far = far.unionByName(near)
    reach = cut(reach.join(far.withColumnRenamed("node", "other"), ["source", "other"]))
    live = flow.where("hop = 0").select("source", F.array("node").alias("path"), F.col("node").alias("last"), F.lit(0.0).alias("total"))
    done = None
    for k in range(1, hops + 1):
        go = live.join(expanded.withColumnRenamed("node", "last"), ["source", "last"], "left_semi")
        step = go.join(adj, go.last == adj.node).where(~F.array_contains("path", F.col("other"))).join(reach, ["source", "other"]).where(F.col("far") <= hops - k)
        step = cut(step.select("source", F.concat("path", F.array("other")).alias("path"), F.col("other").alias("last"), (F.col("total") + F.col("flow")).alias("total")))
        hit = step.join(goal, "last", "left_semi")
        done = hit if done is None else done.unionByName(hit)
        live = step.join(goal, "last", "left_anti")
    return done.select("source", F.col("last").alias("target"), "path", (F.col("total") / (F.size("path") - 1)).alias("score"))


def best_paths(paths: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k best paths of each group: by score, then fewer edges, then the order of names."""
    from loomgraph.operators.ranking import best_of

    return best_of(paths, by, [F.desc("score"), F.size("path"), F.col("path")], k)


def narrated(paths: DataFrame, descriptions: DataFrame) -> DataFrame:
    """`paths` (path, score) with `line`: the names with the descriptions (u, v, description) of the edges between them, cut to 200 characters."""
    rows = paths.withColumn("_id", F.xxhash64("path"))
    hop = rows.select("_id", "path", F.posexplode(F.slice("path", F.lit(2), F.size("path"))).alias("k", "to")).withColumn("from_", F.col("path")[F.col("k")])
    hop = hop.distinct().join(descriptions.select("u", "v", "description"), (F.least("from_", "to") == F.col("u")) & (F.greatest("from_", "to") == F.col("v")), "left")
    step = F.concat(F.lit(" --["), F.substring(F.coalesce("description", F.lit("related to")), 1, 200), F.lit("]--> "), F.col("to"))
    told = hop.groupBy("_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", step.alias("s")))), lambda x: x["s"]), "").alias("told"))
    return rows.join(told, ["_id", "path"]).withColumn("line", F.format_string("%s%s  (score %.3f)", F.col("path")[0], F.col("told"), F.col("score"))).drop("_id", "told")


def shortest_paths(edges: DataFrame, pairs: DataFrame, k: int = 3, hops: int | None = None) -> DataFrame:
    """Rows (source, target, path, rank): the k shortest simple paths by number of edges, ties in the order of the path.

    First the distance of every node to each target is found, by rounds that stop when nothing new is reached (or at
    `hops`); so a path grows only through nodes from which the target can be reached. Then paths grow by one edge a round;
    a pair is closed when it has k paths, all of that length being found, and the rest goes on. `hops` bounds the paths;
    without it the search ends when every pair is closed or no path can grow.
    """
    from loomgraph.operators.ranking import best_of

    want = pairs.select("source", "target").where("source <> target").distinct()
    adj = cut(both_ways(edges).select("node", "other").distinct())
    reach = new = want.select("target", F.col("target").alias("node"), F.lit(0).alias("far")).distinct()
    far = 0
    while hops is None or far < hops:
        far += 1
        new = cut(new.join(adj, "node").select("target", F.col("other").alias("node")).distinct().join(reach, ["target", "node"], "left_anti").withColumn("far", F.lit(far)))
        if new.isEmpty():
            break
        reach = reach.unionByName(new)
    reach = cut(reach)
    live = want.join(reach.select("target", F.col("node").alias("source")), ["source", "target"], "left_semi").select("source", "target", F.array("source").alias("path"), F.col("source").alias("last"))
    done, hop = None, 0
    while hops is None or hop < hops:
        hop += 1
        step = live.join(adj, live.last == adj.node).where(~F.array_contains("path", F.col("other")))
        step = step.join(reach.select("target", F.col("node").alias("other"), "far"), ["target", "other"])
        if hops is not None:
            step = step.where(F.col("far") + hop <= hops)
        step = cut(step.select("source", "target", F.concat("path", F.array("other")).alias("path"), F.col("other").alias("last")))
        hit = step.where("last = target").select("source", "target", "path")
        done = hit if done is None else done.unionByName(hit)
        closed = done.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("source", "target")
        live = step.where("last <> target").join(closed, ["source", "target"], "left_anti")
        if live.isEmpty():
            break
    if done is None:
        done = live.select("source", "target", "path").limit(0)
    return best_of(done, ["source", "target"], [F.size("path"), F.col("path")], k)


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a partition (name, community); 0 for a graph without edges."""
    c = members.select(F.col("name"), F.col("community"))
    e = edges.join(c.select(F.col("name").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("name").alias("v"), F.col("community").alias("cv")), "v")
    deg = e.select(F.col("cu").alias("c"), "weight").unionByName(e.select(F.col("cv").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    inside = e.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("weight").alias("l"))
    per = deg.join(inside, "c", "left").select(F.coalesce("l", F.lit(0.0)).alias("l"), "d")
    m = e.agg(F.sum("weight").alias("m"))
    sums = per.agg(F.sum("l").alias("l"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    total = m.first()["m"] or 0.0
    if not total:
        return sums.select(F.lit(0.0).alias("modularity"))
    return sums.select((F.col("l") / total - resolution * F.col("dd") / (4.0 * total * total)).alias("modularity"))


def _sweeps(graph: tuple[np.ndarray, np.ndarray, np.ndarray], k: np.ndarray, whole: np.ndarray, mark: np.ndarray, resolution: float, level: int, sweeps: int) -> np.ndarray:
    """The sweeps of `_level_by_joins` over a graph of numbers: each node's community. Threads take ranges of nodes, which all see the same state."""
    from concurrent.futures import ThreadPoolExecutor

    node, other, weight = graph
    n = len(k)
    start = sparse.starts(node, n)
    com = np.arange(n)

    def best(a: int, b: int) -> np.ndarray:
        rows, own = slice(start[a], start[b]), com[a:b]
        key = np.concatenate([(node[rows].astype(np.int64) - a) * n + com[other[rows]], np.arange(b - a) * n + own])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        w = np.add.reduceat(np.concatenate([weight[rows], np.zeros(b - a)])[order], first)
        r, c = np.divmod(key[first], n)
        stays, mine = c == own[r], k[a:b][r]
        gain = np.round(w - resolution * (total[c] - np.where(stays, mine, 0.0)) * mine / whole[a:b][r], 9)
        begin = np.searchsorted(r, np.arange(b - a))
        pick = np.where(gain == np.maximum.reduceat(gain, begin)[r], np.where(stays, -1, c), n)
        pick = np.minimum.reduceat(pick, begin)
        return np.where(pick < 0, own, pick)

    ranges = list(sparse.chunks(start, 100_000))
    with ThreadPoolExecutor() as threads:
        for sweep in range(sweeps):
            total = np.bincount(com, k, n)
            to = np.concatenate(list(threads.map(lambda x: best(*x), ranges)))
            wanted = bool((to != com).any())
            com = np.where((mark >> ((level * sweeps + sweep) % 61)) & 1, to, com)
            if not wanted:
                break
    return com


def _levels_in_memory(adj: DataFrame, own: DataFrame, resolution: float, level: int, sweeps: int) -> DataFrame:
    """Rows (node, c): the communities of the nodes of `own` (node, loop, m2) after all levels from this one on, computed in the driver from files of numbers."""
    ids = sparse.numbered(own.select(F.col("node").alias("name")))
    files = sparse.graph_files(adj, ids)
    kinds = {"loop": "<f8", "m2": "<f8", "hash": "<i8"}
    each = own.join(ids.withColumnRenamed("name", "node"), "node").select("i", F.col("loop").cast("double").alias("loop"), F.col("m2").cast("double").alias("m2"), F.xxhash64("node").alias("hash"))
    files.write(kinds, sparse.stream(each.orderBy("i"), kinds))
    node, other, weight, loop, whole, mark = (files.get(c) for c in ("node", "other", "weight", *kinds))
    names = ids_left = np.arange(len(loop))
    while True:
        n = len(ids_left)
        com = _sweeps((node, other, weight), np.bincount(node, weight, n) + loop, whole, mark, resolution, level, sweeps)
        kept, new = np.unique(com, return_inverse=True)
        if len(kept) == n:
            break
        new = new.astype(np.int32)
        names, ids_left, m = new[names], ids_left[kept], len(kept)
        most = np.zeros(m)
        np.maximum.at(most, new, whole)
        u, v = new[node], new[other]
        inner = u == v
        loop = np.bincount(new, loop, m) + np.bincount(u[inner], weight[inner], m)
        key, at = np.unique(u[~inner].astype(np.int64) * m + v[~inner], return_inverse=True)
        weight = np.bincount(at, weight[~inner], len(key))
        node, other = (x.astype(np.int32) for x in np.divmod(key, m))
        whole, mark, level = most, mark[kept], level + 1
    texts = files.texts("name")
    found = pa.table({"node": texts.cast(pa.string()), "c": texts.take(pa.array(ids_left[names])).cast(pa.string())})
    return adj.sparkSession.createDataFrame(found)


def _level_by_joins(adj: DataFrame, strength: DataFrame, resolution: float, level: int, sweeps: int) -> DataFrame:
    """Rows (node, c): in a sweep every node of one half (by a bit of its hash) moves to the neighbouring community of the greatest gain, until none wants to."""
    com = strength.select("node", F.col("node").alias("c"))
    for sweep in range(sweeps):
        totals = com.join(strength, "node").groupBy("c").agg(F.sum("k").alias("tot"))
        links = adj.join(com.select(F.col("node").alias("other"), "c"), "other").groupBy("node", "c").agg(F.sum("weight").alias("w"))
        now = com.withColumnRenamed("c", "now").join(strength, "node")
        stay = now.select("node", F.col("now").alias("c"), F.lit(0.0).alias("w"))
        options = links.unionByName(stay).groupBy("node", "c").agg(F.sum("w").alias("w")).join(now, "node").join(totals, "c")
        rest = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * rest * F.col("k") / F.col("m2"), 9)
        best = options.groupBy("node").agg(F.min_by(F.struct("c", "now", "hash"), F.struct((-gain).alias("g"), (F.col("c") != F.col("now")).alias("moves"), "c")).alias("b"))
        turn = F.shiftright("b.hash", (level * sweeps + sweep) % 61).bitwiseAND(F.lit(1)) == 1
        moved = cut(best.select("node", F.when(turn, F.col("b.c")).otherwise(F.col("b.now")).alias("c"), (F.col("b.c") != F.col("b.now")).alias("wanted")))
        com = moved.select("node", "c")
        if moved.where("wanted").isEmpty():
            break
    return com


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, sweeps: int = 60, small: int = SMALL, parts: DataFrame | None = None) -> DataFrame:
    """Rows (name, community): Louvain with synchronous local moves, for graphs of any size.

    In a sweep every node of one half (which half, a hash and the sweep decide) may move to the neighbouring community of
    the greatest modularity gain, computed from the same state, until no node wants to move (or for `sweeps` sweeps).
    Communities are then merged into nodes and the sweeps repeat, until a level merges nothing. Ties go to the smaller
    community; nodes without edges stay alone. With `parts` (name, part) every part is a graph of its own: its modularity
    counts its own edges alone, and no edge may lead out of it. From the first level of up to `small` edges on, levels are
    computed in the driver, larger ones by joins, with the same result.
    """
    member = nodes.select("name", F.col("name").alias("community")).distinct()
    adj = cut(both_ways(edges.where("weight > 0 and u <> v")).groupBy("node", "other").agg(F.sum("weight").alias("weight")))
    if adj.isEmpty():
        return member
    own = adj.groupBy("node").agg(F.sum("weight").alias("w"))
    own = own.withColumn("part", F.lit(0)) if parts is None else own.join(parts.select(F.col("name").alias("node"), "part"), "node")
    own = own.join(own.groupBy("part").agg(F.sum("w").alias("m2")), "part").select("node", F.lit(0.0).alias("loop"), "m2")
    level = 0
    while True:
        if small and adj.count() <= 2 * small:
            com = _levels_in_memory(adj, own, resolution, level, sweeps).withColumnRenamed("node", "community")
            return cut(member.join(com, "community", "left").select("name", F.coalesce("c", "community").alias("community")))
        strength = cut(own.join(adj.groupBy("node").agg(F.sum("weight").alias("w")), "node", "left").select("node", (F.coalesce("w", F.lit(0.0)) + F.col("loop")).alias("k"), "m2", F.xxhash64("node").alias("hash")))
        com = _level_by_joins(adj, strength, resolution, level, sweeps)
        if com.where("node <> c").isEmpty():
            return member
        member = cut(member.join(com.withColumnRenamed("node", "community"), "community", "left").select("name", F.coalesce("c", "community").alias("community")))
        merged = adj.join(com.withColumnRenamed("c", "cu"), "node").join(com.select(F.col("node").alias("other"), F.col("c").alias("cv")), "other").groupBy("cu", "cv").agg(F.sum("weight").alias("weight"))
        loops = own.join(com, "node").groupBy("c").agg(F.sum("loop").alias("l0"), F.max("m2").alias("m2"))
        inner = merged.where("cu = cv").select(F.col("cu").alias("c"), "weight")
        own = cut(loops.join(inner, "c", "left").select(F.col("c").alias("node"), (F.col("l0") + F.coalesce("weight", F.lit(0.0))).alias("loop"), "m2"))
        adj = cut(merged.where("cu <> cv").select(F.col("cu").alias("node"), F.col("cv").alias("other"), "weight"))
        level += 1


def hierarchy(edges: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """Rows (level, community, parent, name): parts larger than `most` are split again within themselves, until a split gives one part."""
    level0 = communities(edges, nodes).select(F.lit(0).alias("level"), "community", F.lit(None).cast("string").alias("parent"), "name")
    out = current = cut(level0)
    level = 0
    while True:
        level += 1
        large = current.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("community")
        todo = cut(current.join(large, "community", "left_semi").select("community", "name"))
        if todo.isEmpty():
            return out
        inner = edges.join(todo.select(F.col("name").alias("u"), F.col("community").alias("cu")), "u").join(todo.select(F.col("name").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv").drop("cu", "cv")
        parts = communities(inner, todo.select("name"), parts=todo.select("name", F.col("community").alias("part"))).withColumnRenamed("community", "part")
        split = todo.join(parts, "name").withColumn("id", F.concat_ws("/", "community", "part"))
        several = split.groupBy("community").agg(F.count_distinct("part").alias("n")).where("n > 1").select("community")
        current = cut(split.join(several, "community", "left_semi").select(F.lit(level).alias("level"), F.col("id").alias("community"), F.col("community").alias("parent"), "name"))
        if current.isEmpty():
            return out
        out = out.unionByName(current)


class _Paths:
    """Cheapest paths from a growing tree in a graph of numbers (start, other, weight: the neighbours of each node in order)."""

    def __init__(self, start: np.ndarray, other: np.ndarray, weight: np.ndarray) -> None:
        self.start, self.other, self.weight = start, other, weight
        self.far = np.full(len(start) - 1, np.inf)
        self.tree: set[int] = set()

    def _near(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(self.start[n], self.start[n + 1])
        return self.other[rows], self.weight[rows]

    def grow(self, nodes: set[int], goals: set[int]) -> None:
        """Add nodes to the tree and lower the distances that this lowers. What is further than the furthest goal leads to none and is not followed."""
        self.tree |= nodes
        new = np.fromiter(nodes, np.int64, len(nodes))
        self.far[new] = 0.0
        wanted = np.fromiter(goals, np.int64, len(goals))
        front = np.sort(new)
        while len(front := front[self.far[front] <= self.far[wanted].max(initial=0.0)]):
            count = self.start[front + 1] - self.start[front]
            at = np.repeat(self.start[front] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            to, d = self.other[at], np.repeat(self.far[front], count) + self.weight[at]
            less = d < self.far[to]
            to, d = to[less], d[less]
            np.minimum.at(self.far, to, d)
            front = np.unique(to)

    def _level(self, n: int) -> dict[int, int | None]:
        """Where a search by (distance, name, name it came from) comes from to the nodes that edges of weight 0 join with n at its distance."""
        import heapq

        d, same, todo = self.far[n], {n}, [n]
        while todo:
            o, w = self._near(todo.pop())
            new = {int(x) for x in o[(w == 0) & (self.far[o] == d)]} - same
            same |= new
            todo.extend(new)
        heap = [(x, -1) for x in same & self.tree]
        for x in same - self.tree:
            o, w = self._near(x)
            heap += [(x, int(y)) for y in o[(self.far[o] + w == d) & (self.far[o] < d)]]
        heapq.heapify(heap)
        came: dict[int, int | None] = {}
        while heap:
            x, y = heapq.heappop(heap)
            if x in came:
                continue
            came[x] = y if y >= 0 else None
            o, w = self._near(x)
            for z in o[(w == 0) & (self.far[o] == d)]:
                if int(z) not in came:
                    heapq.heappush(heap, (int(z), x))
        return came

    def to(self, goal: int) -> list[int] | None:
        """The cheapest path from the tree to a goal; ties go to the order of names. None if there is none."""
        if not np.isfinite(self.far[goal]):
            return None
        way, at, known = [], goal, {}
        while at is not None:
            way.append(at)
            if at not in known:
                o, w = self._near(at)
                by = o[(self.far[o] + w == self.far[at]) & (self.far[o] < self.far[at])]
                flat = (w == 0) & (self.far[o] == self.far[at])
                known = self._level(at) if flat.any() else {at: None if at in self.tree else int(by.min())}
            at = known[at]
        return way[::-1]


def greedy_tree(graph: tuple[np.ndarray, np.ndarray, np.ndarray], worth: dict[int, float], edge_cost: float = 1.0, most_nodes: int = 20) -> tuple[list[int], list[tuple[int, int]]]:
    """(nodes, edges): from the most valuable prize on, the cheapest path to the prize of the greatest gain is added while one gains.

    graph (start, other, weight) in numbers. Gain: the prizes of the new nodes less edge_cost per edge. Then leaves worth
    less than an edge are pruned. Of equal prizes the last by name is the root; of equal gains the first by name is added.
    """
    start = graph[0]
    prize = {n: p for n, p in worth.items() if p > 0 and start[n + 1] > start[n]}
    if not prize:
        return [], []
    new, tree, kept, paths = {max(prize, key=lambda n: (prize[n], n))}, set(), set(), _Paths(*graph)
    while True:
        tree |= new
        goals = prize.keys() - tree
        if len(tree) >= most_nodes or not goals:
            break
        paths.grow(new, goals)
        offers = []
        for goal in goals:
            way = paths.to(goal)
            if way and len(tree) + len(way) - 1 <= most_nodes:
                offers.append((sum(prize.get(x, 0.0) for x in way[1:]) - edge_cost * (len(way) - 1), -goal, way))
        gain, _, way = max(offers, default=(0.0, 0, []))
        if gain <= 0:
            break
        new = set(way) - tree
        kept |= {(min(e), max(e)) for e in zip(way, way[1:])}
    poor = True
    while poor and len(tree) > 1:
        ends = [n for e in kept for n in e]
        poor = {n for n in tree if ends.count(n) == 1 and prize.get(n, 0.0) < edge_cost}
        tree -= poor
        kept = {e for e in kept if not poor & {*e}}
    return sorted(tree), sorted(kept)


def prize_subgraphs(edges: DataFrame, prizes: DataFrame, edge_cost: float = 1.0, most_nodes: int = 20) -> DataFrame:
    """Rows (query_id, nodes, edges) of a greedy prize-collecting tree for each query's prizes (query_id, name, prize).

    All edges are shipped to the executors as files of numbers, and tasks grow whole trees over them; a search goes no
    further than a query's furthest prize. Queries without a known prize have an empty tree. Edges of negative weight are
    not followed.
    """
    import pandas as pd

    spark = edges.sparkSession
    ids = sparse.numbered(both_ways(edges).select(F.col("node").alias("name")))
    adj = both_ways(edges.where("weight >= 0")).groupBy("node", "other").agg(F.min("weight").alias("weight"))
    files = sparse.graph_files(adj, ids).ship(spark)
    p = prizes.where("prize > 0").groupBy("query_id", "name").agg(F.max("prize").cast("double").alias("prize"))
    per = p.join(ids, "name", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "prize"))).alias("ps"))  # as many as a query has prizes
    alike = per.groupBy("ps").agg(F.collect_list(F.struct("query_id")).alias("ids"))  # queries of the same prizes have one tree

    def run(batches):
        names = files.texts("name")
        graph = (sparse.starts(files.get("node"), len(names)), files.get("other"), files.get("weight"))
        for b in batches:
            out = []
            for qs, ps in zip(b["ids"], b["ps"]):
                nodes, kept = greedy_tree(graph, {int(x["i"]): x["prize"] for x in ps if x["i"] is not None}, edge_cost, most_nodes)
                tree = [names[n].as_py() for n in nodes], [{"u": names[u].as_py(), "v": names[v].as_py()} for u, v in kept]
                out += [(q["query_id"], *tree) for q in qs]
            yield pd.DataFrame(out, columns=["query_id", "nodes", "edges"])

    return alike.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(run, f"query_id {dict(prizes.dtypes)['query_id']}, nodes array<string>, edges array<struct<u:string,v:string>>")


def collect_subgraph(edges: DataFrame, prizes: DataFrame, edge_cost: float = 1.0, most_nodes: int = 20) -> tuple[list[str], list[tuple[str, str]]]:
    """(nodes, edges) of one query's prizes (name, prize); see prize_subgraphs."""
    got = prize_subgraphs(edges, prizes.select(F.lit(0).alias("query_id"), "name", "prize"), edge_cost, most_nodes).first()
    return (list(got["nodes"]), [(e["u"], e["v"]) for e in got["edges"]]) if got else ([], [])
