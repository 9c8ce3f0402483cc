"""Vectors and words: exact cosine search, hashed embeddings, BM25."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import sparse
from loomgraph.operators.ranking import best_of
from loomgraph.session import cut

#: Queries whose vectors are shipped to the executors at once.
QUERY_BLOCK = 2048


def append_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (id, embedding) with new rows; vectors of another length are an error when the rows are read."""
    width = store.select(F.size("embedding").alias("n")).limit(1)
    same = new.crossJoin(F.broadcast(width)).select("id", F.when(F.size("embedding") == F.col("n"), F.col("embedding")).otherwise(F.raise_error(F.lit("vectors of another length"))).alias("embedding"))
    return store.select("id", "embedding").unionByName(same)


def unit(c: Column) -> Column:
    """An array scaled to length one; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, id, score, rank): the k vectors of the greatest cosine for each query, ties to the smaller id.

    queries (query_id, embedding), vectors (id, embedding). Null vectors are left out, zero vectors score 0. The queries
    go to the executors in blocks of QUERY_BLOCK; each Arrow batch of vectors keeps its own best k before the shuffle.
    """
    q = queries.where("embedding is not null").select("query_id", "embedding")
    # rows of one block at a time: a block is bounded, the number of blocks is not
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    q = cut(q) if blocks > 1 else q
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        ids = [r["query_id"] for r in part]
        m = np.asarray([r["embedding"] for r in part], dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        got = _scan(vectors, ids, m, k, dict(queries.dtypes)["query_id"])
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = _scan(vectors.limit(0), [], np.zeros((0, 1)), k, dict(queries.dtypes)["query_id"])
    return best_of(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def _scan(vectors: DataFrame, ids: list, m: np.ndarray, k: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.vstack(b["embedding"].to_numpy()).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            s = np.round(m @ v.T, 6) + 0.0
            key = b["id"].to_numpy()
            order = np.argsort(key, kind="stable")
            s = s[:, order]
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"query_id": np.repeat(np.array(ids, object), top.shape[1]), "id": key[order][top.ravel()], "score": np.take_along_axis(s, top, 1).ravel()})

    return vectors.where("embedding is not null").select("id", "embedding").mapInPandas(run, f"query_id {kind}, id {dict(vectors.dtypes)['id']}, score double")


def hashed_terms(df: DataFrame, id_col: str, text: str, dim: int = 512) -> DataFrame:
    """Rows (id, bucket, value): signed counts of analyzed words by their MD5, scaled to length one; null where all counts are 0. JVM-side."""
    t = df.select(F.col(id_col).alias("id"), F.explode(X.analyze(F.col(text))).alias("term"))
    h = F.md5("term")
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dim))
    sign = F.when(F.substring(h, 9, 1) < "8", 1.0).otherwise(-1.0)
    c = t.groupBy("id", bucket.alias("bucket")).agg(F.sum(sign).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return c.select("id", "bucket", F.when(norm > 0, F.col("v") / norm).alias("value"))


def hashed_top_k(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, score, rank): for each query the k documents of the greatest sum over shared buckets, rounded to 6 digits, ties to the smaller id.

    queries and documents (id, bucket, value) as `hashed_terms` gives them.
    """
    ours = queries.where("value is not null").select(F.col("id").alias("query_id"), F.col("bucket").alias("term"), F.col("value").alias("w"))
    return inverted_top_k(documents.where("value is not null").select(F.col("bucket").alias("term"), "id", "value"), ours, k)


def inverted_top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, score, rank): the k documents of the greatest sum of w * value over shared terms, rounded to 6 digits, ties to the smaller id.

    index (term, id, value), queries (query_id, term, w). Documents that share no term with a query have no score. The
    rows of the queries' terms are shipped to the executors as files of numbers, and a task ranks whole questions over
    them: a task holds a sum per document, and nothing that grows as questions times documents is shuffled.
    """
    spark, kind = index.sparkSession, dict(index.dtypes)["id"]
    terms = sparse.numbered(queries.select(F.col("term").alias("name"))).select(F.col("name").alias("term"), F.col("i").alias("t"))
    used = cut(index.join(terms, "term").select("t", "id", "value"))
    ids = sparse.numbered(used.select(F.col("id").alias("name")))
    files = sparse.Files()
    kinds = {"term": "<i4", "doc": "<i4", "value": "<f8"}
    rows = used.join(ids.withColumnRenamed("name", "id"), "id").select(F.col("t").alias("term"), F.col("i").alias("doc"), F.col("value").cast("double").alias("value"))
    files.write(kinds, sparse.stream(rows.orderBy("term", "doc"), kinds))
    files.write({"id_size": "<i4", "id_bytes": "u1"}, sparse.stream(ids.orderBy("i").select(F.col("name").cast("string").alias("id")), {}, ("id",)))
    files = files.ship(spark)
    per = cut(queries.join(terms, "term").groupBy("query_id").agg(F.collect_list("t").alias("ts"), F.collect_list(F.col("w").cast("double")).alias("ws")))  # as many as a query has terms
    tasks = min(4 * spark.sparkContext.defaultParallelism, max(1, -(-per.count() // 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, term, doc, value = files.texts("id"), files.get("term"), files.get("doc"), files.get("value")
        start = sparse.starts(term, int(term[-1]) + 1 if len(term) else 0)
        total, met = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for b in batches:
            out: list = []
            for r, (ts, ws) in enumerate(zip(b.column("ts").to_pylist(), b.column("ws").to_pylist())):
                for t, w in zip(ts, ws):
                    if t + 1 < len(start):
                        at = doc[start[t] : start[t + 1]]
                        total[at] += w * value[start[t] : start[t + 1]]
                        met[at] = True
                found = np.flatnonzero(met)
                s = total[found]
                total[found], met[found] = 0.0, False
                s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s) + 0.0
                if len(found) > k:
                    near = s >= np.partition(s, -k)[-k]
                    found, s = found[near], s[near]
                best = np.argsort(-s, kind="stable")[:k]
                out.append((np.full(len(best), r), found[best], s[best], np.arange(1, len(best) + 1)))
            which, at, s, rank = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(which)), texts.take(pa.array(at)).cast(pa.string()), pa.array(s, pa.float64()), pa.array(rank, pa.int32())], ["query_id", "id", "score", "rank"])

    got = per.repartition(tasks).mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, id string, score double, rank int")
    return got.select("query_id", F.col("id").cast(kind).alias("id"), "score", "rank")


def blake_vector(words: list[str], dim: int = 512) -> np.ndarray:
    """Signed word counts by BLAKE2b, scaled to length one; a text without words is zero."""
    v = np.zeros(dim, dtype=np.float32)
    for w in words:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += -1.0 if h >> 63 else 1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def hashing_embedder(df: DataFrame, id_col: str, text: str, dim: int = 512) -> DataFrame:
    """Rows (id, embedding array<float>); words are analyzed in the JVM, hashed in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": [blake_vector(list(w), dim).tolist() for w in b["words"]]})

    words = df.select(F.col(id_col).alias("id"), F.coalesce(X.analyze(F.col(text)), F.array().cast("array<string>")).alias("words"))
    return words.mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, embedding array<float>")


def get_embedder(spec: str):
    """'hashing[:dim]' gives a function (df, id, text) -> (id, embedding); others need a model that is not installed."""
    name, _, arg = spec.partition(":")
    if name == "hashing":
        return lambda df, id_col, text: hashing_embedder(df, id_col, text, int(arg or 512))
    if name in ("openai", "st"):
        raise ModuleNotFoundError(f"the embedder {name!r} needs a package and a model that are not installed")
    raise ValueError(f"unknown embedder {spec!r}")


def postings(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (id, term, tf, dl): the inverted index, with each document's length."""
    t = documents.select(F.col(id_col).alias("id"), X.analyze(F.col(text)).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return t.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def bm25(index: DataFrame, n_docs: int, avg_len: float, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (query_id, id, score, rank): the k best documents of each query (query_id, text), each distinct word counted once.

    The index is first cut to the queries' words; documents without any have no score; ties go to the smaller id.
    """
    q = cut(queries.select("query_id", F.explode(F.array_distinct(X.analyze(F.col("text")))).alias("term")))
    used = cut(index.join(q.select("term").distinct(), "term", "left_semi"))
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (avg_len or 1.0)))
    return inverted_top_k(used.join(df, "term").select("term", "id", (idf * tf).alias("value")), q.withColumn("w", F.lit(1.0)), k)


def corpus_stats(documents: DataFrame, text: str) -> tuple[int, float]:
    """Number of documents and their mean length in words."""
    n, avg = documents.select(F.coalesce(F.size(X.analyze(F.col(text))), F.lit(0)).alias("dl")).agg(F.count(F.lit(1)), F.avg("dl")).first()
    return int(n), float(avg or 0.0)
