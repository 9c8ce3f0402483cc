"""Documents into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X


def chunk_fixed(documents: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Rows (unit_id, doc_id, ord, text, n_tokens, start_char, end_char): overlapping windows of words, as raw slices.

    Null and blank texts have none. The last window ends with the text; a text of up to `size` words is one window.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than a window")
    stride = size - overlap
    words = documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"(?U)\s*\S+"), F.lit(0)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / F.lit(float(stride))).cast("int") - 1)
    # characters of each stride, summed once; what lies before a window is a sum over strides, not over words
    per = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice("w", k * stride + 1, F.lit(stride)), F.lit(0), lambda n, x: n + F.length(x)))
    cut = words.select("doc_id", "w", per.alias("per"), F.explode(F.sequence(F.lit(0), last)).alias("ord")).select(
        "doc_id", "ord", F.slice("w", F.col("ord") * stride + 1, F.lit(size)).alias("part"),
        F.aggregate(F.slice("per", F.lit(1), F.col("ord")), F.lit(0), lambda n, x: n + x).alias("before"),
    )
    raw = cut.select("doc_id", "ord", F.size("part").alias("n_words"), "before", F.array_join("part", "").alias("raw"))
    rows = raw.withColumn("text", F.regexp_replace("raw", r"(?U)^\s+", ""))
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias("unit_id"), "doc_id", "ord", "text",
        F.ceil(F.col("n_words") * 4 / F.lit(3.0)).cast("int").alias("n_tokens"),
        (F.col("before") + F.length("raw") - F.length("text")).alias("start_char"), (F.col("before") + F.length("raw")).alias("end_char"),
    )


_END = re.compile(r"[.!?]+(?=\s)|\n")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of sentences, leading white space included; stops after abbreviations cut nothing, blank spans are skipped."""
    spans, start = [], 0
    for m in _END.finditer(text):
        if m.group() != "\n" and text[start : m.end()].endswith(tuple(X.ABBREVIATIONS)):
            continue
        if text[start : m.end()].strip():
            spans.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        spans.append((start, len(text)))
    return spans


def pack_sentences(text: str, most: int, overlap: int) -> list[tuple[str, int, int, int]]:
    """Chunks (text, tokens, start, end) of whole sentences: as many as fit, an oversized one alone; the next starts `overlap` sentences back."""
    spans = sentence_spans(text)
    sizes = [-(-len(text[a:b].split()) * 4 // 3) for a, b in spans]
    out, i = [], 0
    while i < len(spans):
        j, total = i, 0
        while j < len(spans) and (j == i or total + sizes[j] <= most):
            total += sizes[j]
            j += 1
        lo, hi = spans[i][0], spans[j - 1][1]
        out.append((text[lo:hi].strip(), total, lo, hi))
        if j == len(spans):
            break
        i = max(i + 1, j - overlap)
    return out


def chunk_sentences(documents: DataFrame, most_tokens: int = 300, overlap: int = 1) -> DataFrame:
    """Rows like chunk_fixed's, of whole sentences; packing depends on what came before, hence a pandas step per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{d}-{k:03d}", d, k, *c) for d, t in zip(b["doc_id"], b["text"]) for k, c in enumerate(pack_sentences(t, most_tokens, overlap))]
            yield pd.DataFrame(rows, columns=["unit_id", "doc_id", "ord", "text", "n_tokens", "start_char", "end_char"])

    some = documents.select("doc_id", "text").where("text <> ''")
    return some.mapInPandas(run, "unit_id string, doc_id bigint, ord int, text string, n_tokens int, start_char int, end_char int")


def chunk_documents(documents: DataFrame, size: int = 300, overlap: int = 50, method: str = "fixed") -> DataFrame:
    """'fixed' windows of words, or 'sentences' of up to `size` tokens with one sentence of overlap."""
    if method == "fixed":
        return chunk_fixed(documents, size, overlap)
    if method == "sentences":
        return chunk_sentences(documents, size, 1)
    raise ValueError(f"unknown method {method!r}")
