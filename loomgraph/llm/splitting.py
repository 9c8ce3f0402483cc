"""Splitting oversized items at natural boundaries.

The words of an item give a prefix sum of tokens (four thirds of a token per word) and sorted arrays of the word
positions after which a paragraph, line, sentence or clause ends. Each piece starts at a word; a binary search in the
prefix sums gives the last word that still fits, and one in each boundary array the last boundary before it, strongest
first. Without a boundary in the second half of the window the cut is hard. The next piece steps back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'»”’)\]*_]*$")
CLAUSE_END = re.compile(r"[,;:、，；：–—][\"'»”’)\]*_]*$")
ABBREVIATIONS = {"dr.", "mr.", "mrs.", "ms.", "prof.", "capt.", "st.", "no.", "vs.", "e.g.", "i.e.", "fig.", "inc.", "ltd.", "co."}


def word_tokens(n_words: int) -> int:
    """Four thirds of the number of words, rounded up."""
    return -(-n_words * 4 // 3)


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For paragraph, line, sentence and clause: the sorted numbers of words after which one ends."""
    found: list[list[int]] = [[], [], [], []]
    for k in range(len(starts) - 1):
        gap = text[ends[k] : starts[k + 1]]
        word = text[starts[k] : ends[k]]
        lines = len(gap.splitlines()) - 1 + gap.endswith(("\n", "\r"))
        if lines >= 2:
            found[0].append(k + 1)
        if lines >= 1:
            found[1].append(k + 1)
        if SENTENCE_END.search(word) and word.lower() not in ABBREVIATIONS and not (len(word) == 2 and word[0].isupper()):
            found[2].append(k + 1)
        elif CLAUSE_END.search(word):
            found[3].append(k + 1)
    return [np.asarray(x, dtype=np.int64) for x in found]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (first word, word after the last, start, end) with start and end as code point offsets; [] if the text fits.

    Every piece but the first begins with the last `overlap` words of the one before.
    """
    spans = np.asarray([m.span() for m in WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    n = len(spans)
    if word_tokens(n) <= limit:
        return []
    thirds = np.arange(n + 1, dtype=np.int64) * 4  # prefix sums in thirds of a token
    starts, ends = spans[:, 0], spans[:, 1]
    marks = boundaries(text, starts, ends)
    out, i = [], 0
    while True:
        j = int(np.searchsorted(thirds, thirds[i] + 3 * limit, side="right")) - 1
        if j >= n:
            out.append((i, n, int(starts[i]), int(ends[n - 1])))
            return out
        least = i + max(overlap, (j - i) // 2) + 1
        for m in marks:
            k = int(np.searchsorted(m, j, side="right")) - 1
            if k >= 0 and m[k] >= least:
                j = int(m[k])
                break
        out.append((i, j, int(starts[i]), int(ends[j - 1])))
        i = j - overlap


def split_oversized(units: DataFrame, limit: int = 400, overlap: int = 30) -> DataFrame:
    """Pieces (unit_id, doc_id, piece, id, text, n_tokens, at_from, at_to) of every unit of more than `limit` tokens.

    `units` has id, doc_id and text; other columns are ignored. at_from and at_to are code point offsets into the unit.
    Null, empty and fitting texts give no piece; repeated rows give their pieces once; a word longer than the limit is
    one word and stays whole. Units are cut whole, whatever their length.
    """
    if not 0 <= overlap < limit * 3 // 4:
        raise ValueError("the overlap must be smaller than a piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for unit, doc, text in zip(b["id"], b["doc_id"], b["text"]):
                for k, (i, j, lo, hi) in enumerate(cut_points(text, limit, overlap)):
                    rows.append((unit, doc, k, f"{unit}/{k:03d}", text[lo:hi], word_tokens(j - i), lo, hi))
            yield pd.DataFrame(rows, columns=["unit_id", "doc_id", "piece", "id", "text", "n_tokens", "at_from", "at_to"])

    fits = limit * 3 // 4  # a text of more words has at least two code points for each
    words = F.regexp_count("text", F.lit(r"(?U)[^\s\x1c-\x1f]+"))
    long = units.select("id", F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("id").isNotNull() & (F.length("text") > 2 * fits) & (words > fits)).distinct()
    return long.mapInPandas(run, "unit_id string, doc_id bigint, piece int, id string, text string, n_tokens int, at_from int, at_to int")


def in_document(pieces: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """Pieces (id, unit_id, doc_id, piece, text, n_tokens, start_char, end_char) with offsets into the document.

    Where a unit's start_char is null, it is found by looking its text up in the document (first occurrence); the
    offsets stay null where the document is missing or does not hold the text.
    """
    u = units.select(F.col("id").alias("unit_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "start_char", F.col("text").alias("unit_text")).distinct()
    need = u.join(pieces.select("unit_id", "doc_id").distinct(), ["unit_id", "doc_id"], "left_semi")
    lost = need.where("start_char is null").join(documents.select("doc_id", F.col("text").alias("doc_text")), "doc_id", "left")
    found = lost.select("unit_id", "doc_id", F.expr("nullif(instr(doc_text, unit_text), 0) - 1").alias("base"))
    base = need.where("start_char is not null").select("unit_id", "doc_id", F.col("start_char").alias("base")).unionByName(found)
    base = base.groupBy("unit_id", "doc_id").agg(F.min("base").alias("base"))
    return pieces.join(base, ["unit_id", "doc_id"], "left").select(
        "id", "unit_id", "doc_id", "piece", "text", "n_tokens", (F.col("base") + F.col("at_from")).cast("int").alias("start_char"), (F.col("base") + F.col("at_to")).cast("int").alias("end_char")
    )
