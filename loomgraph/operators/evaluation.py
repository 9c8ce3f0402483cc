"""Measures of answers, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X

CRITERIA = ["comprehensiveness", "diversity", "empowerment", "directness"]


def exact_match(prediction: Column, gold: Column) -> Column:
    return (X.normalize_answer(prediction) == X.normalize_answer(gold)).cast("double")


def answer_words(c: Column) -> Column:
    """The words of a normalised answer, in order; compute it as a column before token_f1, so that it isn't repeated per word."""
    return F.filter(F.array_sort(F.split(X.normalize_answer(c), " ")), lambda w: w != "")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of two word lists (answer_words) as multisets; 0 if either has none."""
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(prediction), F.lit(0), lambda n, w: n + F.least(count(prediction, w), count(gold, w)))
    return F.when(common > 0, 2.0 * common / (F.size(prediction) + F.size(gold))).otherwise(0.0)


def context_recall(retrieved: Column, supporting: Column) -> Column:
    """Share of the distinct supporting documents that were retrieved; 1 if there are none."""
    s = F.array_distinct(F.coalesce(supporting, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(s, F.coalesce(retrieved, F.array().cast("array<string>"))))
    return F.when(F.size(s) == 0, 1.0).otherwise(hit.cast("double") / F.size(s))


def scored_answers(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Rows (id, type, system, exact_match, token_f1, context_recall) of results with the question they answer."""
    q = questions.select(F.col("id").alias("question_id"), "type", F.coalesce("answer", F.lit("")).alias("gold"), "supporting_docs").dropDuplicates(["question_id"])
    r = results.select("id", "question_id", F.col("method").alias("system"), F.coalesce("answer", F.lit("")).alias("answer"), "sources").dropDuplicates(["id"])
    q = q.withColumn("gold_words", answer_words(F.col("gold")))
    words = r.withColumn("words", answer_words(F.col("answer"))).join(q, "question_id")
    return words.select(
        "id", "type", "system", exact_match(F.col("answer"), F.col("gold")).alias("exact_match"), token_f1(F.col("words"), F.col("gold_words")).alias("token_f1"),
        context_recall(F.col("sources"), F.col("supporting_docs")).alias("context_recall"),
    )


def summarize(scored: DataFrame) -> DataFrame:
    """Means per system, overall ('all') and per question type."""
    means = [F.round(F.avg(m), 3).alias(m) for m in ("exact_match", "token_f1", "context_recall")]
    g = scored.groupingSets([["system"], ["system", "type"]], "system", "type").agg(F.grouping("type").alias("g"), F.count(F.lit(1)).alias("n"), *means)
    return g.select("system", F.when(F.col("g") == 1, "all").otherwise(F.col("type")).alias("group"), "n", "exact_match", "token_f1", "context_recall")


def report_lines(summary: DataFrame) -> DataFrame:
    return summary.select("system", "group", F.format_string("%-10s %-11s %3d %6.2f %6.2f %10.2f", "system", "group", "n", "exact_match", "token_f1", "context_recall").alias("line"))


def measure(criterion: str, c: Column) -> Column:
    """How good an answer is by a rule: distinct words, sentences, citations, brevity."""
    if criterion == "comprehensiveness":
        return F.size(F.array_distinct(X.analyze(c)))
    if criterion == "diversity":
        return F.size(X.sentences(c))
    if criterion == "empowerment":
        return F.size(F.split(c, r"\[Data:")) - 1
    if criterion == "directness":
        return -X.count_words(c)
    return F.length(c)


def judged_pairs(answers: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (question_id, criterion, winner) of two systems' answers (question_id, system, answer).

    Both orders are asked, and a winner must win both; by the rules here the orders always agree.
    """
    one = answers.where(F.col("system") == a).groupBy("question_id").agg(F.min("answer").alias("x"))
    two = answers.where(F.col("system") == b).groupBy("question_id").agg(F.min("answer").alias("y"))
    p = one.join(two, "question_id")

    def verdict(c: str) -> Column:
        x, y = measure(c, F.col("x")), measure(c, F.col("y"))
        first = F.when(x > y, "A").when(y > x, "B").otherwise("TIE")
        second = F.when(y > x, "A").when(x > y, "B").otherwise("TIE")
        flipped = F.when(second == "A", "B").when(second == "B", "A").otherwise("TIE")
        return F.struct(F.lit(c).alias("criterion"), F.when(first == flipped, first).otherwise("TIE").alias("winner"))

    return p.select("question_id", F.explode(F.array(*map(verdict, CRITERIA))).alias("v")).select("question_id", "v.criterion", "v.winner")


def win_table(judged: DataFrame) -> DataFrame:
    return judged.groupBy("criterion").pivot("winner", ["A", "B", "TIE"]).agg(F.count(F.lit(1))).fillna(0)
