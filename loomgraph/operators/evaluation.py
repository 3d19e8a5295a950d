"""Evaluation aggregates over attempts ``setting, article, question_id, is_correct, latency_ms``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import collapsed


def summary(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, correct ones, both accuracies (of attempts, and of questions ever answered rightly) and mean latency."""
    per_question = attempts.groupBy(*by, "question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("ok"), F.sum("latency_ms").alias("ms"))
    out = per_question.groupBy(*by).agg(
        F.sum("n").alias("attempts"), F.sum("ok").alias("correct"), F.count(F.lit(1)).alias("questions"), F.count_if(F.col("ok") > 0).alias("passed"), F.sum("ms").alias("ms")
    )
    share = lambda a, b: F.round(F.col(a) / F.col(b), 4)
    return out.select(*by, "attempts", "correct", "questions", "passed", share("correct", "attempts").alias("overall_accuracy"), share("passed", "questions").alias("pass_accuracy"), F.floor(F.col("ms") / F.col("attempts")).alias("avg_latency_ms"))


def weighted_stats(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Sum of weights and weighted mean of a value in each group."""
    return rows.groupBy(*by).agg(F.sum(weight).alias("weight"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def most_common(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the smaller) with its count and share."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(*by).agg(F.max_by(value, F.struct("n", F.transform(F.split(value, ""), lambda c: -F.ascii(c)).alias("t"))).alias(value), F.max("n").alias("votes"), F.sum("n").alias("of"))
    return out


def consensus(rows: DataFrame, by: str, answer: str, score: str, majority: float, quality: float) -> DataFrame:
    """Answers of each question by support: ``size``, best and mean score, ``rank``, and whether the first is ``accepted``."""
    key = F.lower(collapsed(F.col(answer)))
    g = rows.where(key != "").groupBy(by, key.alias("answer_key")).agg(F.count(F.lit(1)).alias("size"), F.max(score).alias("best"), F.round(F.avg(score), 9).alias("mean"))
    w = Window.partitionBy(by)
    ranked = g.withColumn("total", F.sum("size").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("size"), F.desc("best"), F.desc("mean"), "answer_key")).cast("bigint"))
    ok = (F.col("rank") == 1) & (F.col("size") > majority * F.col("total")) & (F.col("best") >= quality)
    return ranked.withColumn("accepted", ok)


def pattern_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
