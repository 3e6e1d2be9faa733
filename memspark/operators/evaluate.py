"""Scores of answers, reports over them, and comparisons and merges of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import numbered


def report(results: DataFrame) -> DataFrame:
    """Count, correct, accuracy and mean F1, and mean evidence recall where results have it: overall, by category and by conversation, in one aggregation over grouping sets."""
    grouped = results.groupingSets([[], [F.col("category")], [F.col("conversation")]], F.col("category"), F.col("conversation"))
    means = [F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("mean_f1")]
    if "evidence_recall" in results.columns:
        means.append(F.round(F.avg(F.coalesce("evidence_recall", F.lit(0.0))), 6).alias("mean_evidence_recall"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"), *means)


def ordered(results: DataFrame) -> DataFrame:
    """results with place, from 0, in the order of reports: conversation, category, question."""
    return numbered(results, [], [F.col("conversation"), F.col("category"), F.col("question_id")], "place")


def scorable(category: Column, answer: Column) -> Column:
    return category.between(1, 4) & answer.isNotNull()


def is_abstention(question_id: Column) -> Column:
    return question_id.contains("_abs")


def bank_stats(facts: DataFrame, fact_entities: DataFrame) -> DataFrame:
    """Counts by network and of entities, of each bank."""
    counts = [F.count_if(F.col("network") == n).alias(f"n_{n}") for n in ("world", "experience", "observation", "opinion")]
    entities = fact_entities.groupBy("bank_id").agg(F.countDistinct("entity_id").alias("n_entities"))
    return facts.groupBy("bank_id").agg(F.count(F.lit(1)).alias("n_facts"), *counts).join(entities, "bank_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and errors of each stage, and the time that its calls took where calls have it."""
    sums = [F.count(F.lit(1)).alias("calls"), F.round(F.sum("tokens"), 2).alias("tokens"), F.sum("error").alias("errors")]
    return calls.groupBy("stage").agg(*sums, *([F.sum("latency_ms").alias("latency_ms")] if "latency_ms" in calls.columns else []))


def merged_usage(usages: list[DataFrame]) -> DataFrame:
    """The usage of several runs as that of one: sums of what usage gives, by stage."""
    both = reduce(DataFrame.unionByName, usages)
    return both.groupBy("stage").agg(*[F.sum(c).alias(c) if c != "tokens" else F.round(F.sum(c), 2).alias(c) for c in both.columns if c != "stage"])


def total(rows: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """The field-wise sum of breakdowns or phase times, of all rows or of each group."""
    return rows.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields])


def compare_matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """By category, over questions that both runs have: correct counts, and how many improved, regressed or stayed."""
    both = a.select("question_id", "category", F.col("correct").alias("ca")).join(b.select("question_id", F.col("correct").alias("cb")), "question_id")
    return both.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ca").alias("correct_a"), F.sum("cb").alias("correct_b"), F.count_if(F.col("cb") > F.col("ca")).alias("improved"),
        F.count_if(F.col("cb") < F.col("ca")).alias("regressed"), F.count_if(F.col("cb") == F.col("ca")).alias("unchanged"),
    )


def compare_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every question of the first run with the second's mark, or a dash."""
    mark = F.when(F.col("cb").isNull(), "-").when(F.col("cb") == 1, "yes").otherwise("no")
    both = a.select("question_id", "correct").join(b.select("question_id", F.col("correct").alias("cb")), "question_id", "left")
    return both.select("question_id", "correct", mark.alias("other"))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Disjoint runs as one; raises if two runs share a question or differ in columns."""
    if len({tuple(r.columns) for r in runs}) > 1:
        raise ValueError("runs have different columns")
    both = reduce(DataFrame.unionByName, runs)
    if not both.groupBy("question_id").count().where("count > 1").isEmpty():
        raise ValueError("runs share questions")
    return both
