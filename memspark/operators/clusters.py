"""Similarity clusters, and opinions that are merged, weakened or superseded in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import cut, similar


def similar_pairs(vectors: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """Pairs a < b of id at a cosine of the threshold or more, within a group where one is named."""
    return similar(vectors, vectors, threshold, by, ordered=True).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and cluster_id, the least id that edges (a, b) lead to, of each node.

    Each round a node takes the least label around it and then that label's own label; edges are few beside nodes, and
    rounds are checkpointed so that plans stay small.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct())
    label = both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    while True:  # labels only fall, so it ends
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("label").alias("near"))
        low = label.join(near, label.id == near.a).select("id", F.least("label", "near").alias("low"), "label")
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = cut(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")))
        label = new.select("id", "label")
        if new.where("moved").isEmpty():
            break
    return nodes.select("id").join(label, "id", "left").select("id", F.coalesce("label", "id").alias("cluster_id"))


def clusters(vectors: DataFrame, threshold: float = 0.85, by: str | None = None) -> DataFrame:
    """Single-linkage groups of vectors (id, embedding), each named by its least id."""
    return components(vectors.select("id"), similar_pairs(vectors, threshold, by))


def _whole(order: list[Column]) -> Window:
    return Window.partitionBy("cluster_id").orderBy(*order)


def merge_consistent(opinions: DataFrame) -> DataFrame:
    """Opinions (cluster_id, fact_id, confidence) after their cluster agrees: the strongest, the last of equals, gets the mean
    and 0.1 more, 1 at most; the others get 0. A missing confidence is 0 in the comparison and 0.5 in the mean."""
    level = F.coalesce("confidence", F.lit(0.0))
    first = F.row_number().over(_whole([level.desc(), F.desc("fact_id")]))
    mean = F.avg(F.coalesce("confidence", F.lit(0.5))).over(Window.partitionBy("cluster_id"))
    rows = opinions.select("*", first.alias("__first"), mean.alias("__mean"))
    return rows.select("cluster_id", "fact_id", (F.col("__first") == 1).alias("winner"), F.when(F.col("__first") == 1, F.least(F.lit(1.0), F.col("__mean") + 0.1)).otherwise(F.lit(0.0)).alias("new_confidence"))


def adjacent_distinct(ids: Column) -> Column:
    """An array without the elements that equal the one before."""
    return F.filter(ids, lambda x, i: (i == 0) | (x != F.element_at(ids, F.greatest(i, F.lit(1)).cast("int"))))


def merged_evidence(opinions: DataFrame) -> DataFrame:
    """cluster_id and evidence_ids: those of its opinions one after another, without immediate repeats."""
    lists = opinions.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "evidence_ids"))).alias("all"))
    return lists.select("cluster_id", adjacent_distinct(F.flatten(F.expr("transform(all, x -> x.evidence_ids)"))).alias("evidence_ids"))


def weaken_contradictory(opinions: DataFrame, factor: float = 0.7) -> DataFrame:
    """The weakest opinion of each cluster, the first of equals, with its confidence lowered; a missing one counts as 0 there and as 0.5 here."""
    level = F.coalesce("confidence", F.lit(0.0))
    first = F.row_number().over(_whole([level.asc(), F.asc("fact_id")]))
    return opinions.select("*", first.alias("__first")).where("__first = 1").select("cluster_id", "fact_id", (F.coalesce("confidence", F.lit(0.5)) * factor).alias("new_confidence"))


def weaken_superseded(opinions: DataFrame, verdicts: DataFrame, factor: float = 0.7) -> DataFrame:
    """The opinion at each cluster's superseded index, which is held within the cluster, with its confidence lowered. verdicts: cluster_id, superseded_index."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))
    rows = opinions.select("*", (F.row_number().over(_whole([F.asc("fact_id")])) - 1).alias("__at"), n.alias("__n")).join(verdicts, "cluster_id")
    return rows.where(F.col("__at") == F.least(F.coalesce("superseded_index", F.lit(0)), F.col("__n") - 1)).select("cluster_id", "fact_id", (F.coalesce("confidence", F.lit(0.5)) * factor).alias("new_confidence"))


def reinforced(confidence: Column, delta: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5)) + delta)


def weakened(confidence: Column, delta: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.5)) - delta)


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def formed(opinions: DataFrame) -> DataFrame:
    """Facts of new opinions (fact_id, bank_id, content, evidence_ids, confidence): experience, of the opinion network, with confidence held between 0 and 1."""
    return opinions.select("fact_id", "bank_id", "content", F.lit("experience").alias("fact_type"), F.lit("opinion").alias("network"), F.coalesce("evidence_ids", F.array().cast("array<bigint>")).alias("evidence_ids"), clamped(F.col("confidence")).alias("confidence"))


def moved(opinions: DataFrame, steps: DataFrame) -> DataFrame:
    """fact_id, confidence and evidence_ids of opinions after steps (fact_id, delta, evidence_ids): a positive delta reinforces, a negative one weakens; the evidence of either is added at the end."""
    both = opinions.select("fact_id", "confidence", F.col("evidence_ids").alias("__own")).join(steps, "fact_id")
    level = F.when(F.col("delta") >= 0, reinforced(F.col("confidence"), F.col("delta"))).otherwise(weakened(F.col("confidence"), -F.col("delta")))
    return both.select("fact_id", level.alias("confidence"), F.concat(F.coalesce("__own", F.array().cast("array<bigint>")), "evidence_ids").alias("evidence_ids"))


def opinions_for(queries: DataFrame, facts: DataFrame, k: int = 20) -> DataFrame:
    """The opinions among the k nearest facts of any network: ranked first, filtered after."""
    from .recall import vector_topk

    return vector_topk(queries, facts, k).join(facts.where("network = 'opinion'").select("fact_id"), "fact_id", "left_semi")
