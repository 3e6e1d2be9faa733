"""What callers get to see of results: the columns of a recall, an opinion and an answer, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_view(found: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, place and id, content, score, network, range, source_turn_id and retrieval_sources of each recalled fact, with the total_tokens of its query."""
    totals = found.groupBy("query_id").agg(F.sum("tokens").alias("total_tokens"))
    shown = facts.select("fact_id", "content", "network", "temporal_start", "temporal_end", "source_turn_id")
    return found.join(shown, "fact_id").join(totals, "query_id").select(
        "query_id", F.col("rank").alias("place"), F.col("fact_id").alias("id"), "content", "score", "network", "temporal_start", "temporal_end", "source_turn_id", F.col("sources").alias("retrieval_sources"), "total_tokens"
    )


def opinion_view(opinions: DataFrame) -> DataFrame:
    """id, content, confidence and evidence_ids."""
    return opinions.select(F.col("fact_id").alias("id"), "content", "confidence", "evidence_ids")


def reflect_view(answers: DataFrame) -> DataFrame:
    """query_id, response, sources, new_opinions and confidence."""
    return answers.select("query_id", "response", "sources", "new_opinions", "confidence")
