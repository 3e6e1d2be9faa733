"""Predicates on facts and entities, as Columns that push down to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.temporal import overlaps


def fact_filter(
    networks: list[str] | None = None, fact_type: str | None = None, start: Column | None = None, end: Column | None = None,
    created_since: Column | None = None, unconsolidated: bool = False, any_entity: list[int] | None = None,
) -> Column:
    """The conjunction of what is asked for; facts without a time range pass a range filter."""
    out = F.lit(True)
    if networks is not None:
        out &= F.col("network").isin(*networks)
    if fact_type is not None:
        out &= F.col("fact_type") == fact_type
    if start is not None or end is not None:
        none = F.lit(None).cast("timestamp_ntz")
        out &= overlaps(F.col("temporal_start"), F.col("temporal_end"), none if start is None else start, none if end is None else end)
    if created_since is not None:
        out &= F.col("created_at") >= created_since
    if unconsolidated:
        out &= F.col("consolidated_at").isNull()
    if any_entity is not None:
        out &= F.arrays_overlap("entity_ids", F.array(*map(F.lit, any_entity)).cast("array<bigint>"))
    return out


def entity_facts(fact_entities: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """Facts that hold an entity, through the exploded bridge table."""
    return fact_entities.join(entity_ids, "entity_id", "left_semi")


def exact_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention and the one entity whose name or an alias of which it is, by case; the least id if there are several.

    entities has entity_id, name and aliases; both spellings become keys, so the match is an equi-join.
    """
    keys = entities.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("mention"))
    return mentions.select("mention").distinct().join(keys, "mention").groupBy("mention").agg(F.min("entity_id").alias("entity_id"))


def newest_first(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.desc("created_at"), F.desc("fact_id"))


def active_opinion() -> Column:
    return (F.col("network") == "opinion") & (F.coalesce("confidence", F.lit(0.0)) > 0)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1; planned as a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)
