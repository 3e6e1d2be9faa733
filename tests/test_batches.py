"""Many queries and many facts meet in blocks, with the rows of the channels that compare each pair."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import batches, recall

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(batches, "QUERIES", 7)
    monkeypatch.setattr(batches, "FACTS", 11)
    monkeypatch.setattr(batches, "STEP", 3)
    rng = random.Random(5)
    time = lambda: None if rng.random() < 0.3 else DAY + datetime.timedelta(hours=rng.randrange(2000))
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 2.0], [1.0, 2.0], [float("nan"), 0.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 0.0]]
    row = lambda i: (i, None if i == 5 else i % 3, odd[i - 10] if 10 <= i < 17 else vector(), time(), time())
    facts = spark.createDataFrame([row(i) for i in range(90)], "fact_id long, bank_id long, embedding array<double>, temporal_start timestamp_ntz, temporal_end timestamp_ntz")
    queries = spark.createDataFrame([(*row(i), DAY + datetime.timedelta(days=i)) for i in range(40)], "query_id long, bank_id long, embedding array<double>, from_ timestamp_ntz, to timestamp_ntz, now timestamp_ntz")
    return queries, facts


def test_nearest_of_many_queries_equal_all_pairs(spark, tables):
    queries, facts = tables
    got = recall._ranked(batches.nearest(queries, facts, 6).select("query_id", "fact_id", F.round("cosine", recall.DIGITS).alias("score")), "semantic", 6)
    want = recall.vector_topk(queries, facts, 6)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and want.count() > 200
    met = batches.nearest(queries, facts, 2).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert met <= 4 * 4 * 2 * 4  # a few of each block and length, not the bank


def test_first_times_of_many_queries_keep_their_ranks(spark, tables):
    queries, facts = tables
    whole = recall.temporal_channel(queries, facts).drop("source")
    others = spark.createDataFrame([(q, f) for q in range(40) for f in range(q % 5, 90, 17)], "query_id long, fact_id long")
    got = batches.temporal_first(queries, facts, others, 4, recall.DIGITS)
    want = whole.where("rank < 4").unionByName(whole.join(others, ["query_id", "fact_id"], "left_semi").select(*whole.columns)).distinct()
    rows = lambda df: sorted(map(tuple, df.select("query_id", "fact_id", "score", "rank").collect()))
    assert rows(got) == rows(want) and 100 < got.count() < whole.count()


def test_a_recall_of_many_queries_equals_that_of_few(spark, tables):
    queries, facts = tables
    facts = facts.where("bank_id is not null").withColumns({"content": F.concat(F.lit("word "), "fact_id"), "network": F.when(F.col("fact_id") % 4 == 0, "world").otherwise("observation")})
    queries = queries.where("bank_id is not null and embedding is not null").select("query_id", "bank_id", "embedding", F.col("from_").alias("anchor_start"), F.col("to").alias("anchor_end"), "now", F.lit("word").alias("text"))
    links = facts.select(F.col("fact_id").alias("source_id"), ((F.col("fact_id") + 3) % 90).alias("target_id"), F.lit("causal").alias("link_type"), F.lit(0.8).alias("weight"))
    words = lambda c: F.split(c, " ")
    config = recall.RecallConfig(channel_limit=3, max_facts=5, seeds=2, graph_limit=4)
    run = lambda many: sorted(map(str, recall.recall(queries, facts, links, recall.inverted_index(facts, words), words, config, ["observation"], many=many).collect()))
    assert run(True) == run(False) and len(run(True)) > 60
