"""Recall: four ranked channels, rank fusion, reranking and the token budget, for many queries over many banks at once.

Every channel gives (query_id, fact_id, score, rank, source) with rank from 0. Queries and facts meet by an equi-join on
their bank; Catalyst broadcasts the queries when they are small and shuffles by bank when they aren't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.temporal import overlaps, parse_phrase, proximity
from memspark.functions.text import token_estimate
from memspark.functions.vector import cosine, norm
from memspark.schemas import RecallConfig

from . import batches
from .filters import top
from .ordinals import numbered
from .pairs import cut

#: Decimals that scores keep before they are ranked: near ties are told apart, and the last bits of a sum, which depend on its order, are not.
DIGITS = 10


def _ranked(scored: DataFrame, source: str, k: int | None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    out = scored.select("query_id", "fact_id", "score", (F.row_number().over(order) - 1).cast("long").alias("rank"), F.lit(source).alias("source"))
    return out if k is None else out.where(F.col("rank") < k)


def vector_topk(queries: DataFrame, facts: DataFrame, k: int = 40, networks: list[str] | None = None, source: str = "semantic") -> DataFrame:
    """The k facts of a query's bank nearest by cosine. The network filter comes before ranking; norms are computed once a row."""
    f = facts.where(F.col("embedding").isNotNull())
    if networks is not None:
        f = f.where(F.col("network").isin(*networks))
    f = f.select("bank_id", "fact_id", F.col("embedding").alias("fv"), norm(F.col("embedding")).alias("fn"))
    q = queries.select("query_id", "bank_id", F.col("embedding").alias("qv"), norm(F.col("embedding")).alias("qn"))
    scored = q.join(f, "bank_id").select("query_id", "fact_id", F.round(cosine(F.col("qv"), F.col("fv"), F.col("qn"), F.col("fn")), DIGITS).alias("score"))
    return _ranked(scored, source, k)


def inverted_index(facts: DataFrame, lexemes: Callable[[Column], Column]) -> DataFrame:
    """bank_id, term, fact_id, tf: write it once, partitioned by bank, and every keyword query is an equi-join."""
    return facts.select("bank_id", "fact_id", F.explode(lexemes(F.col("content"))).alias("term")).groupBy("bank_id", "term", "fact_id").agg(F.count(F.lit(1)).alias("tf"))


#: Of a query's rarest terms, how many a fact is held to before all of them are looked at.
FEW = 4


def _holders(queries: DataFrame, index: DataFrame, terms: Column, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(asked, held): query_id and key of the queries, and key, wanted, fact_id, term and columns of the index for each term of each fact that may hold all the terms of a key.

    Queries of one bank and the same terms are one key. A fact that holds all terms holds the rarest, so only facts with that one are
    looked at, then those with a few of the rarest, then the others: a frequent word beside a rarer one costs no more than that. A key with a term that no fact holds has no rows.
    """
    rows = queries.where("bank_id is not null").select("query_id", "bank_id", F.array_sort(F.array_distinct(terms)).alias("terms")).where("size(terms) > 0")
    rows = cut(rows.withColumn("key", F.sha2(F.concat_ws("\u0000", F.col("bank_id").cast("string"), "terms"), 256)))
    each = rows.dropDuplicates(["key"]).select("key", "bank_id", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))
    sizes = index.groupBy("bank_id", "term").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(sizes, ["bank_id", "term"]).groupBy("key").agg(F.first("bank_id").alias("bank_id"), F.first("wanted").alias("wanted"), F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"))
    rare = cut(rare.where(F.size("t") == F.col("wanted")).select("key", "bank_id", "wanted", F.expr("transform(t, x -> x.term)").alias("t")))
    own = index.select("bank_id", "term", "fact_id", *columns)
    first = rare.select("key", "bank_id", "wanted", F.col("t")[0].alias("term")).join(own, ["bank_id", "term"])
    single, several = first.where("wanted = 1"), first.where("wanted > 1").select("key", "fact_id")
    few = several.join(rare.select("key", "bank_id", F.least(F.col("wanted"), F.lit(FEW)).alias("n"), F.slice("t", 2, FEW - 1).alias("t")), "key").select("key", "bank_id", "fact_id", "n", F.explode("t").alias("term"))
    few = few.join(index.select("bank_id", "term", "fact_id"), ["bank_id", "term", "fact_id"]).groupBy("key", "fact_id").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n")).where("met = n - 1")
    all_ = few.select("key", "fact_id").join(rare, "key").select("key", "bank_id", "wanted", "fact_id", F.explode("t").alias("term")).join(own, ["bank_id", "term", "fact_id"])
    at = ["key", "wanted", "fact_id", "term", *columns]
    return rows.select("query_id", "key"), single.select(*at).unionByName(all_.select(*at))


def _for_queries(scored: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """The ranks of keys (key, fact_id, score) for all queries that asked them."""
    ranked = _ranked(scored.withColumnRenamed("key", "query_id"), "keyword", k).withColumnRenamed("query_id", "key")
    return asked.join(ranked, "key").select("query_id", "fact_id", "score", "rank", "source")


def keyword_topk(queries: DataFrame, index: DataFrame, lexemes: Callable[[Column], Column], k: int = 40) -> DataFrame:
    """Facts that hold every lexeme of the query, by how often they hold them. A query without lexemes matches nothing."""
    asked, held = _holders(queries, index, lexemes(F.col("text")), "tf")
    hits = held.groupBy("key", "fact_id").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"), F.sum("tf").cast("double").alias("score"))
    return _for_queries(hits.where(F.col("n") == F.col("wanted")), asked, k)


# Fixed values of the text search that ranks are taken from: the weight of a plain word, positions kept of a lexeme and the last one told
# apart, the distance from which words don't add, the rank of what has no pair of positions, and the sum of 1 / n^2.
WEIGHT, POSITIONS, LAST, FAR, NO_PAIR, SUM = 0.1, 255, 16383, 100, 1e-20, 1.64493406685


def positional_index(facts: DataFrame, lexemes: Callable[[Column], Column]) -> DataFrame:
    """bank_id, term, fact_id and positions of every lexeme of every fact; lexemes gives terms in order, and an empty one for a place that counts but isn't found."""
    rows = facts.select("bank_id", "fact_id", F.posexplode(lexemes(F.col("content"))).alias("at", "term")).where("term <> ''")
    found = rows.groupBy("bank_id", "term", "fact_id").agg(F.array_sort(F.collect_set(F.least(F.col("at") + 1, F.lit(LAST)))).alias("positions"))
    return found.withColumn("positions", F.slice("positions", 1, POSITIONS))


def write_index(index: DataFrame, path: str) -> None:
    """Stores an index with a folder a bank, sorted by term, so that a query reads its banks and skips other terms; banks that are there already are replaced, others left alone."""
    index.repartition("bank_id").sortWithinPartitions("bank_id", "term", "fact_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bank_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, fact_id long, positions array<int>, bank_id long").parquet(path).select("bank_id", "term", "fact_id", "positions")


def _nearness(found: Column) -> Column:
    """The rank of a fact's positions of all the lexemes asked for (an array for each): of one by how often it is there, of several by how near pairs of them are."""
    one = F.aggregate(F.transform(found[0], lambda _, i: WEIGHT / ((i + 1) * (i + 1)).cast("double")), F.lit(0.0), lambda s, x: s + x) / SUM
    apart = lambda p, q: F.when(F.abs(p - q) > FAR, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(F.abs(p - q) / 1.5 - 2)))
    missed = lambda p, q: F.when(p == q, F.lit(1.0)).otherwise(1 - WEIGHT * F.sqrt(apart(p, q)))
    both = lambda miss, a, b: F.aggregate(a, miss, lambda m, p: F.aggregate(b, m, lambda n, q: n * missed(p, q)))
    # each lexeme with all before it: what none of their pairs of positions adds
    none = F.aggregate(
        F.sequence(F.lit(2), F.size(found)), F.lit(1.0),
        lambda miss, i: F.aggregate(F.slice(found, F.lit(1), i - 1), miss, lambda m, before: both(m, F.element_at(found, i), before)),
    )
    pairs = F.size(F.array_distinct(F.flatten(found))) > 1
    return F.when(F.size(found) == 1, one).when(pairs, 1 - none).otherwise(F.lit(NO_PAIR))


def keyword_ranked(queries: DataFrame, index: DataFrame, lexemes: Callable[[Column], Column], k: int | None = 40) -> DataFrame:
    """Facts that hold every lexeme of the query (query_id, bank_id, text), ranked as an English text search ranks them: by the
    positions of its lexemes. index is a positional index. A query without lexemes matches nothing.

    Queries meet the index by an equi-join on (bank, term) of their rarest terms, and only facts that hold all terms get their positions for the rank.
    """
    asked, held = _holders(queries, index, F.filter(lexemes(F.col("text")), lambda w: w != ""), "positions")
    one = held.where("wanted = 1").select("key", "fact_id", F.array("positions").alias("found"))
    hits = held.where("wanted > 1").groupBy("key", "fact_id").agg(F.array_sort(F.collect_list(F.struct("term", "positions"))).alias("found"), F.first("wanted").alias("wanted"))
    whole = hits.where(F.size("found") == F.col("wanted")).select("key", "fact_id", F.expr("transform(found, x -> x.positions)").alias("found"))
    return _for_queries(one.unionByName(whole).withColumn("score", F.round(_nearness(F.col("found")), DIGITS)), asked, k)


def temporal_channel(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """All facts of the bank that overlap a query's range (from_, to), by proximity of middles; queries have a now of their own.

    Facts without a range overlap anything. Queries whose range is null on both sides ask for nothing. A query's facts may be a whole bank,
    so they are numbered by ranges of scores, never in one task.
    """
    q = queries.where(F.col("from_").isNotNull() | F.col("to").isNotNull()).select("query_id", "bank_id", "from_", "to", "now")
    f = facts.select("bank_id", "fact_id", "temporal_start", "temporal_end")
    hit = q.join(f, "bank_id").where(overlaps(F.col("temporal_start"), F.col("temporal_end"), F.col("from_"), F.col("to")))
    score = F.round(proximity(F.col("temporal_start"), F.col("temporal_end"), F.col("from_"), F.col("to"), F.col("now")), DIGITS)
    placed = numbered(hit.select("query_id", "fact_id", score.alias("score")), ["query_id"], [F.desc("score"), F.col("fact_id")], "rank")
    return placed.select("query_id", "fact_id", "score", "rank", F.lit("temporal").alias("source"))


def with_ranges(queries: DataFrame) -> DataFrame:
    """queries with from_ and to: their anchor where they have one, else what their text speaks of."""
    start, end = parse_phrase(F.col("text"), F.col("now"))
    if "anchor_start" in queries.columns:
        anchored = F.col("anchor_start").isNotNull() | F.col("anchor_end").isNotNull()
        start, end = F.when(anchored, F.col("anchor_start")).otherwise(start), F.when(anchored, F.col("anchor_end")).otherwise(end)
    return queries.withColumns({"from_": start, "to": end})


def with_inherited_ranges(searches: DataFrame, questions: DataFrame) -> DataFrame:
    """searches (query_id, text, now) of questions (query_id, text, now) with anchor_start and anchor_end: the time that a search speaks of, else
    the one that its question speaks of, else none."""
    own, asked = parse_phrase(F.col("text"), F.col("now")), questions.select("query_id", F.struct(*[c.alias(n) for c, n in zip(parse_phrase(F.col("text"), F.col("now")), ("start", "end"))]).alias("__asked"))
    speaks = own[0].isNotNull() | own[1].isNotNull()
    both = searches.join(asked, "query_id", "left")
    return both.withColumns({"anchor_start": F.when(speaks, own[0]).otherwise(F.col("__asked.start")), "anchor_end": F.when(speaks, own[1]).otherwise(F.col("__asked.end"))}).drop("__asked")


def undirected(links: DataFrame, link_type: str | None = None) -> DataFrame:
    """node, neighbor, link_type, weight in both directions."""
    own = links if link_type is None else links.where(F.col("link_type") == link_type)
    ahead = own.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), "link_type", "weight")
    return ahead.unionAll(own.select("target_id", "source_id", "link_type", "weight"))


def activation(seeds: DataFrame, links: DataFrame, config: RecallConfig = RecallConfig()) -> DataFrame:
    """query_id, fact_id, score: spreading activation from seeds (query_id, fact_id, score, rank).

    A node spreads once, with the activation of its first arrival in breadth-first order, and scores the largest that
    arrives; neighbors come by weight, type and id. A level is one join of the frontier with the edges, whatever
    the number of queries and nodes, and a node's order is kept as the path of orders that leads to it, so no level
    sorts its frontier.
    """
    edges = undirected(links)
    frontier = cut(seeds).select("query_id", F.col("fact_id").alias("node"), F.col("score").alias("act"), F.array(F.struct(F.lit(0.0).alias("w"), F.lit("").alias("t"), F.col("rank").alias("n"))).alias("path"))
    seen, arrived = frontier.select("query_id", "node"), frontier.select("query_id", "node", "act")
    for hop in range(config.hops):
        boost = F.when(F.col("link_type") == "causal", config.causal_boost).otherwise(1.0)
        step = F.struct((-F.col("weight")).alias("w"), F.col("link_type").alias("t"), F.col("neighbor").alias("n"))
        reach = frontier.join(edges, "node").select("query_id", F.col("neighbor").alias("node"), (F.col("act") * F.col("weight") * boost * config.decay).alias("act"), F.concat("path", F.array(step)).alias("path"))
        reach = cut(reach.where(F.col("act") >= config.threshold))  # three uses each level: without the cut a level would be computed 3 ** hops times
        arrived = arrived.unionAll(reach.select("query_id", "node", "act"))
        if hop + 1 < config.hops:
            first = reach.groupBy("query_id", "node").agg(F.min(F.struct("path", "act")).alias("best"))
            frontier = first.join(seen, ["query_id", "node"], "left_anti").select("query_id", "node", "best.act", "best.path")
            seen = seen.unionAll(frontier.select("query_id", "node"))
    return arrived.groupBy("query_id", "node").agg(F.max("act").alias("score")).withColumnRenamed("node", "fact_id")


def graph_channel(queries: DataFrame, facts: DataFrame, links: DataFrame, config: RecallConfig = RecallConfig(), networks: list[str] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Activation from the nearest facts, which seeds has where they are known; the network filter holds for seeds only."""
    if seeds is None:
        seeds = vector_topk(queries, facts, config.seeds, networks)
    scored = activation(seeds, links, config).join(facts.select("fact_id"), "fact_id", "left_semi")
    return _ranked(scored.withColumn("score", F.round("score", DIGITS)), "graph", config.graph_limit)


def fuse(ranked: DataFrame, k: float = 60.0) -> DataFrame:
    """query_id, fact_id, score, rank, sources: the sum of 1 / (k + rank) over channels, ties by id; sources in channel order."""
    order = F.expr("array_position(array('semantic', 'keyword', 'graph', 'temporal'), source)")
    sums = ranked.groupBy("query_id", "fact_id").agg(
        F.round(F.sum(1 / (k + F.col("rank"))), DIGITS).alias("score"), F.array_sort(F.collect_set(F.struct(order.alias("o"), "source"))).alias("found")
    )
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    return sums.select("query_id", "fact_id", "score", (F.row_number().over(over) - 1).cast("long").alias("rank"), F.expr("transform(found, x -> x.source)").alias("sources"))


def rerank(fused: DataFrame, score: Column | None = None, drop_missing: bool = False) -> DataFrame:
    """fused in the order of another score, ties by the order before; null scores go last, or go. Without a score it is as it was."""
    if score is None:
        return fused
    out = fused.withColumn("score", score)
    if drop_missing:
        out = out.where(F.col("score").isNotNull())
    over = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    return out.withColumn("rank", (F.row_number().over(over) - 1).cast("long"))


def reverse(fused: DataFrame) -> DataFrame:
    return rerank(fused, F.col("rank").cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lexical_overlap(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder's score: the part of the query's words that the text holds, as a logit, through a sigmoid."""
    q = F.array_distinct(F.split(F.lower(query), r"\s+"))
    share = F.size(F.array_intersect(q, F.split(F.lower(text), r"\s+"))) / F.greatest(F.size(q), F.lit(1))
    return sigmoid(8 * share - 4)


def within_budget(ranked: DataFrame, max_facts: int, budget: int) -> DataFrame:
    """Rows of each query, up to max_facts, until the first whose tokens would exceed the budget; adds used, the tokens so far."""
    rows = ranked.where(F.col("rank") < max_facts)
    over = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum("tokens").over(over)).where(F.col("used") <= budget)


def recall(
    queries: DataFrame, facts: DataFrame, links: DataFrame, index: DataFrame, lexemes: Callable[[Column], Column],
    config: RecallConfig = RecallConfig(), networks: list[str] | None = None, score: Column | None = None, many: bool = False,
) -> DataFrame:
    """query_id, fact_id, score, rank, sources, tokens, used of each query. queries has query_id, bank_id, text, embedding and now.

    A time range is a bias, not a filter: channels other than the temporal one don't look at it. score may speak of
    text and content. many is for queries whose number grows with that of the facts: they meet in blocks (see batches.py), with the same rows.
    """
    scoped = facts if networks is None else facts.where(F.col("network").isin(*networks))
    k = max(config.channel_limit, config.seeds)
    if many:
        queries, scoped = cut(queries), cut(scoped.select("fact_id", "bank_id", "embedding", "temporal_start", "temporal_end"))
        near = batches.nearest(queries, scoped, k).select("query_id", "fact_id", F.round("cosine", DIGITS).alias("score"))
    hits = cut(_ranked(near, "semantic", k) if many else vector_topk(queries, scoped, k))  # the nearest are seeds too
    seeds, hits = hits.where(F.col("rank") < config.seeds), hits.where(F.col("rank") < config.channel_limit)
    words = (keyword_ranked if "positions" in index.columns else keyword_topk)(queries, index, lexemes, config.channel_limit)
    if networks is not None:
        words = words.join(scoped.select("fact_id"), "fact_id", "left_semi").select(*hits.columns)
        words = _ranked(words, "keyword", None)
    channels = hits.unionByName(words).unionByName(graph_channel(queries, facts, links, config, networks, seeds))
    if many and score is None and config.rrf_k + config.max_facts < 10 ** (DIGITS / 2):
        # what only the temporal channel finds comes in its order, so of these the first max_facts are enough; of the others' facts the ranks count
        channels = cut(channels)
        timed = batches.temporal_first(with_ranges(queries), scoped, channels, config.max_facts, DIGITS).withColumn("source", F.lit("temporal"))
    else:
        timed = temporal_channel(with_ranges(queries), scoped)
    channels = channels.unionByName(timed)
    fused = fuse(channels, config.rrf_k)
    fused = fused.join(facts.select("fact_id", "content"), "fact_id").join(queries.select("query_id", "text"), "query_id")
    out = rerank(fused, score).withColumn("tokens", token_estimate(F.col("content"))).drop("content", "text")
    return within_budget(out, config.max_facts, config.token_budget)


def first_seen(found: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Of several results that return a fact, the first in the given order."""
    return top(found, [group, "fact_id"], [F.col(c) for c in order], 1).drop("rank")
