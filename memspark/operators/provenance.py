"""Where facts come from: sources, evidence, conversation turns, and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import top
from .pairs import cut


def sources_of(facts: DataFrame, fact_sources: DataFrame, sources: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """fact_id, source_id, rank: the first sources of each fact; the rank limit is applied before rows are gathered."""
    own = fact_sources.join(facts.select("fact_id"), "fact_id", "left_semi").join(sources, "source_id")
    return top(own, ["fact_id"], [F.col(c) for c in order], limit).select("fact_id", "source_id", "rank")


def grouped_sources(ranked: DataFrame) -> DataFrame:
    """fact_id and its source ids in order; facts without sources are left out."""
    lists = ranked.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("x"))
    return lists.select("fact_id", F.expr("transform(x, s -> s.source_id)").alias("source_ids"))


def evidence_closure(evidence: DataFrame) -> DataFrame:
    """fact_id and every fact that its evidence leads to; rounds double the reach, so few are needed."""
    reach = cut(evidence.select("fact_id", "evidence_id").distinct())
    n = reach.count()
    while True:  # reach only grows, and not beyond all pairs of facts
        step = reach.select(F.col("fact_id").alias("evidence_id"), F.col("evidence_id").alias("next"))
        reach = cut(reach.unionAll(reach.join(step, "evidence_id").select("fact_id", F.col("next").alias("evidence_id"))).distinct())
        if (more := reach.count()) == n:
            break
        n = more
    return reach


def closure_from(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """fact_id and evidence_id of all that the evidence of the facts asked for leads to. A round follows only what the one before reached
    first, so work and rounds are those of the facts asked for, whatever the table of evidence holds; cycles end."""
    links = evidence.select("fact_id", "evidence_id").where("fact_id is not null and evidence_id is not null").distinct()
    frontier = cut(asked.select("fact_id").distinct().join(links, "fact_id"))
    reach = [frontier]
    while not frontier.isEmpty():
        step = frontier.select(F.col("fact_id").alias("asked"), F.col("evidence_id").alias("fact_id")).join(links, "fact_id").select(F.col("asked").alias("fact_id"), "evidence_id").distinct()
        frontier = cut(step.join(reduce(DataFrame.unionAll, reach), ["fact_id", "evidence_id"], "left_anti"))
        reach.append(frontier)
    return reduce(DataFrame.unionAll, reach)


def support(asked: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """fact_id and turns: the sorted source turns of each fact asked for and of all its evidence. facts: fact_id, source_turn_id."""
    asked = asked.select("fact_id").distinct()
    closure = closure_from(asked, evidence).unionAll(asked.select("fact_id", F.col("fact_id").alias("evidence_id")))
    turns = closure.join(facts.select(F.col("fact_id").alias("evidence_id"), "source_turn_id"), "evidence_id").where("source_turn_id is not null")
    found = turns.groupBy("fact_id").agg(F.array_sort(F.collect_set("source_turn_id")).alias("turns"))
    return asked.join(found, "fact_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast(found.schema["turns"].dataType)))


#: What an answer's confidence is said to be.
CONFIDENCE = 0.85


def finalized(done: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, response, sources, confidence and new_opinions of each call of done (query_id, response, source_ids): the ids that it cites, in its
    order, without those that no call retrieved (query_id, fact_id)."""
    cited = done.select("query_id", F.posexplode("source_ids").alias("at", "fact_id")).join(retrieved.select("query_id", "fact_id").distinct(), ["query_id", "fact_id"], "left_semi")
    kept = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "fact_id"))).alias("x")).select("query_id", F.expr("transform(x, c -> c.fact_id)").alias("sources"))
    none = F.array().cast(done.schema["source_ids"].dataType)
    return done.select("query_id", "response").join(kept, "query_id", "left").select("query_id", "response", F.coalesce("sources", none).alias("sources"), F.lit(CONFIDENCE).alias("confidence"), F.array().cast("array<string>").alias("new_opinions"))


def valid_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    return cited.join(retrieved.select("fact_id"), "fact_id", "left_semi")


def lookup(keys: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each row's list of keys as the values that a dictionary has for them, in order, without misses. keys: id and an array."""
    rows = keys.select("id", F.posexplode(key).alias("at", "key"))
    hits = rows.join(table.select(F.col(order).alias("key"), F.col(value).alias("value")), "key")
    return hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x")).select("id", F.expr("transform(x, v -> v.value)").alias("values"))


def formatted_sessions(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as lines of role and text."""
    line = F.concat("role", F.lit(": "), F.col("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x")).select("conv_id", F.expr("concat_ws('\\n', transform(x, t -> t.line))").alias("session"))


def preceding_turns(turns: DataFrame) -> DataFrame:
    """Each turn with the texts of all before it in its session, a line each."""
    over = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("text").over(over), "\n").alias("preceding"))


def rounds(turns: DataFrame) -> DataFrame:
    """Each turn with its round: a round ends with the last assistant turn of a run, or with the session."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ends = (F.col("role") == "assistant") & (F.coalesce(F.lead("role").over(order), F.lit("")) != "assistant")
    marked = turns.withColumn("__ends", ends.cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("round", F.coalesce(F.sum("__ends").over(before), F.lit(0)).cast("long")).drop("__ends")


def conversation_totals(turns: DataFrame) -> DataFrame:
    """conv_id, n_sessions (the largest number of a session), n_rounds, n_turns and the latest minute of each conversation (conv_id, session, turn, role, minute)."""
    per = rounds(turns).groupBy("conv_id").agg(F.max("session").alias("n_sessions"), (F.max("round") + 1).alias("n_rounds"), F.count(F.lit(1)).alias("n_turns"), F.max("minute").alias("latest"))
    return per.select("conv_id", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), "n_rounds", "n_turns", "latest")


def unique_across(results: list[DataFrame]) -> DataFrame:
    """Facts of several tool calls, each with the first call that returned it."""
    calls = [r.select("fact_id", F.lit(i).alias("call")) for i, r in enumerate(results)]
    return reduce(DataFrame.unionByName, calls).groupBy("fact_id").agg(F.min("call").alias("call"))
