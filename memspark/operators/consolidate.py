"""Consolidation: batches of facts become observations, round by round.

A bank's batches follow one another, since a batch sees the observations that those before it made or changed. Banks don't look at each
other, so a round takes one batch of every bank at once. What changes between rounds is the observations only: facts are
read a batch at a time, and that they are consolidated is known beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import occurred, truncated
from memspark.schemas import RecallConfig

from . import recall
from .pairs import _importable, cut, discard
from .resolve import consecutive_batches

#: What a batch's recall may spend on observations, a fact.
BUDGET = 512
#: Batches of a bank that are gone through at once where it is known beforehand how they are decided.
SPAN = 1024
#: Shapes of an action, and of an observation on its way.
ACTIONS = "bank_id bigint, place int, action string, content string, fact_indices array<int>, observation_index int, observation_id bigint"
OBSERVATION = ("fact_id", "bank_id", "content", "entity_ids", "evidence_ids", "temporal_start", "temporal_end", "made", "changed")


def placed_batches(facts: DataFrame, size: int = 8) -> DataFrame:
    """Unconsolidated world and experience facts with batch and place, from 0, newest first within a bank."""
    newest = Window.partitionBy("bank_id", "batch").orderBy(F.desc("created_at"), F.desc("fact_id"))
    return consecutive_batches(facts, size).withColumn("place", (F.row_number().over(newest) - 1).cast("int"))


def related_observations(batches: DataFrame, facts: DataFrame, graph: DataFrame, index: DataFrame, lexemes: Callable[[Column], Column], config: RecallConfig = RecallConfig(token_budget=BUDGET)) -> DataFrame:
    """bank_id, batch, observation_index (from 0) and fact_id of what is related to each batch (bank_id, batch, place, fact_id, content, embedding, range, now).

    Every fact of every batch is a query of one recall over all banks: its own text and vector, its own range as the anchor, observations
    only, and a budget of its own. A batch has what any of its facts finds, in the order of facts and of their ranks, once each.
    """
    queries = batches.select(F.col("fact_id").alias("query_id"), "bank_id", F.col("content").alias("text"), "embedding", "now", F.col("temporal_start").alias("anchor_start"), F.col("temporal_end").alias("anchor_end"))
    found = recall.recall(queries, facts, graph, index, lexemes, config, ["observation"], many=True)
    rows = found.select("query_id", "fact_id", "rank").join(batches.select(F.col("fact_id").alias("query_id"), "bank_id", "batch", "place"), "query_id")
    first = rows.groupBy("bank_id", "batch", "fact_id").agg(F.min(F.struct("place", "rank")).alias("at"))
    order = Window.partitionBy("bank_id", "batch").orderBy("at", "fact_id")  # as many rows as a batch's facts find
    return first.select("bank_id", "batch", (F.row_number().over(order) - 1).cast("int").alias("observation_index"), "fact_id")


def prompts(batches: DataFrame, related: DataFrame, observations: DataFrame, template: str) -> DataFrame:
    """bank_id, batch and prompt: the template with {facts} and {observations} filled in, a numbered line each with its range, or (none)."""
    line = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce("content", F.lit("")), occurred(F.col("temporal_start"), F.col("temporal_end")))

    def block(rows: DataFrame, at: str, name: str) -> DataFrame:
        lists = rows.select("bank_id", "batch", F.struct(F.col(at).alias("at"), line(F.col(at)).alias("line")).alias("x")).groupBy("bank_id", "batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
        return lists.select("bank_id", "batch", F.expr("concat_ws('\\n', transform(x, r -> r.line))").alias(name))

    own = related.join(observations.select("fact_id", "content", "temporal_start", "temporal_end"), "fact_id")
    both = block(batches, "place", "facts").join(block(own, "observation_index", "observations"), ["bank_id", "batch"], "left")
    filled = F.replace(F.replace(F.lit(template), F.lit("{facts}"), F.col("facts")), F.lit("{observations}"), F.coalesce("observations", F.lit("(none)")))
    return both.select("bank_id", "batch", filled.alias("prompt"))


def _union(lists: str) -> str:
    """SQL of the elements of a list of lists, each where it is first."""
    return f"array_distinct(flatten({lists}))"


def applied(batch: DataFrame, related: DataFrame, observations: DataFrame, actions: DataFrame, new_id: Column, round_: int) -> tuple[DataFrame, DataFrame]:
    """(observations after the actions, what they made and changed): batch has bank_id, place, fact_id, entity_ids and range of its facts.

    An action takes its evidence from the facts at its indices, in their order and without those that aren't there. An update's target is
    the related observation at its index, else the one that its id names among them; without a target it creates. It starts from
    the observation as the batch found it, so of several updates of one the last holds. Ranges widen to those of the evidence.
    """
    source = batch.select("bank_id", F.col("place").alias("i"), "fact_id", "entity_ids", "temporal_start", "temporal_end")
    asked = actions.select("bank_id", F.col("place").alias("turn"), F.posexplode_outer("fact_indices").alias("at", "i"))
    met = asked.join(source, ["bank_id", "i"], "left").where("fact_id is not null")
    gathered = met.groupBy("bank_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("at", "fact_id", "entity_ids"))).alias("x"), F.min("temporal_start").alias("low"), F.max("temporal_end").alias("high")
    )
    gathered = gathered.select("bank_id", "turn", F.expr("transform(x, r -> r.fact_id)").alias("new_evidence"), F.expr(_union("transform(x, r -> coalesce(r.entity_ids, array()))")).alias("new_entities"), "low", "high")
    none = F.array().cast("array<bigint>")
    known = related.select("bank_id", "observation_index", F.col("fact_id").alias("by_index"))
    named = related.select("bank_id", F.col("fact_id").alias("observation_id"), F.col("fact_id").alias("by_id"))
    each = actions.withColumnRenamed("place", "turn").join(gathered, ["bank_id", "turn"], "left").join(known, ["bank_id", "observation_index"], "left").join(named, ["bank_id", "observation_id"], "left")
    each = each.withColumns({
        "target": F.when(F.col("action") == "update", F.coalesce("by_index", "by_id")), "new_evidence": F.coalesce("new_evidence", none), "new_entities": F.coalesce("new_entities", none),
    })
    each = cut(each.select("bank_id", "turn", "content", "target", "new_evidence", "new_entities", "low", "high"))
    made = each.where("target is null").select(
        new_id.alias("fact_id"), "bank_id", "content", F.col("new_entities").alias("entity_ids"), F.col("new_evidence").alias("evidence_ids"), F.col("low").alias("temporal_start"), F.col("high").alias("temporal_end"),
        F.lit(round_).alias("made"), F.lit(round_).alias("changed"),
    )
    last = each.where("target is not null").groupBy(F.col("target").alias("fact_id")).agg(F.max_by(F.struct(F.col("content").alias("said"), "new_evidence", "new_entities", "low", "high"), "turn").alias("u"))
    own = observations.join(last, "fact_id", "left")
    widened = own.select(
        "fact_id", "bank_id", F.when(F.col("u").isNull(), F.col("content")).otherwise(F.col("u.said")).alias("content"),
        F.when(F.col("u").isNull(), F.col("entity_ids")).otherwise(F.array_union("entity_ids", "u.new_entities")).alias("entity_ids"),
        F.when(F.col("u").isNull(), F.col("evidence_ids")).otherwise(F.array_union("evidence_ids", "u.new_evidence")).alias("evidence_ids"),
        F.least("temporal_start", "u.low").alias("temporal_start"), F.greatest("temporal_end", "u.high").alias("temporal_end"), "made", F.when(F.col("u").isNull(), F.col("changed")).otherwise(F.lit(round_)).alias("changed"),
    )
    report = each.groupBy("bank_id").agg(F.count_if(F.col("target").isNull()).alias("created"), F.count_if(F.col("target").isNotNull()).alias("updated")).withColumn("batch", F.lit(round_))
    return cut(widened.unionByName(made)), report


def observation_id(round_: int | Column) -> Column:
    return F.xxhash64("bank_id", F.lit("observation"), F.lit(round_).cast("int"), "turn")


def _begun(facts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(batches, observations) before the first round."""
    none = F.array().cast("array<bigint>")
    batches = cut(placed_batches(facts.withColumn("entity_ids", F.coalesce("entity_ids", none)), size).repartitionByRange("batch", "bank_id").sortWithinPartitions("batch"))
    now = facts.where("network = 'observation'").select("fact_id", "bank_id", "content", F.coalesce("entity_ids", none).alias("entity_ids"), F.coalesce("evidence_ids", none).alias("evidence_ids"), "temporal_start", "temporal_end", F.lit(-1).alias("made"), F.lit(-1).alias("changed"))
    return batches, cut(now)


def consolidate(
    facts: DataFrame, related: Callable[[DataFrame, DataFrame], DataFrame], decide: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    size: int = 8, new_id: Callable[[int], Column] = observation_id,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, marked, progress): all observations as consolidation leaves them, with the rounds that made and last changed them (-1: none did); fact_id of the facts
    that it consolidated, whether an action names them or not; and for each bank and batch its facts and what was created and updated.

    related gives bank_id, observation_index and fact_id of what a round's batches (one a bank) see of the observations so far, decide the
    actions on it (see ACTIONS), as a model does. Facts need fact_id, bank_id, network, content, entity_ids, evidence_ids, range, created_at and
    consolidated_at. A null list is empty; an observation's confidence and source don't change. There are as many rounds as the bank with the
    most batches has; a round reads its own batches and the observations.
    """
    batches, now = _begun(facts, size)
    last = batches.agg(F.max("batch")).first()[0]
    reports = []
    for round_ in range(-1 if last is None else int(last) + 1):
        own = batches.where(F.col("batch") == round_)
        seen = cut(related(own, now))
        before, (now, report) = now, applied(own, seen, now, decide(own, seen, now), new_id(round_), round_)
        reports.append(cut(report))
        discard(before, seen)
    sizes = batches.groupBy("bank_id", "batch").agg(F.count(F.lit(1)).alias("facts"))
    done = batches.sparkSession.createDataFrame([], "bank_id bigint, batch bigint, created bigint, updated bigint")
    for r in reports:
        done = done.unionByName(r.select("bank_id", F.col("batch").cast("long").alias("batch"), "created", "updated"))
    progress = sizes.join(done, ["bank_id", "batch"], "left").select("bank_id", "batch", "facts", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("updated", F.lit(0)).alias("updated"))
    return now.select(*OBSERVATION), batches.select("fact_id"), progress


def by_shared_entity(batch: DataFrame, observations: DataFrame) -> DataFrame:
    """An offline way to see what is related, in place of a recall: of the observations of a bank that share an entity with the batch, the least by id."""
    wanted = batch.select("bank_id", F.explode("entity_ids").alias("e")).distinct()
    hits = observations.select("bank_id", "fact_id", F.explode("entity_ids").alias("e")).join(wanted, ["bank_id", "e"], "left_semi").select("bank_id", "fact_id").distinct()
    return hits.groupBy("bank_id").agg(F.lit(0).alias("observation_index"), F.min("fact_id").alias("fact_id"))


def one_action(batch: DataFrame, related: DataFrame, observations: DataFrame) -> DataFrame:
    """The offline decision: one action a batch with all its facts and the starts of their texts; it updates the first related observation, and creates one where there is none."""
    said = batch.groupBy("bank_id").agg(F.array_sort(F.collect_list(F.struct("place", truncated(F.col("content"), 40).alias("said")))).alias("x"))
    some = related.where("observation_index = 0").select("bank_id", F.lit(True).alias("any"))
    rows = said.join(some, "bank_id", "left")
    return rows.select(
        "bank_id", F.lit(0).alias("place"), F.when(F.col("any"), "update").otherwise("create").alias("action"), F.expr("concat_ws('; ', transform(x, r -> r.said))").alias("content"),
        F.expr("transform(x, r -> r.place)").alias("fact_indices"), F.lit(0).alias("observation_index"), F.lit(None).cast("long").alias("observation_id"),
    )


def _walked(key: tuple[pa.Scalar, ...], batches: pa.Table, state: pa.Table) -> pa.Table:
    """One span of a bank: the target of each batch (none where it creates), and the least observation of each entity afterwards."""
    least = {e: v for e, v in zip(state.column("e").to_pylist(), state.column("least").to_pylist()) if v is not None}
    rows = []
    for batch, made, entities in zip(*(batches.sort_by("batch").column(c).to_pylist() for c in ("batch", "made", "entities"))):
        target = min((least[e] for e in entities if e in least), default=None)
        least.update(dict.fromkeys(entities, made if target is None else target))
        rows.append((batch, target, None, None))
    rows += [(None, None, e, least.get(e)) for e in state.column("e").to_pylist()]
    columns = zip(*rows) if rows else ((),) * 4
    bank, span = (pa.array([k.as_py()] * len(rows), pa.int64()) for k in key)
    return pa.table({"bank_id": bank, "span": span} | {n: pa.array(c, pa.int64()) for n, c in zip(("batch", "target", "e", "least"), columns)})


def entity_targets(batches: DataFrame, observations: DataFrame, made: Column) -> DataFrame:
    """bank_id, batch and target: the observation that each batch with an entity updates, null where it creates the one of the id made, as rounds of by_shared_entity and one_action find them.

    What a batch sees is the least observation of each of its entities, and all of its entities have its own target afterwards. So a bank is gone
    through in spans of batches, all at once: each begins with what those before it have left, as known so far. A span is right once
    the one before it is, so there are at most as many turns as spans of a bank; they end when no beginning changes, mostly after two or three.
    """
    _importable(batches.sparkSession)
    known = observations.select("bank_id", F.explode("entity_ids").alias("e"), "fact_id").groupBy("bank_id", "e").agg(F.min("fact_id").alias("own"))
    each = batches.where("bank_id is not null").select("bank_id", F.col("batch").cast("long").alias("batch"), F.explode("entity_ids").alias("e")).where("e is not null")
    lists = each.groupBy("bank_id", "batch").agg(F.collect_set("e").alias("entities")).withColumn("turn", F.lit(0))
    lists = cut(lists.select("bank_id", F.floor(F.col("batch") / SPAN).alias("span"), "batch", made.alias("made"), "entities"))
    begins = cut(lists.select("bank_id", "span", F.explode("entities").alias("e")).distinct().join(known, ["bank_id", "e"], "left").select("bank_id", "span", "e", "own", F.col("own").alias("least")))
    key, before = ["bank_id", "span"], Window.partitionBy("bank_id", "e").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span that an entity is in
    while True:
        ends = cut(lists.groupBy(*key).cogroup(begins.groupBy(*key)).applyInArrow(_walked, "bank_id long, span long, batch long, target long, e long, least long"))
        left = ends.where("batch is null").select(*key, "e", F.col("least").alias("end"))
        after = begins.join(left, [*key, "e"]).select(*key, "e", "own", F.coalesce(F.last("end", ignorenulls=True).over(before), "own").alias("least"), F.col("least").alias("was"))
        after = cut(after)
        if after.where("not (least <=> was)").isEmpty():
            return ends.where("batch is not null").select("bank_id", "batch", "target")
        discard(begins, ends)
        begins = after


def consolidate_by_entity(facts: DataFrame, size: int = 8, new_id: Callable[[Column], Column] = observation_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What consolidate returns with by_shared_entity and one_action, without a round for each batch: all targets are found first, then each observation is made of all batches that have to do with it."""
    none = F.array().cast("array<bigint>")
    batches, now = _begun(facts, size)
    made = new_id(F.col("batch").cast("long"))
    placed = F.col("bank_id").isNotNull()  # facts of no bank meet no action's indices
    x = batches.groupBy("bank_id", "batch").agg(
        F.array_sort(F.collect_list(F.struct("place", "fact_id", "entity_ids", truncated(F.col("content"), 40).alias("said")))).alias("x"), F.count(F.lit(1)).alias("facts"), F.min("temporal_start").alias("low"), F.max("temporal_end").alias("high")
    ).withColumn("turn", F.lit(0))
    own = x.select(
        "bank_id", F.col("batch").cast("long").alias("batch"), "facts", made.alias("made_id"), F.expr("concat_ws('; ', transform(x, r -> r.said))").alias("content"),
        F.when(placed, F.expr("transform(x, r -> r.fact_id)")).otherwise(none).alias("evidence"), F.when(placed, F.expr(_union("transform(x, r -> r.entity_ids)"))).otherwise(none).alias("entities"),
        F.when(placed, F.col("low")).alias("low"), F.when(placed, F.col("high")).alias("high"),
    )
    own = cut(own.join(entity_targets(batches, now, made), ["bank_id", "batch"], "left"))
    at = F.col("batch").cast("int")
    fresh = own.where("target is null").select(
        F.col("made_id").alias("fact_id"), "bank_id", "content", F.col("entities").alias("entity_ids"), F.col("evidence").alias("evidence_ids"), F.col("low").alias("temporal_start"), F.col("high").alias("temporal_end"), at.alias("made"), at.alias("changed")
    )
    u = own.where("target is not null").groupBy(F.col("target").alias("fact_id")).agg(
        F.max_by("content", "batch").alias("said"), F.max(at).alias("at"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("batch", "evidence", "entities"))).alias("x")
    )
    every = lambda c, n: F.when(F.col("at").isNull(), F.col(c)).otherwise(F.array_union(c, F.flatten(F.transform("x", lambda r: r[n])))).alias(c)
    done = now.unionByName(fresh).join(u, "fact_id", "left").select(
        "fact_id", "bank_id", F.when(F.col("at").isNull(), F.col("content")).otherwise(F.col("said")).alias("content"), every("entity_ids", "entities"), every("evidence_ids", "evidence"),
        F.least("temporal_start", "low").alias("temporal_start"), F.greatest("temporal_end", "high").alias("temporal_end"), "made", F.coalesce("at", "changed").alias("changed"),
    )
    count = lambda test: (placed & test).cast("long")
    progress = own.select("bank_id", "batch", "facts", count(F.col("target").isNull()).alias("created"), count(F.col("target").isNotNull()).alias("updated"))
    return cut(done).select(*OBSERVATION), batches.select("fact_id"), progress
