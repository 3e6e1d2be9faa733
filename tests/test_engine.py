"""The store by banks, consolidation by rounds, reflection's sources, and numbering without a gathered group."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import text
from memspark.operators import clusters, consolidate, evaluate, filters, ordinals, provenance, recall, resolve
from memspark.plans import engine
from memspark.sources import datasets, store

ASK = "query_id long, bank_id long, text string"


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    e = engine.Engine(spark, str(tmp_path_factory.mktemp("store") / "memory"))
    for i in (1, 2, 3):
        e.create_bank(i, f"bank {i}")
    docs = [(i, 1 + i % 2, f"Alice met Bob in Paris. They saw Carol{i} there. Nobody asked Dora about number {i}") for i in range(8)]
    e.retain(spark.createDataFrame(docs, "doc_id long, bank_id long, text string"), "2024-01-01 10:00:00")
    return e


def files(e, *parts):
    import pathlib

    root = pathlib.Path(e.store.path.removeprefix("file:"))
    return {str(f): f.stat().st_mtime_ns for f in root.glob("/".join(parts)) if f.name.endswith(".parquet")}


def test_a_retain_leaves_other_banks_files_alone(spark, memory):
    others, own = files(memory, "*", "bank_id=2", "*"), files(memory, "facts", "bank_id=1", "*")
    assert len(others) >= 6 and own
    got = memory.retain(spark.createDataFrame([(50, 1, "Erin wrote to Frank. Then Erin left")], "doc_id long, bank_id long, text string"), "2024-01-02 10:00:00")
    assert got["facts"] == 2 and got["entities_created"] >= 1
    assert files(memory, "*", "bank_id=2", "*") == others
    assert own.items() <= files(memory, "facts", "bank_id=1", "*").items()  # inserting adds files, and changes none
    again = memory.retain(spark.createDataFrame([(50, 1, "Erin wrote to Frank. Then Erin left")], "doc_id long, bank_id long, text string"), "2024-01-03 10:00:00")
    assert again["facts"] == 0 and again["facts_total"] == got["facts_total"]


def test_mentions_of_a_retain_share_entities(spark, memory):
    facts = memory.store.read("facts").where("bank_id = 1 and content like '%Bob%'").collect()
    named = {r.entity_id: r.name for r in memory.entities(1).collect()}
    assert len(facts) >= 1 and all([named[i] for i in r.entity_ids] == sorted(w for w in r.content.split()[1:] if w[0].isupper()) for r in facts)
    assert len({r.name for r in memory.entities(1).collect()}) == memory.entities(1).count()


def test_recall_reads_the_stored_index(spark, memory):
    ask = spark.createDataFrame([(0, 2, "meets Bob"), (1, 2, "Bob")], ASK)
    found = memory.recall(ask, "2024-01-03 00:00:00").collect()
    assert {r.query_id for r in found if "keyword" in r.sources} == {1} and {r.query_id for r in found} == {0, 1}


def test_a_missing_store_is_empty_and_a_broken_one_an_error(spark, tmp_path):
    s = store.MemoryStore(spark, str(tmp_path / "none"))
    assert s.read("facts").count() == 0
    broken = tmp_path / "broken" / "facts" / "bank_id=1"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        store.MemoryStore(spark, str(tmp_path / "broken")).read("facts").collect()


def test_consolidation_writes_observations_and_marks(spark, memory):
    before = memory.store.read("facts").where("network in ('world', 'experience')").count()
    progress = memory.consolidate("2024-02-01 00:00:00", size=3).collect()
    facts = memory.store.read("facts").cache()
    assert sum(r.facts for r in progress) == before and all(r.created + r.updated == 1 for r in progress)
    made = facts.where("network = 'observation'").collect()
    assert len(made) == sum(r.created for r in progress) and facts.where("network <> 'observation' and consolidated_at is null").count() == 0
    evidence = [i for r in made for i in r.evidence_ids]
    assert set(evidence) == {r.fact_id for r in facts.where("network <> 'observation'").collect()}
    assert all(r.embedding and r.temporal_start for r in made) and len({r.bank_id for r in made}) == 2
    assert memory.consolidate("2024-02-02 00:00:00").collect() == []  # nothing is left
    hit = memory.recall(spark.createDataFrame([(0, 1, made[0].content.split(";")[0].replace(".", ""))], ASK), "2024-02-03 00:00:00")
    assert hit.count() > 0
    memory.store.reset_consolidation()
    assert memory.store.read("facts").where("network = 'observation' or consolidated_at is not null").count() == 0 and memory.store.read("terms").join(facts.where("network = 'observation'"), "fact_id").count() == 0


def test_opinions_are_merged_in_the_store(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "opinions"))
    e.create_bank(1, "b")
    rows = [(1, 1, "good", [0.0, 1.0], 0.6, [7, 8]), (2, 1, "very good", [0.0, 1.0], 0.8, [8, 9]), (3, 1, "bad", [1.0, 0.0], 0.4, [5])]
    new = spark.createDataFrame(rows, "fact_id long, bank_id long, content string, embedding array<float>, confidence double, evidence_ids array<long>").withColumns({"network": F.lit("opinion"), "fact_type": F.lit("experience")})
    e.store.insert("facts", new)
    got = e.merge_opinions("2024-01-01", text=F.array_join("contents", " / "))
    assert got.count() == 2
    after = {r.fact_id: r for r in e.store.read("facts").collect()}
    assert after[2].content == "good / very good" and after[2].evidence_ids == [7, 8, 9] and after[2].confidence == pytest.approx(0.8)
    assert after[1].confidence == 0.0 and after[1].content == "good" and after[3].confidence == pytest.approx(0.4)


# -- rounds against a plain loop


def slow_consolidate(facts, size):
    """One bank after another, one batch after another."""
    obs = {f["id"]: dict(f, made=-1, changed=-1) for f in facts if f["network"] == "observation"}
    marked, progress = set(), []
    for bank in {f["bank"] for f in facts}:
        todo = sorted((f for f in facts if f["bank"] == bank and f["network"] in ("world", "experience") and not f["done"]), key=lambda f: (f["created"], f["id"]), reverse=True)
        for r, at in enumerate(range(0, len(todo), size)):
            batch = todo[at : at + size]
            ents = [e for f in batch for e in f["entities"]]
            target = min((i for i, o in obs.items() if o["bank"] == bank and set(o["entities"]) & set(ents)), default=None)
            marked |= {f["id"] for f in batch}
            low, high = min((f["start"] for f in batch if f["start"]), default=None), max((f["end"] for f in batch if f["end"]), default=None)
            content = "; ".join(f["content"] for f in batch)
            if target is None:
                obs[1000 * (r + 1) + bank] = dict(bank=bank, content=content, entities=sorted(set(ents)), evidence=[f["id"] for f in batch], start=low, end=high, made=r, changed=r)
            else:
                o = obs[target]
                o.update(content=content, entities=sorted({*o["entities"], *ents}), evidence=o["evidence"] + [f["id"] for f in batch if f["id"] not in o["evidence"]], changed=r)
                o.update(start=min(x for x in (o["start"], low) if x) if o["start"] or low else None, end=max(x for x in (o["end"], high) if x) if o["end"] or high else None)
            progress.append((bank, r, len(batch), int(target is None), int(target is not None)))
    return obs, marked, sorted(progress)


@pytest.mark.parametrize("seed", [1, 2])
def test_consolidation_rounds_equal_a_loop(spark, seed):
    rng, facts = random.Random(seed), []
    for i in range(60):
        net = rng.choice(["world", "experience", "opinion", "observation", "world"])
        start, end = (rng.choice([None, f"2024-01-{rng.randint(10, 28)}"]) for _ in range(2))
        facts.append(dict(id=i, bank=rng.randrange(3), network=net, content=f"c{i}", entities=sorted(rng.sample(range(30), rng.randint(0, 2))), evidence=[], start=start, end=end, created=f"2024-02-{rng.randint(10, 12)}", done=rng.random() < 0.2))
    rows = [(f["id"], f["bank"], f["network"], f["content"], f["entities"] or None, None, f["start"], f["end"], f["created"], "2024-03-01" if f["done"] else None) for f in facts]
    table = spark.createDataFrame(rows, "fact_id long, bank_id long, network string, content string, entity_ids array<long>, evidence_ids array<long>, temporal_start string, temporal_end string, created_at string, consolidated_at string")
    table = table.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("temporal_start", "temporal_end", "created_at", "consolidated_at")})
    found, marked, progress = consolidate.consolidate(table, consolidate.by_shared_entity, consolidate.one_action, 4, lambda r: F.lit(1000 * (r + 1)) + F.col("bank_id"))
    obs, done, steps = slow_consolidate(facts, 4)
    day = lambda x: None if x is None else str(x)[:10]
    got = {r.fact_id: (r.bank_id, r.content, sorted(r.entity_ids), r.evidence_ids, day(r.temporal_start), day(r.temporal_end), r.made, r.changed) for r in found.collect()}
    assert got == {i: (o["bank"], o["content"], o["entities"], o["evidence"], o["start"], o["end"], o["made"], o["changed"]) for i, o in obs.items()}
    assert {r.fact_id for r in marked.collect()} == done and sorted((r.bank_id, r.batch, r.facts, r.created, r.updated) for r in progress.collect()) == steps
    assert any(s[3] for s in steps) and any(s[4] for s in steps)


def test_actions_are_applied_as_the_batch_found_them(spark):
    batch = spark.createDataFrame([(0, 0, 10, [1], None, "2024-01-05"), (0, 1, 11, [2, 1], "2024-01-01", None)], "bank_id long, place int, fact_id long, entity_ids array<long>, temporal_start string, temporal_end string")
    old = spark.createDataFrame([(90, 0, "old", [3], [5, 10], "2024-01-03", None, -1, -1)], "fact_id long, bank_id long, content string, entity_ids array<long>, evidence_ids array<long>, temporal_start string, temporal_end string, made int, changed int")
    related = spark.createDataFrame([(0, 0, 90)], "bank_id long, observation_index int, fact_id long")
    rows = [(0, 0, "update", "first", [0], 0, None), (0, 1, "update", "last", [1, 7, 0], None, 90), (0, 2, "update", "lost", [1], 5, 77), (0, 3, "create", "new", None, None, None)]
    after, report = consolidate.applied(batch, related, old, spark.createDataFrame(rows, consolidate.ACTIONS), F.col("turn") + 100, 4)
    got = {r.fact_id: (r.content, r.entity_ids, r.evidence_ids, r.temporal_start, r.temporal_end, r.made, r.changed) for r in after.collect()}
    assert got == {90: ("last", [3, 2, 1], [5, 10, 11], "2024-01-01", "2024-01-05", -1, 4), 102: ("lost", [2, 1], [11], "2024-01-01", None, 4, 4), 103: ("new", [], [], None, None, 4, 4)}
    assert report.first().asDict() == {"bank_id": 0, "created": 2, "updated": 2, "batch": 4}


def test_prompts_of_batches(spark):
    day = lambda c: F.col(c).cast("timestamp_ntz")
    shape = "bank_id long, batch long, place int, fact_id long, content string, temporal_start string, temporal_end string"
    batches = spark.createDataFrame([(0, 0, 0, 1, "a", "2024-01-01", None), (0, 0, 1, 2, "b", None, None), (1, 0, 0, 3, "c", None, None)], shape).withColumns({c: day(c) for c in ("temporal_start", "temporal_end")})
    related = spark.createDataFrame([(0, 0, 0, 9)], "bank_id long, batch long, observation_index int, fact_id long")
    seen = spark.createDataFrame([(9, "o", None, "2024-01-02")], "fact_id long, content string, temporal_start string, temporal_end string").withColumns({c: day(c) for c in ("temporal_start", "temporal_end")})
    got = {r.bank_id: r.prompt for r in consolidate.prompts(batches, related, seen, "F:{facts} O:{observations}").collect()}
    assert got == {0: "F:[0] a | occurred: 2024-01-01\n[1] b O:[0] o | occurred: until 2024-01-02", 1: "F:[0] c O:(none)"}


# -- sources, numbering and small rules


def test_closure_follows_only_what_is_asked_for(spark):
    evidence = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (3, None), (None, 4)], "fact_id long, evidence_id long")
    asked = spark.createDataFrame([(1,), (1,), (4,)], "fact_id long")
    assert sorted((r.fact_id, r.evidence_id) for r in provenance.closure_from(asked, evidence).collect()) == [(1, 1), (1, 2), (1, 3)]
    facts = spark.createDataFrame([(1, 30), (2, 10), (3, None), (8, 5)], "fact_id long, source_turn_id long")
    assert {r.fact_id: r.turns for r in provenance.support(asked, facts, evidence).collect()} == {1: [10, 30], 4: []}


def test_finalized_answers_cite_what_was_retrieved(spark):
    done = spark.createDataFrame([(0, "r", [9, 3, 5]), (1, "s", [4]), (2, "t", [])], "query_id long, response string, source_ids array<long>")
    retrieved = spark.createDataFrame([(0, 5), (0, 9), (0, 9), (1, 3)], "query_id long, fact_id long")
    assert {r.query_id: (r.sources, r.confidence, r.new_opinions) for r in provenance.finalized(done, retrieved).collect()} == {0: ([9, 5], 0.85, []), 1: ([], 0.85, []), 2: ([], 0.85, [])}


def test_searches_inherit_their_questions_time(spark):
    at = F.lit("2026-02-25 12:00:00").cast("timestamp_ntz")
    questions = spark.createDataFrame([(0, "what happened yesterday?"), (1, "nothing")], "query_id long, text string").withColumn("now", at)
    searches = spark.createDataFrame([(0, "cats"), (0, "on 2026-01-15"), (1, "cats")], "query_id long, text string").withColumn("now", at)
    got = {(r.query_id, r.text): str(r.anchor_start)[:10] for r in recall.with_inherited_ranges(searches, questions).collect()}
    assert got == {(0, "cats"): "2026-02-24", (0, "on 2026-01-15"): "2026-01-15", (1, "cats"): "None"}


def test_numbering_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else None if i % 2 else i % 7, rng.randrange(50), i) for i in range(3000)]
    table = spark.createDataFrame(rows, "g long, x long, i long").withColumns({"__RANGE": F.lit(1), "__move": F.lit(2)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordinals.numbered(table, ["g"], [F.desc("x"), F.col("i")], "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))}
    assert {r.i: r["at"] for r in out.collect()} == want and out.columns == [*table.columns, "at"]
    assert ordinals.numbered(table.limit(0), ["g"], [F.col("i")], "at").count() == 0


def test_small_rules(spark):
    one = spark.range(1)
    row = one.select(
        evaluate.scorable(F.lit(4), F.lit("a")).alias("a"), evaluate.scorable(F.lit(5), F.lit("a")).alias("b"), evaluate.scorable(F.lit(1), F.lit(None)).alias("c"),
        evaluate.is_abstention(F.lit("q_abs_1")).alias("d"), evaluate.is_abstention(F.lit("q")).alias("e"), F.transform(F.array(*map(F.lit, ["Opinions ", "plan", "x", "WORLD"])), resolve.normal_network).alias("f"),
        recall.sigmoid(F.lit(0.0)).alias("g"), clusters.clamped(F.lit(1.5)).alias("h"), clusters.clamped(F.lit(-0.5)).alias("i"), clusters.weakened(F.lit(None).cast("double"), F.lit(0.2)).alias("j"), clusters.reinforced(F.lit(0.95), F.lit(0.2)).alias("k"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i) == (True, False, False, True, False, ["experience", "experience", "world", "world"], 0.5, 1.0, 0.0)
    assert row.j == pytest.approx(0.3) and row.k == 1.0
    facts = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")], "fact_id long, created_at string")
    assert [r.fact_id for r in filters.newest_first(facts).collect()] == [3, 2, 1]
    assert sorted(r.fact_id for r in store.get_facts(facts, spark.createDataFrame([(3,), (9,), (3,)], "fact_id long")).collect()) == [3]
    calls = spark.createDataFrame([(0, 7, 1, 0), (0, 7, 0, 5), (0, 8, 1, 1)], "query_id long, fact_id long, call int, rank long")
    assert sorted((r.fact_id, r.call) for r in recall.first_seen(calls, "query_id", ["call", "rank"]).collect()) == [(7, 0), (8, 1)]
    found = spark.createDataFrame([(0, 1, "observation", "o"), (0, 0, "world", "w"), (0, 2, "opinion", "p"), (0, 3, "experience", "e")], "query_id long, rank long, network string, content string")
    assert engine.context_hierarchy(found).first().context == "## Observations\n- o\n\n## Facts\n- w\n- e\n\n## Opinions\n- p"
    observations = spark.createDataFrame([(1, "a", [1], [2], 5, 6), (2, "b", [], [], None, None)], "observation_id long, content string, evidence_ids array<long>, entity_ids array<long>, temporal_start int, temporal_end int")
    changes = spark.createDataFrame([(1, "z", [1, 3], [4], 3, None)], "observation_id long, new_content string, new_evidence_ids array<long>, new_entity_ids array<long>, new_temporal_start int, new_temporal_end int")
    assert {r.observation_id: tuple(r)[1:] for r in engine.apply_updates(observations, changes).collect()} == {1: ("z", [1, 3], [2, 4], 3, 6), 2: ("b", [], [], None, None)}
    assert text.STOP_WORDS and datasets


def test_a_run_is_written_with_its_summary(spark, tmp_path):
    rows = [("q2", "b", "s1", 1, 1.0, 0.5), ("q1", "a", "s1", 0, 0.0, None), ("q3", "a", "s2", 1, 0.5, 1.0)]
    results = spark.createDataFrame(rows, "question_id string, category string, conversation string, correct int, f1 double, evidence_recall double")
    calls = spark.createDataFrame([("recall", 10.0, 0, 5), ("recall", 2.0, 1, 7), ("judge", 1.0, 0, 1)], "stage string, tokens double, error int, latency_ms long")
    datasets.write_run(results, evaluate.usage(calls), str(tmp_path / "run"), 12.5, results.select("question_id", F.lit("why").alias("note")))
    summary = datasets.read_summary(spark, str(tmp_path / "run"))
    assert summary["total_time_s"] == 12.5 and summary["overall"] == {"n": 3, "correct": 2, "accuracy": pytest.approx(0.666667), "mean_f1": 0.5, "mean_evidence_recall": 0.5}
    assert summary["per_category"]["a"]["n"] == 2 and set(summary["per_conversation"]) == {"s1", "s2"} and summary["stage_usage"]["recall"] == {"calls": 2, "tokens": 12.0, "errors": 1, "latency_ms": 12}
    back = datasets.read_results(spark, str(tmp_path / "run" / "results"), "question_id string, conversation string")
    assert sorted(r.question_id for r in back.collect()) == ["q1", "q2", "q3"]
    assert datasets.read_results(spark, str(tmp_path / "run" / "debug"), "question_id string, note string").where("note = 'why'").count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_whose_targets_are_found_first_equal_rounds(spark, monkeypatch, seed):
    """Odd banks, entities and evidence too; spans of two batches wait for those before them, and no job is run a round."""
    monkeypatch.setattr(consolidate, "SPAN", 2)
    rng, rows = random.Random(seed), []
    for i in range(150):
        entities = rng.choice([None, [], [rng.randrange(60), None], rng.sample(range(60), 2), [7, 7]])
        day = lambda: rng.choice([None, f"2024-01-{rng.randint(10, 28)}"])
        rows.append((i, rng.choice([None, 0, 0, 1, 2]), rng.choice(["world", "experience", "opinion"] + ["observation"] * (i % 9 == 0)), rng.choice([None, f"c{i}"]), entities, rng.choice([None, [3, 3, 5]]), day(), day(), f"2024-02-{rng.randint(10, 12)}", None))
    table = spark.createDataFrame(rows, "fact_id long, bank_id long, network string, content string, entity_ids array<long>, evidence_ids array<long>, temporal_start string, temporal_end string, created_at string, consolidated_at string")
    table = table.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("temporal_start", "temporal_end", "created_at", "consolidated_at")})
    names = lambda r: F.lit(1000) * (r + 1) * F.when(F.col("bank_id") == 2, -1).otherwise(1) + F.coalesce("bank_id", F.lit(9))
    seen = lambda df: sorted(str({k: sorted(v, key=str) if k == "entity_ids" else v for k, v in r.asDict().items()}) for r in df.collect())
    want, got = consolidate.consolidate(table, consolidate.by_shared_entity, consolidate.one_action, 4, lambda r: names(F.lit(r))), consolidate.consolidate_by_entity(table, 4, names)
    assert all(seen(x) == seen(y) for x, y in zip(want, got)) and [x.dtypes for x in want] == [y.dtypes for y in got]
    assert want[0].where("changed > made").count() and want[2].where("created = 1").count()
