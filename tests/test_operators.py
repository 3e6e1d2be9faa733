import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.operators import clusters, evaluate, links, provenance, recall, resolve
from memspark.plans import catalogue, engine, fixtures
from memspark.schemas import RecallConfig
from memspark.sources import datasets, store
from memspark.streaming import trigger


def ranked(spark, lists):
    rows = [(0, f, 0.0, i, s) for s, ids in lists.items() for i, f in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id int, fact_id long, score double, rank long, source string")


def test_fusion_goldens(spark):
    got = {r.fact_id: r for r in recall.fuse(ranked(spark, {"semantic": [1, 2], "keyword": [1], "graph": [3]})).collect()}
    assert got[1].score == pytest.approx(2 / 60, abs=1e-6) and got[2].score == pytest.approx(1 / 61, abs=1e-6)
    assert got[1].sources == ["semantic", "keyword"] and [got[i].rank for i in (1, 3, 2)] == [0, 1, 2]


@given(st.lists(st.integers(0, 9), unique=True, max_size=5), st.lists(st.integers(0, 9), unique=True, max_size=5))
@settings(max_examples=4, deadline=None)
def test_fusion_does_not_depend_on_the_order_of_channels(spark, a, b):
    one = recall.fuse(ranked(spark, {"semantic": a, "graph": b})).collect()
    two = recall.fuse(ranked(spark, {"graph": b, "semantic": a})).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


@pytest.mark.parametrize("budget, kept", [(5, 2), (4, 2), (3, 1), (0, 0), (100, 3)])
def test_budget_is_a_maximal_prefix(spark, budget, kept):
    rows = spark.createDataFrame([(0, i, i, 2) for i in range(3)], "query_id int, fact_id int, rank long, tokens long")
    assert recall.within_budget(rows, 50, budget).count() == kept
    big = spark.createDataFrame([(0, 0, 0, 9), (0, 1, 1, 1)], "query_id int, fact_id int, rank long, tokens long")
    assert recall.within_budget(big, 50, 5).count() == 0  # the first too large one ends it


def test_activation_is_expanded_at_first_arrival(spark):
    edges = spark.createDataFrame([(1, 2, "semantic", 0.9), (2, 3, "semantic", 0.9), (1, 3, "semantic", 0.5), (3, 4, "semantic", 0.9)], "source_id long, target_id long, link_type string, weight double")
    seeds = spark.createDataFrame([(0, 1, 1.0, 0)], "query_id int, fact_id long, score double, rank long")
    got = {r.fact_id: r.score for r in recall.activation(seeds, edges).collect()}
    assert got[4] == pytest.approx(0.2205) and got[3] == pytest.approx(0.3969) and got[2] == pytest.approx(0.63)


def test_rerank(spark):
    fused = recall.fuse(ranked(spark, {"semantic": [1, 2, 3]}))
    assert [r.fact_id for r in recall.reverse(fused).orderBy("rank").collect()] == [3, 2, 1]
    assert recall.rerank(fused) is fused
    some = recall.rerank(fused, F.when(F.col("fact_id") > 1, F.col("fact_id").cast("double")), drop_missing=True)
    assert [r.fact_id for r in some.orderBy("rank").collect()] == [3, 2]


FACT = "fact_id long, bank_id long, network string, temporal_start string, temporal_end string, embedding array<float>"


def facts(spark, rows):
    df = spark.createDataFrame(rows, FACT)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("temporal_start", "temporal_end")})


def test_links(spark):
    rows = [(1, 0, "world", "2024-01-01", None, [1.0, 0.0]), (2, 0, "world", "2024-01-02", None, [1.0, 0.1]), (3, 0, "opinion", "2024-01-01", None, [1.0, 0.0]), (4, 0, "world", "2024-06-01", "2024-07-01", [0.0, 1.0]), (5, 0, "world", None, "2024-06-15", None), (6, 1, "world", "2024-01-01", None, [1.0, 0.0])]
    f = facts(spark, rows)
    got = {(r.source_id, r.target_id): r.weight for r in links.temporal_links(f, f).collect()}
    assert got[1, 2] == got[2, 1] == pytest.approx(1 - 1 / 30, abs=1e-4) and got[3, 1] == 1.0 and (1, 3) not in got and (1, 4) not in got
    assert got[5, 4] == got[4, 5] == 0.5 and got[5, 1] == got[1, 5] == 0.5 and not any(6 in k for k in got)
    assert {(r.source_id, r.target_id) for r in links.semantic_links(f, f).collect()} == {(1, 2), (2, 1), (3, 1), (3, 2)}
    bridge = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (2, 9), (4, 1)], "fact_id long, entity_id long")
    assert {(r.source_id, r.target_id, r.weight) for r in links.entity_links(f, f, bridge).collect()} == {(1, 2, 0.3333), (2, 1, 0.3333)}
    made = links.entity_links(f, f, bridge).unionByName(links.temporal_links(f, f))
    asked = links.causal_candidates(made, 3)
    assert [(r.source_id, r.target_id) for r in asked.orderBy("rank").collect()] == [(1, 2), (1, 5), (2, 1)]
    assert links.causal_links(asked, F.when(F.col("source_id") == 1, " Yes.").otherwise("no")).count() == 2


def test_clusters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])], "id long, embedding array<float>")
    assert {r.id: r.cluster_id for r in clusters.clusters(v).collect()} == {1: 1, 2: 1, 3: 3}
    chain = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    assert {r.id: r.cluster_id for r in clusters.clusters(chain, 0.7).collect()} == {1: 1, 2: 1, 3: 3}
    assert clusters.clusters(v.limit(0)).count() == 0


def test_opinions(spark):
    o = spark.createDataFrame([(1, 1, 0.7, [1, 2]), (1, 2, 0.8, [2, 3]), (1, 3, 0.8, [3, 3]), (9, 9, None, [])], "cluster_id long, fact_id long, confidence double, evidence_ids array<long>")
    got = {r.fact_id: (r.winner, r.new_confidence) for r in clusters.merge_consistent(o).collect()}
    assert got[3] == (True, pytest.approx(0.8666666)) and got[1] == (False, 0.0) and got[9][1] == pytest.approx(0.6)
    assert {r.fact_id: r.new_confidence for r in clusters.weaken_contradictory(o).collect()} == {1: pytest.approx(0.49), 9: pytest.approx(0.35)}
    verdict = spark.createDataFrame([(1, 7), (9, None)], "cluster_id long, superseded_index int")
    assert {r.fact_id for r in clusters.weaken_superseded(o, verdict).collect()} == {3, 9}
    assert {r.cluster_id: r.evidence_ids for r in clusters.merged_evidence(o).collect()} == {1: [1, 2, 3], 9: []}


def test_dedup(spark):
    f = facts(spark, [(i, 0, "world", None, None, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])])
    assert [r.fact_id for r in resolve.dedup(f.where("fact_id > 0"), f.where("fact_id = 0")).collect()] == [2]
    chunks = f.withColumn("chunk", (F.col("fact_id") / 1).cast("int"))
    assert sorted(r.fact_id for r in resolve.dedup_in_order(chunks).collect()) == [0, 2]
    assert sorted(r.fact_id for r in resolve.dedup_in_order(chunks.withColumn("chunk", F.lit(0))).collect()) == [0, 1, 2]


def test_provenance(spark):
    evidence = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1)], "fact_id long, evidence_id long")
    closure = {(r.fact_id, r.evidence_id) for r in provenance.evidence_closure(evidence).collect()}
    assert {(9, x) for x in (1, 2, 3, 4)} <= closure and (4, 1) not in closure
    f = spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4, 9)], "fact_id long, source_turn_id long")
    assert {r.fact_id: r.turns for r in provenance.support(f, f, evidence).collect()}[2] == [20, 30, 40]
    turns = spark.createDataFrame([("c", i, r, r[0]) for i, r in enumerate(["user", "assistant", "assistant", "user", "user", "assistant", "user"])], "conv_id string, turn long, role string, text string")
    assert [r["round"] for r in provenance.rounds(turns).orderBy("turn").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_runs(spark):
    a = spark.createDataFrame([("q1", "x", 1), ("q2", "x", 0)], "question_id string, category string, correct int")
    b = spark.createDataFrame([("q3", "x", 1)], "question_id string, category string, correct int")
    assert evaluate.merge_runs([a, b]).count() == 3
    with pytest.raises(ValueError):
        evaluate.merge_runs([a, a])
    assert {r.other for r in evaluate.compare_all(a, b).collect()} == {"-"}


def test_store(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "bank"))
    assert e.info() == {"banks": 0, "facts": 0}
    e.create_bank(1, "b", directives=["x"])
    e.create_bank(2, "a")
    with pytest.raises(ValueError):
        e.create_bank(3, "c", empathy=9)
    with pytest.raises(KeyError):
        e.get_bank(77)
    assert [r.name for r in e.list_banks().collect()] == ["a", "b"]
    docs = spark.createDataFrame([(1, 1, "Alice met Bob in Paris. They talked about Rust. Bob likes Rust"), (2, 2, "Nothing here")], "doc_id long, bank_id long, text string")
    first = e.retain(docs, "2024-01-01 10:00:00")
    assert first["facts"] == 4 and first["links_total"] > 0
    assert e.retain(docs, "2024-01-02 10:00:00")["facts"] == 0  # all are there already
    ask = spark.createDataFrame([(0, 1, "Bob likes Rust")], "query_id long, bank_id long, text string")
    found = e.recall(ask, "2024-01-03 00:00:00")
    assert found.count() == 3 and found.orderBy("rank").first().sources[0] == "semantic"
    assert {r.tool for r in e.reflect(ask, "2024-01-03 00:00:00").collect()} == {"recall"}
    assert e.lookup_sources(found.select("fact_id")).count() == 3
    assert {r.name for r in e.entities(1).collect()} >= {"Bob", "Rust"}
    e.store.delete_bank(1)
    assert e.info() == {"banks": 1, "facts": 1} and e.store.read("graph_links").count() == 0
    e.store.reset_consolidation()
    assert e.store.read("facts").where("consolidated_at is not null").count() == 0


def test_entity_upsert_keeps_the_id_that_is_there(spark):
    s = "entity_id long, bank_id long, name string, entity_type string, aliases array<string>"
    old, new = spark.createDataFrame([(1, 0, "A", "concept", ["x"])], s), spark.createDataFrame([(9, 0, "A", "person", ["y"]), (8, 0, "B", "concept", [])], s)
    got = {r.name: (r.entity_id, r.entity_type, r.aliases) for r in store.upsert_entities(old, new).collect()}
    assert got == {"A": (1, "person", ["y"]), "B": (8, "concept", [])}


def test_actions(spark):
    replies = spark.createDataFrame([(0, 'x ```json\n{"actions": [{"action": "update", "content": "c", "fact_indices": [0], "observation_index": 1}, {"action": "update", "content": "d", "observation_id": "[AB]"}, {"action": "update", "content": "e", "observation_index": 9}, {"action": "create", "content": "f"}]}\n```')], "batch int, reply string")
    known = spark.createDataFrame([(0, 0, "AB"), (0, 1, "CD")], "batch int, index int, observation_id string")
    got = [(r.action, r.target) for r in engine.decode_actions(replies, known).orderBy("place").collect()]
    assert got == [("update", "CD"), ("update", "AB"), ("create", None), ("create", None)]


def test_schedule_and_ids(spark):
    assert [engine.tool_for(i, 8) for i in (0, 1, 2, 7)] == ["search_observations", "recall", "any", "done"]
    ulid = "01ARZ3NDEKTSV4RRFFQ69G5FAV"
    row = spark.createDataFrame([([f"[{ulid.lower()}]", ulid, "x"],)], "ids array<string>").select(engine.done_ids(F.col("ids")).alias("x"), engine.stop_reason(F.lit("tool_calls")).alias("y")).first()
    assert row.x == [ulid] and row.y == "tool_use"


def test_stream_decisions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", i) for i in range(3)] + [(1, "2024-01-01 00:00:20", 9)] + [(1, "2024-01-01 00:01:00", i) for i in range(40)] + [(2, "2024-01-01 00:00:00", 0)]
    f = spark.createDataFrame(rows, "bank_id long, at string, fact_id long").select("bank_id", "fact_id", F.col("at").cast("timestamp_ntz").alias("created_at"), F.lit("world").alias("network"), F.lit(None).cast("timestamp_ntz").alias("consolidated_at"))
    got = sorted((r.bank_id, r.waiting, r.due) for r in trigger.replay(f, str(tmp_path)).collect())
    assert got == [(1, 1, False), (1, 5, False), (2, 1, False)]


def test_dialogue_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"sample_id": "s", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1:1", "blip_caption": "cat"}, {"speaker": "B", "text": "yo", "dia_id": "D1:2"}], "session_1_date_time": "1:56 pm on 8 May, 2023"}, "qa": [{"question": "q", "answer": 7, "category": 2, "evidence": ["D1:1"]}]}]')
    turns, qa = datasets.read_dialogues(spark, str(tmp_path / "d.json"))
    rows = turns.orderBy("place").collect()
    assert [(r.text, str(r.date)) for r in rows] == [("hi [image: cat]", "2023-05-08 13:56:00"), ("yo", "2023-05-08 13:56:00")] and qa.first().answer == "7"
    (tmp_path / "l.json").write_text('[{"question_id": "a_abs", "question": "q", "answer": "x", "question_date": "2023/05/25 (Thu) 14:30", "haystack_dates": ["d"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "c"}]], "answer_session_ids": ["s1"]}, {"question_id": "b", "question_date": "?", "haystack_dates": [], "haystack_session_ids": ["s1"], "haystack_sessions": [[]], "answer_session_ids": ["s9"]}]')
    q = datasets.read_long_memory(spark, str(tmp_path / "l.json"))
    assert {r.question_id: len(r.errors) for r in datasets.errors_of(q).collect()} == {"b": 4}
    assert datasets.session_turns(q).count() == 1
    datasets.write_results(qa, str(tmp_path / "out"))
    assert datasets.read_results(spark, str(tmp_path / "out"), "question string, answer string").first().answer == "7"


def test_config_defaults():
    c = RecallConfig()
    assert (c.channel_limit, c.max_facts, c.token_budget, c.rrf_k, c.hops, c.seeds, c.graph_limit) == (40, 50, 4096, 60.0, 3, 10, 50)


def test_near_ties_are_ranked_by_their_full_scores(spark):
    facts = spark.createDataFrame([(1, 0, "world", [1.0, 0.00400]), (2, 0, "world", [1.0, 0.00399]), (3, 0, "world", [1.0, 0.00401])], "fact_id long, bank_id long, network string, embedding array<double>")
    queries = spark.createDataFrame([(7, 0, [1.0, 0.0])], "query_id long, bank_id long, embedding array<double>")
    found = recall.vector_topk(queries, facts, 2).orderBy("rank").collect()
    assert [r.fact_id for r in found] == [2, 1] and round(found[0].score, 4) == round(found[1].score, 4)


def test_causal_candidates_need_no_pairs_of_a_whole_bank(spark):
    """The first targets of each fact's entities give the same candidates as all pairs, and their number grows with the facts."""
    counts = []
    for n in (40, 160):
        facts = spark.createDataFrame([(i * 3 % n, i % 2, "opinion" if i % 5 == 1 else "world") for i in range(n)], "fact_id long, bank_id long, network string")
        bridge = facts.select("fact_id", F.explode(F.array(F.col("fact_id") % 3, F.col("fact_id") * 7 % 4)).alias("entity_id"))
        chunk = facts.select(F.col("fact_id").alias("source_id"), (F.col("fact_id") % 5).alias("chunk"))
        some = links.first_entity_pairs(facts, facts, bridge, 4)
        rows = lambda made: {(r.chunk, r["rank"], r.source_id, r.target_id) for r in links.causal_candidates(made, 4, chunk).collect()}
        assert rows(some) == rows(links.entity_links(facts, facts, bridge))
        counts.append(some.count())
    assert counts[1] <= 160 * 2 * 5


def test_entity_links_do_not_group_pairs(spark):
    """Each pair is found once with all that it shares, without an aggregate or a shuffle by pair."""
    ids = {i: {i % 3, i % 4 + 10, 20} for i in range(24)}
    facts = spark.createDataFrame([(i, i % 2, "opinion" if i % 5 == 1 else "world") for i in ids], "fact_id long, bank_id long, network string")
    bridge = spark.createDataFrame([(i, e) for i, es in ids.items() for e in es] + [(0, 20)], "fact_id long, entity_id long")
    made = links.entity_links(facts, facts, bridge)
    assert "Aggregate [a_id" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b, round(len(ids[a] & ids[b]) / len(ids[a] | ids[b]), 4)) for a in ids for b in ids if a != b and a % 2 == b % 2 and b % 5 != 1)
    assert sorted((r.source_id, r.target_id, r.weight) for r in made.collect()) == want


def test_temporal_links_of_crowded_days_are_dealt(spark, monkeypatch):
    """A day with more facts than a block gives the same links, made in blocks, with weights rounded as SQL does."""
    from datetime import datetime, timedelta

    noon = datetime(2024, 1, 1, 12)
    rows = [(i, 1, "world", None if i % 4 == 0 else noon + timedelta(seconds=17496 * (i % 3)), None if i % 5 == 0 else noon + timedelta(hours=i % 7), [1.0]) for i in range(60)]
    facts = spark.createDataFrame(rows, "fact_id long, bank_id long, network string, temporal_start timestamp_ntz, temporal_end timestamp_ntz, embedding array<double>")
    whole = sorted(map(tuple, links.temporal_links(facts, facts, 2).collect()))
    monkeypatch.setattr(links, "ROWS", 7)
    made = links.temporal_links(facts, facts, 2)
    assert sorted(map(tuple, made.collect())) == whole and len({r[:2] for r in whole}) == len(whole)
    assert {r[3] for r in whole} == {1.0, 0.5, 0.8988, 0.7975}
    a, b = facts.selectExpr("bank_id", "fact_id AS a_id"), facts.selectExpr("bank_id", "fact_id AS b_id")
    met = links._dealt(a, b, ["bank_id"], "a_id", "b_id")
    assert met.count() == 3600 and met.groupBy("bank_id", "x_block", "y_block").count().count() >= 64


SMALL = "/root/testdata/sf0.001"


def read_again(df):
    """The given tables that df reads whenever it runs, and how many equi-joins its plan has."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {f.rsplit("/", 1)[1] for f in df.inputFiles() if f.startswith(f"file://{SMALL}")}, plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin")


def test_links_are_made_of_ids_that_are_written_once(spark):
    made = fixtures.build(spark, SMALL, "graph_links")
    assert read_again(made) == (set(), 0)
    facts = fixtures.build(spark, SMALL, "facts")
    want = spark.sql(fixtures.SQL["graph_links"], facts=facts, fact_count=spark.sql(fixtures.SQL["fact_count"], facts=facts))
    assert made.count() == 3 * facts.count() > 0 and made.exceptAll(want).isEmpty() and made.schema.names == want.schema.names
    assert read_again(catalogue.queries()["links_upsert"](spark, SMALL)) == (set(), 0)


def test_links_without_orphans_meet_written_ids(spark):
    made = catalogue.queries()["orphan_links"](spark, SMALL)
    again, joins = read_again(made)
    assert again == set() and joins <= 6  # two for each part of the links
    kept = {r.fact_id for r in fixtures.build(spark, SMALL, "facts").where("network <> 'observation'").collect()}
    rows = fixtures.build(spark, SMALL, "graph_links").collect()
    assert sorted(map(tuple, made.collect())) == sorted((r.source_id, r.target_id, r.link_type) for r in rows if r.source_id in kept and r.target_id in kept)
