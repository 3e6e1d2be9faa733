"""The similarity join and what goes through its pairs in order, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import pairs, resolve
from memspark.operators.clusters import clusters

VECTORS = "id long, bank long, embedding array<double>"


def groups(seed, n=400, dims=16, centers=12, spread=0.05):
    """Unit vectors around a few centers; banks are dealt at random."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dims))
    x = c[rng.integers(0, centers, n)] / np.sqrt(dims) + spread * rng.normal(size=(n, dims))
    return [(i, int(rng.integers(0, 2)), v.tolist()) for i, v in enumerate(x)]


def slow(a, b, threshold, by=False, ordered=False, itself=False):
    out = set()
    for i, g, x in a:
        for j, h, y in b:
            if x and y and len(x) == len(y) and any(x) and any(y) and (not by or g == h):
                if float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))) >= threshold and (i < j if ordered else i != j or itself):
                    out.add((i, j))
    return out


def found(df):
    rows = [(r.a, r.b) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97])
@pytest.mark.parametrize("by", [None, "bank"])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, by):
    monkeypatch.setattr(pairs, "BLOCK", 37)
    rows = groups(1)
    odd = [(900, 0, None), (901, 0, []), (902, 1, [0.0] * 16), (903, 0, [1.0, 0.0]), (904, 0, [2.0, 0.0]), (905, None, [3.0, 0.1]), (906, 0, [1e200] * 16), (907, 1, [1e-200] * 16)]
    table = spark.createDataFrame(rows + odd, VECTORS).withColumn("CELL", F.lit(1))
    both = [(i, g, v) for i, g, v in rows + odd if i not in (906, 907)]
    got = {p for p in found(pairs.similar(table, table, threshold, by, ordered=True)) if not set(p) & {906, 907}}
    assert got == slow(both, both, threshold, bool(by), ordered=True)
    half = table.where("id % 2 = 0")
    some = [r for r in both if r[0] % 2 == 0]
    got = {p for p in found(pairs.similar(half, table, threshold, by, itself=True)) if not set(p) & {906, 907}}
    assert got == slow(some, both, threshold, bool(by), itself=True)


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(groups(2, 5), VECTORS)
    assert not pairs.similar(none, some, 0.5).collect() and not pairs.similar(some, none, 0.5).collect() and not pairs.similar(none, none, 0.5, ordered=True).collect()
    with pytest.raises(ValueError):
        pairs.similar(some, some, 0.0)


def test_pivots_rule_out_most_pairs_of_grouped_vectors(spark, monkeypatch):
    """No product of all with all, and less than a third of all pairs compared, at two sizes."""
    monkeypatch.setattr(pairs, "BLOCK", 64)
    for n in (600, 1800):
        table = spark.createDataFrame(groups(3, n, centers=40), VECTORS)
        met = pairs.meetings(table, table, 0.95, ordered=True)
        plan = met._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        compared = met.select(F.sum(F.size("x") * F.size("y"))).first()[0]
        assert compared < n * (n - 1) / 2 / 3


def test_clusters_without_a_group_have_no_cartesian_product(spark):
    rows = groups(4, 120)
    table = spark.createDataFrame(rows, VECTORS)
    root = {i: i for i, _, _ in rows}
    for i, j in sorted(slow(rows, rows, 0.9, ordered=True)):
        a, b = sorted((root[i], root[j]))
        root = {k: a if v == b else v for k, v in root.items()}
    assert {r.id: r.cluster_id for r in clusters(table, 0.9).collect()} == root


def slow_in_order(rows, threshold):
    """Chunk after chunk of each bank."""
    kept = []
    for c in sorted({r[2] for r in rows}):
        new = [r for r in rows if r[2] == c]
        kept += [r for r in new if not any(r[1] == k[1] and float(np.dot(r[3], k[3]) / (np.linalg.norm(r[3]) * np.linalg.norm(k[3]))) >= threshold for k in kept)]
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_in_order_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, b, rng.randrange(9), v) for i, b, v in groups(seed, 250, spread=0.09)]
    facts = spark.createDataFrame(rows, "fact_id long, bank_id long, chunk int, embedding array<double>")
    got = sorted(r.fact_id for r in resolve.dedup_in_order(facts, 0.9).collect())
    assert got == slow_in_order(rows, 0.9) and 0 < len(got) < len(rows)


def test_dedup_in_order_of_a_long_chain(spark):
    """Each fact is near the one before only, so every other one stays."""
    angle = lambda i: [float(np.cos(0.3 * i)), float(np.sin(0.3 * i))]
    rows = [(i, 0, i, angle(i)) for i in range(9)] + [(50, 0, 3, None)]
    facts = spark.createDataFrame(rows, "fact_id long, bank_id long, chunk int, embedding array<double>")
    assert sorted(r.fact_id for r in resolve.dedup_in_order(facts, 0.95).collect()) == [0, 2, 4, 6, 8, 50]
    stored = spark.createDataFrame([(100, 0, angle(0))], "fact_id long, bank_id long, embedding array<double>")
    assert sorted(r.fact_id for r in resolve.dedup_in_order(facts, 0.95, stored).collect()) == [2, 4, 6, 8, 50]


def slow_resolve(mentions, entities, confirm):
    """One mention after another, as they come."""
    store = {b: [dict(e, aliases=list(e["aliases"])) for e in entities if e["bank"] == b] for b in {m[0] for m in mentions} | {e["bank"] for e in entities}}
    cos = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
    cache, out = {}, {}
    for bank, mention, place, vector in sorted(mentions, key=lambda m: m[2]):
        key = (bank, mention.strip().lower())
        if key not in cache:
            own = sorted(store[bank], key=lambda e: (e["name"], e["id"]))
            exact = [e for e in own if mention == e["name"] or mention in e["aliases"]]
            best = max(own, key=lambda e: cos(e["v"], vector), default=None)
            score = cos(best["v"], vector) if best else 0.0
            if exact:
                cache[key] = (min(e["id"] for e in exact), "exact")
            elif best and (score >= 0.9 or score >= 0.75 and confirm(mention, best["name"])):
                best["aliases"].append(mention)
                cache[key] = (best["id"], "accept" if score >= 0.9 else "ask")
            else:
                new = {"bank": bank, "id": f"new {bank} {key[1]}", "name": mention, "aliases": [], "v": vector}
                store[bank].append(new)
                cache[key] = (new["id"], "create")
        out[place] = cache[key]
    return out, {(e["id"], e["name"]): e["aliases"] for b in store for e in store[b]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_in_order_equals_a_loop(spark, seed):
    rng, rows = random.Random(seed), groups(seed + 10, 90, centers=9, spread=0.12)
    entities = [{"bank": b, "id": f"e{i}", "name": f"Name {i}", "aliases": [f"alias{i}"], "v": v} for i, b, v in rows[:8]]
    mentions = [(b, f" Term{i % 60} " if rng.random() < 0.5 else f"term{i % 60}", i, v) for i, b, v in rows[8:]]
    mentions += [(e["bank"], rng.choice([e["name"], e["aliases"][0], e["name"].lower()]), 200 + i, rows[i][2]) for i, e in enumerate(entities)]
    vector_of = {}
    mentions = [(b, m, p, vector_of.setdefault((b, m.strip().lower()), v)) for b, m, p, v in mentions]
    yes = lambda mention, name: (len(mention) + ord(name[-1])) % 2 == 0
    want, left = slow_resolve(mentions, entities, yes)
    m = spark.createDataFrame(mentions, "bank_id long, mention string, place long, embedding array<double>")
    e = spark.createDataFrame([(x["bank"], x["id"], x["name"], "person", x["aliases"], x["v"]) for x in entities], "bank_id long, entity_id string, name string, entity_type string, aliases array<string>, embedding array<double>")
    new_id = lambda bank, mention: F.concat(F.lit("new "), bank.cast("string"), F.lit(" "), F.lower(F.trim(mention)))
    confirm = lambda mention, name: (F.length(mention) + F.ascii(F.substring(name, -1, 1))) % 2 == 0
    resolved = resolve.resolve_in_order(m, e, confirm, new_id).cache()
    got = {r.place: (r.entity_id, r.tier) for r in resolved.collect()}
    assert got == want and {t for _, t in got.values()} == {"exact", "accept", "ask", "create"}
    after = resolve.with_aliases(e, resolved)
    assert {(r.entity_id, r.name): r.aliases for r in after.collect()} == left


def test_mentions_map_to_ids_in_their_order(spark):
    resolved = spark.createDataFrame([(0, "b", 0, 5), (0, "a", 1, 9), (1, "a", 2, 7)], "bank_id long, mention string, place long, entity_id long")
    facts = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 2, 0, "a"), (2, 0, 1, "a"), (3, 0, 0, "unknown")], "fact_id long, at int, bank_id long, mention string")
    assert {r.fact_id: r.entity_ids for r in resolve.entity_ids_of(facts, resolved).collect()} == {1: [9, 5, 9], 2: [7]}


def test_resolution_of_nothing(spark):
    m = spark.createDataFrame([(0, "a", 0, [1.0, 0.0]), (0, None, 1, None), (0, "A ", 2, [0.0, 1.0])], "bank_id long, mention string, place long, embedding array<double>")
    none = spark.createDataFrame([], "bank_id long, entity_id long, name string, entity_type string, aliases array<string>, embedding array<double>")
    got = {r.place: (r.entity_id, r.tier) for r in resolve.resolve_in_order(m, none).collect()}
    assert got[0] == got[2] and got[0][1] == got[1][1] == "create"
    assert not resolve.resolve_in_order(m.limit(0), none).collect()


def test_blocks_are_bounded_and_null_groups_are_groups(spark, monkeypatch):
    """Vectors without structure are one cell of many blocks; a group of rows is two blocks, floats are moved as floats, and no vector goes to more groups than there are blocks."""
    monkeypatch.setattr(pairs, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 2 else 0, rng.normal(size=32).astype(np.float32).tolist()) for i in range(500)]
    table = spark.createDataFrame(rows, VECTORS.replace("double", "float"))
    assert found(pairs.similar(table, table, 0.4, "bank", ordered=True)) == slow(rows, rows, 0.4, True, ordered=True)
    met = pairs._met(table, table, 0.4, "bank", True)
    sizes = met.groupBy(*pairs._MEETING).count().agg(F.max("count"), F.sum("count")).first()
    assert met.schema["embedding"].dataType.elementType.typeName() == "float" and sizes[0] <= 2 * 2 * 64 and sizes[1] <= 500 * 6


def test_mentions_near_a_stored_entity_wait_for_nobody(spark, monkeypatch):
    """A long chain of mentions that are all near an entity takes no round for each of them."""
    cuts, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: cuts.append(1) or cut(df))
    m = spark.createDataFrame([(0, f"m{i}", i, [1.0, 0.001 * i]) for i in range(16)], "bank_id long, mention string, place long, embedding array<double>")
    e = spark.createDataFrame([(0, 7, "Name", [], [1.0, 0.0])], "bank_id long, entity_id long, name string, aliases array<string>, embedding array<double>")
    assert {(r.entity_id, r.tier) for r in resolve.resolve_in_order(m, e).collect()} == {(7, "accept")} and len(cuts) < 25


def test_copies_of_a_vector_meet_once_in_dedup_in_order(spark, monkeypatch):
    """Each vector is compared once a bank, however many facts have it; copies go with what an earlier chunk says."""
    rng = np.random.default_rng(5)
    base = [v for _, _, v in groups(5, 30, spread=0.09)] + [[0.0] * 16, [float("nan")] + [1.0] * 15]
    rows = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 5)), base[int(rng.integers(0, len(base)))]) for i in range(600)] + [(900, 0, 1, None), (901, 0, 2, None)]
    compared, join = [], resolve.similar
    monkeypatch.setattr(resolve, "similar", lambda a, b, *more, **named: compared.append(a.where("embedding[1] <> 0 and not isnan(embedding[0])").count()) or join(a, b, *more, **named))
    facts = spark.createDataFrame(rows, "fact_id long, bank_id long, chunk int, embedding array<double>")
    got = sorted(r.fact_id for r in resolve.dedup_in_order(facts, 0.9).collect())
    with np.errstate(invalid="ignore"):
        assert got == slow_in_order([r if r[3] else (*r[:3], [0.0] * 16) for r in rows], 0.9)
    assert compared[-1] <= 60


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_a_block_meets_another_in_cells(threshold):
    x, y = (np.array([v for _, _, v in groups(seed, n, spread=0.2)]) for seed, n in ((6, 700), (6, 5000)))
    x, y = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    met = list(pairs._near(x, y, threshold))
    got = sorted(p for i, j, _ in met for p in zip(i.tolist(), j.tolist()))
    assert got == sorted(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= threshold)))) and got
    assert all(np.allclose(score, (x[i] * y[j]).sum(1), atol=1e-12) for i, j, score in met)


def test_blocks_are_written_once_and_read_by_what_compares_them(spark, monkeypatch):
    """No vector is copied or shuffled for each block that it meets: the plan that compares holds places of blocks only."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(pairs, "BLOCK", 32)
    vectors = rng.normal(size=(600, 8))
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "id long, bank long, embedding array<double>")
    written, stored = [], pairs._stored
    monkeypatch.setattr(pairs, "_stored", lambda rows: written.append(stored(rows)) or written[-1])
    near = pairs.similar(table, table, 0.5, "bank", ordered=True)
    places = [r for df in written for r in df.collect()]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = unit @ unit.T
    assert {(r.a, r.b) for r in near.collect()} == {(i, j) for i, j in zip(*np.nonzero(cosines >= 0.5)) if i < j}
    assert len(places) > 10 and len({(r.file, r.offset) for r in places}) == len(places)
    assert "embedding" not in near._jdf.queryExecution().toString()
