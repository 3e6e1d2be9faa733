import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import components, shingles, simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, most=4):
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= most:
                x, y = root[a], root[b]
                low, high = min(x, y), max(x, y)
                root = {k: low if v == high else v for k, v in root.items()}
    return root


@given(st.text(alphabet="aB c\t\nÄé\u00a0", max_size=200))
@settings(max_examples=60, deadline=None)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)) + "x" * 500
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(shingles, "_CHUNK", 64)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


def test_plan_obeys_the_general_pigeonhole_principle():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sample[:500] = sample[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    for n in (100, 10**5, 10**8, 10**11):
        plan = simhash.plan(sample, n, 4)
        assert sum(t + 1 for _, t in plan) == 5
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))


@pytest.mark.parametrize("tile", [4096, 5])
@pytest.mark.parametrize("thresholds", [None, [(range(0, 32), 2), (range(32, 64), 1)]])
def test_links_connect_what_all_links_connect(spark, monkeypatch, tile, thresholds):
    monkeypatch.setattr(simhash, "TILE", tile)
    if thresholds:
        monkeypatch.setattr(simhash, "plan", lambda *_: [(list(g), t) for g, t in thresholds])
    rng = random.Random(3)
    fps = {0}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(8):  # a chain of near fingerprints
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    found = edges.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)) for r in found)
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = slow_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    whole = {f: f for f in fps} | {k % 2**64: v % 2**64 for k, v in got.items()}
    assert groups(whole) == groups(want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(121)} | {500: 500, 501: 500}
    assert components.components(edges.limit(0)).count() == 0


def documents(spark):
    base = " ".join(f"word{i} and{i}" for i in range(400))
    rows = [(3, base), (9, base), (4, base.replace("word7 ", "other ")), (12, "alone here with nobody near by"), (20, None), (21, ""), (22, " \t"), (None, base), (9, base), (30, "x"), (31, "X")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "component_id": F.lit("clash")})


def test_near_duplicates_of_odd_rows(spark):
    out = simhash.near_duplicates(documents(spark)).collect()
    assert len(out) == 11
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [by[i].component_id for i in (3, 4, 9, 12, 20, 21, 22, 30, 31)] == [3, 3, 3, 12, 20, 20, 20, 30, 30]
    assert by[20].fingerprint == "0" * 16 and {r.component_id for r in out if r.doc_id is None} == {3}
    assert all(r.fingerprint == f"{slow_fingerprint(t):016x}" for r, t in ((by[3], documents(spark).first().text),))
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 12, 20, 30]


def test_keep_one_loses_no_text(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (5, a, 3), (9, b, 4), (None, a, 5), (None, c, 6), (None, c, 6), (7, None, 7), (8, [], 8)]
    docs = spark.createDataFrame([(i, " ".join(t) if t is not None else None, k) for i, t, k in rows], "doc_id long, text string, __KEPT long").withColumn("__first", F.lit(1)).withColumn("key", F.lit("x"))
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    got = [kept.collect() for _ in range(2)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:2]) for r in got[0]) == [(-1, "c0"), (5, "a0"), (5, "b0"), (7, "")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def slow_kept(rows):
    """Least ids of the components of five-word shingle sets with a Jaccard similarity of 0.8 or more."""

    def grams(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(i, grams(t)) for i, t in rows]
    root = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
    return sorted(min(sets[i][0] for i in range(len(sets)) if root[i] == r) for r in set(root))


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return words


def test_keep_one_finds_every_edited_copy(spark):
    rng, rows = random.Random(3), []
    line = [f"line{i}" for i in range(12)]
    for g in range(12):
        base = line + [rng.choice(["a", "b", "c", "d"]) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 260))]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 20))) for _ in range(5)]
    chain = [f"c{i}" for i in range(200)]  # each a near copy of the one before, the ends far apart
    for _ in range(8):
        chain = edited(rng, chain, 3)
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == slow_kept(rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    assert len(kept) < len(set(slow_components(fps).values()))
