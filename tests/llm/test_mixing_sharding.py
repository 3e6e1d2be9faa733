import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import mixing, sharding


def make(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.withColumns({"SIZE": F.lit("x"), "pieces": F.lit(1), "__start": F.lit(0), "__n": F.lit("k")}) if extra else df


def corpus(n=300):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 4}", " ".join(f"w{k}" for k in range(int(rng.integers(0, 400))))) for i in range(n)]
    return rows + [(9001, None, "a b c " * 200), (9002, "s0", None), (9003, "s0", ""), (None, "s1", "one two"), (5, "s1", "x\ty"), (5, "s1", "x\ty")]


def test_targets_reshare_what_is_above():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.targets([], [], 0, 2) == []
    assert mixing.targets([1, 100, 100], [3, 1, 2], 301.5, 2) == pytest.approx([2, 299.5 / 3, 599 / 3])


@pytest.mark.parametrize("shards", [1, 2, 13, 64])
def test_the_tree_splits_quotas_exactly_and_by_the_hypergeometric_law(shards):
    quotas = np.array([7, 0, 900, 31])
    parts = mixing.Tree(quotas, shards, 0).leaves()
    assert parts.shape == (shards, 4) and (parts >= 0).all() and (parts.sum(0) == quotas).all()
    assert parts.sum(1).max() - parts.sum(1).min() <= 8
    many = np.array([mixing.Tree(quotas, 4, seed).leaves()[2] for seed in range(400)])
    assert many.mean(0) == pytest.approx(quotas / 4, abs=1) and 3 < many[:, 3].var() < 8  # without replacement: below the binomial's, of equal draws


def test_nodes_are_the_same_whether_remembered_or_not(monkeypatch):
    quotas, rng = np.array([500, 20, 0, 77]), np.random.default_rng(2)
    source = rng.choice([0, 1, 3], 300, p=[0.8, 0.05, 0.15])
    at = (rng.random(300) * quotas[source]).astype(np.int64)
    whole = mixing.Tree(quotas, 37, 5).shard(source, at)
    monkeypatch.setattr(mixing, "NODES", 0)
    assert mixing.Tree(quotas, 37, 5).shard(source, at).tolist() == whole.tolist()
    one = [int(mixing.Tree(quotas, 37, 5).shard(source[i : i + 1], at[i : i + 1])[0]) for i in range(50)]
    assert one == whole[:50].tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations_are_permutations_and_differ_by_key(n):
    k, full = np.arange(n), np.full(n, n)
    own = [mixing.permuted(k, full, np.full(n, key, np.uint64)) for key in (1, 2)]
    assert all(sorted(x.tolist()) == list(range(n)) for x in own)
    if n > 16:
        assert (own[0] == own[1]).sum() < 10 and (np.diff(own[0]) == np.diff(own[0])[0]).mean() < 0.1


@pytest.mark.parametrize("extra", [False, True])
def test_mix_meets_targets_and_draws_disjoint_pieces(spark, extra):
    rows = corpus()
    out = mixing.mix(make(spark, rows, extra), shards=5, block_words=16).collect()
    assert len(out) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        assert r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.pieces)
        spans = defaultdict(list)
        for p in r.pieces:
            assert 0 <= p.shard < 5 and 0 <= p.first and p.first + p.words <= r.size
            spans[p.turn].append((p.first, p.first + p.words))
        for own in spans.values():
            own.sort()
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    for s in size:
        assert taken[s] == math.floor(target[s] + 1e-9), s
        assert target[s] <= 2 * size[s] + 1e-9
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix(make(spark, rows[::-1], extra), shards=5, block_words=16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken, str(r.pieces))
    assert sorted(map(key, out)) == sorted(map(key, again))


def slow_mix(docs, weights, share, most, shards, seed, block):
    """Every word of every stream, block by block: {(doc, copy): [(shard, turn, block, first, words)]}; docs are (name, source, place, size)."""
    names = sorted({s for _, s, _, _ in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, _, n in docs if x == s) for s in names}
    mixture = mixing.plan(list(total.items()), weights, share, most, shards, seed, block)
    leaf = mixing.Tree(mixture["draws"].sum(1), shards, seed).leaves()
    out = defaultdict(list)
    for i, s in enumerate(names):
        stream = [(name, w) for name, x, _, n in sorted((d for d in docs if d[1] == s), key=lambda d: d[2]) for w in range(n)]
        blocks = [stream[at : at + block] for at in range(0, len(stream), block)]
        order = [shard for shard in range(shards) for _ in range(leaf[shard, i])]
        want, drawn = math.floor(mixture["targets"][i] + 1e-9), 0
        for turn in range(most):
            left = min(len(stream), want - turn * len(stream))
            at = {int(p): k for k, p in enumerate(mixing.permuted(np.arange(len(stream) // block), np.full(len(stream) // block, len(stream) // block), np.full(len(stream) // block, mixture["keys"][i, turn])))}
            for p in range(len(blocks)):
                if left <= 0:
                    break
                for name, w in blocks[at.get(p, p)][:left]:
                    if out[name] and out[name][-1][:3] == [order[drawn], turn, at.get(p, p)]:
                        out[name][-1][4] += 1
                    else:
                        out[name].append([order[drawn], turn, at.get(p, p), w, 1])
                left -= len(blocks[at.get(p, p)][:left])
                drawn += 1
    return {k: sorted(map(tuple, v), key=lambda p: p[1:3]) for k, v in out.items()}


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_pieces_equal_those_of_a_walk_over_every_word(shards):
    rng = np.random.default_rng(shards)
    docs, place = [], Counter()
    for i in range(120):
        s, n = [None, "a", "b", "c"][int(rng.integers(0, 4))], int(rng.integers(0, 90))
        docs.append((i, s, place[s], n))
        place[s] += n
    want = slow_mix(docs, (3, 1, 2), 1.5, 2, shards, 7, 16)
    mixture = mixing.plan(list(place.items()), (3, 1, 2), 1.5, 2, shards, 7, 16)
    number = {s: i for i, s in enumerate(mixture["sources"])}
    found = mixing.pieces(mixture, mixing.Tree(mixture["draws"].sum(1), shards, 7), *(np.array(x) for x in ([number[s] for _, s, _, _ in docs], [p for _, _, p, _ in docs], [n for *_, n in docs])))
    got = defaultdict(list)
    for row, *piece in zip(*(x.tolist() for x in found)):
        got[row].append(tuple(piece))
    assert got == {k: v for k, v in want.items() if v}


def test_rows_repeated_very_often_are_dealt_like_others(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 8)
    rows = [(1, "a", "x y z")] * 100 + [(2, "b", "w " * 50)]
    out = mixing.mix(make(spark, rows), shards=3, block_words=5).collect()
    assert len(out) == 101 and sorted(r.copy for r in out if r.doc_id == 1) == list(range(100))
    assert sum(r.taken for r in out) == math.floor(out[0].target if out[0].source == "a" else 525 - out[0].target) + math.floor(525 - out[0].target if out[0].source == "a" else out[0].target)


def test_deal_gives_the_drawn_words_by_shard(spark):
    docs = make(spark, corpus(80)).withColumns({"n_chars": F.char_length("text").cast("long"), "COPY": F.lit("x"), "target": F.lit(2), "__shard": F.lit(3)})
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), shards=9, block_words=16).collect()
    wanted = Counter()
    for r in mixed:
        for p in r.pieces:
            wanted[p.shard] += p.words
    assert len(wanted) == 9 and max(wanted.values()) - min(wanted.values()) <= 16 * 9
    out = mixing.deal(docs, shards=9, block_words=16)
    assert out.schema.names == docs.schema.names
    got = out.collect()
    assert sum(len(r.text.split()) for r in got) == sum(wanted.values())
    assert all(r.n_chars == len(r.text) and r.COPY == "x" and r.target == 2 for r in got)
    by = defaultdict(lambda: [0, 0])
    for r in mixed:
        for p in r.pieces:
            by[r.doc_id, p.shard, p.turn][0] += p.words
    rows = Counter((r.doc_id, len(r.text.split())) for r in got)
    assert sum(rows.values()) >= len(by) and {k[0] for k in by} == {k[0] for k in rows}
    assert sorted(map(str, got)) == sorted(map(str, mixing.deal(docs, shards=9, block_words=16).collect()))
    assert mixing.deal(docs.limit(0)).count() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    only = mixing.mix(make(spark, [(1, None, None)])).collect()
    assert [(r.size, r.taken) for r in only] == [(0, 0)]


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop_and_only_new_shards_gain():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert [jump_by_hand(int(k) % 2**64, 24) for k in keys] == a.tolist()
    moved = a != b
    assert (b[moved] == 24).all() and 60 < moved.sum() < 180
    assert sharding.jump(np.zeros(0, np.int64), 3).tolist() == []


def test_slots_are_gapless_whatever_repeats(spark, monkeypatch):
    rows = [(i, "s", f"t{i}") for i in range(200)] + [(7, "s", "same")] * 50 + [(None, None, None)] * 3
    out = sharding.slotted(make(spark, rows)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(8, 0)}
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    monkeypatch.setattr(sharding, "TOGETHER", 7)
    small = sharding.slotted(make(spark, rows)).collect()
    assert all(sorted(r.slot for r in small if r.shard == s) == list(range(len(v))) for s, v in by.items())
    assert sharding.slotted(make(spark, [])).count() == 0
