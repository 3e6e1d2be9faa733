import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import odd_sketch

DOCS = "doc_id long, text string"


def slow_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def slow(rows, alike=85):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= alike * len(x | y) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def near_copies(seed, n=8, words=(6, 160)):
    """Groups of texts from few edits to many, so that similarities fall on both sides of the limit."""
    rng = random.Random(seed)
    rows = [(-1, None), (-2, ""), (-3, " \t\n"), (None, None), (None, "one two three"), (-4, "One  two\tTHREE"), (-4, "One  two\tTHREE"), (-5, "É a b c d"), (-6, "é a b c d"), (-7, "w " * 30_000)]
    for g in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(*words))]
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((100 * g + k, " ".join(copy) + rng.choice(["", "\n", " "])))
            base = copy if rng.random() < 0.4 else base  # chains as well as stars
    return rows


@pytest.mark.parametrize("tile", [2048, 3])
@pytest.mark.parametrize("alike", [85, 80])
def test_components_equal_brute_force(spark, monkeypatch, tile, alike):
    monkeypatch.setattr(odd_sketch, "TILE", tile)
    rows = near_copies(tile + alike)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"NODE": F.lit(1), "Key": F.lit("x"), "at": F.lit(2)})
    assert got(odd_sketch.near_duplicates(docs, alike)) == sorted(slow(rows, alike), key=str)


def test_stock_sentences_are_compared_exactly(spark, monkeypatch):
    """Texts of few stock sentences share many shingles without being alike; bands of one sample make nearly all of them meet."""
    monkeypatch.setattr(odd_sketch, "ROWS", 1)
    rng = random.Random(8)
    stock = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(14)]
    rows = [(i, " ".join(rng.sample(stock, 8))) for i in range(150)]
    assert got(odd_sketch.near_duplicates(spark.createDataFrame(rows, DOCS))) == sorted(slow(rows), key=str)


def test_meetings_of_stock_sentences_grow_no_faster_than_texts(spark, monkeypatch):
    """What bands let meet, summed over tiles, of texts of 5 out of 60 stock sentences."""
    rng = random.Random(3)
    stock = [" ".join(f"s{i}w{rng.randrange(10**6)}" for _ in range(12)) for i in range(60)]
    made = []
    for n in (500, 2000):
        rows = [(i, " ".join(rng.sample(stock, 5)) + f" own{i} words{i} of{i} text{i} here{i}") for i in range(n)]
        nodes = odd_sketch.signed(spark.createDataFrame(rows, DOCS), odd_sketch.bands(85, 100)).select("doc_id", F.explode("keys").alias("key"))
        made.append(nodes.groupBy("key").count().select(F.sum(F.expr("count * (count - 1) div 2"))).first()[0])
    assert made[1] < 4 * 4 * max(made[0], 500) and made[1] < 0.05 * 2000 * 2000 / 2


def test_sketches_let_all_links_pass():
    """Of pairs at the least similarity none shares no band, and none differs in more bits than the limit; far pairs do."""
    rng = np.random.default_rng(1)
    k, most = odd_sketch.bands(85, 100) * odd_sketch.ROWS, odd_sketch.limit(85, 100)
    for alike, near in ((0.85, True), (0.3, False)):
        for _ in range(150):
            both, each = int(400 * alike), (400 - int(400 * alike)) // 2
            x = rng.integers(0, 2**63, both + 2 * each, dtype=np.uint64)
            a, b = odd_sketch.samples(x[: both + each], k), odd_sketch.samples(np.concatenate([x[:both], x[both + each :]]), k)
            differ = int(np.bitwise_count(odd_sketch.odd_sketch(a) ^ odd_sketch.odd_sketch(b)).sum())
            assert (differ <= most) == near
            if near:
                assert np.intersect1d(odd_sketch.keys(a), odd_sketch.keys(b)).size


def test_whole_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    rng, rows, want = np.random.default_rng(0), [], []
    for n in (1, 70, 500, 520, 1100, 3000):
        for share in (0.8, 0.95, 1.0):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[: int(share * len(x))], rng.integers(0, 2**63, int((1 - share) * n) + n // 20).astype(np.uint64)]))
            rows += [odd_sketch.whole_sketch(x), odd_sketch.whole_sketch(y)]
            want.append(len(np.setxor1d(x, y)))
    sizes = np.array([len(r) for r in rows])
    p = np.arange(0, len(rows), 2)
    got = odd_sketch.differences(np.concatenate(rows), np.cumsum(sizes) - sizes, sizes, p, p + 1)
    assert (got <= want).all() and (got > np.array(want) / 2).any() and len(set(sizes)) > 3 and (sizes[p] != sizes[p + 1]).any()


def test_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = odd_sketch.samples(x[:2000], 2000), odd_sketch.samples(x[1000:], 2000)
    assert abs((a == b).mean() - 1 / 3) < 0.05


def test_nothing_and_nulls(spark):
    assert got(odd_sketch.near_duplicates(spark.createDataFrame([], DOCS))) == []
    rows = [(None, None), (None, "a b c d e f"), (3, None)]
    assert got(odd_sketch.near_duplicates(spark.createDataFrame(rows, DOCS))) == sorted([(None, 0, None, True), (None, 2, None, True), (3, 0, 3, True)], key=str)
