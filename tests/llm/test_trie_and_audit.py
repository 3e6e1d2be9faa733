import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from memspark.llm import audit, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def slow_rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(head, [])[:h] + own[c][h:]
    return out


def slow_trie(convs):
    """Every node as the sequence of its turns."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        stack, found = [path], []
        while stack:
            found.append(p := stack.pop())
            stack += children[p]
        return found

    rows = []
    for path, cs in members.items():
        sub = below(path)
        ends = sorted(c for c in cs if len(convs[c]) == len(path))
        rows.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children[path]), sum(not children[p] for p in sub),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in sub if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = [(5, 0, None, "a"), (5, 0, None, "a"), (5, None, "user", None), (None, 1, "user", "x"), (100, 1, "user", "very " * 5000), (-7, 0, "u", "é😀"), (-107, 1, "u", "é😀")]
    for c in [*range(0, 12), 100, 101, 199, 300, 305, -100, -150, 777]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "ab", "b", ""])))
    rows += [(1000, t, "user", str(t % 7)) for t in range(600)] + [(1001, t, "user", str(t % 7)) for t in range(550)]  # reaches over several ranges
    return rows


@pytest.mark.parametrize("prime", [None, 31])
def test_trie_equals_brute_force(spark, monkeypatch, prime):
    """With a tiny prime nearly all fingerprints collide at first, and collisions are split until all is verified."""
    if prime:
        monkeypatch.setattr(prefix_trie, "PRIME", prime)
        monkeypatch.setattr(prefix_trie, "POINTS", 2)
    rows = conversations(1)
    random.Random(2).shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).withColumn("DEPTH", F.lit(3)).withColumn("fp", F.lit("x"))
    assert found(prefix_trie.trie(*prefix_trie.rebuilt(turns))) == slow_trie(slow_rebuilt(rows))


def test_small_tries(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert found(prefix_trie.trie(*prefix_trie.rebuilt(nothing))) == []
    nobody = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert found(prefix_trie.trie(*prefix_trie.rebuilt(nobody))) == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)  # loses its only turn, and its base is missing
    rows = [(c, None, None, None)]
    assert found(prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS)))) == slow_trie({c: []})


def test_rolling_combines_ranges(spark):
    rows = [(1, t, "u", f"{t}") for t in range(500)] + [(2, t, "u", f"{t}") for t in range(500)]
    turns = spark.createDataFrame(rows, TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.rolled(turns, [F.col("turn")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.place == r.turn + 1 for r in got)
    by = {(r.conv_id, r.place): r for r in got}
    assert all(by[1, i].fp == by[2, i].fp and by[1, i].prev == by[1, i - 1].fp for i in range(2, 501))


def slow_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    split = lambda x: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x) if w]
    least = {}
    for i, _, x in docs:
        if i is not None:
            least[x or ""] = min(least.get(x or "", i), i)
    rows = []
    for i, s, x in docs:
        x = x or ""
        w = split(x)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in x) > 2 * len(x),
            "D": any(c in "#$%&*|" for c in x), "E": i is not None and i > least[x],
        }
        rows.append((s or "", {k for k in fails if fails[k]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                stay = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                total[f] += len(gone)
                left = stay
        for k, v in out.items():
            if k[0] == part:
                v[6] = total.get(v[6], v[6])
    return out


def documents():
    rng = random.Random(4)
    texts = [
        None, "", " \t\n", "one two", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 90}" for i in range(220)), " ".join(f"W{i}" for i in range(210)),
        " ".join(f"w{i}" for i in range(199)) + " #", " ".join(f"w{i}" for i in range(50_000)), "a b " * 250, "x" * 300_000, " ".join(["w", "W"] * 100 + [f"v{i}" for i in range(98)]),
    ]
    rows = [(i, rng.choice(["s", "s", "t", None, ""]), rng.choice(texts)) for i in range(120)]
    return rows + [(3, "s", texts[4]), (3, "s", texts[4]), (None, "t", texts[4]), (None, None, None), (999, "u", "only one")]


def test_audit_equals_brute_force(spark):
    docs = documents()
    labels = [(i, i % 2, i % 3 and 1) for i in range(0, 120, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (5000, 1, 1), (7, None, None)]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"PART": F.lit("x"), "failed": F.lit(1), "Digest": F.lit("y")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(""))
    got = audit.audit(table, marks).collect()
    want = slow_audit(docs, labels)
    assert len(got) == len(want) == 600 * len({k[0] for k in want})
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_shapley_is_efficient(spark):
    docs = documents()
    table = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = audit.audit(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    sums = got.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r"), F.max("good_lost").alias("g")).collect()
    assert all(x.s == 120 * x.r and x.g == 0 for x in sums)


def test_audit_of_nothing(spark):
    assert audit.audit(spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
