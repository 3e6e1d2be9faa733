r"""Conversation prefix trie by polynomial rolling fingerprints (operator 11).

A node is a sequence of first turns that conversations share. A conversation's prefixes have fingerprints that roll on turn by
turn: F(d) = F(d - 1) + hash(turn d) * B^(d - 1) modulo a prime, at several points B at once. Turns are sorted in ranges, and each
task scans its range with numpy; where a conversation goes on in the next range, what the ranges before it have summed
up to is added afterwards, since fingerprints of two pieces combine to that of the whole. So no conversation is gathered in one task.

Prefixes of one length and fingerprint are a candidate node. Its conversations are verified turn by turn against its least one: at
every node all must have the same last turn and come from the same node. By induction on the length nodes that pass are exact. If any
fails, fingerprints of other hashes and points are put beside the old ones, which split collisions, and all is verified again.

Sums over subtrees go to parents by doubling: after k rounds a node has the sum over what is less than 2^k levels below it, so
rounds are as the logarithm of the depth. Nodes of a single conversation need none: below them is one leaf and nothing to save.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: The prime, and how many points a round of fingerprints has.
PRIME, POINTS = (1 << 31) - 1, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def points(salt: int, prime: int = PRIME) -> list[int]:
    """The points of a round, from 2 on, drawn by its salt."""
    return [2 + int.from_bytes(hashlib.sha256(f"{salt}:{i}".encode()).digest()[:8], "big") % (prime - 3) for i in range(POINTS)]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(20)


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo the prime."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def rolled(turns: DataFrame, order: list[Column], salt: int = 0) -> DataFrame:
    """turns (conv_id, not null, role, text) with place, from 1 in their order within conv_id, fp and prev, the fingerprints up to and before each turn.

    Equal turns of one conv_id that the order doesn't tell apart are numbered in any order.
    """
    prime, bases, n = PRIME, points(salt), POINTS
    hashed = turns.withColumn("__hash", F.xxhash64(F.lit(salt), "role", "text")).repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    own = [f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, count, sums = TaskContext.get().partitionId(), None, 0, [0] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            c, h = batch.column("conv_id").to_numpy(), batch.column("__hash").to_numpy().view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            start = np.repeat(first, np.diff(np.append(first, len(c))))
            at = np.arange(len(c)) - start
            goes_on = (c == conv) & (start == 0) if conv is not None else np.zeros(len(c), bool)
            place = at + 1 + np.where(goes_on, count, 0)
            after, before = [], []
            for i, base in enumerate(bases):
                terms = (_mixed(h, i) % np.uint64(prime)).astype(np.int64) * _powers(base, int(at.max()) + 1, prime)[at] % prime
                run = np.cumsum(terms)
                run -= np.repeat(run[first] - terms[first], np.diff(np.append(first, len(c))))
                lead, shift = (sums[i], pow(base, count, prime)) if goes_on[0] else (0, 1)
                for out, x in ((after, run), (before, run - terms)):
                    x %= prime
                    out.append(np.where(goes_on, (lead + x * shift) % prime, x))
            conv, count, sums = c[-1], int(place[-1]), [int(x[-1]) for x in after]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(x, 1).ravel()), n).cast(pa.list_(pa.int64())) for x in (after, before)]
            kept = [batch.column(f.name) for f in batch.schema if f.name != "__hash"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(c), part, np.int32)), pa.array(place), *lists], names=[*(f.name for f in batch.schema if f.name != "__hash"), "part", "place", "fp", "prev"])

    pieces = cut(hashed.mapInArrow(apply, ", ".join([*own, "part int, place long, fp array<long>, prev array<long>"])), "rolled")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count, sums = 0, [0] * n
                for r in ranges:
                    if count:
                        rows.append({"conv_id": conv, "part": r["part"], "count": count, "sums": sums, "shifts": [pow(b, count, prime) for b in bases]})
                    sums = [(s + pow(b, count, prime) * x) % prime for s, b, x in zip(sums, bases, r["fp"])]
                    count += r["place"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64())), ("shifts", pa.list_(pa.int64()))]))

    # a conversation has a row here for each range that it reaches into, as many as there are tasks at most
    ends = pieces.groupBy("conv_id", "part").agg(F.max(F.struct("place", "fp")).alias("end")).select("conv_id", "part", "end.*")
    lists = ends.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "fp"))).alias("ranges")).where("size(ranges) > 1")
    moves = lists.mapInArrow(combined, "conv_id long, part int, count long, sums array<long>, shifts array<long>")
    moved = lambda x: F.when(F.col("count").isNull(), F.col(x)).otherwise(F.expr(f"transform({x}, (x, i) -> (sums[i] + shifts[i] * x) % {prime}L)"))
    found = pieces.join(moves, ["conv_id", "part"], "left")
    return found.select(*turns.columns, (F.col("place") + F.coalesce("count", F.lit(0))).alias("place"), moved("fp").alias("fp"), moved("prev").alias("prev"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, fp, prev and chars of each turn of turns (conv_id, place, role, text), place from 1 without gaps; fingerprints
    tell all different prefixes apart, which is verified turn by turn."""
    bare, salt, known = turns.select("conv_id", "place", "role", "text"), 0, None
    while True:
        now = rolled(bare.withColumnRenamed("place", "depth"), [F.col("depth")], salt).drop("place")
        if known is not None:
            old = known.select("conv_id", "depth", F.col("fp").alias("__fp"), F.col("prev").alias("__prev"))
            now = now.join(old, ["conv_id", "depth"]).select("conv_id", "depth", "role", "text", F.concat("__fp", "fp").alias("fp"), F.concat("__prev", "prev").alias("prev"))
        known = cut(now, "prefixes")
        shared = known.groupBy("depth", "fp").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # the representative's turn is among those compared, so one least and greatest turn means that all equal it
        turn = F.struct("prev", "role", "text")
        differ = known.join(shared.select("depth", "fp"), ["depth", "fp"], "left_semi").groupBy("depth", "fp").agg(F.min(turn).alias("low"), F.max(turn).alias("high")).where("low <> high")
        if differ.isEmpty():
            return known.select("conv_id", "depth", "fp", "prev", F.char_length("text").cast("long").alias("chars"))
        salt += 1


def _subtrees(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens of the nodes of several conversations; nodes: conv_id, depth, parent_conv_id, n_children, n_convs, saved."""
    single = nodes.where("n_convs = 1").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("alone"))
    own = nodes.where("n_convs > 1").join(single, ["conv_id", "depth"], "left")
    at = cut(own.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), (F.coalesce("alone", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), F.col("saved").alias("saved_tokens")), "subtrees")
    reach = 1
    while not at.where("up is not null").isEmpty():
        sums = at.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        above = at.where("up is not null").select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("next"))
        moved = at.join(sums, ["conv_id", "depth"], "left").join(above, ["up", "depth"], "left")
        last, at = at, cut(moved.select("conv_id", "depth", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "subtrees")
        discard(last)
        reach *= 2
    return at.drop("up")


def _digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256, the hash of the members of each group of ends (conv_id, depth, member), ascending and joined by
    commas. A group passes through one hash in order, as a hash of its whole list must, but is never held in memory."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            c, d, m = (batch.column(i).to_numpy() for i in range(3))
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])) if len(c) else np.zeros(0, np.int64)
            done = []
            for a, b in zip(first, np.append(first[1:], len(c))):
                if key != (c[a], d[a]):
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (c[a], d[a]), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, m[a:b].tolist())).encode())
            yield _rows(done)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    def _rows(done: list) -> pa.RecordBatch:
        c, d, s = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], names=["conv_id", "depth", "ends_sha256"])

    return ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member").mapInArrow(apply, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of turns (conv_id, place from 1 without gaps, role, text); conversations has all conv_ids, those without turns too.

    conv_id (the least member's), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each
    node, the root among them. Defined results: roles and texts must not be null; no conversations, no nodes; conversations
    without turns are members of the root alone; other columns aren't looked at.
    """
    rows = prefixes(turns)
    grouped = cut(rows.groupBy("depth", "fp").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("prev").alias("prev"), F.first("chars").alias("chars")), "nodes")
    every = conversations.select("conv_id").distinct()
    top = every.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    root = every.sparkSession.createDataFrame([(top.conv_id, top.n_convs)] if top.n_convs else [], "conv_id long, n_convs long")
    above = grouped.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    below = grouped.join(above, ["depth", "prev"], "left").withColumn("__root", F.lit(top.conv_id).cast("long"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    nodes = below.select("conv_id", "depth", F.coalesce("parent_conv_id", "__root").alias("parent_conv_id"), "n_convs", saved)
    nodes = nodes.unionByName(root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("saved")))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "fp")).alias("end")).select(F.col("conv_id").alias("member"), "end.*")
    ends = last.join(grouped.select("depth", "fp", "conv_id", "n_convs"), ["depth", "fp"]).select("conv_id", "depth", "member", "n_convs")
    turnless = every.withColumnRenamed("conv_id", "member").join(last.select("member"), "member", "left_anti")
    ends = cut(ends.unionByName(turnless.select(F.lit(top.conv_id).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "member", F.lit(top.n_convs).cast("long").alias("n_convs"))), "ends")
    several = _digests(ends.where("n_convs > 1").select("conv_id", "depth", "member"))
    hashes = several.unionAll(ends.where("n_convs = 1").select("conv_id", "depth", F.sha2(F.col("member").cast("string"), 256)))
    out = nodes.join(_subtrees(nodes), ["conv_id", "depth"], "left").join(hashes, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation c begins with the first h turns of that at c - c % block instead of its own, h = crc32(c) % most.

    Turns are in the order of turn (null first), role and text. Defined results: a null role or text is an empty one;
    repeated rows are turns of their own; rows without a conv_id belong to no conversation and take no part; a conversation keeps its turns
    after the first h where the other one is missing, and may be left with none; other columns aren't looked at.
    """
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = cut(rolled(own, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select("conv_id", "place", "role", "text"), "placed")
    convs = placed.select("conv_id").distinct().withColumns({"head": F.col("conv_id") - F.col("conv_id") % block, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    heads = placed.where((F.col("conv_id") % block == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "head")
    taken = convs.join(heads, "head").where("place <= h").select("conv_id", "place", "role", "text")
    lengths = placed.where((F.col("conv_id") % block == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("head")).agg(F.max("place").alias("there"))
    shifts = convs.join(lengths, "head", "left").select("conv_id", "h", F.least(F.col("h"), F.coalesce("there", F.lit(0))).alias("lead"))
    kept = placed.join(shifts, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "role", "text")
    return cut(taken.unionAll(kept), "rebuilt"), convs.select("conv_id")


#: The same from the table itself: prefixes as lists of turns.
SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(
    string_split(cast(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h, list({'role': role, 'text': text} ORDER BY place) AS own FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS turns FROM c LEFT JOIN c b ON b.conv_id = c.head),
p AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS ends FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS depth)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS (SELECT n.*, m.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children
    FROM n LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.path = n.path[1:n.depth - 1]),
a AS (SELECT path[1:up] AS path, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].text) ELSE 0 END) AS saved FROM k, LATERAL (SELECT unnest(range(depth + 1)) AS up) GROUP BY 1, 2)
SELECT k.conv_id, cast(k.depth AS BIGINT) AS depth, k.parent_conv_id, k.n_convs, k.n_children, cast(n_leaves AS BIGINT) AS n_leaves,
  cast(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM k JOIN a ON a.depth = k.depth AND a.path = k.path
"""
