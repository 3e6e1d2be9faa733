"""SimHash near-duplicates by generalised pigeonhole search (operator 2).

A text's fingerprint has the bits that are set in more than half of the hashes of its shingles. Two fingerprints are
linked at ``most`` or fewer differing bits. The 64 bits are grouped into partitions, correlated ones together, and
partition i gets a threshold t_i of its own, with sum(t_i + 1) = most + 1: if two fingerprints differ by more than
t_i in every partition, they differ by more than ``most`` overall, so each link shows in at least one partition. A
dynamic program picks the thresholds that cost least by candidates estimated from a sample; a threshold of -1 leaves a
partition out. Candidates meet by key: each fingerprint is indexed by its bits in a partition and probes all values
within t_i bits of them. All candidates are verified on all bits.

Only different fingerprints are compared: copies share one, so a group of copies is a single node. A task that verifies
candidates returns a spanning forest of the links it found, not all pairs, and keys with many fingerprints are dealt
into tiles of bounded size, each pair of blocks meeting in one.

``keep_one``, the pipeline's stage, links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Linked fingerprints are its first candidates; fingerprints miss edited copies, so bands of MinHash samples complete them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import odd_sketch
from .common import cut, unused
from .components import components, forest
from .shingles import mixed, shingle_hashes

SHINGLE, BITS = 4, 64
#: The Jaccard similarity of near copies as a fraction.
ALIKE, OF = 4, 5
#: Fingerprints that the plan's correlations are estimated on, and those whose pairs estimate candidates.
SAMPLE, PAIRED = 20_000, 2_000
#: Fingerprints of a key that are compared in one tile.
TILE = 4096
#: What a signature costs in units of comparing a candidate.
SIGNATURE_COST = 60
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def fingerprint(text: str | None) -> int:
    counts, n = np.zeros((8, 256), np.int64), 0
    for hashes in shingle_hashes((text or "").encode(), SHINGLE):
        n += len(hashes)
        for i, column in enumerate(hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T):
            counts[i] += np.bincount(column, minlength=256)
    return int.from_bytes(np.packbits(((counts @ _BITS).ravel() * 2 > n).astype(np.uint8)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, fp long")


def partitions(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, as wide as one another; each begins at the bit that correlates most with those left, and takes in those that correlate most with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0)) + 1e-9
    alike, left, out = np.abs(bits.T @ bits) / np.outer(norm, norm), set(range(BITS)), []
    for i in range(m):
        rest = sorted(left)
        group = [rest[int(np.argmax(alike[np.ix_(rest, rest)].sum(1)))]]
        left.discard(group[0])
        while len(group) < BITS // m + (i < BITS % m):
            rest = sorted(left)
            group.append(rest[int(np.argmax(alike[np.ix_(rest, group)].sum(1)))])
            left.discard(group[-1])
        out.append(group)
    return out


def plan(sample: np.ndarray, n: int, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, at the least cost over several numbers of partitions."""
    few = sample[:PAIRED]
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, 9):
        groups, costs = partitions(sample, m), []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            seen = np.zeros(len(group) + 1)
            for at in range(0, len(few), 256):
                d = np.bitwise_count((few[at : at + 256, None] ^ few[None, :]) & mask)
                seen += np.bincount(d[np.arange(len(d))[:, None] + at < np.arange(len(few))[None, :]], minlength=len(group) + 1)
            share = np.cumsum(seen) / max(1.0, seen.sum())
            cost = [0.0]
            for t in range(min(most, len(group)) + 1):
                ball = sum(comb(len(group), i) for i in range(t + 1))
                cost.append(n * (ball + (t > 0)) * SIGNATURE_COST + max(share[t], ball / 2.0 ** len(group)) * n * n / 2)
            costs.append(cost + [float("inf")] * (most + 2 - len(cost)))
        table = {0: (0.0, [])}
        for cost in costs:
            step: dict = {}
            for used, (so_far, picks) in table.items():
                for t in range(-1, most - used + 1):
                    x = (so_far + cost[t + 1], [*picks, t])
                    if used + t + 1 not in step or x[0] < step[used + t + 1][0]:
                        step[used + t + 1] = x
            table = step
        if most + 1 in table and table[most + 1][0] < best[0]:
            best = (table[most + 1][0], list(zip(groups, table[most + 1][1])))
    return [(g, t) for g, t in best[1] if t >= 0]


def signatures(nodes: DataFrame, parts: list[tuple[list[int], int]], probes: bool = True) -> DataFrame:
    """key, probe, fp: a row for each partition's value of a fingerprint, and one for each value near it."""
    masks = [sum(1 << b for b in g) for g, _ in parts]
    flips = [[sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(g, k)] if probes else [] for g, t in parts]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (mask, flip) in enumerate(zip(masks, flips)):
                own, salt = fp & np.uint64(mask), np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                for probe, values in ((0, [0]), (1, flip)):
                    for at in range(0, len(values), 64):
                        f = np.array(values[at : at + 64], np.uint64)
                        key = mixed((own[:, None] ^ f[None, :]) + salt).ravel().view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(np.full(len(key), probe, np.int8)), pa.array(np.repeat(fp, len(f)).view(np.int64))], names=["key", "probe", "fp"]
                        )

    return nodes.select("fp").mapInArrow(apply, "key long, probe byte, fp long")


def _verify(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between an indexed fingerprint and those after it with the same key; rows are sorted by key, indexed ones first."""
    ends = np.searchsorted(key, key, side="right")
    first = np.flatnonzero((probe == 0) & (ends > np.arange(len(key)) + 1))
    counts = ends[first] - first - 1
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    upto = np.cumsum(counts)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 21))))
        c = counts[at:to]
        left = np.repeat(first[at:to], c)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        x, y = fp[left], fp[right]
        near = (np.bitwise_count(x ^ y) <= most) & (x != y)
        if near.any():
            x, y = forest(x[near], y[near])
            a.append(x)
            b.append(y)
        at = to
    return forest(np.concatenate(a), np.concatenate(b))


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) between fingerprints of nodes (one column fp, no repeats): within a component as connected as all links at most ``most`` bits apart."""
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    if n < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts = plan(sample, n, most)
    rows = signatures(nodes, parts)
    crowded = cut(signatures(nodes, parts, probes=False).groupBy("key").count().where(F.col("count") > TILE).selectExpr("key", f"cast(ceil(count / {TILE}) as int) as blocks"), "crowded")
    if not crowded.isEmpty():
        rows = rows.join(crowded, "key", "left")
        tiles = F.expr("transform(sequence(0, blocks - 1), x -> xxhash64(key, least(x, cast(pmod(xxhash64(fp), blocks) as int)), greatest(x, cast(pmod(xxhash64(fp), blocks) as int))))")
        rows = rows.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(tiles)).alias("key"), "probe", "fp")
    schema = "a long, b long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]

        def found(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = _verify(part[0], part[1], part[2].view(np.uint64), most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            now = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last key may go on in the next batch
            yield from found([x[:whole] for x in now])
            kept = [x[whole:] for x in now]
        yield from found(kept)

    return rows.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(apply, schema)


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach, of every row of docs.

    Words are split at six white-space characters after lower-casing A-Z; shingles are four words, with repeats, or the
    whole text if it has fewer. Defined results: a null or empty text has fingerprint zero, linked like any other;
    repeated rows and copies share a component; a null doc_id takes part but is never a component_id, unless no
    row of the component has another; an empty table gives an empty result; other columns aren't looked at.
    """
    fps = cut(fingerprints(docs), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), most))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", F.col("component_id").alias("__linked"))
    named = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("__linked", "least").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def by_fingerprints(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (a, b) of nodes (node, mark, the fingerprint of a text) that fingerprints link: each with the least one of its fingerprint, and those of linked fingerprints."""
    least = cut(nodes.groupBy(F.col("mark").alias("fp")).agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(least, F.col("mark") == F.col("fp")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = (least.select(F.col("fp").alias(f"f{c}"), F.col("least").alias(c)) for c in "ab")
    near = links(least.select("fp"), most).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(x, "fa").join(y, "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(near)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id, and of the least hashes of its text and of its other columns where several have it.

    Near copies are what links join, each between two texts whose sets of shingles have a Jaccard similarity of ALIKE / OF
    or more. A shingle is five words, lower-cased as in fingerprints, or the whole text if it has fewer. Fingerprints give the first candidates;
    they miss edited copies, so bands of MinHash samples give the others, and all candidates are confirmed on their full sets. Defined
    results: null and empty texts and texts of white space have no words and are copies of each other; rows that share a
    doc_id and aren't near copies all stay; a null doc_id is after all others, and its rows are copies like others;
    repeated rows are copies; an empty table gives an empty result; other columns stay as they are, whatever their names.
    """
    rows, classes = odd_sketch.classes(docs.select("doc_id", "text"), ALIKE, OF, lambda t: int(np.array(fingerprint(t), np.uint64).view(np.int64)), by_fingerprints)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("at").alias("at"))
    least = rows.groupBy("digest").agg(F.min(row).alias("least")).join(classes, "digest", "left").groupBy(F.coalesce("root", F.lit(-1)).alias("root")).agg(F.min("least").alias("least"))
    key, first = unused(docs, "kept", "first")
    name = lambda i, t: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), t.cast("string")).alias(key)
    kept = cut(least.select(name(F.col("least.id"), F.col("least.at"))), "kept")
    own = docs.select("*", name(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(kept, key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return own.withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).drop(key, first)
