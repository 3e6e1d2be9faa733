r"""MinHash near-duplicates with odd sketches (operator 12).

A document is its set of different shingles, of five lower-cased words. Two sets are linked if what they share is at least ``alike`` of
``of`` of their union. A set has MinHash samples, least values under many hash functions, each equal in two sets with the probability of
their similarity. Bands of samples are keys: sets that are alike enough miss every common key with a probability of MISS at most.
All samples are folded into an odd sketch, a bitmap that tells of each bit whether an odd number of samples falls on it. Samples that
two sets have in common cancel in the exclusive or of their bitmaps, so its population count tells how many differ, most precisely for
high similarities. A candidate is verified by its sizes and sketches. Those that pass are held to the odd sketch of their whole sets, whose
difference is never larger than that of the sets, so it rules out no link, and the others are confirmed on the full sets.

Equal sets are one node. A key may hold a third of all nodes, so pairs of a key are never listed: first each node is compared with one
other, of the least nodes of its keys that with the most keys in common. What that links is one component, and only nodes of a key that
are in different components are compared further, in tiles of bounded size: those outside the key's largest component with all. Of these
pairs the nearest of each node are confirmed first, round by round, so that groups of copies grow together; in the end all that are
still between components are. So a group of copies takes work by its size. No pair is left out, whatever the size of a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .components import components
from .shingles import mixed, shingle_hashes

#: Words of a shingle, and the least similarity of linked sets as a fraction.
SHINGLE, ALIKE, OF = 5, 85, 100
#: Samples of a band, and the largest probability that two sets of the least similarity have no band in common.
ROWS, MISS = 5, 1e-10
#: Bits of an odd sketch, and how many standard deviations beyond its expected difference a pair of the least similarity is still verified.
BITS, SIGMAS = 1024, 6.5
#: Nodes on each side of a tile.
TILE = 2048
_BLOCK = 2048


def bands(alike: int, of: int) -> int:
    """How many bands keep the probability that a link shares none at MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (alike / of) ** ROWS))


def limit(alike: int, of: int) -> int:
    """In how many bits the sketches of a linked pair differ at most, but for SIGMAS standard deviations."""
    k, p = bands(alike, of) * ROWS, 1 - alike / of
    kept = math.exp(-4 * k * p / BITS)  # each sample that differs falls on a bit twice, once from either set
    of_samples, of_bits = 2 * kept * math.sqrt(k * p * (1 - p)), math.sqrt(BITS / 4 * (1 - kept**2))
    return math.ceil(BITS / 2 * (1 - kept) + SIGMAS * math.hypot(of_samples, of_bits))


@cache
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return x[:k] | np.uint32(1), x[k:]


def samples(x: np.ndarray, k: int) -> np.ndarray:
    """The k MinHash samples of a set of hashes that isn't empty: the least value under each of k functions."""
    a, b = _functions(k)
    x, low = (x >> np.uint64(32)).astype(np.uint32), np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _BLOCK):
        np.minimum(low, (x[at : at + _BLOCK, None] * a + b).min(0), out=low)
    return low


def keys(low: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of that many samples."""
    n = len(low) // rows
    key = np.arange(1, n + 1, dtype=np.uint64)
    for column in low.reshape(n, rows).T.astype(np.uint64):
        key = mixed((key << np.uint64(32)) ^ (key >> np.uint64(32)) ^ column)
    return key


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The parity bitmap of samples, as BITS / 64 longs."""
    at = mixed((np.arange(1, len(low) + 1, dtype=np.uint64) << np.uint64(32)) | low) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def whole_sketch(x: np.ndarray) -> np.ndarray:
    """The parity bitmap of a whole set: about as many bits as shingles, a power of two, 512 at least; half of them, folded, are the shorter bitmap."""
    n = 64 * max(8, 1 << max(0, -(-len(x) // 64) - 1).bit_length())
    return np.packbits((np.bincount((mixed(x) % np.uint64(n)).astype(np.int64), minlength=n) & 1).astype(np.uint8)).view(np.uint64)


def differences(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of rows p and q differ, at the length of the shorter one; row i's are sizes[i] longs of values from starts[i]."""
    out = np.zeros(len(p), np.int64)
    for a, b in set(zip(sizes[p].tolist(), sizes[q].tolist())):
        at = np.flatnonzero((sizes[p] == a) & (sizes[q] == b))
        for lo in range(0, len(at), step := max(1, (1 << 20) // max(a, b))):
            one = at[lo : lo + step]
            x, y = values[starts[p[one]][:, None] + np.arange(a)], values[starts[q[one]][:, None] + np.arange(b)]
            while x.shape[1] != y.shape[1]:
                if x.shape[1] > y.shape[1]:
                    x, y = y, x
                half = y.shape[1] // 2
                y = y[:, :half] ^ y[:, half:]
            out[one] = np.bitwise_count(x ^ y).sum(1)
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; empty without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes((text or "").encode(), SHINGLE)]))


def _digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def signed(docs: DataFrame, n_bands: int, mark: Callable[[str | None], int] | None = None) -> DataFrame:
    """doc_id, at (a hash of the text), digest (of the set), n (its size), sketch, whole, keys and the mark of each row of docs; without words no sketches and no keys."""

    rows = ROWS

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            digests, sizes, sketches, wholes, all_keys, marks = [], [], [], [], [], []
            for t in (s.as_py() for s in batch.column(2)):
                x = shingle_set(t)
                marks.append(0 if mark is None else mark(t))
                low = samples(x, n_bands * rows) if len(x) else None
                digests.append(_digest(x))
                sizes.append(len(x))
                sketches.append(none if low is None else odd_sketch(low))
                wholes.append(none if low is None else whole_sketch(x))
                all_keys.append(none if low is None else keys(low, rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _lists(sketches), _lists(wholes), _lists(all_keys), pa.array(marks, pa.int64())], names=["doc_id", "at", "digest", "n", "sketch", "whole", "keys", "mark"])

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("at"), "text")
    return bare.mapInArrow(apply, "doc_id long, at long, digest binary, n long, sketch array<long>, whole array<long>, keys array<long>, mark long")


def _full_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """node and shingles of the nodes asked for (node, at, digest), read again from a text that has the set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            same = pa.array([_digest(x) == d.as_py() for x, d in zip(sets, batch.column(1))], pa.bool_())  # texts of one hash may differ
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), _lists(sets).filter(same)], names=["node", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("at"), "text").join(asked, "at").dropDuplicates(["node", "text"]).select("node", "digest", "text")
    return cut(texts.mapInArrow(apply, "node long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, alike: int, of: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept[i] = of * both >= alike * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in batch.columns[:2]], names=["a", "b"])

    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return cut(pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(apply, "a long, b long"), "links")


def _may_link(alike: int, of: int, most: int) -> Column:
    """Whether sizes na, nb and sketches ka, kb allow a link."""
    bits = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, c: total + c)
    return (F.least("na", "nb") * of >= F.greatest("na", "nb") * alike) & (bits <= most)


def _apart(shared: DataFrame, nodes: DataFrame, roots: DataFrame, alike: int, of: int, most: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, are in different components so far and may be linked: all, or with each node outside the
    largest component of a key the nearest one only.

    In each key the nodes outside its largest component meet all others, in tiles of TILE by TILE nodes. A tile is compared by
    numpy and returns just the pairs that sizes and sketches allow.
    """
    placed = shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    per_key = cut(per_key.select("key", F.col("top.root").alias("largest"), F.ceil(F.col("all") / TILE).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("top.n")) / TILE).cast("int").alias("high")), "apart")
    rows = placed.join(per_key, "key").withColumn("rest", F.col("root") != F.col("largest"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: F.struct(F.xxhash64("key", block("high"), j).alias("tile"), F.lit(True).alias("left"))))
    right = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda i: F.struct(F.xxhash64("key", i, block("wide")).alias("tile"), F.lit(False).alias("left")))
    none = F.array().cast("array<struct<tile: bigint, left: boolean>>")
    dealt = rows.select("node", "root", "rest", F.explode(F.concat(F.coalesce(left, none), right)).alias("x")).select("x.*", "node", "root", "rest")
    dealt = dealt.join(nodes.select("node", "n", "sketch", "whole"), "node").select("tile", "left", "node", "root", "rest", "n", "sketch", "whole")

    def compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, left, node, root, rest, n, sketches, wholes = (part.column(i).combine_chunks() for i in range(8))
        tile, left, node, root, rest, n = (c.to_numpy(zero_copy_only=False) for c in (tile, left, node, root, rest, n))
        sketch = sketches.flatten().to_numpy().view(np.uint64).reshape(len(tile), -1)
        values, sizes = wholes.flatten().to_numpy().view(np.uint64), pc.list_value_length(wholes).to_numpy()
        starts = np.cumsum(sizes) - sizes
        for at in np.split(np.arange(len(tile)), np.flatnonzero(tile[1:] != tile[:-1]) + 1):
            x, y = at[left[at]], at[~left[at]]
            for lo in range(0, len(x), 256):
                i = x[lo : lo + 256]
                fits = (root[i, None] != root[y]) & (np.minimum(n[i, None], n[y]) * of >= np.maximum(n[i, None], n[y]) * alike)
                if not nearest:
                    fits &= ~rest[y] | (node[i, None] < node[y])  # two nodes outside the largest component meet both ways
                p, q = np.nonzero(fits)
                bits = np.zeros(len(p), np.int32)
                for k in range(sketch.shape[1]):
                    bits += np.bitwise_count(sketch[i[p], k] ^ sketch[y[q], k])
                p, q, bits = (v[bits <= most] for v in (p, q, bits))
                both = n[i[p]] + n[y[q]]
                close = differences(values, starts, sizes, i[p], y[q]) * (of + alike) <= both * (of - alike)
                p, q, bits = p[close], q[close], bits[close]
                if nearest:
                    order = np.lexsort((node[y[q]], bits, p))
                    order = order[np.unique(p[order], return_index=True)[1]]
                    p, q, bits = p[order], q[order], bits[order]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(node[i[p]]), pa.array(node[y[q]]), pa.array(bits)], names=["x", "y", "bits"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            kept = now if kept is None else pa.concat_tables([kept, now])
            tile = kept.column(0).to_numpy()
            whole = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0  # the last tile may go on in the next batch
            if whole:
                yield from compare(kept.slice(0, whole))
                kept = kept.slice(whole)
        if kept is not None and kept.num_rows:
            yield from compare(kept)

    met = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(apply, "x long, y long, bits int")
    if nearest:
        met = met.groupBy("x").agg(F.min(F.struct("bits", "y")).alias("best")).select("x", "best.y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, alike: int, of: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) between nodes (node, digest, at, n, sketch, whole, keys): within a component as connected as all pairs of sets that are alike enough.

    more may name other candidates (a, b) of nodes, to be confirmed at first.
    """
    most = limit(alike, of)
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    heads = exploded.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = cut(exploded.join(heads, "key"), "shared")
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}")) for c in "ab")
    first = shared.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).count()
    first = first.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select("best.a", "b")
    if more is not None:
        first = first.unionByName(more(nodes)).distinct()
    first = cut(first.join(y, "b").join(x, "a").where(_may_link(alike, of, most)).select("a", "b"), "pairs")
    found, tried = _linked(docs, nodes, first, alike, of), first
    while True:  # as long as an eighth of the nearest pairs are links: these join more and more nodes, and each round has fewer components
        near = cut(_apart(shared, nodes, components(found), alike, of, most, True).join(tried, ["a", "b"], "left_anti"), "pairs")
        if near.isEmpty():
            break
        new = _linked(docs, nodes, near, alike, of)
        found, tried = cut(found.unionByName(new), "links"), cut(tried.unionByName(near), "tried")
        if new.count() * 8 < near.count():
            break
    rest = cut(_apart(shared, nodes, components(found), alike, of, most, False).join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(shared)
    return found if rest.isEmpty() else found.unionByName(_linked(docs, nodes, rest, alike, of))


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, alike: int, of: int) -> DataFrame:
    asked = nodes.select("node", "at", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    sets = _full_sets(docs, asked)
    found = _confirmed(pairs, sets, alike, of)
    discard(sets)
    return found


def classes(docs: DataFrame, alike: int = ALIKE, of: int = OF, mark: Callable[[str | None], int] | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, at, digest and n of each row of docs (doc_id, text), and digest and root, the class of equal or linked sets, of each set that isn't empty.

    mark gives a number for each text, which nodes carry for more (see links).
    """
    rows = cut(signed(docs, bands(alike, of), mark), "signed")
    order = F.struct("at", "mark", "sketch", "whole", "keys")
    nodes = rows.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.min(order).alias("one")).select("digest", "n", "one.*")
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(links(docs.select("text"), nodes, alike, of, more))
    found = cut(nodes.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "classes")
    return rows.select("doc_id", "at", "digest", "n"), found


def near_duplicates(docs: DataFrame, alike: int = ALIKE, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (it is that itself) of every row of docs.

    Words are split at six white-space characters after lower-casing A-Z; a text of fewer than SHINGLE words has its whole sequence as its one
    shingle. Defined results: null texts, empty ones and white space have empty sets, linked with nothing, each its own component;
    repeated rows and copies share a component, and all rows of its least doc_id are kept; a null doc_id takes part, but names a
    component only if none of its rows has another; an empty table gives an empty result; other columns aren't looked at. Texts of any
    length are read whole.
    """
    rows, found = classes(docs, alike, of)
    least = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least")).join(found, "digest")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("named")), "root").select("digest", "named")
    out = rows.join(named, "digest", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("named")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same rows from the table itself, by all shared shingles of distinct sets.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
n AS MATERIALIZED (SELECT s, min(r) AS node, min(doc_id) AS least, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s),
x AS (SELECT node, n, unnest(s) AS shingle FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.node < b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT node, node AS low FROM n UNION SELECT u.b, c.low FROM c JOIN u ON u.a = c.node),
k AS MATERIALIZED (SELECT node, min(low) AS root FROM c GROUP BY node),
m AS MATERIALIZED (SELECT k.root, min(n.least) AS component_id FROM k JOIN n ON n.node = k.node GROUP BY k.root),
o AS (SELECT g.doc_id, cast(len(g.s) AS BIGINT) AS n_shingles, CASE WHEN len(g.s) = 0 THEN g.doc_id ELSE m.component_id END AS component_id
    FROM g LEFT JOIN n ON n.s = g.s LEFT JOIN k ON k.node = n.node LEFT JOIN m ON m.root = k.root)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""
