"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 1).

Each source is a stream of words: its documents in a hashed order, one after another. The stream is cut into blocks of
equally many words. A source's target fixes exactly how many blocks are drawn, over at most two passes; each pass draws
along a keyed permutation of the block numbers, so no block is drawn twice in a pass. A binary tree over the output
shards splits the vector of quotas: at each node the left half of the shards draws its share without replacement, which is
a multivariate-hypergeometric vector. What a node's left half draws of a source comes first in the source's order of drawn
blocks, so walking down from the root leads a drawn block to its shard. Shards are disjoint, each has exactly the quotas of
its leaf, and is in itself shuffled.

Blocks and shards both number as the square root of the words, so a shard has some 50 blocks whatever the size, and no table
of blocks or shards is ever made: tasks work out the permutation and the nodes that they come by, each node from its own
seed. Only the mixture (a row a source) is on the driver. Documents get their place in the stream by ``running_start``,
over rows without texts; a source is never gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, running_start, unused

#: Sources that a mixture may name; more is an error, since the mixture is planned on the driver.
SOURCES = 100_000
#: A block's words are the square root of all words over this, at least LEAST_BLOCK; so is the number of shards, of the words to draw.
ROOT, LEAST_BLOCK = 8, 256
#: Bytes of drawn nodes that a task remembers, and equal rows that are placed together.
NODES, TOGETHER = 32 << 20, 1024
_PIECES = "array<struct<shard:long,turn:int,block:long,first:long,words:long>>"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what is above is shared again among the others."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if per * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


class Tree:
    """The splitting tree of a vector of quotas over shards; its nodes are numbered as in a heap and drawn when they are met."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int) -> None:
        self.quotas, self.shards, self.seed = quotas, shards, seed
        self.drawn: dict[int, np.ndarray] = {}
        self.held = 0

    def left(self, node: int, counts: np.ndarray, shards: int) -> np.ndarray:
        """What the first half of a node's shards draws without replacement of its counts."""
        found = self.drawn.get(node)
        if found is None:
            total = int(counts.sum())
            take = total * (shards // 2) // shards
            found = np.random.default_rng([self.seed, node]).multivariate_hypergeometric(counts, take, method="marginals") if take else np.zeros_like(counts)
            self.held += found.nbytes + 150
            if self.held > NODES:
                self.drawn.clear()
                self.held = found.nbytes
            self.drawn[node] = found
        return found

    def shard(self, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The shard of the at-th drawn block of a source, for many."""
        out = np.empty(len(at), np.int64)
        ids = np.flatnonzero(self.quotas)
        todo = [(1, 0, self.shards, ids, self.quotas[ids], np.zeros(len(ids), np.int64), np.arange(len(at)))] if len(at) else []
        while todo:
            node, first, shards, ids, counts, begin, rows = todo.pop()
            if shards == 1:
                out[rows] = first
                continue
            left = self.left(node, counts, shards)
            place = np.searchsorted(ids, source[rows])
            low = at[rows] < (begin + left)[place]
            half = shards // 2
            for child, some, own, start, f, n in ((2 * node, rows[low], left, begin, first, half), (2 * node + 1, rows[~low], counts - left, begin + left, first + half, shards - half)):
                if len(some):
                    some_ids = own > 0
                    todo.append((child, f, n, ids[some_ids], own[some_ids], start[some_ids], some))
        return out

    def leaves(self) -> np.ndarray:
        """Quotas of every shard (shards x sources); for tests, and for mixtures that fit in memory."""
        source = np.repeat(np.arange(len(self.quotas)), self.quotas)
        at = np.arange(len(source)) - np.repeat(np.cumsum(self.quotas) - self.quotas, self.quotas)
        out = np.zeros((self.shards, len(self.quotas)), np.int64)
        np.add.at(out, (self.shard(source, at), source), 1)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of number k in the permutation of 0 to n - 1 that belongs to key: a Feistel network, walked until it is below n."""
    k, n = k.astype(np.uint64), n.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    bits = np.where(np.uint64(1) << (np.uint64(2) * bits) < n, bits + np.uint64(1), bits)
    mask, out, live = (np.uint64(1) << bits) - np.uint64(1), k.copy(), np.flatnonzero(n > 1)
    while len(live):
        high, low = out[live] >> bits[live], out[live] & mask[live]
        for turn in range(6):
            high, low = low, high ^ (_mixed(low + key[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask[live])
        out[live] = high << bits[live] | low
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def plan(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: int, shards: int | None, seed: int, block_words: int | None) -> dict:
    """The mixture: for each source, by code point with null last, its target, its full blocks, and each pass's draws and where a block is cut."""
    if len(sizes) > SOURCES:
        raise ValueError(f"a mixture of {len(sizes)} sources; merge them to {SOURCES} at most")
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    n = np.array([x for _, x in sizes], np.int64)
    want = targets(n.tolist(), [weights[i % len(weights)] for i in range(len(sizes))], share * int(n.sum()), most)
    block = block_words or max(LEAST_BLOCK, math.isqrt(int(n.sum())) // ROOT)
    full, short = n // block, n % block
    draws, cuts, cut_words = (np.zeros((len(n), most), np.int64) for _ in range(3))
    for i, target in enumerate(want):
        words = min(most * int(n[i]), math.floor(target + 1e-9))
        for turn in range(most):
            part = max(0, min(int(n[i]), words - turn * int(n[i])))
            whole, rest = divmod(part, block)
            draws[i, turn] = whole + (rest > 0)
            cuts[i, turn] = -1 if not rest or (part == n[i] and short[i]) else whole
            cut_words[i, turn] = rest
    shards = shards or 1 + math.isqrt(int(sum(want))) // ROOT
    keys = _mixed(np.arange(len(n) * most, dtype=np.uint64).reshape(-1, most) + np.uint64(seed) * np.uint64(1 << 32))
    return {"sources": [s for s, _ in sizes], "sizes": n, "targets": want, "block": block, "full": full, "draws": draws, "cuts": cuts, "cut_words": cut_words, "keys": keys, "shards": shards, "seed": seed}


def pieces(mixture: dict, tree: Tree, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, shard, turn, block, first and words of what is drawn of rows that lie at start in their sources' streams; by row, turn and block."""
    block = mixture["block"]
    low = start // block
    count = np.where(size > 0, (start + size - 1) // block - low + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    s, found = source[row], []
    full = mixture["full"][s]
    before = np.cumsum(mixture["draws"], axis=1) - mixture["draws"]
    for turn in range(mixture["draws"].shape[1]):
        at = np.where(k < full, permuted(np.minimum(k, np.maximum(full - 1, 0)), full, mixture["keys"][s, turn]), k)
        end = np.minimum((k + 1) * block, start[row] + size[row])
        end = np.where(at == mixture["cuts"][s, turn], np.minimum(end, k * block + mixture["cut_words"][s, turn]), end)
        first = np.maximum(k * block, start[row])
        i = np.flatnonzero((at < mixture["draws"][s, turn]) & (end > first))
        shard = tree.shard(s[i], before[s[i], turn] + at[i])
        found.append((row[i], shard, np.full(len(i), turn), k[i], (first - start[row])[i], (end - first)[i]))
    out = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shards: int | None = None, seed: int = 7, block_words: int | None = None) -> DataFrame:
    """docs without text, but with size, text_hash, source_size, target, taken, pieces and copy: what the mix draws of each document.

    Sources, by code point with null last, get the weights in turn, and share ``share`` times all words; no source gets
    over ``most`` times its words. pieces is an array of (shard, turn, block, first, words): in pass ``turn``, that shard
    gets ``words`` words of the document from word ``first`` on. taken is the sum of their words. Without a number of
    shards, or of words of a block, they follow from the words.

    Defined results: a null source is a source of its own; a null or empty text has size 0, takes nothing and stays;
    rows that are repeated, or share a doc_id, are drawn each for itself, and copy numbers the repeated ones from 0;
    an empty table gives an empty result; a column of docs with the name of a new one is replaced. Reruns give the same rows.
    """
    spark = docs.sparkSession
    new = ("size", "text_hash", "source_size", "target", "taken", "pieces", "copy")
    kept = [c for c in docs.columns if c.lower() not in ("text", *new)]
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(*(F.col(f"`{c}`") for c in kept), words.alias("size"), F.xxhash64("text").alias("text_hash"))
    each, n, part, key, again, number, start = unused(sized, "each", "n", "part", "key", "again", "number", "start")
    counted = cut(sized.groupBy(*(F.col(f"`{c}`") for c in sized.columns)).agg(F.count(F.lit(1)).alias(each)), "sizes")
    total = counted.groupBy("source").agg(F.sum(F.col("size") * F.col(each)).alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    mixture = plan([(r[0], int(r[1])) for r in total], weights, share, most, shards, seed, block_words)
    shared = spark.sparkContext.broadcast(mixture)
    names = spark.createDataFrame([(s, i) for i, s in enumerate(mixture["sources"])], f"{again} string, {number} int")
    # equal rows are placed by the thousand, so that a row that is repeated very often is dealt like different ones
    rows = counted.join(names, F.col("source").eqNullSafe(F.col(again))).drop(again)
    rows = rows.withColumn(part, F.explode(F.sequence(F.lit(0), F.expr(f"cast((`{each}` - 1) div {TOGETHER} as int)"))))
    rows = rows.withColumn(n, F.least(F.lit(TOGETHER), F.col(each) - F.col(part) * TOGETHER)).withColumn(each, F.col("size") * F.col(n))
    rows = rows.withColumn(key, F.xxhash64(*(F.col(f"`{c}`") for c in [*sized.columns, part]))).withColumn(again, F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in [*sized.columns, part])))
    placed = running_start(rows, number, each, [key, again], start, max(16, sum(r[2] for r in total) >> 12))
    placed = placed.select(*(F.col(f"`{c}`") for c in sized.columns), *(F.col(c) for c in (number, start, n, part)))
    schema = T.StructType([*placed.schema[: len(sized.columns)], *T.StructType.fromDDL(f"source_size long, target double, taken long, pieces {_PIECES}, copy long")])
    struct = pa.struct([("shard", pa.int64()), ("turn", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("words", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = shared.value
        tree = Tree(plan_["draws"].sum(1), plan_["shards"], plan_["seed"])
        sizes, wanted = plan_["sizes"], np.array(plan_["targets"], np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            source, first, count, chunk = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[-4:])
            size = batch.column(len(kept)).to_numpy()
            whole = np.repeat(np.arange(len(size)), count)
            copy = np.arange(len(whole)) - np.repeat(np.cumsum(count) - count, count)
            for at in range(0, len(whole), 20_000):
                r, c = whole[at : at + 20_000], copy[at : at + 20_000]
                row, *drawn = pieces(plan_, tree, source[r], first[r] + c * size[r], size[r])
                ends = np.searchsorted(row, np.arange(len(r) + 1))
                made = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(drawn, struct)], fields=list(struct))
                taken = np.bincount(row, drawn[-1], len(r)).astype(np.int64)
                given = [x.take(pa.array(r)) for x in batch.columns[:-4]]
                yield pa.RecordBatch.from_arrays(
                    [*given, pa.array(sizes[source[r]]), pa.array(wanted[source[r]]), pa.array(taken), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made), pa.array(chunk[r] * TOGETHER + c)], names=schema.names
                )

    return placed.mapInArrow(apply, schema)


def deal(docs: DataFrame, seed: int = 7, **options: object) -> DataFrame:
    """The mixed corpus: a row for each shard and pass that draw of a document, with the words drawn as its text, in shuffled shards.

    A document drawn whole keeps its text as it is. Of one drawn in part, the drawn words stay in order, with the white
    space that follows each; n_chars, where there is one, is that of the new text. Every shard has exactly the words
    that the tree gives it, and is whole in one of the session's shuffle partitions, in an order by hash. options are those of ``mix``.

    Defined results: documents without words, null texts with them, are drawn by no shard and aren't in the result; a document is there
    as often as it is drawn; repeated rows are drawn each for itself; an empty table gives an empty result; other columns stay as
    they are, whatever their names. Reruns give the same rows.
    """
    shard, turn, own, whole, lead, words, key, place = unused(docs, "shard", "turn", "own", "whole", "lead", "words", "key", "place")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("text", "source")}  # no name clashes with mix's new ones
    plain = docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns))
    drawn = mix(plain, seed=seed, **options)
    same = lambda text: F.sha2(F.concat_ws("/", F.xxhash64(*(F.col(names.get(c, c)) for c in docs.columns if c != "text"), text), F.xxhash64(F.lit(1), text, *(F.col(names.get(c, c)) for c in docs.columns if c != "text"))), 224)
    parts = drawn.select(same(F.col("text_hash")).alias(key), "copy", "size", F.explode("pieces").alias("piece"))
    parts = parts.groupBy(key, "copy", "size", F.col("piece.turn").alias(turn), F.col("piece.shard").alias(shard)).agg(F.array_sort(F.collect_list(F.struct("piece.first", "piece.words"))).alias(own))
    texts = plain.withColumn(key, same(F.xxhash64("text"))).dropDuplicates([key])
    out = texts.join(parts, key)
    split = F.expr(r"split(text, '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])')")
    out = out.withColumn(whole, F.expr(f"aggregate({own}, 0L, (a, p) -> a + p.words) = size"))
    out = out.withColumns({words: F.when(~F.col(whole), split), lead: F.expr(r"if(text rlike '^[\\x20\\x09-\\x0D]', 1, 0)")})
    part = F.expr(f"concat_ws('', flatten(transform({own}, p -> slice({words}, cast(p.first + 1 + {lead} as int), cast(p.words as int)))))")
    out = out.withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(part)).withColumn(place, F.xxhash64(F.lit(seed), key, turn, "copy"))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.when(F.col(whole), F.col(names["n_chars"])).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    out = out.select(shard, place, *(F.col(names.get(c, c)).alias(c) for c in docs.columns))
    return out.repartition(F.col(shard)).sortWithinPartitions(shard, place).select(*columns)
