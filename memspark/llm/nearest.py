"""Approximate nearest neighbours by adaptive dimension scan (operator 6).

Vectors of length one are dealt to lists by their nearest centroid; a query probes the lists whose centroids are nearest to
it. Inside a list, vectors are rotated by one random rotation and lie in column blocks. A query's partial distance over the
first columns is an estimate of its whole distance, since a rotation spreads it evenly over columns; after each
column block a hypothesis test abandons candidates whose whole distance would be, with high confidence, beyond
the query's best so far. What is left is ranked by the cosine of the original vectors in double precision.

Centroids and the number of probed lists are fitted on a bounded sample; every vector is indexed and every query is
answered. A list with many vectors is dealt into blocks of bounded size, so no list is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that centroids are fitted on for few vectors and for many: eight for each list, of which there are as many as the square
#: root of the vectors, so that a query's work grows with that root; and queries that the number of probes is fitted on.
SAMPLE, MOST, ASKED = 8192, 131072, 400
#: Part of the sample's true neighbours that the probed lists must hold.
HELD = 0.97
#: Columns of a block; confidence of the tests, in the units of a distance's spread over rotated columns.
COLUMNS, CONFIDENCE = 16, 2.1
#: Vectors and queries of a block, about.
VECTORS, QUERIES = 4096, 1024


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one: the same cosines to the last bit, without overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit(sample: np.ndarray, n: int, k: int, seed: int = 3) -> dict:
    """Rotation, centroids and probes for n vectors like those of the sample."""
    rng = np.random.default_rng(seed)
    x = _unit(np.unique(sample, axis=0))
    lists = int(max(1, min(round(n**0.5), len(x) // 8)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums**2).sum(1))
        centres = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centres)
    own = (x @ centres.T).argmax(1)
    ask = rng.choice(len(x), min(ASKED, len(x)), replace=False)
    near = x[ask] @ x.T
    near[np.arange(len(ask)), ask] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[ask] @ centres.T), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(HELD * len(depth))))]) + 1 if len(depth) else lists
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    return {"rotation": rotation, "centres": centres, "probes": probes}


def scan(q: np.ndarray, v: np.ndarray, mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among the k nearest: rows of q and v, rotated unit vectors; mine forbids pairs."""
    dims, m = v.shape[1], len(v)
    first = min(m, 16 * k)
    d = 2 - 2 * (q @ v[:first].T)
    d[mine[:, :first]] = np.inf
    limit = np.partition(d, min(k, first) - 1, axis=1)[:, min(k, first) - 1] if first >= k else np.full(len(q), np.inf)
    far = np.zeros((len(q), m))
    columns = [np.ascontiguousarray(v[:, c : c + COLUMNS].T) for c in range(0, dims, COLUMNS)]
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    done, rest = 0, None
    for b, block in enumerate(columns):
        part = q[:, done : done + len(block)]
        done += len(block)
        bound = limit * (1.0 if done == dims else done / dims * (1 + CONFIDENCE / done**0.5) ** 2) + 1e-12
        if pairs is None:
            far += (part**2).sum(1)[:, None] + (block**2).sum(0)[None, :] - 2 * (part @ block)
            alive = (far <= bound[:, None]) & ~mine
            if b + 1 < len(columns) and alive.mean() < 0.25:
                pairs = np.nonzero(alive)
                rest = far[pairs]
        else:
            a, c = pairs
            rest = rest + ((part[a] - block.T[c]) ** 2).sum(1)
            kept = rest <= bound[a]
            pairs, rest = (a[kept], c[kept]), rest[kept]
    if pairs is None:
        pairs = np.nonzero(alive)
    return pairs


def vectors(table: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """__id and __vector of the rows that take part: none that is null, zero, or holds null or non-finite components."""
    fine = F.expr(f"`{key}` is not null and `{value}` is not null and forall(`{value}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{value}`, x -> x <> 0)")
    return table.where(fine).select(F.col(key).cast("long").alias("__id"), F.col(value).cast("array<double>").alias("__vector"))


def search(table: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, among all others, of each row whose id is divisible by every.

    Nearness is the cosine in double precision; ties go to the smaller id. Defined results: rows without an id, and
    vectors null, zero, or holding null or non-finite components take no part; rows that share an id are candidates and queries of
    their own, and none is its own candidate; a query's candidates are the vectors of its length, since no others have a cosine with it; with fewer
    than k others, all are returned; empty tables give empty results; other columns aren't looked at.
    """
    own = cut(vectors(table, key, value).withColumns({"__n": F.size("__vector"), "__row": F.monotonically_increasing_id()}), "vectors")
    found = [_search(own.where(F.col("__n") == n).drop("__n"), n, count, every, k) for n, count in own.groupBy("__n").count().orderBy("__n").collect()]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, found)


def _search(own: DataFrame, dims: int, n: int, every: int, k: int) -> DataFrame:
    """search among vectors (__row, __id, __vector) of one length."""
    sample = np.array([r[0] for r in own.orderBy(F.xxhash64("__id"), "__row").limit(min(MOST, max(SAMPLE, 8 * round(n**0.5)))).select("__vector").collect()], np.float64)
    shared = own.sparkSession.sparkContext.broadcast(fit(sample, n, k))

    def place(probes: bool):  # noqa: ANN202
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value["centres"]
            take = min(shared.value["probes"], len(centres)) if probes else 1
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unit(batch.column("__vector").flatten().to_numpy().reshape(-1, dims))
                near = x @ centres.T
                lists = np.argpartition(-near, take - 1, axis=1)[:, :take] if take < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
                at = np.repeat(np.arange(len(x)), take)
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), *(c.take(pa.array(at)) for c in batch.columns)], names=["__list", *batch.schema.names])

        return apply

    row = "__list int, __row long, __id long, __vector array<double>"
    own = own.select("__row", "__id", "__vector")
    placed = cut(own.mapInArrow(place(False), row), "lists")
    asking = cut(own.where(F.col("__id") % every == 0).mapInArrow(place(True), row), "probes")
    # a row a list at most
    sizes = placed.groupBy("__list").agg(F.ceil(F.count(F.lit(1)) / VECTORS).cast("int").alias("__blocks"))
    counts = asking.groupBy("__list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("__asking"))
    deal = F.broadcast(sizes.join(counts, "__list"))
    block = F.struct(F.col("__row").alias("row"), F.col("__id").alias("id"), F.col("__vector").alias("vector"))
    stored = placed.join(deal, "__list").withColumn("__block", F.pmod(F.xxhash64("__row"), "__blocks").cast("int"))
    stored = stored.groupBy("__list", "__block").agg(F.collect_list(block).alias("stored"))
    asks = asking.join(deal, "__list").withColumn("__part", F.pmod(F.xxhash64("__row"), "__asking").cast("int"))
    asks = asks.groupBy("__list", "__part").agg(F.collect_list(block).alias("asks"), F.first("__blocks").alias("__blocks"))
    asks = asks.select("__list", "asks", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))

    def read(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return cell.values.field(0).to_numpy(), cell.values.field(1).to_numpy(), cell.values.field(2).flatten().to_numpy().reshape(-1, dims)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value["rotation"]
        for batch in batches:
            for s, a in zip(batch.column(0), batch.column(1)):
                (rows, ids, x), (qrows, qids, q) = read(s), read(a)
                q, x = _scaled(q), _scaled(x)
                i, j = scan(_unit(q) @ rotation, _unit(x) @ rotation, qrows[:, None] == rows[None, :], k)
                score = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[i[t : t + 65536]], x[j[t : t + 65536]]) for t in range(0, len(i), 65536)])
                score /= np.sqrt(np.einsum("ij,ij->i", q, q))[i] * np.sqrt(np.einsum("ij,ij->i", x, x))[j]
                order = np.lexsort((rows[j], ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qrows[i], qids[i], rows[j], ids[j], score[keep])], names=["asked", "query_id", "row", "vec_id", "score"])

    found = stored.join(asks, ["__list", "__block"]).select("stored", "asks").mapInArrow(apply, "asked long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
