"""Vector and temporal channels of as many queries as there are facts: a bank's queries and facts meet in bounded blocks, and a pair of blocks returns only what may count.

The pairs of queries and facts of a bank grow with its square. They are compared in numpy, some queries at once, by as many tasks as there are
pairs of blocks, and are never rows of a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.temporal import closeness, days_apart, micros_between, middle, overlaps

from .pairs import _importable, cut

#: Queries and facts in a block, about, and queries that are compared at once.
QUERIES, FACTS, STEP = 4096, 8192, 128
#: What scores may be off by the order of their sums, and before they are rounded to the decimals that they are ranked by.
SLACK = 1e-9
#: No time: before or after all others, in microseconds.
NEVER = 1 << 62


def _met(queries: DataFrame, facts: DataFrame):  # noqa: ANN202
    """queries (query_id, bank_id, ...) and facts (fact_id, bank_id, ...), both written, grouped together by bank, block of queries and block of facts."""
    _importable(queries.sparkSession)
    of = lambda df, rows, name: df.groupBy("bank_id").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    counts = of(queries, QUERIES, "n").join(of(facts, FACTS, "m"), "bank_id")
    own = lambda i, count: F.pmod(F.xxhash64(i), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    q = queries.join(counts, "bank_id").select(*queries.columns, own("query_id", F.col("n")).alias("q_block"), every("m").alias("f_block"))
    f = facts.join(counts, "bank_id").select(*facts.columns, every("n").alias("q_block"), own("fact_id", F.col("m")).alias("f_block"))
    key = ["bank_id", "q_block", "f_block"]
    return q.groupBy(*key).cogroup(f.groupBy(*key))


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, vectors and norms of each length; vectors that are null or hold a null have the length -1 and no norm."""
    lists = column.combine_chunks()
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([-1 if x is None else len(x) for x in lists.to_pylist()])
    at = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        sizes[np.unique(np.searchsorted(at, np.nonzero(flat.is_null().to_numpy(zero_copy_only=False))[0], "right") - 1)] = -1
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.nonzero(sizes == d)[0]
        x = values[at[rows][:, None] + np.arange(d)] if d > 0 else np.zeros((len(rows), 0))
        out[d] = rows, x, np.sqrt(_dots(x, x))
    return out


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in the order of their elements, as Column functions sum them."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * y[:, c]
    return total


def nearest(queries: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """query_id, fact_id and cosine: of each query's bank the k facts nearest, and some more. The cosines are those of vector_topk, odd vectors included."""
    q = cut(queries.where("bank_id is not null").select("query_id", "bank_id", "embedding"))
    f = cut(facts.where("bank_id is not null and embedding is not null").select("fact_id", "bank_id", "embedding"))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        np.seterr(all="ignore")  # norms of 0, and what isn't finite
        asks, ids, found = left.column("query_id").to_numpy(), right.column("fact_id").to_numpy(), []
        own, others = ({} if not t.num_rows else _vectors(t.column("embedding")) for t in (left, right))
        for e, (columns, y, fn) in others.items():
            order = np.argsort(ids[columns], kind="stable")
            columns, y, fn = columns[order], y[order], fn[order]
            for d, (rows, x, qn) in own.items():
                for lo in range(0, len(rows), STEP):
                    some = slice(lo, lo + STEP)
                    n = qn[some, None] * fn
                    if min(d, e) < 0:
                        score = np.zeros(n.shape)
                    else:  # no cosine of vectors of several lengths
                        score = np.where(n <= 0, 0.0, x[some] @ y.T / n if d == e else -np.inf)
                    score[np.isnan(score)] = np.inf  # which comes first
                    last = np.partition(score, -k, axis=1)[:, -k, None] if len(y) > k else -np.inf
                    i, j = np.nonzero(score >= last - SLACK)
                    exact = score[i, j]
                    if d == e and d >= 0:
                        norms = n[i, j]
                        exact = np.where(norms <= 0, 0.0, _dots(x[some][i], y[j]) / norms)
                    if len(i) > 4 * k * len(n):  # many equal ones: the first k of them, by id
                        order = np.lexsort((j, exact, i))
                        i, j, exact = i[order], j[order], exact[order]
                        starts = np.concatenate([[True], (np.diff(i) != 0) | ~((exact[1:] == exact[:-1]) | np.isnan(exact[1:]) & np.isnan(exact[:-1]))])
                        keep = np.arange(len(i)) - np.maximum.accumulate(np.where(starts, np.arange(len(i)), 0)) < k
                        i, j, exact = i[keep], j[keep], exact[keep]
                    found.append((asks[rows[some]][i], ids[columns[j]], exact))
        a, b, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": a, "fact_id": b, "cosine": pa.array(c, mask=np.isneginf(c))})

    return _met(q, f).applyInArrow(apply, "query_id long, fact_id long, cosine double")


def temporal_first(queries: DataFrame, facts: DataFrame, others: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, fact_id, score, rank: the rows of temporal_channel that are of a query's first k, or of its facts in others (query_id, fact_id). Their ranks are those among all rows."""
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    asked = queries.where("bank_id is not null and (from_ is not null or to is not null)").select("query_id", "bank_id", "from_", "to", "now")
    times = cut(facts.where("bank_id is not null").select("fact_id", "bank_id", "temporal_start", "temporal_end"))
    at = lambda c, none: F.coalesce(micros_between(F.col(c), origin), F.lit(none))
    both = others.select("query_id", "fact_id").distinct().join(times, "fact_id").join(asked, ["query_id", "bank_id"])
    both = both.where(overlaps(F.col("temporal_start"), F.col("temporal_end"), F.col("from_"), F.col("to")))
    days = days_apart(F.col("temporal_start"), F.col("temporal_end"), F.col("from_"), F.col("to"), F.col("now"))
    listed = both.groupBy("query_id").agg(F.collect_list(F.struct("fact_id", days.alias("days"))).alias("x")).select("query_id", F.col("x.fact_id").alias("others"), F.col("x.days").alias("days"))
    own = F.coalesce(middle(F.col("from_"), F.col("to"), F.col("now")), F.lit(0))
    q = cut(asked.join(listed, "query_id", "left").select("query_id", "bank_id", at("from_", -NEVER).alias("from_"), at("to", NEVER).alias("to"), micros_between(F.col("now"), origin).alias("now"), own.alias("own"), "others", "days"))
    f = cut(times.select("fact_id", "bank_id", at("temporal_start", -NEVER).alias("start"), at("temporal_end", NEVER).alias("end"), middle(F.col("temporal_start"), F.col("temporal_end"), origin).alias("middle")))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("fact_id")
            ids, start, end = (right.column(c).to_numpy() for c in ("fact_id", "start", "end"))
            timeless = right.column("middle").is_null().to_numpy()
            middles, width, none = right.column("middle").fill_null(0).to_numpy(), len(ids) + 1, np.iinfo(np.int64).max
            place = lambda d: 10**10 - np.floor(1 / (1 + 0.01 * d) * 1e10 + 0.5).astype(np.int64)
            for lo in range(0, left.num_rows, STEP):
                some = left.slice(lo, STEP)
                asks, from_, to, now, own = (some.column(c).to_numpy() for c in ("query_id", "from_", "to", "now", "own"))
                apart = np.floor(np.abs(np.where(timeless, 0, middles - now[:, None]) - own[:, None]) / 86_400_000_000)
                order = place(apart) * width + np.arange(len(ids))
                order[(start > to[:, None]) | (end < from_[:, None])] = none
                order.sort(axis=1)
                i, j = np.nonzero(order[:, :k] != none)
                seat = order[i, j] % width
                found.append((asks[i], ids[seat], apart[i, seat].astype(np.int64), np.full(len(i), -1)))
                for row, (known, d) in enumerate(zip(some.column("others").to_pylist(), some.column("days").to_pylist())):
                    if known:
                        before = np.searchsorted(order[row], place(np.array(d, np.float64)) * width + np.searchsorted(ids, known))
                        found.append((np.full(len(known), asks[row]), np.array(known), np.array(d), before))
        columns = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64) for _ in range(4))
        return pa.table(dict(zip(("query_id", "fact_id", "days", "before"), columns)))

    rows = cut(_met(q, f).applyInArrow(apply, "query_id long, fact_id long, days long, before long"))
    scored = rows.withColumn("score", F.round(closeness(F.col("days")), digits))
    first = scored.where("before < 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")).cast("long") - 1).where(F.col("rank") < k)
    known = scored.where("before >= 0").groupBy("query_id", "fact_id").agg(F.first("score").alias("score"), F.sum("before").alias("rank"))
    return first.select("query_id", "fact_id", "score", "rank").unionByName(known).dropDuplicates(["query_id", "fact_id"])
