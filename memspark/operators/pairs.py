"""Pairs of similar vectors by pivot partitions, and plans cut between rounds.

The angle between vectors is a metric, so it obeys the triangle inequality. Some vectors are pivots, and each vector of the left
side belongs to the cell of the pivot nearest to it. A vector of the right side is copied to just those cells that can hold a
vector within the threshold's angle t: it is no farther from a cell's pivot than from its own by more than 2 t (else the border
between the two is too far away), and its distance to the pivot is within t of the cell's ring, the least and the
largest distance of what is in the cell. All that passes these bounds is compared, so the join is exact; how much passes depends on the data: groups
of vectors that are near each other are told apart by pivots, while vectors without any structure and wide angles leave little to rule out.
Such vectors get fewer pivots, one at least, and a cell is dealt into blocks, two of which meet in a group of rows; so a task
holds two blocks whatever the size of a cell, and a vector is moved as often as there are blocks that its own meets.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors in a block, about.
BLOCK = 16384
#: Vectors that are compared at once with others, and pairs of an output batch, about.
TILE, BATCH = 4096, 1 << 18
#: Vectors that pivots are chosen from, and pivots at most; there are at most as many as the square root of half the vectors.
SAMPLE, PIVOTS = 8192, 2048
#: What angles may be off by rounding.
SLACK = 1e-6


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that it is computed once and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/memspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what cut has written for these."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def _element(*sides: DataFrame) -> str:
    """What the vectors of all sides are made of: float where all are, so that no more bytes are moved than there are, else double."""
    return "float" if all(side.schema["embedding"].dataType.elementType.typeName() == "float" for side in sides) else "double"


def _rows(side: DataFrame, by: str | None, element: str) -> DataFrame:
    """id, group, dims and embedding of the vectors that have a direction; only vectors of one group and length are compared."""
    own = side.where("embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and forall(embedding, x -> abs(x) < double('infinity'))")
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    return own.select(F.col("id").cast("long").alias("id"), group.alias("group"), F.size("embedding").alias("dims"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))


def _unit(vectors: pa.ListArray, dims: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small ones are lost
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def chosen(sample: np.ndarray, k: int) -> np.ndarray:
    """k of the unit vectors, each the farthest from those before, so that every group of near vectors has one."""
    at, nearest = [0], sample @ sample[0]
    while len(at) < min(k, len(sample)):
        at.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[at[-1]])
    return sample[at]


def useful(sample: np.ndarray, found: np.ndarray, n: float, angle: float) -> int:
    """How many of the pivots found, from the first on, to take for n vectors of a group: with more of them, cells are smaller but each vector is copied to more of them.

    A vector is moved once for each block that it meets, which costs about as much as BLOCK comparisons. Where nothing is ruled out, copies are as many
    as pivots, and one cell of many blocks is best.
    """
    a, k, costs = _angles(sample[:1024], found), len(found), {}
    while k:
        copies = (a[:, :k] <= a[:, :k].min(1, keepdims=True) + 2 * angle).sum(1).mean()
        costs[k] = (math.ceil(n / k * copies / BLOCK) + copies * math.ceil(n / k / BLOCK)) * BLOCK + copies * n / k
        k //= 2
    return min(costs, key=costs.get)


def pivots(rows: DataFrame, angle: float = 0.0) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, from a sample of bounded size."""
    n, of = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("group")).first()
    some = rows.orderBy(F.xxhash64("id"), "id").select("dims", "embedding").limit(SAMPLE).toPandas()
    k = max(1, min(PIVOTS, math.isqrt(n // 2)))
    out = {}
    for d, g in some.groupby("dims"):
        sample = _unit(pa.array(list(g["embedding"])), int(d))
        found = chosen(sample, k)
        out[int(d)] = found[: useful(sample, found, n / max(1, of), angle)]
    return out


def _angles(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ to.T, -1, 1))


_CELLS = "id long, group string, dims int, embedding array<{}>, cell int, home int, angle double"


def _cells(rows: DataFrame, found: dict[int, np.ndarray], rings: dict | None = None, angle: float = 0.0) -> DataFrame:
    """rows with their own cell, or with a row for each cell that may hold what is near, where rings has the least and largest angle in each cell."""
    shared = rows.sparkSession.sparkContext.broadcast((found, rings))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rings = shared.value
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                if d not in found:  # too few of this length for the sample: one cell
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.zeros(part.num_rows, t)) for t in (np.int32, np.int32, np.float64))], names=[*part.schema.names, "cell", "home", "angle"])
                    continue
                for lo in range(0, part.num_rows, 1024):
                    piece = part.slice(lo, 1024)
                    a = _angles(_unit(piece.column(3), d), found[d])
                    home = a.argmin(1)
                    row, cell = np.arange(len(a)), home
                    if rings is not None:
                        low, high = rings[d]
                        own = a[np.arange(len(a)), home][:, None]
                        row, cell = np.nonzero((a <= np.minimum(own + 2 * angle, high + angle) + SLACK) & (a >= low - angle - SLACK))
                    out = piece.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), pa.array(a[row, cell])], names=[*out.schema.names, "cell", "home", "angle"])

    return rows.mapInArrow(apply, _CELLS.format(_element(rows)))


def _blocks(rows: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and other with n and m, the numbers of blocks of each in a cell. Only cells of more than a block are counted one by one: there are few of them."""
    key = ["group", "dims", "cell"]
    large = lambda df, name: F.broadcast(df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)).where(f"{name} > 1"))
    n, m = large(rows, "n"), large(other, "m")
    each = lambda df: df.join(n, key, "left").join(m, key, "left").fillna(1, ["n", "m"])
    return each(rows), each(other)


_MEETING = ["group", "dims", "cell", "x_block", "y_block"]


def _sides(a: DataFrame, b: DataFrame, threshold: float, by: str | None, ordered: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(own, copies, spare): the vectors of a in their cells and those of b in all cells that may hold what is near, both with n and m; spare tells whether there is more than one cell.

    ordered is for one table with itself: a vector is then copied to cells below its own only.
    """
    if threshold <= 0:
        raise ValueError("a threshold must be above 0")
    _importable(a.sparkSession)
    element, angle = _element(a, b), math.acos(min(1.0, threshold))
    left, right = _rows(a, by, element), _rows(b, by, element)
    found = pivots(left, angle)
    own = cut(_cells(left, found))
    rings = {d: (np.full(len(p), np.inf), np.full(len(p), -np.inf)) for d, p in found.items()}
    for r in own.groupBy("dims", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row for each pivot
        if r.dims in rings:
            rings[r.dims][0][r.cell], rings[r.dims][1][r.cell] = r.low, r.high
    copies = _cells(right, found, rings, angle)
    if ordered:
        copies = copies.where("cell < home")
    return *_blocks(own, copies), any(len(p) > 1 for p in found.values())


def _at(count: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")


def _met(a: DataFrame, b: DataFrame, threshold: float, by: str | None, ordered: bool) -> DataFrame:
    """A row for each vector of each block (id, embedding, home, left) and each block of the other side that it meets, by _MEETING.

    A pair of blocks of one cell meets once where ordered.
    """
    x, y, spare = _sides(a, b, threshold, by, ordered)
    at = _at

    def side(rows: DataFrame, is_left: bool, x_block: Column, y_block: Column) -> DataFrame:
        return rows.select("group", "dims", "cell", x_block.alias("x_block"), y_block.alias("y_block"), F.lit(is_left).alias("left"), "id", "embedding", "home")

    if not ordered:
        return side(x, True, at("n"), F.explode(F.sequence(F.lit(0), F.col("m") - 1))).unionAll(side(y, False, F.explode(F.sequence(F.lit(0), F.col("n") - 1)), at("m")))
    # blocks of copies from other cells come after those of a cell's own vectors, which meet each other once
    met = side(x, True, at("n"), F.explode(F.sequence(at("n"), F.col("n") + F.col("m") - 1 if spare else F.col("n") - 1)))
    met = met.unionAll(side(x, False, F.explode(F.sequence(F.lit(0), at("n"))), at("n")))
    return met.unionAll(side(y, False, F.explode(F.sequence(F.lit(0), F.col("n") - 1)), F.col("n") + at("m"))) if spare else met


def meetings(a: DataFrame, b: DataFrame, threshold: float, by: str | None = None, ordered: bool = False) -> DataFrame:
    """dims, x and y: the blocks of both sides that are compared."""
    rows = lambda left: F.collect_list(F.when(F.col("left") == left, F.struct("id", "embedding", "home")))
    met = _met(a, b, threshold, by, ordered).groupBy(*_MEETING).agg(rows(True).alias("x"), rows(False).alias("y"))
    return met.where("size(x) > 0 and size(y) > 0").select("dims", "x", "y")


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y and cosines of the pairs of unit vectors at the threshold or more, each once.

    y is dealt to the cells of some of its own. A row of x meets a cell unless it is out of its ring or too far behind the border between the cell and its own. What
    meets is compared in single precision, with slack for its rounding, and what passes in double.
    """
    angle, slack, k = math.acos(min(1.0, threshold)), (x.shape[1] + 8) * 2.5e-7, math.isqrt(len(y))
    centers = y[np.linspace(0, len(y) - 1, k).astype(int)]

    def cosines(rows: np.ndarray) -> np.ndarray:
        return np.clip(rows @ centers.T, -1, 1)

    apart = np.sqrt(np.maximum(2 - 2 * cosines(centers), 0))

    def meets(rows: np.ndarray) -> np.ndarray:
        c = cosines(rows)
        home, a = c.argmax(1), np.arccos(c)
        return (a >= low - angle - SLACK) & (a <= high + angle + SLACK) & (c.max(1)[:, None] - c <= math.sin(min(angle, math.pi / 2)) * apart[home] + SLACK)

    best = np.concatenate([np.stack([(c := cosines(y[lo : lo + TILE])).argmax(1), c.max(1)]) for lo in range(0, len(y), TILE)], axis=1)
    order = np.argsort(best[0], kind="stable")
    y, home, a = y[order], best[0][order].astype(int), np.arccos(best[1][order])
    low, high = np.full(k, np.inf), np.full(k, -np.inf)
    np.minimum.at(low, home, a)
    np.maximum.at(high, home, a)
    parts = np.split(np.arange(len(y)), np.searchsorted(home, np.arange(1, k)))
    if meets(x[:: max(1, len(x) // 256)]).mean() > 0.5:  # cells rule too little out
        parts = [np.arange(lo, min(lo + 1024, len(y))) for lo in range(0, len(y), 1024)]
        meets = lambda rows: np.ones((len(rows), len(parts)), bool)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for lo in range(0, len(x), TILE):
        met = meets(x[lo : lo + TILE])
        for c, part in enumerate(parts):
            rows = lo + np.nonzero(met[:, c])[0]
            if not (len(part) and len(rows)):
                continue
            of = slice(part[0], part[-1] + 1)
            step = max(1, (1 << 19) // len(part))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                score = x32[some] @ y32[of].T
                if score.max() < threshold - slack:
                    continue
                i, j = np.nonzero(score >= threshold - slack)
                if len(i) * 16 > score.size:
                    exact = (x[some] @ y[of].T)[i, j]
                else:
                    exact = np.einsum("ij,ij->i", x[some[i]], y[of][j])
                keep = exact >= threshold
                yield some[i[keep]], order[of.start + j[keep]], exact[keep]


_PLACE = "group string, dims int, cell int, block int, file string, offset long, length long"


def _stored(rows: DataFrame) -> DataFrame:
    """_PLACE of each block of rows (group, dims, cell, block, id, embedding), which is written to the shared folder once, whatever it meets."""
    folder, key = f"{shared_folder(rows.sparkSession)}/memspark-{uuid.uuid4().hex}", ["group", "dims", "cell", "block"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, held, last, at, places = TaskContext.get(), None, [], None, 0, []
        file = f"{folder}/block-{context.partitionId()}-{context.taskAttemptId()}"

        def flush() -> None:
            nonlocal out, held, at
            if out is None:
                files, path = FileSystem.from_uri(folder)
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(f"{path}/{file.rpartition('/')[2]}", compression=None)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for x in held:
                    stream.write_batch(x)
            data = sink.getvalue()
            out.write(data)
            places.append((*last, file, at, data.size))
            at, held = at + data.size, []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in range(4)]
            ends = np.ones(batch.num_rows, bool)
            ends[:-1] = np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in keys], axis=0)
            lo = 0
            for hi in (np.nonzero(ends)[0] + 1).tolist():
                now = tuple(c[lo].as_py() for c in keys)
                if held and now != last:
                    flush()
                held.append(batch.slice(lo, hi - lo).select(["id", "embedding"]))
                last, lo = now, hi
        if held:
            flush()
        if out is not None:
            out.close()
        columns = zip(*places) if places else ((),) * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=[*key, "file", "offset", "length"])

    return cut(rows.repartition(*key).sortWithinPartitions(*key).select(*key, "id", "embedding").mapInArrow(apply, _PLACE))


def _block(file: str, offset: int, length: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block."""
    files, path = FileSystem.from_uri(file)
    with files.open_input_file(path) as f, pa.ipc.open_stream(f.read_at(length, offset)) as stream:
        table = stream.read_all()
    return table.column("id").to_numpy(), _unit(table.column("embedding").combine_chunks(), dims)


#: Tasks that compare blocks, at most.
TASKS = 4096


def similar(a: DataFrame, b: DataFrame, threshold: float, by: str | None = None, ordered: bool = False, itself: bool = False) -> DataFrame:
    """a, b, score of the pairs of id at a cosine of the threshold (above 0) or more, within a group where by names one.

    Blocks are written once, and a task reads those that it compares, two at a time: so vectors are neither copied nor shuffled for each block that they meet. It
    compares some vectors at once and returns just the pairs that pass. ordered asks for a < b of one table with
    itself; itself also asks for pairs of equal ids, which two tables may have. Vectors that are null, empty or zero, and those of
    other lengths, are near nothing; a null group is a group.
    """
    x, y, spare = _sides(a, b, threshold, by, ordered)
    key = ["group", "dims", "cell"]
    left = _stored(x.withColumn("block", _at("n")))
    side = lambda df, n: df.select(*key, F.col("block").alias(f"{n}_block"), F.struct("file", "offset", "length").alias(n))
    none = left.where("false")
    own = side(left, "x").join(side(left if ordered else none, "y"), key).where("x_block <= y_block").withColumn("own", F.lit(True))
    met = own.unionByName(side(left, "x").join(side(_stored(y.withColumn("block", _at("m"))) if spare or not ordered else none, "y"), key).withColumn("own", F.lit(False)))
    met = cut(met.select("dims", "y.*", "x", (F.col("own") & (F.col("x_block") == F.col("y_block"))).alias("same")))
    n = max(1, min(TASKS, met.count()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ys, held, n = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["file"], r["offset"]):
                    at, ys = (r["file"], r["offset"]), _block(r["file"], r["offset"], r["length"], r["dims"])
                (yi, y), (xi, x) = ys, ys if r["same"] else _block(r["x"]["file"], r["x"]["offset"], r["x"]["length"], r["dims"])
                for i, j, score in _near(x, y, threshold):
                    p, q = xi[i], yi[j]
                    keep = p < q if r["same"] else (p != q) | itself  # vectors of one block meet both ways
                    p, q, score = p[keep], q[keep], score[keep]
                    held.append((np.minimum(p, q), np.maximum(p, q), score) if ordered else (p, q, score))
                    n += len(p)
                    if n >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["a", "b", "score"])
                        held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["a", "b", "score"])

    return met.repartitionByRange(n, "file", "offset", "x").sortWithinPartitions("file", "offset").mapInArrow(apply, "a long, b long, score double")
