"""Exact top-k by inner product with a pivot-distance index.

With one more component, sqrt(M^2 - |x|^2), all vectors get the largest norm M
and the order by inner product is the order by Euclidean distance.  Equal
vectors are one, with its k + 1 smallest ids: no other can be in a result.  Each
is keyed by its nearest pivot and its distance to it; sorted by that key, runs
of BLOCK vectors are annuli around a pivot, each with its range of distances to
several more pivots.

Queries go in chunks, one from each annulus, and expand over the annuli in
rounds: their own, which gives a first bound of the k-th best score and so a
radius; then the cells around the nearest pivots; then the others in the order
of their bounds.  Each round leaves a better k-th score, so a smaller radius.  By
the triangle inequality an annulus is skipped by chunk or by single query if for
any of its pivots the query's distance is farther than the radius from the
annulus' range, and a query stops when that holds for all that is left.  Scores
are integers and compared exactly.

Pivots are fitted to a bounded sample and grow with the root of the number of
vectors; every row is indexed.  A task has one annulus and at most QUERIES
queries.  How much the bounds save depends on the vectors: see the README.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

K, EVERY, SCALE = 20, 20, 64
#: Rows that the pivots are fitted to, vectors of an annulus (a power of two), queries of a task.
SAMPLE, BLOCK, QUERIES = 2048, 1024, 16384
#: Fewest and most pivots; pivots to which an annulus knows its distances besides its own.
LEAST_PIVOTS, MOST_PIVOTS, REFERENCES = 8, 512, 32
#: Cells, from the nearest on, up to which each round goes; the last goes over all.
ROUNDS = (2, 8, MOST_PIVOTS)
#: Scores held at once.
HELD = 1 << 22
NONE = np.iinfo(np.int64).min


def _quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, norm2): q holds floor(SCALE * x) as little-endian 64-bit integers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            q = [np.floor(SCALE * np.asarray(x, dtype=np.float64)).astype("<i8") for x in rows]
            norms = pa.array([float((x.astype(np.float64) ** 2).sum()) for x in q], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in q], pa.binary()), norms], names=["vec_id", "q", "norm2"]
            )

    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    return rows.mapInArrow(run, "vec_id long, q binary, norm2 double")


def _matrix(rows, dim: int) -> np.ndarray:
    """Shorter vectors are zero where they have no component."""
    out = np.zeros((len(rows), dim), np.int64)
    for k, x in enumerate(rows):
        own = np.frombuffer(x, "<i8")
        out[k, : len(own)] = own
    return out


class Space:
    """The augmented space: what is needed to bound distances."""

    def __init__(self, dim: int, top: float, sample: np.ndarray, pivots: int):
        self.dim, self.top = dim, top
        self.exact = top < 2**53  # then float64 products of integers are exact
        points = self.augment(sample)
        chosen = [int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
        far = np.full(len(points), np.inf)
        while len(chosen) < min(pivots, len(points)):  # each pivot is the point farthest from those before
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = points[chosen]

    def augment(self, q: np.ndarray) -> np.ndarray:
        x = q.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        """Queries have zero as their last component."""
        return self.distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]))

    def radius(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What scores ``least`` or more is within this distance; rounding is allowed for."""
        square = (q.astype(np.float64) ** 2).sum(axis=1) + self.top - 2 * least.astype(np.float64)
        out = np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + self.slack
        return np.where(least == NONE, np.inf, out)

    def apart(self, to: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least distance, by the triangle inequality, of points at distances ``to`` from the
        pivots to whatever is between ``low`` and ``high`` from each of them."""
        return np.maximum(np.maximum(to - high, low - to).max(axis=1), 0) - self.slack

    @property
    def slack(self) -> float:
        return 1e-6 * max(1.0, float(np.sqrt(self.top)))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int):
    """(row, column) of each row's k best scores of at least ``least``, ties to smaller ids."""
    bar = least
    if scores.shape[1] > k:
        bar = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    rows, cols = np.nonzero(scores >= bar[:, None])
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


def _visit(space: Space, q: np.ndarray, x: np.ndarray, counts: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int):
    """(query, vec_id, score) of each query's k best ids of an annulus; ``counts`` ids belong to each vector."""
    each = np.repeat(np.arange(len(x)), counts)
    step, out = max(1, HELD // max(1, len(each))), []
    for a in range(0, len(q), step):
        scores = space.scores(q[a : a + step], x)[:, each]
        rows, cols = _best(scores, ids, least[a : a + step], k)
        out.append((rows + a, ids[cols], scores[rows, cols]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _distinct(table: DataFrame, k: int, every: int) -> DataFrame:
    """(q, norm2, ids, asked): each vector once, with its smallest ids and whether it is a query's."""
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy("vec_id"))
    few = table.withColumn("rank", rank).filter(F.col("rank") <= k + 1)  # limited before the shuffle as well
    few = few.groupBy("q").agg(F.max("norm2").alias("norm2"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    asks = table.filter(F.col("vec_id") % every == 0).groupBy("q").agg(F.lit(True).alias("asked"))
    return few.join(asks, "q", "left").select("q", "norm2", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


ANNULUS = (
    "block long, pivot int, near double, far double, low array<double>, high array<double>, counts binary, ids binary,"
    " vectors binary, asks int, ask_at binary, ask_vectors binary, least binary"
)


def _annuli(vectors: DataFrame, space: Space, k: int) -> DataFrame:
    """Blocks of vectors of one pivot in order of distance, and their queries with a first bound each."""

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            q = _matrix([x.as_buffer() for x in batch.column(0)], space.dim)
            d = space.distances(space.augment(q))
            near = d.argmin(axis=1)
            more = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(q)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["q", "ids", "asked", "pivot", "distance"])

    names = [x.split()[0] for x in ANNULUS.split(",")]

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0

        def block(held):
            nonlocal serial
            serial += 1
            q = _matrix([h[0] for h in held], space.dim)
            counts, ids = np.array([len(h[1]) for h in held], "<i8"), np.concatenate([h[1] for h in held])
            asks = np.flatnonzero([h[2] for h in held])
            least = np.full(len(asks), NONE)
            if len(ids) > k:
                rows, _, scores = _visit(space, q[asks], q, counts, ids, least, k + 1)
                least[:] = scores[np.cumsum(np.bincount(rows, minlength=len(asks))) - 1]
            d = space.distances(space.augment(q))[:, :REFERENCES]
            blob = lambda a: pa.array([np.ascontiguousarray(a, "<i8").tobytes()], pa.binary())
            ranges = [pa.array([a.tolist()], pa.list_(pa.float64())) for a in (d.min(axis=0), d.max(axis=0))]
            row = [
                pa.array([(part << 32) + serial], pa.int64()), pa.array([held[0][3]], pa.int32()), pa.array([held[0][4]]), pa.array([held[-1][4]]),
                *ranges, blob(counts), blob(ids), blob(q), pa.array([len(asks)], pa.int32()), blob(asks), blob(q[asks]), blob(least),
            ]
            return pa.RecordBatch.from_arrays(row, names=names)

        held: list = []
        for batch in batches:
            columns = [batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()]
            for x, ids, asked, pivot, distance in zip(batch.column(0), *columns, strict=True):
                if held and (held[0][3] != pivot or len(held) == BLOCK):
                    yield block(held)
                    held = []
                held.append((x.as_buffer().to_pybytes(), ids.values.to_numpy(), asked, pivot, distance))
        if held:
            yield block(held)

    keyed = vectors.select("q", "ids", "asked").mapInArrow(assign, "q binary, ids array<long>, asked boolean, pivot int, distance double")
    order = ["pivot", "distance", "q"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, ANNULUS)


def _chunk_cells(asking: DataFrame, space: Space, cells: dict[int, tuple[float, float]], first: int, last: int) -> DataFrame:
    """(chunk, pivot, low, high): the cells from the ``first`` to before the ``last`` in a chunk's order
    that its queries' radii reach, and the distances from the pivot that they reach there."""
    names = np.array(sorted(cells))
    near, far = (np.array([cells[p][k] for p in names]) for k in (0, 1))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for chunk, vectors, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = np.frombuffer(vectors, "<i8").reshape(-1, space.dim)
                d, reach = space.query_distances(q)[:, names], space.radius(q, np.frombuffer(least, "<i8"))
                bound = np.maximum(np.maximum(d - far, near - d), 0)
                order = np.lexsort((names, d.min(axis=0), bound.min(axis=0)))[first:last]
                met = order[(bound[:, order] - space.slack <= reach[:, None]).any(axis=0)]
                columns = ([chunk] * len(met), names[met], (d - reach[:, None]).min(axis=0)[met], (d + reach[:, None]).max(axis=0)[met])
                for column, values in zip(out, columns, strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["chunk", "pivot", "low", "high"])

    return asking.select("block", "ask_vectors", "least").mapInArrow(run, "chunk long, pivot int, low double, high double")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, work=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows.

    Queries are the rows whose vec_id ``every`` divides.  Rows without an id,
    with a null vector, or with a null or non-finite component take no part;
    shorter vectors count as zero where they end.  Rows equal in id and vector
    count once.  Rows that share an id but not the vector are one query, which
    gets the k best scores of all its vectors, and several candidates; a query
    never finds its own id.  Ties go to the smaller vec_id.  Fewer candidates
    than k give fewer rows; an empty table gives none.  ``work`` may be an
    accumulator: it gets the number of products that were computed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    table = scratch.write(_quantized(vectors), "quantized")
    facts = table.agg(F.max(F.length("q")).alias("bytes"), F.max("norm2").alias("top")).first()
    if facts["bytes"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, facts["bytes"] // 8)
    whole = F.rpad("q", 8 * dim, F.lit(b"\0"))  # shorter vectors are zero where they end
    table = table.withColumn("q", whole)
    unique = scratch.write(_distinct(table, k, every), "distinct")
    sample = unique.orderBy(F.xxhash64("q"), "q").limit(SAMPLE).select("q").collect()
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(unique.count()) // 2))
    space = Space(dim, facts["top"], _matrix([r["q"] for r in sample], dim), pivots)
    blocks = scratch.write(_annuli(unique, space, k), "blocks")
    cells = blocks.groupBy("pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect()  # a row a pivot
    cells = {r["pivot"]: (r["near"], r["far"]) for r in cells}
    asking = blocks.filter("asks > 0").select("block", "asks", "ask_at", "ask_vectors", "least")
    shares = max(1, -(-(asking.agg(F.sum("asks")).first()[0] or 0) // QUERIES))
    places = blocks.select("block", "pivot", "near", "far")
    annuli = scratch.read("blocks").select("block", "low", "high", "counts", "ids", "vectors")
    scratch.drop("distinct")

    def meet(annulus, chunks):
        import pyarrow as pa

        out = [np.zeros(0, np.int64)] * 3
        if annulus.num_rows and chunks.num_rows:
            numbers = lambda x: np.frombuffer(x, "<i8")
            counts, ids, x = (numbers(annulus.column(c)[0].as_py()) for c in ("counts", "ids", "vectors"))
            low, high = (np.array(annulus.column(c)[0].as_py()) for c in ("low", "high"))
            join = lambda c: numbers(b"".join(chunks.column(c).to_pylist()))
            names = np.repeat(chunks.column("chunk").to_numpy(), chunks.column("asks").to_numpy()) * BLOCK + join("ask_at")
            q, least, found = join("ask_vectors").reshape(-1, dim), join("least"), []
            for a in range(0, len(q), 1024):
                to = space.query_distances(q[a : a + 1024])[:, : len(low)]
                some = a + np.flatnonzero(space.apart(to, low, high) <= space.radius(q[a : a + 1024], least[a : a + 1024]))
                if len(some):
                    rows, hit, scores = _visit(space, q[some], x.reshape(-1, dim), counts, ids, least[some], k + 1)
                    found.append((names[some][rows], hit, scores))
                    if work is not None:
                        work.add(len(some) * len(counts))
            if found:
                out = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.Table.from_arrays([pa.array(c) for c in out], names=["query", "vec_id", "score"])

    def tighten(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for at, least, known in zip(*(batch.column(c).to_pylist() for c in ("ask_at", "least", "known")), strict=True):
                at, least = np.frombuffer(at, "<i8"), np.frombuffer(least, "<i8").copy()
                for x in known or ():
                    least[np.searchsorted(at, x["at"])] = x["bar"]
                out.append(least.tobytes())
            columns = [*batch.columns[:-2], pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "asks", "ask_at", "ask_vectors", "least"])

    key, best, first = ["block", "share"], None, 0
    share = F.pmod(F.xxhash64("chunk"), F.lit(shares)).alias("share")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    for turn, last in enumerate(ROUNDS):
        reach = _chunk_cells(asking, space, cells, first, last)
        pairs = reach.join(places, "pivot").filter((F.col("low") <= F.col("far")) & (F.col("near") <= F.col("high")))
        pairs = scratch.write(pairs.select("block", "chunk", share), f"pairs{turn}")
        right = pairs.join(asking.withColumnRenamed("block", "chunk"), "chunk")
        left = annuli.join(scratch.read(f"pairs{turn}").select("block", "share").distinct(), "block")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query long, vec_id long, score long")
        found = found if best is None else found.unionByName(best)
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank")
        old, best = turn - 1, scratch.write(found, f"best{turn}")
        scratch.drop(f"pairs{turn}", f"best{old}")
        first = last
        if turn + 1 < len(ROUNDS):
            bars = best.groupBy("query").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > k)
            entry = F.struct((F.col("query") % BLOCK).alias("at"), "bar")
            bars = bars.groupBy(F.floor(F.col("query") / BLOCK).alias("block")).agg(F.collect_list(entry).alias("known"))  # BLOCK at most
            schema = "block long, asks int, ask_at binary, ask_vectors binary, least binary"
            asking = scratch.write(asking.join(bars, "block", "left").mapInArrow(tighten, schema), f"asking{turn}")
            scratch.drop(f"asking{old}")

    scratch.drop(f"asking{len(ROUNDS) - 2}")

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], []]
            for block, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out[0] += [block * BLOCK + int(a) for a in np.frombuffer(at, "<i8")]
                out[1] += [x[k : k + 8 * dim] for k in range(0, len(x), 8 * dim)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["query", "q"])

    asked = blocks.filter("asks > 0").select("block", "ask_at", "ask_vectors").mapInArrow(unpack, "query long, q binary")
    ids = table.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "q").distinct()
    out = ids.join(asked, "q").join(best, "query").filter("query_id <> vec_id").select("query_id", "vec_id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
