"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree, verified until a chi-square test holds.

Largest inner products are nearest neighbours after each vector gets one more component, sqrt(M^2 - |x|^2), with M the
largest norm, and each query is brought to the length M with a zero behind. Vectors are projected to ``DIMENSIONS`` by
Gaussian directions. The top levels of a kd-tree over the projections, fitted on at most about ``SAMPLE`` vectors, cut the
table into parts; every vector is in one, and a part of more than ``SHARD`` vectors is dealt into shards by a hash. A
shard has the lower levels of the tree.

A query first goes to one shard of its own part. Its k-th best inner product there tells which other parts the stopping
test leaves open, by their boxes' projected distance, and only to those it is sent. Within a shard, leaves whose box is
closed are left out, and vectors are verified on all components in the order of their projected distance, until the
chi-square test says that a vector as near as the k-th best would have had a smaller one with probability ``SURE``.

Of equal vectors only the k + 1 with the smallest ids can be among anyone's k best, so only those are indexed apart.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most take no
part, nor do rows with a null id; rows that share an id count as one (the least of their vectors). Ties go to the smaller
id. With fewer candidates than asked for, all are returned. Ids are whole numbers; a text id that isn't one counts as null.
Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import need, ship, shuffle_width, stored, table

NEAREST = 20
DIMENSIONS = 16
SURE = 0.88
#: Vectors of a shard and of a leaf; vectors that the upper levels are fitted on, and parts that they make at most.
SHARD, LEAF = 16_384, 64
SAMPLE, PARTS = 20_000, 256
#: Projected neighbours that are verified before the test, and again; queries that step together.
STEPS, TOGETHER = (64, 256, 1024, 4096), 64
_SALTS = 256


def chi_square(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(dimensions // 2))


def quantile(p: float, dimensions: int) -> float:
    """Where the distribution function is ``p``: the test holds from this multiple of the k-th best distance on."""
    low, high = 0.0, 100.0 * dimensions
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), dimensions) < p else (low, middle)
    return high


REACH = quantile(SURE, DIMENSIONS)


def ways(components: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((components + 1, DIMENSIONS))


def lowered(x: np.ndarray, norm: float, way: np.ndarray) -> np.ndarray:
    """Projections of vectors with the component that brings them to the length ``norm``."""
    return x @ way[:-1] + np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))[:, None] * way[-1]


def kd_tree(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The points' numbers by leaf: the widest side is halved at its median until ``leaf`` are left."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        side = np.ptp(points[own], axis=0).argmax()
        half = leaf * max(1, round(len(own) / leaf / 2))
        order = np.argpartition(points[own, side], half)
        todo += [own[order[half:]], own[order[:half]]]
    return out


class Top:
    """The upper levels: a complete tree of ``depth`` levels, each node halving its sample at the median of its widest side."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.side, self.cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        groups = {0: points}
        for node in range(2**depth - 1):
            own = groups.pop(node)
            if len(own):
                self.side[node] = side = np.ptp(own, axis=0).argmax()
                self.cut[node] = np.median(own[:, side])
            above = own[:, self.side[node]] > self.cut[node]
            groups[2 * node + 1], groups[2 * node + 2] = own[~above], own[above]

    def part(self, low: np.ndarray) -> np.ndarray:
        node = np.zeros(len(low), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (low[np.arange(len(low)), self.side[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _gap(low: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    return sum(np.maximum(0, np.maximum(least[:, d] - low[:, d : d + 1], low[:, d : d + 1] - most[:, d])) ** 2 for d in range(low.shape[1]))


def _radius(q: np.ndarray, worst: np.ndarray, norm: float) -> np.ndarray:
    """Squared projected distance from which on the test holds, for queries whose k-th best inner product is ``worst``."""
    size = np.sqrt((q**2).sum(1))
    return np.maximum(0, 2 * norm**2 - 2 * norm * worst / size) * REACH + 1e-9 * norm**2


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float):
        self.norm, self.way, self.verified = norm, ways(x.shape[1]), 0
        low = lowered(x, norm, self.way)
        leaves = kd_tree(low, LEAF)
        order = np.concatenate(leaves)
        self.ids, self.x, self.low = ids[order], x[order], low[order]
        self.size = np.array([len(own) for own in leaves])
        first = np.cumsum(self.size) - self.size
        self.least, self.most = np.minimum.reduceat(self.low, first), np.maximum.reduceat(self.low, first)

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number of the vector or -1, inner product) of each query's ``k`` best here; ``floor``: the k-th best known elsewhere."""
        n = len(q)
        floor = np.full(n, -np.inf) if floor is None else floor
        best, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        low = q * (self.norm / np.sqrt((q**2).sum(1)))[:, None] @ self.way[:-1]
        open_leaves = (_gap(low, self.least, self.most) <= _radius(q, floor, self.norm)[:, None]).any(0)
        near = np.flatnonzero(np.repeat(open_leaves, self.size))
        far = (low**2).sum(1)[:, None] + (self.low[near] ** 2).sum(1) - 2 * low @ self.low[near].T
        far[self.ids[near] == ids[:, None]] = np.inf
        for step in (*STEPS, None):
            if step and step < len(near):
                row = np.repeat(np.arange(n), step)
                col = np.argpartition(far, step - 1, axis=1)[:, :step].ravel()
            elif len(near):
                row, col = np.nonzero(far <= _radius(q, np.maximum(floor, best[:, -1]), self.norm)[:, None])
            else:
                break
            good = far[row, col] <= _radius(q, np.maximum(floor, best[:, -1]), self.norm)[row]
            good &= np.isfinite(far[row, col])
            row, col = row[good], col[good]
            far[row, col] = np.inf
            self.verified += len(row)
            at, score = near[col], np.empty(len(row))
            for i in range(0, len(row), 65_536):
                j = slice(i, i + 65_536)
                score[j] = np.einsum("pd,pd->p", self.x[at[j]], q[row[j]])
            keep = score >= best[row, -1]
            held = np.flatnonzero(place.ravel() >= 0)
            row = np.concatenate([held // k, row[keep]])
            at, score = np.concatenate([place.ravel()[held], at[keep]]), np.concatenate([best.ravel()[held], score[keep]])
            order = np.lexsort((self.ids[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < k
            place[row[top], rank[top]], best[row[top], rank[top]] = at[top], score[top]
            if step and step >= len(near):
                break
        return place, best


def _in_order(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products added up component by component: equal vectors get equal numbers wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[:, d]
    return out


def _searched(k: int, norm: float):
    """Rows come by shard, its vectors (kind 0) before the queries (kind 1)."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, index = None, [], [], None
        for b in batches:
            where, kind, names, floor = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "id", "floor"))
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cuts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1]))) if len(where) else []
            for a, z in zip(cuts, np.append(cuts[1:], len(where)), strict=True):
                if where[a] != shard:
                    shard, ids, vectors, index = where[a], [], [], None
                if not kind[a]:
                    ids.append(names[a:z])
                    vectors.append(x[a:z])
                    continue
                if not ids:
                    continue
                index = index or Shard(np.concatenate(ids), np.concatenate(vectors), norm)
                for i in range(a, z, TOGETHER):
                    some = slice(i, min(i + TOGETHER, z))
                    place, best = index.search(names[some], x[some], k, floor[some])
                    row, col = np.nonzero((place >= 0) & (best >= floor[some][:, None] - 1e-9 * norm**2))
                    at = place[row, col]
                    yield pa.RecordBatch.from_arrays([pa.array(names[some][row]), pa.array(index.ids[at]), pa.array(_in_order(index.x[at], x[some][row]))], ["query_id", "vec_id", "score"])

    return searched


def valid(vectors: DataFrame) -> DataFrame:
    """Of (id, v): the vectors that take part, in double precision, one for each id."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where("v IS NOT NULL").select(F.expr("try_cast(id AS bigint)").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def first_copies(rows: DataFrame, many: int) -> DataFrame:
    """Of equal vectors those with the ``many`` smallest ids; a vector of very many rows is cut down in ``_SALTS`` parts first."""
    for keys in (("v", F.pmod(F.xxhash64("id"), F.lit(_SALTS))), ("v",)):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= many).drop("n")
    return rows


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors whose id is divisible by ``every``, against all others."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(valid(need(vectors, id=id_col, v=vector_col)), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, norm, components = rows.agg(F.count("*"), F.coalesce(F.sqrt(F.max(square)), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    way = ways(components)
    depth = max(0, min(int(math.log2(PARTS)), math.ceil(math.log2(max(1, n) / SHARD))))
    matrix = lambda b: b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def projected(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(lowered(matrix(b), norm, way)), pa.list_(pa.float64()))], ["low"])

    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select("v") if depth else rows.limit(0).select("v")
    sample = drawn.mapInArrow(projected, "low array<double>").toArrow().column("low").to_pylist()  # about SAMPLE rows
    top = Top(np.array(sample, float).reshape(len(sample), DIMENSIONS), depth)

    def parted(batches):
        for b in batches:
            if b.num_rows:
                low = lowered(matrix(b), norm, way)
                yield b.append_column("part", pa.array(top.part(low)))

    def boxed(batches):
        least, most, many = np.full((2**depth, DIMENSIONS), np.inf), np.full((2**depth, DIMENSIONS), -np.inf), np.zeros(2**depth, np.int64)
        for b in batches:
            if b.num_rows:
                low, part = lowered(matrix(b), norm, way), b.column("part").to_numpy(zero_copy_only=False)
                np.minimum.at(least, part, low)
                np.maximum.at(most, part, low)
                many += np.bincount(part, minlength=2**depth)
        part, side = np.nonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part, side, least[part, side], most[part, side], many[part])], ["part", "side", "least", "most", "many"])

    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    placed = stored(first_copies(rows, k + 1).mapInArrow(parted, "id long, v array<double>, part long"), "parts")
    boxes = placed.mapInArrow(boxed, "part long, side long, least double, most double, many long")
    boxes = boxes.groupBy("part", "side").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("many").alias("many")).toPandas()  # a row for each part and side
    least, most, shards = np.full((2**depth, DIMENSIONS), np.inf), np.full((2**depth, DIMENSIONS), -np.inf), np.zeros(2**depth, np.int64)
    at = boxes["part"].to_numpy(int), boxes["side"].to_numpy(int)
    least[at], most[at], shards[at[0]] = boxes["least"], boxes["most"], -(-boxes["many"].to_numpy(int) // SHARD)
    first = np.cumsum(shards) - shards
    of = lambda values: F.get(F.array(*map(F.lit, values.tolist())), F.col("part").cast("int"))
    shard = of(first) + F.pmod(F.xxhash64("id"), of(np.maximum(shards, 1)))
    own = placed.select(shard.alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))
    width = max(1, min(int(shards.sum()), 4 * shuffle_width(spark)))

    def found(queries: DataFrame) -> DataFrame:
        dealt = own.union(queries.select("shard", F.lit(1), "id", "v", "floor")).repartition(width, "shard").sortWithinPartitions("shard", "kind", "id")
        return stored(dealt.mapInArrow(_searched(k, norm), "query_id long, vec_id long, score double"), "found")

    def routed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, floor, done = matrix(b), b.column("floor").to_numpy(zero_copy_only=False), b.column("shard").to_numpy(zero_copy_only=False)
            low = q * (norm / np.sqrt((q**2).sum(1)))[:, None] @ way[:-1]
            row, part = np.nonzero((_gap(low, least, most) <= _radius(q, floor, norm)[:, None]) & (shards > 0))
            many = shards[part]
            row, part = np.repeat(row, many), np.repeat(part, many)
            to = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[part]
            row, to = row[to != done[row]], to[to != done[row]]
            picked = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to), *(picked.column(c) for c in ("id", "v", "floor"))], ["shard", "id", "v", "floor"])

    begun = asked.mapInArrow(parted, "id long, v array<double>, part long").select("id", "v", shard.alias("shard"), F.lit(-math.inf).alias("floor"))
    begun = stored(begun, "asked")
    near = found(begun)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    floors = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    again = begun.join(floors, "id", "left").select("id", "v", "shard", F.coalesce("known", "floor").alias("floor"))
    rest = found(again.mapInArrow(routed, "shard long, id long, v array<double>, floor double"))
    return ranked(near.union(rest)).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
