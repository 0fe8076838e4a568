"""Approximate nearest neighbours as a block matrix join, with exact results.

Every vector is scaled to int8 once, by its own largest component, with the length of the
rounding error kept beside it. Query blocks meet runs of candidates: a task holds the int8
rows of one query block and takes its candidates tile by tile, so that what it holds does not
depend on the size of the table, and there are at most about `TASKS` tasks. The product of two
int8 matrices approximates all inner products of a tile, and with q = s u + e and x = t v + f

    |q.x - s t u.v| <= |e| |x| + |q| |f| + |e| |f|

bounds how wrong each can be. Of candidates that are equal vectors only the k + 1 with the
smallest ids can be among the k best of any query but themselves; the others are left out before
anything meets, by a ranking whose limit applies ahead of its shuffle. A query keeps the k best lower bounds it has met; pairs whose
upper bound is below the least of these cannot be among its k best. What survives the tiles of
one task is pruned once more by the bounds of all, and only the survivors, about k a query,
fetch the original vectors: their inner products are computed in double precision, and heaps
of k merge them. So nothing is lost to quantisation: recall is 1.

The tile product is taken in single precision on int8 values: products and sums stay below
2**24 for up to 1,040 components, so it is exact integer arithmetic (and beyond that, double).

Defined cases: vectors that are null, empty, all zero, or with a null or non-finite component
take no part; nor do rows without an id; vectors meet those of equal length, as no other
inner product exists; a query meets every row but its own, so repeated rows meet one another,
and each row of an id that is searched has its own list; fewer than k candidates give fewer
rows; ties go to the smaller id; an empty table gives no rows; other columns may have any
names.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import grouped, materialize

K, EVERY = 20, 20
#: Queries of a block, candidates of a tile, and tasks: at least, so that small tables use the whole
#: cluster too, and at most, about.
QUERY_BLOCK, TILE, LEAST_TASKS, TASKS = 32_768, 16_384, 32, 20_000
#: Queries whose products with a tile are held at once, and survivors before they are pruned.
STEP, HELD = 256, 4_000_000


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale, length of the error, length of the row; both lengths rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # a component below the smallest double over 127
    u = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - u * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return u, scale, error, np.sqrt((x**2).sum(axis=1)) * (1 + 1e-9)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed from the first component to the last."""
    return np.add.accumulate(q * x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


class Block:
    """The queries of one block, and what survives of the candidates they have met."""

    def __init__(self, row: np.ndarray, u: np.ndarray, scale: np.ndarray, error: np.ndarray, norm: np.ndarray, k: int) -> None:
        self.row, self.scale, self.error, self.norm, self.k = row, scale, error, norm, k
        self.kind = np.float32 if u.shape[1] <= 1040 else np.float64
        self.u = u.astype(self.kind)
        self.best = np.full((len(row), k), -np.inf)  # lower bounds, the least in front
        self.found: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def meet(self, row: np.ndarray, u: np.ndarray, scale: np.ndarray, error: np.ndarray, norm: np.ndarray) -> None:
        """One tile."""
        xt = u.T.astype(self.kind)
        for at in range(0, len(self.row), STEP):
            s = slice(at, at + STEP)
            with np.errstate(invalid="ignore", over="ignore"):
                near = (self.u[s] @ xt).astype(np.float64) * self.scale[s, None] * scale
                # the last term covers rounding in the bound and in the recomputed sum
                wide = self.error[s, None] * norm + (self.norm[s, None] + self.error[s, None]) * error + self.norm[s, None] * norm * 1e-12
                low, high = near - wide, near + wide
            own = self.row[s, None] == row
            low[own | np.isnan(low)] = -np.inf
            high[np.isnan(high)] = np.inf  # beyond doubles: nothing is known
            both = np.concatenate([self.best[s], low], axis=1)
            self.best[s] = np.partition(both, -self.k, axis=1)[:, -self.k :]
            q, x = np.nonzero((high >= self.best[s, :1]) & ~own)
            self.found.append((q + at, row[x], low[q, x], high[q, x]))
            self.count += len(q)
        if self.count > HELD:
            self.found = [self.survivors()]
            self.count = len(self.found[0][0])

    def survivors(self) -> tuple[np.ndarray, ...]:
        """query (place in the block), candidate row, lower and upper bound."""
        q, x, low, high = (np.concatenate(c) for c in zip(*self.found))
        keep = high >= self.best[q, 0]
        return q[keep], x[keep], low[keep], high[keep]


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number of its own), id, vec (array<double>), d: the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    v = v.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", good) & F.exists("vec", lambda c: c != 0))
    return v.select(F.monotonically_increasing_id().alias("row"), "id", "vec", F.size("vec").alias("d"))


def _small(v: DataFrame) -> DataFrame:
    """row, id, d, u (the int8 components), scale, error, norm, same (digest of the vector)."""

    def run(it):
        for b in it:
            d = b.column(3).to_numpy()
            vec = b.column(2)
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                x = vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                u, scale, error, norm = quantised(x)
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(scale), pa.array(error), pa.array(norm), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in x], pa.binary())], names=["row", "id", "d", "u", "scale", "error", "norm", "same"])

    return v.select("row", "id", "vec", "d").mapInArrow(run, "row long, id long, d int, u binary, scale double, error double, norm double, same binary")


def _tiles(rows: DataFrame, k: int) -> DataFrame:
    """rows: d, i, r (query block and run of candidates), side (0: query), row, u, scale, error,
    norm, sorted by the first four -> q, x (rows), low, high: possible neighbours."""

    def run(it):
        block, now, held, queries = None, None, [], []

        def parts(batches):
            t = pa.Table.from_batches(batches)
            d = t["d"][0].as_py()
            u = np.frombuffer(b"".join(t["u"].to_pylist()), np.int8).reshape(-1, d)
            return t["row"].to_numpy(), u, *(t[c].to_numpy() for c in ("scale", "error", "norm"))

        def flush():
            nonlocal block, held, queries
            if queries:
                block, queries = Block(*parts(queries), k), []
            if held and block is not None:
                block.meet(*parts(held))
            held = []

        def result():
            nonlocal block
            if block is not None and block.found:
                q, x, low, high = block.survivors()
                for at in range(0, len(q), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(block.row[q[s]]), pa.array(x[s]), pa.array(low[s]), pa.array(high[s])], names=["q", "x", "low", "high"])
            block = None

        size = 0
        for b in it:
            key = np.stack([b.column(c).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero(np.any(np.diff(key) != 0, axis=0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                at = tuple(key[:3, a].tolist())
                if at != now:
                    flush()
                    yield from result()
                    now, size = at, 0
                if key[3, a] == 0:
                    queries.append(b.slice(a, z - a))
                    continue
                while a < z:
                    n = min(z - a, TILE - size)
                    held.append(b.slice(a, n))
                    a, size = a + n, size + n
                    if size == TILE:
                        flush()
                        size = 0
        flush()
        yield from result()

    return rows.mapInArrow(run, "q long, x long, low double, high double")


def _pruned(found: DataFrame, k: int) -> DataFrame:
    """q, x: of what the tasks found, the pairs that can be among the k best of their query. The k best
    lower bounds are picked ahead of a shuffle, and no query's pairs are gathered."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    best = found.select("q", "low").withColumn("place", place).where(F.col("place") <= k)
    least = materialize(best.groupBy("q").agg(F.when(F.count("*") == k, F.min("low")).alias("least")), "least-bounds")
    return found.join(least, "q").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("q", "x")


class Heaps:
    """The k best candidates of each query so far: by score, then by id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.of: dict[tuple[int, int], list[tuple[float, int]]] = {}

    def add(self, q: list, query_id: list, score: list, vec_id: list) -> None:
        for a, i, s, v in zip(q, query_id, score, vec_id):
            heap = self.of.setdefault((a, i), [])
            heap.append((-s, v))
            if len(heap) > 8 * self.k:
                heap[:] = heapq.nsmallest(self.k, heap)

    def rows(self):
        """query, its id, place, candidate, score."""
        for (q, i), heap in self.of.items():
            for n, (s, v) in enumerate(heapq.nsmallest(self.k, heap), 1):
                yield q, i, n, v, -s + 0.0


def _merged(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: q, query_id, vec_id, qvec, vec -> query_id, rank, vec_id, score. Each partition keeps heaps
    of its pairs, and only these are merged by query."""

    def score(it):
        heaps = Heaps(k)
        for b in it:
            d = pc.list_value_length(b.column(3)).to_numpy()
            for size in np.unique(d):
                own = b.take(pa.array(np.flatnonzero(d == size)))
                q, x = (own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for c in (3, 4))
                heaps.add(own.column(0).to_pylist(), own.column(1).to_pylist(), dots(q, x).tolist(), own.column(2).to_pylist())
            if len(heaps.of) > 200_000:  # bounds memory; the rest meets in the merge
                yield batch(heaps, False)
                heaps = Heaps(k)
        yield batch(heaps, False)

    def batch(heaps: Heaps, last: bool) -> pa.RecordBatch:
        cols = list(zip(*heaps.rows())) or [[]] * 5
        kinds = (("q", pa.int64()), ("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (n, kind) in zip(cols, kinds) if not last or n != "q"], names=[n for n, _ in kinds if not last or n != "q"])

    def merge(it):
        for t in grouped(it, ["q"], 1 << 16):
            heaps = Heaps(k)
            heaps.add(*(t[c].to_pylist() for c in ("q", "query_id", "score", "vec_id")))
            yield batch(heaps, True)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = pairs.select("q", "query_id", "vec_id", "qvec", "vec").mapInArrow(score, "q long, query_id long, rank int, vec_id long, score double")
    return scored.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest."""
    v = materialize(prepared(vectors, id_col, vec_col), "vectors")
    small = materialize(_small(v), "int8-vectors")
    asks = F.col("id") % every == 0
    n, q = small.agg(F.count("*"), F.count_if(asks)).first()
    blocks = max(1, -(-q // QUERY_BLOCK))
    runs = max(-(-LEAST_TASKS // blocks), min(-(-n // TILE), TASKS // blocks))
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rest = ["row", "u", "scale", "error", "norm"]
    equal = F.row_number().over(Window.partitionBy("same").orderBy("id", "row"))
    x = small.withColumn("equal", equal).where(F.col("equal") <= k + 1).select("d", every_one(blocks).alias("i"), deal(runs, 1).alias("r"), F.lit(1).alias("side"), *rest)
    a = small.where(asks).select("d", deal(blocks, 2).alias("i"), every_one(runs).alias("r"), F.lit(0).alias("side"), *rest)
    rows = a.unionByName(x).repartitionById(blocks * runs, F.col("i") * runs + F.col("r")).sortWithinPartitions("d", "i", "r", "side", "row")
    found = materialize(_tiles(rows, k), "tile-survivors")
    pairs = materialize(_pruned(found, k), "survivors")
    # by candidate last: the pairs of one query are spread
    full = pairs.join(v.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "q")
    full = full.join(v.select(F.col("row").alias("x"), F.col("id").alias("vec_id"), "vec"), "x")
    return _merged(full, k)


def op4(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
with v as (
  select row_number() over () as row, vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.row, q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score
  from v q join v on q.row <> v.row and len(q.e) = len(v.e) where q.vec_id % 20 = 0),
r as (
  select *, row_number() over (partition by row order by score desc, vec_id)::integer as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""
