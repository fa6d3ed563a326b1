"""Nearest neighbours of a query set by a block matrix join over int8 codes.

Queries and candidates are dealt to blocks of bounded size, and every block of queries meets every block of
candidates in one group. Each vector is coded as int8 times a scale of its own; the product of two blocks
of codes gives approximate distances, and the length of each coding error bounds how far off
they are. Pairs whose least possible distance is above the k-th greatest possible one are left out; the
others are computed from the original vectors in double precision and kept in heaps of k per query.
The bound holds for every pair, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from firn.llm.lines import query, table
from firn.session import materialize

NEAREST = 10
BLOCK_ROWS = 8192
BLOCK_BYTES = 1 << 24
TILE_ROWS = 256
_SLACK = 1e-9
_FOUND = "query_row long, query_id long, vec_id long, row long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Coded:
    """int8 codes of the rows of a matrix, with what the bounds need."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        scale = np.abs(values).max(axis=1) / 127.0
        safe = np.where(scale > 0, scale, 1.0)
        self.codes = np.rint(values / safe[:, None]).clip(-127, 127).astype(np.int8)
        self.scale = safe
        decoded = self.codes * safe[:, None]
        self.error = _length(values - decoded)
        self.size, self.decoded_size = _length(values), _length(decoded)

    def products(self, other: Coded) -> np.ndarray:
        """Inner products of codes. float32 holds every sum exactly up to 1040 components, float64 beyond."""
        kind = np.float32 if self.codes.shape[1] <= 1040 else np.float64
        return (self.codes.astype(kind) @ other.codes.astype(kind).T).astype(np.float64)

    def rows(self, start: int, stop: int) -> Coded:
        part = object.__new__(Coded)
        for name in ("values", "scale", "codes", "error", "size", "decoded_size"):
            setattr(part, name, getattr(self, name)[start:stop])
        return part


def _length(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired rows; components are added one after the other, so equal pairs agree to the bit."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        gap = left[:, j] - right[:, j]
        total += gap * gap
    return np.sqrt(total)


def bounds(queries: Coded, others: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible squared distance of every pair.

    x.y - x'.y' = (x - x').y + x'.(y - y'), so the product of codes is off by at most |x - x'||y| + |x'||y - y'|.
    """
    product = queries.products(others) * queries.scale[:, None] * others.scale
    off = queries.error[:, None] * others.size + queries.decoded_size[:, None] * others.error
    squares = (queries.size**2)[:, None] + others.size**2
    middle, reach = squares - 2 * product, 2 * off + _SLACK * squares
    return middle - reach, middle + reach


class Heaps:
    """The k nearest of each query so far. Entries are negated keys, so the worst is on top of its heap."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(queries)]

    def worst(self, start: int, stop: int) -> np.ndarray:
        return np.array([-h[0][0] if len(h) == self.k else np.inf for h in self.heaps[start:stop]])

    def add(self, at: int, score: float, missing: int, vec_id: int, row: int) -> None:
        entry, heap = (-score, -missing, -vec_id, -row), self.heaps[at]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _matrix(rows: pa.Table) -> np.ndarray:
    vectors = rows.column("vector").combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def search_block(queries: pa.Table, candidates: pa.Table, k: int, tile: int = TILE_ROWS, seen: list | None = None) -> Heaps:
    """The k nearest candidates of each query: tile by tile, bounds first, doubles for the pairs they leave.

    ``seen`` collects how many pairs of each tile were computed from the original vectors.
    """
    left, right = Coded(_matrix(queries)), Coded(_matrix(candidates))
    query_rows = queries.column("row").to_numpy()
    rows = candidates.column("row").to_numpy()
    ids = candidates.column("vec_id").combine_chunks()
    missing, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
    heaps = Heaps(len(query_rows), k)
    for first in range(0, len(rows), 8 * tile):
        here = slice(first, min(first + 8 * tile, len(rows)))
        block = right.rows(here.start, here.stop)
        for start in range(0, len(query_rows), tile):
            stop = min(start + tile, len(query_rows))
            least, most = bounds(left.rows(start, stop), block)
            own = query_rows[start:stop, None] == rows[here]
            most[own] = np.inf
            if most.shape[1] > k:
                limit = np.partition(most, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(stop - start, np.inf)
            limit = np.minimum(limit, heaps.worst(start, stop) ** 2 * (1 + _SLACK))
            near, other = np.nonzero((least <= limit[:, None]) & ~own)
            if seen is not None:
                seen.append(len(near))
            near += start
            other += here.start
            score = distance(left.values[near], right.values[other])
            order = np.lexsort((rows[other], ids[other], missing[other], score, near))
            near, other, score = near[order], other[order], score[order]
            place = np.arange(len(near)) - np.searchsorted(near, near)
            for i in np.flatnonzero(place < k):
                j = other[i]
                heaps.add(int(near[i]), float(score[i]), int(missing[j]), int(ids[j]), int(rows[j]))
    return heaps


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest other rows of each query row.

    Nearness is the smallest Euclidean distance in double precision, ties to the smaller id, null ids
    last. Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors meet only
    those of their own number of components. With fewer than ``k`` candidates all are returned; an empty table gives an
    empty result. Rows that repeat an id (or a vector) are rows of their own: each repeated query row has its
    own ranks and may find its copy at distance 0. Other columns are not read.

    A candidate is shuffled once for each block of queries (at most ``BLOCK_ROWS`` of them), a query once for each block of candidates, and
    each group sends on k rows per query. Copies of one vector are spread over all groups.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    rows = rows.filter(usable(F.col("vector"))).select("*", F.monotonically_increasing_id().alias("row"), F.size("vector").alias("_width"))
    rows = materialize(rows, "vectors")
    total, asked, widest = rows.agg(F.count("*"), F.count_if("_query"), F.max("_width")).head()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(TILE_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (8 * widest)))
    left_blocks, right_blocks = -(-asked // size), -(-total // size)

    def dealt(count: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    queries = rows.filter("_query").select("row", "vec_id", "vector", "_width", dealt(left_blocks, 1).alias("_left"), every(right_blocks).alias("_right"))
    # Columns under names of their own: where both sides share columns, a later projection would prune the right side's.
    shared = [F.col(c).alias(c) for c in ("row", "vec_id", "vector", "_width")]
    others = rows.select(*shared, every(left_blocks).alias("_left"), dealt(right_blocks, 2).alias("_right"))

    def search(asking: pa.Table, given: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(asking) and len(given):
            heaps = search_block(asking, given, k).heaps
            for row, query_id, heap in zip(asking.column("row").to_pylist(), asking.column("vec_id").to_pylist(), heaps):
                for score, missing, found, at in heap:
                    for column, value in zip(out, (row, query_id, None if missing else -found, -at, -score)):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query_row", "query_id", "vec_id", "row", "score"])

    key = ["_width", "_left", "_right"]
    found = queries.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(search, _FOUND)
    best = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 10
"""


@query("op12_nearest", _SQL)
def op12_nearest(spark, folder):
    """The ten nearest other rows of every row of ``embeddings`` whose vec_id is divisible by 100."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
