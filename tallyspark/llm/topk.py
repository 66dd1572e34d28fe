"""Exact top-k search by Fagin's threshold algorithm.

Every task holds a block of vectors as one sorted list per dimension and walks these lists for
each query from the favourable end (largest components where the query's is positive, smallest
where it is negative), further each time in the lists whose next stretch lowers the bound most.
All rows met are scored in full. What no list has shown yet has no component beyond the lists'
present depths, and no norm beyond the block's largest: the largest product a vector within both limits
can have with the query bounds it. The walk stops once that bound is below the kth score, of this
block or of an earlier one of the task (one number a query is carried from block to block).
There is no other way out: where the bound cannot stop it, the walk goes on until every row is met.
Queries are read in blocks from a table in the shared folder, never broadcast. Each block returns
at most k rows a query, and a ranking window keeps the k best.

Components are floor(scale * x); scores are exact integers (floating point only while every sum
stays below 2^53, Python integers beyond, kept within 64 bits in the result).
Left out: rows whose vector is null or has null or non-finite components, and rows without an id.
Vectors of different lengths never meet. A query's own row is every row with its id; if several
rows share a query's id, the smallest vector asks. Repeated rows are candidates each; ties of score go to
the smaller id. Very long vectors: a block holds ``BLOCK_VALUES`` components or one vector. Extra columns are
ignored, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import _files
from tallyspark.llm._memory import trimmed
from tallyspark.llm._store import Scratch

SCALE, EVERY, K = 1024, 100, 10
BLOCK_VALUES, QUERY_ROWS, STEP = 1 << 22, 1 << 12, 4
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Integer components as float64 where all are exact, as Python integers otherwise."""
    out = np.floor(np.asarray(vectors, np.float64) * scale)
    if not np.isfinite(out).all() or (out.size and np.abs(out).max() >= 2.0**53):
        return np.array([[_exact(x, scale) for x in v] for v in vectors], object).reshape(out.shape)
    return out


def _exact(x: float, scale: int) -> int:
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


def best_within(weights: np.ndarray, caps: np.ndarray, norm: float) -> float:
    """Upper bound of weights @ y over all y <= caps of the given norm at most (weights are positive).

    The best y is min(caps, x * weights) for the one x that uses up the norm; x is found by halving and rounded up."""
    full = float(weights @ caps)
    if float(caps @ caps) <= norm * norm or not len(caps):
        return full
    low, high = 0.0, norm / float(np.sqrt(weights @ weights))
    while np.square(np.minimum(caps, high * weights)).sum() < norm * norm:
        high *= 2
        if high > 1e300:
            return full
    for _ in range(30):
        middle = (low + high) / 2
        if np.square(np.minimum(caps, middle * weights)).sum() < norm * norm:
            low = middle
        else:
            high = middle
    return min(full, float(weights @ np.minimum(caps, high * weights)) * (1 + 1e-9) + 1)


class Block:
    """Vectors of one length with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.n, self.scored = ids, rows, len(ids), 0
        self.most = max((abs(int(x)) for x in rows.ravel()), default=0) if rows.dtype == object else (float(np.abs(rows).max()) if rows.size else 0)
        self.norm = float("inf") if rows.dtype == object or not rows.size else float(np.sqrt(np.square(rows).sum(1).max())) * (1 + 1e-9)
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(rows, self.order.T, axis=0).T.copy()

    def top(self, query: np.ndarray, own: int, k: int, floor=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id; rows below ``floor`` may be left out."""
        rows, lists, n = self.rows, self.sorted, self.n
        if rows.dtype != object and (query.dtype == object or self.most * float(np.abs(query).sum()) >= 2.0**53):
            rows, lists = rows.astype(np.int64).astype(object), lists.astype(np.int64).astype(object)
        if rows.dtype == object and query.dtype != object:
            query = query.astype(np.int64).astype(object)
        exact = rows.dtype == object
        dims = np.flatnonzero(query != 0)
        up = (query[dims] > 0).astype(bool)
        weights = np.abs(query[dims])
        depth, step = np.zeros(len(dims), np.int64), np.full(len(dims), STEP, np.int64)
        unseen, left = np.ones(n, bool), n
        ids, scores = np.empty(0, np.int64), np.empty(0, rows.dtype)

        def caps(at):
            """Per list, the best component (in the query's direction) from depth ``at`` on."""
            place = np.minimum(at, n - 1)
            return np.where(up, lists[dims, n - 1 - place], -lists[dims, place])

        def meet(at):
            nonlocal ids, scores, left
            unseen[at] = False
            left -= len(at)
            self.scored += len(at)
            at = at[self.ids[at] != own]
            new = rows[at] @ query if rows.shape[1] else np.zeros(len(at), rows.dtype)
            if len(scores) >= k:
                fair = new >= scores[-1]
                at, new = at[fair], new[fair]
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, new])
            best = np.lexsort((ids, -scores))[:k] if not exact else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
            ids, scores = ids[best], scores[best]

        if not len(dims):  # all products are 0: the smallest ids
            meet(np.arange(n))
        while left:
            now = caps(depth)
            bound = weights @ now if exact else best_within(weights, now, self.norm)
            if (len(scores) >= k and bound < scores[-1]) or (floor is not None and bound < floor):
                break
            to = np.minimum(depth + step, n)
            drop = weights * (now - caps(to))
            chosen = np.flatnonzero((depth < n) & (drop >= drop.sum() / len(dims)))
            if not len(chosen):
                chosen = np.flatnonzero(depth < n)
            met = [self.order[dims[i], n - to[i] : n - depth[i]] if up[i] else self.order[dims[i], depth[i] : to[i]] for i in chosen.tolist()]
            met = np.concatenate(met)
            meet(np.unique(met[unseen[met]]))
            depth[chosen] = to[chosen]
            step[chosen] *= 2
        if floor is not None:
            ids, scores = ids[scores >= floor], scores[scores >= floor]
        return ids, scores


def _lengths(column: pa.Array):
    """(row numbers, matrix) of the vectors of each length."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(ends) - ends
    for n in np.unique(ends).tolist():
        rows = np.flatnonzero(ends == n)
        yield rows, values[(starts[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)


def _search(folder: str, scale: int, k: int):
    def blocks(batches):
        """Per length of vectors: ids and components."""
        held, size = defaultdict(list), 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, vectors in _lengths(batch.column(1)):
                most = max(1, BLOCK_VALUES // max(1, vectors.shape[1]))
                for at in range(0, len(rows), most):
                    held[vectors.shape[1]].append((ids[rows[at : at + most]], vectors[at : at + most]))
                    size += vectors[at : at + most].size + 1
                    if size >= BLOCK_VALUES:
                        yield held
                        held, size = defaultdict(list), 0
        if held:
            yield held

    def queries():
        for system, path in _files.parquet_files(folder):
            with system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(QUERY_ROWS, columns=["vec_id", "embedding"]):
                    ids = batch.column(0).to_numpy()
                    column = batch.column(1)
                    for rows, vectors in _lengths(column):
                        yield ids[rows], vectors

    def run(batches):
        carried: list[dict] = []  # per block of queries: what the kth best row of an earlier block scored
        for held in blocks(batches):
            by = {n: Block(np.concatenate([i for i, _ in parts]), scaled(np.concatenate([v for _, v in parts]), scale)) for n, parts in held.items()}
            out = [[], [], []]
            for number, (ids, vectors) in enumerate(queries()):
                if number == len(carried):
                    carried.append({})
                if not (block := by.get(vectors.shape[1])):
                    continue
                floors = carried[number]
                for i, query in enumerate(vectors):
                    found, scores = block.top(scaled(query[None], scale)[0], ids[i], k, floors.get(i))
                    if len(found) == k:
                        floors[i] = scores[-1]
                    out[0] += [int(ids[i])] * len(found)
                    out[1] += found.tolist()
                    out[2] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
                if len(out[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=FOUND)
                    out = [[], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=FOUND)

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; queries: rows of ``vectors`` whose id is divisible by EVERY unless given."""
    store = Scratch(vectors.sparkSession, "topk")

    def sound(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        finite = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)

    rows = sound(vectors)
    asked = sound(queries) if queries is not None else rows.filter(F.col("vec_id") % EVERY == 0)
    store.table("queries", asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    found = rows.mapInArrow(trimmed(_search(f"{store.path}/queries", scale, k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
