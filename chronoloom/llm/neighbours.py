"""Nearest neighbours by cosine as a block matrix join.

Vectors become int8 codes with a scale and the norm of the rounding error; codes alone
are dealt into blocks of queries and tiles of candidates of bounded size, and Spark brings
each pair of them together (a stated query set against all rows, in blocks). In a task,
one product of int8 codes gives all approximate cosines, and the errors bound how far each
can be off. Pairs whose upper bound is below the k-th best lower bound of their query, in
the tile and then over all tiles, are discarded. The original vectors of the others, a few
for each query, are fetched and computed in double precision, and heaps keep the best.
Where more than MANY candidates of a tile stay open for a query, as codes do not tell near
copies apart, that tile's originals are brought to the query's instead, and the tile's k
best are found there: no query gathers a group of near copies.

The bounds hold for every pair, so the search is exact: recall is 1.

Defined results: vectors that are null, zero or empty, or hold null or non-finite
components, take no part, as rows with a null id; a query with fewer than k candidates
gets them all; of rows that repeat an id one counts, the shortest, then the one of the
smallest hash; vectors of another length than the query's are no candidates for it; equal
scores go by the smaller id; an empty table gives no rows; further columns are ignored;
very small and very large components are scaled by powers of two, so that nothing
underflows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stash

TILE, BLOCK = 8192, 2048
#: Candidates of a tile that a query fetches one by one at most.
MANY = 64
#: Vectors that are fetched by a broadcast of their ids at most.
SMALL_IDS = 1_000_000
_CODES = "vec_id long, dim int, pick long, code binary, scale double, error double"


def usable(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """(vec_id, v, dim, pick); pick tells rows of one id apart."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"), F.xxhash64(v).alias("pick"))


def _quantised(x: np.ndarray):
    """int8 codes of the unit vectors, scales and the norms of the rounding errors."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        at = np.r_[0, np.cumsum(dims)]
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            codes, scale, error = _quantised(flat[at[own][:, None] + np.arange(dim)[None, :]])
            data = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(own)), pa.array(np.full(len(own), dim, dtype=np.int32)), batch.column("pick").take(pa.array(own)), pa.array(data, pa.binary()), pa.array(scale), pa.array(error)], names=["vec_id", "dim", "pick", "code", "scale", "error"])


def _by_dim(table: pa.Table, copies: int | None = None) -> dict[int, tuple]:
    """(ids, codes, scales, errors) for each length, every id once; of equal vectors the
    ``copies`` smallest ids, as they score alike and no others can be among the best."""
    ids, dims, pick = (table.column(c).to_numpy() for c in ("vec_id", "dim", "pick"))
    order = np.lexsort((pick, dims, ids))
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
    if copies is not None:
        order = order[np.lexsort((ids[order], pick[order], dims[order]))]
        new = np.flatnonzero(np.r_[True, (pick[order][1:] != pick[order][:-1]) | (dims[order][1:] != dims[order][:-1])])
        order = order[np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)])) < copies]
    codes = table.column("code").to_pylist()
    out = {}
    for dim in np.unique(dims[order]):
        own = order[dims[order] == dim]
        code = np.frombuffer(b"".join([codes[i] for i in own]), dtype=np.int8).reshape(len(own), int(dim))
        out[int(dim)] = (ids[own], code, table.column("scale").to_numpy()[own], table.column("error").to_numpy()[own])
    return out


def _tile(k: int):
    """The pairs of a block and a tile that can be among a query's k best, with bounds."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0), np.zeros(0))]
        left = _by_dim(queries) if queries.num_rows else {}
        right = _by_dim(candidates, k + 1) if candidates.num_rows else {}  # one may be the query itself
        for dim in left.keys() & right.keys():
            (q_id, qc, qs, qe), (c_id, cc, cs, ce) = left[dim], right[dim]
            # products of int8 codes are exact in this type up to the given lengths
            kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
            columns = cc.astype(kind).T
            for i in range(0, len(q_id), 256):
                s = slice(i, i + 256)
                near = (qc[s].astype(kind) @ columns) * qs[s, None] * cs[None, :]
                off = qe[s, None] + (1 + qe[s, None]) * ce[None, :] + 1e-6
                low = near - off
                other = q_id[s, None] != c_id[None, :]
                low[~other] = -np.inf
                top = min(k, low.shape[1])
                bound = np.partition(low, low.shape[1] - top, axis=1)[:, low.shape[1] - top]
                a, b = np.nonzero((near + off >= np.maximum(bound, -2.0)[:, None]) & other)
                count = np.bincount(a, minlength=len(low))
                few = (count <= MANY)[a]
                out.append((q_id[a + i][few], c_id[b][few], np.zeros(few.sum(), bool), low[a, b][few], (near + off)[a, b][few]))
                # a tile that stays open for a query: its k best lower bounds, no candidates
                wide = np.flatnonzero(count > MANY)
                lows = -np.partition(-low[wide], top - 1, axis=1)[:, :top]
                highs = np.where(other, near + off, -2.0)[wide].max(axis=1) if len(wide) else np.zeros(0)
                out.append((np.repeat(q_id[wide + i], top), np.zeros(len(wide) * top, np.int64), np.ones(len(wide) * top, bool), lows.ravel(), np.repeat(highs, top)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        tile = candidates.column("tile")[0].as_py() if candidates.num_rows else 0
        return pa.table({**dict(zip(("query_id", "vec_id", "open", "low", "high"), columns, strict=True)), "tile": pa.array(np.full(len(columns[0]), tile, dtype=np.int32))})

    return run


def _vectors(table: pa.Table) -> dict[int, tuple]:
    """(ids, vectors) for each length, every id once, in double precision."""
    if not table.num_rows:
        return {}
    ids, dims, pick = (table.column(c).to_numpy() for c in ("vec_id", "dim", "pick"))
    order = np.lexsort((pick, dims, ids))
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
    flat = table.column("v").combine_chunks()
    flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.r_[0, np.cumsum(dims)]
    out = {}
    for dim in np.unique(dims[order]):
        own = order[dims[order] == dim]
        x = flat[at[own][:, None] + np.arange(dim)[None, :]]
        top = np.abs(x).max(axis=1)
        odd = (top < 1e-100) | (top > 1e100)
        x[odd] *= 2.0 ** np.clip(-np.floor(np.log2(top[odd])), -1000, 1000)[:, None]
        out[int(dim)] = (ids[own], x)
    return out


def _whole_tile(k: int):
    """The k best of a tile for queries that it stays open for, from original vectors."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        left, right = _vectors(queries), _vectors(candidates)
        for dim in left.keys() & right.keys():
            (q_id, q), (c_id, c) = left[dim], right[dim]
            norm = sum(c[:, j] * c[:, j] for j in range(dim))
            for i in range(len(q_id)):
                dot, own = np.zeros(len(c)), 0.0
                for j in range(dim):  # summed from the first component to the last
                    dot += q[i, j] * c[:, j]
                    own += q[i, j] * q[i, j]
                score = np.clip(dot / np.sqrt(own * norm), -1.0, 1.0)
                score[c_id == q_id[i]] = -np.inf
                best = np.flatnonzero(score >= np.partition(score, max(0, len(c) - k))[max(0, len(c) - k)])
                for s, v in heapq.nsmallest(k, zip((-score[best]).tolist(), c_id[best].tolist(), strict=True)):
                    if s < np.inf:
                        out.append((int(q_id[i]), v, -s))
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return run


def _scaled(v: Column) -> Column:
    """Vectors of extreme size times a power of two."""
    top = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(top)).cast("double"))))
    return F.when((top < 1e-100) | (top > 1e100), F.transform(v, lambda x: x * power)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, summed from the first component to the last."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def _originals(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The vectors of the ids, in double precision, one for each."""
    ids = ids.distinct()
    few = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    held = rows.join(few, "vec_id", "left_semi").groupBy("vec_id").agg(F.min_by("v", F.struct("dim", "pick")).alias("v"))
    return held.select(F.col("vec_id").alias(name), F.col("v").cast("array<double>").alias(f"{name}_v")).withColumn(f"{name}_v", _scaled(F.col(f"{name}_v")))


def _best(k: int):
    """The k best of each query in a batch, by heaps; what is left is ranked by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, c, x in zip(*(batch.column(n).to_pylist() for n in ("query_id", "vec_id", "score")), strict=True):
                heap = heaps.setdefault(q, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (x, -c))
            if len(heaps) > 10_000:
                yield _table(heaps)
                heaps = {}
        yield _table(heaps)

    return run


def _table(heaps: dict[int, list]) -> pa.RecordBatch:
    rows = [(q, -c, x) for q, heap in heaps.items() for x, c in heap]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", column: str = "embedding", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of ``vectors``."""
    bounded_batches(vectors.sparkSession)
    rows, asked = usable(vectors, vec_id, column), usable(queries, vec_id, column)
    codes, asked_codes = (stash(df.select("vec_id", "v", "dim", "pick").mapInArrow(_encode, _CODES)) for df in (rows, asked))
    tiles, blocks = max(1, -(-codes.count() // tile)), max(1, -(-asked_codes.count() // block))
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked_codes.select("*", one(blocks).alias("block"), every(tiles).alias("tile"))
    right = codes.select("*", one(tiles).alias("tile"), every(blocks).alias("block"))
    key = ["tile", "block"]
    found = stash(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), "query_id long, vec_id long, open boolean, low double, high double, tile int"))
    # the k-th best lower bound of a query over all tiles
    own = Window.partitionBy("query_id")
    placed = found.withColumn("n", F.row_number().over(own.orderBy(F.desc("low"), "vec_id"))).withColumn("least", F.max(F.when(F.col("n") == k, F.col("low"))).over(own))
    passed = stash(placed.where(F.col("high") >= F.coalesce("least", F.lit(-2.0))).select("query_id", "vec_id", "open", "tile"))
    left_over = passed.where("not open").select("query_id", "vec_id")
    pairs = left_over.join(_originals(rows, left_over.select("vec_id"), "vec_id"), "vec_id").join(_originals(asked, left_over.select(F.col("query_id").alias("vec_id")), "query_id"), "query_id")
    scored = pairs.select("query_id", "vec_id", cosine(F.col("query_id_v"), F.col("vec_id_v")).alias("score")).mapInArrow(_best(k), "query_id long, vec_id long, score double")
    wide = passed.where("open").select("query_id", "tile").distinct()
    if not wide.isEmpty():
        asked_wide = asked.join(wide.withColumnRenamed("query_id", "vec_id"), "vec_id").withColumn("block", one(blocks))
        meet = stash(asked_wide.select("tile", "block").distinct())
        there = rows.withColumn("tile", one(tiles)).join(meet, "tile")
        scored = scored.union(stash(asked_wide.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_whole_tile(k), "query_id long, vec_id long, score double")))
    order = own.orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
