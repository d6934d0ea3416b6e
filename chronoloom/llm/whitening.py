"""Embedding whitening by QDWH spectral divide and conquer.

Entries become integers (256 steps to one), each distinct vector stands once in the fit
list, and its count and sums per dimension are exact. Tasks add up centred products of
their rows; what they give is summed by Spark, an entry of the covariance at a time, and
the covariance, of the size of a vector squared however many rows there are, is split on
the driver: the polar factor of the covariance less a shift, by QR- and Cholesky-based
dynamically weighted Halley steps, gives the projector on the eigenvectors beyond the
shift; an orthonormal basis of both sides makes two smaller blocks, of which only those
that hold the leading components are split again, down to single components. Components,
means and scales are broadcast and every row is projected where it lies.

Defined results: vectors that are null or hold null or non-finite entries are dropped;
empty vectors have no components and give no rows; vectors of different lengths are
different spaces, each with its own fit list; repeated rows repeat results, and rows with
a null id keep it; components of eigenvalue zero (beyond the rank of the fit list, as with
a single vector) have null as whitened value and take no part in identity_error; of equal
eigenvalues any orthonormal vectors count; entries beyond the range of a long count as its
ends; deviation is null where it would exceed a long; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stash

EPS = np.finfo(np.float64).eps
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley
    iteration: inverse-free steps from QR while the weights are large, then Cholesky."""
    n = len(a)
    size = np.abs(a).sum(axis=0).max()
    x, low, eye = a / size, EPS, np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4) if low < 1 else 0.0
        p = np.sqrt(1 + d)
        wa = p + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * p)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            now = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            r = np.linalg.cholesky(eye + wc * (x.T @ x))
            now = wb / wc * x + (wa - wb / wc) * np.linalg.solve(r.T, np.linalg.solve(r, x.T)).T
        now = (now + now.T) / 2
        step = np.linalg.norm(now - x)
        x, low = now, min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if step <= np.cbrt(EPS) and low >= 1 - 1e-12:
            break
    return x


def _halves(a: np.ndarray, size: float):
    """Orthonormal bases of the eigenvectors beyond and below a shift, or None where all
    eigenvalues are equal in double precision."""
    n = len(a)
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 4 * EPS * n * size:
        return None
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a, 2)
    best = None
    for shift in (float(np.median(diagonal)), float(np.trace(a) / n), float(diagonal[0] + diagonal[-1]) / 2, float(np.trace(a) / n) + 1e-3 * spread, float(np.trace(a) / n) - 1e-3 * spread):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        basis = np.random.default_rng(n).standard_normal((n, rank))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        q, _ = np.linalg.qr(basis, mode="complete")
        off = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
        if best is None or off < best[0]:
            best = (off, q[:, :rank], q[:, rank:])
        if off <= 16 * EPS * n * size:
            break
    # eigenvalues nearer to each other than double precision tells apart
    return None if best is None or best[0] > 1e-6 * size else best[1:]


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as
    columns, by spectral divide and conquer."""
    size = float(np.linalg.norm(v))
    values, vectors = [], []
    open_ = [(v, np.eye(len(v)))]  # blocks by falling eigenvalues, with their bases
    while open_ and len(values) < min(k, len(v)):
        a, basis = open_.pop()
        both = _halves(a, size) if len(a) > 1 and size > 0 else None
        if both is None:
            values += np.sort(np.diag(a))[::-1].tolist()
            vectors += list(basis[:, np.argsort(-np.diag(a), kind="stable")].T)
            continue
        for part in both[::-1]:
            block = part.T @ a @ part
            open_.append(((block + block.T) / 2, basis @ part))
    values, vectors = np.array(values[:k]), np.array(vectors[:k]).reshape(-1, len(v)).T
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _blocks(table: pa.RecordBatch | pa.Table, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vectors in a batch."""
    lists = table.column(column)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    at = np.r_[0, np.cumsum(size)]
    for d in np.unique(size[size > 0]):
        own = np.flatnonzero(size == d)
        yield int(d), own, flat[at[own][:, None] + np.arange(d)[None, :]]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task's rows, one row for each length and dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        for d, own, x in _blocks(batch):
            small = len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62
            sums = x.sum(axis=0).tolist() if small else [sum(map(int, c)) for c in x.T]
            n, so_far = held.get(d, (0, [0] * d))
            held[d] = (n + len(own), [a + b for a, b in zip(so_far, sums, strict=True)])
    rows = [(d, i, n, Decimal(s)) for d, (n, sums) in held.items() for i, s in enumerate(sums)]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)], strict=True)], names=["d", "i", "n", "s"])


def _products(models, projected: bool):
    """Sums of centred products over a task's rows; of projected rows where told so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _blocks(batch):
                model = models.value[d]
                y = x - model["mean"]
                if projected:
                    y = np.column_stack([np.ones(len(y)), y @ model["scaled"]])
                held[d] = held.get(d, 0.0) + y.T @ y
        parts = [(np.full(m.size, d), *(g.ravel() for g in np.indices(m.shape)), m.ravel()) for d, m in held.items()]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
        kinds = [np.int32, np.int32, np.int32, np.float64]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["d", "i", "j", "v"])

    return run


def _matrices(fit: DataFrame, models: dict, projected: bool) -> dict[int, np.ndarray]:
    shared = fit.sparkSession.sparkContext.broadcast(models)
    found = fit.mapInArrow(_products(shared, projected), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, own in found.groupby("d"):
        m = np.zeros((int(own["i"].max()) + 1,) * 2)
        m[own["i"], own["j"]] = own["v"]
        out[int(d)] = (m + m.T) / 2
    return out


def fit_whitening(fit: DataFrame, k: int) -> dict[int, dict]:
    """For each length of the distinct vectors ``x``: count, sums, mean, components,
    eigenvalues, explained shares and the error of the whitened covariance."""
    bounded_batches(fit.sparkSession)
    sums = fit.mapInArrow(_sums, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "i").collect()
    models: dict[int, dict] = {}
    for r in sums:
        models.setdefault(r["d"], {"n": r["n"], "sums": []})["sums"].append(int(r["s"]))
    for m in models.values():
        m["mean"] = np.array([float(Fraction(s, m["n"])) for s in m["sums"]])
    for d, v in _matrices(fit, models, False).items():
        m, v = models[d], v / models[d]["n"]
        e, vectors = leading_components(v, k)
        total = float(np.trace(v))
        real = e > d * EPS * total
        m |= {"e": e, "explained": e / total if total > 0 else np.zeros(len(e)), "real": real, "scaled": vectors[:, real] / np.sqrt(e[real]), "error": 0.0}
    if models:
        for d, w in _matrices(fit, models, True).items():
            m = models[d]
            w = w / m["n"]
            cov = w[1:, 1:] - np.outer(w[0, 1:], w[0, 1:])
            m["error"] = float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else 0.0
    return models


def _whitened(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in _blocks(batch):
                m = models.value[d]
                k, n = len(m["e"]), m["n"]
                top = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in m["sums"])
                if d * top * top < 1 << 63:
                    deviation = pa.array(((n * x - np.array(m["sums"], dtype=np.int64)) ** 2).sum(axis=1))
                else:
                    exact = [sum((n * v - s) ** 2 for v, s in zip(row, m["sums"], strict=True)) for row in x.tolist()]
                    deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                white = np.full((len(x), k), np.nan)
                white[:, m["real"]] = (x - m["mean"]) @ m["scaled"]
                row = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(own, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(row), n, dtype=np.int64)),
                        deviation.take(pa.array(row)),
                        pa.array(white.ravel(), mask=np.tile(~m["real"], len(x))),
                        pa.array(np.tile(m["explained"], len(x))),
                        pa.array(np.full(len(row), m["error"])),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, k: int = 4, steps: int = 256, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every
    usable row in the first k components of the fit list."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col(column)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    stepped = F.transform(v, lambda c: F.floor(c.cast("double") * steps))
    rows = vectors.where(v.isNotNull() & fine & (F.size(v) > 0)).select(F.col(vec_id).cast("long").alias("vec_id"), stepped.alias("x"))
    fit = stash(rows.select("x").distinct())
    models = fit_whitening(fit, k)
    return rows.mapInArrow(_whitened(spark.sparkContext.broadcast(models)), _OUT)
