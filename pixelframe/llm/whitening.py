"""Embedding whitening by Jacobi-Davidson: the leading eigenvectors of the covariance without forming it.

Vectors become integers (floor of STEP times each entry), so that counts and sums are exact. The covariance is only ever
applied: one Spark job multiplies a block of directions by the centred distinct vectors and back, each task adding up
its own rows, and Spark adds up the tasks' partial sums. The driver holds directions, never vectors: some MOST of them,
of one number for each dimension. A search space grows by approximate solutions of the projected correction equations, which MINRES solves for all pairs
sought in lockstep, so that each inner step is one job. Pairs are taken from the space by Rayleigh-Ritz, and locked
when their residual is down to rounding. A pair is locked only behind all larger ones, and random directions are
tried at the end: an eigenvector that the start has missed would show up there.

Defined results: rows whose vector is null or holds null or non-finite entries go; shorter vectors count as if zeros
followed; null and repeated ids are rows like others; equal vectors are fitted once; eigenvalues of equal size get any
orthonormal basis of their space; components of no variance (n = 1, or fewer independent dimensions than components)
cannot be whitened and are not returned; an empty table gives no rows; entries beyond 2**52 / STEP are an error, for products would not
be exact; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Steps of one unit; components; directions of the search space at most; MINRES steps of a correction.
STEP, COMPONENTS, MOST, INNER = 256, 4, 40, 8
#: Residual over the largest eigenvalue at which a pair is locked, and where a pair may stay if rounding allows no less.
EXACT, ROUNDING = 1e-14, 1e-12
SEED = 13


def quantised(vectors: DataFrame, vec_col: str = "embedding", step: int = STEP) -> DataFrame:
    """vectors with x array<long>, those of whole finite vectors only."""
    v = F.col(vec_col)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    limit = F.lit(float(1 << 52))

    def entry(c):
        y = F.floor(c.cast("double") * step)
        big = F.abs(c.cast("double") * step) >= limit
        return F.when(big, F.raise_error(F.lit("entry too large to be exact")).cast("long")).otherwise(y.cast("long"))

    return vectors.where(F.coalesce(good, F.lit(False))).withColumn("x", F.transform(v, entry))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of a matrix, zeros behind short ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def added_up(rows: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of what part makes of one: each task adds up its own, Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # size rows
        out[r["at"]] = r["v"]
    return out


class Centred:
    """The covariance (divisor n) of the distinct vectors of a table, as an operation on blocks of directions."""

    def __init__(self, fit: DataFrame):
        first = fit.agg(F.count("*"), F.max(F.size("x"))).first()
        self.fit, self.n, self.dims, self.products = fit, first[0], first[1] or 0, 0
        sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
        self.sums = [0] * self.dims
        for r in sums.collect():  # dims rows
            self.sums[r["at"]] = int(r["s"])
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)

    def __call__(self, block: np.ndarray) -> np.ndarray:
        dims, mean = self.dims, self.mean

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = rows_of(batch.column(0), dims) - mean
            return (x.T @ (x @ block)).ravel()

        self.products += 1
        return added_up(self.fit, block.size, part).reshape(block.shape) / self.n


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The directions of new that are in none of the bases, orthonormal; what is lost to rounding goes."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for _ in range(3):
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system for each column, in lockstep: a step is one call of apply."""
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v = rhs / np.where(live, beta, 1)
    before, b_old, eta = np.zeros_like(v), np.zeros_like(beta), beta.copy()
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    w, w_old, x = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    scale = None
    for _ in range(steps):
        y = apply(v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - b_old * before
        b_new = np.linalg.norm(y, axis=0)
        delta, rho2, rho3 = c * alpha - c_old * s * b_old, s * alpha + c_old * c * b_old, s_old * b_old
        rho1 = np.hypot(delta, b_new)
        scale = np.abs(alpha) + b_new if scale is None else scale
        live = live & (rho1 > 1e-14 * scale)
        safe = np.where(live, rho1, 1)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, b_new / safe, 0)
        w, w_old = np.where(live, (v - rho3 * w_old - rho2 * w) / safe, 0), w
        x = x + np.where(live, c * eta, 0) * w
        eta = -s * eta
        before, v, b_old = v, np.where(b_new > 0, y / np.where(b_new > 0, b_new, 1), 0), b_new
        live = live & (b_new > 1e-14 * scale)
        if not live.any():
            break
    return x


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], dims: int, want: int, seed: int = SEED, most: int = MOST, inner: int = INNER, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The want largest eigenvalues of a symmetric operation, falling, and their eigenvectors as columns."""
    want = min(want, dims)
    rng = np.random.default_rng(seed)
    if not want:
        return np.zeros(0), np.zeros((dims, 0))
    most = max(most, 3 * want)
    held, values = np.zeros((dims, 0)), np.zeros(0)
    space = orthonormal(rng.normal(size=(dims, min(dims, want + 2))))
    image, tried, best, still = apply(space), False, np.inf, 0
    for _ in range(rounds):
        e, s = np.linalg.eigh(space.T @ image)
        e, s = e[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        top = max([*values, *e, np.finfo(float).tiny])
        residual = image - space * e - held @ (held.T @ image)
        size = np.linalg.norm(residual, axis=0)
        sought = want - held.shape[1]
        # stuck at rounding: the largest residual sought has not fallen for three rounds
        now = size[:sought].max(initial=0)
        still, best = (0, now) if now < 0.5 * best else (still + 1, best)
        floor = ROUNDING if still >= 3 else EXACT
        ready = 0
        full = space.shape[1] + held.shape[1] == dims
        while ready < min(sought, space.shape[1]) and (size[ready] <= floor * top or full):
            ready += 1
        if ready:
            held, values = np.column_stack([held, space[:, :ready]]), np.concatenate([values, e[:ready]])
            space, image, residual, e, size = space[:, ready:], image[:, ready:], residual[:, ready:], e[ready:], size[ready:]
            best, still = np.inf, 0
        sought = want - held.shape[1]
        if not sought:
            if tried or not space.shape[1] or full:
                break
            # has the start missed an eigenvector? unlock if random directions, improved twice, find a larger value
            tried = True
            extra = orthonormal(rng.normal(size=(dims, 2)), held)
            for _ in range(2):
                extra = orthonormal(apply(extra), held)
            probe = orthonormal(extra, held, space)
            if probe.shape[1]:
                space, image = np.column_stack([space, probe]), np.column_stack([image, apply(probe)])
            found = np.linalg.eigvalsh(space.T @ image)[::-1]
            if not len(found) or found[0] <= values.min() * (1 + 1e-9):
                break
            back = values >= found[0]
            space, image = np.column_stack([held[:, ~back], space]), np.column_stack([held[:, ~back] * values[~back], image])
            held, values = held[:, back], values[back]
            continue
        if space.shape[1] + sought + 2 > most:  # start again from the best
            keep = max(2 * sought, most // 2)
            space, image = space[:, :keep], image[:, :keep]
        block = min(sought + 1, residual.shape[1])
        pairs, shift = space[:, :block], e[:block]

        def projected(t: np.ndarray) -> np.ndarray:
            """Off the locked vectors, and each column off its own pair."""
            t = t - held @ (held.T @ t)
            return t - pairs * (pairs * t).sum(axis=0)

        def corrected(t: np.ndarray) -> np.ndarray:
            t = projected(t)
            return projected(apply(t) - shift * t)

        step = minres(corrected, -projected(residual[:, :block]), inner)
        new = orthonormal(np.column_stack([projected(step), residual[:, :block]])[:, : 2 * block], held, space)[:, :block]
        if not new.shape[1]:
            new = orthonormal(rng.normal(size=(dims, block)), held, space)
        space, image = np.column_stack([space, new]), np.column_stack([image, apply(new)])
    else:
        raise RuntimeError("eigenpairs did not settle")
    order = np.argsort(-values, kind="stable")
    return values[order], held[:, order]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, step: int = STEP) -> DataFrame:
    """id, component, n, deviation (decimal, exact), whitened, explained, identity_error: one row for each row of vectors and
    component, numbered from 1 by falling eigenvalue."""
    rows = quantised(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v", step).select("id", "x")
    fit = cut(rows.select("x").distinct())
    v = Centred(fit)
    if not v.n:
        return rows.select("id", F.lit(0).alias("component")).where("false").selectExpr("id", "component", "0L n", "cast(0 as decimal(38,0)) deviation", "0d whitened", "0d explained", "0d identity_error").withColumnRenamed("id", id_col)
    values, basis = jacobi_davidson(v, v.dims, components)
    mean, n, dims, sums = v.mean, v.n, v.dims, np.array(v.sums, dtype=object)
    trace = float(added_up(fit, 1, lambda batch: np.array([((rows_of(batch.column(0), dims) - mean) ** 2).sum()]))[0]) / n
    real = values > 1e-12 * max(trace, np.finfo(float).tiny)
    values, basis = values[real], basis[:, real]
    k = len(values)
    onto = basis / np.sqrt(values)
    # covariance of what comes out, over the fit list, centred by its own mean
    means = added_up(fit, max(k, 1), lambda batch: np.append(((rows_of(batch.column(0), dims) - mean) @ onto).sum(axis=0), np.zeros(max(0, 1 - k)))) / n

    def outer(batch: pa.RecordBatch) -> np.ndarray:
        w = (rows_of(batch.column(0), dims) - mean) @ onto - means[:k]
        return np.append((w.T @ w).ravel(), np.zeros(max(0, 1 - k)))

    error = float(np.abs(added_up(fit, max(k * k, 1), outer)[: k * k].reshape(k, k) / n - np.eye(k)).max(initial=0.0))
    explained = values / trace if k else values
    # below this every product of n, x and their squares' sum fits 64 bits
    reach = (1 << 62) // max(dims, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), dims)
            w = (x - mean) @ onto
            top = int(np.abs(x).max(initial=0)) * n + int(max((abs(s) for s in sums), default=0))
            if top * top < reach:
                far = ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1)
                far = [int(f) for f in far]
            else:
                far = [sum((int(a) * n - s) ** 2 for a, s in zip(r, sums)) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(f) for f in far], pa.string()), pa.array(w.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "w"])

    found = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, deviation string, w array<double>")
    share = F.array(*[F.lit(float(e)) for e in explained]) if k else F.array().cast("array<double>")
    found = found.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("c", "whitened"))
    found = found.select("id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))
    return found.withColumnRenamed("id", id_col)
