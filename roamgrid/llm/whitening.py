"""Embedding whitening: principal components by Chebyshev-filtered subspace iteration.

Vectors are written once as whole numbers. One pass over them multiplies the covariance with a block of
directions Q: each task adds up Xc' (Xc Q) over its centred rows Xc, and Spark sums the tasks' small
matrices. A filter is a polynomial of the covariance, evaluated by the Chebyshev recurrence with one pass for each
degree: it is bounded on [0, b], where the unwanted spectrum lies, and grows fast beyond. QR and
Rayleigh-Ritz follow, until residuals certify the components. What a task sends, what the driver holds and what
is shipped with a pass are matrices of dimension x block, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Components wanted, further directions beside them, degree of a filter, and rounds of filters before giving up.
COMPONENTS, GUARD, DEGREE, ROUNDS = 32, 16, 8, 40
#: A component counts as found when |V u - e u| is at most TOLERANCE x the largest eigenvalue; those below FLAT x trace have no scale to divide by.
TOLERANCE, FLAT = 1e-13, 1e-12
#: Rows with a larger entry than this have no exact whole number; they raise an error.
LARGEST = 2.0**40
#: What a result must keep to.
WITHIN = 1e-4


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(64 c) + 1,000,000 of each entry c. Rows go whose vector is null or empty or holds null or
    non-finite entries, or has another length than most of these rows' vectors (of equally frequent
    lengths the largest counts): an entry that isn't there is null."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    d = rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(fine)
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    d = d.filter(F.size("v") == (lengths["n"] if lengths else 0))
    large = F.raise_error(F.lit(f"an entry of {vector_col} is beyond {LARGEST:g}"))
    whole = F.when(F.forall("v", lambda c: F.abs(c) <= LARGEST), F.transform("v", lambda c: F.floor(c * 64).cast("long") + 1_000_000)).otherwise(large.cast("array<bigint>"))
    return d.select("vec_id", whole.alias("x"))


def matrix(column) -> np.ndarray:
    """Rows x dimension of a column of arrays of equal length, without a copy."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def summed(rows: DataFrame, f, kind: str = "double") -> np.ndarray:
    """The sum over all tasks of f(batch), a flat array of one length, of bounded size: each task adds up its batches first."""
    to = np.int64 if kind == "long" else np.float64

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total.astype(to))], names=["i", "v"])

    found = rows.mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows, to)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


class Covariance:
    """The covariance of written rows(x), known by what it does to a block of directions."""

    def __init__(self, rows: DataFrame):
        self.rows, self.n = rows.select("x"), rows.count()
        self.sums = summed(self.rows, lambda b: matrix(b.column(0)).sum(0), "long") if self.n else np.zeros(0, np.int64)
        self.d = len(self.sums)
        self.passes = 0

    def centred(self):
        """f(batch column) to rows of x - S / n: the difference n x - S is exact before it is divided."""
        n, sums = self.n, self.sums
        return lambda column: exact_difference(matrix(column), n, sums).astype(np.float64) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, by one pass."""
        centred, n, shape = self.centred(), self.n, q.shape
        self.passes += 1

        def f(batch):
            x = centred(batch.column(0))
            return (x.T @ (x @ q)).ravel()

        return summed(self.rows, f).reshape(shape) / n

    def trace(self) -> float:
        centred = self.centred()
        return float(summed(self.rows, lambda b: np.array([np.square(centred(b.column(0))).sum()]))[0]) / self.n


def exact_difference(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S in whole numbers: of 64 bits where they suffice, else of any size."""
    if float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0)) < 2**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def filtered(v: Covariance, q: np.ndarray, vq: np.ndarray, bound: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V of the given degree times q, where vq = V q: at most 1 in size on [0, bound], scaled by its value at `top`."""
    half = bound / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        before, now = now, (v.times(now) - half * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def components(v: Covariance, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the k largest, certified by their residuals."""
    size = min(v.d, k + guard)
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((v.d, size)))
    worst = []
    for _ in range(rounds):
        vq = v.times(q)
        s = q.T @ vq
        e, w = np.linalg.eigh((s + s.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        q, vq = q @ w, vq @ w
        if e[0] <= 0:
            return np.zeros(0), q[:, :0]
        worst.append(float(np.linalg.norm(vq[:, :k] - q[:, :k] * e[:k], axis=0).max()))
        # Certified, or as good as rounding allows: far below the tolerance of the result, and no longer improving.
        still = len(worst) > 2 and worst[-1] <= 1e-10 * e[0] and worst[-1] >= 0.5 * worst[-2]
        if size == v.d or worst[-1] <= TOLERANCE * e[0] or still:
            return e[:k], q[:, :k]
        low = max(e[-1], 1e-14 * e[0])  # all unwanted eigenvalues lie in [0, low], about
        q, _ = np.linalg.qr(filtered(v, q, vq, low, e[0], degree) if low < e[0] else vq)
    raise RuntimeError(f"residual {worst[-1]:g} after {rounds} rounds; more are needed")


def whiten(rows: DataFrame, *, components_wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows that usable() leaves out don't occur. There are as many components as wanted, or as have an
    eigenvalue above FLAT x trace: none if all vectors are equal, so that the result is empty as for an
    empty table. Ids may be null or repeat: each row is whitened by itself. Other columns aren't used.
    An error is raised where the result isn't within its bounds.
    """
    spark = rows.sparkSession
    x = cut(usable(rows, id_col, vector_col))
    kind = dict(x.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = Covariance(x)
    trace = v.trace() if v.n else 0.0
    e, u = components(v, components_wanted) if trace else (np.zeros(0), None)
    k = int(np.count_nonzero(e > FLAT * trace))
    if not k:
        return spark.createDataFrame([], schema)
    e, to = e[:k], u[:, :k] / np.sqrt(e[:k])
    n, sums, centred = v.n, v.sums, v.centred()

    def moments(batch):
        w = centred(batch.column(0)) @ to
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    m = summed(x.select("x"), moments) / n
    identity_error = float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())
    if identity_error > WITHIN:
        raise RuntimeError(f"the whitened covariance is off by {identity_error:g}")
    explained = e / trace

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.repeat(np.arange(batch.num_rows), k)
            tile = lambda a: np.tile(a, batch.num_rows)
            exact = exact_difference(matrix(batch.column(1)), n, sums)
            if float(np.abs(exact).max()) ** 2 * exact.shape[1] >= 2.0**62:
                exact = exact.astype(object)
            deviation = np.square(exact).sum(1).astype(np.int64)  # beyond 64 bits this is an error
            w = centred(batch.column(1)) @ to
            cols = [pc.take(batch.column(0), pa.array(at)), tile(np.arange(1, k + 1, dtype=np.int32)), np.full(len(at), n), deviation[at], w.ravel(), tile(explained), np.full(len(at), identity_error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
