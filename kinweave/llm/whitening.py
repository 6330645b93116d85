"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

X holds the fixed-point vectors less their mean, one row per vector; every pass centres its rows before it multiplies.  The
method builds orthonormal v_1, v_2 ... and u_1, u_2 ... with X v_j = beta_(j-1) u_(j-1) + alpha_j u_j and
X'u_j = alpha_j v_j + beta_j v_(j+1).  The singular values and right singular vectors of the small bidiagonal matrix of the
alphas and betas give the components (V times them) and, squared and divided by the number of rows, the variances.

A vector u is as long as the table.  It lies in the range of X, so it is kept as u = X y with a y as short as a row, and a
pass makes its entries anew.  One pass a step does both products: u = X y by rows, then X'u and the squared norm of u as
sums over rows.  Full reorthogonalisation on both sides happens on the driver, among at most as many short vectors as there
are dimensions: the products U'(X v) equal Z'v, where Z holds the X'u of the passes before.

With all steps (the default) the decomposition is complete and no component is an approximation; a smaller `steps` takes
fewer passes and gives the leading components as far as they have converged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinweave.llm.common import narrow, to_batch, type_of
from kinweave.session import cut

COMPONENTS = 8
#: Fixed point: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1_024, 100_000
#: Beyond this, doubles do not hold x exactly.
MOST = 1 << 50
#: Bytes of vectors that one task of a pass reads.
TASK_BYTES = 64 << 20
#: A new direction whose length is below this share of the largest so far is none.
SMALL = 1e-12
#: Rows that are multiplied at once.
AT_ONCE = 4_096
SEED = 42


@dataclass
class Whitening:
    """What is fitted: the number of rows, sums per dimension, components (columns), deviations, shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return mean_of(self.sums, self.n)


def mean_of(sums: list[int], n: int) -> np.ndarray:
    """Exact sums over n, each rounded once."""
    return np.array([s // n + (s % n) / n for s in sums])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vec) whose vector is not null or empty and holds neither null nor non-finite entries, as doubles."""
    doubles = vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return doubles.where((F.size("vec") > 0) & ~bad)


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The fixed-point vectors of a batch, a row each; integers, held as doubles."""
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat) + SHIFT
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"entries beyond {MOST // SCALE} are outside of what the fixed-point numbers hold exactly")
    return x.reshape(-1, dims)


def summed(rows: DataFrame, dims: int, work: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """Sums over all rows: work(x) gives a flat array for some rows x; equal places are added, in tasks and then in Spark.

    Only one number a place comes to the driver.
    """
    schema = f"place int, value {kind}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch, dims)
            for start in range(0, len(x), AT_ONCE):
                part = work(x[start : start + AT_ONCE])
                total = part if total is None else total + part
        if total is not None:
            yield to_batch([np.arange(len(total), dtype=np.int32), total.tolist()], arrow)

    found = rows.select("vec").mapInArrow(run, schema).groupBy("place").agg(F.sum("value").alias("value"))
    return [r["value"] for r in sorted(found.collect())]


def bidiagonal(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dims: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B: V with orthonormal columns, B upper bidiagonal.  product(y) gives (X'X y, squared norm of X y).

    Where a direction ends (alpha or beta is zero), the next v is any direction orthogonal to those before.
    """
    rnd = np.random.default_rng(SEED)
    v = np.zeros((dims, 0))
    y, z = np.zeros((dims, 0)), np.zeros((dims, 0))  # u = X y and X'u, by columns
    alphas, betas = [], []
    largest = 0.0

    def fresh() -> np.ndarray:
        return orthogonal(rnd.standard_normal(dims))

    def orthogonal(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - v @ (v.T @ w)
        return w

    start = fresh()
    while True:
        v = np.c_[v, start / np.linalg.norm(start)]
        # X v less its part along the u before; the second time removes what rounding left
        along = z.T @ v[:, -1]
        new = v[:, -1] - y @ along
        new = new - y @ (z.T @ new)
        back, square = product(new)
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha)
        if alpha <= SMALL * largest or not alpha:
            alpha, new, back = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            new, back = new / alpha, back / alpha
        alphas.append(alpha)
        y, z = np.c_[y, new], np.c_[z, back]
        if v.shape[1] == steps:
            break
        start = orthogonal(back)
        beta = float(np.linalg.norm(start))
        largest = max(largest, beta)
        if beta <= SMALL * largest or not beta:
            beta, start = 0.0, fresh()
        betas.append(beta)
    return v, np.diag(alphas) + np.diag(betas, 1)


def fit(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> tuple[Whitening | None, DataFrame]:
    """The whitening of usable rows (vec_id, vec), and these rows as written for the passes; no whitening without rows.

    All vectors must be of one length (ValueError).  Components of no variance are left out, so there may be fewer.
    """
    rows = usable(vectors)
    sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("dims")).first()
    n, dims = sizes["n"], sizes["dims"]
    if not n:
        return None, rows
    if sizes["least"] != dims:
        raise ValueError(f"vectors of {sizes['least']} and of {dims} entries cannot be whitened together")
    # small tables go to few tasks, as every step is a pass; large ones keep the partitions of their scan, unshuffled
    rows = cut(rows.coalesce(-(-n * dims * 8 // TASK_BYTES)))
    sums = [int(s) for s in summed(rows, dims, lambda x: x.astype(np.int64).sum(0).astype(object), "decimal(38,0)")]
    mean = mean_of(sums, n)

    def product(y: np.ndarray) -> tuple[np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ y
            return np.r_[centred.T @ u, u @ u]

        found = summed(rows, dims, work)
        return np.array(found[:-1]), found[-1]

    total = summed(rows, dims, lambda x: np.array([np.square(x - mean).sum()]))[0]
    v, b = bidiagonal(product, dims, min(steps or dims, dims))
    _, values, right = np.linalg.svd(b)
    kept = values[:components] > SMALL * max(values[0], 1.0)
    values = values[:components][kept]
    explained = np.square(values) / total if total else values
    return Whitening(n, sums, (v @ right.T)[:, :components][:, kept], values / np.sqrt(n), explained), rows


def identity_error(model: Whitening, rows: DataFrame) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity, measured over all rows."""
    scale, k = model.components / model.deviations, len(model.deviations)
    mean, dims, n = model.mean, len(model.sums), model.n
    middle = np.array(summed(rows, dims, lambda x: ((x - mean) @ scale).sum(0))) / n

    def work(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ scale - middle
        return (white.T @ white).ravel()

    covariance = np.array(summed(rows, dims, work)).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) squared, exactly."""
    whole = x.astype(np.int64)
    offset = np.array([s // n for s in sums], np.int64)
    left = np.array([s - n * (s // n) for s in sums], np.int64)
    near, most = whole - offset, int(np.abs(whole - offset).max(initial=0)) + 1
    if (n * most) ** 2 * max(len(sums), 1) < 1 << 63:
        return np.square(n * near - left).sum(1).tolist()
    return np.square(n * near.astype(object) - left.astype(object)).sum(1).tolist()


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """One row per usable vector: vec_id, n, deviation (exact), whitened and explained (arrays by component), identity_error.

    Rows whose vector is null or empty or holds null or non-finite entries are dropped; all others count for the fit, rows
    that repeat included.  Entries are taken as fixed-point numbers.  Vectors of different lengths and entries beyond 2^40
    raise ValueError.  Components of no variance are left out (a single vector has none, so its arrays are empty).  Null
    vec_ids stay null, other columns are not looked at, and an empty table gives an empty result.  The components' signs
    make their largest entry positive.
    """
    given = narrow(vectors, vec_id=vec_id, vec=vector)
    schema = f"vec_id {type_of(given, 'vec_id')}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    model, rows = fit(given, components, steps)
    if model is None:
        return given.sparkSession.createDataFrame([], schema)
    model.components *= np.where(np.abs(model.components).max(0, initial=0) == model.components.max(0, initial=0), 1, -1)
    error = identity_error(model, rows) if len(model.deviations) else 0.0
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n, sums, mean, k = model.n, model.sums, model.mean, len(model.deviations)
    scale, explained = model.components / model.deviations, model.explained.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                x = matrix(part, len(sums))
                white = ((x - mean) @ scale).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(white, pa.float64()))
                columns = [n] * len(x), deviations(x, n, sums), lists, [explained] * len(x), [error] * len(x)
                yield to_batch([part.column("vec_id"), *columns], arrow)

    return rows.mapInArrow(run, schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "e")
    return whitened.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"),
        F.col("e.explained").alias("explained"), "identity_error",
    )
