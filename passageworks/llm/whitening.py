"""Whitening by Chebyshev-filtered subspace iteration.

A component becomes the whole number ``x = floor(scale * c) + shift``. The *fit list* is every distinct
vector once: ``n`` of them with sums ``S`` per dimension, both exact. All covariances are over the fit
list with divisor ``n``, and every pass centres by the exact ``(n * x - S) / n`` before it multiplies.

The leading eigenvectors of the covariance ``V`` are found without forming ``V``. A *pass* reads the
fit list once; each task sends ``X'(X Q)`` of its rows, as many numbers as ``Q`` has, and these are added
up on the executors. With a basis ``Q`` of ``2 * components`` columns a round is

1. *filter*: a Chebyshev polynomial of ``V`` on ``Q``, one pass per degree. It is at most 1 on the
   interval of unwanted eigenvalues and grows fast above it. The upper end is the least
   Ritz value of the basis, the lower end comes from a Lanczos run that rides as one more column
   in the first round's passes (least Ritz value minus the length of the last residual);
2. *QR* and *Rayleigh-Ritz* on the driver, with one more pass (matrices of the width times
   the basis, whatever the number of rows).

A round also puts fresh random columns in place of the last ones, so that a direction
missed by the start is found. Rounds end when they are *certified*: the residuals
``|V q - e q|`` of the wanted components are within ``TOLERANCE`` of the largest eigenvalue, and the
Ritz values stayed as they were for a round; a run that does not get there fails. A basis as wide
as the vectors needs no filter.

Components whose eigenvalue is zero to rounding have no whitened value: it is null. Vectors that are
null or empty or hold null or non-finite components are left out; other columns are not read;
repeated rows are returned as often as they occur. Vectors of different widths are
an error. An empty table gives an empty result; a single distinct vector has no variance, so
all its whitened values are null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .vectors import integers, matrix, whole, width_of

#: Residuals of wanted components, against the largest eigenvalue.
TOLERANCE = 2e-14
#: Passes of a filter, rounds after which a fit fails, and columns renewed in a round.
DEGREE, ROUNDS, FRESH = 10, 40, 3
#: An eigenvalue below this share of the largest counts as zero.
ZERO = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``n``, exact sums, eigenvalues (falling) and unit eigenvectors (columns) of a fit list."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float
    passes: int


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n``, from whole numbers that are exact or, beyond a long, Python's."""
    return np.asarray(_deviations(x, n, sums) / n, np.float64)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` exactly: longs if all of it fits in their square root, else Python integers."""
    top = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums.tolist())) if x.size else 0
    if top < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _summed(rows: DataFrame, width: int, columns: int, partial) -> np.ndarray:
    """The sum over all rows of a ``(width, columns)`` matrix that ``partial(x)`` gives for each batch."""

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(matrix(batch.column("x"), width))
                total = part if total is None else total + part
        if total is not None:
            at = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    sent = rows.select("x").mapInArrow(work, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width * columns)
    out[sent.column("at").to_numpy()] = sent.column("value").to_numpy()
    return out.reshape(width, columns)


def _sums(rows: DataFrame, width: int) -> np.ndarray:
    """Exact sums per dimension, as Python integers."""
    each = rows.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    out = [0] * width
    for r in each.collect():
        out[r["at"]] = int(r["value"])
    return np.array(out, object)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and ``V`` times these."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(values)[::-1]
    return values[order], q @ turn[:, order], vq @ turn[:, order]


class _Lanczos:
    """A Lanczos run with full orthogonalisation, one step per pass of others."""

    def __init__(self, start: np.ndarray):
        self.basis = [start / np.linalg.norm(start)]
        self.main: list[float] = []
        self.beside: list[float] = []

    def step(self, v_last: np.ndarray) -> None:
        self.main.append(float(self.basis[-1] @ v_last))
        rest = v_last
        for _ in range(2):
            for b in self.basis:
                rest = rest - (b @ rest) * b
        self.beside.append(float(np.linalg.norm(rest)))
        if self.beside[-1] > 0:
            self.basis.append(rest / self.beside[-1])

    def lowest(self) -> float:
        """Below the least eigenvalue: the least Ritz value minus the length of the residual."""
        between = self.beside[: len(self.main) - 1]
        t = np.diag(self.main) + np.diag(between, 1) + np.diag(between, -1)
        return float(np.linalg.eigvalsh(t)[0]) - self.beside[-1]


def leading(apply, width: int, components: int, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and unit eigenvectors of the symmetric map ``apply(Q) = V Q``."""
    rng = np.random.default_rng(seed)
    size = min(width, 2 * components + FRESH)
    q = np.linalg.qr(rng.standard_normal((width, size)))[0]
    values, q, vq = _ritz(q, apply(q))
    if size == width:
        # the basis is the whole space; a second turn takes the rounding of the first one out
        values, q, vq = _ritz(*(lambda b: (b, apply(b)))(np.linalg.qr(q)[0]))
        return values[:components], q[:, :components]
    lanczos, low, last, reached = _Lanczos(rng.standard_normal(width)), 0.0, None, np.inf
    for _ in range(rounds):
        # renewed columns have small Ritz values; the filter's edge is the least of the others
        edge = values[size - FRESH - 1]
        if values[0] <= 0 or edge <= ZERO * values[0]:
            edge = ZERO * max(values[0], 1e-300)
        q[:, -FRESH:] = rng.standard_normal((width, FRESH))
        half, centre = (edge - low) / 2, (edge + low) / 2
        first = half / (values[0] - centre) if values[0] > centre else 1.0
        scale, before, now = first, q, None
        for step in range(degree):
            riding = len(lanczos.main) < degree and lanczos.basis
            block = q if now is None else now
            applied = apply(np.column_stack([block, lanczos.basis[-1]]) if riding else block)
            if riding:
                lanczos.step(applied[:, -1])
                applied = applied[:, :-1]
            if now is None:
                now = (applied - centre * block) * (first / half)
            else:
                scale_next = 1 / (2 / first - scale)
                before, now = now, (applied - centre * block) * (2 * scale_next / half) - before * (scale * scale_next)
                scale = scale_next
        low = max(0.0, lanczos.lowest())
        q = np.linalg.qr(now)[0]
        values, q, vq = _ritz(q, apply(q))
        residual = np.linalg.norm(vq[:, :components] - q[:, :components] * values[:components], axis=0).max()
        top = max(values[0], 1e-300)
        steady = last is not None and np.abs(values[:components] - last).max() <= 1e-13 * top
        # rounding of the passes may keep residuals a little above the tolerance: then they no longer fall
        if steady and (residual <= TOLERANCE * top or residual <= 100 * TOLERANCE * top and residual >= reached / 2):
            return values[:components], q[:, :components]
        last, reached = values[:components], min(reached, residual)
    raise RuntimeError(f"no certified eigenvectors after {rounds} rounds: residual {residual}")


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Fit on ``rows``, a stored table of distinct vectors ``x``; None if there are none."""
    n, width = width_of(rows)
    if not n:
        return None
    sums = _sums(rows, width)
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def partial(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _summed(rows, width, q.shape[1], partial) / n

    trace = float(_summed(rows, width, 1, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0)[:, None]).sum() / n)
    components = min(components, width)
    values, vectors = leading(apply, width, components) if trace > 0 else (np.zeros(components), np.eye(width)[:, :components])
    alive = values > ZERO * max(values[0], 0)
    error = 0.0
    if alive.any():
        turn = vectors[:, alive] / np.sqrt(values[alive])
        whitened = lambda x: _centred(x, n, sums) @ turn
        mean = _summed(rows, width, 1, lambda x: np.pad(whitened(x).sum(axis=0), (0, width - turn.shape[1]))[:, None])[: turn.shape[1], 0] / n

        def spread(x: np.ndarray) -> np.ndarray:
            w = whitened(x) - mean
            return np.pad(w.T @ w, ((0, width - turn.shape[1]), (0, 0)))

        cov = _summed(rows, width, turn.shape[1], spread)[: turn.shape[1]] / n
        error = float(np.abs(cov - np.eye(len(cov))).max())
    return Whitening(n, tuple(sums.tolist()), trace, values, vectors, error, passes)


def whiten(df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every row and component.

    ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2``, a ``decimal(38,0)``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(whole(F.col("v"))).select("vec_id", integers(F.col("v"), scale, shift).alias("x"))
    # read once per pass, so it is stored; copies of a vector combine before the shuffle
    model = fit(store(rows.select("x").distinct(), "whitening"), components)
    out = f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], out)
    width, count = model.vectors.shape
    n, sums, trace, error = model.n, np.array(model.sums, object), model.trace, model.identity_error
    alive = model.values > ZERO * max(model.values[0], 0)
    turn = model.vectors / np.sqrt(np.where(alive, model.values, 1))
    explained = model.values / trace if trace > 0 else np.full(count, np.nan)

    def project(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            if not len(x):
                continue
            away = _deviations(x, n, sums)
            if away.dtype != object and int(np.abs(away).max()) ** 2 * width >= 1 << 62:
                away = away.astype(object)
            deviation = pa.array([int(v) for v in (away * away).sum(axis=1)], pa.decimal128(38, 0))
            at = np.repeat(np.arange(len(x)), count)
            whitened = (_centred(x, n, sums) @ turn).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                    deviation.take(pa.array(at)), pa.array(whitened, mask=np.tile(~alive, len(x))),
                    pa.array(np.tile(explained, len(x)), mask=np.full(len(at), not trace > 0)), pa.array(np.full(len(at), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, out)
