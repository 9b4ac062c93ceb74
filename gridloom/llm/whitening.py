"""Whitening of vectors on their leading principal components, found by LOBPCG.

The covariance matrix is never made. A pass over the rows multiplies it with a block of vectors:
every task centres its rows and adds up y (y'Q), and Spark sums what the tasks give. Each
iteration applies Rayleigh-Ritz to the span of the iterate, its residual and the previous
direction, until the residuals certify the eigenvectors. The driver holds a block of a few dozen
columns by the vectors' dimension, never a row.

Entries are whole numbers, floor(1024 c) + 100000, and so are their sums, so centring starts
from exact figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, written

SCALE, SHIFT = 1024, 100_000
#: Entries beyond it count as it, so that sums of batches stay exact.
LARGEST = 2.0**30
#: Columns of a block beside the wanted components: the further the spectrum falls behind the
#: block, the fewer iterations.
GUARD = 12
#: Residuals, by the largest eigenvalue, at which a component is certified; what a pass that no
#: longer improves must have reached; passes after which it fails.
TOLERANCE, ENOUGH, PASSES = 1e-13, 1e-11, 400
#: Components whose eigenvalue is not above this share of the largest one can't be whitened in
#: double precision.
NEGLIGIBLE = 1e-9

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _usable(embedding: str) -> F.Column:
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def scaled_rows(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``dim`` and ``x`` (packed 64-bit whole numbers) of every usable row, written once."""
    out = pa.schema([("dim", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.concat_arrays([batch.column("embedding")])
            ends = lists.offsets.to_numpy()
            c = np.clip(lists.values.to_numpy(zero_copy_only=False).astype(np.float64), -LARGEST, LARGEST)
            x = (np.floor(c * SCALE).astype(np.int64) + SHIFT).tobytes()
            packed = [x[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.diff(ends), pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", *out.names])

    rows = embeddings.where(_usable("embedding")).select("vec_id", "embedding")
    return written(rows.mapInArrow(frugal(run), f"vec_id {dict(rows.dtypes)['vec_id']}, dim int, x binary"), "whitening-rows")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


#: Rows that a task centres at a time.
_SLICE = 4096


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def column_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums of each position, by dimension. A row per position reaches the driver."""
    out = pa.schema([("dim", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in _slices(batches):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(batch.column("x").filter(pa.array(dims == dim)), dim)
                own = held.setdefault(dim, [0, np.zeros(dim, object)])
                own[0] += len(x)
                own[1] = own[1] + x.sum(axis=0)
        for dim, (n, s) in held.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "pos": i, "n": n, "s": int(v)} for i, v in enumerate(s)], schema=out)

    sums = rows.select("dim", "x").mapInArrow(frugal(run), "dim int, pos int, n long, s decimal(38,0)").groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "pos").collect():
        found.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return found


@dataclass(frozen=True)
class Centre:
    """The mean of the rows as whole and rest: S = n whole + rest, so x - S/n loses no digits."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None where it is no 64-bit number."""
        d, n = x - self.whole, self.n
        rest = self.rest
        if len(d) and max(int(np.abs(d).max()), 1) ** 2 * d.shape[1] >= 2**62 or max(int(np.abs(d).max(initial=0)), 1) * n * d.shape[1] >= 2**62:
            d, rest = d.astype(object), rest.astype(object)
        a, b, c = (d * d).sum(axis=1), (d * rest).sum(axis=1), sum(int(r) ** 2 for r in rest)
        each = [n * n * int(p) - 2 * n * int(q) + c for p, q in zip(a, b, strict=True)]
        return [v if v < 2**63 else None for v in each]


def _summed(rows: DataFrame, width: int, part) -> np.ndarray:
    """The sum over all tasks of the matrix that ``part`` makes of a slice of rows."""
    names = [f"p{i}" for i in range(width)]
    out = pa.schema([("pos", pa.int32()), *((c, pa.float64()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            one = part(batch)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *map(pa.array, total.T)], schema=out)

    made = rows.mapInArrow(frugal(run), "pos int, " + ", ".join(f"{c} double" for c in names))
    return np.array([r[1:] for r in made.groupBy("pos").agg(*[F.sum(c).alias(c) for c in names]).orderBy("pos").collect()], float).reshape(-1, width)


def covariance_times(rows: DataFrame, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance (divisor n) times a block, and its trace, by one pass over centred rows."""
    dim = len(block)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        y = centre.centred(_matrix(batch.column("x"), dim))
        return np.column_stack([y.T @ (y @ block), (y * y).sum(axis=0)])

    total = _summed(rows, block.shape[1] + 1, part) / centre.n
    return total[:, :-1], float(total[:, -1].sum())


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the span of ``against``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def leading_components(rows: DataFrame, centre: Centre, components: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors (columns) and the trace of the covariance."""
    dim = len(centre.whole)
    k = min(dim, components + GUARD)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, k)))[0]
    best, idle = np.inf, 0
    for _ in range(PASSES):
        product, trace = covariance_times(rows, centre, basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        x, ax = basis @ turn, product @ turn
        residual = ax - x * values
        wanted = values[: min(components, dim)]
        error = np.linalg.norm(residual[:, : len(wanted)], axis=0).max() / max(values[0], 1e-300)
        idle = 0 if error < best / 2 else idle + 1
        best = min(best, error)
        if values[0] <= 0 or error <= TOLERANCE or (idle >= 2 and error <= ENOUGH) or k == dim:
            return wanted, x[:, : len(wanted)], trace
        previous = basis[:, k:] @ turn[k:, :] if basis.shape[1] > k else np.zeros((dim, 0))
        x = np.linalg.qr(x)[0]
        basis = np.column_stack([x, _orthonormal(np.column_stack([residual, previous]), x)])
    raise RuntimeError(f"after {PASSES} passes the residual is {best:.2g} of the largest eigenvalue")


def _whitened(rows: DataFrame, dim: int, centre: Centre, components: int) -> DataFrame | None:
    """The result for the vectors of one dimension; nothing if they don't vary."""
    rows = rows.where(F.col("dim") == dim)
    values, vectors, trace = leading_components(rows, centre, components)
    keep = values > NEGLIGIBLE * max(values[0], 0)
    if not keep.any():
        return None
    vectors = vectors[:, keep] / np.sqrt(values[keep])
    explained, m, n = values[keep] / trace, int(keep.sum()), centre.n

    def second(batch: pa.RecordBatch) -> np.ndarray:
        z = centre.centred(_matrix(batch.column("x"), dim)) @ vectors
        return np.column_stack([z.T @ z, z.sum(axis=0)])

    moments = _summed(rows, m + 1, second) / n
    error = float(np.abs(moments[:, :m] - np.outer(moments[:, m], moments[:, m]) - np.eye(m)).max())
    kind = dict(rows.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch.column("x"), dim)
            z, count = centre.centred(x) @ vectors, len(x)
            every = np.repeat(np.arange(count), m)
            columns = [
                batch.column("vec_id").take(pa.array(every)),
                pa.array(np.tile(np.arange(1, m + 1), count), pa.int32()),
                pa.array(np.full(count * m, n), pa.int64()),
                pa.array(centre.deviations(x), pa.int64()).take(pa.array(every)),
                pa.array(z.ravel()),
                pa.array(np.tile(explained, count)),
                pa.array(np.full(count * m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *(c.split()[0] for c in RESULT.split(", "))])

    return rows.select("vec_id", "x").mapInArrow(frugal(run), f"vec_id {kind}, {RESULT}")


def whitened_components(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``: a row per usable row of ``embeddings`` (``vec_id``, ``embedding``) and
    component.

    Vectors that are null, empty or hold null or non-finite entries are left out. Repeated rows
    count and come back as often as they are there; a null ``vec_id`` stays null; other columns
    are ignored. There are at most as many components as dimensions, and those without variance
    (``NEGLIGIBLE``) are left out, so equal vectors and empty tables give no rows. Components
    with equal eigenvalues are any basis of their space. Vectors of different lengths are fitted
    apart, length by length. A deviation beyond 64 bits is null.
    """
    rows = scaled_rows(embeddings)
    parts = [_whitened(rows, dim, Centre.of(n, sums), components) for dim, (n, sums) in sorted(column_sums(rows).items())]
    found = [p for p in parts if p is not None]
    empty = rows.limit(0).select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in RESULT.split(", "))])
    return reduce(DataFrame.unionByName, found) if found else empty
