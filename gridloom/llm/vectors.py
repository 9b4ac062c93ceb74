"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by a random rotation and its signs are kept as a code, together with
the inner product f of the turned vector and its code. For another vector q, <q, code> / f is
an unbiased estimate of the cosine, and sqrt((1 - f^2) / f^2 / (d - 1)) bounds its error with a
known confidence. Pairs whose upper bound reaches the threshold are computed exactly.

Which pairs are looked at: vectors of one label meet in cells, the leading signs under further
rotations. The number of signs follows the size of the label and the number of rotations is
such that a pair at the threshold shares no cell with a probability of at most ``MISSED``.
Codes and factors go through the cells; vectors only follow for those that have a partner there
whom the bound on two codes can't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

#: Vectors that a cell should hold; most vectors on a side of a comparison block.
CELL, BLOCK = 512, 1024
#: Probability that a pair at the threshold never meets, and standard errors of the bound.
MISSED, ERRORS = 1e-6, 5.5
MOST_BITS = 24


@lru_cache(maxsize=128)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix that depends on its size and seed alone."""
    q, r = np.linalg.qr(np.random.default_rng(10_007 * seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cell_bits(n: int, dim: int, held: int = CELL) -> int:
    return max(0, min(MOST_BITS, dim, math.ceil(math.log2(max(n, 1) / held))))


def cell_tables(bits: int, threshold: float) -> int:
    """Rotations after which a pair at the threshold has shared a cell almost surely."""
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if agree >= 1 else math.ceil(math.log(MISSED) / math.log(1 - agree))


def binary_codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned vectors, and their correction factors."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimates(unit: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of each vector with each coded one, and a standard error per code."""
    dim = unit.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (unit @ rotation(dim, 0).T).astype(np.float32)
    error = np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / max(dim - 1, 1)) if dim > 1 else np.full(len(factors), np.inf)
    return turned @ signs.T / (math.sqrt(dim) * factors), error


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each such that no square under- or overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def open_members(signs: np.ndarray, factors: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have a partner, one of ``left`` and one of ``right``, whose code leaves the
    threshold open: the inner product of two codes misses the cosine by the errors of both."""
    dim = signs.shape[1]
    error = ERRORS * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / max(dim - 1, 1)) if dim > 1 else np.full(len(factors), np.inf)
    found = np.zeros(len(signs), bool)
    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        ratio = factors[right][None, :] / factors[some][:, None]
        about = signs[some] @ signs[right].T / dim * np.maximum(ratio, 1 / ratio)
        near = about + error[some][:, None] + error[right][None, :] >= threshold
        near &= some[:, None] != right[None, :]
        found[some[near.any(axis=1)]] = True
        found[right[near.any(axis=0)]] = True
    return found


def near_pairs(x: np.ndarray, y: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y with a cosine, in double precision, of at least ``threshold``."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    about, error = estimates(x / nx[:, None], codes, factors)
    i, j = np.nonzero(about + ERRORS * error >= threshold)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        keep[at : at + 50_000] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return i[keep], j[keep]


def _rows(column: pa.Array, dim: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


def _usable(embedding: str) -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    value = F.col(embedding)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(value, lambda x: x != 0)


def vector_classes(embeddings: DataFrame) -> DataFrame:
    """``cls``, ``label``, ``embedding``, ``copies``, ``vec_id``: equal vectors of a label are one class."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("embedding"))
    return rows.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id")).withColumn("cls", _cls())


def _cls() -> F.Column:
    return F.xxhash64(F.col("label").cast("string"), F.col("embedding"))


def _cells(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each vector under each of so many rotations."""
    dim = unit.shape[1]
    return np.stack([((unit @ rotation(dim, t + 1)[:bits].T >= 0) << np.arange(bits)).sum(axis=1) for t in range(tables)], axis=1).astype(np.int32)


def _in_cells(classes: DataFrame, threshold: float, held: int) -> DataFrame:
    """A row per class and rotation, with its cell, code and factor."""
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    sized = classes.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"]).select("cls", F.col("label").cast("string").alias("label"), "dim", "n", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ns = batch.column("dim").to_numpy(), batch.column("n").to_numpy()
            for dim, n in sorted(set(zip(dims.tolist(), ns.tolist(), strict=True))):
                for part in _slices(batch.filter(pa.array((dims == dim) & (ns == n))), 500):
                    x = scaled(part.column("embedding").flatten().to_numpy().reshape(-1, dim))
                    unit = x / np.linalg.norm(x, axis=1)[:, None]
                    codes, factors = binary_codes(unit)
                    bits = cell_bits(n, dim, held)
                    cells = _cells(unit, bits, cell_tables(bits, threshold))
                    known = [part.column("cls"), part.column("label"), part.column("dim"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(factors)]
                    for t in range(cells.shape[1]):
                        yield pa.RecordBatch.from_arrays([*known, pa.array(np.full(len(x), bits, np.int32)), pa.array(np.full(len(x), t, np.int32)), pa.array(cells[:, t])], names=["cls", "label", "dim", "code", "factor", "bits", "table", "cell"])

    return sized.mapInArrow(run, "cls long, label string, dim int, code binary, factor double, bits int, table int, cell int")


def _slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def _groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links i-j reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        after = least.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def linked_vectors(classes: DataFrame, threshold: float, held: int = CELL, side: int = BLOCK) -> DataFrame:
    """``cls``, ``links`` (vectors of other classes linked in a block) and ``root`` (a class that
    these links reach), over all blocks.

    Cells should hold ``held`` vectors. One of more than ``side`` is cut into parts and each two
    parts are a task's block. A pair counts in the first rotation that puts it into one cell.
    """
    rows = written(_in_cells(classes, threshold, held), "vector-cells")
    cell = ["label", "dim", "table", "cell"]
    large = rows.groupBy(*cell).agg(F.ceil(F.count("*") / side).cast("int").alias("parts")).where("parts > 1")
    blocks = (
        rows.join(large, cell, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
        .drop("parts", "other")
    )
    names = [*cell, "first", "second", "own", "bits", "cls"]

    def sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        own, first = block.column("own").to_numpy(), block.column("first")[0].as_py()
        same = first == block.column("second")[0].as_py()
        left = np.flatnonzero(own == first)
        return left, left if same else np.flatnonzero(own != first), same

    def ruled(block: pa.Table) -> pa.Table:
        dim = block.column("dim")[0].as_py()
        left, right, _ = sides(block)
        signs = np.unpackbits(_rows(block.column("code"), -(-dim // 8), np.uint8), axis=1, count=dim).astype(np.float32) * 2 - 1
        hit = open_members(signs, block.column("factor").to_numpy(), left, right, threshold)
        return block.select(names).filter(pa.array(hit))

    kinds = dict(blocks.dtypes)
    open_ = written(blocks.groupBy(*cell, "first", "second").applyInArrow(ruled, ", ".join(f"{c} {kinds[c]}" for c in names)), "vector-open")
    vectors = classes.select("cls", "copies", F.col("embedding").cast("array<double>").alias("vector"))

    def compare(block: pa.Table) -> pa.Table:
        t, dim, bits = (block.column(c)[0].as_py() for c in ("table", "dim", "bits"))
        left, right, same = sides(block)
        x = scaled(np.concatenate([c.flatten().to_numpy() for c in block.column("vector").chunks]).reshape(-1, dim))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        codes, factors = binary_codes(unit)
        copies, cls = (block.column(c).to_numpy() for c in ("copies", "cls"))
        cells = _cells(unit, bits, t) if t else np.zeros((len(x), 0), np.int32)
        found = []
        for at in range(0, len(left), 128):
            i, j = near_pairs(x[left[at : at + 128]], x[right], codes[right], factors[right], threshold)
            i, j = left[at + i], right[j]
            new = (i < j) if same else np.ones(len(i), bool)
            new &= ~(cells[i] == cells[j]).any(axis=1)
            found.append((i[new], j[new]))
        i, j = (np.concatenate(a) for a in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        links = np.zeros(len(x), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        hit = np.flatnonzero(links)
        return pa.table({"cls": cls[hit], "links": links[hit], "root": cls[_groups(len(x), i, j)[hit]]})

    blocks = open_.join(vectors, "cls")
    return written(blocks.groupBy(*cell, "first", "second").applyInArrow(compare, "cls long, links long, root long"), "vector-links")


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, held: int = CELL, side: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``embeddings`` (vec_id,
    embedding, label): vectors of one label link when their cosine is at least ``threshold``.

    Rows whose label or vec_id is null, and null, empty or zero vectors and those with null or
    non-finite components, link with nothing; vectors of different lengths don't link. Equal
    vectors of a label are one class, which is compared once and counts all its rows. A null
    vec_id has a null component and isn't kept. Rows that repeat a vec_id count each. Extra
    columns are ignored; an empty table gives an empty result. No pair below the threshold links;
    a pair at it is missed with a probability of about ``MISSED``.
    """
    classes = written(vector_classes(embeddings), "vector-classes")
    linked = linked_vectors(classes, threshold, held, side)
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    named = (
        classes.select("cls", "copies", "vec_id")
        .join(links, "cls", "left")
        .join(components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
        .withColumn("n", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    least = named.groupBy("component").agg(F.min("vec_id").alias("least"))
    found = named.join(least, "component").select("cls", "n", "least")
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("embedding")
    rows = embeddings.select("vec_id", F.when(able, _cls()).alias("cls"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return rows.join(found, "cls", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
