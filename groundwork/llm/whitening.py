"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

A is the fit list, each distinct vector of whole numbers once, with the mean taken off. A step takes
one pass over A: each task forms its part of u = Av (less the part along the left vectors so far) and
sums its part of A'u, so that products with A and with A' alternate in one read. The left vectors are
as long as the table, so they are never stored: u is A times a short vector that the driver keeps, and
a task forms again the parts it needs. Both sides are fully reorthogonalised, the left side by inner
products summed in the same pass, the right side on the driver. The small bidiagonal matrix then has
the singular values and, turned by its right vectors, the components.

A step that ends (a zero coefficient) goes on with a new direction across those so far, so that equal
eigenvalues are found as often as they occur. The steps end when the residuals of the wanted components
are at rounding level and no direction that is left holds as much as the last of them, at the latest
when all dimensions are used.

What the driver holds: a few vectors of one length for each step, and sums from at most ``tasks`` tasks.
What is kept on the cluster: the fit list in blocks, written to the shared folder, so that a lost
executor costs a reread.

Edge cases: vectors that are null or hold a null or non-finite entry leave; a vector shorter than the
longest counts as if zeros followed; repeated rows count once in the fit and are each returned; a
component without variance (one distinct vector, constant or dependent dimensions) is not returned, so
an empty table, empty vectors or a single distinct vector give no rows; a deviation beyond long is
null; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.lineage import cut
from groundwork.llm.vectors import LONG, largest, matrix, scaled


@dataclass(frozen=True)
class Whitening:
    """scale: of the whole numbers. components: most that are returned. block_rows: vectors in a block.
    task_values: entries that a task of a pass reads, about. tasks: most tasks of a pass."""

    scale: int = 256
    components: int = 4
    block_rows: int = 2048
    task_values: int = 1_000_000
    tasks: int = 4096
    seed: int = 7


@dataclass(frozen=True)
class Whitened:
    """vectors: a unit component in each row. values: their eigenvalues. sums, n: of the fit list."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    sums: list[int]
    n: int
    identity_error: float
    steps: int


def _blocks(dims: int, rows: int):
    """Vectors (x) packed as blocks: the number of rows and their entries, int64, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), dims)
            for at in range(0, len(x), rows):
                part = x[at : at + rows]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["rows", "block"])

    return run


def _each(b: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    for block in b.column("block"):
        yield np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dims)


def _totals(blocks: DataFrame, dims: int) -> tuple[list[int], int]:
    """Exact sums by dimension and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dims, 0
        for b in batches:
            for x in _each(b, dims):
                small = largest(x) * len(x) <= LONG
                part = x.sum(0) if small else x.astype(object).sum(0)
                sums, n = [a + int(c) for a, c in zip(sums, part, strict=True)], n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[str(s) for s in sums]]), pa.array([n])], names=["sums", "n"])

    sums, n = [0] * dims, 0
    for r in blocks.mapInArrow(run, "sums array<string>, n long").collect():
        sums, n = [a + int(c) for a, c in zip(sums, r["sums"], strict=True)], n + r["n"]
    return sums, n


def _summed(blocks: DataFrame, dims: int, of) -> np.ndarray:
    """The sum over all blocks of what ``of`` makes of a block, a flat array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            for x in _each(b, dims):
                total = total + of(x)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    return np.sum([r["v"] for r in blocks.mapInArrow(run, "v array<double>").collect()], axis=0)


def _across(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` less its parts along the orthonormal columns of ``basis``, taken off twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalised(blocks: DataFrame, mean: np.ndarray, n: int, wanted: int, seed: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(components, singular values, squared Frobenius norm, steps) of the centred rows; at most
    ``wanted`` components, those without variance left out."""
    d = len(mean)
    tiny, draw = float(np.finfo(float).eps), np.random.default_rng(seed)
    norm2 = float(_summed(blocks, d, lambda x: np.array([np.square(x - mean).sum()]))[0])
    if norm2 == 0:
        return np.zeros((0, d)), np.zeros(0), 0.0, 0
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, w with u = Aw, A'u
    alphas: list[float] = []
    betas: list[float] = []
    v = draw.standard_normal(d)
    v, beta = v / np.linalg.norm(v), 0.0
    while True:
        w = v - beta * short[:, -1] if alphas else v
        side = np.column_stack([w, short])

        def step(x: np.ndarray, side=side) -> np.ndarray:
            c = x - mean
            u = c @ side
            return np.concatenate([u[:, 0] @ u, c.T @ u[:, 0]])

        got = _summed(blocks, d, step)
        along, turned = got[1 : 1 + len(alphas)], got[1 + len(alphas) :]
        alpha = float(np.sqrt(max(0.0, got[0] - along @ along)))
        live = alpha > d * tiny * np.sqrt(norm2)
        w, g = ((w - short @ along) / alpha, (turned - back @ along) / alpha) if live else (np.zeros(d), np.zeros(d))
        right, short, back = np.column_stack([right, v]), np.column_stack([short, w]), np.column_stack([back, g])
        alphas.append(alpha if live else 0.0)
        rest = _across(g - alphas[-1] * v, right)
        beta = float(np.linalg.norm(rest))
        small = np.diag(alphas) + np.diag(betas, 1)
        left, s, turn = np.linalg.svd(small)
        k = len(alphas)
        top = s[: wanted + 1]
        if k == d:
            break
        if k > wanted:
            gap = np.minimum(-np.diff(top), np.r_[np.inf, -np.diff(top)[:-1]])
            settled = (beta * np.abs(left[-1, :wanted]) <= tiny * np.maximum(gap, tiny * s[0])).all()
            if settled and norm2 - float(np.square(s).sum()) < float(s[wanted - 1]) ** 2:
                break
        if beta > d * tiny * np.sqrt(norm2):
            v = rest / beta
        else:  # nothing leads on from here: a new direction, apart from all so far
            beta, v = 0.0, _across(draw.standard_normal(d), right)
            v = _across(v / np.linalg.norm(v), right)
            v /= np.linalg.norm(v)
        betas.append(beta)
    found = s[:wanted] > d * tiny * np.sqrt(norm2)
    made = (right @ turn.T).T[:wanted][found]
    made = made / np.linalg.norm(made, axis=1, keepdims=True)
    sign = np.sign(made[np.arange(len(made)), np.abs(made).argmax(1)]) if len(made) else np.ones(0)
    return made * sign[:, None], s[:wanted][found], norm2, k


def fit(vectors: DataFrame, dims: int, p: Whitening | None = None) -> Whitened:
    """The whitening of ``vectors`` (x array<long>, not null): of each distinct one once."""
    p = p or Whitening()
    made = cut(vectors.select("x").distinct().mapInArrow(_blocks(dims, p.block_rows), "rows int, block binary"))
    size = made.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] * dims
    blocks = made.coalesce(min(p.tasks, 1 + size // p.task_values)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums, n = _totals(blocks, dims)
        mean = np.array([_ratio(s, n) for s in sums])
        found, s, norm2, steps = bidiagonalised(blocks, mean, n, p.components, p.seed)
        values = np.square(s) / n
        if not len(values):
            return Whitened(found, values, norm2 / n, sums, n, 0.0, steps)
        turn = (found / np.sqrt(values)[:, None]).T
        middle = _summed(blocks, dims, lambda x: ((x - mean) @ turn).sum(0)) / n

        def products(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ turn - middle
            return (y.T @ y).reshape(-1)

        cov = _summed(blocks, dims, products).reshape(len(values), -1) / n
        return Whitened(found, values, norm2 / n, sums, n, float(np.abs(cov - np.eye(len(values))).max()), steps)
    finally:
        blocks.unpersist()


def _ratio(a: int, b: int) -> float:
    return a / b  # of whole numbers of any size, correctly rounded


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sums over dimensions of (n*x-S)^2, exact; None beyond long."""
    most = n * largest(x) + max(map(abs, sums))
    if most * most * len(sums) <= LONG:
        return np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
    out = np.square(x.astype(object) * n - np.array(sums, object)).sum(1)
    return [int(v) if v <= LONG else None for v in out]


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", p: Whitening | None = None) -> DataFrame:
    """A row for each row of ``df`` that remains and each component: key, component, n, deviation,
    whitened, explained, identity_error."""
    p = p or Whitening()
    rows = df.select(df[key].alias("vec_id"), scaled(df, vector, p.scale).alias("x")).filter("x IS NOT NULL")
    dims = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    made = fit(rows, dims, p) if dims else Whitened(np.zeros((0, 0)), np.zeros(0), 0.0, [], 0, 0.0, 0)
    mean = np.array([_ratio(s, made.n) for s in made.sums]) if made.n else np.zeros(dims)
    turn = (made.vectors / np.sqrt(made.values)[:, None]).T
    k, shares = len(made.values), made.values / made.trace if made.trace else made.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not (k and b.num_rows):
                continue
            x = matrix(b.column("x"), dims)
            at, m = np.repeat(np.arange(len(x)), k), len(x)
            deviation = pa.array(_deviations(x, made.sums, made.n), pa.int64()).take(pa.array(at))
            columns = [
                b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, made.n)), deviation,
                pa.array(((x - mean) @ turn).reshape(-1)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, made.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("vec_id", key)
