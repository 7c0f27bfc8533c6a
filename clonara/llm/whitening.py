"""Whitening of embeddings by spectrum slicing.

Sums, covariance and the check of the result are folded inside tasks and added up by matrix row, so the driver holds
matrices of the vectors' width only. There, the signs in a symmetric LDLᵀ factorisation of the covariance less a shift
count the eigenvalues above the shift. Halving intervals by that count isolates each leading eigenvalue; Rayleigh
quotient iteration, which converges cubically, gives it and its vector; and counts on both sides of it certify its number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE = 64
#: Whole numbers beyond this are held to it, either sign.
LARGEST = 2**40
#: Eigenvalues closer than this share of themselves are one group with a common space of vectors.
TOGETHER = 1e-9
#: Components with less than this share of the largest eigenvalue have no whitened value.
NOTHING = 1e-12

_ROWS = 2048
_FITS = 2.0**62


# ---- symmetric matrices on the driver ------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above the shift, by the positive pivots of LDLᵀ with pivots of one and two rows."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        off = np.abs(a[k + 1:, k])
        r = k + 1 + int(np.argmax(off)) if len(off) else k
        most = off[r - k - 1] if len(off) else 0.0
        two = False
        if abs(a[k, k]) < alpha * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            widest = row.max()
            if abs(a[k, k]) * widest < alpha * most * most:
                if abs(a[r, r]) >= alpha * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            above += 1  # such a pivot has one eigenvalue of each sign
            left = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= left @ np.linalg.solve(a[k:k + 2, k:k + 2], left.T)
            k += 2
        else:
            pivot = a[k, k]
            above += bool(pivot > 0)
            if pivot != 0:
                left = a[k + 1:, k]
                a[k + 1:, k + 1:] -= np.outer(left / pivot, left)
            k += 1
    return above


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    for _ in range(60):
        try:
            out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        shift += least
        least *= 2
    raise ArithmeticError("no solution near the shift")


class Slicer:
    """Leading eigenpairs of a symmetric matrix; all counts are kept."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.norm = float(np.abs(matrix).sum(1).max()) if len(matrix) else 0.0
        self.least = 8 * np.finfo(float).eps * self.norm
        self.counts: dict[float, int] = {}
        self.draw = np.random.default_rng(11)

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """Ends of an interval that holds the eigenvalue of that number: alone, or with others too close to tell apart."""
        low, high = -2 * self.norm - 1, 2 * self.norm + 1
        for shift, n in self.counts.items():
            if n >= number:
                low = max(low, shift)
            else:
                high = min(high, shift)
        while not self._alone(low, high) and high - low > self._slack((high + low) / 2):
            middle = (low + high) / 2
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def _slack(self, value: float) -> float:
        return max(TOGETHER * abs(value), 2 * self.least)

    def _alone(self, low: float, high: float) -> bool:
        return low in self.counts and high in self.counts and self.counts[low] - self.counts[high] == 1

    def single(self, number: int, low: float, high: float) -> tuple[float, np.ndarray]:
        """The one eigenpair between the ends by Rayleigh quotient iteration; a start that leaves them is begun anew in half of them."""
        while True:
            value = (low + high) / 2
            vector = self.draw.standard_normal(len(self.matrix))
            for step in range(14):
                vector = _solved(self.matrix, value, vector, self.least)
                vector /= np.linalg.norm(vector)
                image = self.matrix @ vector
                quotient = float(vector @ image)
                if step and low < quotient < high and np.linalg.norm(image - quotient * vector) <= 4 * self.least:
                    return quotient, vector
                if step or low < quotient < high:
                    value = quotient
                if step > 1 and not low <= value <= high:
                    break
            if high - low <= self.least:
                return value, vector
            middle = (low + high) / 2
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle

    def together(self, low: float, high: float, many: int, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues and an orthonormal basis for a group of eigenvalues that are too close to tell apart."""
        basis = self.draw.standard_normal((len(self.matrix), many))
        known = np.array(found).T if found else np.zeros((len(self.matrix), 0))
        for _ in range(4):
            basis = _solved(self.matrix, high + (high - low), basis, self.least)  # beside the group, so that none of it prevails
            basis /= np.linalg.norm(basis, axis=0)
            for _ in range(2):
                basis -= known @ (known.T @ basis)
                basis, _ = np.linalg.qr(basis)
        values = np.einsum("ij,ij->j", basis, self.matrix @ basis)
        order = np.argsort(-values, kind="stable")
        return values[order], basis[:, order]

    def leading(self, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(eigenvalues, falling; vectors as columns) of the first ``many`` numbers."""
        if not self.norm:
            some = min(many, len(self.matrix))
            return np.zeros(some), np.eye(len(self.matrix))[:, :some]
        values: list[float] = []
        vectors: list[np.ndarray] = []
        while len(values) < min(many, len(self.matrix)):
            number = len(values) + 1
            low, high = self.interval(number)
            if self._alone(low, high):
                value, vector = self.single(number, low, high)
                low, high = value - self._slack(value), value + self._slack(value)
            group = self.above(low) - number + 1
            if group == 1 and self.above(high) == number - 1:
                values.append(value)
                vectors.append(vector)
            else:
                some, basis = self.together(low, high, group, vectors)
                values.extend(some.tolist())
                vectors.extend(basis.T)
        self.certify(values)
        return np.array(values[:many]), np.array(vectors[:many]).T.reshape(len(self.matrix), -1)

    def certify(self, values: list[float]) -> None:
        """Counts on both sides of every eigenvalue must agree with its number."""
        for number, value in enumerate(values, 1):
            slack = 2 * self._slack(value)
            if not self.above(value + slack) < number <= self.above(value - slack):
                raise ArithmeticError(f"eigenvalue {number} is out of order")


# ---- vectors in tasks ----------------------------------------------------------------


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their entries times the scale as whole numbers; short vectors extended with zeros)."""
    lengths = np.diff(column.offsets.to_numpy())
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    values = column.flatten()
    entries = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(entries)]] = False
    width = int(lengths[good].max(initial=0))
    out = np.zeros((len(column), width), np.int64)
    keep = good[owner]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(entries)) - first[owner]
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries[keep])
    out[owner[keep], place[keep]] = np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)
    return np.flatnonzero(good), out[good]


def _rows_of(batches, width: int | None = None):
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            at, x = _whole(part.column(part.num_columns - 1))
            if len(at):
                yield part, at, x if width is None or x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _folded(vectors: DataFrame, fold, kind: str) -> dict[int, np.ndarray]:
    """Row i of the sum over all tasks of what ``fold`` gives for a task: a mapping from i to an array."""
    own, arrow = (np.int64, pa.int64()) if kind == "long" else (np.float64, pa.float64())

    def out(rows: dict[int, np.ndarray]):
        items = sorted(rows.items())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], pa.int32()), pa.array([v.astype(own).tolist() for _, v in items], pa.list_(arrow))], names=["i", "v"])

    def task(batches):
        yield from out(fold(batches))

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                rows[i] = rows[i] + v if i in rows else v
        yield from out(rows)

    schema = f"i int, v array<{kind}>"
    parts = vectors.select("_v").mapInArrow(task, schema)
    return {r.i: np.array(r.v, own) for r in parts.repartition("i").mapInArrow(add, schema).collect()}


class Whitener(NamedTuple):
    """What a fit gives: rows, sums per dimension of the whole numbers, leading eigenvalues and vectors, total variance, check."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    def scaled(self) -> np.ndarray:
        """Matrix that takes a centred vector to its whitened components; not a number where there is no variance."""
        some = self.values > NOTHING * max(self.values.max(initial=0.0), 0.0)
        root = np.sqrt(np.where(some, self.values, 1.0))
        return np.where(some, self.vectors / root, np.nan)


def _named(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Means, leading components and the check of their whitening, over all vectors that take part; none if there are none.

    Four passes: sums, centred products, sums of whitened values, centred products of these.
    """
    rows = _named(vectors)

    def sums(batches):
        out = {-1: np.zeros(1, np.int64)}
        for _, at, x in _rows_of(batches):
            out[-1] += len(at)
            for i, s in enumerate(x.sum(0)):
                out[i] = out[i] + s if i in out else np.array([s])
        return out

    total = _folded(rows, sums, "long")
    n = int(total.pop(-1, np.zeros(1))[0])
    if n == 0:
        return None
    width = len(total)
    sums_ = np.array([total[i][0] for i in range(width)], np.int64)
    mean = sums_ / n

    def products(center, matrix=None):
        def fold(batches):
            out = np.zeros((len(center), len(center)))
            for _, _, x in _rows_of(batches, width):
                x = x - mean
                x = (x if matrix is None else x @ matrix) - (0 if matrix is None else center)
                out += x.T @ x
            return dict(enumerate(out))

        return fold

    def square(rows_: dict[int, np.ndarray], size: int) -> np.ndarray:
        a = np.array([rows_[i] for i in range(size)]).reshape(size, size) / n
        return (a + a.T) / 2

    covariance = square(_folded(rows, products(mean), "double"), width)
    values, basis = Slicer(covariance).leading(components)
    fitted = Whitener(n, sums_, values, basis, float(np.trace(covariance)), None)
    matrix = fitted.scaled()
    matrix = matrix[:, np.isfinite(matrix).all(0)]
    if not matrix.size:
        return fitted

    def whitened_sums(batches):
        out = np.zeros(matrix.shape[1])
        for _, _, x in _rows_of(batches, width):
            out += ((x - mean) @ matrix).sum(0)
        return {0: out}

    center = _folded(rows, whitened_sums, "double")[0] / n
    check = square(_folded(rows, products(center, matrix), "double"), matrix.shape[1])
    return fitted._replace(identity_error=float(np.abs(check - np.eye(len(check))).max()))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - sum)², exact; null where a long cannot hold it."""
    size = n * np.abs(x).max(initial=0) + np.abs(sums).max(initial=0)
    if float(size) ** 2 * max(x.shape[1], 1) < _FITS:
        d = n * x - sums
        return pa.array((d * d).sum(1), pa.int64())
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return pa.array([d if d < 2**63 else None for d in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors are read as whole numbers, 64 times an entry and rounded down; entries beyond 2^34 are held to it. A vector
    that is null or holds null or non-finite entries takes no part. Shorter vectors are extended with zeros to the
    longest. Components are as many as asked, at most the width. Repeated rows count each and give repeated results; a
    null vec_id stays null. Where a component has no variance its whitened value is null, and identity_error, the largest
    entry of the whitened covariance less the identity, is of the others (null without any); explained is null if no
    component has variance. deviation is null where a long cannot hold it. Other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(vectors, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, width, many, matrix = fitted.n, fitted.sums, len(fitted.sums), len(fitted.values), fitted.scaled()
    share = fitted.values / fitted.trace if fitted.trace > 0 else np.full(many, np.nan)

    def run(batches):
        names = pa.array(np.arange(1, many + 1, dtype=np.int32))
        for part, at, x in _rows_of(batches, width):
            owner = pa.array(np.repeat(at, many))
            every = pa.array(np.tile(np.arange(many), len(at)))
            if not many:
                continue
            deviation = _deviations(x, n, sums).take(pa.array(np.repeat(np.arange(len(at)), many)))
            values = ((x - sums / n) @ matrix).ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(owner), names.take(every), pa.repeat(pa.scalar(n, pa.int64()), len(owner)), deviation, pa.array(values, from_pandas=True),
                 pa.array(share, from_pandas=True).take(every), pa.repeat(pa.scalar(fitted.identity_error, pa.float64()), len(owner))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _named(vectors).mapInArrow(run, schema)
