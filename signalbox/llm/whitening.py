"""Embedding whitening with an exact characteristic polynomial.

Vectors are scaled to integers, so the scatter of the distinct ones is an integer matrix that Spark sums exactly. Its
characteristic polynomial is found modulo many primes, each a Spark task that reduces the matrix to Hessenberg form,
and put together by Chinese remaindering; a bound on the coefficients says how many primes prove it. All its roots are
real, so the sign changes of a shifted polynomial count the roots above a place exactly (Descartes' rule); bisection
isolates and refines the largest ones to PRECISION bits. A component solves the scatter less its root, nearly singular,
by elimination in high precision, which blows up its null space; what remains is rounded to doubles once.

The driver holds numbers of the dimensions alone: the scatter, the polynomial and the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.llm.common import let_go
from signalbox.session import work_dir

#: A vector's entries are floor(SCALE * entry).
SCALE = 256
COMPONENTS = 4
#: Relative bits of an eigenvalue; roots that are nearer to each other count as one of that multiplicity.
PRECISION = 200
#: Decimal digits of the elimination, well over twice the eigenvalue's.
DIGITS = 150
#: Bits of the limbs in which sums of any size travel, and the largest integer that all doubles up to it hold exactly.
LIMB, EXACT = 48, 1 << 53


# ---- exact sums ------------------------------------------------------------------------------


def scaled(df: DataFrame, vector: str, *others: str) -> DataFrame:
    """``x``, the integer vectors of rows whose vector has only finite entries, and the ``others``."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    given = df.select(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(others)], v.alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < math.inf), F.lit(False)))
    return given.filter(finite).select(*[f"o{i}" for i in range(len(others))], F.transform("v", lambda c: F.floor(SCALE * c)).alias("x"))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value as (place, limb), all but the last from 0 up."""
    place = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield place, value & (1 << LIMB) - 1
        value >>= LIMB
        place += 1
    yield place, value


def _matrix(batch: pa.Array, dimensions: int) -> np.ndarray:
    lists = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def gram(x: np.ndarray) -> np.ndarray:
    """The exact sum of outer products: in doubles where every partial sum fits, else in integers of any size."""
    top = int(max(-int(x.min()), int(x.max()), 1)) if x.size else 1
    rows = EXACT // (top * top)
    if rows < 1:
        wide = x.astype(object)
        return wide.T @ wide
    out = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


class Scatter(NamedTuple):
    """n vectors, their sums, and n * (sum of outer products) - (outer product of the sums), all exact."""

    n: int
    sums: list[int]
    matrix: list[list[int]]


def scatter(fit: DataFrame, dimensions: int) -> Scatter:
    """Of integer vectors ``x`` of equal length. A task sends one matrix, whatever the number of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        n, sums, outer = 0, np.zeros(dimensions, object), np.zeros((dimensions, dimensions), object)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            n += len(x)
            top = int(np.abs(x).max(initial=0))  # of a saturated entry negative
            sums += x.sum(0).astype(object) if 0 <= top < 1 << 40 else x.astype(object).sum(0)
            outer += gram(x)
        if not n:
            return
        values = [(-1, -1, n), *((i, -1, int(v)) for i, v in enumerate(sums))]
        values += [(i, j, int(outer[i, j])) for i in range(dimensions) for j in range(i, dimensions)]
        rows = [(i, j, place, limb) for i, j, v in values for place, limb in _limbs(v) if limb]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "place", "limb"])

    sums = fit.select("x").mapInArrow(run, "i int, j int, place int, limb bigint").groupBy("i", "j", "place").agg(F.sum(F.col("limb").cast("decimal(28,0)")).alias("v"))
    total: dict[tuple[int, int], int] = {}
    for r in sums.collect():  # of the dimensions alone
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (int(r["v"]) << LIMB * r["place"])
    n = total.get((-1, -1), 0)
    s = [total.get((i, -1), 0) for i in range(dimensions)]
    at = lambda i, j: n * total.get((min(i, j), max(i, j)), 0) - s[i] * s[j]
    return Scatter(n, s, [[at(i, j) for j in range(dimensions)] for i in range(dimensions)])


# ---- characteristic polynomial ---------------------------------------------------------------


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo the prime ``p`` (below 2^31) with nothing below its first subdiagonal."""
    a = a % p
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        a[[k + 1, pivot]] = a[[pivot, k + 1]]
        a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        f = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - f[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * f % p).sum(1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - a) modulo p, the constant first."""
    h, d = hessenberg(a, p), len(a)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    chain = np.zeros(0, np.int64)  # products of subdiagonal entries from each row down to the current one
    for k in range(d):
        new = np.roll(minors[k], 1) - h[k, k] * minors[k] % p
        if k:
            chain = np.append(chain, 1) * h[k, k - 1] % p
            weights = h[:k, k] * chain % p
            new = new - (weights[:, None] * minors[:k] % p).sum(0)
        minors[k + 1] = new % p
    return minors[d]


def primes(product: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``product``."""
    out, p, reached = [], 1 << 31, 1
    while reached <= product:
        p -= 1
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        # Miller-Rabin with these bases is exact below 3,215,031,751.
        if p % 2 and all((x := pow(b, odd, p)) in (1, p - 1) or any(pow(x, 1 << i, p) == p - 1 for i in range(1, twos)) for b in (2, 3, 5, 7)):
            out.append(p)
            reached *= p
    return out


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(xI - matrix), the constant first, for a positive semidefinite integer matrix.

    Its coefficients are sums of products of its eigenvalues, whose mean is known, so none exceeds the binomial
    coefficient times a power of the mean (Maclaurin); primes are taken until they prove twice that.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    wanted = primes(2 * bound)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                p = wanted[i]
                out.append(polynomial_modulo(np.array([[v % p for v in row] for row in matrix], np.int64), p).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["i", "residues"])

    tasks = min(len(wanted), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(wanted), 1, tasks).mapInArrow(residues, "i bigint, residues array<bigint>").collect()
    out, product = [0] * (d + 1), 1
    for row in rows:
        p = wanted[row["i"]]
        inverse = pow(product, -1, p)
        out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, row["residues"])]
        product *= p
    return [c - product if 2 * c > product else c for c in out]


# ---- roots -----------------------------------------------------------------------------------


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """How many roots, with multiplicity, exceed at / 2^bits; exact where all roots are real."""
    d = len(coefficients) - 1
    c = [v << bits * (d - i) for i, v in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], at: int, bits: int) -> int:
    value, scale = 0, 1
    for c in reversed(coefficients):
        value = value * at + c * scale
        scale <<= bits
    return (value > 0) - (value < 0)


class Root(NamedTuple):
    value: Fraction
    multiplicity: int


def largest_roots(coefficients: list[int], wanted: int, precision: int = PRECISION) -> list[Root]:
    """The largest positive roots, falling, until their multiplicities reach ``wanted`` or none is left.

    All roots must be real and none negative. A root lies within value * 2^-precision.
    """
    out, found = [], 0
    positive = roots_above(coefficients, 0, 0)
    bits, high = 0, max(1, -coefficients[-2])  # no eigenvalue exceeds the trace
    while found < min(wanted, positive):
        # Above high / 2^bits lie the roots found; above low / 2^bits lie ``above``, more than those.
        low, above = 0, positive
        while (high - low) << precision > low:
            if high - low < 2:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            if above == found + 1:  # one root is left between them, and the sign tells on which side
                higher = _sign(coefficients, middle, bits) == (1 if above % 2 == 0 else -1)
            else:
                count = roots_above(coefficients, middle, bits)
                higher = count > found
                above = count if higher else above
            low, high = (middle, high) if higher else (low, middle)
        out.append(Root(Fraction(low + high, 2 << bits), above - found))
        found, high = above, low
    return out


# ---- components ------------------------------------------------------------------------------


def null_space(matrix: list[list[int]], root: Root) -> list[list[float]]:
    """Unit vectors, as many as the root's multiplicity, that the matrix only stretches by the root.

    Inverse iteration: the solution of (matrix - root) y = b lies in the null space but for a share of about
    2^-PRECISION. Further vectors are kept orthogonal to those found.
    """
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        value = Decimal(root.value.numerator) / Decimal(root.value.denominator)
        a = [[Decimal(matrix[i][j]) - (value if i == j else 0) for j in range(d)] for i in range(d)]
        tiny = max(value, Decimal(1)) * Decimal(10) ** -(DIGITS - 20)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[pivot] = a[pivot], a[k]
            order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            upper = a[k]
            for i in range(k + 1, d):
                row = a[i]
                f = row[k] / upper[k]
                row[k] = f  # the lower part keeps the steps
                if f:
                    for j in range(k + 1, d):
                        row[j] -= f * upper[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum(a[i][j] * y[j] for j in range(i))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum(a[i][j] * y[j] for j in range(i + 1, d))) / a[i][i]
            return y

        def unit(y: list[Decimal], against: list[list[Decimal]]) -> list[Decimal]:
            for _ in range(2):
                for other in against:
                    share = sum(p * q for p, q in zip(y, other))
                    y = [p - share * q for p, q in zip(y, other)]
                top = max(abs(v) for v in y)
                y = [v / top for v in y]
                size = sum(v * v for v in y).sqrt()
                y = [v / size for v in y]
            return y

        found: list[list[Decimal]] = []
        for m in range(root.multiplicity):
            y = unit([Decimal(1 + (i * 7919 + m * 104729) % 1009) for i in range(d)], found)
            for _ in range(3):
                y = unit(solved(y), found)
            found.append(y)
        out = []
        for y in found:
            lead = max(range(d), key=lambda i: (abs(y[i]), -i))
            out.append([float(v if y[lead] > 0 else -v) for v in y])
        return out


class Model:
    """A fitted whitening: ``n`` distinct vectors, their ``sums``, and components by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, eigenvalues: list[Fraction], trace: Fraction) -> None:
        self.n, self.sums, self.components, self.trace = n, sums, components, trace
        self.eigenvalues = eigenvalues
        self.explained = [float(e / trace) for e in eigenvalues]
        self.identity_error = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        top = max(-int(x.min()), int(x.max())) if x.size else 0
        if self.n * top + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component."""
        roots = np.array([math.sqrt(e) for e in self.eigenvalues])
        return (self.centred(x) / self.n).astype(np.float64) @ self.components.T / roots

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``centred``, exact; null above the largest long."""
        centred = self.centred(x)
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * self.dimensions < 1 << 63:
            return (centred * centred).sum(1).tolist()
        exact = (centred.astype(object) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Fits on every distinct integer vector once; None where there is no direction to whiten.

    Vectors that are null or hold null or non-finite entries don't count; entries beyond a long saturate. The
    dimensions are the most frequent length of the distinct vectors (the longer one in a tie); others don't count.
    There are fewer components where fewer eigenvalues are positive.
    """
    spark, folder = df.sparkSession, work_dir(df.sparkSession, "whitening")
    scaled(df, vector).distinct().write.parquet(folder)  # read three times below
    distinct = spark.read.parquet(folder)
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    d = lengths[0]["d"]
    distinct = distinct.filter(F.size("x") == d)
    n, sums, matrix = scatter(distinct, d)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return None
    vectors, values = [], []
    for root in largest_roots(characteristic(spark, matrix), components):
        root = root._replace(multiplicity=min(root.multiplicity, components - len(vectors)))
        vectors += null_space(matrix, root)
        values += [root.value / n**2] * root.multiplicity
    model = Model(n, sums, np.array(vectors), values, Fraction(trace, n**2))
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Model) -> float:
    """The largest entry of the covariance of the whitened vectors, as measured over them, less the identity."""
    k, d = len(model.eigenvalues), model.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total, outer = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), d))  # centred by the exact mean
            total += w.sum(0)
            outer += w.T @ w
        rows = [(i, -1, total[i]) for i in range(k)] + [(i, j, outer[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "v"])

    sums = distinct.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {(r["i"], r["j"]): r["v"] / model.n for r in sums}
    return max(abs(mean[i, j] - mean[i, -1] * mean[j, -1] - (i == j)) for i in range(k) for j in range(k))


def whiten(df: DataFrame, model: Model | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each vector and component: key, component (from 1), n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null, holds null or non-finite entries, or has another length than the model's are left out;
    null keys and repeated rows stay; other columns, whatever their names, play no part. Without a model, as for an
    empty table or a single distinct vector, there are no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *fields])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)
    k, d = len(model.eigenvalues), model.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            x = _matrix(batch.column(1), d)
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(rows)),
                pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(rows), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return scaled(df, vector, key).filter(F.size("x") == d).select("o0", "x").mapInArrow(run, schema)
