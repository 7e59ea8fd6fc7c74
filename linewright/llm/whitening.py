"""Whitening by the exact characteristic polynomial of the integer scatter.

The distinct vectors of whole numbers are summed into an integer matrix,
C = n * sum(x x') - S S', which is n * n times their covariance. Its
characteristic polynomial is found modulo many primes, one Spark task for some
primes, by reduction to Hessenberg form, and put together by Chinese remainders.
The polynomial has real roots only, so the sign changes of its shifted
coefficients count the roots above any point exactly; that isolates the largest
ones to any precision. Each gives its component by inverse iteration in the
null space of C - root, in decimal arithmetic of as many digits as it takes.

What does not grow with the rows (a matrix as wide as the vectors, and one
polynomial) is put together on the driver; all passes over rows are Spark jobs.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.top_k import _kind, whole_numbers
from linewright.session import materialize

COMPONENTS = 4
#: Bits of a root that are settled; roots that agree in them count as one multiple root.
ROOT_BITS = 128
#: Rows that are multiplied at once.
ROWS = 4_096

#: Exact whole numbers of any size travel in limbs of so many bits.
LIMB = 40
SUMS = "i int, limb int, count long, sums array<long>"
RESULT = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- exact sums over rows ---


def _exact_products(rows: np.ndarray) -> list[list[int]]:
    """``rows' rows`` in whole numbers, by floating point where that is exact."""
    top = float(np.abs(rows.astype(np.float64)).max(initial=0))
    if top * top * len(rows) < 2**53:
        real = rows.astype(np.float64)
        return (real.T @ real).astype(np.int64).tolist()
    exact = rows.astype(object)
    return (exact.T @ exact).tolist()


def _limbs(values: list[int]) -> list[list[int]]:
    """The numbers in limbs, lowest first, each with its number's sign; at least one."""
    signs = [(v > 0) - (v < 0) for v in values]
    out = [[s * (abs(v) % (1 << LIMB)) for s, v in zip(signs, values)]]
    rest = [s * (abs(v) >> LIMB) for s, v in zip(signs, values)]
    return out + (_limbs(rest) if any(rest) else [])


def scatter(distinct: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """``(n, S, C)`` of the vectors in column ``vec``: their number, sums, and n * sum(x x') - S S'."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, n = [[0] * width for _ in range(width)], [0] * width, 0
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                rows = _stacked(batch["vec"].iloc[start : start + ROWS], width)
                part = _exact_products(rows)
                total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, part)]
                sums = [a + b for a, b in zip(sums, rows.astype(object).sum(axis=0).tolist())]
                n += len(rows)
        if n:
            # row i of the upper triangle, and the sums as row -1
            rows = [(i, limb, n, part) for i, row in enumerate([sums, *[row[i:] for i, row in enumerate(total)]], -1) for limb, part in enumerate(_limbs(row))]
            yield pd.DataFrame(rows, columns=["i", "limb", "count", "sums"])

    each = distinct.select("vec").mapInPandas(add, SUMS)
    each = each.select("i", "limb", "count", F.posexplode("sums").alias("j", "s"))
    sums = each.groupBy("i", "j", "limb").agg(F.sum("count").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    n, first, second = 0, [0] * width, [[0] * width for _ in range(width)]
    for i, j, limb, count, value in sums.collect():  # width * (width + 3) / 2 numbers
        if i < 0:
            n = max(n, count)  # limb zero has a row from every task
            first[j] += int(value) << LIMB * limb
        else:
            second[i][i + j] += int(value) << LIMB * limb
    for i in range(width):
        for j in range(i):
            second[i][j] = second[j][i]
    return n, first, [[n * second[i][j] - first[i] * first[j] for j in range(width)] for i in range(width)]


def _stacked(vectors, width: int) -> np.ndarray:
    vectors = list(vectors)
    return np.frombuffer(b"".join(vectors), f"<i{len(vectors[0]) // width}").reshape(-1, width).astype(np.int64)


# --- the characteristic polynomial ---


def _is_prime(n: int) -> bool:
    """For odd numbers of up to 64 bits, by strong probable primes to enough bases."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)  # fixed: enough for 64 bits
    if n in bases:
        return True
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in bases:
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than ``bits`` bits."""
    found, product, n = [], 1, 2**31 - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo ``p`` with zeros below the first subdiagonal."""
    h = matrix.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + below[0]
        h[[m, pivot]] = h[[pivot, m]]
        h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    return h


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """The characteristic polynomial's coefficients modulo ``p``, constant first."""
    h = hessenberg(matrix, p)
    minors = [np.array([1], np.int64)]  # of the leading blocks
    for k in range(len(h)):
        nxt = np.zeros(k + 2, np.int64)
        nxt[1:] = minors[k]
        nxt[:-1] = (nxt[:-1] - h[k, k] * minors[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            nxt[: i + 1] = (nxt[: i + 1] - chain * int(h[i, k]) % p * minors[i] % p) % p
        minors.append(nxt)
    return minors[-1].tolist()


def characteristic_polynomial(spark: SparkSession, c: list[list[int]]) -> list[int]:
    """The coefficients, constant first, of a positive semidefinite matrix of whole numbers."""
    width, trace = len(c), sum(c[i][i] for i in range(len(c)))
    # the k-th symmetric sum of roots is at most comb(d, k) * (trace / d)**k
    bits = max(math.comb(width, k).bit_length() + k * max(1, (trace // width + 1).bit_length()) for k in range(width + 1)) + 1
    primes = primes_for(bits + 31)  # one more than needed, which proves the sum

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place in batch["id"]:
                p = primes[place]
                matrix = np.array([[x % p for x in row] for row in c], np.int64)
                yield pd.DataFrame({"place": [place], "coefficients": [polynomial_modulo(matrix, p)]})

    tasks = min(len(primes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = spark.range(0, len(primes), 1, tasks).mapInPandas(reduce, "place long, coefficients array<long>").collect()
    residues = dict(map(tuple, parts))
    *used, check = range(len(primes))
    product = math.prod(primes[i] for i in used)
    weights = [(product // primes[i]) * pow(product // primes[i], -1, primes[i]) for i in used]
    out = []
    for k in range(width + 1):
        value = sum(w * residues[i][k] for w, i in zip(weights, used)) % product
        value -= product * (value > product // 2)
        if value % primes[check] != residues[check][k]:
            raise ArithmeticError("the remainders do not fit one polynomial")
        out.append(value)
    return out


# --- its largest roots ---


def _above(coefficients: list[int], point: int) -> int:
    """How many roots, each as often as it repeats, are above ``point``.

    Of a polynomial with real roots only, the sign changes in the coefficients
    are as many as positive roots; the shift moves ``point`` to zero.
    """
    shifted = list(coefficients)
    for i in range(len(shifted) - 1):
        for k in range(len(shifted) - 2, i - 1, -1):
            shifted[k] += point * shifted[k + 1]
    signs = [x > 0 for x in shifted if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(coefficients: list[int], point: int) -> int:
    out = 0
    for x in reversed(coefficients):
        out = out * point + x
    return out


def largest_roots(coefficients: list[int], count: int) -> list[tuple[Fraction, int]]:
    """``(root, multiplicity)`` of the largest positive roots, of at least ``count`` with repeats if there are so many.

    Each root is right to ``ROOT_BITS`` bits.
    """
    degree = len(coefficients) - 1
    most = -coefficients[degree - 1] + 1 if degree else 1  # no root is above the sum of all
    out: list[tuple[Fraction, int]] = []
    before = 0
    while before < count and _above(coefficients, 0) > before:
        # the largest root with `before` others above it: low < root <= high, times 2**scale
        scaled, scale, low, high = coefficients, 0, 0, most
        n_low, n_high = _above(scaled, low), 0
        while not low or (high - low) << ROOT_BITS > low:
            if high - low == 1:
                scale, low, high = scale + 32, low << 32, high << 32
                scaled = [x << 32 * (degree - k) for k, x in enumerate(scaled)]
            middle = (low + high) // 2
            at_middle = _value(scaled, middle)
            if n_low - n_high == 1 and at_middle:
                # one root in between: below the n-th root from above the sign is that of (-1)**n
                n = n_low if (at_middle < 0) == bool(n_low % 2) else n_high
            else:
                n = _above(scaled, middle)
            if n > before:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
        # the interval holds one root, or several that agree in ROOT_BITS bits
        many = n_low - before
        out.append((Fraction(low + high, 2 << scale), many))
        before += many
    return out


# --- their components ---


def null_space(c: list[list[int]], root: Fraction, many: int) -> list[list[Decimal]]:
    """``many`` orthogonal unit vectors that ``c`` only multiplies by ``root``."""
    width = len(c)
    # digits of the matrix, of the root, and as many again for the inverse
    digits = 40 + len(str(max(abs(x) for row in c for x in row))) + ROOT_BITS // 3
    with decimal.localcontext(decimal.Context(prec=digits)) as context:
        value = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(x) for x in row] for row in c], object)
        a[np.diag_indices(width)] -= value
        tiny = value.scaleb(-digits) if value else Decimal(1).scaleb(-digits)
        order = list(range(width))
        for k in range(width):
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, pivot]], order[k], order[pivot] = a[[pivot, k]], order[pivot], order[k]
            if not a[k, k]:
                a[k, k] = tiny
            if k + 1 < width:
                factors = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k] = factors
                a[k + 1 :, k + 1 :] -= factors[:, None] * a[k, k + 1 :]

        def solve(right: np.ndarray) -> np.ndarray:
            x = right[order].copy()
            for k in range(width):
                x[k + 1 :] -= a[k + 1 :, k] * x[k]
            for k in range(width - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1 :] * x[k + 1 :]).sum()) / a[k, k]
            return x

        found: list[np.ndarray] = []
        for turn in range(many):
            # different starts that no structure of the matrix is likely to be orthogonal to
            x = np.array([Decimal((i + 1) ** (turn + 1) * 7919 % 10007 + 1) for i in range(width)], object)
            for _ in range(4):
                x = solve(x)
                for _ in range(2):
                    for y in found:
                        x = x - (x * y).sum() * y
                x = x / context.sqrt((x * x).sum())
            x = x if max(x) >= -min(x) else -x
            found.append(x)
        return [list(x) for x in found]


def principal_components(c: list[list[int]], coefficients: list[int], count: int) -> list[tuple[Fraction, list[float]]]:
    """``(root, unit vector)`` for the ``count`` largest positive roots, repeated ones as often as they repeat."""
    out = []
    for root, many in largest_roots(coefficients, count):
        out += [(root, [float(x) for x in v]) for v in null_space(c, root, many)]
    return out[:count]


# --- the rows ---


def _packed(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    """The vectors as bytes, beside the keys."""
    fields = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["vec binary"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vec"] = [np.asarray(v).astype(kind).tobytes() for v in batch.pop("v")]
            yield batch[[*keys, "vec"]]

    return rows.select(*keys, "v").mapInPandas(pack, fields)


class _Fit:
    """What a row needs to be whitened."""

    def __init__(self, n: int, sums: list[int], parts: list[tuple[Fraction, list[float]]], trace: int):
        self.n, self.sums = n, sums
        self.rows = np.array([v for _, v in parts]).reshape(len(parts), len(sums))
        # roots are n * n times the variances
        self.scales = np.array([math.sqrt(float(root / n**2)) for root, _ in parts])
        self.explained = [float(root / trace) for root, _ in parts]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: as numbers of 64 bits where these hold the squares' sum too."""
        top = max(map(abs, self.sums)) + self.n * max(1, int(np.abs(rows).max(initial=0)))
        if top * top * rows.shape[1] < 2**63:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.rows.T / self.scales


def _identity_error(distinct: DataFrame, fit: _Fit, width: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    k = len(fit.rows)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = fit.whitened(fit.centred(_stacked(batch["vec"], width)))
                yield pd.DataFrame({f"w{i}": out[:, i] for i in range(k)})

    rows = distinct.select("vec").mapInPandas(project, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def _whitened(items: DataFrame, width: int, top: float, components: int) -> DataFrame | None:
    """The result for vectors of one width; none if they do not differ."""
    spark, key = items.sparkSession, items.schema["vec_id"].dataType.simpleString()
    distinct = materialize(_packed(items, _kind(top)).distinct(), "distinct-vectors")
    n, sums, c = scatter(distinct, width)
    trace = sum(c[i][i] for i in range(width))
    if not trace:
        return None
    fit = _Fit(n, sums, principal_components(c, characteristic_polynomial(spark, c), components), trace)
    error = _identity_error(distinct, fit, width)
    k = len(fit.rows)

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            centred = fit.centred(np.stack(batch["v"].to_list()).astype(np.int64))
            squares = [Decimal(int(x)) for x in (centred * centred).sum(axis=1)]
            squares = [x if len(str(x)) <= 38 else None for x in squares]
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].repeat(k),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)),
                    "n": n,
                    "deviation": [x for x in squares for _ in range(k)],
                    "whitened": fit.whitened(centred).ravel(),
                    "explained": np.tile(fit.explained, len(batch)),
                    "identity_error": error,
                }
            )

    return items.select("vec_id", "v").mapInPandas(whiten, RESULT.format(key))


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    Components are of the covariance of the distinct vectors of whole numbers
    floor(scale * x), from the largest variance down; the largest entry of each
    is positive. Those of no variance are left out, so vectors that do not
    differ give no rows. Equal variances take any orthogonal components of
    theirs. ``deviation`` is exact, null beyond 38 digits. Vectors that are
    null, empty, or hold a null or a number that is not finite are dropped;
    vectors of different widths are fitted apart. Repeated rows stay, ids may
    be null, other columns are not looked at, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), whole_numbers(F.col(embedding), scale).alias("v")).where("v IS NOT NULL")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.max(norm).alias("top")).orderBy("width").collect()
    parts = [_whitened(rows.where(F.size("v") == width), width, top, components) for width, top in widths]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], RESULT.format(rows.schema["vec_id"].dataType.simpleString()))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # beyond 63 bits there is no long to hold it
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
