"""Matrices from formulas: every row is an expression over its index, so a matrix is one narrow query without joins.

Grids are numbered along a space-filling (Morton) curve; states of a fixed particle number by their rank among the bit
patterns with that many bits, which the combinatorial number system gives in closed form.  Random diagonals are hashes
of the index and a seed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Context, MatSym, Matrix, SolverError

Entry = tuple[Column, Column, Column]  # whether it exists, column index, value


def from_entries(spark: SparkSession, n: int, entries: Callable[[Column], Sequence[Entry]], ncols: int | None = None, rows: DataFrame | None = None, **more) -> Matrix:
    """Matrix whose row i has the entries that the expressions give; `rows` may carry further columns beside i."""
    rows = spark.range(n).withColumnRenamed("id", "i") if rows is None else rows
    cells = [F.when(there, F.struct(j.cast("long").alias("j"), v.cast("double").alias("v"))) for there, j, v in entries(F.col("i"))]
    df = rows.select("i", F.explode(F.array_compact(F.array(*cells))).alias("e")).select("i", "e.j", "e.v")
    return Matrix(df, n, n if ncols is None else ncols, **more)


def from_row_function(spark: SparkSession, n: int, f: Callable, ncols: int | None = None, setup: Callable[[], object] | None = None, context: Context | None = None) -> Matrix:
    """f(row[, work]) -> (columns, values), run in batches; setup() makes the workspace of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = (setup(),) if setup else ()
        for b in batches:
            i, j, v = [], [], []
            for row in b.column(0).to_pylist():
                cols, vals = f(row, *work)
                i += [row] * len(cols)
                j += list(cols)
                v += list(vals)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64())], names=["i", "j", "v"])

    rows = spark.range(n) if context is None else spark.range(0, n, 1, context.row.blocks)
    return Matrix(rows.mapInArrow(run, "i long, j long, v double"), n, n if ncols is None else ncols, context=context)


def _always() -> Column:
    return F.lit(True)


# ---------------------------------------------------------------- bands


def tridiagonal(spark: SparkSession, n: int, diag: float = 2.0, sup: float = -1.0, sub: float | None = None) -> Matrix:
    sub = sup if sub is None else sub
    return from_entries(spark, n, lambda i: [(i > 0, i - 1, F.lit(float(sub))), (_always(), i, F.lit(float(diag))), (i < n - 1, i + 1, F.lit(float(sup)))], symmetry=MatSym.HERMITIAN if sub == sup else MatSym.GENERAL)


def tri_toeplitz(spark: SparkSession, level: int) -> Matrix:
    """2^level rows: 2 on the diagonal, -1 / (1 + 1e-8) beside it."""
    return tridiagonal(spark, 2**level, 2.0, -1 / (1 + 1e-8))


def complex_tridiagonal(spark: SparkSession, n: int, diag: complex, sup: complex, sub: complex) -> Matrix:
    re = tridiagonal(spark, n, diag.real, sup.real, sub.real).df
    im = tridiagonal(spark, n, diag.imag, sup.imag, sub.imag).df.withColumnRenamed("v", "v_im")
    return Matrix(re.join(im, ["i", "j"]), n, n)


def brussolator(spark: SparkSession, m: int) -> Matrix:
    """Brusselator wave model, 2 m rows.

    Fixed values: delta1 = 0.008, delta2 = delta1 / 2, alpha = 2, beta = 5.45, L = 0.51302.
    """
    alpha, beta, length = 2.0, 5.45, 0.51302
    h = 1 / (m + 1)
    t1, t2 = 0.008 / (h * length) ** 2, 0.004 / (h * length) ** 2
    upper = lambda i: i < m
    t = lambda i: F.when(upper(i), F.lit(t1)).otherwise(F.lit(t2))
    return from_entries(spark, 2 * m, lambda i: [
        (i > 0, i - 1, t(i)), (_always(), i, F.when(upper(i), F.lit(-2 * t1 + beta - 1)).otherwise(F.lit(-2 * t2 - alpha**2))),
        (i < 2 * m - 1, i + 1, t(i)), (_always(), F.when(upper(i), i + m).otherwise(i - m), F.when(upper(i), F.lit(alpha**2)).otherwise(F.lit(-beta))),
    ])


# ---------------------------------------------------------------- grids


def spread(x: Column, level: int, dims: int) -> Column:
    """The bits of x, dims apart."""
    out = F.lit(0).cast("long")
    for b in range(level):
        bit = F.shiftright(x.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
        out = out + F.shiftleft(bit, b * dims)
    return out


def gathered(i: Column, level: int, dims: int, which: int) -> Column:
    """Inverse of spread for one of the interleaved coordinates."""
    out = F.lit(0).cast("long")
    for b in range(level):
        out = out + F.shiftleft(F.shiftright(i, b * dims + which).bitwiseAND(F.lit(1).cast("long")), b)
    return out


def _grid(spark: SparkSession, side: int, dims: int) -> tuple[DataFrame, Callable[..., Column], int]:
    """Rows i with coordinates c0.. from 0, and the index of coordinates: Morton order for powers of two, else row by row."""
    n = side**dims
    level = side.bit_length() - 1
    rows = spark.range(n).withColumnRenamed("id", "i")
    if side == 1 << level:
        rows = rows.withColumns({f"c{k}": gathered(F.col("i"), level, dims, k) for k in range(dims)})
        return rows, lambda *c: sum((F.shiftleft(spread(x, level, dims), k) for k, x in enumerate(c)), F.lit(0).cast("long")), n
    rows = rows.withColumns({f"c{k}": F.floor(F.col("i") / side**k) % side for k in range(dims)})
    return rows, lambda *c: sum((x * side**k for k, x in enumerate(c)), F.lit(0).cast("long")), n


def matpde(spark: SparkSession, side: int) -> Matrix:
    """Five-point scheme on side x side points of -(p u_x)_x - (q u_y)_y + r u_x + (r u)_x + t u, zero at the boundary.

    Fixed values: p = exp(-xy), q = exp(xy), r = 20 (x + y), t = 1 / (1 + x + y).
    """
    rows, index, n = _grid(spark, side, 2)
    h = 1 / (side + 1)
    a, b = F.col("c0"), F.col("c1")
    rows = rows.withColumns({"x": (a + 1) * F.lit(h), "y": (b + 1) * F.lit(h)})
    x, y = F.col("x"), F.col("y")
    p, q, r = lambda x, y: F.exp(-x * y), lambda x, y: F.exp(x * y), lambda x, y: 20.0 * (x + y)
    east, west, north, south = p(x + h / 2, y), p(x - h / 2, y), q(x, y + h / 2), q(x, y - h / 2)
    drift = lambda x2: (r(x, y) + r(x2, y)) * F.lit(0.5 * h)
    return from_entries(spark, n, lambda i: [
        (_always(), i, east + west + north + south + F.lit(h * h) / (1 + x + y)),
        (b > 0, index(a, b - 1), -south), (a > 0, index(a - 1, b), -(west + drift(x - h))),
        (a < side - 1, index(a + 1, b), -east + drift(x + h)), (b < side - 1, index(a, b + 1), -north),
    ], rows=rows)


#: Convection (c_x, c_y, c_z) and reaction of the constant-diffusion problems, as functions of x, y, z.  A0 to A7 are all
#: the plain Laplacian: their scales of convection and reaction are zero.
_A = {
    **{f"A{k}": lambda x, y, z: (0, 0, 0, 0) for k in range(8)},
    "E1": lambda x, y, z: (200, 200, 200, -1000),
}
#: Conservative convection (f u)_x + (g u)_y: factor of exp(xy) and exp(-xy).
_A_FLUX = {"A8": 10.0, "A9": 1000.0}
#: Variable diffusion: scales of the x, y, z convection and of the reaction 1 / (1 + x + y + z).
_B = {"B0": (0, 0, 0, 0), "B1": (20, 0, 0, 0), "B2": (1000, 0, 0, 0), "B3": (20, 0, 0, 100), "B4": (1000, 1000, 0, 0), "B5": (20, 1, 0, 1)}


def bench3d(spark: SparkSession, side: int, problem: str, seed: int = 1) -> Matrix:
    """Seven-point schemes on side^3 points: A0-A9, B0-B5 and E1 with zero boundary, C0 and C1 periodic with a random diagonal."""
    rows, index, n = _grid(spark, side, 3)
    h = 1 / (side + 1)
    c = [F.col(f"c{k}") for k in range(3)]
    rows = rows.withColumns({name: (c[k] + 1) * F.lit(h) for k, name in enumerate("xyz")})
    at = [F.col(name) for name in "xyz"]
    move = lambda k, s: index(*[(x + s) % side if problem[0] == "C" and m == k else x + s if m == k else x for m, x in enumerate(c)])
    if problem[0] == "C":
        scale = {"C0": 16.5, "C1": 1.0}[problem]
        noise = F.xxhash64("i", F.lit(seed)) / F.lit(2.0**64) * scale
        wrapped = lambda k: index(*[F.pmod(x - 1, F.lit(side)) if m == k else x for m, x in enumerate(c)])
        return from_entries(spark, n, lambda i: [(_always(), i, noise), *[(F.lit(side > 1), move(k, 1), F.lit(-1.0)) for k in range(3)], *[(F.lit(side > 2), wrapped(k), F.lit(-1.0)) for k in range(3)]], rows=rows)
    shifted = lambda k, s: [x + F.lit(s * h) if m == k else x for m, x in enumerate(at)]
    one = F.lit(1.0)
    if problem in _A:
        diffusion = [lambda x, y, z: one] * 3
        *speed, react = _A[problem](*at)
        convection = lambda k, s: (F.lit(1.0) * speed[k]) * F.lit(s * h / 2)
    elif problem in _A_FLUX:
        f = _A_FLUX[problem]
        diffusion = [lambda x, y, z: one] * 3
        wave = [lambda x, y, z: -f * F.exp(x * y), lambda x, y, z: -f * F.exp(-x * y), lambda x, y, z: F.lit(0.0)]
        convection = lambda k, s: wave[k](*shifted(k, s)) * F.lit(s * h / 2)
        react = 0
    elif problem in _B:
        *scales, reaction = _B[problem]
        if problem == "B5":
            scales, reaction = [x * (side + 1) for x in scales], side + 1
        diffusion = [lambda x, y, z: F.exp(-x * y * z), lambda x, y, z: F.exp(x * y * z), lambda x, y, z: F.exp((1 - x) * (1 - y) * (1 - z))]
        wave = [lambda x, y, z: F.sin(F.lit(math.pi) * y), lambda x, y, z: F.sin(F.lit(math.pi) * z), lambda x, y, z: F.sin(F.lit(math.pi) * x)]
        # f u_x + (f u)_x, centred: half of f here and half of f at the neighbour, each counted for its own term
        convection = lambda k, s: (wave[k](*at) + wave[k](*shifted(k, s))) * F.lit(float(scales[k]) * s * h / 2)
        react = reaction / (1 + at[0] + at[1] + at[2])
    else:
        raise SolverError(f"no problem {problem!r}")
    face = lambda k, s: diffusion[k](*shifted(k, s / 2))
    diagonal = sum((face(k, s) for k in range(3) for s in (-1, 1)), F.lit(0.0)) + F.lit(h * h) * react
    return from_entries(spark, n, lambda i: [(_always(), i, diagonal), *[((c[k] > 0) if s < 0 else (c[k] < side - 1), move(k, s), -face(k, s) + convection(k, s)) for k in range(3) for s in (-1, 1)]], rows=rows)


def anderson(spark: SparkSession, lx: int, ly: int, lz: int, t: float = 1.0, ranpot: float = 0.0, periodic: bool = False, seed: int = 1) -> Matrix:
    """Hopping -t on a cuboid and a random potential in [-ranpot, ranpot]."""
    sides = (lx, ly, lz)
    step = (1, lx, lx * ly)
    n = lx * ly * lz

    def entries(i: Column) -> list[Entry]:
        out = [(_always(), i, F.xxhash64(i, F.lit(seed)) / F.lit(2.0**63) * float(ranpot))]
        for k, s in enumerate(sides):
            c = F.floor(i / step[k]) % s
            if s > 1:
                out += [(c < s - 1, i + step[k], F.lit(-t)), (c > 0, i - step[k], F.lit(-t))]
            if periodic and s > 2:
                out += [(c == s - 1, i - (s - 1) * step[k], F.lit(-t)), (c == 0, i + (s - 1) * step[k], F.lit(-t))]
        return out

    return from_entries(spark, n, entries, symmetry=MatSym.HERMITIAN)


def one_fermion(spark: SparkSession, n: int, t: float = 1.0, periodic: bool = False) -> Matrix:
    return anderson(spark, n, 1, 1, t, 0.0, periodic)


def graphene(spark: SparkSession, width: int, length: int | None = None, gamma: float = 0.2, seed: int = 1, periodic: bool = False) -> Matrix:
    """Tight-binding sheet as a brick wall: site w + width l is bound to w - 1, w + 1 and, by its parity, to one row above or below; open at its edges unless periodic.

    Fixed values: hoppings t1 = -1 (three neighbours), t2 = -0.1 / 2.78 (six), t3 = -0.095 / 2.78 (three); disorder +-gamma / 2.
    """
    length = width if length is None else length
    t1, t2, t3 = -1.0, -0.1 / 2.78, -0.095 / 2.78
    n = length * width

    def entries(i: Column) -> list[Entry]:
        w, row = i % width, F.floor(i / width)
        up = F.when((w + row) % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
        near = [(F.lit(d), F.lit(0), t1) for d in (-1, 1)] + [(F.lit(0), up, t1)]
        second = [(F.lit(d), F.lit(0), t2) for d in (-2, 2)] + [(F.lit(d), F.lit(e), t2) for d in (-1, 1) for e in (-1, 1)]
        third = [(F.lit(d), up, t3) for d in (-2, 2)] + [(F.lit(0), -up, t3)]
        out = [(_always(), i, F.xxhash64(i, F.lit(seed)) / F.lit(2.0**64) * gamma + 3 * t3)]
        for dw, dl, t in near + second + third:
            x, y = w + dw, row + dl
            inside = F.lit(True) if periodic else (x >= 0) & (x < width) & (y >= 0) & (y < length)
            out.append((inside, F.pmod(y, F.lit(length)) * width + F.pmod(x, F.lit(width)), F.lit(t)))
        return out

    m = from_entries(spark, n, entries)
    return Matrix.from_entries(m.df, n, n, symmetry=MatSym.HERMITIAN)  # on tiny periodic sheets neighbours coincide


# ---------------------------------------------------------------- many-particle states


def _bit(b: Column, k: int) -> Column:
    return F.shiftright(b, k).bitwiseAND(F.lit(1).cast("long"))


def rank(b: Column, sites: int) -> Column:
    """Place of a bit pattern among all with as many bits, in rising order."""
    out = F.lit(0).cast("long")
    for p in range(sites):
        row = F.array(*[F.lit(math.comb(p, j)).cast("long") for j in range(sites + 1)])
        below = F.bit_count(b.bitwiseAND(F.lit((1 << (p + 1)) - 1).cast("long")))
        out = out + F.when(_bit(b, p) == 1, F.get(row, below)).otherwise(F.lit(0).cast("long"))
    return out


def _patterns(spark: SparkSession, sites: int, ones: int) -> DataFrame:
    rows = spark.range(1 << sites).withColumnRenamed("id", "b").where(F.bit_count("b") == ones)
    return rows.select(rank(F.col("b"), sites).alias("i"), "b")


def _flip(b: Column, p: int, q: int) -> Column:
    return b.bitwiseXOR(F.lit((1 << p) | (1 << q)).cast("long"))


def _bonds(sites: int, periodic: bool) -> list[tuple[int, int]]:
    return [(p, p + 1) for p in range(sites - 1)] + ([(0, sites - 1)] if periodic and sites > 2 else [])


def spin_chain(spark: SparkSession, sites: int, up: int | None = None, jz: float = 1.0, jxy: float = 1.0, bz: float = 0.0, periodic: bool = True) -> Matrix:
    """Heisenberg chain: the sum over bonds of +-jz (equal or opposite spins) and 2 jxy for exchanging opposite ones.

    With `up` only the states of that many up spins, otherwise all 2^sites.
    """
    bonds = _bonds(sites, periodic)
    if up is None:
        n, rows = 1 << sites, spark.range(1 << sites).select(F.col("id").alias("i"), F.col("id").alias("b"))
        index = lambda b: b
    else:
        n, rows = math.comb(sites, up), _patterns(spark, sites, up)
        index = lambda b: rank(b, sites)
    b = F.col("b")
    same = sum((F.when(_bit(b, p) == _bit(b, q), F.lit(1.0)).otherwise(F.lit(-1.0)) for p, q in bonds), F.lit(0.0))
    diagonal = same * float(jz) + (2 * F.bit_count("b") - sites) * float(bz)
    m = from_entries(spark, n, lambda i: [(_always(), i, diagonal), *[(_bit(b, p) != _bit(b, q), index(_flip(b, p, q)), F.lit(2.0 * jxy)) for p, q in bonds]], rows=rows)
    return Matrix(m.df, n, n, MatSym.HERMITIAN)


def spin_sz(spark: SparkSession, sites: int) -> Matrix:
    return spin_chain(spark, sites, sites // 2)


def _hops(b: Column, sites: int, periodic: bool) -> list[tuple[Column, Column, Column]]:
    """Moves of one fermion along a bond: whether it can, the new pattern, and the sign of the particles it passes."""
    out = []
    for p, q in _bonds(sites, periodic):
        between = F.bit_count(b.bitwiseAND(F.lit(((1 << q) - 1) & ~((1 << (p + 1)) - 1)).cast("long")))
        out.append((_bit(b, p) != _bit(b, q), _flip(b, p, q), F.when(between % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))))
    return out


def free_fermions(spark: SparkSession, sites: int, fermions: int, t: float = 1.0, species: int = 1, periodic: bool = False) -> Matrix:
    """Hopping -t of fermions of several kinds that do not see each other; the first kind is the fastest index."""
    return hubbard(spark, sites, fermions, t, 0.0, species, periodic, 0.0)


def hubbard(spark: SparkSession, sites: int, fermions: int, t: float = 1.0, u: float = 0.0, species: int = 2, periodic: bool = False, ranpot: float = 0.0, seed: int = 1) -> Matrix:
    """Fermions of each kind hop by -t; two of different kinds on a site cost u; sites may have a random potential."""
    one = math.comb(sites, fermions)
    n = one**species
    rows = None
    for k in range(species):
        own = _patterns(spark, sites, fermions).select(F.col("i").alias(f"i{k}"), F.col("b").alias(f"b{k}"))
        rows = own if rows is None else rows.crossJoin(own)  # the product of the kinds' states is the basis itself
    total = sum((F.col(f"i{k}") * one**k for k in range(species)), F.lit(0).cast("long"))
    rows = rows.withColumn("i", total)
    bs = [F.col(f"b{k}") for k in range(species)]
    pot = [float((np.random.default_rng(seed).uniform(-ranpot, ranpot, sites))[s]) for s in range(sites)]
    diagonal = F.lit(0.0)
    for k in range(species):
        diagonal = diagonal + sum((_bit(bs[k], s) * pot[s] for s in range(sites)), F.lit(0.0)) if ranpot else diagonal
        for m in range(k):
            diagonal = diagonal + F.bit_count(bs[k].bitwiseAND(bs[m])) * float(u)
    entries = [(_always(), F.col("i"), diagonal)]
    for k in range(species):
        entries += [(can, F.col("i") + (rank(new, sites) - F.col(f"i{k}")) * one**k, sign * float(-t)) for can, new, sign in _hops(bs[k], sites, periodic)]
    m = from_entries(spark, n, lambda i: entries, rows=rows)
    return Matrix(m.df, n, n, MatSym.HERMITIAN)


def _moved(a: int, b: int) -> Column:
    """The numbers n of the sites after one particle went from a to b."""
    return F.transform("n", lambda x, k: x + F.when(k == b, 1).when(k == a, -1).otherwise(0))


def free_bosons(spark: SparkSession, sites: int, bosons: int, t: float = 1.0, periodic: bool = False) -> Matrix:
    """Bosons on a chain, as patterns of `bosons` ones among bosons + sites - 1 bits (zeros are walls between sites)."""
    bits = bosons + sites - 1
    n = math.comb(bits, bosons)
    rows = _patterns(spark, bits, bosons)
    # numbers of each site: lengths of the runs between the walls
    text = F.lpad(F.bin("b"), bits, "0")
    rows = rows.withColumn("n", F.transform(F.split(text, "0", sites), lambda r: F.length(r)))
    hops = []
    for p, q in _bonds(sites, periodic):
        for a, b in ((p, q), (q, p)):
            moved = _moved(a, b)
            pattern = F.conv(F.array_join(F.transform(moved, lambda x: F.repeat(F.lit("1"), x)), "0"), 2, 10).cast("long")
            hops.append((F.get("n", F.lit(a)) > 0, rank(pattern, bits), F.sqrt(F.get("n", F.lit(a)) * (F.get("n", F.lit(b)) + 1.0)) * float(-t)))
    m = from_entries(spark, n, lambda i: hops, rows=rows)
    return Matrix(m.df, n, n, MatSym.HERMITIAN)


def harmonic(spark: SparkSession, bosons: int, omega: float = 1.0, shift: float = 0.0) -> Matrix:
    """Oscillator omega (n + 1/2) with the linear term shift (b + b')."""
    n = bosons + 1
    return from_entries(spark, n, lambda i: [(_always(), i, (i + 0.5) * float(omega)), (i > 0, i - 1, F.sqrt(i.cast("double")) * float(shift)), (i < n - 1, i + 1, F.sqrt(i + 1.0) * float(shift))], symmetry=MatSym.HERMITIAN)


# ---------------------------------------------------------------- by name


def _named(text: str, spec: dict[str, Callable]) -> dict:
    out = {}
    for part in filter(None, text.split(",")):
        k, _, v = part.partition("=")
        if k not in spec:
            raise SolverError(f"unknown parameter {k!r}")
        out[k] = spec[k](v)
    return out


_YES = lambda v: v.lower() in ("true", "1", "periodic", "pbc")
_PHYSICS: dict[str, tuple[Callable, dict]] = {
    "Anderson": (lambda s, Lx=5, Ly=5, Lz=5, t=1.0, ranpot=0.0, boundary_conditions=False, seed=1: anderson(s, Lx, Ly, Lz, t, ranpot, boundary_conditions, seed), {"Lx": int, "Ly": int, "Lz": int, "t": float, "ranpot": float, "boundary_conditions": _YES, "seed": int}),
    "FreeBosonChain": (lambda s, t=1.0, n_sites=5, n_bosons=3, PBC=False: free_bosons(s, n_sites, n_bosons, t, PBC), {"t": float, "n_sites": int, "n_bosons": int, "PBC": _YES}),
    "FreeFermionChain": (lambda s, t=1.0, n_species=1, n_sites=10, n_fermions=5, PBC=False: free_fermions(s, n_sites, n_fermions, t, n_species, PBC), {"t": float, "n_species": int, "n_sites": int, "n_fermions": int, "PBC": _YES}),
    "Harmonic": (lambda s, **k: harmonic(s, k.get("n_bos", 100), k.get("omega", 1.0), k.get("lambda", 0.0)), {"omega": float, "lambda": float, "n_bos": int}),
    "Hubbard": (lambda s, t=1.0, U=0.0, n_sites=6, n_fermions=3, boundary_conditions=False, ranpot=0.0, seed=1: hubbard(s, n_sites, n_fermions, t, U, 2, boundary_conditions, ranpot, seed), {"t": float, "U": float, "n_sites": int, "n_fermions": int, "boundary_conditions": _YES, "ranpot": float, "seed": int}),
    "OneFermion": (lambda s, t=1.0, n_sites=10, PBC=False: one_fermion(s, n_sites, t, PBC), {"t": float, "n_sites": int, "PBC": _YES}),
    "SpinChainXXZ": (lambda s, Jxy=1.0, Jz=1.0, Bz=0.0, n_sites=10, n_up=5, boundary_conditions=False: spin_chain(s, n_sites, n_up, Jz / 4, Jxy / 4, Bz / 2, boundary_conditions), {"Jxy": float, "Jz": float, "Bz": float, "n_sites": int, "n_up": int, "boundary_conditions": _YES}),
    "Tridiagonal": (lambda s, n=100, diag=0.0, offdiag=1.0, phi=0.0: tridiagonal(s, n, diag, offdiag) if phi == 0 else complex_tridiagonal(s, n, complex(diag), offdiag * np.exp(1j * phi), offdiag * np.exp(-1j * phi)), {"n": int, "diag": float, "offdiag": float, "phi": float}),
    "TridiagonalComplex": (lambda s, n=100, diag_re=0.0, diag_im=0.0, supdiag=1.0, subdiag=1.0: complex_tridiagonal(s, n, complex(diag_re, diag_im), complex(supdiag), complex(subdiag)), {"n": int, "diag_re": float, "diag_im": float, "supdiag": float, "subdiag": float}),
    "TridiagonalReal": (lambda s, n=100, diag=0.0, supdiag=1.0, subdiag=1.0: tridiagonal(s, n, diag, supdiag, subdiag), {"n": int, "diag": float, "supdiag": float, "subdiag": float}),
}


def create_matrix(spark: SparkSession, problem: str) -> Matrix:
    """A matrix by file name (.mm .mtx .rua .cua .crs .bin .parquet) or by the name of a model problem."""
    from . import io

    low = problem.lower()
    if low.endswith((".mm", ".mtx")):
        return io.read_mm(spark, problem)
    if low.endswith((".rua", ".cua", ".rsa", ".hb")):
        return io.read_hb(spark, problem)
    if low.endswith((".crs", ".bin")):
        return io.read_bin(spark, problem)
    if low.endswith(".parquet"):
        return io.read_parquet(spark, problem)
    if m := re.fullmatch(r"graphene(\d+)(?:x(\d+))?", low):
        return graphene(spark, int(m[1]), int(m[2]) if m[2] else None)
    if m := re.fullmatch(r"bench3d-(\d+)-([a-e]\d)", low):
        return bench3d(spark, int(m[1]), m[2].upper())
    for name, f in (("matpde", matpde), ("tritoeplitz", tri_toeplitz), ("brussolator", brussolator), ("spinsz", spin_sz), ("spin", lambda s, n: spin_chain(s, n))):
        if m := re.fullmatch(rf"{name}(\d+)", low):
            return f(spark, int(m[1]))
    if m := re.fullmatch(r"(?:scamac-)?(\w+),?(.*)", problem, re.IGNORECASE):
        for name, (f, spec) in _PHYSICS.items():
            if name.lower() == m[1].lower():
                return f(spark, **_named(m[2], spec))
    raise SolverError(f"no matrix named {problem!r}")


def create_sol_and_rhs(a: Matrix, k: int, seed: int = 42):
    """A random solution and the right-hand side that belongs to it."""
    from ..operators import spmv, vec

    x = vec.random(a.spark, a.ncols, k, seed)
    return x, spmv.spmv(a, x)
