import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spandrel.operators import dense, eig, linop, orth, precond, rowproj, solve, spmv, vec
from spandrel.sources import gen, io, relational
from spandrel.streaming import loop
from spandrel.types import BlockVector, Context, EigSort, LinSolv, Map, MatSym, Matrix, SdMat, SolverError


def dense_of(m):
    out = np.zeros((m.nrows, m.ncols), complex if m.complex else float)
    for r in m.df.collect():
        out[r["i"], r["j"]] += r["v"] + (1j * r["v_im"] if m.complex else 0)
    return out


def sparse(spark, a):
    i, j = np.nonzero(a)
    rows = [(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)]
    return Matrix(spark.createDataFrame(rows, "i long, j long, v double"), *a.shape)


@pytest.fixture(scope="module")
def a(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 30)) * (rng.random((30, 30)) < 0.2)
    m[4] = 0
    m[:, 7] = 0
    return m


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(1)
    return rng.normal(size=(30, 3)), rng.normal(size=(30, 3))


# ---------------------------------------------------------------- products


def test_spmv_family(spark, a, xy):
    m, (x, y) = sparse(spark, a), xy
    vx, vy = vec.set_data(spark, x), vec.set_data(spark, y)
    assert np.allclose(vec.get_data(spmv.spmv(m, vx, 2.0, -1.0, vy, 0.5)), 2 * (a + 0.5 * np.eye(30)) @ x - y)
    assert np.allclose(vec.get_data(spmv.spmv_t(m, vx)), a.T @ x)
    assert np.allclose(vec.get_data(spmv.spmv(m, vx, shift=[1.0, 0.0, -2.0])), a @ x + x * [1, 0, -2])
    assert np.allclose(vec.get_data(spmv.spmv_pair(2.0, [1, 2, 3], m, [0, 1, -1], m.transposed(), vx, 1.0, vy)), 2 * (a @ x * [1, 2, 3] + a.T @ x * [0, 1, -1]) + y)
    f = spmv.spmv_mvtmv(1.0, m, vx)
    assert np.allclose(f.ww, (a @ x).T @ (a @ x)) and np.allclose(f.vw, x.T @ a @ x)
    f = spmv.spmv_mvdot(1.0, m, vx, 2.0, vy)
    w = a @ x + 2 * y
    assert np.allclose(f.ww, (w * w).sum(0)) and np.allclose(f.vw, (x * w).sum(0))


def test_beta_zero_overwrites_nan_and_alpha_zero_skips(spark, a, xy):
    m, vx = sparse(spark, a), vec.set_data(spark, xy[0])
    bad = vec.create(spark, 30, 3, float("nan"))
    assert np.allclose(vec.get_data(spmv.spmv(m, vx, 1.0, 0.0, bad)), a @ xy[0])
    assert np.allclose(vec.get_data(vec.axpby(2.0, vx, 0.0, bad)), 2 * xy[0])
    assert not vec.get_data(spmv.spmv(m, vx, 0.0)).any()


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_results_do_not_depend_on_partitions(spark, a, xy, parts):
    m = sparse(spark, a)
    m = Matrix(m.df.repartition(parts), 30, 30)
    v = vec.set_data(spark, xy[0])
    v = BlockVector(v.df.repartition(parts), 30, 3)
    assert np.allclose(vec.get_data(spmv.spmv(m, v)), a @ xy[0])
    assert np.allclose(vec.gram(v, v).a, xy[0].T @ xy[0])
    assert np.array_equal(vec.get_data(vec.random(spark, 40, 2)), vec.get_data(BlockVector(vec.random(spark, 40, 2).df.repartition(parts), 40, 2)))


def test_rectangular_duplicates_and_shapes(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (3, 0, 1.0)], "i long, j long, v double")
    m = Matrix.from_entries(df, 4, 2)
    x = vec.set_data(spark, np.array([[1.0], [10.0]]))
    assert vec.get_data(spmv.spmv(m, x)).ravel().tolist() == [50, 0, 0, 1]
    with pytest.raises(SolverError):
        spmv.spmv(m, vec.create(spark, 4, 1))
    assert m.global_nnz().first()[0] == 2


def test_complex_products(spark, a, xy):
    rng = np.random.default_rng(2)
    b = np.where(a != 0, rng.normal(size=a.shape), 0)
    rows = [(int(i), int(j), float(a[i, j]), float(b[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    m = Matrix(spark.createDataFrame(rows, "i long, j long, v double, v_im double"), 30, 30)
    x, y = xy
    z = vec.combine(vec.set_data(spark, x), vec.set_data(spark, y))
    for adjoint, full in ((False, a + 1j * b), (True, (a + 1j * b).conj().T)):
        re, im = vec.split(spmv.complex_spmv(m, z, 2 - 1j, adjoint))
        assert np.allclose(vec.get_data(re) + 1j * vec.get_data(im), (2 - 1j) * full @ (x + 1j * y))
    assert np.allclose(vec.complex_dot(z, z), ((x - 1j * y) * (x + 1j * y)).sum(0))


# ---------------------------------------------------------------- vectors


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-10, 10), st.floats(-10, 10))
def test_axpby_is_linear(spark, xy, p, q):
    x, y = (vec.set_data(spark, v) for v in xy)
    assert np.allclose(vec.get_data(vec.axpby(p, x, q, y)), p * xy[0] + q * xy[1])


def test_wide_blocks_and_small_matrices(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(50, 40)), rng.normal(size=(40, 10))
    v = vec.set_data(spark, x)
    assert np.allclose(vec.get_data(vec.times_sdmat(1.0, v, SdMat(c))), x @ c)
    assert np.allclose(vec.gram(v, v).a, x.T @ x)
    assert np.allclose(vec.get_data(vec.times_sdmat_inplace(v, SdMat(c))), np.concatenate([x @ c, x[:, 10:]], axis=1))
    g = vec.robust_gram(v, v)
    assert np.allclose(g.a, x.T @ x, atol=1e-13) and np.abs(g.lo).max() < 1e-12


def test_normalize_leaves_zero_columns(spark):
    v, n = vec.normalize(vec.set_data(spark, np.array([[3.0, 0.0], [4.0, 0.0]])))
    assert n.tolist() == [5, 0] and np.allclose(vec.get_data(v), [[0.6, 0], [0.8, 0]])


def test_maps(spark):
    m = Map(10, 3)
    assert [m.bounds(b) for b in range(3)] == [(0, 3), (4, 6), (7, 9)]
    got = spark.range(10).select(m.block_of(__import__("pyspark").sql.functions.col("id"))).collect()
    assert [r[0] for r in got] == [0] * 4 + [1] * 3 + [2] * 3
    assert Map(10, 3).compatible(Map(10, 3)) == 0 and Map(10, 3).compatible(Map(9, 3)) == -1 and Map(10, 3).compatible(Map(10, 2)) == 2
    within = spark.createDataFrame([(i, {0: 1, 1: 0}.get(i, i)) for i in range(10)], "i long, to long")
    assert Map(10, 3).compatible(Map(10, 3, within)) == 1


# ---------------------------------------------------------------- dense


def test_pivoted_cholesky_reveals_rank():
    rng = np.random.default_rng(4)
    b = rng.normal(size=(6, 4))
    m = b @ b.T
    r, perm, rank = dense.cholesky(SdMat(m), 1e-12)
    assert rank == 4 and np.allclose(r.a.T @ r.a, m[np.ix_(perm, perm)])
    full = m + np.eye(6)
    r, perm, rank = dense.cholesky(SdMat(full))
    x = dense.backward(r, perm, rank, dense.forward(r, perm, rank, SdMat(np.eye(6)))).a
    assert np.allclose(full @ x, np.eye(6))
    q, back, _, got = dense.qb(SdMat(m), 1e-12)
    assert got == 4 and np.allclose((q.a.T @ m @ q.a), np.diag([0, 0, 1, 1, 1, 1]), atol=1e-8)
    assert dense.pseudo_inverse(SdMat(m))[1] == 4


@pytest.mark.parametrize("which", [EigSort.LM, EigSort.SM, EigSort.LR, EigSort.SR])
def test_sorted_schur(which):
    a = np.random.default_rng(5).normal(size=(12, 12))
    t, q, ev = dense.sorted_schur(a, which)
    assert np.allclose(a @ q, q @ t) and np.allclose(q.conj().T @ q, np.eye(12)) and np.allclose(np.tril(t, -1), 0)
    key = dense.sort_key(ev, which)
    assert (np.diff(key) >= -1e-8).all()
    x = q @ dense.schur_eigenvectors(t)
    assert np.allclose(a @ x, x * np.diag(t))
    b = np.eye(12) * 2 + np.diag(np.ones(11), 1)
    s, u, v, w, _ = dense.generalized_schur(a, b, which)
    assert np.allclose(a @ v, w @ s) and np.allclose(b @ v, w @ u)


# ---------------------------------------------------------------- generators and files


def test_physics_matrices_are_symmetric(spark):
    for name in ("spinSZ6", "spin4", "SCAMAC-Hubbard,n_sites=4,n_fermions=2,U=2", "SCAMAC-FreeBosonChain,n_sites=3,n_bosons=3", "SCAMAC-FreeFermionChain,n_sites=5,n_fermions=2,PBC=true", "SCAMAC-Anderson,Lx=3,Ly=2,Lz=2,ranpot=1", "SCAMAC-Harmonic,n_bos=8,lambda=0.3", "graphene4x6", "SCAMAC-SpinChainXXZ,n_sites=6,n_up=2", "SCAMAC-OneFermion,n_sites=6,PBC=true"):
        d = dense_of(gen.create_matrix(spark, name))
        assert np.allclose(d, d.T), name
    free = np.linalg.eigvalsh(dense_of(gen.create_matrix(spark, "SCAMAC-FreeFermionChain,n_sites=5,n_fermions=2")))
    one = np.linalg.eigvalsh(dense_of(gen.create_matrix(spark, "SCAMAC-OneFermion,n_sites=5")))
    assert np.allclose(free, np.sort([one[p] + one[q] for p in range(5) for q in range(p)]))
    bosons = np.linalg.eigvalsh(dense_of(gen.create_matrix(spark, "SCAMAC-FreeBosonChain,n_sites=3,n_bosons=2")))
    one = np.linalg.eigvalsh(dense_of(gen.create_matrix(spark, "SCAMAC-OneFermion,n_sites=3")))
    assert np.allclose(bosons, np.sort([one[p] + one[q] for p in range(3) for q in range(p + 1)]))
    chain, sector = dense_of(gen.create_matrix(spark, "spin6")), dense_of(gen.create_matrix(spark, "spinSZ6"))
    states = [b for b in range(64) if bin(b).count("1") == 3]
    assert np.allclose(chain[np.ix_(states, states)], sector)


def test_grid_matrices(spark):
    d = dense_of(gen.create_matrix(spark, "BENCH3D-4-A0"))
    assert np.allclose(d, d.T) and np.isclose(np.linalg.eigvalsh(d)[0], 6 - 6 * np.cos(np.pi / 5))
    for p in ("A1", "A8", "B0", "B1", "B5", "C1", "E1"):
        assert gen.create_matrix(spark, f"BENCH3D-4-{p}").df.count() in (64 + 6 * 48, 64 * 7)
    assert gen.create_matrix(spark, "matpde8").df.count() == 5 * 64 - 4 * 8
    d = dense_of(gen.create_matrix(spark, "BENCH3D-3-B0"))
    assert np.allclose(d, d.T)
    with pytest.raises(SolverError):
        gen.create_matrix(spark, "nothing12")


def test_graphene_is_open_and_its_first_number_the_width(spark):
    d = dense_of(gen.create_matrix(spark, "graphene6x4"))
    assert d.shape == (24, 24) and np.allclose(d, d.T)
    assert d[0, 5] == 0 and d[0, 18] == 0  # no wrapping
    assert d[0, 1] == d[1, 7] == -1 and d[0, 6] != -1  # only odd sites are bound to the row above
    round_ = dense_of(gen.graphene(spark, 6, 4, gamma=0.0, periodic=True))
    assert round_[0, 5] == -1


def test_convection_of_the_grid_problems(spark):
    plain = dense_of(gen.create_matrix(spark, "BENCH3D-4-A0"))
    for k in range(1, 8):
        assert np.allclose(dense_of(gen.create_matrix(spark, f"BENCH3D-4-A{k}")), plain)
    b0, b4 = dense_of(gen.create_matrix(spark, "BENCH3D-4-B0")), dense_of(gen.create_matrix(spark, "BENCH3D-4-B4"))
    assert np.allclose(np.diag(b0), np.diag(b4)) and not np.allclose(b0, b4)


def test_options_that_are_not_built_are_refused():
    for text in ("lookAhead 3", "innerSolvMaxProjectionSpace 5", "innerSolvStopAfterFirstConverged 1", "preconOpts x", "symmetry odd"):
        with pytest.raises(NotImplementedError):
            eig.JadaOptions.parse(text).check()
    eig.JadaOptions.parse("symmetry HERMITIAN\nblockSize 2").check()


def test_row_functions(spark):
    m = gen.from_row_function(spark, 6, lambda i, w: ([i], [w["two"]]), setup=lambda: {"two": 2.0}, context=Context.of(6, 6, 3))
    assert np.allclose(dense_of(m), 2 * np.eye(6))


def test_matrix_market(spark, tmp_path):
    (tmp_path / "g.mm").write_text("%%MatrixMarket matrix coordinate real general\n% words\n\n  3   4  3\n1 1 1.5\n3 4 -2e0\n  2 2   0\n")
    m = io.read_mm(spark, str(tmp_path / "g.mm"))
    assert (m.nrows, m.ncols) == (3, 4) and m.df.count() == 3
    assert dense_of(m)[2, 3] == -2
    (tmp_path / "h.mm").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 1 0\n2 1 3 4\n")
    d = dense_of(io.read_mm(spark, str(tmp_path / "h.mm")))
    assert np.allclose(d, [[1, 3 - 4j], [3 + 4j, 0]])
    (tmp_path / "s.mm").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 1\n2 1\n")
    s = io.read_mm(spark, str(tmp_path / "s.mm"))
    assert np.allclose(dense_of(s), [[0, 1], [1, 0]]) and s.symmetry == MatSym.HERMITIAN
    io.write_mm(m, str(tmp_path / "out.mm"))
    assert np.allclose(dense_of(io.read_mm(spark, str(tmp_path / "out.mm"))), dense_of(m))
    with pytest.raises(SolverError):
        (tmp_path / "x.mm").write_text("hello\n")
        io.read_mm(spark, str(tmp_path / "x.mm"))


def test_harwell_boeing_and_binary(spark, tmp_path, a):
    text = ["title".ljust(72) + "key".ljust(8), "".join(f"{n:14d}" for n in (3, 1, 1, 1, 0)), "RUA".ljust(14) + "".join(f"{n:14d}" for n in (3, 3, 4, 0)), "(4I4)".ljust(16) + "(4I4)".ljust(16) + "(4E16.8)".ljust(20) + "".ljust(20), "   1   3   4   5", "   1   3   2   3", "".join(f"{v:16.8E}" for v in (1.0, 2.0, 3.0, -4.0))]
    (tmp_path / "m.rua").write_text("\n".join(text) + "\n")
    assert np.allclose(dense_of(gen.create_matrix(spark, str(tmp_path / "m.rua"))), [[1, 0, 0], [0, 3, 0], [2, 0, -4]])
    i, j = np.nonzero(a)
    (tmp_path / "m.crs").write_bytes(io.encode_bin(i, j, a[i, j], 30, 30))
    assert np.allclose(dense_of(gen.create_matrix(spark, str(tmp_path / "m.crs"))), a)
    (tmp_path / "c.crs").write_bytes(io.encode_bin(i, j, a[i, j] * 1j, 30, 30))
    assert np.allclose(dense_of(io.read_bin(spark, str(tmp_path / "c.crs"))), a * 1j)
    m = sparse(spark, a)
    io.write_parquet(m, str(tmp_path / "m.parquet"))
    assert np.allclose(dense_of(gen.create_matrix(spark, str(tmp_path / "m.parquet"))), a)
    io.write_vector(vec.create(spark, 5, 2, 1.0), str(tmp_path / "v"))
    assert vec.get_data(io.read_vector(spark, str(tmp_path / "v"), 5, 2)).sum() == 10
    with pytest.raises(SolverError):
        io.read_vector(spark, str(tmp_path / "v"), 6, 2)
    io.write_sdmat(SdMat(np.arange(6.0).reshape(2, 3)), spark, str(tmp_path / "s"))
    assert io.read_sdmat(spark, str(tmp_path / "s")).a.tolist() == [[0, 1, 2], [3, 4, 5]]


def test_tables_become_matrices(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "k string, n int")
    ids = {r["k"]: r["id"] for r in relational.dense_ids(df, "k").collect()}
    assert ids == {"a": 0, "b": 1}
    v = relational.vector_from_table(df, __import__("pyspark").sql.functions.col("n"), [__import__("pyspark").sql.functions.lit(1)], 6)
    assert vec.get_data(v).ravel().tolist() == [0, 1, 1, 1, 1, 0]


# ---------------------------------------------------------------- orthogonalisation


def test_orthogonalisation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(59, 5))
    for q, b in ((orth.svqb(vec.set_data(spark, x))[0], None), (orth.chol_qr(vec.set_data(spark, x))[0], None)):
        d = vec.get_data(q)
        assert np.allclose(d.T @ d, np.eye(5), atol=1e-10) and b is None
    q, r, rank = orth.qr(vec.set_data(spark, x))
    assert rank == 5 and np.allclose(vec.get_data(q) @ r.a, x)
    flat = np.concatenate([x[:, :3], x[:, :2] @ rng.normal(size=(2, 2))], axis=1)
    q, r, perm, rank = orth.chol_qr(vec.set_data(spark, flat), 1e-12)
    d = vec.get_data(q)
    assert rank == 3 and np.allclose(d.T @ d, np.eye(5), atol=1e-9) and np.allclose(d @ r.a, flat[:, perm], atol=1e-9)
    v = orth.orthog(None, vec.set_data(spark, x[:, :2]))[0]
    q, r1, r2, rank = orth.orthog(v, vec.set_data(spark, x[:, 2:]))
    both = np.concatenate([vec.get_data(v), vec.get_data(q)], axis=1)
    assert rank == 5 and np.allclose(both.T @ both, np.eye(5), atol=1e-10)
    assert np.allclose(vec.get_data(q) @ r1.a + vec.get_data(v) @ r2.a, x[:, 2:], atol=1e-10)
    inside = vec.times_sdmat(1.0, v, SdMat(np.array([[1.0, 2], [3, 4]])))
    q, r1, r2, rank = orth.orthog(v, inside, tol=1e-10)
    d = np.concatenate([vec.get_data(v), vec.get_data(q)], axis=1)
    assert rank == 2 and np.allclose(d.T @ d, np.eye(4), atol=1e-8)


# ---------------------------------------------------------------- solvers


@pytest.mark.parametrize("name", ["PCG", "MINRES", "GMRES", "BICGSTAB", "QMR", "IDRS"])
def test_solvers_reach_the_tolerance(spark, name):
    n = 40
    symmetric = name in ("PCG", "MINRES")
    a = gen.tridiagonal(spark, n, 3.0, -1.0, -1.0 if symmetric else -0.3).persisted()
    x = vec.random(spark, n, 2)
    b = spmv.spmv(a, x).persisted()
    r = solve.SOLVERS[name](linop.wrap_matrix(a), b, tol=1e-8, max_iter=150)
    assert r.converged
    err = vec.get_data(r.x) - vec.get_data(x)
    assert np.linalg.norm(err, axis=0).max() < 20 * 1e-8 * np.linalg.norm(vec.get_data(b))
    assert r.frame(spark).count() == len(np.atleast_1d(r.residuals))


def test_solver_edge_cases(spark):
    a = linop.wrap_matrix(gen.tridiagonal(spark, 12, 3.0, -1.0))
    zero = vec.create(spark, 12, 1)
    for name in ("PCG", "GMRES", "BICGSTAB"):
        r = solve.SOLVERS[name](a, zero, tol=1e-8)
        assert r.iterations == 0 and not vec.get_data(r.x).any()
    with pytest.raises(SolverError):
        solve.bicgstab(a, zero, precon=linop.identity(12))
    with pytest.raises(SolverError):
        solve.minres(a, zero, precon=linop.identity(12))
    two = vec.set_data(spark, np.stack([np.ones(12), np.zeros(12)], axis=1))
    assert solve.pcg(a, two, stop="any").iterations == 0
    state = solve.create_states(1, 3)[0]
    state.reset(vec.create(spark, 12, 1, 1.0), tol=1e-10)
    assert solve.iterate(a, [state], max_iter=2) == 3 and state.total == 2
    assert solve.update_solution(state).k == 1


def test_preconditioners(spark):
    a = gen.tridiagonal(spark, 20, 4.0, -1.0)
    d = dense_of(a)
    x = np.random.default_rng(7).normal(size=(20, 2))
    v = vec.set_data(spark, x)
    assert np.allclose(vec.get_data(precond.create(a, "jacobi").apply(v)), x / 4)
    blocks = np.kron(np.eye(4), np.ones((5, 5))) * d
    assert np.allclose(vec.get_data(precond.create(a, "block_jacobi", "size=5").apply(v)), np.linalg.solve(blocks, x))
    p = precond.create(a, "jacobi")
    p.update(1.0)
    assert np.allclose(vec.get_data(p.apply(v)), x / 3)
    assert np.allclose(vec.get_data(precond.create(a, "user_defined", user=lambda y: vec.scale(y, 2.0)).apply(v)), 2 * x)
    with pytest.raises(SolverError):
        precond.create(a, "usage")


def test_sweeps_match_a_plain_kaczmarz(spark):
    rng = np.random.default_rng(8)
    d = np.diag(rng.uniform(3, 4, 12)) + np.diag(rng.normal(size=11), 1) + np.diag(rng.normal(size=11), -1)
    b, x = rng.normal(size=(12, 2)), rng.normal(size=(12, 2))
    sigma = np.array([0.3, 0.5 + 1j])

    def plain(z, rows):
        z = z.astype(complex).copy()
        for i in [*rows, *reversed(rows)]:
            for c in range(2):
                w = d[i].astype(complex)
                w[i] -= sigma[c]
                z[:, c] += 0.8 * w.conj() * (b[i, c] - w @ z[:, c]) / (np.abs(w) ** 2).sum()
        return z

    c = rowproj.setup(sparse(spark, d), 1)
    re, im = rowproj.sweep_vectors(c, sigma, vec.set_data(spark, b), vec.set_data(spark, x), omega=0.8)
    assert np.allclose(vec.get_data(re) + 1j * vec.get_data(im), plain(x, range(12)))
    c = rowproj.setup(sparse(spark, d), 2)
    re, im = rowproj.sweep_vectors(c, sigma, vec.set_data(spark, b), vec.set_data(spark, x), omega=0.8)
    one, two = plain(x, range(6)), plain(x, range(6, 12))
    mean = np.concatenate([one[:5], (one[5:7] + two[5:7]) / 2, two[7:]])
    assert np.allclose(vec.get_data(re) + 1j * vec.get_data(im), mean)


def test_carp_cg_with_a_complex_shift(spark):
    a = gen.tridiagonal(spark, 20, 2.0, -1.0)
    b = vec.create(spark, 20, 1, 1.0)
    r = rowproj.carp_cg(a, b, [0.5 + 1j], tol=1e-8, blocks=2)
    z = vec.get_data(BlockVector(r.x.df, 20, 1)) + 1j * vec.get_data(BlockVector(r.x.df.select("i", __import__("pyspark").sql.functions.col("x_im").alias("x")), 20, 1))
    assert r.converged and np.allclose((dense_of(a) - (0.5 + 1j) * np.eye(20)) @ z, 1, atol=1e-6)
    q = rowproj.bordered(a, vec.create(spark, 20, 1, 1.0))
    assert np.allclose(dense_of(q)[20, :20], 1) and q.nrows == 21


# ---------------------------------------------------------------- eigenvalues


@pytest.mark.parametrize("k", [1, 2])
def test_arnoldi_identity(spark, k):
    a = gen.tridiagonal(spark, 25, 1.0, -1.0, 0.5)
    v, h = eig.block_arnoldi(linop.wrap_matrix(a), 6, k)
    d = vec.get_data(v)
    assert np.allclose(dense_of(a) @ d[:, :6], d @ h, atol=1e-10) and np.allclose(d.T @ d, np.eye(6 + k), atol=1e-10)


def test_lanczos_with_checkpoints(spark, tmp_path):
    a = gen.tridiagonal(spark, 30, 2.0, -1.0).persisted()
    ev = np.linalg.eigvalsh(dense_of(a))
    c = loop.Checkpoint(spark, str(tmp_path), "lanczos")
    eig.lanczos(linop.wrap_matrix(a), 10, 1e-12, checkpoint=c, every=5)
    assert c.need_restart() and len(c.read()["alpha"]) == 10
    low, high, n = eig.lanczos(linop.wrap_matrix(a), 30, 1e-9, checkpoint=loop.Checkpoint(spark, str(tmp_path), "lanczos"), every=50)
    assert np.allclose([low, high], ev[[0, -1]], atol=1e-6) and n > 10


@pytest.mark.skipif(not os.environ.get("SPANDREL_SLOW"), reason="minutes of small jobs; set SPANDREL_SLOW=1")
def test_jacobi_davidson_with_and_without_b(spark):
    a = gen.create_matrix(spark, "spinSZ6").persisted()
    ev = np.linalg.eigvalsh(dense_of(a))
    o = eig.JadaOptions(numEigs=2, which=EigSort.SR, convTol=1e-7, minBas=6, maxBas=14, innerSolvType=LinSolv.GMRES, innerSolvMaxIters=6)
    r = eig.subspace_jada(linop.wrap_matrix(a), o)
    assert r.converged == 2 and np.allclose(r.values, ev[:2], atol=1e-6)
    assert eig.residual_norms(linop.wrap_matrix(a), r).max() < 1e-5
    b = gen.tridiagonal(spark, a.nrows, 2.0, 0.0)
    b = Matrix(b.df.where("v != 0"), a.nrows, a.nrows)
    half = eig.subspace_jada(linop.wrap_matrix(a), o, linop.wrap_matrix(b))
    assert np.allclose(half.values, ev[:2] / 2, atol=1e-6)
    assert r.frame(spark).count() == 2
    with pytest.raises(NotImplementedError):
        eig.subspace_jada(linop.wrap_matrix(a), eig.JadaOptions(how=eig.EigExtr.HARMONIC))


def test_kpm_and_options(spark):
    a = gen.tridiagonal(spark, 20, 2.0, -1.0)
    d = (dense_of(a) - 2 * np.eye(20)) / 2.5
    x = vec.random(spark, 20, 2)
    mu = eig.kpm_moments(a, x, 0.4, 2.0, 7)
    v, t = vec.get_data(x), [np.eye(20), d]
    while len(t) < 7:
        t.append(2 * d @ t[-1] - t[-2])
    assert np.allclose(mu, [[v[:, j] @ m @ v[:, j] for j in range(2)] for m in t])
    o = eig.JadaOptions.parse("numEigs 4\nwhich SR\nconvTol 1e-6\nsomething else\ninnerSolvType MINRES\ninnerSolvRobust 0\n")
    assert (o.numEigs, o.which, o.innerSolvType, o.innerSolvRobust) == (4, EigSort.SR, LinSolv.MINRES, False)
    assert eig.JadaOptions.parse(o.text()).numEigs == 4


@pytest.mark.skipif(not os.environ.get("SPANDREL_SLOW"), reason="minutes of small jobs; set SPANDREL_SLOW=1")
def test_lobpcg_and_krylov_schur(spark):
    a = gen.tridiagonal(spark, 30, 2.0, -1.0).persisted()
    ev = np.linalg.eigvalsh(dense_of(a))
    r = eig.lobpcg(linop.wrap_matrix(a), 3, EigSort.LR, tol=1e-5, max_iter=40)
    assert np.allclose(r.values[:2], ev[::-1][:2], atol=1e-5)
    b = gen.tridiagonal(spark, 30, 0.0, -1.0, 2.0).persisted()
    want = np.linalg.eigvals(dense_of(b))
    got = eig.krylov_schur(linop.wrap_matrix(b), 2, EigSort.LM, basis=14, tol=1e-7)
    assert np.allclose(np.sort(np.abs(got.values)), np.sort(np.abs(want))[-2:], atol=1e-4)


def test_projections(spark):
    rng = np.random.default_rng(9)
    v = orth.orthog(None, vec.set_data(spark, rng.normal(size=(15, 2))))[0]
    x = vec.set_data(spark, rng.normal(size=(15, 1)))
    p = linop.projection(v, v)
    assert np.allclose(vec.gram(v, p.apply(x)).a, 0, atol=1e-12)
    a = gen.tridiagonal(spark, 15, 3.0, -1.0)
    d, q = dense_of(a), vec.get_data(v)
    op = eig.jada_op(linop.wrap_matrix(a), v, None, [0.7])
    proj = np.eye(15) - q @ q.T
    assert np.allclose(vec.get_data(op.apply(x)), proj @ (d - 0.7 * np.eye(15)) @ proj @ vec.get_data(x))
    inv = linop.from_function(15, 15, lambda y: vec.scale(y, 0.5))
    assert np.allclose(vec.gram(v, eig.jada_precon(inv, v).apply(x)).a, 0, atol=1e-12)
