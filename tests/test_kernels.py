import numpy as np
import pytest

from warpspark.functions import kernels as K

PAIRS = [
    ([0, 0, 0], [1, 1, 1], 1.7320508075688772), ([0, 1, 0], [0, 0, 0], 1.0), ([1, 2, 3, 4], [1, 2, 3, 4], 0.0), ([1, 2, 3], [3, 2, 1], 2.8284271247461903),
    ([0, 5, 0, 5], [5, 0, 5, 0], 7.0710678118654755), ([1], [5], 4.0), ([0, 0, 1], [1, 0, 0], 1.4142135623730951), ([0, 1, 2, 3, 4], [0, 0, 0, 0, 4], 2.449489742783178),
    ([10, 10, 10], [10.1, 9.9, 10], 0.14142135623730953), ([0, 3, 0, 3, 0], [3, 0, 3, 0, 3], 4.242640687119285),
]


def arr(x):
    return np.array([x], float)


def plain(a, b, r):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if r is None or abs(i - j) <= r:
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return np.sqrt(d[n, m])


@pytest.mark.parametrize("a,b,d", PAIRS)
def test_golden_distances(a, b, d):
    assert abs(K.dtw(arr(a), arr(b), None)[0] - d) < 1e-10


def test_batches_match_plain_matrix():
    rng = np.random.default_rng(0)
    for n, m in ((7, 7), (5, 9)):
        a, b = rng.normal(size=(20, n)), rng.normal(size=(20, m))
        for r in (None, 4):
            assert np.allclose(K.dtw(a, b, r), [plain(x, y, r) for x, y in zip(a, b)])
            d, row, i, j = K.paths(a, b, r)
            assert np.allclose(d, [plain(x, y, r) for x, y in zip(a, b)])
            cost = np.bincount(row, weights=(a[row, i] - b[row, j]) ** 2)
            assert np.allclose(np.sqrt(cost), d)
            for k in range(20):
                p = list(zip(i[row == k], j[row == k]))
                assert p[0] == (0, 0) and p[-1] == (n - 1, m - 1)
                assert all((x[0] - w[0], x[1] - w[1]) in ((1, 1), (1, 0), (0, 1)) for w, x in zip(p, p[1:]))


def test_cutoff_keeps_equal_and_drops_above():
    a, b = np.zeros((1, 5)), np.full((1, 5), 10.0)
    d = K.dtw(a, b, None)
    assert np.isinf(K.dtw(a, b, None, np.array([1.0]))[0])
    assert K.dtw(a, b, None, d)[0] == d[0]
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 12)), rng.normal(size=(300, 12))
    full, cut = K.dtw(x, y, 2), np.full(300, np.median(K.dtw(x, y, 2)))
    assert np.array_equal(K.dtw(x, y, 2, cut), np.where(full <= cut, full, np.inf))


def test_bounds_are_below_the_distance():
    rng = np.random.default_rng(2)
    for r in (0, 1, 3, None):
        x, c = rng.normal(size=(200, 16)).cumsum(axis=1), rng.normal(size=16)
        up, low = (e[0] for e in K.envelopes(c[None], r))
        d = K.dtw(x, np.broadcast_to(c, x.shape), r)
        assert (K.lb_keogh(x, up, low) <= d + 1e-9).all()
        assert (K.lb_two_pass(x, c, up, low, r) <= d + 1e-9).all()


def test_nearest_is_exact_where_a_false_bound_would_err():
    label, dist = K.nearest(np.zeros((1, 4)), np.stack([np.full(4, 6.0), np.full(4, -5.0)]), 2)
    assert label[0] == 1 and dist[0] == 10
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(150, 20)), rng.normal(size=(6, 20))
    all_d = np.stack([K.dtw(x, np.broadcast_to(k, x.shape), 2) for k in c], 1)
    label, dist = K.nearest(x, c, 2)
    assert np.array_equal(label, all_d.argmin(axis=1)) and np.allclose(dist, all_d.min(axis=1))


@pytest.mark.parametrize("base", [0, 5, 10])
def test_barycenter(base):
    x = np.array([[base] * 4, [base + 0.1, base, base, base], [base, base + 0.1, base, base]], float)
    c, converged, *_ = K.dba(x, None, max_iter=50, tol=1e-8)
    assert converged and np.allclose(c, [base + 1 / 30, base + 1 / 30, base, base], atol=1e-6)
    c, *_ = K.ssg(x, None)
    assert np.allclose(c, base, atol=0.2)
    assert K.dba(x, None, init="medoid")[4] == "full" and K.dba(x, None, fraction=0.4)[4] == "stochastic"


def test_envelopes_are_those_of_each_neighbourhood():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 30):
        x = rng.normal(size=(3, n))
        for r in (0, 1, 2, 5, 29, 40, None):
            up, low = K.envelopes(x, r)
            for i in range(n):
                part = x if r is None else x[:, max(0, i - r) : i + r + 1]
                assert np.array_equal(up[:, i], part.max(axis=1)) and np.array_equal(low[:, i], part.min(axis=1))


def test_buffers_follow_the_band_and_not_the_matrix():
    assert K.path_batch(3000, 3000, 2) * 3000 * 5 <= K.MOVES and K.path_batch(3000, 3000, None) * 9_000_000 <= K.MOVES
    assert K.batch_size(3000, 3000, 2) * 8 * 6000 <= K.BUFFER and K.batch_size(64, 64, 2) > 1000
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(3, 5000)), rng.normal(size=(3, 5001))
    d, row, i, j = K.paths(a, b, 2)
    assert np.allclose(np.sqrt(np.bincount(row, weights=(a[row, i] - b[row, j]) ** 2)), d) and np.array_equal(d, K.dtw(a, b, 2))
    assert np.isinf(K.dtw(a[:, :5], b[:, :9], 2)).all()  # a band that doesn't reach the end


def test_cascade_warps_only_what_bounds_let_pass(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(400, 16)).cumsum(axis=1), rng.normal(size=(400, 16)).cumsum(axis=1)
    full = K.dtw(a, b, 2)
    cut = np.full(400, np.median(full))
    seen = []
    dtw = K.dtw
    monkeypatch.setattr(K, "dtw", lambda a, *rest: (seen.append(len(a)), dtw(a, *rest))[1])
    found, by = K.cascade(a, b, 2, cut)
    assert np.array_equal(found, np.where(full <= cut, full, np.inf))
    assert sum(seen) == np.isin(by, (2, 3)).sum() < 300 and (by == 0).any() and (by == 3).sum() == 200
    found, by = K.cascade(a[:, :9], b, 8, cut)
    assert set(by) <= {2, 3}


def test_kept_bounds_are_true_and_spare_distances():
    rng = np.random.default_rng(7)
    for r in (0, 2, None):
        x = np.concatenate([rng.normal(size=(60, 24)).cumsum(axis=1) + 6 * g for g in range(5)])
        c = np.stack([x[60 * g : 60 * g + 60].mean(axis=0) for g in range(5)])
        label, lower, moves, made = np.zeros(300, int), np.zeros((300, 5)), np.zeros(5), []
        for step in range(5):
            kept = np.maximum(lower - moves, 0)
            every = np.stack([K.dtw(x, np.broadcast_to(k, x.shape), r) for k in c], 1)
            assert (kept <= every + 1e-12).all()
            label, dist, lower, warped, spared = K.nearest_bounded(x, c, r, label, kept)
            assert np.array_equal(label, every.argmin(axis=1)) and np.array_equal(dist, every.min(axis=1)) and (lower <= every + 1e-12).all()
            made.append((int(warped.sum()), int(spared.sum())))
            moved = c + rng.normal(size=c.shape) * 0.1 / (step + 1)
            moves, c = K.bound_moves(c, moved, r), moved
        assert made[0][1] == 0 and made[-1][1] > 300 and made[-1][0] < 1500 * 0.6
    # Ties go to the least centroid, whichever was the last one.
    label = K.nearest_bounded(np.zeros((2, 4)), np.stack([np.ones(4), -np.ones(4)]), 2, np.array([1, 0]), np.zeros((2, 2)))[0]
    assert label.tolist() == [0, 0]


def test_path_of_one_pair_is_that_of_batches():
    rng = np.random.default_rng(8)
    for n, m, r in ((7, 7, None), (5, 9, 4), (9, 5, 4), (6, 6, 0), (1, 1, 2), (1, 4, None), (4, 1, 3), (30, 30, 2)):
        for _ in range(20):
            a, b = rng.integers(0, 3, n).astype(float), rng.integers(0, 3, m).astype(float)
            _, _, i, j = K.paths(a[None], b[None], r)
            assert K.path_of(a, b, r) == list(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("p, q, n, m, radius", [(30, 40, 9, 9, 2), (5, 3, 4, 4, None), (7, 6, 5, 7, 2), (1, 1, 1, 1, 2), (20, 2, 7, 9, 1)])
def test_table_is_bit_for_bit_the_distances(monkeypatch, p, q, n, m, radius):
    monkeypatch.setattr(K, "PATCH_COLUMNS", 8)
    monkeypatch.setattr(K, "PATCH", 50)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(p, n)), rng.normal(size=(q, m))
    got, own = np.full((p, q), np.nan), np.zeros((p, p))
    for rows, columns, d in K.table(x, y, radius):
        got[rows, columns] = d
    for rows, columns, d in K.table(x, None, radius):
        own[rows, columns] += d
    assert (got == np.stack([K.dtw(np.broadcast_to(v, (q, n)), y, radius) for v in x])).all()
    assert (own == np.tril(np.stack([K.dtw(np.broadcast_to(v, (p, n)), x, radius) for v in x]), -1)).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_diagonals_give_what_rows_of_the_band_give(monkeypatch, radius):
    calls, add = [], np.add
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 6, 20):
        x, y = rng.normal(size=(9, n)), rng.normal(size=(7, n))
        want = np.stack([K.dtw(np.broadcast_to(v, (7, n)), y, radius) for v in x])
        with monkeypatch.context() as m:
            m.setattr(np, "add", lambda *a, **b: calls.append(n) or add(*a, **b))
            assert [d.tolist() for *_, d in K.table(x, y, radius)] == [want.tolist()]
        x[4, 0], y[3, n - 1], x[5, n // 2] = np.inf, np.nan, 1e200
        want = np.stack([K.dtw(np.broadcast_to(v, (7, n)), y, radius) for v in x])
        assert np.array_equal(next(K.table(x, y, radius))[2], want, equal_nan=True)
    assert radius > K.NARROW or len([n for n in calls if n == 20]) == (20 if radius == 0 else 39)  # once for a diagonal, not for a cell


@pytest.mark.parametrize("n, radius", [(64, 2), (30, 7), (30, None)])
def test_single_precision_errs_as_little_as_it_says(n, radius):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, n)) * 10.0 ** rng.integers(-9, 9, (60, 1))).astype(np.float32).astype(float)
    for (_, _, rough), (_, _, d) in zip(K.table(x, None, radius, np.float32), K.table(x, None, radius)):
        assert rough.dtype == np.float32 and (rough != d).any()
        assert (abs(rough.astype(float) - d) <= K.table_error(n, n) * d).all()
