from dataclasses import replace

import numpy as np
import pytest

from warpspark import errors
from warpspark.functions import kernels
from warpspark.operators import align, barycenter, kmeans, minibatch, pairwise, seeding, silhouette
from warpspark.rng import uniform_value


@pytest.fixture(scope="module")
def archetypes(spark):
    rows = [r for c in (0, 5, 10) for r in ([c] * 4, [c + 0.1, c, c, c], [c, c + 0.1, c, c])]
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, series array<double>")


def groups(result):
    by = {}
    for r in result.assignments.collect():
        by.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(sorted, by.values()))


WANTED = [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


@pytest.mark.parametrize("options", [{}, {"init": "parallel"}, {"elkan": True}, {"centroid_method": "ssg"}, {"dba_init": "medoid"}])
def test_kmeans_finds_archetypes(archetypes, options):
    found = kmeans.fit(archetypes, kmeans.KMeansConfig(k=3, n_init=5, **options))
    assert groups(found) == WANTED and found.inertia < 0.1 and found.converged
    assert [r["n"] for r in found.sizes().orderBy("cluster").collect()] == [3, 3, 3]
    again = kmeans.fit(archetypes.repartition(3), kmeans.KMeansConfig(k=3, n_init=5, **options))
    assert again.inertia == found.inertia and again.centroids.tolist() == found.centroids.tolist()


def test_distributed_way_agrees(archetypes, monkeypatch):
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 0)
    found = kmeans.fit(archetypes, kmeans.KMeansConfig(k=3, n_init=3, max_iter=10))
    assert groups(found) == WANTED and found.inertia < 0.1


@pytest.mark.parametrize("options", [{}, {"centroid_method": "ssg"}, {"dba_init": "medoid"}, {"dba_fraction": 0.5}, {"init": "parallel"}, {"elkan": True}])
def test_both_ways_give_the_same(spark, monkeypatch, options):
    x = np.random.default_rng(3).normal(size=(40, 8)).cumsum(axis=1)
    walks = spark.createDataFrame([(7 * i + 3, v.tolist()) for i, v in enumerate(x)], "id long, series array<double>")
    cfg = kmeans.KMeansConfig(k=4, n_init=1, max_iter=2, dba_max_iter=2, **options)
    found = [kmeans.fit(walks, cfg)]
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 0)
    found.append(kmeans.fit(walks, cfg))
    a, b = (sorted((r["id"], r["cluster"]) for r in f.assignments.collect()) for f in found)
    assert a == b and found[0].centroids == pytest.approx(found[1].centroids, abs=1e-9) and found[0].inertia == pytest.approx(found[1].inertia)
    assert found[0].skipped == found[1].skipped and found[0].iterations == found[1].iterations


def test_kept_bounds_change_no_result(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(30, 10)).cumsum(axis=1) + 8 * g for g in range(4)])
    walks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, series array<double>")
    for values in (kmeans.LOCAL_VALUES, 0):
        monkeypatch.setattr(kmeans, "LOCAL_VALUES", values)
        cfg = kmeans.KMeansConfig(k=4, n_init=1, max_iter=6, dba_max_iter=3)
        a, b = kmeans.fit(walks, cfg), kmeans.fit(walks, replace(cfg, elkan=True))
        assert np.allclose(a.centroids, b.centroids, atol=1e-9) and a.iterations == b.iterations
        assert sorted(map(tuple, a.assignments.select("id", "cluster").collect())) == sorted(map(tuple, b.assignments.select("id", "cluster").collect()))
        assert b.skipped > 0 and b.warped < 120 * 4 * b.iterations and a.warped == a.skipped == 0


@pytest.mark.parametrize("options", [{}, {"method": "ssg", "max_epochs": 3}, {"init": "medoid"}, {"fraction": 0.5}])
def test_whole_groups_and_partial_sums_average_alike(spark, monkeypatch, options):
    x = np.random.default_rng(9).normal(size=(36, 7)).cumsum(axis=1)
    rows = spark.createDataFrame([(5 * i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, g int, series array<double>").repartition(4)
    found = []
    for values in (4_000_000, 0, 12 * 7):
        monkeypatch.setattr(barycenter, "GROUP_VALUES", values)
        some = rows if values != 84 else rows.unionByName(rows.filter("g = 1 and id < 100").selectExpr("id + 1000 AS id", "g", "series"))
        found.append({r["group"]: r for r in barycenter.averages(some, "g", 2, max_iter=4, **options).collect()})
    for g in range(3):
        a, b = found[0][g], found[1][g]
        assert np.allclose(a["centroid"], b["centroid"], atol=1e-9) and (a["iterations"], a["converged"], a["mode"]) == (b["iterations"], b["converged"], b["mode"])
    assert np.allclose(found[0][0]["centroid"], found[2][0]["centroid"]) and not np.allclose(found[0][1]["centroid"], found[2][1]["centroid"])  # one of three is large


def test_subgradient_parts_are_averaged(spark, monkeypatch):
    x = np.random.default_rng(12).normal(size=(15, 6)).cumsum(axis=1)
    rows = spark.createDataFrame([(i, int(i >= 10), v.tolist()) for i, v in enumerate(x)], "id long, cluster int, series array<double>")
    start = np.stack([x[:10].mean(axis=0), x[10:].mean(axis=0)])
    monkeypatch.setattr(barycenter, "PART_MEMBERS", 5)  # two parts of the first cluster, one of the second
    part = {r["id"]: r["p"] for r in rows.selectExpr("id", "pmod(xxhash64(id), 2) AS p").collect()}
    got = barycenter.ssg_distributed(rows.repartition(3), start, 2, max_epochs=2, seed=7)
    want, steps = start.copy(), [0, 0]
    for epoch in (1, 2):
        new = want.copy()
        for c, members in ((0, range(10)), (1, range(10, 15))):
            groups = [[i for i in members if part[i] == q] for q in (0, 1)] if c == 0 else [list(members)]
            ends = []
            for own in groups:
                own = sorted(own, key=lambda i: (uniform_value(7, "ssg", epoch, i), i))  # noqa: B023
                at = want[c].copy()
                kernels.ssg_pass(x[own], at, 2, steps[c], 0.1, 0.01)
                ends.append((len(own), at))
            new[c] = sum(n * at for n, at in ends) / len(members)
            steps[c] += max(n for n, _ in ends)
        want = new
    assert np.allclose(got, want, atol=1e-9) and min(len(set(part[i] for i in range(10))), 2) == 2


def test_sweep_draws_once_and_needs_no_square(spark, archetypes, monkeypatch):
    cfg = kmeans.KMeansConfig(k=1, n_init=3, max_iter=4)
    pairs = pairwise.pairwise(archetypes, cfg.radius)
    one = kmeans.optimize(archetypes, 2, 5, cfg)
    assert one[0] == [(k, pytest.approx(kmeans.fit(archetypes, replace(cfg, k=k)).inertia)) for k in range(2, 6)]
    assert kmeans.optimize(archetypes, 2, 5, cfg, pairs) == one
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 0)
    two = kmeans.optimize(archetypes, 2, 4, replace(cfg, n_init=2), pairs)
    monkeypatch.undo()
    assert two[0] == [(k, pytest.approx(v)) for k, v in kmeans.optimize(archetypes, 2, 4, replace(cfg, n_init=2))[0]]
    x = np.stack([r["series"] for r in archetypes.orderBy("id").collect()])
    assert seeding.plus_plus_cached(archetypes, pairs, 5, [7, 8]) == [seeding.plus_plus_local(x, 5, cfg.radius, s) for s in (7, 8)]


def test_cached_draws_make_only_the_rows_of_drawn_ids(spark, archetypes, monkeypatch):
    x = np.stack([r["series"] for r in archetypes.orderBy("id").collect()])
    made, plain = [], seeding.distances_from
    monkeypatch.setattr(seeding, "distances_from", lambda df, ids, radius: made.append(ids) or plain(df, ids, radius))
    found = seeding.plus_plus_cached(archetypes, None, 4, [7, 8, 7], 2)
    assert found == [seeding.plus_plus_local(x, 4, 2, s) for s in (7, 8, 7)]
    assert sorted(i for ids in made for i in ids) == sorted({i for ids in found for i in ids[:-1]})  # each once
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], "id long, series array<double>")
    assert len(set(seeding.plus_plus_cached(same, None, 3, [1])[0])) == 3


def test_silhouette_sums_match_pairs(spark):
    x = np.random.default_rng(10).normal(size=(60, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 3 if i else 9) for i, v in enumerate(x)], "id long, series array<double>, cluster int")
    a = silhouette.samples(pairwise.pairwise(df, 1), df.select("id", "cluster")).orderBy("id").collect()
    b = silhouette.scores(pairwise.cluster_distances(df, 1)).orderBy("id").collect()
    assert [(r["id"], r["cluster"]) for r in a] == [(r["id"], r["cluster"]) for r in b] and np.allclose([r["score"] for r in a], [r["score"] for r in b]) and len(b) == 60


def test_mini_batch_is_the_same_both_ways(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(50, 6)).cumsum(axis=1)
    walks = spark.createDataFrame([(11 * i, v.tolist()) for i, v in enumerate(x)], "id long, series array<double>")
    cfg = minibatch.MiniBatchConfig(k=3, batch_size=10, max_iter=4, n_init=1)
    a = minibatch.fit(walks, cfg)
    monkeypatch.setattr(minibatch, "LOCAL_VALUES", 0)
    b = minibatch.fit(walks.repartition(3), cfg)
    assert a.centroids == pytest.approx(b.centroids, abs=1e-9) and a.inertia == pytest.approx(b.inertia)


def test_medoid_by_batches(monkeypatch):
    x = np.random.default_rng(6).normal(size=(30, 5))
    d = np.array([[kernels.dtw(a[None], b[None], 1)[0] for b in x] for a in x])
    monkeypatch.setattr(kernels, "BATCH", 4)
    assert kernels.medoid(x, 1) == int(np.argmin(d.sum(axis=1)))


@pytest.mark.parametrize("options", [{}, {"centroid_method": "ssg"}, {"dba_init": "medoid"}, {"dba_fraction": 0.5}])
def test_distributed_way_honours_options(archetypes, monkeypatch, options):
    cfg = kmeans.KMeansConfig(k=3, n_init=2, max_iter=4, dba_max_iter=1, **options)
    labelled = archetypes.selectExpr("id", "int(id / 3) as cluster", "series")
    x = np.stack([r["series"] for r in archetypes.orderBy("id").collect()])
    got = kmeans._averaged(labelled, cfg, 7)
    sampled = [(0, 1), (0, 2), (1, 2)]
    for c in range(3):
        own = x[3 * c : 3 * c + 3]
        if "dba_fraction" in options:  # one of the samples of two, from the mean of all
            each = [s / n for m in sampled for s, n in [kernels.align_sums(own[list(m)], own.mean(axis=0), cfg.radius)]]
            assert min(np.abs(e - got[c]).max() for e in each) < 1e-9
        elif "centroid_method" in options:  # orders of members differ
            assert got[c] == pytest.approx(kernels.ssg(own, cfg.radius, seed=7)[0], abs=0.02)
            assert np.abs(got[c] - kernels.dba(own, cfg.radius, max_iter=1)[0]).max() > 1e-6
        else:
            assert got[c] == pytest.approx(kernels.dba(own, cfg.radius, cfg.dba_init, 1)[0])
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 0)
    found = kmeans.fit(archetypes, cfg)
    assert groups(found) == WANTED and found.inertia < 0.1


@pytest.mark.parametrize("options", [{"centroid_method": "ssg"}, {"dba_init": "medoid"}, {"dba_fraction": 0.5}])
def test_options_change_the_distributed_fit(spark, monkeypatch, options):
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 0)
    x = np.random.default_rng(3).normal(size=(9, 8)).cumsum(axis=1)
    walks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, series array<double>")
    one = {"k": 1, "n_init": 1, "max_iter": 1, "dba_max_iter": 1}
    got = kmeans.fit(walks, kmeans.KMeansConfig(**one, **options)).centroids[0]
    assert np.abs(got - kernels.dba(x, 2, max_iter=1)[0]).max() > 1e-3  # what it was whatever the options
    if "dba_init" in options:
        assert got == pytest.approx(kernels.dba(x, 2, "medoid", 1)[0])
    if "centroid_method" in options:
        assert got == pytest.approx(kernels.ssg(x, 2)[0], abs=0.5)


def test_sample_of_members_is_exact(spark):
    df = spark.range(1000).selectExpr("id", "int(id % 7 = 0) as cluster", "array(double(id)) as series")
    one, two = ({(r["id"], r["cluster"]) for r in barycenter.members_sample(df.repartition(3), 0.3, 5, n).collect()} for n in (0, 1))
    for got in (one, two):
        assert sorted(c for _, c in got) == [0] * 258 + [1] * 43  # ceil(0.3 * 857) and ceil(0.3 * 143)
    assert one != two


def test_distributed_rescue_takes_the_member_from_its_donor(spark):
    df = spark.createDataFrame([(i, 0, float(i), [float(i)] * 2) for i in range(4)], "id long, cluster int, dist double, series array<double>")
    got = kmeans._rescued(df, [{"cluster": 0, "n": 4}], 3, 1)
    assert sorted((r["id"], r["cluster"]) for r in got.collect()) == [(0, 0), (1, 0), (2, 2), (3, 1)]


def test_limits(archetypes):
    assert kmeans.fit(archetypes, kmeans.KMeansConfig(k=1, n_init=1, radius=None)).inertia == pytest.approx(600.04, rel=0.01)
    assert kmeans.fit(archetypes, kmeans.KMeansConfig(k=9, n_init=2)).inertia == pytest.approx(0, abs=1e-9)
    with pytest.raises(errors.TooFewSeries):
        kmeans.fit(archetypes, kmeans.KMeansConfig(k=10))
    with pytest.raises(errors.InvalidK):
        kmeans.KMeansConfig(k=0)
    with pytest.raises(errors.EmptyCluster):
        kmeans.rescue(np.zeros(1, int), np.zeros((1, 4)), np.zeros((2, 4)), 2, None, 1)


def test_optimize_and_elbow(archetypes, spark):
    results, best = kmeans.optimize(archetypes, 2, 6, kmeans.KMeansConfig(k=1, n_init=4))
    assert best == 3 and len(results) == 5
    assert kmeans.best_k([(1, 100.0), (2, 30.0), (3, 25.0)]) == 2 and kmeans.best_k([(4, 1.0)]) == 4 and kmeans.best_k([]) is None
    assert kmeans.best_k_table(spark.createDataFrame(results, "k long, inertia double")).first()[0] == 3
    with pytest.raises(errors.InvalidKRange):
        kmeans.optimize(archetypes, 3, 2, kmeans.KMeansConfig(k=1))


def test_mini_batch(archetypes):
    found = minibatch.fit(archetypes, minibatch.MiniBatchConfig(k=3, batch_size=100, max_iter=20))
    assert groups(found) == WANTED


def test_pairs_silhouette_and_medoid(archetypes, spark):
    pairs = pairwise.pairwise(archetypes, 2)
    assert pairs.count() == 36 and pairs.filter("i <= j").count() == 0
    good = spark.createDataFrame([(i, i // 3) for i in range(9)], "id long, cluster int")
    bad = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, cluster int")
    _, a = silhouette.silhouette(archetypes, good, 2)
    _, b = silhouette.silhouette(archetypes, bad, 2)
    assert a > 0.8 and b < 0.5 and b < a
    with pytest.raises(errors.SingleCluster):
        silhouette.silhouette(archetypes, good.selectExpr("id", "0 AS cluster"), 2)
    # 1 and 2 have equal sums, so has 0 a smaller one in each group
    assert sorted((r["group"], r["medoid"]) for r in pairwise.medoid(archetypes.join(good, "id"), "cluster", 2).collect()) == [(0, 0), (1, 3), (2, 6)]


def test_pairwise_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK", 7)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, series array<double>")
    got = {(r["i"], r["j"]) for r in pairwise.pairwise(df).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i)}


def test_pairs_leave_a_tile_nearest_first(spark):
    x = np.random.default_rng(14).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, series array<double>, one int")
    found = pairwise.pairwise(df, 1, within="one").collect()
    assert {(r["i"], r["j"]): r["dist"] for r in found} == {(i, j): kernels.dtw(x[i][None], x[j][None], 1)[0] for i in range(60) for j in range(i)}
    assert (np.diff([r["dist"] for r in found]) > -1e-9).all()


@pytest.fixture(scope="module")
def copied(spark):
    """120 series in 3 groups, a third of them copies."""
    x = np.random.default_rng(12).normal(size=(80, 6))
    rows = [(i, x[i if i < 80 else i - 80], i % 3 if i < 80 else (i - 80) % 3 if i % 2 else 0) for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in rows], "id long, series array<double>, cluster int")
    d = np.array([[kernels.dtw(a[1][None], b[1][None], 1)[0] for b in rows] for a in rows])
    return df, d, np.array([c for *_, c in rows])


@pytest.mark.parametrize("block, columns", [(512, 512), (7, 3)])
def test_tiles_add_up_their_pairs(copied, monkeypatch, block, columns):
    df, d, label = copied
    monkeypatch.setattr(pairwise, "BLOCK", block)
    monkeypatch.setattr(kernels, "PATCH_COLUMNS", columns)
    got = {(r["id"], r["other"]): (r["cluster"], r["total"], r["n"]) for r in pairwise.cluster_distances(df, 1).collect()}
    assert len(got) == 360
    for i in range(120):
        for c in range(3):
            assert got[i, c] == (label[i], pytest.approx(d[i, label == c].sum()), (label == c).sum() - (label[i] == c))
    for r in pairwise.medoid(df, "cluster", 1).collect():
        own = np.flatnonzero(label == r["group"])
        sums = d[np.ix_(own, own)].sum(axis=1)
        assert r["medoid"] == own[np.isclose(sums, sums.min())].min() and r["total"] == pytest.approx(sums.min())
    pairs = {(r["group"], r["i"], r["j"]): r["dist"] for r in pairwise.pairwise(df, 1, within="cluster").collect()}
    assert pairs == {(label[i], i, j): d[i, j] for i in range(120) for j in range(i) if label[i] == label[j]}


@pytest.mark.parametrize("scale", [1.0, 1e-15, 1e18])
@pytest.mark.parametrize("block", [512, 7])
def test_medoids_need_few_sums_in_double_precision(spark, monkeypatch, scale, block):
    monkeypatch.setattr(pairwise, "BLOCK", block)
    x = np.random.default_rng(13).normal(size=(60, 8))
    x[7] = x[40] = x[21] * (1 + 1e-12)  # single precision can't tell these from 21
    x *= scale
    label, taken, totals = np.arange(60) % 2, [], pairwise._totals
    label[40] = 1
    df = spark.createDataFrame([(i, v.tolist(), int(label[i])) for i, v in enumerate(x)], "id long, series array<double>, cluster int")
    monkeypatch.setattr(pairwise, "_totals", lambda each, chosen, radius: taken.append(chosen) or totals(each, chosen, radius))
    found = {r["group"]: (r["medoid"], r["total"]) for r in pairwise.medoid(df, "cluster", 2).collect()}
    bounds = {r["id"]: (r["least"], r["most"]) for r in pairwise._bounds(df.selectExpr("id", "cluster AS of", "series", "1 AS n"), 2).collect()}
    for c in (0, 1):
        own = np.flatnonzero(label == c)
        sums = np.array([kernels.dtw(x[own], np.broadcast_to(x[i], (len(own), 8)), 2).sum() for i in own])
        assert found[c] == (own[sums.argmin()], pytest.approx(sums.min(), rel=1e-12))
        assert all(bounds[i][0] <= s <= bounds[i][1] for i, s in zip(own, sums))
    assert taken[0].count() <= 6 if scale < 1e18 else taken[0].count() == 59  # beyond float32 all are open; 7 and 40 are copies


def test_medoids_of_what_cannot_be_compared(spark):
    rows = [(0, [0.0, np.nan]), (1, [1.0, 2.0]), (2, [np.inf, 1.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, i // 2 if i < 3 else 2) for i, v in rows], "id long, series array<double>, cluster int")
    assert sorted((r["group"], r["medoid"]) for r in pairwise.medoid(df, "cluster", 2).collect()) == [(0, 0), (1, 2), (2, 3)]


def test_what_tiles_shuffle_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK", 2)
    for n in (60, 240):
        df = spark.range(n).selectExpr("id", "array(double(id), 1D) AS series", "0 AS cluster")
        assert pairwise._tiles(df, None).count() == pairwise._tiles(df, "cluster").count() == pairwise.COPIES * n


def test_averages_begin_at_medoids_of_tiles(copied, monkeypatch):
    df, d, label = copied
    monkeypatch.setattr(kernels, "medoid", None)  # no task compares a whole group
    for r in barycenter.averages(df, "cluster", 1, init="medoid", max_iter=2).collect():
        own = np.flatnonzero(label == r["group"])
        x = np.array([row["series"] for row in df.orderBy("id").collect()])[own]
        sums = d[np.ix_(own, own)].sum(axis=1)
        first = x[np.flatnonzero(np.isclose(sums, sums.min()))[0]]
        assert r["centroid"] == pytest.approx(kernels.dba(x, 1, max_iter=2, start=first)[0])


def test_averages_begin_at_medoids_by_bounds(copied, monkeypatch):
    df, _, _ = copied
    taken, totals = [], pairwise._totals
    monkeypatch.setattr(pairwise, "_totals", lambda each, chosen, radius: taken.append(chosen) or totals(each, chosen, radius))
    assert barycenter.averages(df, "cluster", 1, init="medoid", max_iter=1).count() == 3
    assert len(taken) == 1 and taken[0].count() <= 6  # of 120 rows


def test_seeding_with_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], "id long, series array<double>")
    assert seeding.plus_plus(df, 3, None, 1).shape == (3, 2)
    assert len(set(seeding.plus_plus_local(np.ones((4, 2)), 3, None, 1))) == 3
    assert len(set(seeding.parallel_local(np.ones((4, 2)), 3, None, 1))) == 3


def test_align(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "id string, label int")
    attributes = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0)], "id string, x double")
    rows, dropped = align.align(labels, attributes)
    assert {(r["id"], r["x"]) for r in rows.collect()} == {("a", 2.0), ("b", 1.0)} and dropped == 1
    with pytest.raises(errors.MissingAttributes):
        align.align(labels, attributes.filter("id <> 'a'"))


@pytest.mark.parametrize("options", [{}, {"elkan": True}, {"init": "parallel", "elkan": True}])
def test_restarts_share_their_passes(spark, monkeypatch, options):
    x = np.random.default_rng(4).normal(size=(60, 6)).cumsum(axis=1)
    walks = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, series array<double>").repartition(3)
    cfg = kmeans.KMeansConfig(k=3, n_init=3, max_iter=4, dba_max_iter=2, **options)
    want = kmeans.fit(walks, cfg)
    passes, plain = [], barycenter._summed
    monkeypatch.setattr(barycenter, "_summed", lambda *a: passes.append(1) or plain(*a))
    monkeypatch.setattr(kmeans, "TASK_VALUES", 359)
    for values in (barycenter.GROUP_VALUES, 0):  # sums added up by the driver, and by a shuffle
        monkeypatch.setattr(barycenter, "GROUP_VALUES", values)
        passes.clear()
        got = kmeans.fit(walks, cfg)
        assert 0 < len(passes) <= 4 * (1 + 2)  # of one restart, whatever their number
        assert got.restarts == pytest.approx(want.restarts) and np.allclose(got.centroids, want.centroids, atol=1e-9)
        assert (got.iterations, got.converged, got.skipped, got.warped) == (want.iterations, want.converged, want.skipped, want.warped)
        assert sorted(map(tuple, got.assignments.select("id", "cluster").collect())) == sorted(map(tuple, want.assignments.select("id", "cluster").collect()))


def test_draws_of_all_seeds_take_a_pass_each(spark, archetypes):
    x = np.stack([r["series"] for r in archetypes.orderBy("id").collect()])
    got = seeding.plus_plus_runs(archetypes, 4, 2, [7, 8])
    assert [g.tolist() for g in got] == [x[seeding.plus_plus_local(x, 4, 2, s)].tolist() for s in (7, 8)]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], "id long, series array<double>")
    assert seeding.plus_plus_runs(same, 3, None, [1])[0].shape == (3, 2)
