import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.operators import bins as bn
from tractwise.operators import centers as ce
from tractwise.operators import clusters as cl
from tractwise.operators import hierarchy as hi


def vectors(spark, x, name="vec"):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, {name} array<double>")


def blobs(seed=0, sizes=(30, 20, 10), p=4, gap=6):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n, p)) + gap * i for i, n in enumerate(sizes)])


def brute_ward(x):
    groups = {i: [i] for i in range(len(x))}
    merges = []
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    na, nb = len(groups[a]), len(groups[b])
                    gap = x[groups[a]].mean(0) - x[groups[b]].mean(0)
                    cost = np.sqrt(2 * na * nb / (na + nb) * (gap @ gap))
                    if best is None or cost < best[0]:
                        best = (cost, a, b)
        cost, a, b = best
        groups[a] += groups.pop(b)
        merges.append((a, b, cost, len(groups[a])))
    return merges


@pytest.mark.parametrize("limit,block", [(2000, None), (1, 7)])
def test_ward_tree_is_exact_in_every_mode(spark, limit, block):
    x = np.random.default_rng(8).normal(size=(24, 3))
    df = vectors(spark, x)
    merges = hi.ward_merges(df, "vec", limit, block)
    got = sorted((r["height"], r["a"], r["b"], r["into"], r["size"]) for r in merges.collect())
    want = sorted((c, a, b, a, n) for a, b, c, n in brute_ward(x))
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want])
    for k in (2, 5):
        groups = {i: {i} for i in range(24)}
        for _, a, b, _, _ in want[:24 - k]:
            groups[a] |= groups.pop(b)
        number = {i: n for n, a in enumerate(sorted(groups), 1) for i in groups[a]}
        cut = {r["id"]: r["cluster"] for r in hi.ward_cut(df, merges, k).collect()}
        assert cut == number


def test_ward_with_equal_points(spark):
    x = np.repeat(np.array([[0.0, 0], [5, 5], [9, 0]]), 4, axis=0)
    for limit in (2000, 1):
        merges = hi.ward_merges(vectors(spark, x), "vec", limit, 5)
        heights = sorted(r["height"] for r in merges.collect())
        assert len(heights) == 11 and heights[:9] == [0.0] * 9
        cut = {r["id"]: r["cluster"] for r in hi.ward_cut(vectors(spark, x), merges, 3).collect()}
        assert [cut[i] for i in range(12)] == [1] * 4 + [2] * 4 + [3] * 4


@pytest.mark.parametrize("block", [None, 9])
def test_silhouette(spark, block):
    x = np.random.default_rng(9).normal(size=(30, 3))
    label = np.array([0] * 14 + [1] * 15 + [2])
    df = vectors(spark, x).withColumn("c", F.element_at(F.array(*[F.lit(int(c)) for c in label]),
                                                       (F.col("id") + 1).cast("int")))
    got = {r["id"]: r["width"] for r in hi.silhouettes(df, "id", "c", "vec", block).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(30):
        own = (label == label[i]) & (np.arange(30) != i)
        if not own.any():
            assert got[i] == 0.0
            continue
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))
    assert hi.silhouettes(df.filter("c = 0"), "id", "c", "vec").count() == 0


def test_bins_edges(spark):
    points = spark.createDataFrame([("f", float(x), d) for x, d in [(1, 1.0), (1.9, 3.0), (2, 5.0), (4, 7.0)]]
                                   + [("g", 99.0, 1.0)], "file string, x double, delta double")
    grid = bn.fit_grid(points.filter("file = 'f'"))
    assert grid.breaks == [1, 2, 3, 4, 5] and grid.mids == [1.5, 2.5, 3.5, 4.5]
    got = {r["file"]: r["vec"] for r in bn.bin_means(points, grid).collect()}
    assert got == {"f": [2.0, 5.0, 0.0, 7.0], "g": [0.0] * 4}
    edge = spark.createDataFrame([(5.0,), (5.01,), (0.99,)], "x double")
    assert [r[0] for r in edge.select(grid.index(F.col("x"))).collect()] == [4, None, None]
    with pytest.raises(ValueError):
        bn.fit_grid(points.filter("file = 'g'"))


def test_scaling_survives_flat_bins(spark):
    df = vectors(spark, np.array([[1.0, 5], [3, 5], [5, 5]]))
    z = bn.scale_vectors(df, bn.vector_stats(df))
    assert [r["z"] for r in z.orderBy("id").collect()] == [[-1, 0], [0, 0], [1, 0]]


def test_soft_membership_sums_to_one(spark):
    df = vectors(spark, blobs())
    centers = spark.createDataFrame([(1, [0.0] * 4), (2, [6.0] * 4)], "cluster int, center array<double>")
    got = ce.center_distances(df, centers).withColumn("m", ce.memberships()).withColumn(
        "own", ce.nearest())
    for r in got.collect():
        assert sum(m["weight"] for m in r["m"]) == pytest.approx(1)
        d = [x["dist"] for x in r["dists"]]
        assert r["own"] == 1 + int(np.argmin(d))
        assert r["m"][0]["weight"] == pytest.approx((1 / (d[0] ** 2 + 1e-6)) / sum(1 / (v * v + 1e-6) for v in d))


def test_cluster_names_by_rank(spark):
    df = spark.createDataFrame([(1, -.5), (1, -.3), (2, -.1)], "cluster int, mean_delta double")
    assert {r["cluster"]: r["cluster_name"] for r in ce.name_by_mean(df).collect()} == {
        1: "contraction", 2: "expansion"}
    tie = spark.createDataFrame([(1, .1), (2, .1)], "cluster int, mean_delta double")
    assert {r["cluster"]: r["cluster_name"] for r in ce.name_by_mean(tie).collect()} == {
        1: "expansion", 2: "contraction"}


def test_kmeans_finds_the_blobs(spark):
    x = blobs()
    fit = cl.kmeans_fit(vectors(spark, x, "z").repartition(3), 3, n_start=10)
    truth = np.repeat([0, 1, 2], (30, 20, 10))
    means = np.array([x[truth == c].mean(0) for c in range(3)])
    order = np.argsort(fit.means[:, 0])
    assert fit.means[order] == pytest.approx(means)
    assert fit.goal == pytest.approx(((x - means[truth]) ** 2).sum())


def dense_loglik(x, m):
    whole = m.variances if m.variances.ndim == 3 else np.stack([np.diag(v) for v in m.variances])
    density = np.zeros(len(x))
    for w, mu, cov in zip(m.weights, m.means, whole):
        gap = x - mu
        far = (gap * np.linalg.solve(cov, gap.T).T).sum(1)
        density += w * np.exp(-.5 * far) / np.sqrt(np.linalg.det(2 * np.pi * cov))
    return np.log(density).sum()


def test_mixture_selects_three_and_likelihood_rises(spark):
    x = blobs(1)
    fits = cl.mixture_fits(vectors(spark, x, "z").repartition(2), range(1, 6))
    assert max(fits, key=lambda m: m.bic).k == 3
    for m in fits:
        assert (np.diff(m.history) >= -1e-6 * (1 + np.abs(m.history[-1]))).all(), (m.family, m.k)
        if not m.failed:
            assert m.history[-1] == pytest.approx(dense_loglik(x, m)), (m.family, m.k)
            assert m.bic == pytest.approx(
                2 * m.history[-1] - cl.family_parameters(m.family, m.k, 4) * np.log(60))
    assert {m.family for m in fits if m.k == 3 and not m.failed} == set(cl.FAMILIES + cl.FULL_FAMILIES)
    table = cl.bic_table(spark, fits)
    assert table.count() == 60


def test_common_axes_raise_the_likelihood_too(spark):
    x = blobs(2) @ np.random.default_rng(2).normal(size=(4, 4))
    for m in cl.mixture_fits(vectors(spark, x, "z"), [2], families=cl.COMMON_AXES, max_iter=25):
        assert not m.failed and len(m.history) > 2
        assert (np.diff(m.history) >= -1e-6 * (1 + np.abs(m.history[-1]))).all(), m.family


def dense_em(x, means, family, passes):
    """Plain EM of the two families with closed covariances, from the nearest means."""
    z = np.eye(len(means))[((x[:, None] - means[None]) ** 2).sum(2).argmin(1)]
    logs = []
    for _ in range(passes):
        n = z.sum(0)
        mu = z.T @ x / n[:, None]
        cov = np.stack([(z[:, j] * (x - mu[j]).T) @ (x - mu[j]) / n[j] for j in range(len(n))])
        if family == "EEE":
            cov = np.repeat((cov * n[:, None, None]).sum(0, keepdims=True) / len(x), len(n), 0)
        dens = np.stack([np.exp(-.5 * ((x - mu[j]) @ np.linalg.inv(cov[j]) * (x - mu[j])).sum(1))
                         / np.sqrt(np.linalg.det(2 * np.pi * cov[j])) for j in range(len(n))], 1) * (n / len(x))
        logs.append(np.log(dens.sum(1)).sum())
        z = dens / dens.sum(1, keepdims=True)
    return logs


@pytest.mark.parametrize("family", ["EEE", "VVV"])
def test_covariances_follow_a_dense_em(spark, family):
    rng = np.random.default_rng(12)
    mix = rng.normal(size=(2, 3, 3))
    x = np.concatenate([rng.normal(size=(70, 3)) @ mix[0], rng.normal(size=(50, 3)) @ mix[1] + 2])
    frame = vectors(spark, x, "z").repartition(3)
    fit = cl.mixture_fits(frame, [2], families=(family,), n_start=4)[0]
    start = cl.kmeans_fit(frame, 2, n_start=4, max_iter=100)
    assert fit.history == pytest.approx(dense_em(x, start.means, family, len(fit.history)))


def test_families_follow_the_number_of_vectors(spark):
    x = np.random.default_rng(2).normal(size=(5, 6))
    fits = cl.mixture_fits(vectors(spark, x, "z"), [1], n_start=1)
    assert [m.family for m in fits] == cl.FAMILIES
    # more vectors than bins, but too few in a cluster for its own axes: told as failed, not fitted
    y = np.concatenate([np.random.default_rng(3).normal(size=(6, 4)), np.full((2, 4), 40.0) + np.eye(2, 4)])
    status = {m.family: m.status for m in cl.mixture_fits(vectors(spark, y, "z"), [2], n_start=4)}
    assert status["VVV"] == "failed" and status["EII"] == "ok" and len(status) == 12


@pytest.mark.parametrize("family", cl.FULL_FAMILIES + cl.COMMON_AXES)
def test_family_covariances_are_the_maximum(family):
    rng = np.random.default_rng(4)
    size, p = np.array([20.0, 30, 15]), 3
    roots = rng.normal(size=(3, p, p)) + np.eye(p)
    scatter = size[:, None, None] * np.einsum("kij,klj->kil", roots, roots)
    axes, before = None, np.inf
    for _ in range(2000):
        best, axes = cl.family_covariances(family, size, scatter, axes)
        if axes is None or np.abs(best - before).max() < 1e-13:
            break
        before = best

    def value(cov):
        return -.5 * (size * np.linalg.slogdet(cov)[1]
                      + np.einsum("kij,kji->k", np.linalg.inv(cov), scatter)).sum()

    def turn(scale):
        a = rng.normal(size=(p, p)) * scale
        return np.linalg.qr(np.eye(p) + a - a.T)[0]

    if family[2] == "E" and axes is None:
        own = np.repeat(np.linalg.eigh(best[0])[1][None], 3, 0)
    elif axes is not None:
        own = np.repeat(axes[None], 3, 0)
    else:
        own = np.linalg.eigh(scatter)[1]
    spread = np.einsum("kia,kij,kja->ka", own, best, own)
    assert np.einsum("kia,ka,kja->kij", own, spread, own) == pytest.approx(best)
    volume = np.exp(np.log(spread).mean(1))
    shape = spread / volume[:, None]
    if family[0] == "E":
        assert volume == pytest.approx(np.full(3, volume[0]))
    if family[1] == "E":
        assert shape == pytest.approx(np.repeat(shape[:1], 3, 0))
    top = value(best)
    for scale in (.1, .01, .001):
        for _ in range(100):
            louder = np.exp(rng.normal(0, scale, 3 if family[0] == "V" else 1))
            bent = np.exp(rng.normal(0, scale, (3 if family[1] == "V" else 1, p)))
            bent /= np.exp(np.log(bent).mean(1))[:, None]
            turned = own @ (turn(scale) if family[2] == "E" else np.stack([turn(scale) for _ in range(3)]))
            other = spread * bent * np.broadcast_to(louder, 3)[:, None]
            assert value(np.einsum("kia,ka,kja->kij", turned, other, turned)) <= top + 1e-7


def test_number_of_parameters():
    assert [cl.family_parameters(f, 3, 4) for f in cl.FAMILIES] == [14 + n for n in (1, 3, 4, 6, 10, 12)]
    assert [cl.family_parameters(f, 3, 4) for f in cl.FULL_FAMILIES + cl.COMMON_AXES] == [
        14 + n for n in (10, 12, 22, 24, 28, 30, 16, 18)]


@pytest.mark.parametrize("family", cl.FAMILIES)
def test_family_variances_are_the_maximum(family):
    rng = np.random.default_rng(3)
    size, scatter = np.array([20.0, 30, 15]), rng.gamma(2, 3, (3, 4)) * 10
    best = cl.family_variances(family, size, scatter)

    def value(v):
        return -.5 * (size[:, None] * np.log(v) + scatter / v).sum()

    top = value(best)
    for _ in range(200):
        bump = np.exp(rng.normal(0, .05, (3, 4)))
        if family == "EII":
            other = best * bump[0, 0]
        elif family == "VII":
            other = best * bump[:, :1]
        elif family == "EEI":
            other = best * bump[:1]
        elif family == "VEI":
            other = best * bump[:, :1] * bump[:1]
        elif family == "EVI":
            shape = bump / np.exp(np.log(bump).mean(1))[:, None]
            other = best * shape * bump[0, 0]
        else:
            other = best * bump
        assert value(other) <= top + 1e-7
    assert cl.family_parameters("VVI", 3, 4) == 12 + 2 + 12


def long_points(spark, x):
    rows = [(f"f{i}", float(j + 1), float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "file string, x double, delta double")


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_model_save_load_and_predict(spark, tmp_path, method):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(.5, .1, (12, 5)), rng.normal(-.5, .1, (9, 5))])
    points = long_points(spark, x)
    model = cl.train_model(points, method, 2, auto_select_k=False, n_start=5)
    path = cl.save_model(spark, model, str(tmp_path))
    again = cl.load_model(spark, path)
    assert again.centers == pytest.approx(model.centers) and again.types == model.types
    assert sorted(again.types) == ["contraction-dominant", "expansion-dominant"]
    a = {r["file"]: r for r in cl.train_assignments(points, model).collect()}
    b = {r["file"]: r for r in cl.train_assignments(points, again).collect()}
    assert a == b
    assert len({a[f"f{i}"]["cluster"] for i in range(12)}) == 1
    assert all(r["pC1"] + r["pC2"] == pytest.approx(1) for r in a.values())
    preds = cl.bin_predictions(points, again)
    assert preds.count() == 21 * 5
    first = preds.filter("file = 'f0' AND bin = 2").first()
    assert first["mid"] == 2.5 and first["y_bin"] == pytest.approx(x[0, 1])
    if method == "kmeans":
        assert first["y_pred"] == pytest.approx(x[:12, 1].mean())
    wide = cl.center_frame(spark, model)
    assert wide.columns == [f"bin_{i}" for i in range(1, 6)] + ["cluster", "cluster_type"]


def test_starts_come_from_distinct_vectors(spark):
    rows = [(i, [0.0, 0.0]) for i in range(800)] + [(1000 + i, [float(i), float(i * i % 7)]) for i in range(1, 31)]
    frame = spark.createDataFrame(rows, "id long, z array<double>")
    assert cl.kmeans_fit(frame, 3, n_start=2).k == 3
    fits = cl.mixture_fits(frame, range(1, 4), families=("EII",), n_start=2, max_iter=3)
    assert [m.k for m in fits] == [1, 2, 3]


def test_every_number_of_clusters_is_reported(spark):
    frame = spark.createDataFrame([(i, [float(i % 2)]) for i in range(20)], "id long, z array<double>")
    fits = cl.mixture_fits(frame, range(1, 5), families=("EII",), n_start=2)
    status = {r["k"]: r["status"] for r in cl.bic_table(spark, fits).collect()}
    assert set(status) == {1, 2, 3, 4}
    assert status[3] == status[4] == "fewer distinct vectors"
    cut = cl.mixture_fits(spark.createDataFrame(
        [(i, [float(i), float(i * i % 11)]) for i in range(40)], "id long, z array<double>"),
        [3], families=("VVI",), n_start=1, max_iter=1)
    assert [m.status for m in cut] == ["not converged"]


def drawn(merges, n):
    """Leaf order by recursion over the merge table."""
    tree = {i: (0.0, 1, i, [i]) for i in range(1, n + 1)}
    for r in merges:
        one, two = sorted((tree[r["a"]], tree.pop(r["b"])), key=lambda t: t[:3])
        tree[r["into"]] = (r["height"], r["size"], r["into"], one[3] + two[3])
    return tree[1][3]


@pytest.mark.parametrize("kind", ["random", "chain", "ties"])
def test_leaf_order_equals_the_recursive_one(spark, kind):
    rng = np.random.default_rng(5)
    x = {"random": rng.normal(size=(37, 3)), "chain": np.array([[1.7 ** i] for i in range(20)]),
         "ties": np.array([[float(i % 4), float(i // 4)] for i in range(16)])}[kind]
    points = vectors(spark, x)
    merges = hi.ward_merges(points, "vec")
    rows = sorted(merges.collect(), key=lambda r: (r["height"], r["size"]))
    first = min(r["id"] for r in points.collect())
    shifted = [{**r.asDict(), **{c: r[c] - first + 1 for c in ("a", "b", "into")}} for r in rows]
    found = sorted(hi.leaf_order(merges, points).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(1, len(x) + 1))
    assert [r["id"] - first + 1 for r in found] == drawn(shifted, len(x))


def test_rounds_keep_partners_and_give_the_same_tree(spark):
    x = np.random.default_rng(8).normal(size=(60, 4))
    rounds = []
    ours = hi.ward_merges(vectors(spark, x), "vec", 1, 16, rounds).collect()
    local = hi.ward_merges(vectors(spark, x), "vec").collect()
    key = lambda r: (r["a"], r["b"], r["size"], round(r["height"], 9))
    assert sorted(map(key, ours)) == sorted(map(key, local))
    assert rounds[0][1:] == (60, 3600) and sum(done for *_, done in rounds[1:]) < 0.8 * sum(n * n for _, n, _ in rounds[1:])


@pytest.mark.parametrize("kind", ["blobs", "grid"])
def test_cells_give_the_tree_of_all_blocks(spark, kind):
    rng = np.random.default_rng(11)
    x = blobs(4, (120, 70, 30), 3) if kind == "blobs" else rng.integers(0, 5, (220, 3)).astype(float)
    points = vectors(spark, x)
    key = lambda r: (r["a"], r["b"], r["into"], r["size"], r["height"])
    by_blocks = hi.ward_merges(points, "vec", 60, 32)
    by_cells = hi.ward_merges(points, "vec", 60, cell=12)
    assert sorted(map(key, by_cells.collect())) == sorted(map(key, by_blocks.collect()))


def test_cells_that_cannot_hold_a_partner_are_not_searched(spark):
    x = np.concatenate([np.random.default_rng(i).normal(size=(40, 3)) + 50 * i for i in range(6)])
    state = vectors(spark, x).withColumn("size", F.lit(1).cast("bigint"))
    near, (placed, asked) = hi._nearest_by_cells(state, len(x), 20)
    searched = asked.select(F.sum(F.size("targets"))).first()[0]
    assert placed.select("number").distinct().count() >= 6 and searched < 4 * len(x)
    best = {r["id"]: r["c"] for r in near.groupBy("id").agg(F.min(F.struct("cost", "partner")).alias("c")).collect()}
    cost = hi._ward_costs(x, np.ones(len(x)), x, np.ones(len(x)))
    np.fill_diagonal(cost, np.inf)
    assert {i: tuple(c) for i, c in best.items()} == {i: (row.min(), row.argmin()) for i, row in enumerate(cost)}


@pytest.mark.parametrize("kind", ["near", "ties"])
def test_a_cell_is_searched_exactly(kind, monkeypatch):
    monkeypatch.setattr(hi, "LEAF", 7)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(130, 4)) + 1e6 if kind == "near" else rng.integers(0, 4, (130, 4)).astype(float)
    size = rng.integers(1, 40, 130) if kind == "near" else np.repeat([1, 3], 65)
    frame = hi.pd.DataFrame({"id": rng.permutation(130), "vec": list(x), "size": size})
    cells = hi._Cells(x.mean(0), np.linalg.eigh(np.cov(x.T))[1], {})
    ask, cost = frame.iloc[:80].assign(cost=np.inf, partner=-1), hi._ward_costs(x, size.astype(float), x, size.astype(float))
    np.fill_diagonal(cost, np.inf)
    best, who = hi._look_in_cell(ask, frame, cells, True)
    want = [min(zip(row, frame["id"])) for row in cost[:80]]
    assert list(zip(best, who)) == want
    # what was found before stays unless the cell has better
    held = ask.assign(cost=[c * (.5 if i % 2 else 1) for i, (c, _) in enumerate(want)], partner=-1)
    best, who = hi._look_in_cell(held, frame, cells, True)
    assert list(best) == list(held["cost"]) and (who == -1).all()


def test_equal_points_take_no_rounds(spark):
    x = np.repeat(np.array([[0.0, 0], [5, 5], [9, 0], [7, 1]]), [30, 1, 25, 4], axis=0)
    points, rounds = vectors(spark, x), []
    key = lambda r: (r["a"], r["b"], r["into"], r["size"], r["height"])
    ours = hi.ward_merges(points, "vec", 1, 16, rounds).collect()
    assert len(rounds) <= 3 and rounds[0][1] == 4
    assert [r for r in sorted(map(key, ours)) if not r[4]] == [r for r in sorted(map(key, hi.ward_merges(points, "vec").collect())) if not r[4]]


def test_complete_linkage_order():
    from tractwise.plans.tree import complete_linkage_order

    x = np.array([0.0, 10.0, 1.0, 11.5, 4.0])  # (1, 3) at 1.5 is lower than ((0, 2), 4) at 4; in that, the point comes first
    assert complete_linkage_order(np.abs(x[:, None] - x)) == [1, 3, 4, 0, 2]
    assert complete_linkage_order(np.zeros((1, 1))) == [0] and complete_linkage_order(np.zeros((0, 0))) == []


def test_a_pass_reads_packed_blocks_and_adds_what_rows_add(spark):
    x = blobs(3, (900, 700, 500), 5)
    centers = np.stack([x[:3], x[900:903], x[[0, 950, 1900]]])
    with cl._packed(vectors(spark, x, "z"), "z") as blocks:
        assert [f.name for f in blocks.schema] == ["n", "block"]
        assert blocks.count() < 20 and blocks.agg(F.sum("n")).first()[0] == len(x)
        models = [cl._Candidate(i, c) for i, c in enumerate(centers)]
        found = cl._means_pass(blocks, models)
        direct, cl.DIRECT_SUMS = cl.DIRECT_SUMS, 0
        try:
            added = cl._means_pass(blocks, models)
        finally:
            cl.DIRECT_SUMS = direct
    for m in models:
        gap = ((x[:, None] - m.means[None]) ** 2).sum(2)
        onto = np.eye(3)[gap.argmin(1)]
        for size, sums, goal in (found[m.name], added[m.name]):
            assert (size == onto.sum(0)).all()
            assert np.allclose(sums, onto.T @ x) and np.isclose(goal, gap.min(1).sum())


def test_distances_keep_their_digits_far_from_the_middle():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 3)), 1e6 + rng.normal(size=(40, 3)), np.full((3, 3), 1e6)])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = hi._distances(x, x, x.mean(0))
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[80:, 80:] == 0).all()


def test_blocks_meet_once(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))

    def compare(a, b):
        return a.head(1)[["_a", "_b"]] if len(a) and len(b) else a.head(0)[["_a", "_b"]]

    points = vectors(spark, x)
    met = hi._block_pairs(points, ["id", "vec"], 60, 10, compare, "_a int, _b int").collect()
    assert len(met) == len({frozenset((r["_a"], r["_b"])) for r in met}) == 21


@pytest.mark.parametrize("single", [True, False])
def test_nearest_partner_is_exact_among_equal_and_near_points(single):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 3, size=(700, 2)).astype(float), 1e5 + 1e-6 * rng.normal(size=(200, 2)),
                        rng.normal(size=(300, 2))])
    size = np.ones(len(x)) if single else rng.integers(1, 5, len(x)).astype(float)
    order = rng.permutation(len(x))
    parts = []
    for ids in (order[:600], order[600:]):
        parts.append(hi.pd.DataFrame({"id": ids, "vec": list(x[ids]), "size": size[ids]}))
    found = hi._nearest_in_block(*parts).set_index("id")
    for own, other in (parts, parts[::-1]):
        ids, others = own["id"].to_numpy(), np.sort(other["id"].to_numpy())
        cost = hi._ward_costs(x[ids], size[ids], x[others], size[others])
        assert (found.loc[ids, "cost"] == cost.min(1)).all()
        assert (found.loc[ids, "partner"] == others[cost.argmin(1)]).all()
