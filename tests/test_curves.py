import itertools

import numpy as np
import pytest

from tractwise.operators import smoothers as sm
from tractwise.plans.curves import curve_batch


def frame(spark, sets):
    rows = [(name, float(i + 1), float(v)) for name, y in sets.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "dataset string, x double, delta double")


def test_basis_size():
    assert [sm.basis_size(n) for n in (3, 48, 60, 200)] == [10, 12, 15, 20]


def test_line_is_returned_and_limit_is_linear():
    x = np.arange(1, 41.0)
    basis = sm.SplineBasis(x, 10)
    line = 0.3 - 0.02 * x
    fitted, se, edf, _, _ = basis.fit(line[:, None])
    assert fitted[:, 0] == pytest.approx(line) and se.max() < 1e-6
    y = np.sin(x / 5)
    heavy = basis.line @ (basis.line.T @ y) + basis.wave @ (basis.shrink(np.array([60.0]))[0]
                                                            * (basis.wave.T @ y))
    assert heavy == pytest.approx(np.polyval(np.polyfit(x, y, 1), x), abs=1e-8)


def test_fit_equals_dense_penalised_least_squares():
    rng = np.random.default_rng(0)
    x = np.sort(rng.choice(np.arange(1, 120), 60, replace=False)).astype(float)
    y = np.sin(x / 12) + rng.normal(0, .2, 60)
    k = 15
    basis = sm.SplineBasis(x, k)
    fitted, se, edf, log_lambda, kept = basis.fit(y[:, None])
    # the same model written out: kernel eigenvectors, null space constraint, explicit penalty
    gap = x - x.mean()
    kernel = np.abs(gap[:, None] - gap) ** 3 / 12
    w, v = np.linalg.eigh(kernel)
    lead = np.argsort(-np.abs(w))[:k]
    t = np.column_stack([np.ones(60), gap])
    z = np.linalg.svd((v[:, lead].T @ t).T)[2][2:].T
    design = np.column_stack([t, (v[:, lead] * w[lead]) @ z])
    penalty = np.zeros((k, k))
    penalty[2:, 2:] = z.T @ np.diag(w[lead]) @ z
    inverse = np.linalg.pinv(design.T @ design + np.exp(log_lambda[0]) * penalty, rcond=1e-14)
    hat = design @ inverse @ design.T
    assert fitted[:, 0] == pytest.approx(hat @ y, abs=1e-5)
    assert edf[0] == pytest.approx(np.trace(hat), abs=1e-4)
    sigma2 = ((y - hat @ y) ** 2).sum() / (60 - np.trace(hat))
    assert se[:, 0] == pytest.approx(np.sqrt(np.diag(hat) * sigma2), rel=1e-4)

    def reml(log_l):
        cov = np.eye(60) + design[:, 2:] @ np.linalg.solve(penalty[2:, 2:], design[:, 2:].T) / np.exp(log_l)
        inv = np.linalg.inv(cov)
        info = t.T @ inv @ t
        r = y - t @ np.linalg.solve(info, t.T @ inv @ y)
        return (58 * np.log(r @ inv @ r) + np.linalg.slogdet(cov)[1] + np.linalg.slogdet(info)[1])

    best = reml(log_lambda[0])
    assert all(best <= reml(log_lambda[0] + d) + 1e-6 for d in (-1, -.2, .2, 1))


def test_bands_and_statuses(spark):
    x = np.arange(60)
    rng = np.random.default_rng(1)
    sets = {"bump": np.exp(-((x - 20) / 6.0) ** 2) + rng.normal(0, .02, 60),
            "flat": rng.normal(0, .001, 60), "short": [0.1, 0.2, 0.1, 0.3, 0.2, 0.1]}
    got = {}
    for r in sm.spline_fit(frame(spark, sets), tau=0.05).orderBy("x").collect():
        got.setdefault(r["dataset"], []).append(r)
    assert {r["status"] for r in got["bump"]} == {"ok"}
    assert got["bump"][20]["label_fit"] == "expansion" and got["bump"][55]["label_fit"] == "neutral"
    assert {r["label_fit"] for r in got["flat"]} == {"neutral"}
    assert len(got["short"]) == 6 and got["short"][0]["status"].startswith("no fit")
    assert got["short"][0]["fit"] is None and got["short"][0]["label_fit"] == "neutral"
    wide = sm.spline_fit(frame(spark, {"bump": sets["bump"]}), simultaneous=True, draws=2000)
    a, b = wide.orderBy("x").first(), got["bump"][0]
    assert a["upper"] - a["lower"] > b["upper"] - b["lower"]


def brute_segments(y):
    n = len(y)
    best = None
    for size in range(n):
        for cuts in itertools.combinations(range(1, n), size):
            ends = [0, *cuts, n]
            cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() + np.log(b - a)
                       for a, b in zip(ends, ends[1:])) + 3 * np.log(n) * size
            if best is None or cost < best[0] - 1e-12:
                best = (cost, cuts)
    return best[1]


def test_changes_equal_full_enumeration():
    rng = np.random.default_rng(2)
    for n in (3, 7, 11):
        y = np.column_stack([np.repeat(rng.normal(0, 6, 4), 3)[:n] + rng.normal(0, .5, n) for _ in range(6)])
        seg = sm.mean_changes(y)
        for c in range(6):
            assert tuple(np.flatnonzero(np.diff(seg[:, c])) + 1) == brute_segments(y[:, c])


def unpruned(y):
    """Last starts of the plain dynamic programme over all starts, one series."""
    n, (a, b) = len(y), (np.append(0, np.cumsum(v)) for v in (y, y * y))
    best, last = [-3 * np.log(n)], [0]
    for t in range(1, n + 1):
        size = t - np.arange(t)
        cost = np.array(best) + b[t] - b[:t] - (a[t] - a[:t]) ** 2 / size + np.log(size) + 3 * np.log(n)
        last.append(int(cost.argmin()))
        best.append(cost.min())
    cuts, end = [], n
    while last[end] > 0:
        end = last[end]
        cuts.append(end)
    return cuts[::-1]


def test_pruned_changes_equal_the_unpruned_search():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30, 180):
        y = np.column_stack([np.repeat(rng.normal(0, s, n), 1 + i)[:n] + rng.normal(0, .6, n) for i, s in enumerate((0, 1, 2, 4, 9, 30))])
        found = sm.mean_changes(y)
        alone = np.hstack([sm.mean_changes(y[:, c:c + 1]) for c in range(y.shape[1])])
        assert (found == alone).all()
        for c in range(y.shape[1]):
            assert (np.flatnonzero(np.diff(found[:, c])) + 1).tolist() == unpruned(y[:, c])
    long = np.repeat(rng.normal(0, 20, 4000), 5)[:, None] + rng.normal(0, 1, (20000, 1))
    assert sm.mean_changes(long).max() > 3000


def test_series_too_short_to_smooth_are_neutral(spark):
    rows = sm.changepoint_labels(frame(spark, {"s": [5.0, 6.0]})).collect()
    assert [(r["cp_segment"], r["cp_mean"], r["label_cp"]) for r in rows] == [(1, None, "neutral")] * 2


def test_changepoint_labels(spark):
    y = [0.0] * 40 + [0.4] * 40 + [-0.4] * 40
    rows = sm.changepoint_labels(frame(spark, {"s": y}), standardize=True).orderBy("x").collect()
    assert [r["label_cp"] for r in rows[5:35]] == ["neutral"] * 30
    assert [r["label_cp"] for r in rows[45:75]] == ["expansion"] * 30
    assert [r["label_cp"] for r in rows[85:115]] == ["contraction"] * 30
    plain = sm.changepoint_labels(frame(spark, {"s": y})).collect()
    assert {r["cp_segment"] for r in plain} == {1}  # unit variance is assumed, so nothing is found


def test_batch_tables(spark):
    x = np.arange(80)
    rng = np.random.default_rng(5)
    bump = .6 * np.exp(-((x - 20) / 8.0) ** 2) - .6 * np.exp(-((x - 55) / 8.0) ** 2)
    sets = {"wave": bump + rng.normal(0, .01, 80), "none": rng.normal(0, 1e-4, 80), "tiny": [0.1, 0.2]}
    batch = curve_batch(frame(spark, sets), standardize=True)
    metrics = {r["file"]: r for r in batch.metrics.collect()}
    assert metrics["tiny"]["n_points"] == 0 and metrics["tiny"]["max_length"] is None
    assert metrics["tiny"]["summary"] == "no data ≤ 250" and metrics["tiny"]["n_pred_exp"] == 0
    assert metrics["none"]["summary"] == "no robust change segments"
    assert "expansion between lengths" in metrics["wave"]["summary"]
    assert metrics["wave"]["n_pred_exp"] >= 1 and metrics["wave"]["n_truth_con"] >= 1
    segs = batch.segments.collect()
    assert {(r["dataset"], r["label"]) for r in segs if r["label"] == "none"} == {
        ("none", "none"), ("tiny", "none")}
    assert {r["source"] for r in segs} == {"consensus", "GAM", "PELT"}
    panel = batch.panel.filter("dataset = 'wave'").collect()
    assert len(panel) == 80 and {r["band"] for r in panel} == {None, "expansion", "contraction"}


def test_areas_are_the_same_on_lazy_and_settled_inputs(spark):
    from tractwise.operators.series import segment_areas, segment_counts, segment_curves
    from tractwise.session import settle

    pred = spark.createDataFrame(
        [(f"d{i}", s, float(10 * k), float(10 * k + 8), 0.1 * k + 0.01 * i) for i in range(20)
         for s in ("expansion", "contraction") for k in range(1, 4)],
        "dataset string, label string, start_rl double, end_rl double, mean_eff double")
    truth = pred.filter("start_rl > 10").select("dataset", "label", "start_rl", "end_rl")
    sets = pred.select("dataset").distinct()

    def areas(p, t, d):
        return sorted(map(tuple, segment_areas(segment_curves(p, t, d), segment_counts(p, t, d)).collect()))

    lazy, settled = areas(pred, truth, sets), areas(settle(pred), settle(truth), settle(sets))
    assert lazy == settled and len(lazy) == 40
    assert all(r[-1] is not None for r in lazy)


def test_repeated_lengths_do_not_multiply(spark):
    from tractwise.operators.smoothers import changepoint_labels, consensus, spline_fit

    rows = [("d", float(x), 0.01 * x) for x in range(30)] + [("d", 7.0, 0.5)]
    series = spark.createDataFrame(rows, "dataset string, x double, delta double")
    both = consensus(spline_fit(series), changepoint_labels(series))
    assert both.count() == len(rows)
    assert sorted(r["delta"] for r in both.filter("x = 7").collect()) == [0.07, 0.5]


def test_series_are_fitted_in_bounded_pieces():
    batch = sm.pd.DataFrame({"dataset": [f"s{i}" for i in range(600)]})
    parts = list(sm._pieces(iter([batch, batch.head(3)])))
    assert max(map(len, parts)) <= 256
    assert [n for p in parts for n in p["dataset"]] == [*batch["dataset"], "s0", "s1", "s2"]


def test_the_band_of_all_lengths_is_that_of_each_draw():
    x = np.arange(40.0)
    basis = sm.SplineBasis(x, 10)
    kept = basis.fit(np.sin(x / 5)[:, None])[4][0]
    normals = np.random.default_rng(1).standard_normal((2 + len(kept), 3000))
    paths = basis.line @ normals[:2] + (basis.wave * np.sqrt(kept)) @ normals[2:]
    scale = np.sqrt(basis.unit_variance(kept[None, :])[:, 0])
    assert np.isclose(basis.simultaneous(kept, normals), np.quantile(np.abs(paths / scale[:, None]).max(0), 0.95))
