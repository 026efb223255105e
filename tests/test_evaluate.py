import numpy as np
import pytest

from tractwise.operators import evaluate


def frame(spark, sets):
    rows = [(k, int(y) if y is not None else None, float(s)) for k, (ys, ss) in sets.items()
            for y, s in zip(ys, ss)]
    return spark.createDataFrame(rows, "k string, y int, score double")


def brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    v1 = np.array([((neg < p) + 0.5 * (neg == p)).mean() for p in pos])
    v0 = np.array([((pos > n) + 0.5 * (pos == n)).mean() for n in neg])
    up = v1.mean()
    auc = 1 - up if np.median(neg) > np.median(pos) else up
    se = np.sqrt(v1.var(ddof=1) / len(pos) + v0.var(ddof=1) / len(neg))
    return auc, 1 - up, max(0, 1 - up - 1.959963984540054 * se), min(1, 1 - up + 1.959963984540054 * se)


def sets():
    rng = np.random.default_rng(5)
    out = {}
    for i in range(8):
        y = rng.integers(0, 2, 40)
        out[f"k{i}"] = (y, np.round(rng.normal(size=40) + y * rng.normal(), 1))
    return out


def test_auc_with_ties_and_interval(spark):
    data = sets()
    got = {r["k"]: r for r in evaluate.auc(frame(spark, data), ["k"]).collect()}
    for name, (y, s) in data.items():
        r = got[name]
        assert (r["auc"], r["auc_fixed"], r["ci_low"], r["ci_high"]) == pytest.approx(brute(y, s))


def test_pooled_equals_brute_force(spark):
    data = sets()
    y = np.concatenate([v[0] for v in data.values()])
    s = np.concatenate([v[1] for v in data.values()])
    r = evaluate.auc(frame(spark, data)).first()
    assert (r["auc"], r["auc_fixed"], r["ci_low"], r["ci_high"]) == pytest.approx(brute(y, s))


def test_one_class_gives_null(spark):
    r = evaluate.auc(frame(spark, {"a": ([1, 1, None], [1, 2, 3])}), ["k"]).first()
    assert r["k"] == "a" and r["auc"] is None
    assert evaluate.roc_points(frame(spark, {"a": ([1, 1], [1, 2])}), ["k"]).count() == 0


def test_mirrored_labels_and_scores_give_the_same_area(spark):
    data = sets()
    mirrored = {k: (1 - y, -s) for k, (y, s) in data.items()}
    a = {r["k"]: r["auc"] for r in evaluate.auc(frame(spark, data), ["k"]).collect()}
    b = {r["k"]: r["auc"] for r in evaluate.auc(frame(spark, mirrored), ["k"]).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("fixed", [True, False])
def test_curve_area_is_the_auc(spark, fixed):
    data = sets()
    df = frame(spark, data)
    areas = {r["k"]: r["auc_fixed"] if fixed else 1 - r["auc_fixed"]
             for r in evaluate.auc(df, ["k"]).collect()}
    points = {}
    for r in evaluate.roc_points(df, ["k"], fixed=fixed).collect():
        points.setdefault(r["k"], []).append((r["fpr"], r["tpr"]))
    for name, curve in points.items():
        curve = np.array(sorted(curve))
        assert curve[0].tolist() == [0, 0] and curve[-1].tolist() == [1, 1]
        width = np.diff(curve[:, 0])
        assert (width * (curve[1:, 1] + curve[:-1, 1]) / 2).sum() == pytest.approx(areas[name])
