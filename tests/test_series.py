import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.functions.columns import tau_label
from tractwise.operators import series as se


def frame(spark, values, name="d", start=1):
    rows = [(name, float(start + i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, x double, delta double")


def segs(spark, rows):
    return spark.createDataFrame(
        rows, "dataset string, label string, start_rl double, end_rl double, len int, "
              "mean_eff double, max_abs double")


def rolled(y, k, edges):
    before, after = (k - 1) // 2, k // 2
    out = [np.mean(y[i - before:i + after + 1]) if i >= before and i + after < len(y) else None
           for i in range(len(y))]
    known = [v for v in out if v is not None]
    if edges == "raw":
        return [y[i] if v is None else v for i, v in enumerate(out)]
    return [(known[0] if i < len(y) / 2 else known[-1]) if v is None else v for i, v in enumerate(out)]


@pytest.mark.parametrize("k,edges", [(5, "raw"), (4, "raw"), (3, "extend"), (5, "extend")])
def test_rolling_mean(spark, k, edges):
    y = np.random.default_rng(k).normal(size=12)
    got = se.rolling_mean(frame(spark, y), "delta", "m", k, edges).orderBy("x").collect()
    assert [r["m"] for r in got] == pytest.approx(rolled(y, k, edges))


def test_short_series_stays_raw(spark):
    got = se.smooth(frame(spark, [1, 2, 3])).orderBy("x").collect()
    assert [r["yf"] for r in got] == [1, 2, 3]


def test_segments_follow_rows_not_lengths(spark):
    df = frame(spark, [.1, .2, .3, 0, -.1, -.1, .5, .5, .5, .5]).withColumn(
        "x", F.when(F.col("x") >= 9, F.col("x") + 50).otherwise(F.col("x")))
    labelled = df.withColumn("l", tau_label(F.col("delta"), 0.05))
    got = {(r["label"], r["start_rl"], r["end_rl"], r["len"]): r
           for r in se.segments(labelled, "l", "delta").collect()}
    assert set(got) == {("expansion", 1.0, 3.0, 3), ("expansion", 7.0, 60.0, 4)}
    assert got[("expansion", 1.0, 3.0, 3)]["mean_eff"] == pytest.approx(0.2)


def test_summary_text(spark):
    found = segs(spark, [("a", "expansion", 3., 9., 3, .1, .1), ("a", "contraction", 20., 22.5, 3, -.1, .1),
                         ("a", "expansion", 12., 15., 3, .1, .1)])
    names = spark.createDataFrame([("a",), ("b",)], "dataset string")
    got = {r[0]: r[1] for r in se.segment_summary(found, names).collect()}
    assert got == {"a": "contraction between lengths 20–22.5, expansion between lengths 3–15",
                   "b": "no robust change segments"}


def test_one_point_overlap_counts_nothing(spark):
    pred = segs(spark, [("a", "expansion", 5., 5., 1, .1, .1), ("a", "expansion", 1., 4., 4, .2, .2)])
    truth = segs(spark, [("a", "expansion", 4., 6., 3, .1, .1)])
    got = {r["start_rl"]: r["best_iou"] for r in se.segment_iou(pred, truth).collect()}
    assert got == {5.0: 0.0, 1.0: 0.0}


def brute_curve(pred, truth, thr):
    def iou(p, t):
        hull = max(p[1], t[1]) - min(p[0], t[0])
        return max(0, min(p[1], t[1]) - max(p[0], t[0])) / hull if hull > 0 else 0

    rows = []
    for cut in sorted({p[2] for p in pred}, reverse=True):
        chosen = [p for p in pred if p[2] >= cut]
        hits = [p for p in chosen if max(iou(p, t) for t in truth) >= thr]
        tp, fp = len(hits), len(chosen) - len(hits)
        fn = sum(not any(iou(p, t) >= thr for p in hits) for t in truth)
        rows.append((cut, tp, fp, fn, tp / max(tp + fp, 1e-9), tp / max(tp + fn, 1e-9),
                     fp / max(fp + len(truth) - tp, 1e-9)))
    return rows


def area(xs, ys):
    order = sorted(range(len(xs)), key=lambda i: xs[i])
    if len(order) < 2:
        return None
    return sum((xs[b] - xs[a]) * (ys[a] + ys[b]) / 2 for a, b in zip(order, order[1:]))


def test_curves_and_areas_against_brute_force(spark):
    rng = np.random.default_rng(3)
    preds, truths, expected = [], [], {}
    for d in range(12):
        sets = []
        for _ in range(2):
            cuts = np.sort(rng.choice(np.arange(1, 120), 2 * rng.integers(0, 7), replace=False))
            sets.append([(float(a), float(b), float(rng.integers(1, 5)) / 10)
                         for a, b in zip(cuts[::2], cuts[1::2])])
        p, t = sets
        preds += [(f"d{d}", "expansion", a, b, 3, s, s) for a, b, s in p]
        truths += [(f"d{d}", "expansion", a, b, 3, s, s) for a, b, s in t]
        expected[f"d{d}"] = brute_curve(p, t, 0.3) if p and t else None
    pred, truth = segs(spark, preds), segs(spark, truths)
    names = spark.createDataFrame([(f"d{d}",) for d in range(12)], "dataset string")
    curves = se.segment_curves(pred, truth, names)
    areas = {r["dataset"]: r for r in se.segment_areas(
        curves, se.segment_counts(pred, truth, names)).filter("label = 'expansion'").collect()}
    got = {}
    for r in curves.filter("label = 'expansion'").orderBy("dataset", "step").collect():
        got.setdefault(r["dataset"], []).append(r)
    for name, rows in expected.items():
        if rows is None:
            assert [(r["recall"], r["fpr"]) for r in got[name]] == [(0, 0), (1, 1)]
            assert areas[name]["auc_roc"] is None
            continue
        assert [(r["threshold"], r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["fpr"])
                for r in got[name]] == [pytest.approx(r) for r in rows]
        for field, x, y in (("auc_roc", 6, 5), ("auc_pr", 5, 4)):
            want = area([r[x] for r in rows], [r[y] for r in rows])
            assert areas[name][field] == (None if want is None else pytest.approx(want))


def test_fallback_precision(spark):
    truth = segs(spark, [("a", "expansion", 4., 6., 3, .1, .1)])
    names = spark.createDataFrame([("a",)], "dataset string")
    rows = se.segment_curves(truth.limit(0), truth, names).filter("label = 'expansion'").orderBy("step")
    assert [r["precision"] for r in rows.collect()] == [1.0, pytest.approx(1 / (1 + 1e-9))]
    with pytest.raises(ValueError):
        se.segment_curves(truth, truth, names, 0)
